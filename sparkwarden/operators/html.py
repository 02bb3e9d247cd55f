"""The markup of web pages: tags, their attributes, comments and raw texts, and checks on them.

One pattern is the tokenizer's state machine: at each place of a page where markup can begin it takes a whole comment, a
whole element of raw text (its tags are text), a declaration, or a tag up to the first `>` that is in no quoted value. So
what stands in a comment, a script or a value is never taken for a tag. All its loops are possessive: Java runs them
without a stack frame a turn, and no page makes it go back. Nothing moves until tokens are put in order within a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: white space of HTML, elements whose content is text ---
SPACE = r"\x09\x0A\x0C\x0D\x20"
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")


def _any_case(name: str) -> str:
    return "".join(f"[{c}{c.upper()}]" for c in name)


def patterns(possessive: bool = True) -> tuple[str, str, str]:
    """The patterns of a piece of markup, of a tag, and of an attribute (name, value). Without possessive loops, for engines that
    need none: as the alternatives of a loop begin with different characters and a tag may end with the text, nothing is
    ever tried a second way."""
    p = "+" if possessive else ""
    # a quote opens a value after an equals sign only; one that is never closed is a character like others
    rest = rf"(?:[^>\"'=]+{p}|=[{SPACE}]*{p}(?:\"[^\"]*\"|'[^']*')?{p}|[\"'])*{p}"
    raw = "|".join(rf"<{_any_case(n)}(?:[{SPACE}/]{rest})?(?:>(?s:.*?)(?:</{_any_case(n)}(?:[{SPACE}/][^>]*{p})?(?:>|\z)|\z)|\z)" for n in RAW)
    tag = rf"</?[A-Za-z][^{SPACE}/>]*{p}{rest}(?:>|\z)"
    markup = rf"<!--(?:-?>|(?s:.*?)(?:--!?>|\z))|{raw}|{tag}|<[!?/][^>]*{p}(?:>|\z)"
    return markup, tag, rf"([^{SPACE}/>=\"'][^{SPACE}/>=]*)(?:[{SPACE}]*=[{SPACE}]*(\"[^\"]*\"|'[^']*'|[^{SPACE}>\"'][^{SPACE}>]*)?)?"


MARKUP, TAG, ATTRIBUTE = patterns()
_NAME = rf"^</?([A-Za-z][^{SPACE}/>]*)"


def tokens(pages: DataFrame, key: str, html: str, *carried: str) -> DataFrame:
    """(key, carried columns, ord, kind, name, attributes, body) for each piece of markup, in its order from 1.

    kind: start, end, comment, declaration (also processing instructions and closing tags without a name), or cut (a tag
    or raw element's tag that the text ends in; it has no attributes). name: of a tag, in lower case. attributes: an array of
    (name in lower case, value as written without its quotes, '' if there is none), the first of equal names only. body: what
    is in a comment or an element of raw text, else null; one without an end lasts to the end of the text. Null and empty
    pages have no rows, repeated ones have theirs each; a very long page is one task's, column html is not carried on.
    """
    rows = pages.select(key, *carried, F.posexplode(F.regexp_extract_all(html, F.lit(MARKUP), F.lit(0))).alias("pos", "raw"))
    raw = F.col("raw")
    name = F.lower(F.regexp_extract(raw, _NAME, 1))
    comment, tag = raw.startswith("<!--"), raw.rlike("^</?[A-Za-z]")
    opened = F.regexp_extract(raw, rf"^(?:{TAG})", 0)
    whole = F.when(raw.startswith("</"), raw.endswith(">")).otherwise(opened.endswith(">"))
    kind = F.when(comment, "comment").when(~tag, "declaration").when(~whole, "cut").when(raw.startswith("</"), "end").otherwise("start")
    rows = rows.select(key, *carried, (F.col("pos") + 1).alias("ord"), kind.alias("kind"), F.when(tag, name).alias("name"), "raw", opened.alias("opened"))
    inside = F.regexp_replace(F.col("opened"), rf"^<[A-Za-z][^{SPACE}/>]*", "")
    names, values = (F.regexp_extract_all(inside, F.lit(ATTRIBUTE), F.lit(k)) for k in (1, 2))
    bare = F.transform(values, lambda v: F.when(v.rlike("^[\"']"), F.substr(v, F.lit(2), F.length(v) - 2)).otherwise(v))
    pairs = F.zip_with(F.transform(names, F.lower), bare, lambda n, v: F.struct(n.alias("name"), v.alias("value")))
    first = F.filter(pairs, lambda x, k: F.array_position(F.transform(names, F.lower), x["name"]) == k + 1)
    content = F.substr(F.col("raw"), F.length("opened") + 1)
    ended = F.regexp_replace(content, rf"(?i)</(?:{'|'.join(RAW)})[^<>]*>?\z", "")
    body = F.when(F.col("kind") == "comment", F.regexp_replace(F.regexp_replace("raw", r"^<!--(?:-?>\z)?", ""), r"--!?>\z", ""))
    body = body.when((F.col("kind") == "start") & F.col("name").isin(*RAW), ended)
    empty = F.array().cast("array<struct<name:string,value:string>>")
    return rows.select(key, *carried, "ord", "kind", "name", F.when(F.col("kind") == "start", first).otherwise(empty).alias("attributes"), body.alias("body"))


def value(name: str) -> Column:
    """The value of a token's attribute, null if it has none of that name."""
    return F.try_element_at(F.transform(F.filter("attributes", lambda a: a["name"] == name), lambda a: a["value"]), F.lit(1))


def inside(found: DataFrame, key: str, element: str) -> DataFrame:
    """found with `within`: the ord of the open `element` (one that does not nest, such as a form) that a token stands in, null
    if none. A start that follows one which is still open is ignored, as browsers do; found holds a page's tokens by its key,
    so keys must tell pages apart."""
    edge = F.when((F.col("name") == element) & F.col("kind").isin("start", "end"), F.struct("ord", "kind"))
    before = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    runs = found.withColumn("_edge", edge).withColumn("_last", F.last("_edge", ignorenulls=True).over(before))
    # of starts in a row only the first opens; it is the one whose edge before is an end or none
    opens = (F.col("_edge.kind") == "start") & ((F.col("_last.kind") == "end") | F.col("_last").isNull())
    mark = F.when(opens, F.col("ord")).when(F.col("_edge.kind") == "end", F.lit(-1))
    runs = runs.withColumn("_mark", mark)
    return runs.withColumn("within", F.nullif(F.last("_mark", ignorenulls=True).over(before), F.lit(-1))).drop("_edge", "_last", "_mark")


# --- checks ----------------------------------------------------------------------------------------------------------


def _foreign(address: Column) -> Column:
    """Host and path of an address with a host, '' of one without; at most 60 characters."""
    return F.substring(F.regexp_extract(address, r"^(?i:https?:)?//([^\"']+)", 1), 1, 60)


def missing_integrity(found: DataFrame, key: str, most: int = 5) -> DataFrame:
    """(key, scripts, sources): scripts of other hosts without an integrity hash, and the first `most` addresses by name."""
    source = _foreign(F.trim(value("src")))
    rows = found.where((F.col("kind") == "start") & (F.col("name") == "script")).select(key, source.alias("source"), F.coalesce(F.trim(value("integrity")), F.lit("")).alias("hash"))
    rows = rows.where("source <> '' and hash = ''").groupBy(key, "source").agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy(key).orderBy("source")) <= most
    rows = rows.withColumn("shown", F.when(first, F.col("source")))
    return rows.groupBy(key).agg(F.sum("n").alias("scripts"), F.array_join(F.sort_array(F.collect_list("shown")), ", ").alias("sources"))


def inline_code(found: DataFrame, key: str) -> DataFrame:
    """(key, ord, what, at, chars) of code that a page carries itself: scripts without an address (script), attributes that
    handle events (handler) and addresses that are code (address); at: the attribute's name."""
    start = found.where("kind = 'start'")
    script = start.where((F.col("name") == "script") & value("src").isNull() & (F.trim(F.coalesce("body", F.lit(""))) != "")).select(key, "ord", F.lit("script").alias("what"), F.lit("").alias("at"), F.length("body").alias("chars"))
    each = start.select(key, "ord", F.explode("attributes").alias("a"))
    what = F.when(F.col("a.name").rlike("^on[a-z]+$"), "handler").when(F.col("a.name").isin("href", "src", "action", "formaction") & F.col("a.value").rlike(rf"^(?i)[{SPACE}]*javascript:"), "address")
    other = each.select(key, "ord", what.alias("what"), F.col("a.name").alias("at"), F.length("a.value").alias("chars")).where("what is not null")
    return script.unionByName(other)


def forms(found: DataFrame, key: str) -> DataFrame:
    """(key, ord, method, action, fields, passwords, hidden) for each form: what is sent how and where. Fields outside of any
    form have none; a second start tag inside a form is no form."""
    rows = inside(found.where(F.col("name").isin("form", "input", "select", "textarea", "button")), key, "form").where("kind = 'start'")
    kind = F.lower(F.coalesce(value("type"), F.lit("")))
    own = (F.col("name") == "form") & F.col("within").isNull()
    rows = rows.where(own | ((F.col("name") != "form") & F.col("within").isNotNull())).withColumn("form", F.when(own, F.col("ord")).otherwise(F.col("within")))
    field = lambda test: F.coalesce(F.sum((~own & test).cast("long")), F.lit(0))
    return rows.groupBy(key, F.col("form").alias("ord")).agg(
        F.max(F.when(own, F.lower(F.coalesce(value("method"), F.lit("get"))))).alias("method"), F.max(F.when(own, F.coalesce(value("action"), F.lit("")))).alias("action"),
        field(F.lit(True)).alias("fields"), field(kind == "password").alias("passwords"), field(kind == "hidden").alias("hidden"),
    )

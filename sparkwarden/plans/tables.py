"""Queries over the given tables for the operators that need them: markup, rule index, version ranges, bursts, verdicts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sparkwarden.functions import catalog as K
from sparkwarden.functions import text as T
from sparkwarden.operators import bursts, char_model, code_rules, cube, dependencies, html, line_ranges, line_sequences, rule_index
from sparkwarden.operators import version_ranges as ranges_op
from sparkwarden.plans import fixtures as X
from sparkwarden.plans.registry import _LINES, _rule_sql, _secret_sql, _table, query
from sparkwarden.sources import nested_ignore, scratch
from sparkwarden.streaming import verdicts

# --- markup of pages -------------------------------------------------------------------------------------------------------------

_MARKUP, _TAG, _ATTRIBUTE = html.patterns(possessive=False)
_TOKENS = f"""p AS (SELECT page_id, regexp_extract_all(html, {X.literal(_MARKUP)}) AS x FROM pages),
  m AS (SELECT page_id, CAST(generate_subscripts(x, 1) AS INTEGER) AS ord, unnest(x) AS raw FROM p),
  k AS (SELECT *, lower(regexp_extract(raw, '^</?([A-Za-z][^{html.SPACE}/>]*)', 1)) AS name, regexp_extract(raw, {X.literal(f"^(?:{_TAG})")}) AS opened, CASE WHEN starts_with(raw, '<!--') THEN 'comment'
    WHEN NOT regexp_matches(raw, '^</?[A-Za-z]') THEN 'declaration' WHEN starts_with(raw, '</') THEN CASE WHEN ends_with(raw, '>') THEN 'end' ELSE 'cut' END
    WHEN NOT ends_with(regexp_extract(raw, {X.literal(f"^(?:{_TAG})")}), '>') THEN 'cut' ELSE 'start' END AS kind FROM m),
  a AS (SELECT *, CASE WHEN kind = 'start' THEN regexp_replace(opened, '^<[A-Za-z][^{html.SPACE}/>]*', '') ELSE '' END AS inner_text FROM k),
  n AS (SELECT *, list_transform(regexp_extract_all(inner_text, {X.literal(_ATTRIBUTE)}, 1), lambda v: lower(v)) AS names,
    list_transform(regexp_extract_all(inner_text, {X.literal(_ATTRIBUTE)}, 2), lambda v: CASE WHEN regexp_matches(v, '^["'']') THEN v[2:len(v) - 1] ELSE v END) AS vals FROM a),
  t AS (SELECT page_id, ord, kind, CASE WHEN kind IN ('comment', 'declaration') THEN NULL ELSE name END AS name, raw, opened,
    list_filter(list_transform(range(1, len(names) + 1), lambda i: {{'name': names[i], 'value': vals[i], 'first': list_position(names, names[i]) = i}}), lambda s: s.first) AS attributes FROM n)"""


def _pages(spark, sf_dir):
    return html.tokens(_table(spark, sf_dir, "pages"), "page_id", "html")


@query(f"WITH {_TOKENS} SELECT page_id, ord, kind, name, array_to_string(list_transform(attributes, lambda s: s.name || '=' || s.value), chr(10)) AS attributes FROM t")
def html_tokens(spark, sf_dir):
    """Every piece of markup of every page."""
    shown = F.array_join(F.transform("attributes", lambda a: F.concat(a["name"], F.lit("="), a["value"])), "\n")
    return _pages(spark, sf_dir).select("page_id", "ord", "kind", "name", shown.alias("attributes"))


@query(f"""WITH {_TOKENS}, s AS (SELECT *, list_filter(attributes, lambda s: s.name = 'src') AS src, regexp_replace(substr(raw, length(opened) + 1), '(?i)</(?:script|style|textarea|title|xmp|iframe|noembed|noframes)[^<>]*>?\\z', '') AS body FROM t WHERE kind = 'start'),
  e AS (SELECT page_id, ord, unnest(attributes) AS a FROM s)
  SELECT page_id, ord, 'script' AS what, '' AS at, CAST(length(body) AS INTEGER) AS chars FROM s WHERE name = 'script' AND len(src) = 0 AND trim(body) <> ''
  UNION ALL SELECT page_id, ord, CASE WHEN regexp_matches(a.name, '^on[a-z]+$') THEN 'handler' ELSE 'address' END, a.name, CAST(length(a.value) AS INTEGER) FROM e
    WHERE regexp_matches(a.name, '^on[a-z]+$') OR (a.name IN ('href', 'src', 'action', 'formaction') AND regexp_matches(a.value, '^(?i)[{html.SPACE}]*javascript:'))""")  # fmt: skip
def html_inline_code(spark, sf_dir):
    return html.inline_code(_pages(spark, sf_dir), "page_id")


@query(f"""WITH {_TOKENS} SELECT kind, coalesce(name, '') AS name, count(*) AS n, count(DISTINCT page_id) AS pages, CAST(sum(len(attributes)) AS BIGINT) AS attributes FROM t GROUP BY ALL""")
def html_profile(spark, sf_dir):
    """How often which tags stand in how many pages."""
    each = _pages(spark, sf_dir).groupBy("kind", F.coalesce("name", F.lit("")).alias("name"), "page_id").agg(F.count("*").alias("n"), F.sum(F.size("attributes")).alias("attributes"))
    return each.groupBy("kind", "name").agg(F.sum("n").alias("n"), F.count("*").alias("pages"), F.sum("attributes").alias("attributes"))


_ADDRESS = "^(?:([A-Za-z][A-Za-z0-9+.-]*):)?//([^/?#]*)"


@query(f"""WITH {_TOKENS}, e AS (SELECT page_id, name AS tag, unnest(attributes) AS a FROM t WHERE kind = 'start'),
  l AS (SELECT *, lower(coalesce(nullif(regexp_extract(a.value, '{_ADDRESS}', 2), ''), regexp_extract(url, '{_ADDRESS}', 2))) AS host FROM e JOIN pages USING (page_id) WHERE a.name IN ('href', 'src', 'action', 'formaction'))
  SELECT tag, a.name AS at, host, count(*) AS n, count(DISTINCT a.value) AS addresses, count(DISTINCT page_id) AS pages,
    count(*) FILTER (starts_with(lower(url), 'https:') AND starts_with(lower(a.value), 'http:')) AS mixed FROM l GROUP BY ALL""")  # fmt: skip
def html_links(spark, sf_dir):
    """Hosts that pages point to, their own if an address has none, and how often a page that came encrypted points to an address that does not."""
    found = html.tokens(_table(spark, sf_dir, "pages"), "page_id", "html", "url").where("kind = 'start'").select("page_id", "url", F.col("name").alias("tag"), F.explode("attributes").alias("a"))
    found = found.where(F.col("a.name").isin("href", "src", "action", "formaction"))
    host = F.coalesce(F.nullif(F.regexp_extract("a.value", _ADDRESS, 2), F.lit("")), F.regexp_extract("url", _ADDRESS, 2))
    mixed = F.startswith(F.lower("url"), F.lit("https:")) & F.startswith(F.lower("a.value"), F.lit("http:"))
    return found.groupBy("tag", F.col("a.name").alias("at"), F.lower(host).alias("host")).agg(
        F.count("*").alias("n"), F.countDistinct("a.value").alias("addresses"), F.countDistinct("page_id").alias("pages"), F.count_if(mixed).alias("mixed")
    )


# --- all rules at once -----------------------------------------------------------------------------------------------------------

_EVERY = f"""{_LINES}, page_lines AS (SELECT page_id, CAST(line_no AS INTEGER) AS line_no, line FROM (SELECT page_id, unnest(string_split(html, chr(10))) AS line,
  generate_subscripts(string_split(html, chr(10)), 1) AS line_no, len(string_split(html, chr(10))) AS n FROM pages) WHERE NOT (line = '' AND line_no = n)),
  every AS (SELECT doc_id AS id, line_no, line FROM doc_lines UNION ALL SELECT -1 - page_id, line_no, line FROM page_lines)"""
RULES = [(r, s, c, lits, p) for r, _, s, c, lits, p in K.CODE_RULES] + [tuple(r) for r in K.SECRET_RULES]


def _every_line(spark, sf_dir):
    """The lines of documents, and those of pages with ids from -1 down."""
    docs = T.lines(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "id", "text")
    return docs.unionByName(T.lines(_table(spark, sf_dir, "pages").select((F.lit(-1) - F.col("page_id")).alias("id"), "html"), "id", "html"))


def _silent():
    """What keeps a code rule from a line; the secret patterns look at every line."""
    line, lower, rule = F.col("line"), F.col("lower"), F.col("rule_id")
    own = F.when(rule == "SAF-ASSERT", code_rules.suppressed("SAF-ASSERT", line, lower)).when(rule == "SAF-COMPILE", code_rules.suppressed("SAF-COMPILE", line, lower))
    own = own.otherwise(line.contains("SAF-") & F.contains(line, rule))
    imported = lower.contains("import ") & lower.contains("from ")
    return rule.isin(*[r[0] for r in K.CODE_RULES]) & (code_rules.commented(line) | imported | own)


@query(f"WITH {_EVERY}, " + _rule_sql(K.CODE_RULES, "every", "id") + " UNION ALL " + _secret_sql("id", "every"))
def rule_index_all(spark, sf_dir):
    """All 92 code and secret rules over the lines of documents and pages, by the index."""
    found = rule_index.indexed_findings(_every_line(spark, sf_dir), RULES, "id", silent=_silent())
    return found.select("id", "line_no", "rule_id", "severity", "confidence")


WORD_RULES = 2000
_WORDS = f"SELECT word FROM (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]{{8,}}'))) AS word FROM documents) ORDER BY md5(word), word LIMIT {WORD_RULES}"


@query(f"""WITH {_EVERY}, w AS ({_WORDS}), hit AS (SELECT DISTINCT id, line_no, word FROM (SELECT id, line_no, unnest(regexp_extract_all(lower(line), '[a-z]+')) AS word FROM every) JOIN w USING (word))
  SELECT 'W-' || word AS rule_id, count(*) AS n, count(DISTINCT id) AS texts, min(id) AS first_id FROM hit GROUP BY ALL""")
def rule_index_words(spark, sf_dir):
    """Two thousand rules made of the documents' own words (a choice by their hash), over the lines of documents and pages."""
    words = _table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{8,}"), F.lit(0))).alias("word")).select(F.lower("word").alias("word")).distinct()
    words = [r["word"] for r in words.orderBy(F.md5("word"), "word").limit(WORD_RULES).collect()]
    rules = [(f"W-{w}", "LOW", 0.5, (w,), rf"(?i)(?:^|[^A-Za-z]){w}(?:[^A-Za-z]|$)") for w in words]
    found = rule_index.indexed_findings(_every_line(spark, sf_dir), rules, "id")
    return found.groupBy("rule_id").agg(F.count("*").alias("n"), F.countDistinct("id").alias("texts"), F.min("id").alias("first_id"))


# --- version ranges --------------------------------------------------------------------------------------------------------------

_NUMBERS = r"[0-9]+(?:\.[0-9]+)+"
#: A third of the points and ranges are of one package.
_POINTS = f"""SELECT 'net' AS package, unnest(regexp_extract_all(text, '{_NUMBERS}')) AS version FROM documents
  UNION ALL SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'p' ELSE 'p' || CAST(o_orderkey % 50 AS VARCHAR) END, CAST(o_custkey % 1000 AS VARCHAR) || '.' || CAST(o_orderkey % 97 AS VARCHAR) || CASE WHEN o_orderkey % 5 = 0 THEN '.0' ELSE '' END FROM orders"""
_KIND = "l_orderkey % 4"


def _points(spark, sf_dir):
    of_text = _table(spark, sf_dir, "documents").select(F.lit("net").alias("package"), F.explode(F.regexp_extract_all("text", F.lit(f"({_NUMBERS})"), F.lit(1))).alias("version"))
    key = F.col("o_orderkey")
    version = F.concat((F.col("o_custkey") % 1000).cast("string"), F.lit("."), (key % 97).cast("string"), F.when(key % 5 == 0, ".0").otherwise(""))
    return of_text.unionByName(_table(spark, sf_dir, "orders").select(F.when(key % 3 == 0, "p").otherwise(F.concat(F.lit("p"), (key % 50).cast("string"))).alias("package"), version.alias("version")))


def _ranges(spark, sf_dir):
    """A range for each line of an order, of four kinds."""
    line, key = _table(spark, sf_dir, "lineitem"), F.col("l_orderkey")
    a, b = (F.col("l_partkey") % 1000).cast("string"), (F.col("l_suppkey") % 97).cast("string")
    text = lambda *parts: F.concat(*[F.lit(p) if p is not a and p is not b else p for p in parts])
    clauses = F.when(key % 4 == 0, text(">=", a, ".", b, ",<=", a, ".90")).when(key % 4 == 1, text("==", a, ".", b, ".*")).when(key % 4 == 2, text(">", a, ".", b, ",!=", a, ".50,<", a, ".60")).otherwise(text("~=", a, ".", b))
    package = F.when(key % 3 == 0, "p").when(key % 3 == 1, "net").otherwise(F.concat(F.lit("p"), (key % 50).cast("string")))
    return line.select((key * 10 + F.col("l_linenumber")).alias("range_id"), package.alias("package"), clauses.alias("clauses"))


@query(f"""WITH points AS (SELECT DISTINCT * FROM ({_POINTS})), keyed AS (SELECT *, list_transform(string_split(version, '.'), lambda x: CAST(x AS HUGEINT)) AS full_key FROM points),
  v AS (SELECT package, version, full_key, list_resize(full_key, greatest(len(full_key), 8), 0::HUGEINT) AS k FROM keyed),
  r AS (SELECT l_orderkey * 10 + l_linenumber AS range_id, CASE WHEN l_orderkey % 3 = 0 THEN 'p' WHEN l_orderkey % 3 = 1 THEN 'net' ELSE 'p' || CAST(l_orderkey % 50 AS VARCHAR) END AS package,
    {_KIND} AS kind, CAST(l_partkey % 1000 AS HUGEINT) AS a, CAST(l_suppkey % 97 AS HUGEINT) AS b FROM lineitem),
  hit AS (SELECT v.package, version, range_id FROM v JOIN r ON v.package = r.package AND k[1] = a AND CASE kind
    WHEN 0 THEN k >= [a, b, 0, 0, 0, 0, 0, 0] AND k <= [a, 90, 0, 0, 0, 0, 0, 0] WHEN 1 THEN k[2] = b
    WHEN 2 THEN k > [a, b, 0, 0, 0, 0, 0, 0] AND k <> [a, 50, 0, 0, 0, 0, 0, 0] AND k < [a, 60, 0, 0, 0, 0, 0, 0] ELSE k >= [a, b, 0, 0, 0, 0, 0, 0] END)
  SELECT package, version, count(*) AS n, min(range_id) AS first_range FROM hit GROUP BY ALL""")  # fmt: skip
def version_ranges(spark, sf_dir):
    """How many of the ranges (one for each line of an order) hold which versions: dotted numbers of documents, and one for each order."""
    hits = ranges_op.range_hits(_points(spark, sf_dir), _ranges(spark, sf_dir))
    return hits.groupBy("package", "version").agg(F.count("*").alias("n"), F.min("range_id").alias("first_range"))


# --- dependencies of dependencies --------------------------------------------------------------------------------------------------

DEPTH = 8
_GRAPH = f"""l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey AS package, l_suppkey, CAST(l_quantity AS INTEGER) AS q, l_returnflag FROM lineitem),
  offered AS (SELECT p_partkey AS package, p_size AS major, p_partkey % 7 AS minor FROM part UNION ALL SELECT p_partkey, p_size + 10, 1 FROM part),
  asked AS (SELECT a.package, b.package AS needs, b.q FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_returnflag = 'R' AND a.l_linenumber > 4),
  edges AS (SELECT asked.package, needs, q, max(struct_pack(major, minor)) AS best FROM asked JOIN offered o ON o.package = needs AND (major < q OR (major = q AND minor < 5)) AND (major >= 3) GROUP BY ALL),
  least AS (SELECT package, needs, min(CAST(best.major AS VARCHAR) || '.' || CAST(best.minor AS VARCHAR)) AS version FROM edges GROUP BY ALL),
  roots AS (SELECT l_suppkey AS root, package, min(CAST(p_size AS VARCHAR) || '.0') AS version FROM l JOIN part ON p_partkey = package WHERE l_returnflag = 'R' AND l_linenumber = 5 GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {_GRAPH}, reach AS (SELECT root, package, 0 AS depth FROM roots UNION SELECT root, needs, depth + 1 FROM reach JOIN least USING (package) WHERE depth < {DEPTH}),
  near AS (SELECT root, package, min(depth) AS depth FROM reach GROUP BY ALL),
  by_parent AS (SELECT n.root, n.package, n.depth, min(struct_pack(parent := p.package, version := e.version)) AS w FROM near n JOIN near p ON p.root = n.root AND p.depth = n.depth - 1
    JOIN least e ON e.package = p.package AND e.needs = n.package GROUP BY ALL)
  SELECT root, package, CAST(depth AS INTEGER) AS depth, w.parent AS parent, w.version AS version FROM by_parent UNION ALL SELECT root, package, 0, -1, version FROM roots""")  # fmt: skip
def dependency_closure(spark, sf_dir):
    """What suppliers' parts need through the parts that follow them in orders, in versions made of the parts' sizes."""
    line = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("package"), "l_suppkey", F.col("l_quantity").cast("int").alias("q"), "l_returnflag").distinct()
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("package"), "p_size")
    name = lambda major, minor: F.concat(major.cast("string"), F.lit("."), minor.cast("string"))
    offered = part.select("package", name(F.col("p_size"), F.col("package") % 7).alias("version")).unionByName(part.select("package", name(F.col("p_size") + 10, F.lit(1)).alias("version")))
    after = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("package").alias("needs"), F.concat(F.lit(">=3,<"), F.col("q").cast("string"), F.lit(".5")).alias("clauses"))
    asked = line.where("l_returnflag = 'R' and l_linenumber > 4").join(after, ["l_orderkey", "l_linenumber"]).select("package", "needs", "clauses").distinct()
    roots = line.where("l_returnflag = 'R' and l_linenumber = 5").join(part, "package").select(F.col("l_suppkey").alias("root"), "package", name(F.col("p_size"), F.lit(0)).alias("version"))
    found = dependencies.closure(roots, dependencies.resolved(asked, offered), DEPTH)
    return found.withColumn("parent", F.coalesce("parent", F.lit(-1).cast("long")))


# --- bursts ------------------------------------------------------------------------------------------------------------------------

BURST = 3


@query(f"""WITH w AS (SELECT user_id, ts, count(*) OVER f AS n, max(ts) OVER f AS e FROM events WINDOW f AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL 1 DAY FOLLOWING)),
  s AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY ts, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM w WHERE n >= {BURST}),
  i AS (SELECT *, sum(CASE WHEN before IS NULL OR ts > before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, e ROWS UNBOUNDED PRECEDING) AS island FROM s),
  b AS (SELECT user_id, min(ts) AS s, max(e) AS e FROM i GROUP BY user_id, island)
  SELECT b.user_id, epoch_us(b.s) AS start_us, epoch_us(b.e) AS end_us, count(*) AS n FROM b JOIN events v ON v.user_id = b.user_id AND v.ts BETWEEN b.s AND b.e GROUP BY ALL""")  # fmt: skip
def event_bursts_any_window(spark, sf_dir):
    """Runs of events of which each lies in some day (that may begin at any moment) with three events of its user."""
    found = bursts.any_window_bursts(_table(spark, sf_dir, "events"), 86_400, BURST)
    return found.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


# --- ignore rules in many folders --------------------------------------------------------------------------------------------------

#: Rules of the top folder; each host and each of its folders has some of its own, chosen by their hashes.
_PATH = "regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^?#]*)', 1), '/+$', '')"
_IGNORED = f"""pages_at AS (SELECT DISTINCT {_PATH} AS path FROM pages),
  hosts AS (SELECT DISTINCT split_part(path, '/', 1) AS host, split_part(path, '/', 2) AS lang FROM pages_at),
  rules AS (SELECT '' AS folder, 0 AS ord, '*7' AS pattern, '(^|/)[^/]*7(/|$)' AS regex, true AS exclude
    UNION ALL SELECT '', 1, '!en/', '(^|/)en/', false
    UNION ALL SELECT DISTINCT host, 0, '[0-4]*', '(^|/)[0-4][^/]*(/|$)', true FROM hosts WHERE md5(host)[1] < '8'
    UNION ALL SELECT DISTINCT host, 1, '!*1', '(^|/)[^/]*1(/|$)', false FROM hosts WHERE md5(host)[2] < '8'
    UNION ALL SELECT host || '/' || lang, 0, '*5', '(^|/)[^/]*5(/|$)', true FROM hosts WHERE md5(host || lang)[1] < '8')"""


@query(f"""WITH {_IGNORED}, met AS (SELECT path, folder, pattern, exclude, len(folder) * 10 + ord AS place FROM pages_at JOIN rules
    ON folder = '' OR folder = split_part(path, '/', 1) OR folder = split_part(path, '/', 1) || '/' || split_part(path, '/', 2)
    WHERE regexp_matches(CASE WHEN folder = '' THEN path ELSE substr(path, len(folder) + 2) END, regex) AND starts_with(path || '/', CASE WHEN folder = '' THEN '' ELSE folder || '/' END))
  SELECT path, coalesce(arg_max(exclude, place), false) AS ignored, arg_max(folder, place) AS folder, arg_max(pattern, place) AS pattern FROM pages_at LEFT JOIN met USING (path) GROUP BY path""")  # fmt: skip
def ignored_paths(spark, sf_dir):
    """Which of the pages' addresses, read as paths, ignore rules at three depths leave out."""
    path = F.regexp_replace(F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://([^?#]*)", 1), "/+$", "")
    paths = _table(spark, sf_dir, "pages").select(path.alias("path")).distinct()
    host, lang = F.split_part("path", F.lit("/"), F.lit(1)), F.split_part("path", F.lit("/"), F.lit(2))
    hosts = paths.select(host.alias("host"), lang.alias("lang")).distinct()
    digit = lambda c, k: F.substring(F.md5(c), k, 1) < "8"
    rule = lambda rows, folder, k, pattern: rows.select(folder.alias("folder"), F.lit(k).alias("ord"), F.lit(pattern).alias("pattern"))
    top = spark.createDataFrame([("", 0, "*7"), ("", 1, "!en/")], "folder string, ord int, pattern string")
    rules = top.unionByName(rule(hosts.where(digit("host", 1)), F.col("host"), 0, "[0-4]*")).unionByName(rule(hosts.where(digit("host", 2)), F.col("host"), 1, "!*1"))
    both = F.concat("host", "lang")
    rules = rules.unionByName(rule(hosts.where(digit(both, 1)), F.concat("host", F.lit("/"), "lang"), 0, "*5"))
    return nested_ignore.decided(paths, rules)


# --- verdicts of a stream -----------------------------------------------------------------------------------------------------------

_SEVERITY = "CASE WHEN event_type = 'error' AND value > 40 THEN 'HIGH' WHEN event_type = 'error' AND value > 10 THEN 'MEDIUM' WHEN event_type = 'error' THEN 'LOW' END"


@query(f"""WITH f AS (SELECT user_id, {_SEVERITY} AS severity FROM events WHERE ts IS NOT NULL), g AS (SELECT user_id, count(*) AS n, max(CASE severity WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'HIGH' THEN 2 END) AS max_rank FROM f GROUP BY user_id)
  SELECT user_id, CASE WHEN max_rank >= 2 THEN 'BLOCK' WHEN max_rank = 1 THEN 'WARN' ELSE 'PASS' END AS verdict, max_rank FROM g""")  # fmt: skip
def event_verdict_stream(spark, sf_dir):
    """The verdict that each user's events end with, errors being findings, as a stream with state finds it. The events come as
    one delivery of files; tests deliver them in many and in any order."""
    path = f"{sf_dir}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/events.parque[t]")  # as a pattern, it may be one file
    rows = events.select("user_id", "ts", F.expr(_SEVERITY).alias("severity"))
    changes = verdicts.running_verdicts(rows, "user_id", "ts", threshold="HIGH", quiet="36500 days", late="36500 days")
    out = verdicts.run_to_end(changes, f"{scratch.folder(spark)}/sparkwarden/verdicts-{uuid.uuid4().hex}", "changes")
    last = out.groupBy("user_id").agg(F.max_by(F.struct("verdict", "max_rank"), F.struct("batch_id", "max_rank")).alias("last"))
    return last.select("user_id", "last.verdict", "last.max_rank")


# --- a cube of counts ----------------------------------------------------------------------------------------------------------------

_DIMS = ["source", "lang", "kind"]
_KIND_OF = "CASE WHEN trim(line) = '' THEN 'blank' WHEN length(line) > 200 THEN 'long' WHEN contains(line, '://') THEN 'address' ELSE 'plain' END"


def _deliveries(spark, sf_dir):
    """The lines of documents, counted in seven deliveries that are stored one after the other."""
    lines = T.lines(_table(spark, sf_dir, "documents"), "doc_id", "text", "source", "lang").withColumn("kind", F.expr(_KIND_OF)).withColumn("size", F.length("line"))
    return scratch.stored(cube.deliveries(lines.withColumn("day", F.col("doc_id") % 7), "day", _DIMS, "doc_id", "size"), "deliveries")


@query(f"""WITH {_LINES}, k AS (SELECT source, lang, {_KIND_OF} AS kind FROM doc_lines JOIN documents USING (doc_id))
  SELECT CAST(grouping(source, lang, kind) AS INTEGER) AS level, source, lang, kind, count(*) AS n FROM k GROUP BY CUBE (source, lang, kind)""")  # fmt: skip
def line_cube(spark, sf_dir):
    """Lines by source, language and kind in all combinations, merged from deliveries."""
    return cube.cube(_deliveries(spark, sf_dir), _DIMS).select("level", *_DIMS, "n")


@query()
def line_cube_sketches(spark, sf_dir):
    """How many documents, and how long the lines are, in the cells of line_cube: from sketches, tested against exact values."""
    found = cube.cube(_deliveries(spark, sf_dir), _DIMS)
    return found.select("level", *_DIMS, F.col("distinct_values").alias("docs"), F.col("quantiles")[0].alias("median_size"), F.col("quantiles")[1].alias("p95_size"))


# --- rules over several lines ----------------------------------------------------------------------------------------------------------

SEQUENCES = {
    "SEQ-1": r"/[0-9]{4}/ then within 3 /@/", "SEQ-2": r"/@/ then within 5 /[0-9]{4}/ unless /:/", "SEQ-3": r"/[.]$/ then within 1 /^[A-Z]/ then within 2 /,/", "SEQ-4": r"/https?:\/\// then within 4 /[0-9]/",
    "SEQ-5": r"/[?]/ then within 2 /[.]/ unless /!/", "SEQ-6": r"/^[a-z]/ then within 3 /[A-Z]{2}/", "SEQ-7": r"/key|token|password/ then within 6 /[=:]/", "SEQ-8": r"/[(]/ then within 2 /[)]/ unless /[.]/",
    "SEQ-9": r"/the/ then within 1 /and/ then within 1 /of|de/ then within 3 /[.]/", "SEQ-10": r"/[A-Z][a-z]+ [A-Z][a-z]+/ then within 8 /[0-9]+[.][0-9]+/ unless /;/",
}


def _sequence_sql() -> str:
    parts = []
    for rule, text in SEQUENCES.items():
        steps = line_sequences.parse(text)
        ctes, last = [], len(steps) - 1
        ctes.append(f"e{last} AS (SELECT id, line_no, line, CASE WHEN regexp_matches(line, {X.literal(steps[last].pattern)}) THEN line_no END AS e FROM every)")
        for k in range(last, 0, -1):
            frame = f"OVER (PARTITION BY id ORDER BY line_no RANGE BETWEEN 1 FOLLOWING AND {steps[k].within} FOLLOWING)"
            stop = f"min(CASE WHEN regexp_matches(line, {X.literal(steps[k].unless)}) THEN line_no END) {frame}" if steps[k].unless else "NULL"
            ctes.append(f"w{k} AS (SELECT id, line_no, line, min(CASE WHEN e IS NOT NULL THEN struct_pack(a := line_no, b := e) END) {frame} AS next, {stop} AS stop FROM e{k})")
            ctes.append(f"e{k - 1} AS (SELECT id, line_no, line, CASE WHEN regexp_matches(line, {X.literal(steps[k - 1].pattern)}) AND next IS NOT NULL AND (stop IS NULL OR stop >= next.a) THEN next.b END AS e FROM w{k})")
        parts.append(f"SELECT * FROM (WITH {', '.join(ctes)} SELECT id, '{rule}' AS rule_id, line_no, e AS end_line FROM e0 WHERE e IS NOT NULL)")
    return " UNION ALL ".join(parts)


_TALK = """talk AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
  talk_lines AS (SELECT -1 - conv_id AS id, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS line_no, unnest(string_split(text, chr(10))) AS line FROM talk),
  every AS (SELECT doc_id AS id, line_no, line FROM doc_lines UNION ALL SELECT * FROM talk_lines)"""


@query(f"WITH {_LINES}, {_TALK} {_sequence_sql()}")
def line_sequences_found(spark, sf_dir):
    """Ten rules of two to four steps over the lines of documents, and of conversations read as one text (ids from -1 down)."""
    docs = T.lines(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "id", "text")
    turns = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))  # the turns of one conversation
    talk = turns.select((F.lit(-1) - F.col("conv_id")).alias("id"), F.posexplode(F.split(F.array_join("t.text", "\n"), "\n")).alias("pos", "line"))
    every = docs.unionByName(talk.select("id", (F.col("pos") + 1).alias("line_no"), "line"))
    return line_sequences.sequence_findings(every, SEQUENCES, "id")


# --- lines of huge texts, randomness -----------------------------------------------------------------------------------------------------

RANGE = 997


@query("""WITH whole AS (SELECT lang, string_agg(text, '' ORDER BY doc_id) AS text FROM documents GROUP BY lang), p AS (SELECT lang, string_split(text, chr(10)) AS parts FROM whole WHERE text <> ''),
  l AS (SELECT lang, CAST(generate_subscripts(parts, 1) AS BIGINT) AS line_no, unnest(parts) AS line, len(parts) AS n FROM p)
  SELECT lang, line_no, CAST(length(line) AS BIGINT) AS n_chars FROM l WHERE NOT (line = '' AND line_no = n)""")
def line_numbering_ranges(spark, sf_dir):
    """Lines of all documents of a language read as one text, which comes in ranges."""
    parts = line_ranges.ranges(_table(spark, sf_dir, "documents"), "lang", "text", RANGE, "doc_id")
    return line_ranges.range_lines(parts, "lang", "doc_id", "part").select("lang", "line_no", "n_chars")


_SYM = "CASE WHEN {0} BETWEEN 32 AND 126 THEN {0} - 32 ELSE 95 END"
_RANDOM = "[A-Za-z0-9]{16,}"


@query(f"""WITH b AS (SELECT regexp_extract_all(hex(encode(text)), '..') AS l FROM documents WHERE strlen(text) > 1),
  xy AS (SELECT unnest(list_transform(list_zip(l[1:len(l) - 1], l[2:len(l)]), lambda p: p[1] || p[2])) AS h FROM b), g AS (SELECT h, count(*) AS n FROM xy GROUP BY h),
  raw AS (SELECT ('0x' || h[1:2])::INTEGER AS x, ('0x' || h[3:4])::INTEGER AS y, n FROM g), pairs AS (SELECT {_SYM.format('x')} AS a, {_SYM.format('y')} AS b, sum(n) AS n FROM raw GROUP BY ALL)
  SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, CAST(n AS BIGINT) AS n FROM pairs""")
def character_pairs(spark, sf_dir):
    """The character model's counts over all documents."""
    return char_model.pair_counts(_table(spark, sf_dir, "documents")).select(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), "n")


@query()
def random_tokens(spark, sf_dir):
    """Long runs of letters and digits in documents with their bits per character, under the documents' model and by entropy."""
    docs = _table(spark, sf_dir, "documents")
    tokens = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"({_RANDOM})"), F.lit(1))).alias("token")).distinct()
    return tokens.select("doc_id", "token", char_model.bits(F.col("token"), char_model.model(docs)).alias("bits"), T.entropy(F.col("token")).alias("entropy"))

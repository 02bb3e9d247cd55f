"""Advisories: PEP 440 versions as sortable structs, range tests, and the joins of packages with advisories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.functions.catalog import ADVISORIES
from sparkwarden.operators.manifests import bound_version

_VERSION = (
    r"^v?(?:(\d+)!)?(\d+(?:\.\d+)*)(?:[-_.]?(alpha|a|beta|b|preview|pre|c|rc)[-_.]?(\d*))?"
    r"(?:[-_.]?(post|rev|r)[-_.]?(\d*)|-(\d+))?(?:[-_.]?(dev)[-_.]?(\d*))?(?:\+[a-z0-9]+(?:[-_.][a-z0-9]+)*)?$"
)
#: Numbers are strings, see _number(); this is nought's. No post-release comes before any number, no dev-release after all.
ZERO, _NO_POST, _NO_DEV = "!", "", "\x7f"


def _number(c: Column) -> Column:
    """A string that sorts as the number does, of any length: how many digits it has, without noughts in front, and these."""
    digits = F.regexp_replace(c, "^0+", "")
    size = F.length(digits)
    return F.concat(F.repeat(F.lit("~"), F.floor(size / 90).cast("int")), F.char(33 + size % 90), digits)


def version_key(version: Column) -> Column:
    """A struct that sorts as PEP 440 does (epoch, release, phase, pre, post, dev); null for anything else.

    The release has its numbers without noughts at the end, however many and however long they are; local labels are ignored.
    """
    v = F.lower(F.trim(version))
    part = lambda k: F.regexp_extract(v, _VERSION, k)
    release = F.transform(F.split(part(2), r"\."), _number)
    used = F.array_max(F.transform(release, lambda x, k: F.when(x != ZERO, k + 1).otherwise(0)))
    pre, has_post, has_dev = part(3), (part(5) != "") | (part(7) != ""), part(8) != ""
    phase = F.when(pre.isin("a", "alpha"), 0).when(pre.isin("b", "beta"), 1).when(pre != "", 2).when(has_dev & ~has_post, -1).otherwise(3).cast("bigint")
    post = F.when(has_post, _number(F.concat(part(6), part(7)))).otherwise(F.lit(_NO_POST))
    dev = F.when(has_dev, _number(part(9))).otherwise(F.lit(_NO_DEV))
    fields = {"epoch": _number(part(1)), "release": F.slice(release, F.lit(1), used), "phase": phase, "pre": _number(part(4)), "post": post, "dev": dev}
    return F.when(v.rlike(_VERSION), F.struct(*[c.alias(n) for n, c in fields.items()]))


def _base(key: Column) -> Column:
    return F.struct(key["epoch"], key["release"])


def _head(key: Column, n: Column) -> Column:
    """The epoch and the first n numbers of the release."""
    return F.struct(key["epoch"], F.slice(F.concat(key["release"], F.array_repeat(F.lit(ZERO), n)), F.lit(1), n))


def _early(key: Column) -> Column:
    """Whether a key is that of a pre- or dev-release."""
    return (key["phase"] < 3) | (key["dev"] != _NO_DEV)


def parsed(clause: Column) -> Column:
    """What a clause such as '<3.2.0' says: (op, wild: a .* at the end, size: numbers of its release, bound: their key)."""
    c = F.trim(clause)
    text = F.trim(F.regexp_replace(c, r"^[<>=!~]+", ""))
    plain = F.regexp_replace(text, r"\.\*$", "")
    op = F.regexp_extract(c, r"^(===|==|!=|~=|<=|>=|<|>)", 1)
    return F.struct(op.alias("op"), text.endswith(".*").alias("wild"), F.size(F.split(plain, r"\.")).alias("size"), version_key(plain).alias("bound"))


def meets(key: Column, clause: Column) -> Column:
    """Whether a version key meets a parsed() clause; one that cannot be read is never met."""
    op, bound, size = clause["op"], clause["bound"], clause["size"]
    same = F.when(clause["wild"], _head(key, size) == _head(bound, size)).otherwise(key == bound)
    below = (key < bound) & ~(_early(key) & ~_early(bound) & (_base(key) == _base(bound)))
    above = (key > bound) & ~((key["post"] != _NO_POST) & (bound["post"] == _NO_POST) & (_base(key) == _base(bound)))
    return F.coalesce(
        F.when(op.isin("==", "==="), same).when(op == "!=", ~same).when(op == "<", below).when(op == ">", above).when(op == "<=", key <= bound)
        .when(op == ">=", key >= bound).when(op == "~=", (key >= bound) & (_head(key, size - 1) == _head(bound, size - 1))),
        F.lit(False),
    )


def satisfies(key: Column, clause: Column) -> Column:
    """Whether a version key meets one clause such as '<3.2.0'; a clause that cannot be read is never met."""
    return meets(key, parsed(clause))


def affected(version: Column, ranges: Column) -> Column:
    """Whether a version lies in any of the ranges (each a comma-joined list of clauses). Unreadable versions lie in none."""
    key = version_key(version)
    return key.isNotNull() & F.exists(ranges, lambda r: F.forall(F.split(r, ","), lambda c: satisfies(key, c)))


def offline_advisories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ADVISORIES, "package string, ranges array<string>, severity string, cve string")


def read_advisories(spark: SparkSession, path: str) -> DataFrame:
    """Advisories of a JSON file: an object with a 'vulnerabilities' list, or the list itself; anything else has none."""
    entry = "array<struct<package:string,versions:array<string>,severity:string,cve:string,description:string>>"
    text = spark.read.text(path, wholetext=True).select("value")
    wrapped = F.from_json("value", f"struct<vulnerabilities:{entry}>").getField("vulnerabilities")
    rows = text.select(F.explode(F.coalesce(wrapped, F.from_json("value", entry))).alias("v"))
    return rows.select("v.package", F.col("v.versions").alias("ranges"), "v.severity", "v.cve")


def advisory_findings(packages: DataFrame, advisories: DataFrame, ecosystem: str | None = "PyPI") -> DataFrame:
    """Packages that an advisory affects: equal lower-case names, then the range test, one row per package and advisory.

    ecosystem: the one that the advisories speak of (a package of that name elsewhere is another package); None: any.
    Severities outside HIGH, LOW and CRITICAL count as MEDIUM.
    """
    rows = packages if ecosystem is None else packages.where(F.col("ecosystem") == ecosystem)
    rows = rows.withColumn("version", bound_version(F.col("version_spec")))
    hit = rows.join(advisories.withColumn("package", F.lower("package")), F.lower(F.col("name")) == F.col("package")).where(affected(F.col("version"), F.col("ranges")))
    severity = F.when(F.upper("severity").isin("HIGH", "LOW", "CRITICAL"), F.upper("severity")).otherwise("MEDIUM")
    rule = F.concat(F.lit("DEP-"), F.replace(F.col("cve"), F.lit("-"), F.lit("_")))
    return hit.select("manifest", "line_num", "name", "version", rule.alias("rule_id"), severity.alias("severity"), F.substring("snippet", 1, 80).alias("snippet"))


# --- online advisory records (a dump of them; nothing is fetched) ----------------------------------------------------------

OSV = (
    "id string, summary string, details string, aliases array<string>, severity array<struct<type:string,score:string>>, "
    "affected array<struct<package:struct<ecosystem:string,name:string>,versions:array<string>,"
    "ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>,"
    "database_specific:struct<severity:string>,ecosystem_specific:struct<severity:string>>>, database_specific struct<severity:string>"
)


def read_osv(spark: SparkSession, path: str) -> DataFrame:
    """OSV records of a dump: a file or folder of JSON, one record (or an array of them) a file, or .jsonl with one a line."""
    return spark.read.schema(OSV).option("multiLine", not path.rstrip("/").endswith(".jsonl")).json(path)


def osv_ranges(records: DataFrame) -> DataFrame:
    """(range_id: the record's id, ecosystem, name in lower case, clauses) of the records' SEMVER and ECOSYSTEM ranges and of the
    versions that they list. A range begins at an `introduced` event and ends before the `fixed` one that follows, or at
    `last_affected`; without either it has no end, and introduced '0' has no beginning."""
    of = records.select("id", F.explode("affected").alias("a")).where("a.package.name is not null")
    place = ["id", F.col("a.package.ecosystem").alias("ecosystem"), F.lower("a.package.name").alias("name")]
    each = of.select(*place, F.explode("a.ranges").alias("r")).where(F.col("r.type").isin("SEMVER", "ECOSYSTEM"))
    events = F.col("r.events")

    def stretch(e: Column, k: Column) -> Column:
        after = F.try_element_at(events, (k + 2).cast("int"))
        low = F.when(e["introduced"] == "0", ">=0.dev0").otherwise(F.concat(F.lit(">="), e["introduced"]))
        high = F.when(after["fixed"].isNotNull(), F.concat(F.lit(",<"), after["fixed"])).when(after["last_affected"].isNotNull(), F.concat(F.lit(",<="), after["last_affected"]))
        return F.when(e["introduced"].isNotNull(), F.concat(low, F.coalesce(high, F.lit(""))))

    spans = each.select("id", "ecosystem", "name", F.explode(F.array_compact(F.transform(events, stretch))).alias("clauses"))
    listed = of.select(*place, F.explode("a.versions").alias("v")).select("id", "ecosystem", "name", F.concat(F.lit("=="), "v").alias("clauses"))
    return spans.unionByName(listed).withColumnRenamed("id", "range_id")


def osv_hits(packages: DataFrame, records: DataFrame) -> DataFrame:
    """(ecosystem, name, version, id): which records of a dump affect which packages (ecosystem, name, version_spec), by ranges and
    listed versions; names are compared in lower case. However many ranges a package has, none is paired with all its versions."""
    from sparkwarden.operators.version_ranges import range_hits

    both = F.to_json(F.struct("ecosystem", F.lower("name").alias("name")))
    points = packages.select("ecosystem", "name", bound_version(F.col("version_spec")).alias("version"), both.alias("package"))
    hits = range_hits(points, osv_ranges(records).select("range_id", both.alias("package"), "clauses")).distinct()
    return points.distinct().join(hits, ["package", "version"]).select("ecosystem", "name", "version", F.col("range_id").alias("id"))


def cvss_severity(score: Column) -> Column:
    """The bucket of a CVSS score: from 9 CRITICAL, 7 HIGH, 4 MEDIUM, below LOW; null MEDIUM."""
    return F.when(score.isNull(), "MEDIUM").when(score >= 9, "CRITICAL").when(score >= 7, "HIGH").when(score >= 4, "MEDIUM").otherwise("LOW")


def osv_summary(records: DataFrame) -> DataFrame:
    """Per OSV record: id, cve (first CVE alias, else the id), severity and fixed version.

    Severity: the record's own word, else its first numeric CVSS v3 score, else the first word of an affected entry, else
    MEDIUM. The fixed version is the first of the last range that has one.
    """
    known = lambda c: F.when(F.upper(c).isin("LOW", "MEDIUM", "MODERATE", "HIGH", "CRITICAL"), F.when(F.upper(c) == "MODERATE", "MEDIUM").otherwise(F.upper(c)))
    scores = F.filter(F.transform(F.filter("severity", lambda s: s["type"] == "CVSS_V3"), lambda s: s["score"].try_cast("double")), lambda x: x.isNotNull())
    words = F.flatten(F.transform("affected", lambda a: F.array(known(a["database_specific"]["severity"]), known(a["ecosystem_specific"]["severity"]))))
    first = lambda a: F.try_element_at(a, F.lit(1))
    score = first(scores)
    severity = F.coalesce(known(F.col("database_specific.severity")), F.when(score.isNotNull(), cvss_severity(score)), first(F.filter(words, lambda w: w.isNotNull())), F.lit("MEDIUM"))
    ranges = F.filter(F.flatten(F.transform("affected", lambda a: F.coalesce(a["ranges"], F.array()))), lambda r: r["type"].isin("SEMVER", "ECOSYSTEM"))
    fixes = F.filter(F.transform(ranges, lambda r: first(F.filter(F.transform(r["events"], lambda e: e["fixed"]), lambda f: f.isNotNull()))), lambda f: f.isNotNull())
    cve = F.coalesce(first(F.filter("aliases", lambda a: a.startswith("CVE-"))), F.col("id"))
    return records.select("id", cve.alias("cve"), severity.alias("severity"), F.coalesce(F.try_element_at(fixes, F.lit(-1)), F.lit("")).alias("fixed"))


def osv_findings(packages: DataFrame, hits: DataFrame, records: DataFrame) -> DataFrame:
    """Packages with known records: hits (ecosystem, name, version, id) is the advisory index, records the OSV dump."""
    rows = packages.withColumn("version", bound_version(F.col("version_spec")))
    found = rows.join(hits, ["ecosystem", "name", "version"]).join(osv_summary(records), "id")
    rule = F.concat(F.lit("DEP-"), F.replace(F.col("cve"), F.lit("-"), F.lit("_")))
    return found.select("manifest", "line_num", "name", "version", rule.alias("rule_id"), "severity", "fixed", *["snippet"] * ("snippet" in packages.columns))

"""Every query of the engine by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.functions import advice as A
from sparkwarden.functions import catalog as K
from sparkwarden.functions import text as T
from sparkwarden.operators import advisories, code_rules, findings, manifests, responses, syntax_tree
from sparkwarden.plans import fixtures as X
from sparkwarden.streaming import monitor

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _own(column: str) -> str:
    """The inline column, told apart for each document."""
    return f"concat(cast(doc_id as string), '/', {column})"


def _doc_lines(spark, sf_dir, *more) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return T.lines(docs.select("doc_id", "text"), "doc_id", "text")


_LINES = """doc_lines AS (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
  generate_subscripts(string_split(text, chr(10)), 1) AS line_no, len(string_split(text, chr(10))) AS n FROM documents) WHERE NOT (line = '' AND line_no = n))"""
_SEV = "CASE severity WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'CRITICAL' THEN 3 END"
_RANK = "CASE {0} WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'CRITICAL' THEN 3 END"
_VERDICT = "CASE WHEN max_rank IS NULL THEN 'PASS' WHEN {t} - max_rank <= 0 THEN 'BLOCK' WHEN {t} - max_rank = 1 THEN 'WARN' ELSE 'PASS' END"

# --- lines, secrets and entropy over documents ------------------------------------------------------------------------------


@query(f"WITH {_LINES} SELECT doc_id, line_no, length(line) AS n_chars FROM doc_lines")
def line_numbering(spark, sf_dir):
    return _doc_lines(spark, sf_dir).select("doc_id", "line_no", F.char_length("line").cast("bigint").alias("n_chars"))


def _secret_sql(key: str, lines: str) -> str:
    return " UNION ALL ".join(f"SELECT {key}, line_no, '{r}' AS rule_id, '{s}' AS severity, CAST({c} AS DOUBLE) AS confidence FROM {lines} WHERE regexp_matches(line, {X.literal(p)})" for r, s, c, _, p in K.SECRET_RULES)



def _secrets(spark, sf_dir):
    lines = T.lines(_table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return code_rules.secret_findings(lines, "doc_id", "source")


@query(f"WITH {_LINES} " + _secret_sql("doc_id", "doc_lines"))
def secret_findings(spark, sf_dir):
    return code_rules.secret_findings(_doc_lines(spark, sf_dir), "doc_id").select("doc_id", "line_no", "rule_id", "severity", "confidence")


_PLANTED_SECRETS = X.Over("l", [(f, k + 1, t) for k, (f, t) in enumerate(X.SECRET_LINES)], "file_path string, line_no int, line string", {"file_path": _own("file_path"), "line": "concat(line, ' ', source)"})


@query(f"WITH {_PLANTED_SECRETS.sql} " + _secret_sql("file_path", "l"))
def secret_patterns(spark, sf_dir):
    return code_rules.secret_findings(_PLANTED_SECRETS.frame(spark, sf_dir)).select("file_path", "line_no", "rule_id", "severity", "confidence")


@query(f"WITH {_LINES}, s AS (" + _secret_sql("doc_id", "doc_lines") + ") SELECT source, rule_id, count(*) AS n FROM s JOIN documents USING (doc_id) GROUP BY ALL")
def secret_by_source(spark, sf_dir):
    return _secrets(spark, sf_dir).groupBy("source", "rule_id").agg(F.count("*").alias("n"))


@query(f"WITH {_LINES}, s AS (" + _secret_sql("doc_id", "doc_lines") + f"""), g AS (SELECT source, count(rule_id) AS n, CAST(max({_SEV}) AS INTEGER) AS max_rank
  FROM documents LEFT JOIN s USING (doc_id) GROUP BY source) SELECT source, n, {_VERDICT.format(t=1)} AS verdict FROM g""")
def secret_verdict(spark, sf_dir):
    # a line has a rule once and the lines of a document stay together: nothing to deduplicate, nothing to join
    every = _table(spark, sf_dir, "documents").select("source").distinct()
    found = _secrets(spark, sf_dir).withColumn("sev_rank", findings.rank(F.col("severity"))).groupBy("source").agg(F.count("*").alias("n"), F.max("sev_rank").alias("max_rank"))
    found = found.unionByName(every.select("source", F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("int").alias("max_rank")))
    agg = found.groupBy("source").agg(F.sum("n").alias("n"), F.max("max_rank").alias("max_rank"))
    return agg.select("source", "n", findings.verdict(F.col("max_rank"), "MEDIUM").alias("verdict"))


_TOKENS = "SELECT doc_id, unnest(regexp_extract_all(text, '[0-9a-f]{20,}')) AS token FROM documents"
@query(f"WITH tokens AS ({_TOKENS}), ch AS (SELECT doc_id, token, unnest(string_split(token, '')) AS c FROM (SELECT DISTINCT * FROM tokens)), p AS (SELECT doc_id, token, c, count(*) / CAST(length(token) AS DOUBLE) AS p FROM ch GROUP BY doc_id, token, c), "
       "e AS (SELECT doc_id, token, round(sum(-p * log2(p)), 6) AS bits FROM p GROUP BY ALL) SELECT doc_id, token, bits FROM e ORDER BY bits DESC, token, doc_id LIMIT 20")  # fmt: skip
def entropy_topk(spark, sf_dir):
    """The 20 most random hexadecimal strings of 20 characters or more (a top-k report)."""
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("([0-9a-f]{20,})"), F.lit(1))).alias("token")).distinct()
    return rows.withColumn("bits", F.round(T.entropy(F.col("token")), 6)).orderBy(F.desc("bits"), "token", "doc_id").limit(20)


_ASSIGNED = r"([A-Za-z_]*(?:key|secret|token|passw|auth|cred)[A-Za-z_]*)[\"']?\s*[:=]\s*[\"']([A-Za-z0-9+/=_\-]{20,})[\"']"


@query(f"""WITH {_LINES}, v AS (SELECT doc_id, line_no, regexp_extract(line, {X.literal(_ASSIGNED)}, 1, 'i') AS name, regexp_extract(line, {X.literal(_ASSIGNED)}, 2, 'i') AS value FROM doc_lines
  WHERE regexp_matches(line, {X.literal(_ASSIGNED)}, 'i')), ch AS (SELECT *, unnest(string_split(value, '')) AS c FROM v), p AS (SELECT doc_id, line_no, name, value, c, count(*) / CAST(length(value) AS DOUBLE) AS p FROM ch GROUP BY doc_id, line_no, name, value, c),
  e AS (SELECT doc_id, line_no, name, round(sum(-p * log2(p)), 6) AS bits FROM p GROUP BY doc_id, line_no, name, value)
  SELECT doc_id, line_no, name, bits, CASE WHEN bits >= 4.2 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM e WHERE bits >= 3.5""")
def entropy_findings(spark, sf_dir):
    return code_rules.entropy_findings(_doc_lines(spark, sf_dir), "doc_id")


@query("""WITH g AS (SELECT source || '.' || lang AS name, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT sum(n) AS total FROM g)
  SELECT name, n, round(100.0 * n / total, 4) AS pct, CAST(least(20, greatest(1, floor(100.0 * n / total / 5))) AS INTEGER) AS bar FROM g, t""")
def ext_histogram(spark, sf_dir):
    counts = _table(spark, sf_dir, "documents").groupBy(F.concat_ws(".", "source", "lang").alias("name")).agg(F.count("*").alias("n"))
    return findings.shares(counts, "name")


_NAMES = X.Over("e", [("a.py",), ("b/c.PY",), (".env",), ("x/.env",), ("a.tar.gz",), ("Makefile",), ("d.e/f",)], "p string", {"p": "concat(source, '/', p)"})


@query(f"WITH {_NAMES.sql} SELECT regexp_extract(lower(p), '[^/.][^/]*?(\\.[^./]*)$', 1) AS ext, count(*) AS n FROM e GROUP BY 1")
def extension_counts(spark, sf_dir):
    return _NAMES.frame(spark, sf_dir).groupBy(T.extension(F.col("p")).alias("ext")).agg(F.count("*").alias("n"))


# --- findings and the verdict --------------------------------------------------------------------------------------------------

_FOUND = X.Over("f", X.FINDINGS, X.FINDING_COLUMNS, {"file_path": _own("file_path"), "ord": "doc_id * 100 + ord"}, group=lambda r: r[0])
_F = _FOUND.sql


def _findings(spark, sf_dir) -> DataFrame:
    return findings.conform(_FOUND.frame(spark, sf_dir))


_FIRST = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_path, line_number, rule_id, endpoint ORDER BY ord) AS rn FROM f) WHERE rn = 1"


@query(f"WITH {_F} SELECT file_path, line_number, rule_id, endpoint, severity, ord FROM ({_FIRST})")
def findings_dedup_first(spark, sf_dir):
    return findings.first_only(_findings(spark, sf_dir)).select("file_path", "line_number", "rule_id", "endpoint", "severity", "ord")


@query(f"WITH {_F} SELECT file_path, line_number, rule_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY file_path, line_number, rule_id ORDER BY ord) AS rn FROM f) WHERE rn = 1")
def dependency_dedup(spark, sf_dir):
    return findings.first_only(_findings(spark, sf_dir), "file_path", "line_number", "rule_id").select("file_path", "line_number", "rule_id", "ord")


@query(f"""WITH {_F}, d AS ({_FIRST}) SELECT file_path, count(*) FILTER (severity = 'LOW') AS low, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'HIGH') AS high,
  count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) AS total, CAST(max({_SEV}) AS TINYINT) AS max_rank FROM d GROUP BY file_path""")
def severity_summary(spark, sf_dir):
    return findings.severity_counts(findings.first_only(_findings(spark, sf_dir)), "file_path")


@query(f"WITH {_F}, d AS ({_FIRST}) SELECT issue_type, count(*) AS n FROM d GROUP BY issue_type")
def type_counts(spark, sf_dir):
    return findings.type_counts(findings.first_only(_findings(spark, sf_dir)))


_MATRIX = [(h, t) for h in (None, *K.SEVERITIES) for t in K.SEVERITIES]
_MATRIX_ROWS = X.Over("m", _MATRIX, "highest string, threshold string")
_M = _MATRIX_ROWS.sql
_MV = f"SELECT highest, threshold, {_RANK.format('highest')} AS max_rank, {_RANK.format('threshold')} AS t FROM m"


@query(f"WITH {_M}, r AS ({_MV}) SELECT highest, threshold, {_VERDICT.format(t='t')} AS verdict FROM r")
def verdict_matrix(spark, sf_dir):
    rows = _MATRIX_ROWS.frame(spark, sf_dir)
    return rows.select("highest", "threshold", findings.verdict(findings.rank(F.col("highest")), F.col("threshold")).alias("verdict"))


@query(f"WITH {_M}, r AS ({_MV}) SELECT highest, threshold, CASE {_VERDICT.format(t='t')} WHEN 'BLOCK' THEN 2 WHEN 'WARN' THEN 1 ELSE 0 END AS code FROM r")
def exit_code(spark, sf_dir):
    return verdict_matrix(spark, sf_dir).select("highest", "threshold", findings.exit_code(F.col("verdict")).alias("code"))


@query(f"WITH {_F} SELECT rule_id, arg_min(severity, ord) AS severity, arg_min(issue_type, ord) AS issue_type, min(ord) AS first_ord FROM f GROUP BY rule_id")
def distinct_rules(spark, sf_dir):
    return findings.distinct_rules(_findings(spark, sf_dir)).drop("message")


@query(f"WITH {_F} SELECT file_path, string_agg(rule_id, ',' ORDER BY ord) AS rules, CAST(max({_SEV}) AS TINYINT) AS max_rank FROM f GROUP BY file_path")
def findings_by_file(spark, sf_dir):
    rows = findings.by_file(_findings(spark, sf_dir))
    return rows.select("file_path", F.array_join(F.transform("findings", lambda f: f["rule_id"]), ",").alias("rules"), "max_rank")


@query(f"WITH {_F} SELECT rule_id, severity, CAST(ord + CASE WHEN k = 1 THEN 4503599627370496 ELSE 0 END AS BIGINT) AS ord FROM f, (VALUES (0), (1)) u(k)")
def detector_union(spark, sf_dir):
    return findings.union(_findings(spark, sf_dir), _findings(spark, sf_dir)).select("rule_id", "severity", "ord")


# --- insecure code ---------------------------------------------------------------------------------------------------------------

_CODE_ROWS = [(f, k + 1, t) for k, (f, t) in enumerate(X.CODE)]
_CODE_LINES = X.Over("c", _CODE_ROWS, "file_path string, line_no int, line string", {"file_path": _own("file_path"), "line": "concat(line, ' ', source)", "planted_in": "doc_id"}, group=lambda r: r[1] % 8)
_CODE = _CODE_LINES.sql
_KEPT = """SELECT * FROM {0} WHERE NOT (starts_with(trim(line), '#') OR starts_with(trim(line), '//') OR starts_with(trim(line), '/*') OR contains(line, '\"\"\"') OR contains(line, ''''''''))
  AND NOT (contains(lower(line), 'import ') AND contains(lower(line), 'from '))"""


def _rule_sql(rules, source: str, key: str = "file_path") -> str:
    parts = []
    for rule_id, _, severity, confidence, _, pattern in rules:
        test = f"regexp_matches(line, {X.literal(pattern)})"
        if rule_id == "SAF-YAML-LOAD":  # RE2 has no lookahead: the call, and not the call with a safe loader
            test = "regexp_matches(line, '\\byaml\\.load\\s*\\(') AND NOT regexp_matches(line, '\\byaml\\.load\\s*\\([^)]*\\bLoader\\s*=\\s*SafeLoader')"
        elif rule_id == "SAF-SQL-FSTRING":
            test = "regexp_matches(line, '(?i)(?:cursor\\.execute|\\.execute|\\.raw)\\s*\\(\\s*f[\"\u201d]')"
        if rule_id == "SAF-ASSERT":
            test += " AND NOT contains(lower(line), 'def test_') AND NOT contains(lower(line), 'class test')"
        if rule_id == "SAF-COMPILE":
            test += " AND NOT contains(line, 're.compile')"
        parts.append(f"SELECT {key}, line_no, '{rule_id}' AS rule_id, '{severity}' AS severity, CAST({confidence} AS DOUBLE) AS confidence FROM kept WHERE {test} AND NOT (contains(line, 'SAF-') AND contains(line, '{rule_id}'))")
    return f"kept AS ({_KEPT.format(source)}) " + " UNION ALL ".join(parts)


FAMILIES = tuple(dict.fromkeys(r[1] for r in K.CODE_RULES))


def _code_query(family: str | None):
    def run(spark, sf_dir):
        rows = _CODE_LINES.frame(spark, sf_dir)
        return code_rules.code_findings(rows, families=(family,) if family else ()).select("file_path", "line_no", "rule_id", "severity", "confidence")

    return run


for _family in FAMILIES:
    query(f"WITH {_CODE}, " + _rule_sql([r for r in K.CODE_RULES if r[1] == _family], "c"), f"static_match_{_family}")(_code_query(_family))
query(f"WITH {_CODE}, " + _rule_sql(K.CODE_RULES, "c"), "static_match_all")(_code_query(None))


_PLANTED = "every AS (SELECT doc_id, line_no, line FROM doc_lines UNION ALL SELECT -1 - planted_in AS doc_id, line_no, line FROM c)"


@query(f"WITH {_LINES}, {_CODE}, {_PLANTED}, " + _rule_sql(K.CODE_RULES, "every", "doc_id"))
def static_match_documents(spark, sf_dir):
    """All rules over all documents' lines; as prose holds no code, each document has some lines of code too, under ids from -1 down."""
    planted = _CODE_LINES.frame(spark, sf_dir).select((F.lit(-1) - F.col("planted_in")).alias("doc_id"), "line_no", "line")
    rows = _doc_lines(spark, sf_dir).unionByName(planted)
    return code_rules.code_findings(rows, "doc_id").select("doc_id", "line_no", "rule_id", "severity", "confidence")


@query(f"WITH {_CODE} SELECT line_no, starts_with(trim(line), '#') OR starts_with(trim(line), '//') OR starts_with(trim(line), '/*') OR contains(line, '\"\"\"') OR contains(line, '''''''') AS comment, contains(lower(line), 'import ') AND contains(lower(line), 'from ') AS imported, left(trim(line), 80) AS snippet FROM c")
def suppressions(spark, sf_dir):
    rows, line = _CODE_LINES.frame(spark, sf_dir), F.col("line")
    imported = F.lower(line).contains("import ") & F.lower(line).contains("from ")
    return rows.select("line_no", code_rules.commented(line).alias("comment"), imported.alias("imported"), F.substring(T.strip(line), 1, 80).alias("snippet"))


_PYTHON = [
    ("a.py", "import requests\npassword = 'longenough'\ndef f():\n    api_key = \"12345678\"\n    try:\n        requests.get(u)\n    except:\n        pass\n    requests.post(u, timeout=3, verify=False)\n"),
    ("b.py", "def broken(:\n"), ("c.txt", "password = 'longenough'"), ("d.py", "pwd = 'short'\nx.get(u)\nhttpx.get(u, timeout=1)\n"), ("e.py", None), ("f.py", ""),
]


@query()
def ast_rules(spark, sf_dir):
    return syntax_tree.tree_findings(X.Over("p", _PYTHON, "file_path string, content string", {"file_path": _own("file_path")}).frame(spark, sf_dir))


# --- manifests and advisories ------------------------------------------------------------------------------------------------------

_MANIFEST_ROWS = {kind: X.Over("m", rows, "manifest string, content string", {"manifest": _own("manifest")}, group=lambda r: 0) for kind, rows in X.MANIFESTS.items()}
_MF = lambda kind: _MANIFEST_ROWS[kind].sql
_ML = "l AS (SELECT manifest, CAST(generate_subscripts(string_split(content, chr(10)), 1) AS INTEGER) AS line_num, trim(unnest(string_split(content, chr(10))), ' ' || chr(9)) AS line FROM m)"
_SECTION = "h AS (SELECT *, last_value(CASE WHEN {0} THEN line END IGNORE NULLS) OVER (PARTITION BY manifest ORDER BY line_num) AS section, {0} AS heading FROM l)"
_OUT = "manifest, lower({0}) AS name, {1} AS version_spec, {2} AS line_num"
_Q = X.literal


def _all_sql(pattern: str, name: str, spec: str, where: str = "true", options: str = "") -> str:
    group = lambda k: f"unnest(regexp_extract_all(content, {_Q(pattern)}, {k}{options}))"
    groups = ", ".join(f"{group(k)} AS g{k}" for k in range(1, 4 if "g3" in spec else 3))
    return f"SELECT {_OUT.format(name, spec, '0')} FROM (SELECT manifest, {groups} FROM m) WHERE {where}"


_PARSE_SQL = {
    "requirements": f"{_ML}, c AS (SELECT *, trim(string_split(line, ' #')[1]) AS cut FROM l WHERE NOT starts_with(line, '#') AND NOT starts_with(line, '-')) SELECT {_OUT.format(f'regexp_extract(cut, {_Q(manifests.REQUIREMENT)}, 1)', f'trim(regexp_extract(cut, {_Q(manifests.REQUIREMENT)}, 2))', 'line_num')} FROM c WHERE regexp_matches(cut, {_Q(manifests.REQUIREMENT)})",
    "pipfile": f"{_ML}, " + _SECTION.format("starts_with(line, '[') AND ends_with(line, ']')") + ", s AS (SELECT *, trim(trim(trim(substr(line, instr(line, '=') + 1)), '\"'), '''') AS spec, trim(trim(trim(left(line, instr(line, '=') - 1)), '\"'), '''') AS nm FROM h WHERE NOT heading AND section IN ('[packages]', '[dev-packages]') AND contains(line, '=') AND NOT starts_with(line, '#')) "
        f"SELECT {_OUT.format('nm', 'spec', 'line_num')} FROM s WHERE spec NOT IN ('', '*')",
    "gradle": f"{_ML}, g AS (SELECT *, string_split(regexp_extract(line, {_Q(manifests.GRADLE)}, 1), ':') AS p FROM l) SELECT {_OUT.format('p[1] || chr(58) || p[2]', 'p[3]', 'line_num')} FROM g WHERE len(p) >= 3",
    "nuget": _all_sql(manifests.NUGET, "g1", "g2"), "csproj": _all_sql(manifests.CSPROJ, "g1", "g2"), "yarn": _all_sql(manifests.YARN, "trim(g1)", "g2"),
    "pom": _all_sql(manifests.POM, "trim(g1) || ':' || trim(g2)", "trim(g3)", "NOT starts_with(trim(g3), '$')"),
    "gomod": f"{_ML}, " + _SECTION.format("line IN ('require (', ')')") + f", w AS (SELECT *, string_split_regex(line, '\\s+') AS w, CASE WHEN section = 'require (' THEN 1 WHEN starts_with(line, 'require ') THEN 2 END AS k FROM h WHERE NOT heading) SELECT {_OUT.format('w[k]', 'ltrim(w[k + 1], chr(118))', 'line_num')} FROM w WHERE k IS NOT NULL AND len(w) > k",
    "cargo": f"{_ML}, " + _SECTION.format("(starts_with(line, '[dependencies') OR (starts_with(line, '[') AND ends_with(line, ']')))") + ", s AS (SELECT *, trim(substr(line, instr(line, '=') + 1)) AS v, trim(trim(left(line, instr(line, '=') - 1)), '\"') AS nm FROM h WHERE NOT heading AND starts_with(section, '[dependencies') AND contains(line, '=') AND NOT starts_with(line, '#')), "
        "u AS (SELECT *, CASE WHEN starts_with(v, '{') THEN regexp_extract(v, 'version\\s*=\\s*\"([^\"]+)\"', 1) WHEN starts_with(v, '\"') AND ends_with(v, '\"') THEN trim(v, '\"') END AS spec FROM s) " + f"SELECT {_OUT.format('nm', 'spec', 'line_num')} FROM u WHERE spec <> ''",
    "gemfile": f"{_ML} SELECT {_OUT.format(f'regexp_extract(line, {_Q(manifests.GEM)}, 1)', f'regexp_extract(line, {_Q(manifests.GEM)}, 2)', 'line_num')} FROM l WHERE regexp_matches(line, {_Q(manifests.GEM)})",
}
for _kind, _parts in manifests.JSON_SECTIONS.items():
    _each = " UNION ALL ".join(f"SELECT manifest, unnest(json_keys(content, '$.\"{s}\"')) AS k, '{s}' AS s, content FROM m WHERE json_valid(content)" for s in _parts)
    _PARSE_SQL[_kind] = f"j AS ({_each}), v AS (SELECT manifest, k, trim(json_extract_string(content, '$.\"' || s || '\".\"' || k || '\"')) AS spec FROM j WHERE k <> 'php') SELECT {_OUT.format('k', 'spec', '0')} FROM v WHERE spec <> ''"


def _parse_query(kind: str):
    def run(spark, sf_dir):
        return manifests.PARSERS[kind](_MANIFEST_ROWS[kind].frame(spark, sf_dir)).drop("snippet")

    return run


for _kind, _sql in _PARSE_SQL.items():
    query(f"WITH {_MF(_kind)}" + (", " if _sql[:6] != "SELECT" else " ") + _sql, f"parse_{_kind}")(_parse_query(_kind))

_FILES = [(m, c) for rows in X.MANIFESTS.values() for m, c in rows] + [("sub/requirements.txt", "flask==1.0"), ("bin/x.csproj", "<PackageReference Include=\"A\" Version=\"1\" />")]
_TREE = X.Over("f", _FILES, "file_path string, content string", {"of": "doc_id"}, group=lambda r: 0)
_DETECT_ROWS = [(n, e, k) for n, (e, k) in K.MANIFESTS.items()]


@query(f"WITH {_TREE.sql}, " + X.relation("d", _DETECT_ROWS, "name string, ecosystem string, parser string") + """
  SELECT file_path, ecosystem, parser FROM f JOIN d ON file_path = name UNION ALL SELECT file_path, 'NuGet', 'csproj' FROM f WHERE regexp_matches(file_path, '\\.(csproj|vbproj|fsproj)$') AND NOT regexp_matches(file_path, '(^|/)(bin|obj|target|node_modules)/')""")
def manifest_detection(spark, sf_dir):
    return manifests.detect(_TREE.frame(spark, sf_dir)).select("file_path", "ecosystem", "parser")


_ECOSYSTEM = {kind: eco for eco, kind in K.MANIFESTS.values()} | {"csproj": "NuGet"}
_COUNTED = " UNION ALL ".join(
    f"SELECT '{_ECOSYSTEM[k]}' AS ecosystem, (SELECT count(*) FROM (WITH {_MF(k)}{', ' if q[:6] != 'SELECT' else ' '}{q})) AS n" for k, q in _PARSE_SQL.items()
)


@query(f"SELECT ecosystem, CAST(sum(n) AS BIGINT) AS n FROM ({_COUNTED}) GROUP BY ecosystem")
def package_counts(spark, sf_dir):
    found = manifests.detect(_TREE.frame(spark, sf_dir)).select(F.concat_ws("/", "of", "file_path").alias("manifest"), "content", "ecosystem", "parser")
    return manifests.parse(found).groupBy("ecosystem").agg(F.count("*").alias("n"))


_SPECS = [("==2.0.0",), (">=3.2,<4.0",), ("^4.18.0",), ("~4.17.21",), ("==2.0.*",), ("v1.2.3",), ("!=2.0.0",), ("1.0",)]


_SPEC_ROWS = X.Over("s", _SPECS, "spec string")


@query(f"WITH {_SPEC_ROWS.sql}" + " SELECT spec, regexp_replace(regexp_replace(trim(regexp_replace(trim(string_split(spec, ',')[1]), '^[><=!~]+', '')), '\\*+$', ''), '^[\\^~vV]+', '') AS version FROM s")
def version_extraction(spark, sf_dir):
    return _SPEC_ROWS.frame(spark, sf_dir).select("spec", manifests.bound_version(F.col("spec")).alias("version"))


_NUM = "list_resize(list_transform(string_split(regexp_replace({0}, '^[<>=!]+', ''), '.'), lambda x: try_cast(x AS BIGINT)), 12, 0)"
_OPS = "CASE regexp_extract(c, '^(==|!=|<=|>=|<|>)', 1) WHEN '==' THEN v = b WHEN '!=' THEN v <> b WHEN '<' THEN v < b WHEN '>' THEN v > b WHEN '<=' THEN v <= b WHEN '>=' THEN v >= b END"


_VERSION_ROWS = X.Over("t", X.VERSIONS, "version string, ranges string", {"d": "doc_id"})


@query(f"WITH {_VERSION_ROWS.sql}" + f""", u AS (SELECT version, ranges, unnest(string_split(ranges, ',')) AS c FROM t WHERE regexp_matches(version, '^[0-9]+(\\.[0-9]+)*$')),
  k AS (SELECT version, ranges, c, {_NUM.format('version')} AS v, {_NUM.format('c')} AS b FROM u), a AS (SELECT version, ranges, bool_and({_OPS}) AS hit FROM k GROUP BY ALL)
  SELECT t.version, t.ranges, coalesce(a.hit, false) AS hit FROM t LEFT JOIN a USING (version, ranges)""")
def version_boundary(spark, sf_dir):
    rows = _VERSION_ROWS.frame(spark, sf_dir)
    return rows.select("version", "ranges", advisories.affected(F.col("version"), F.array("ranges")).alias("hit"))


_PKG = [("requirements.txt", "PyPI", n, f"=={v}", k + 1, f"{n}=={v}") for k, (n, v) in enumerate([("django", "3.0.0"), ("flask", "2.0.0"), ("requests", "2.28.0"), ("PyYAML", "5.3.0"), ("cryptography", "38.0.0"), ("numpy", "1.23.0"), ("pillow", "9.4.0"), ("django", "4.0.0"), ("Django", "3.9.9"), ("gunicorn", "20.0"), ("celery", "5.2.0"), ("redis", "4.4.0"), ("tornado", "6.3.0"), ("click", "8"), ("boto3", "1.x")])] + [("package.json", "npm", "redis", "^4.0.0", 0, "redis")]
_PKG_COLUMNS = "manifest string, ecosystem string, name string, version_spec string, line_num int, snippet string"
_PKG_ROWS = X.Over("p", _PKG, _PKG_COLUMNS, {"manifest": _own("manifest")}, group=lambda r: r[4] % 4)
_ADV = [(p, r, s, c) for p, rs, s, c in K.ADVISORIES for r in rs]
_KEY = "list_append(" + _NUM.replace("{0}", "regexp_replace({0}, '(a|b|rc)[0-9]+$', '')") + ", CASE WHEN regexp_matches({0}, '(a|b|rc)[0-9]+$') THEN -1 ELSE 0 END)"


@query("WITH " + _PKG_ROWS.sql + ", " + X.relation("a", _ADV, "package string, r string, sev string, cve string") + f""", j AS (SELECT p.*, a.*, regexp_replace(version_spec, '^[=^]+', '') AS version FROM p JOIN a ON lower(name) = package WHERE ecosystem = 'PyPI'),
  u AS (SELECT *, unnest(string_split(r, ',')) AS c FROM j WHERE regexp_matches(version, '^[0-9.]+$')), k AS (SELECT *, {_KEY.format('version')} AS v, {_KEY.format('c')} AS b FROM u),
  h AS (SELECT manifest, line_num, name, version, cve, sev, r, bool_and({_OPS}) AS hit FROM k GROUP BY ALL)
  SELECT DISTINCT manifest, line_num, name, version, 'DEP-' || replace(cve, '-', '_') AS rule_id, sev AS severity FROM h WHERE hit""")
def advisory_join(spark, sf_dir):
    return advisories.advisory_findings(_PKG_ROWS.frame(spark, sf_dir), advisories.offline_advisories(spark)).drop("snippet")


_CVSS = [(None,), (9.0,), (8.9,), (7.0,), (6.9,), (4.0,), (3.9,), (0.0,), (10.0,)]


_CVSS_ROWS = X.Over("s", _CVSS, "score double")


@query(f"WITH {_CVSS_ROWS.sql}" + " SELECT score, CASE WHEN score IS NULL THEN 'MEDIUM' WHEN score >= 9 THEN 'CRITICAL' WHEN score >= 7 THEN 'HIGH' WHEN score >= 4 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM s")
def cvss_buckets(spark, sf_dir):
    return _CVSS_ROWS.frame(spark, sf_dir).select("score", advisories.cvss_severity(F.col("score")).alias("severity"))


_OSV = [
    '{"id":"GHSA-1","aliases":["X-1","CVE-2020-1"],"database_specific":{"severity":"high"},"affected":[{"ranges":[{"type":"SEMVER","events":[{"introduced":"0"},{"fixed":"1.2"}]},{"type":"GIT","events":[{"fixed":"abc"}]}]}]}',
    '{"id":"GHSA-2","severity":[{"type":"CVSS_V2","score":"9.9"},{"type":"CVSS_V3","score":"CVSS:3.1/AV:N"},{"type":"CVSS_V3","score":"7.5"}],"affected":[{"ranges":[{"type":"ECOSYSTEM","events":[{"introduced":"0"},{"fixed":"2.0"}]}]},{"ranges":[{"type":"ECOSYSTEM","events":[{"fixed":"3.1"}]}]}]}',
    '{"id":"CVE-2021-9","aliases":[],"affected":[{"ecosystem_specific":{"severity":"critical"}}]}', '{"id":"Z"}',
    '{"id":"G-4","severity":[{"type":"CVSS_V3","score":"3.1"}],"affected":[{"database_specific":{"severity":"HIGH"},"ranges":[{"type":"SEMVER","events":[{"introduced":"0"}]},{"type":"ECOSYSTEM","events":[{"fixed":"4.0"},{"fixed":"4.1"}]}]}]}',
    '{"id":"G-5","database_specific":{"severity":"moderate"},"severity":[{"type":"CVSS_V3","score":"9.8"}]}', '{"id":"G-6","severity":[{"type":"CVSS_V3","score":"9.0"}],"affected":[]}',
    '{"id":"G-7","affected":[{"ecosystem_specific":{"severity":"odd"}},{"database_specific":{"severity":"low"}}]}',
]


_OSV_ROWS = X.Over("r", [(x,) for x in _OSV], "j string", {"j": "replace(j, '{\"id\":\"', concat('{\"id\":\"', cast(doc_id as string), '-'))"})


def _osv(rows):
    return rows.select(F.from_json("j", f"struct<{advisories.OSV.replace(' string', ':string').replace(' array', ':array').replace(' struct', ':struct')}>").alias("o")).select("o.*")


_OSV_WORD = "CASE WHEN upper({0}) IN ('LOW', 'MEDIUM', 'HIGH', 'CRITICAL') THEN upper({0}) WHEN upper({0}) = 'MODERATE' THEN 'MEDIUM' END"
_OSV_SQL = f"""s AS (SELECT json_extract_string(j, '$.id') AS id, j FROM r),
  score AS (SELECT id, min_by(v, k) AS score FROM (SELECT id, k, try_cast(json_extract_string(x, '$.score') AS DOUBLE) AS v FROM (SELECT id, unnest(json_extract(j, '$.severity[*]')) AS x, generate_subscripts(json_extract(j, '$.severity[*]'), 1) AS k FROM s) WHERE json_extract_string(x, '$.type') = 'CVSS_V3') WHERE v IS NOT NULL GROUP BY id),
  aff AS (SELECT id, unnest(json_extract(j, '$.affected[*]')) AS a, generate_subscripts(json_extract(j, '$.affected[*]'), 1) AS k FROM s),
  word AS (SELECT id, min_by(w, k) AS word FROM (SELECT id, k, coalesce({_OSV_WORD.format("json_extract_string(a, '$.database_specific.severity')")}, {_OSV_WORD.format("json_extract_string(a, '$.ecosystem_specific.severity')")}) AS w FROM aff) WHERE w IS NOT NULL GROUP BY id),
  rng AS (SELECT id, k, unnest(json_extract(a, '$.ranges[*]')) AS g, generate_subscripts(json_extract(a, '$.ranges[*]'), 1) AS m FROM aff),
  fix AS (SELECT id, max_by(f, 1000 * k + m) AS fixed FROM (SELECT id, k, m, json_extract_string(g, '$.events[*].fixed')[1] AS f FROM rng WHERE json_extract_string(g, '$.type') IN ('SEMVER', 'ECOSYSTEM')) WHERE f IS NOT NULL GROUP BY id),
  osv AS (SELECT s.id, coalesce(list_filter(CAST(json_extract(j, '$.aliases') AS VARCHAR[]), lambda a: starts_with(a, 'CVE-'))[1], s.id) AS cve,
    coalesce({_OSV_WORD.format("json_extract_string(j, '$.database_specific.severity')")}, CASE WHEN score >= 9 THEN 'CRITICAL' WHEN score >= 7 THEN 'HIGH' WHEN score >= 4 THEN 'MEDIUM' WHEN score IS NOT NULL THEN 'LOW' END, word, 'MEDIUM') AS severity, coalesce(fixed, '') AS fixed
    FROM s LEFT JOIN score USING (id) LEFT JOIN word USING (id) LEFT JOIN fix USING (id))"""


@query(f"WITH {_OSV_ROWS.sql}, {_OSV_SQL} SELECT id, cve, severity, fixed FROM osv")
def osv_summary(spark, sf_dir):
    return advisories.osv_summary(_osv(_OSV_ROWS.frame(spark, sf_dir)))


_HITS = [("PyPI", "flask", "2.0.0", "GHSA-1"), ("PyPI", "django", "3.0.0", "G-4"), ("PyPI", "numpy", "1.23.0", "G-6"), ("npm", "redis", "4.0.0", "GHSA-2"), ("PyPI", "redis", "9.9", "Z")]


@query("WITH " + _PKG_ROWS.sql + ", " + X.relation("h", _HITS, "ecosystem string, name string, version string, id string") + ", " + X.relation("r", [(x,) for x in _OSV], "j string") + f""", {_OSV_SQL}
  SELECT manifest, line_num, p.name, h.version, 'DEP-' || replace(cve, '-', '_') AS rule_id, severity, fixed FROM p JOIN h ON p.ecosystem = h.ecosystem AND p.name = h.name AND regexp_replace(version_spec, '^[=^]+', '') = h.version JOIN osv USING (id)""")
def osv_join(spark, sf_dir):
    return advisories.osv_findings(_PKG_ROWS.frame(spark, sf_dir).drop("snippet"), X.frame(spark, _HITS, "ecosystem string, name string, version string, id string"), _osv(X.frame(spark, [(x,) for x in _OSV], "j string")))


# --- times, budget and advice -------------------------------------------------------------------------------------------------------

_TIMES = [("secrets", 30.0), ("static_analysis", 30.0), ("dependencies", 12.5), ("discovery", 0.0)]


_TIME_ROWS = X.Over("t", _TIMES, "scanner string, ms double", {"ms": "ms + n_chars % 50"})


@query(f"WITH {_TIME_ROWS.sql}" + " SELECT scanner, ms, round(100 * ms / 80.0, 4) AS pct FROM t")
def timing_share(spark, sf_dir):
    return findings.time_shares(_TIME_ROWS.frame(spark, sf_dir), 80.0)


_ADVISED = [(r,) for r in sorted(A.WEB)] + [("DAST-EXPOSED-ENV",), ("DAST-VERBOSE-ERROR-PATH_TRAVERSAL",), ("DAST-INJECTION-OTHER",), ("DAST-AWS-METADATA-ACCESSIBLE",), ("DAST-UNKNOWN",)]
_ADVISED_ROWS = X.Over("r", _ADVISED, "rule_id string")
_WEB_TABLE = X.relation("w", [(r, *v[:3]) for r, v in A.WEB.items()], "rule_id string, t string, c string, o string")


@query(f"WITH {_ADVISED_ROWS.sql}, {_WEB_TABLE} " + """SELECT rule_id,
  coalesce(t, CASE WHEN starts_with(rule_id, 'DAST-EXPOSED-') THEN 'dast_exposed_endpoint' WHEN starts_with(rule_id, 'DAST-VERBOSE') THEN 'dast_information_disclosure' WHEN starts_with(rule_id, 'DAST-INJ') THEN 'dast_injection' WHEN ends_with(rule_id, '-METADATA-ACCESSIBLE') THEN 'dast_ssrf' ELSE 'dast' END) AS issue_type,
  coalesce(c, CASE WHEN starts_with(rule_id, 'DAST-EXPOSED-') THEN 'CWE-200' WHEN starts_with(rule_id, 'DAST-VERBOSE') THEN 'CWE-209' WHEN starts_with(rule_id, 'DAST-INJ') THEN 'CWE-74' WHEN ends_with(rule_id, '-METADATA-ACCESSIBLE') THEN 'CWE-918' ELSE '' END) AS cwe_id,
  coalesce(o, CASE WHEN starts_with(rule_id, 'DAST-EXPOSED-') OR starts_with(rule_id, 'DAST-VERBOSE') THEN 'A05:2021' WHEN starts_with(rule_id, 'DAST-INJ') THEN 'A03:2021' WHEN ends_with(rule_id, '-METADATA-ACCESSIBLE') THEN 'A10:2021' ELSE '' END) AS owasp_category FROM r LEFT JOIN w USING (rule_id)""")
def rule_categories(spark, sf_dir):
    told = A.web_advice(F.col("rule_id"))
    return _ADVISED_ROWS.frame(spark, sf_dir).select("rule_id", *[told[c].alias(c) for c in ("issue_type", "cwe_id", "owasp_category")])


_PROBES = [("t", p, "", k, 200) for p, n in (("root", 1), ("path", 5), ("verbose", 3), ("listing", 4), ("idor", 3), ("xml", 2), ("graphql", 2), ("cors", 2)) for k in range(n)] + [("u", "path", "", 0, 200), ("u", "listing", "", 0, 200)]
_PROBE_COLUMNS = "target string, probe string, detail string, seq int, status_code int"


_PROBE_ROWS = X.Over("r", _PROBES, _PROBE_COLUMNS, {"target": "concat(target, '/', cast(page_id as string))"}, table="pages", key="page_id", group=lambda r: r[0])


@query(f"WITH {_PROBE_ROWS.sql}" + """, o AS (SELECT *, list_position(['root', 'path', 'verbose', 'listing', 'idor', 'xml', 'graphql'], probe) AS step FROM r),
  b AS (SELECT *, (SELECT count(*) FROM o p WHERE p.target = o.target AND p.step > 0 AND p.probe <> 'listing' AND (p.step < o.step OR (p.step = o.step AND p.seq < o.seq))) AS asked FROM o)
  SELECT target, probe, seq FROM b WHERE step IS NULL OR step = 1 OR asked < 10""")
def probe_budget(spark, sf_dir):
    return responses.budgeted(_PROBE_ROWS.frame(spark, sf_dir), 10).select("target", "probe", "seq")


# --- addresses and pages -------------------------------------------------------------------------------------------------------------


@query("SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1) AS host FROM pages")
def url_parts(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("url", "^([A-Za-z][A-Za-z0-9+.-]*)://", 1)).alias("scheme"), T.host(F.col("url")).alias("host"))


_URL_ROWS = X.Over("u", X.URLS, "url string", {"url": "concat(url, case when contains(url, '://') then cast(doc_id as string) else '' end)"})


@query(f"WITH {_URL_ROWS.sql}" + " SELECT url, CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) ELSE 'http' END AS scheme, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1) AS host FROM u")
def url_edges(spark, sf_dir):
    return _URL_ROWS.frame(spark, sf_dir).select("url", T.scheme(F.col("url")).alias("scheme"), T.host(F.col("url")).alias("host"))


_JOINS = [("https://example.com/", "/api"), ("https://example.com", "api"), ("https://Example.com/app", "api/v1"), ("http://localhost:8080/test//", "a b/c?d='x'"), ("not-a-url", "")]
_QUOTED = "replace(replace(replace(replace(path, '?', '%3F'), '=', '%3D'), chr(39), '%27'), ' ', '%20')"


_JOIN_ROWS = X.Over("u", _JOINS, "url string, path string", {"path": "concat(path, source)"})


@query(f"WITH {_JOIN_ROWS.sql}" + f""" SELECT url, path, rtrim(url, '/') || '/' || ltrim(path, '/') AS joined, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS origin,
  CASE WHEN contains(url, '://') THEN lower(regexp_extract(url, '://([^/?#:]*)', 1)) ELSE url END AS host, starts_with(lower(url), 'https://') AS https, {_QUOTED} AS quoted FROM u""")
def url_functions(spark, sf_dir):
    rows, url, path = _JOIN_ROWS.frame(spark, sf_dir), F.col("url"), F.col("path")
    return rows.select("url", "path", T.join_url(url, path).alias("joined"), T.origin(url).alias("origin"), T.host_or_self(url).alias("host"), T.is_https(url).alias("https"), T.quote(path).alias("quoted"))


@query("SELECT page_id, url FROM pages WHERE NOT starts_with(lower(url), 'https://')")
def no_https(spark, sf_dir):
    return _table(spark, sf_dir, "pages").where(T.scheme(F.col("url")) != "https").select("page_id", "url")


@query("SELECT page_id, len(regexp_extract_all(html, '(?i)<script[^>]*>')) AS scripts, len(regexp_extract_all(html, '(?i)<script[^>]*src=')) AS external FROM pages WHERE regexp_matches(html, '(?i)<script')")
def html_inline_script(spark, sf_dir):
    count = lambda p: F.regexp_count("html", F.lit(p)).cast("bigint")
    return _table(spark, sf_dir, "pages").where(F.col("html").rlike("(?i)<script")).select("page_id", count("(?i)<script[^>]*>").alias("scripts"), count("(?i)<script[^>]*src=").alias("external"))


@query(f"SELECT page_id, " + " OR ".join(f"regexp_matches(lower(html), {_Q(p)}, 'i')" for p in K.FETCH_BODY) + " AS fetches, " + " OR ".join(f"regexp_matches(html, {_Q(p)}, 'i')" for p in K.DEBUG_BODY) + " AS debug FROM pages")
def page_indicators(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", responses.any_of(F.lower("html"), K.FETCH_BODY).alias("fetches"), responses.any_of(F.col("html"), K.DEBUG_BODY).alias("debug"))


# --- events --------------------------------------------------------------------------------------------------------------------------


@query("SELECT user_id, time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) >= 3")
def event_bursts(spark, sf_dir):
    return monitor.bursts(_table(spark, sf_dir, "events"), least=3, window="1 day")


@query("SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds, count(DISTINCT length(props)) AS sizes FROM events GROUP BY user_id HAVING count(*) >= 2 AND (count(DISTINCT event_type) > 1 OR count(DISTINCT length(props)) > 1)")
def event_enumeration(spark, sf_dir):
    agg = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("kinds"), F.countDistinct(F.length("props")).alias("sizes"))
    return agg.where("n >= 2 and (kinds > 1 or sizes > 1)")


# --- responses -------------------------------------------------------------------------------------------------------------------------

#: Each page is a target; the first answer's body has the page's markup in it.
_CAPTURE = X.Over("r", X.RESPONSES, X.RESPONSE_COLUMNS, {"target": "concat(target, '/', cast(page_id as string))", "body": "case when probe = 'root' and body <> '' then concat(body, html) else body end"}, table="pages", key="page_id", group=lambda r: r[0])
_R = _CAPTURE.sql


def _h(name: str) -> str:
    return f"coalesce(list_filter(headers, lambda x: lower(x.name) = '{name}')[1].value, '')"


def _rules(*items: tuple, source: str = "a", extra: str = "") -> str:
    """items: (rule, severity, confidence, condition[, endpoint]) as SQL expressions over the responses that were answered."""
    parts = [f"SELECT target, {i[0]} AS rule_id, {i[1]} AS severity, CAST({i[2]} AS DOUBLE) AS confidence, {i[4] if len(i) > 4 else 'target'} AS endpoint FROM {source} WHERE {i[3]}" for i in items]
    return f"WITH {_R}, a AS (SELECT * FROM r WHERE status_code <> 0){extra} " + " UNION ALL ".join(parts)


def _any(c: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({c}, {_Q(p)}, 'i')" for p in patterns) + ")"


def _in(paths) -> str:
    return "(" + " OR ".join(f"starts_with(detail, '{p}')" for p in paths) + ")"


_COOKIES = ", ck AS (SELECT target, c.value AS cookie, lower(c.value) AS low, string_split(c.value, '=')[1] AS name FROM (SELECT target, unnest(list_filter(headers, lambda x: lower(x.name) = 'set-cookie')) AS c FROM a WHERE probe = 'root'))"
_HSTS, _CSP = _h("strict-transport-security"), _h("content-security-policy")
_ALLOW = f"upper(CASE WHEN {_h('allow')} <> '' THEN {_h('allow')} ELSE {_h('access-control-allow-methods')} END)"
_SET = "array_to_string(list_transform(list_filter(headers, lambda x: lower(x.name) = 'set-cookie'), lambda x: x.value), chr(10))"
_ORIGIN = _h("access-control-allow-origin")
_SCRIPTS = "len(list_filter(regexp_extract_all(body, '(?i)<script[^>]*src=[\"''](?:https?:)?//[^\"'']+[\"''][^>]*>'), lambda t: NOT contains(lower(t), 'integrity='))) > 0"
_CTX = ", w AS (SELECT *, string_split(detail, '|')[1] AS kind, substr(detail, instr(detail, '|') + 1) AS payload FROM a), x AS (SELECT *, instr(body, payload) AS p FROM w WHERE contains(body, payload)), y AS (SELECT *, left(trim(regexp_replace(substr(body, greatest(1, p - 50), p - greatest(1, p - 50) + length(payload) + 50), '\\s+', ' ', 'g')), 120) AS ctx FROM x)"
_ERR = "(" + " OR ".join(f"contains(lower(ctx), {_Q(p.lower())})" for p in K.ERROR_PHRASES) + ")"
_RUN = "(contains(lower(ctx), '<script') OR regexp_matches(lower(ctx), 'on\\w+\\s*=') OR regexp_matches(ctx, '<[a-zA-Z][^>]*' || regexp_escape(left(payload, 20))) OR regexp_matches(ctx, regexp_escape(left(payload, 20)) || '[^>]*>'))"
_SUM = f", z AS (SELECT target, {{g}} count(*) AS n, count(DISTINCT ctx) AS places, count(DISTINCT kind) AS kinds, bool_and({_ERR}) AS errors, bool_or({_RUN}) AS runs, sum((length(body) - length(replace(body, payload, ''))) / length(payload)) AS times, bool_or(contains(lower(body), '<html') OR contains(lower(body), '<body') OR contains(lower(body), '<p>') OR contains(lower(body), '<div')) AS html FROM y WHERE probe = '{{p}}' GROUP BY ALL)"
_JWT = f""", tk AS (SELECT target, unnest(list_filter(list_concat([regexp_extract({_h('authorization')}, '(?i)bearer\\s+(\\S+)', 1)], [{', '.join(f"regexp_extract({_SET}, '(?i){n}=([^;\\n]+)', 1)" for n in responses.TOKEN_COOKIES)}],
  regexp_extract_all(body, 'eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+')), lambda t: t <> '')[1:5]) AS token FROM a WHERE probe = 'root'),
  pt AS (SELECT target, list_transform(string_split(token, '.')[1:2], lambda p: decode(from_base64(rpad(translate(p, '-_', '+/'), CAST(4 * ceil(length(p) / 4.0) AS INTEGER), '=')))) AS p FROM tk WHERE contains(token, '.')),
  jw AS (SELECT target, coalesce(json_extract_string(p[1], '$.alg'), '') AS alg, CAST(json_extract_string(p[2], '$.exp') AS DOUBLE) AS exp, json_extract_string(p[2], '$.iss') AS iss, json_extract_string(p[2], '$.aud') AS aud FROM pt)"""

RESPONSE_SQL = {
    "unreachable": f"WITH {_R} SELECT target, 'DAST-CONNECTION-ERROR' AS rule_id, 'LOW' AS severity, CAST(1 AS DOUBLE) AS confidence, target AS endpoint FROM r WHERE probe = 'root' AND status_code = 0",
    "security_headers": _rules(
        *[(f"'DAST-{n.upper().replace('-', '_')}'", f"'{s}'", 0.95, f"probe = 'root' AND {_h(n.lower())} = ''") for n, _, s in K.REQUIRED_HEADERS],
        ("'DAST-HSTS-NO-MAX-AGE'", "'MEDIUM'", 0.8, f"probe = 'root' AND {_HSTS} <> '' AND NOT contains(lower({_HSTS}), 'max-age=')"),
        ("'DAST-HSTS-LOW-MAX-AGE'", "'LOW'", 0.8, f"probe = 'root' AND try_cast(regexp_extract({_HSTS}, '(?i)max-age=(\\d+)', 1) AS BIGINT) < 10886400"),
    ),
    "cookies": _rules(*[(f"'DAST-COOKIE-NO-{f.upper()}'", f"'{s}'", 0.8, f"NOT contains(low, '{f}')") for f, s in (("secure", "HIGH"), ("httponly", "MEDIUM"), ("samesite", "MEDIUM"))], source="ck", extra=_COOKIES),
    "cookie_prefixes": _rules(("'DAST-COOKIE-PREFIX'", "'LOW'", 0.6, "contains(cookie, '=') AND regexp_matches(lower(name), 'session|sid|token|jwt') AND NOT starts_with(name, '__Host-') AND NOT starts_with(name, '__Secure-')"), source="ck", extra=_COOKIES),
    "cors": _rules(
        ("'DAST-CORS-WILDCARD'", "'HIGH'", 0.9, f"probe = 'cors' AND {_ORIGIN} = '*'"), ("'DAST-CORS-HTTP-ORIGIN'", "'MEDIUM'", 0.8, f"probe = 'cors' AND starts_with({_ORIGIN}, 'http://')"),
        ("'DAST-CORS-WITH-CREDENTIALS'", "'MEDIUM'", 0.7, f"probe = 'cors' AND {_ORIGIN} NOT IN ('', '*') AND lower({_h('access-control-allow-credentials')}) = 'true'"),
    ),
    "transport": _rules(
        ("'DAST-NO-HTTPS'", "'HIGH'", 1, "probe = 'root' AND NOT starts_with(target, 'https://')"), ("'DAST-TLS-CONNECTION-FAILED'", "'HIGH'", 1, "probe = 'root' AND starts_with(target, 'https://') AND tls_version IS NULL"),
        ("'DAST-WEAK-TLS'", "CASE WHEN tls_rank >= 4 THEN 'HIGH' ELSE 'MEDIUM' END", 0.8, "probe = 'root' AND starts_with(target, 'https://') AND tls_rank >= 3"),
    ),
    "server_info": _rules(
        ("'DAST-SERVER-INFO-DISCLOSURE'", "'LOW'", 0.9, f"probe = 'root' AND {_h('server')} <> ''"), ("'DAST-X-POWERED-BY'", "'LOW'", 0.9, f"probe = 'root' AND {_h('x-powered-by')} <> ''"),
        ("'DAST-DEBUG-MODE'", "'HIGH'", 0.8, f"probe = 'root' AND {_any('body', K.DEBUG_BODY)}"),
    ),
    "injections": _rules(("'DAST-INJECTION-' || upper(kind)", "CASE WHEN kind IN ('sql', 'command', 'ssti') THEN 'CRITICAL' ELSE 'HIGH' END", "round(least(0.95, 0.4 + CASE WHEN n >= 2 THEN 0.25 ELSE 0 END + CASE WHEN places >= 2 THEN 0.1 ELSE 0 END - CASE WHEN errors AND n < 3 THEN 0.2 ELSE 0 END + CASE WHEN runs THEN 0.15 ELSE 0 END + CASE WHEN times > 2 * n THEN 0.1 ELSE 0 END), 4)", "true"), source="z", extra=_CTX + _SUM.format(g="kind,", p="injection")),
    "markup": _rules(("'DAST-XSS-REFLECTED'", "'HIGH'", "round(least(0.95, 0.4 + CASE WHEN n >= 2 THEN 0.2 ELSE 0 END + CASE WHEN n >= 3 THEN 0.1 ELSE 0 END + CASE WHEN runs THEN 0.2 ELSE 0 END + CASE WHEN kinds >= 2 THEN 0.1 ELSE 0 END + CASE WHEN html THEN 0.1 ELSE 0 END - CASE WHEN errors THEN 0.2 ELSE 0 END), 4)", "true"), source="z", extra=_CTX + _SUM.format(g="", p="markup")),
    "template": _rules(("'DAST-SSTI'", "CASE WHEN regexp_matches(body, '49\\b') THEN 'CRITICAL' ELSE 'MEDIUM' END", 0.6, "probe = 'template' AND (regexp_matches(body, '49\\b') OR contains(body, '{#'))")),
    "exposed_paths": _rules((
        "'DAST-EXPOSED-' || trim(translate(upper(detail), '/.', '__'), '_')",
        f"CASE WHEN detail IN ('/.git/config', '/.env', '/backup') OR (detail = '/actuator' AND contains(body, '_links')) THEN 'CRITICAL' WHEN {_in(K.HIGH_PATHS)} THEN 'HIGH' WHEN {_in(K.MEDIUM_PATHS)} THEN 'MEDIUM' ELSE 'LOW' END",
        "CASE WHEN (detail = '/.git/config' AND contains(body, '[core]')) OR (detail = '/.env' AND regexp_matches(body, '(?i)(API_KEY|SECRET|PASSWORD)')) OR (detail = '/phpinfo.php' AND contains(body, 'PHP License')) THEN 1.0 WHEN detail IN ('/.git/config', '/.env', '/backup') THEN 0.9 WHEN detail = '/actuator' AND contains(body, '_links') THEN 0.95 ELSE 0.7 END",
        "probe = 'path' AND status_code < 400", "detail")),
    "verbose_errors": _rules(("'DAST-VERBOSE-ERROR-' || CASE detail " + " ".join(f"WHEN '{p}' THEN '{n}'" for p, n in K.VERBOSE_PROBES) + " END", "CASE WHEN status_code >= 500 THEN 'HIGH' ELSE 'MEDIUM' END", 0.85, f"probe = 'verbose' AND {_any('body', K.ERROR_BODY)}", "detail")),
    "listings": _rules(("'DAST-DIRECTORY-LISTING'", "'MEDIUM'", 0.95, f"probe = 'listing' AND status_code = 200 AND {_any('body', K.LISTING_BODY)}", "detail")),
    "plain_login": _rules(("'DAST-LOGIN-OVER-HTTP'", "'CRITICAL'", 0.95, f"probe = 'login' AND status_code < 400 AND NOT starts_with(target, 'https://') AND {_any('body', K.LOGIN_BODY)}", "'/login'")),
    "user_enumeration": _rules(("'DAST-USER-ENUMERATION'", "'MEDIUM'", 0.5, "n >= 2 AND (codes > 1 OR sizes > 1)", "'/login'"), source="g", extra=", g AS (SELECT target, count(*) AS n, count(DISTINCT status_code) AS codes, count(DISTINCT length(body)) AS sizes FROM a WHERE probe = 'user' GROUP BY target)"),
    "direct_references": _rules(("'DAST-IDOR-POTENTIAL'", "'HIGH'", 0.5, f"probe = 'idor' AND status_code = 200 AND {_any('body', K.PERSONAL_BODY)}", "detail")),
    "open_redirect": _rules(("'DAST-OPEN-REDIRECT'", "'MEDIUM'", 0.7, f"probe = 'redirect' AND status_code IN (301, 302, 303, 307, 308) AND contains({_h('location')}, 'evil.com')")),
    "regex_load": _rules(("'DAST-REDOS'", "'MEDIUM'", 0.4, f"probe = 'regex' AND {_any('body', K.REDOS_BODY)}"), ("'DAST-REDOS-TIMING'", "'HIGH'", 0.5, "probe = 'regex' AND elapsed_ms > 5000")),
    "parsers": _rules(
        ("'DAST-XXE-POTENTIAL'", "'MEDIUM'", 0.3, f"probe = 'root' AND contains(lower({_h('content-type')}), 'xml')"), ("'DAST-INSECURE-DESERIALIZATION'", "'MEDIUM'", 0.35, f"probe = 'root' AND {_any('body', K.SERIAL_BODY)}"),
        ("'DAST-INSECURE-DESERIALIZATION'", "'MEDIUM'", 0.35, f"probe = 'root' AND regexp_matches({_h('content-type')}, '(?i)application/(x-java-serialized-object|php-serialized)')"),
        ("'DAST-XXE-ENDPOINT'", "'HIGH'", 0.5, "probe = 'xml' AND status_code < 500 AND seq = (SELECT min(b.seq) FROM a b WHERE b.target = a.target AND b.probe = 'xml' AND b.status_code < 500)", "detail"),
    ),
    "graphql": _rules(("'DAST-GRAPHQL-INTROSPECTION'", "'MEDIUM'", 0.95, "true", "path"), source="g", extra=", g AS (SELECT target, arg_min(detail, seq) AS path FROM a WHERE probe = 'graphql' AND status_code = 200 AND contains(body, '__schema') GROUP BY target)"),
    "rate_limit": _rules(("'DAST-NO-RATE-LIMITING'", "'LOW'", 0.4, "ok AND n >= 5"), source="g", extra=", g AS (SELECT target, bool_and(status_code = 200) AS ok, count(*) AS n FROM r WHERE probe = 'burst' GROUP BY target)"),
    "metadata": _rules(("'DAST-' || upper(detail) || '-METADATA-ACCESSIBLE'", "'CRITICAL'", 0.9, "probe = 'metadata' AND status_code < 500")),
    "fetchers": _rules(("'DAST-SSRF-INDICATOR'", "'MEDIUM'", 0.3, f"probe = 'root' AND {_any('lower(body)', K.FETCH_BODY)}"), ("'DAST-SSRF-CLOUD-METADATA'", "'CRITICAL'", 0.95, "probe = 'fetch' AND status_code < 500 AND regexp_matches(body, 'ami-id|instance-id|security-credentials')")),
    "content_policy": _rules(("'DAST-CSP-INSECURE'", "'MEDIUM'", 0.9, f"probe = 'root' AND (contains({_CSP}, '''unsafe-inline''') OR contains({_CSP}, '''unsafe-eval''') OR regexp_matches({_CSP}, '(?:script-src|default-src)\\s+[^;]*\\*') OR contains({_CSP}, 'data:'))")),
    "methods": _rules(("'DAST-HTTP-METHODS'", "'MEDIUM'", 0.8, f"probe = 'options' AND regexp_matches({_ALLOW}, 'TRACE|PUT|DELETE|PATCH')")),
    "frameworks": _rules(("'DAST-FRAMEWORK-FINGERPRINT'", "'LOW'", 0.7, f"probe = 'root' AND (regexp_matches(lower({_SET}), 'csrftoken|_session_id|connect.sid|laravel_session') OR regexp_matches({_SET}, 'JSESSIONID|ASPSESSIONID') OR regexp_matches(lower({_h('x-powered-by')}), 'django|express|laravel|spring|asp\\.net') OR contains(lower({_h('server')}), 'rails') OR (contains(lower({_SET}), 'session') AND contains(lower({_h('server')}), 'python')))")),
    "integrity": _rules(("'DAST-SRI-MISSING'", "'LOW'", 0.85, f"probe = 'root' AND {_SCRIPTS}")),
    "websockets": _rules(("'DAST-WEBSOCKET'", "'LOW'", 0.7, "probe = 'root' AND regexp_matches(lower(body), '(?:ws|wss)://|new\\s+websocket\\s*\\(')")),
    "sniffing": _rules(("'DAST-NO-NOSNIFF'", "'LOW'", 0.9, f"probe = 'root' AND lower({_h('x-content-type-options')}) <> 'nosniff'")),
    "jwt": _rules(
        ("'DAST-JWT-ALG-NONE'", "'CRITICAL'", 1, "alg IN ('none', 'None', 'NONE')"), ("'DAST-JWT-SYMMETRIC-ALG'", "'MEDIUM'", 0.6, "alg IN ('HS256', 'HS384', 'HS512')"), ("'DAST-JWT-ALG-CONFUSION'", "'LOW'", 0.3, "starts_with(alg, 'RS')"),
        ("'DAST-JWT-NO-EXPIRY'", "'HIGH'", 0.9, "exp IS NULL"), ("'DAST-JWT-LONG-LIVED'", "'MEDIUM'", 0.7, f"exp - {X.AS_OF} > 86400"), ("'DAST-JWT-MISSING-CLAIMS'", "'LOW'", 0.5, "iss IS NULL OR aud IS NULL"), source="jw", extra=_JWT,
    ),
}


def _response_query(name: str):
    def run(spark, sf_dir):
        rows = _CAPTURE.frame(spark, sf_dir)
        found = responses.jwt(rows, X.AS_OF) if name == "jwt" else responses.CHECKS[name](rows)
        return found.drop("evidence")

    return run


for _name in (*responses.CHECKS, "jwt"):
    query(RESPONSE_SQL[_name], f"response_{_name}")(_response_query(_name))


@query()
def response_report(spark, sf_dir):
    """All checks over one capture, deduplicated."""
    found = responses.response_findings(_CAPTURE.frame(spark, sf_dir), X.AS_OF)
    return findings.first_only(findings.conform(found)).select("file_path", "endpoint", "rule_id", "issue_type", "severity", "confidence", "cwe_id", "owasp_category", "sev_rank", "ord")


@query()
def sarif_json(spark, sf_dir):
    from sparkwarden.plans import sinks

    return sinks.sarif_results(findings.first_only(_findings(spark, sf_dir)))


@query()
def finding_json(spark, sf_dir):
    from sparkwarden.plans import sinks

    return sinks.finding_json(findings.first_only(_findings(spark, sf_dir)))


# --- the driver's other tables ---------------------------------------------------------------------------------------------------------


@query("SELECT quality, toxic, count(*) AS docs, sum(n_chars) AS chars FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def label_profile(spark, sf_dir):
    joined = _table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(_table(spark, sf_dir, "labels"), "doc_id")
    return joined.groupBy("quality", "toxic").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))


@query(f"WITH l AS (SELECT conv_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS line_no, turn, role, unnest(string_split(text, chr(10))) AS line FROM conversations) "
       "SELECT role, count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS chars, count(*) FILTER (regexp_matches(line, '[.?!]$')) AS closed FROM l WHERE regexp_matches(line, '[A-Za-z]') GROUP BY role")  # fmt: skip
def conversation_lines(spark, sf_dir):
    """Lines of conversations by role: how many, how long, and how many end in a sentence mark."""
    lines = T.lines(_table(spark, sf_dir, "conversations"), "conv_id", "text", "role").where(F.col("line").rlike("[A-Za-z]"))
    return lines.groupBy("role").agg(F.count("*").alias("n"), F.sum(F.char_length("line")).alias("chars"), F.count_if(F.col("line").rlike("[.?!]$")).alias("closed"))


from sparkwarden.plans import tables  # noqa: E402, F401  (adds its queries)

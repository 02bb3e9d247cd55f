import json
import re

import pytest

from sparkwarden.functions import catalog, text
from sparkwarden.operators import advisories, code_rules, findings, manifests, responses, syntax_tree
from sparkwarden.plans import api, cli, fixtures, sinks
from sparkwarden.sources import files, patterns
from sparkwarden.streaming import monitor


def lines_of(spark, *rows):
    return spark.createDataFrame([("f.py", k + 1, t) for k, t in enumerate(rows)], "file_path string, line_no int, line string")


def rules(spark, line):
    return {r.rule_id for r in code_rules.code_findings(lines_of(spark, line)).collect()}


def test_catalog_shape():
    ids = [r[0] for r in catalog.CODE_RULES]
    assert len(ids) == len(set(ids)) == 61
    count = lambda s: sum(r[2] == s for r in catalog.CODE_RULES)
    assert (count("HIGH"), count("MEDIUM"), count("LOW"), count("CRITICAL")) == (34, 17, 7, 3)
    assert len({r[0] for r in catalog.SECRET_RULES}) == len(catalog.SECRET_RULES) == 31
    assert len(catalog.SENSITIVE_PATHS) == 46 and len(catalog.MARKUP_PROBES) == 15 and sum(len(v[2]) for v in catalog.INJECTIONS.values()) == 30


@pytest.mark.parametrize("rule", catalog.CODE_RULES, ids=lambda r: r[0])
def test_guards_are_implied_by_their_patterns(rule):
    """No fixture line that a pattern matches may lack all of its rule's literals."""
    rule_id, _, _, _, literals, pattern = rule
    hit = False
    for _, line in fixtures.CODE:
        if re.search(pattern, line):
            hit = True
            low = pattern.startswith("(?i)")
            assert any((x.lower() in line.lower()) if low else (x in line) for x in literals), line
    assert hit, f"no fixture line for {rule_id}"


@pytest.mark.parametrize(
    ("line", "expected", "absent"),
    [
        ("result = eval(user_input)", {"SAF-EVAL", "SAF-JS-EVAL", "SAF-RUBY-EVAL"}, set()), ("evaluate(data)", set(), {"SAF-EVAL"}), ("execution()", set(), {"SAF-EXEC"}), ("# eval(x)", set(), {"SAF-EVAL"}),
        ('pattern = re.compile(r"test")', set(), {"SAF-COMPILE"}), ("from os import system; system(x)", set(), {"SAF-PHP-EXEC"}), ("def test_a(): assert x", set(), {"SAF-ASSERT"}),
        ("cipher = DES(key)", {"SAF-WEAK-CIPHER"}, set()), ("yaml.load(f, Loader=SafeLoader)", set(), {"SAF-YAML-LOAD"}), ("yaml.load(f, Loader=yaml.SafeLoader)", {"SAF-YAML-LOAD"}, set()),
        ("ip = '210.1.2.3'", {"SAF-HARDCODED-IP"}, set()), ("insecure_eval(x)", set(), {"SAF-EVAL"}), ("x = 1", set(), {r[0] for r in catalog.CODE_RULES}), ("éeval(x)", set(), {"SAF-EVAL"}),
    ],
)
def test_single_lines(spark, line, expected, absent):
    got = rules(spark, line)
    assert expected <= got and not absent & got


def test_rules_agree_with_python(spark):
    """The guarded Java patterns against Python's re, on every fixture line."""
    got = {(r.line_no, r.rule_id) for r in code_rules.code_findings(lines_of(spark, *[t for _, t in fixtures.CODE])).collect()}
    want = set()
    for k, (_, line) in enumerate(fixtures.CODE):
        s, low = line.strip(), line.lower()
        if s.startswith(("#", "//", "/*")) or '"""' in s or "'''" in s or ("import " in low and "from " in low):
            continue
        for rule_id, *_, pattern in catalog.CODE_RULES:
            own = ("SAF-" in line and rule_id in line) or (rule_id == "SAF-COMPILE" and "re.compile" in line) or (rule_id == "SAF-ASSERT" and ("def test_" in low or "class test" in low))
            if re.search(pattern, line) and not own:
                want.add((k + 1, rule_id))
    assert got == want


def test_lines_split_as_python_does(spark):
    texts = ["a\nb\r\nc\rd", "x\n", "", "\n", "a\x0bb\x0cc\x1cd\x85e f", None, "no end"]
    rows = text.lines(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "k", "t").collect()
    for k, t in enumerate(texts):
        assert [r.line for r in sorted(rows, key=lambda r: r.line_no) if r.k == k] == (t or "").splitlines()


def test_secrets_and_entropy(spark):
    got = {r.rule_id for r in code_rules.secret_findings(lines_of(spark, *[t for _, t in fixtures.SECRET_LINES])).collect()}
    assert {"SEC-aws-access-key", "SEC-github-token", "SEC-private-key", "SEC-connection-string", "SEC-slack-webhook-url", "SEC-npm-token", "SEC-gitlab-token"} <= got
    assert code_rules.secret_findings(lines_of(spark, "x = 1", "", "password = 'short'")).count() == 0
    bits = code_rules.entropy_findings(lines_of(spark, 'api_key = "0123456789abcdef0123"', 'api_key = "aaaaaaaaaaaaaaaaaaaa"', 'name = "0123456789abcdef0123"')).collect()
    assert [(r.line_no, r.severity) for r in bits] == [(1, "LOW")]


def test_first_finding_wins_whatever_the_partitioning(spark):
    df = findings.conform(fixtures.frame(spark, fixtures.FINDINGS, fixtures.FINDING_COLUMNS))
    for parts in (1, 5):
        once = findings.first_only(df.repartition(parts)).collect()
        assert len(once) == 6 and {(r.rule_id, r.endpoint): r.severity for r in once}[("SEC-x", "")] == "HIGH"
    assert findings.severity_counts(df.limit(0)).select(findings.verdict(findings.F.col("max_rank"), "LOW").alias("v")).first().v == "PASS"
    assert all(v is not None for v in findings.conform(spark.createDataFrame([("a", None, None)], "file_path string, severity string, message string")).first())


def test_syntax_tree():
    source = "import requests\ndef outer():\n    def inner():\n        password = 'longenough'\n    try:\n        requests.get(u, verify=False)\n    except:\n        pass\n"
    got = [(line, rule, inside) for line, rule, _, inside in syntax_tree.scan_source(source)]
    assert got == [(4, "SAF-HARDCODED-CRED", "inner"), (6, "SAF-INSECURE-SSL", "outer"), (6, "SAF-REQUEST-TIMEOUT", "outer"), (7, "SAF-BARE-EXCEPT", "outer")]
    assert syntax_tree.scan_source("def (") == [] and syntax_tree.scan_source(None) == [] and syntax_tree.scan_source("x\x00") == []


def test_versions(spark):
    key = pytest.importorskip("packaging.version")
    order = ["1.0.dev1", "1.0a1", "1.0a2.dev1", "1.0b1", "1.0rc1", "1.0", "1.0.post1", "1.0.1", "1.1", "1!0.1"]
    rows = spark.createDataFrame([(v,) for v in order], "v string").select("v", advisories.version_key(findings.F.col("v")).alias("k")).collect()
    assert [r.v for r in sorted(rows, key=lambda r: r.k)] == sorted(order, key=key.Version)
    from packaging.specifiers import SpecifierSet

    versions = ["1.0", "1.0.0", "1.0.1", "2.0", "1.5", "1.0.post1", "0.9", "1.10", "1.0a1", "1.0rc2", "1.0.dev3", "1!0.5", "1.0.0.0.0.0.0.0.0.1", "1.0.0.0.0.0.0.0.0.2"]
    specs = ["<1.0", "<=1.0", ">1.0", ">=1.0.1", "==1.0", "!=1.0", "~=1.0", "==1.*", ">=0.9,<1.5", "==1.0.*", ">1.0.0.0.0.0.0.0.0.1", "~=1.0.0", "<1.0a2", ">=1!0", "==1!0.*", "!=1.0.*"]
    cases = [(v, s) for v in versions for s in specs]
    got = spark.createDataFrame(cases, "v string, s string").select("v", "s", advisories.affected(findings.F.col("v"), findings.F.array("s")).alias("hit")).collect()
    assert {(r.v, r.s): r.hit for r in got} == {(v, s): SpecifierSet(s).contains(v, prereleases=True) for v, s in cases}


def test_manifest_attribution(spark):
    df = spark.createDataFrame([("requirements.txt", "flask==2.0.0\n"), ("package.json", '{"dependencies":{"redis":"4.0.0"}}'), ("sub/go.mod", "require a v1")], "file_path string, content string")
    packages = manifests.packages(df)
    assert {(r.manifest, r.ecosystem, r.name) for r in packages.collect()} == {("requirements.txt", "PyPI", "flask"), ("package.json", "npm", "redis")}
    offline = advisories.offline_advisories(spark)
    assert {r.name for r in advisories.advisory_findings(packages, offline).collect()} == {"flask"}
    assert {r.name for r in advisories.advisory_findings(packages, offline, None).collect()} == {"flask", "redis"}


@pytest.mark.parametrize(
    ("pattern", "hits", "misses"),
    [("*.md", ["a.md", "x/b.md"], ["a.mdx"]), ("/root.txt", ["root.txt"], ["x/root.txt"]), ("build/", ["build/a", "x/build/b"], ["build"]), ("a/**/b", ["a/b", "a/x/y/b"], ["b"]), ("test_*", ["test_a.py", "x/test_b/c"], ["atest_"]), ("f[0-9].py", ["f1.py"], ["fa.py"])],
)
def test_ignore_patterns(pattern, hits, misses):
    regex, exclude = patterns.to_regex(pattern)
    assert exclude and all(re.search(regex, h) for h in hits) and not any(re.search(regex, m) for m in misses)
    assert patterns.to_regex("# x") is None and patterns.to_regex("") is None and patterns.to_regex("!a")[1] is False


@pytest.fixture
def tree(tmp_path):
    for name, content in {
        "app.py": "result = eval(user_input)\npassword = 'longenough'\n", "notes.md": "# hi", "requirements.txt": "flask==2.0.0\n", ".gitignore": "*.md\n", ".env": "TOKEN=1", "empty": "", "Makefile": "all:\n",
        "logo.png": "x", "blob": "a\0b", "pkg/__init__.py": "exec(x)", ".venv/x.py": "eval(x)", "node_modules/x.js": "eval(x)", "sub/t test+1.js": "document.write(x)", "sub/empty.py": "",
    }.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(content)
    return str(tmp_path)


def test_discovery(spark, tree):
    names = lambda **o: {r.file_path for r in files.discover(spark, tree, **o).collect()}
    every = {"app.py", "notes.md", "requirements.txt", ".gitignore", ".env", "Makefile", "sub/t test+1.js", "sub/empty.py", "pkg/__init__.py"}
    assert names() == every and names(include_ignored=False) == every - {"notes.md"}
    assert names(exclude=["sub/"]) == every - {"sub/t test+1.js", "sub/empty.py"} and names(include=["*.py"]) == {"app.py", "sub/empty.py", "pkg/__init__.py"}
    assert {"logo.png", "blob", "empty", "node_modules/x.js", ".venv/x.py"} <= names(scan_all=True)
    found = files.discover(spark, tree)
    assert ".env" not in {r.file_path for r in files.scannable(found).collect()} and ".env" in {r.file_path for r in files.scannable(found, dotenv=True).collect()}
    assert {r.ext: r.n for r in files.extension_counts(found).collect()}["(no ext)"] == 3


def test_repository_scan_and_reports(spark, tree, capsys, tmp_path):
    summary, rows = api.scan_repository(spark, tree)
    ids = {(r.file_path, r.rule_id) for r in rows.collect()}
    assert {("app.py", "SAF-EVAL"), ("app.py", "SAF-HARDCODED-CRED"), ("sub/t test+1.js", "SAF-DOCUMENT-WRITE"), ("requirements.txt", "DEP-CVE_2023_25577")} <= ids
    assert summary["verdict"] == "BLOCK" and summary["total_findings"] == len(ids) == rows.count()
    log = sinks.sarif(rows)["runs"][0]
    assert log["results"] and log["invocations"] and all(r["locations"][0]["physicalLocation"]["region"]["startLine"] >= 1 for r in log["results"])
    assert {r["id"] for r in log["tool"]["driver"]["rules"]} == {r for _, r in ids}
    assert "invocations" not in sinks.sarif(rows.limit(0))["runs"][0]
    report = json.loads(sinks.json_report(summary, rows))
    assert len(report["findings"]) == len(ids) and all("endpoint" not in f for f in report["findings"])
    assert "Verdict: BLOCK" in sinks.text_report(summary, rows)
    out = tmp_path / "r.sarif"
    assert cli.main(["scan", tree, "--format", "sarif", "--compact", "--output", str(out)]) == 2 and json.loads(out.read_text())["version"] == "2.1.0"
    assert cli.main(["scan", str(tmp_path / "missing")]) == cli.USAGE_ERROR


def test_response_scan(spark, tmp_path, capsys):
    captured = fixtures.frame(spark, fixtures.RESPONSES, fixtures.RESPONSE_COLUMNS)
    summary, rows = api.scan_responses(spark, captured, fixtures.AS_OF)
    got = {(r.endpoint, r.rule_id) for r in rows.collect()}
    assert ("https://down.example", "DAST-CONNECTION-ERROR") in got and summary["verdict"] == "BLOCK"
    assert not any(e == "https://down.example" and r != "DAST-CONNECTION-ERROR" for e, r in got)
    captured.write.parquet(f"{tmp_path}/c.parquet")
    assert cli.main(["responses", f"{tmp_path}/c.parquet", "--as-of", str(fixtures.AS_OF), "--format", "json", "--skip", "cors"]) == 2
    found = json.loads(capsys.readouterr().out)["findings"]
    assert found and not any(f["rule_id"].startswith("DAST-CORS") for f in found)
    assert responses.exposed_paths(captured, budget=1).count() == 0


def test_options():
    assert findings.parse_threshold(" high ") == "HIGH" and patterns.parse_list(" a, ,b ") == ["a", "b"] and patterns.parse_list(None) == []
    with pytest.raises(ValueError, match="no such severity"):
        findings.parse_threshold("urgent")
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["scan", ".", "--threshold", "urgent"])


def test_streams(spark, tmp_path):
    from pyspark.sql import functions as F

    src = str(tmp_path / "events")
    rows = spark.range(12).select((F.col("id") % 2).alias("user_id"), F.timestamp_seconds(F.lit(1000) + F.col("id") / 2).alias("ts"))
    rows.coalesce(1).write.parquet(src)
    batch = {tuple(r) for r in monitor.bursts(spark.read.parquet(src), 3).collect()}
    stream = monitor.bursts(spark.readStream.schema(rows.schema).parquet(src), 3)
    q = stream.writeStream.outputMode("complete").format("memory").queryName("bursts").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("bursts").collect()} == batch and batch
    seen = rows.select(F.lit("f").alias("file_path"), F.lit(1).alias("line_number"), F.lit("r").alias("rule_id"), F.lit("").alias("endpoint"), "ts")
    seen.coalesce(1).write.parquet(f"{src}2")
    q = monitor.first_findings(spark.readStream.schema(seen.schema).parquet(f"{src}2")).writeStream.outputMode("append").format("memory").queryName("firsts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("firsts").count() == 1


def test_two_targets_keep_their_findings(spark):
    """The same path exposed on two targets is two findings, told apart by the address that they name."""
    columns = fixtures.RESPONSE_COLUMNS
    rows = [(t, probe, detail, 0, 200, [], "API_KEY=1", 1.0, "TLS 1.3", 1) for t in ("https://a.example", "https://b.example") for probe, detail in (("root", ""), ("path", "/.env"))]
    summary, found = api.scan_responses(spark, spark.createDataFrame(rows, columns), 0)
    exposed = {(r.file_path, r.endpoint, r.issue_type, r.cwe_id, r.severity) for r in found.collect() if r.rule_id == "DAST-EXPOSED-ENV"}
    assert exposed == {(f"https://{t}.example/.env", "/.env", "dast_exposed_endpoint", "CWE-200", "CRITICAL") for t in "ab"}
    assert summary["by_type"]["dast_exposed_endpoint"] == 2
    assert all(r.message and r.remediation_hint for r in found.collect())


@pytest.mark.parametrize(
    ("context", "payload", "runs"),
    [
        ("it's <a title='", "'", True), ("it's <a title=' x", "'", True), ("it's plain", "'", False), ("a' > b", "'", True), ("<b>x</b> ' y", "'", False), ("see \\E here <i \\E", "\\E", True),
        ("{{7*7}} and", "{{7*7}}", False), ("<p>{{7*7}}</p>", "{{7*7}}", True), ("a.b <x a+b", "a.b", False), ("on it", "it", False), ("onx = it", "it", True),
    ],
)
def test_every_place_of_a_payload_counts(spark, context, payload, runs):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(context, payload)], "c string, p string").select(responses.executable(F.col("c"), F.col("p")).alias("runs")).first()
    want = bool("<script" in context.lower() or re.search(r"on\w+\s*=", context.lower()) or re.search(r"<[a-zA-Z][^>]*" + re.escape(payload[:20]), context) or re.search(re.escape(payload[:20]) + r"[^>]*>", context))
    assert row.runs == want == runs


SAMPLE = {
    "app.py": "import os\n\n\ndef run(user_input):\n    eval(user_input)\n    os.system('ls ' + user_input)\n    # eval(ignored)\n    return hashlib.md5(user_input)\n",
    "config.py": "password = 'long enough to count'\nDEBUG = False\n",
    "requirements.txt": "# pinned\ndjango==3.0.0\nflask==2.0.0\nclick==8.1.0\n",
}


@pytest.fixture(scope="module")
def sample(tmp_path_factory):
    root = tmp_path_factory.mktemp("sample")
    for name, content in SAMPLE.items():
        (root / name).write_text(content)
    return str(root)


def test_whole_scan_of_a_sample(spark, sample, tmp_path):
    """Exact findings, counts, times and reports of a small repository."""
    summary, rows = api.scan_repository(spark, sample)
    got = {(r.file_path, r.line_number, r.rule_id, r.issue_type) for r in rows.collect()}
    code = {("app.py", 5, r, "static_analysis") for r in ("SAF-EVAL", "SAF-JS-EVAL", "SAF-RUBY-EVAL")} | {("app.py", 6, r, "static_analysis") for r in ("SAF-OS-SYSTEM", "SAF-PHP-EXEC", "SAF-RUBY-SYSTEM")}
    code |= {("app.py", 8, "SAF-MD5", "static_analysis"), ("config.py", 1, "SAF-HARDCODED-CRED", "static_analysis")}
    deps = {("requirements.txt", 2, "DEP-CVE_2023_23969", "dependency"), ("requirements.txt", 3, "DEP-CVE_2023_25577", "dependency")}
    assert got - {g for g in got if g[3] == "secret"} == code | deps and ("config.py", 1, "SEC-password-in-code", "secret") in got
    assert summary["verdict"] == "BLOCK" and summary["scanned_files"] == 3 and summary["files_by_extension"] == {".py": 2, ".txt": 1}
    assert set(summary["scanner_times_ms"]) == {"discovery", "secrets", "static_analysis", "syntax_trees", "dependencies"} and all(v >= 0 for v in summary["scanner_times_ms"].values())
    assert sum(summary["scanner_times_ms"].values()) <= summary["scan_time_ms"]
    assert all(r.message and r.remediation_hint for r in rows.collect())
    order = [(r.issue_type, r.file_path, r.line_number) for r in rows.orderBy("ord").collect() if r.issue_type == "static_analysis" and r.detection_method == "regex"]
    assert order == sorted(order)
    report = sinks.text_report(summary, rows, colour=True, stats=True)
    assert "\033[91mHIGH" in report and "\033[97;41m BLOCK" in report and "syntax_trees" in report and "\033" not in sinks.text_report(summary, rows)
    own = tmp_path / "advisories.json"
    own.write_text(json.dumps({"vulnerabilities": [{"package": "Click", "versions": ["<9"], "severity": "low", "cve": "CVE-1999-1", "description": "x"}]}))
    _, other = api.scan_repository(spark, sample, advisory_file=str(own))
    assert {r.rule_id for r in other.collect() if r.issue_type == "dependency"} == {"DEP-CVE_1999_1"}


def test_sarif_structure(spark, sample):
    _, rows = api.scan_repository(spark, sample)
    log = sinks.sarif(rows)
    assert sinks.sarif_errors(log) == [] and sinks.sarif_errors(sinks.sarif(rows.limit(0))) == []
    names = {r["id"]: r["name"] for r in log["runs"][0]["tool"]["driver"]["rules"]}
    assert names["SAF-OS-SYSTEM"] == "Os System" and len(names) == len({r.rule_id for r in rows.collect()})
    for spoil, said in (
        (lambda x: x.pop("version"), "version"), (lambda x: x.update(version="2.0.0"), "2.0.0"), (lambda x: x["runs"][0]["tool"].pop("driver"), ""), (lambda x: x["runs"][0]["results"][0].update(level="bad"), "level"),
        (lambda x: x["runs"][0]["results"][0].update(ruleId="X-1"), "ruleId"), (lambda x: x["runs"][0]["results"][0].pop("message"), "message"), (lambda x: x["runs"][0].update(results=[3]), "not an object"),
        (lambda x: x["runs"][0]["results"][0]["locations"][0]["physicalLocation"]["region"].update(startLine=0), "startLine"),
        (lambda x: x["runs"][0]["tool"]["driver"]["rules"].append(x["runs"][0]["tool"]["driver"]["rules"][0]), "twice"),
    ):
        broken = json.loads(json.dumps(log))
        spoil(broken)
        errors = sinks.sarif_errors(broken)
        assert errors and any(said in e for e in errors)
    assert sinks.sarif_errors([]) or sinks.sarif_errors({})


def test_manifests_are_read_in_one_pass(spark, tmp_path):
    rows = [(m, c) for kind in fixtures.MANIFESTS.values() for m, c in kind]
    spark.createDataFrame(rows, "file_path string, content string").write.parquet(str(tmp_path / "m"))
    plan = manifests.packages(spark.read.parquet(str(tmp_path / "m")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan


def test_file_counts_read_no_contents(spark, sample):
    assert files.count_files(spark, sample) == 3
    plan = files.names(spark, sample)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan

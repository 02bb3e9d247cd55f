"""Options of the scan: an OSV dump, rules that are turned off, .env files, findings in bulk."""

import json
import os

import pytest

from sparkwarden.operators import advisories
from sparkwarden.plans import api, cli


def record(i, name, events=None, versions=(), ecosystem="PyPI", kind="ECOSYSTEM", **more):
    ranges = [{"type": kind, "events": events}] if events else []
    return {"id": i, "aliases": [f"CVE-2024-{i}"], "affected": [{"package": {"ecosystem": ecosystem, "name": name}, "ranges": ranges, "versions": list(versions)}], **more}


RECORDS = [
    record("1", "Flask", [{"introduced": "0"}, {"fixed": "2.3"}], database_specific={"severity": "HIGH"}),
    record("2", "flask", [{"introduced": "1.0"}, {"fixed": "1.5"}, {"introduced": "2.0"}, {"last_affected": "2.0.1"}]),
    record("3", "flask", [{"introduced": "2.1"}]), record("4", "flask", versions=["2.0", "9"]), record("5", "flask", [{"introduced": "0"}], ecosystem="npm"),
    record("6", "flask", [{"introduced": "0"}], kind="GIT"), record("7", "express", [{"introduced": "4.0.0"}, {"fixed": "4.19.0"}], ecosystem="npm"), {"id": "8"}, record("9", "other", [{"introduced": "0"}]),
]


@pytest.fixture(scope="module")
def place(tmp_path_factory):
    top = tmp_path_factory.mktemp("scan")
    tree, dump = top / "tree", top / "dump"
    tree.mkdir()
    dump.mkdir()
    (tree / "requirements.txt").write_text("flask==2.0.0\nunknown==1.0\n")
    (tree / "package.json").write_text(json.dumps({"dependencies": {"Express": "^4.18.0"}}))
    (tree / "a.py").write_text("x = eval(y)\nos.system(z)\n")
    (tree / ".env").write_text("password = \"hunter2hunter2\"\n")
    for k, r in enumerate(RECORDS):
        (dump / f"{k}.json").write_text(json.dumps(r, indent=1))
    (top / "dump.jsonl").write_text("".join(json.dumps(r) + "\n" for r in RECORDS))
    return top


def test_an_osv_dump_is_looked_up(spark, place):
    for dump in ("dump", "dump.jsonl"):
        _, rows = api.scan_repository(spark, str(place / "tree"), osv=str(place / dump))
        found = {(r.file_path, r.rule_id, r.severity, r.remediation_hint) for r in rows.where("detection_method = 'dependency'").collect()}
        assert found == {
            ("requirements.txt", "DEP-CVE_2024_1", "HIGH", "Update flask to 2.3"), ("requirements.txt", "DEP-CVE_2024_2", "MEDIUM", "Update flask to 1.5"), ("requirements.txt", "DEP-CVE_2024_4", "MEDIUM", "Update flask"),
            ("package.json", "DEP-CVE_2024_7", "MEDIUM", "Update express to 4.19.0"),
        }, dump


def test_hits_of_a_dump_are_those_of_its_ranges_one_by_one(spark, place):
    versions = ["0.1", "1.0", "1.0a1", "1.4.9", "1.5", "2.0", "2.0.1", "2.0.2", "2.1", "2.3", "2.4", "9", "9.0", "junk"]
    packages = spark.createDataFrame([("PyPI", "flask", f"=={v}") for v in versions] + [("npm", "Flask", "==1"), ("npm", "express", "~4.18.2"), (None, "flask", "==1")], "ecosystem string, name string, version_spec string")
    got = {(r.ecosystem, r.name, r.version, r.id) for r in advisories.osv_hits(packages, advisories.read_osv(spark, str(place / "dump.jsonl"))).collect()}
    below = [v for v in versions if v in ("0.1", "1.0", "1.0a1", "1.4.9", "1.5", "2.0", "2.0.1", "2.0.2", "2.1")]
    want = {("PyPI", "flask", v, "1") for v in below} | {("PyPI", "flask", v, "2") for v in ("1.0", "1.4.9", "2.0", "2.0.1")} | {("PyPI", "flask", v, "3") for v in ("2.1", "2.3", "2.4", "9", "9.0")}
    want |= {("PyPI", "flask", v, "4") for v in ("2.0", "9", "9.0")} | {("npm", "Flask", "1", "5"), ("npm", "express", "4.18.2", "7")}
    assert got == want


def test_rules_are_turned_off_and_env_files_scanned(spark, place):
    _, plain = api.scan_repository(spark, str(place / "tree"))
    ids = {r.rule_id for r in plain.collect()}
    assert {"SAF-EVAL", "SAF-OS-SYSTEM"} <= ids and not any(r.file_path == ".env" for r in plain.collect())
    summary, fewer = api.scan_repository(spark, str(place / "tree"), disabled=["SAF-EVAL", "NO-SUCH-RULE"], dotenv=True)
    assert {r.rule_id for r in fewer.where("file_path <> '.env'").collect()} == ids - {"SAF-EVAL"} and fewer.where("file_path = '.env'").count() > 0
    assert summary["scanned_files"] >= 3


def test_the_command_line_writes_findings_in_bulk(spark, place, tmp_path, capsys):
    code = cli.main(["scan", str(place / "tree"), "--osv", str(place / "dump"), "--disable", "SAF-EVAL,SAF-OS-SYSTEM", "--dotenv", "--findings", f"file://{tmp_path}/bulk", "--format", "json", "--output", str(tmp_path / "r.json")])
    report = json.loads((tmp_path / "r.json").read_text())
    rows = [json.loads(x) for f in os.listdir(tmp_path / "bulk") if f.endswith(".json") for x in open(tmp_path / "bulk" / f)]
    assert code in (1, 2) and len(rows) == report["total_findings"] if "total_findings" in report else len(rows) > 3
    assert {"DEP-CVE_2024_1"} <= {r["rule_id"] for r in rows} and not {"SAF-EVAL", "SAF-OS-SYSTEM"} & {r["rule_id"] for r in rows}

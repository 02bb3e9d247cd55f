import re
from collections import defaultdict

import pytest

import corpus_pipeline as C
from sparkwarden.llm import decontamination, mixing, pii, quality, simhash
from tests.llm.test_decontamination import brute_cover
from tests.llm.test_simhash import components, plain_fingerprint


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark, docs):
    import random

    root = tmp_path_factory.mktemp("sf")
    docs.write.parquet(f"{root}/documents.parquet")
    rng = random.Random(3)
    labels = [(r.doc_id, 0 if r.doc_id % 5 == 0 else 1, 0) for r in docs.select("doc_id").where("doc_id is not null").distinct().collect()]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    text = docs.where("doc_id = 2").first().text
    spark.createDataFrame([(0, text), (1, " ".join(f"q{rng.randrange(99)}" for _ in range(30)))], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def test_stages_do_what_their_operators_do(spark, folder):
    assert [n for n, _ in C.STAGES] == ["quality", "near_dedup", "decontaminate", "pii", "mix"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, labels, bench = docs.columns, spark.read.parquet(f"{folder}/labels.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    ids = lambda df: sorted((r[0] is not None, r[0] or 0) for r in df.select("doc_id").collect())
    for k, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, folder)
        path = f"{folder}/stage{k}.parquet"
        out.write.parquet(path)
        out = spark.read.parquet(path)
        if name == "quality":
            scores = quality.quality_scores(docs, labels).where("predicted = 1")
            assert ids(out) == ids(scores)
        elif name == "near_dedup":
            groups = {r.component_id for r in simhash.near_duplicates(docs).collect()}
            assert {r.doc_id for r in out.collect() if r.doc_id is not None} == {g for g in groups if g is not None}
        elif name == "decontaminate":
            bad = {r.doc_id for r in decontamination.contaminated(docs, bench).collect()}
            assert ids(out) == sorted((r.doc_id is not None, r.doc_id or 0) for r in docs.collect() if r.doc_id not in bad)
        elif name == "pii":
            assert ids(out) == ids(docs)
            before = {r.doc_id: r.text for r in docs.collect()}
            assert all(r.text == (None if before[r.doc_id] is None else pii.redact_text(before[r.doc_id], pii.find_spans(before[r.doc_id]))) for r in out.collect())
        else:
            assert sorted(map(str, out.collect())) == sorted(map(str, mixing.mix(docs).collect()))
        if name != "mix":
            assert out.columns == columns
        docs = out


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def folded(text):
    return re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (text or "").lower())


def test_run_against_brute_force(spark, folder):
    """The model's scores are taken as they are; all else is worked out from the rows in plain Python."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    bench = {r.item_id: folded(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    scores = {(r.doc_id, r.score >= 0.7) for r in quality.quality_scores(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    rows = [r for r in docs.select("doc_id", "text", "source").collect() if (r.doc_id, True) in scores]
    groups = components({plain_fingerprint(r.text) for r in rows})
    best = {}
    for r in rows:
        key, group = (r.doc_id is None, r.doc_id or 0), min(groups[plain_fingerprint(r.text)])
        best[group] = min(best.get(group, (key, r)), (key, r), key=lambda x: x[0])
    kept = [r for _, r in best.values()]
    held = lambda i, w: w == i if len(i) < 5 else len(w) < 1000 and brute_cover(i, w) >= 0.8 * len(i)
    clean = [r for r in kept if not any(i and held(i, folded(r.text)) for i in bench.values())]
    assert len(rows) > len(kept) > len(clean) > 10
    size = {r.doc_id: words(pii.redact_text(r.text, pii.find_spans(r.text)) if r.text is not None else None) for r in clean}
    of = {r.doc_id: r.source for r in clean}
    sizes = defaultdict(int)
    for i, n in size.items():
        sizes[of[i]] += n
    aim = mixing.targets(dict(sizes))
    got = C.run(spark, folder).collect()
    assert sorted((str(r.doc_id), r.size, r.source_size) for r in got) == sorted((str(i), n, sizes[of[i]]) for i, n in size.items())
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(aim[of[r.doc_id]]) and 0 <= r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0
        taken[of[r.doc_id]] += r.taken
    for s, n in taken.items():
        assert abs(n - aim[s]) <= max(size[i] for i in size if of[i] == s)
    assert C.ORACLE_SQL is None


def test_empty_tables_and_clashing_columns(spark, folder, tmp_path):
    from pyspark.sql import functions as F

    full = {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels", "benchmark")}
    names = ["fp", "id", "size", "root", "keep", "label", "tree", "c0", "source", "lang", "item", "n", "t", "key"]
    for case, empty in (("documents", {"documents"}), ("others", {"labels", "benchmark"}), ("clash", set())):
        for n, df in full.items():
            df = df.limit(0) if n in empty else df
            extra = {c: F.lit("clash") for c in names if c not in df.columns}
            df.withColumns(extra).write.parquet(str(tmp_path / case / f"{n}.parquet"))
        out = C.run(spark, str(tmp_path / case))
        if case == "clash":
            assert sorted(map(str, out.collect())) == sorted(map(str, C.run(spark, folder).collect()))
        else:
            assert out.count() == 0 and "taken" in out.columns


def test_entry_registers_all():
    import __spark_entry__ as e

    names = e.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14)) and "pipeline" in names

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from sparkwarden.llm import infill
from sparkwarden.llm.common import text_bytes

WORDS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SPLIT = {"word": WORDS.findall, "char": list}


@pytest.mark.parametrize("unit", ["word", "char"])
def test_cuts_are_found_by_runs(unit):
    rng = random.Random(1)
    texts = ["", "  ", "a", "  a", " a b ", ""] + ["".join(rng.choice("ab é\n　𝛼\t c\x00") for _ in range(rng.randint(0, 40))) for _ in range(400)] + ["", ""]
    raw, offsets = text_bytes(pa.array(texts))
    runs = infill._UNITS[unit](raw, offsets)
    units = [SPLIT[unit](t) for t in texts]
    assert runs.count().tolist() == [len(u) for u in units]
    for share in (0, 0.3, 0.8, 1):
        n = np.array([int(share * len(u)) for u in units])
        at, points = runs.cut(np.arange(len(texts)), n)
        for k, u in enumerate(units):
            head = "".join(u[: n[k]])
            assert (at[k] - offsets[k], points[k] - runs.points[runs.rows[k]]) == (len(head.encode()), len(head))


def plain(key, text, unit="word", rate=50, spm_rate=80):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = SPLIT[unit](text)
    i, j = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:i], units[i:j], units[j:]))
    if not text or any(x in text for x in infill.MARKS) or h[2] % 100 >= rate:
        return key, len(units), "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return key, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return key, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("unit", "rate"), [("word", 50), ("char", 50), ("word", 100)])
def test_operator(spark, docs, rows, empty, unit, rate):
    more = [(k, t, "en", "s", 0) for k, t in enumerate(["<", "<P", "x<S>y <", " <M> ", "<P<P>", "a<", "<<S", "   x\x0b\x0c y", "𝛼" * 50 + " " * 20, "<|P|> >"] * 8, 1000)]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, docs.sparkSession.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").schema).select("doc_id", "text"))
    out = infill.fill_in_middle(both, unit=unit, rate=rate)
    got = out.select("*", infill.restored().alias("back")).collect()
    want = [plain(r[0], r[1], unit, rate) for r in [*rows, *more]]
    assert sorted(str(tuple(r)[:6]) for r in got) == sorted(map(str, want))
    assert sorted((str(r.doc_id), r.back) for r in got) == sorted((str(r[0]), r[1] or "") for r in [*rows, *more])
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(empty).count() == 0
    assert [tuple(r)[:6] for r in sorted(got, key=str)] == [tuple(r) for r in sorted(infill.fill_in_middle(docs.select("doc_id", "text").unionByName(both.where("doc_id >= 1000")).repartition(5), unit=unit, rate=rate).collect(), key=str)]


def test_columns_of_the_operator_may_be_there_before(docs):
    named = docs.withColumnsRenamed({"c0": "output", "id": "n", "fp": "form", "root": "h1"})
    assert named.count() == infill.fill_in_middle(named).count()


def test_bytes_that_are_no_utf8(spark):
    odd = spark.sql("select 2L doc_id, cast(unhex('61ff20f09f62') as string) text union all select 3L, null")
    got = {r.doc_id: r for r in infill.fill_in_middle(odd, rate=100).select("*", infill.restored().alias("back")).collect()}
    assert got[2].back == "a� �b" and got[2].n == 2 and got[3].form == "plain" and got[3].output == ""

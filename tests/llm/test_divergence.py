import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparkwarden.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least):
    """(lang, source, part, item, value, rank) by loops over dictionaries of Python numbers."""
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        found = TERM.findall((text or "").translate(LOWER))
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        counts[lang, source].update(found)
        seen[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= least]

        def share(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        of = {s: share(counts[lang, s]) for s in sources}
        whole = share(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [("pair", o, sum(abs(of[s][t] - of[o][t]) for t in kept)) for o in sources if o != s]
            terms = [("term", t, of[s][t] - whole[t]) for t in kept if counts[lang, s][t] and of[s][t] > whole[t]]
            for part, most in ((pairs, None), (terms, 50)):
                for rank, (kind, item, value) in enumerate(sorted(part, key=lambda x: (-x[2], x[1].encode()))[:most], 1):
                    out.append((lang, s, kind, item, value, rank))
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.collect())


def leaves_of(table):
    """A trie from {term: (docs, {source: count})}."""
    terms = sorted(table)
    raw = np.frombuffer(b"".join(terms), np.uint8)
    size = np.array([len(t) for t in terms], dtype=np.int64)
    ends = np.cumsum(size)
    each = [sorted(table[t][1].items()) for t in terms]
    column = lambda k: np.array([x[k] for e in each for x in e], dtype=np.int64)
    bounds = np.cumsum([0, *[len(e) for e in each]])
    return divergence.Leaves(raw, ends - size, ends, np.array([table[t][0] for t in terms], dtype=np.int64), bounds, column(0), column(1))


def table_of(leaves):
    b = leaves.bounds.tolist()
    return {t: (int(d), dict(zip(leaves.source[b[k] : b[k + 1]].tolist(), leaves.count[b[k] : b[k + 1]].tolist(), strict=True))) for k, (t, d) in enumerate(zip(leaves.terms, leaves.docs, strict=True))}


def test_tries_merge_as_tables_do():
    rng = random.Random(3)
    for alphabet, longest in ((b"ab", 30), (bytes(range(65, 91)) + bytes(range(128, 256)), 6), (b"a", 200), (b"xyz", 9)):
        tables = []
        for _ in range(4):
            table = {}
            for _ in range(rng.choice([0, 1, 300])):
                term = bytes(rng.choice(alphabet) for _ in range(rng.randint(1, longest)))
                table[term] = (rng.randint(1, 9), {rng.randrange(6): rng.choice([1, 300, 2**40]) for _ in range(rng.randint(1, 3))})
            tables.append(table)
        if not any(tables):
            continue
        want = {}
        for table in tables:
            for t, (d, c) in table.items():
                had = want.setdefault(t, (0, Counter()))
                had[1].update(c)
                want[t] = had[0] + d, had[1]
        got = divergence.merge([leaves_of(t) for t in tables])
        assert got.terms == sorted(want) and table_of(got) == {t: (d, dict(c)) for t, (d, c) in want.items()}
        assert got.prefixes().tolist() == [int.from_bytes(t[:8].ljust(8, b"\0"), "big") for t in got.terms]
        for part in got.parts(7):
            used, data = part.dump()
            back = divergence.Leaves.load(data, np.array(used))
            assert table_of(back) == table_of(part) and len(back.raw) == sum(map(len, back.terms))


def test_counting_is_by_documents_and_sources():
    rng = random.Random(7)
    for _ in range(60):
        texts = ["".join(rng.choice(["ab", "é", " ", "1", "日本", "x" * 9, "Q", "-"]) for _ in range(rng.randint(0, 25))) for _ in range(rng.randint(1, 9))]
        group = np.array([rng.randrange(3) for _ in texts])
        low = divergence._LOWER[np.frombuffer("".join(texts).encode(), np.uint8)]
        got = divergence.counted(low, np.cumsum([0, *[len(t.encode()) for t in texts]]), group, np.array([0, 1, 0]))
        want = {}
        for t, g in zip(texts, group.tolist(), strict=True):
            for term, n in Counter(TERM.findall(t.translate(LOWER))).items():
                docs, counts = want.setdefault((0, 1, 0)[g], {}).setdefault(term.encode(), (0, Counter()))
                want[(0, 1, 0)[g]][term.encode()] = docs + 1, counts
                counts[g] += n
        assert {k: table_of(v) for k, v in got.items()} == {k: {t: (d, dict(c)) for t, (d, c) in v.items()} for k, v in want.items()}
        assert all(v.terms == sorted(want[k]) for k, v in got.items())


def test_portions_cut_between_terms():
    rng = random.Random(2)
    for _ in range(50):
        data = np.frombuffer("".join(rng.choice(["abc", "é", " ", "1", "日本", "\n\n"]) for _ in range(rng.randint(0, 300))).encode(), np.uint8)
        for size in (1, 2, 17, 1000):
            parts = list(divergence._portions(data, size))
            terms = lambda raw: [raw[a:b].tobytes() for a, b in zip(*divergence.spans(raw, np.array([0, len(raw)]))[:2], strict=True)]
            assert b"".join(p.tobytes() for p in parts) == data.tobytes() and [t for p in parts for t in terms(p)] == terms(data)


def test_shares_of_very_large_counts_are_exact():
    counts = np.array([[0, 7], [10**10, 10**12]], dtype=np.int64)
    total = np.array([10**13, 3 * 10**12])
    want = [[1 + 10**9 * (int(c) + 5) // (int(t) + 10) for c, t in zip(row, total, strict=True)] for row in counts]
    assert divergence.shares(counts, total, 2).tolist() == want


SETTINGS = [{}, {"GATHER": 500, "HELD": 60, "PIECE": 3, "BLOCK": 4, "TILE": 2, "SAMPLE": 5, "RANGE_BYTES": 4000}, {"GATHER": 10, "HELD": 1, "PIECE": 1, "BLOCK": 1, "TILE": 1, "RANGE_BYTES": 9000}]


@pytest.mark.parametrize("settings", SETTINGS)
def test_operator(spark, docs, rows, empty, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(divergence, name, value)
    few = [r for r in rows if len(r[1] or "") < 300] if settings.get("HELD") == 1 else rows
    table = docs if few is rows else docs.where("text is null or length(text) < 300")
    for least in (30, 2):
        want = plain(few, least)
        assert any(r[2] == "term" for r in want) or least == 30
        assert result(divergence.source_divergence(table, least=least)) == want
    assert divergence.source_divergence(empty).count() == 0


def test_ties_go_by_bytes_and_sources_without_terms_stay(spark):
    rng = random.Random(8)
    words = ["zeta", "Äpfel", "äpfel", "ALPHA", "日本", "日", "ｚ", "😀x", "beta's"]
    rows = [(k, " ".join(rng.sample(words, 4)), "l", f"s{k % 3}", 0) for k in range(200)] + [(900, "1 2 3", "l", "none", 0), (901, None, None, "x", 0), (902, "", "", "y", 0), (903, "a", "", None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = result(divergence.source_divergence(df))
    assert got == plain(rows, 30)
    assert ("", "x", "pair", "y", 0, 2) in got and ("", "x", "pair", "", 0, 1) in got


def test_a_hot_term_and_a_hot_source(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 8)
    rows = [(k, "the " * 50 + f"w{'abcdefghij'[k % 10]} {'xyz'[k % 3] * (1 + k % 7)}", "en", "hot" if k % 3 else f"s{k % 9}", 0) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    assert result(divergence.source_divergence(df)) == plain(rows, 30)


def test_many_sources_are_measured_in_tiles(spark):
    """600 sources of one language: three tiles, six rows of work."""
    rows = [(k, f"a b c {'d ' * (k % 5)}", "l", f"s{k % 600}", 0) for k in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = divergence.source_divergence(df, least=30)
    assert got.where("part = 'pair'").count() == 600 * 599
    want = plain([r for r in rows], 30)
    some = {r for r in want if r[1] in ("s0", "s299", "s511")}
    assert set(map(tuple, got.where("source in ('s0', 's299', 's511')").collect())) == some


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no driver tables")
def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source, 0) for r in df.collect()]
    assert result(divergence.source_divergence(df)) == plain(rows, 30)

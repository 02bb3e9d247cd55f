import random
import re
import time

import numpy as np
import pytest

from sparkwarden.llm import decontamination as D


def brute_cover(item, doc, least=5):
    """Greedy string tiling by definition: the longest common run of unmarked words first; covered words of the item."""
    mi, md, total = [False] * len(item), [False] * len(doc), 0
    while True:
        best = (least - 1, None, None)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not mi[i + n] and not md[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if i is None:
            return total
        mi[i : i + n], md[j : j + n] = [True] * n, [True] * n
        total += n


def test_tiles_cover_what_plain_tiling_covers(monkeypatch):
    rng = random.Random(1)
    for _ in range(60):
        item = [rng.randrange(12) for _ in range(rng.randrange(0, 30))]
        doc = [rng.randrange(12) for _ in range(rng.randrange(0, 60))]
        if item and rng.random() < 0.7:
            cut = rng.randrange(len(item))
            doc[5:5] = item[cut:] + [99] + item[:cut]  # reordered
        for listed in (8, 0):  # by listed runs, and by length
            monkeypatch.setattr(D, "LISTED", listed)
            tiles = D.tile(np.array(item, dtype=np.uint64), np.array(doc, dtype=np.uint64))
            assert all(item[i : i + n] == doc[j : j + n] and n >= 5 for i, j, n in tiles)
            assert len({k for i, _, n in tiles for k in range(i, i + n)}) == len({k for _, j, n in tiles for k in range(j, j + n)}) == sum(n for *_, n in tiles)
            assert sum(n for *_, n in tiles) == brute_cover(item, doc)


@pytest.fixture(scope="module")
def benchmark(spark):
    rng = random.Random(2)
    items = [(k, " ".join(rng.choice("abcdefghijklmnop") + rng.choice("xyz") for _ in range(rng.randrange(12, 50)))) for k in range(12)]
    return spark.createDataFrame([*items, (50, None), (51, ""), (52, "too short"), (53, items[0][1])], "item_id long, text string")


def test_operator(spark, docs, rows, empty, benchmark, monkeypatch):
    items = {r.item_id: r.text for r in benchmark.collect()}
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    w = items[3].split()
    more = [
        (900, "Lead in. " + items[1].upper() + ", and out", 0), (901, " ".join(w[len(w) // 2 :]) + " between " + " ".join(w[: len(w) // 2]), 0),
        (905, "Too, SHORT!", 0), (906, "too short by a word", 0),
        (902, " ".join(w[: len(w) // 3]), 0), (903, items[0] + "\n" + items[2], 0), (904, items[5].replace(" ", "\n\t"), 0), (904, items[5].replace(" ", "\n\t"), 0),
    ]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string, x int").drop("x"))
    want = set()
    for i, t in [(r[0], r[1]) for r in rows] + [(m[0], m[1]) for m in more]:
        for k, item in items.items():
            a = split(item)
            d = split(t)
            runs = lambda x, n: {tuple(x[j : j + n]) for j in range(len(x) - n + 1)}
            if (len(a) >= 5 and runs(a, 5) & runs(d, 5) and brute_cover(a, d) >= 0.8 * len(a)) or (0 < len(a) < 5 and tuple(a) in runs(d, len(a))):
                want.add((i, k))
    assert {900, 901, 903, 904, 905, 906} <= {i for i, _ in want} and not {902} & {i for i, _ in want}
    for words in (4_000_000, 60):  # in one block, and in many
        monkeypatch.setattr(D, "BLOCK_WORDS", words)
        got = D.contaminated(every, benchmark).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and all(0.8 <= r.coverage <= 1 for r in got)
        assert len(got) == len(want) + sum(i == 904 for i, _ in want)
        clean = D.decontaminated(docs, benchmark)
        assert clean.columns == docs.columns and clean.count() == len(rows)
        assert D.decontaminated(every, benchmark).count() == len(rows) + 1
    assert D.contaminated(empty, benchmark).count() == 0 and D.contaminated(docs, benchmark.limit(0)).count() == 0 and D.decontaminated(empty, benchmark).count() == 0


def test_long_texts(spark):
    """Tiles of texts of 80,000 words in a moment, and passages deep inside long texts are found."""
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 60, 80_000).astype(np.uint64)
    b = a.copy()
    b[rng.integers(0, len(b), 1600)] = 7
    began = time.time()
    assert sum(n for *_, n in D.tile(a, b)) > 75_000
    same = np.full(80_000, 5, dtype=np.uint64)
    assert D.tile(same[:40_000], same) == [(0, 0, 40_000)] and D.tile(a[:50], np.concatenate([a[50:], a[:50]])) == [(0, 79_950, 50)]
    assert time.time() - began < 5
    words = [f"w{k}" for k in range(60_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:100])), (3, "x " * 60_000)], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(words[40_000:40_040])), (8, " ".join(words[100:50_000])), (9, "x " * 30_000)], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.coverage) for r in D.contaminated(docs, items).collect()} == {(1, 7, 1.0), (1, 8, 1.0), (3, 9, 1.0)}


def test_repeated_items_do_not_fill_a_block(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_WORDS", 100)
    text = " ".join(f"w{k}" for k in range(20))
    items = spark.createDataFrame([(k, text) for k in range(300)] + [(None, text)], "item_id long, text string")
    docs = spark.createDataFrame([(1, text), (None, text)], "doc_id long, text string")
    assert len(list(D._blocks(D._distinct_items(items, "text")))) == 1
    assert D.contaminated(docs, items).count() == 602


def test_short_items_are_found_wherever_they_stand(spark):
    texts = ["zebra quantum lattice", "a Zebra, quantum -- LATTICE and a zebra quantum lattice", "zebra quantum", "quantum lattice zebra", "zebra", "x " * 3000 + "zebra quantum lattice", None, "", "zebra quantum lattices"]
    items = [(1, "zebra quantum lattice"), (2, "zebra"), (3, "Zebra - Quantum - lattice!"), (4, "a b c d"), (5, ""), (6, None)]
    got = D.contaminated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    whole = [0, 1, 5]
    assert sorted((r.doc_id, r.item_id) for r in got) == sorted([(d, i) for d in whole for i in (1, 3)] + [(d, 2) for d in (0, 1, 2, 3, 4, 5, 8)])
    assert all(r.item_words == r.covered_words == r.longest == (1 if r.item_id == 2 else 3) and r.coverage == 1.0 and r.tiles == 1 for r in got)


def test_blocks_are_counted_in_the_words_that_they_hold(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_WORDS", 1000)
    items = spark.createDataFrame([(k, ".".join(f"w{k}x{j}" for j in range(100))) for k in range(40)], "item_id long, text string")
    blocks = [b for b, _ in D._blocks(D._distinct_items(items, "text"))]
    assert len(blocks) == 8 and max(sum(map(len, b.value.items)) for b in blocks) <= 1300

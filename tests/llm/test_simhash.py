import random
from collections import defaultdict

import xxhash

import pytest

from sparkwarden.llm import simhash


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not words:
        return 0
    parts = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """{fingerprint: set reached over links of at most three bits}."""
    todo, out = set(prints), {}
    while todo:
        group, front = set(), [todo.pop()]
        while front:
            x = front.pop()
            group.add(x)
            near = {y for y in todo if (x ^ y).bit_count() <= 3}
            todo -= near
            front += near
        for x in group:
            out[x] = group
    return out


def test_whole_operator(docs, rows, empty):
    got = simhash.near_duplicates(docs).select("doc_id", simhash.spelled("fp").alias("fingerprint"), "component_id").collect()
    assert len(got) == len(rows) and simhash.near_duplicates(empty).count() == 0
    prints = defaultdict(list)
    for r in rows:
        prints[plain_fingerprint(r[1])].append(r[0])
    groups = components(prints)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        p = plain_fingerprint(texts[r.doc_id])
        assert r.fingerprint == f"{p:016x}"
        ids = [i for q in groups[p] for i in prints[q] if i is not None]
        assert r.component_id == (min(ids) if ids else None)


@pytest.mark.parametrize("hot", [3_000, 3, 1])  # no bucket, some and nearly all buckets cut into cells
def test_links_connect_what_lies_three_bits_apart(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(3)
    prints = {0, (1 << 64) - 1}
    for _ in range(150):
        x = rng.getrandbits(64)
        prints.add(x)
        for _ in range(rng.choice([0, 1, 4, 12])):  # walks of one to four bits, some in one half alone
            bits = rng.sample(range(64) if rng.random() < 0.5 else range(32), rng.choice([1, 2, 3, 3, 4]))
            x ^= sum(1 << b for b in bits)
            prints.add(x)
    center = rng.getrandbits(64)
    prints |= {center ^ (1 << a) ^ (1 << b) for a in range(16) for b in range(a)}  # a dense group within one half
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    edges = simhash.links(spark.createDataFrame([(signed(x),) for x in prints], "fp long")).collect()
    mask = (1 << 64) - 1
    assert all(((e.a ^ e.b) & mask).bit_count() <= 3 for e in edges)
    joined = defaultdict(set)
    for e in edges:
        joined[e.a & mask].add(e.b & mask)
        joined[e.b & mask].add(e.a & mask)
    want = components(prints)
    for x in prints:
        seen, front = {x}, [x]
        while front:
            for y in joined[front.pop()] - seen:
                seen.add(y)
                front.append(y)
        assert seen == want[x]


def test_large_buckets_meet_by_balls(monkeypatch, spark):
    monkeypatch.setattr(simhash, "_SMALL", 1)
    import numpy as np

    rng = random.Random(9)
    base = [rng.getrandbits(32) for _ in range(40)]
    other = sorted({x ^ (1 << a) ^ (1 << b) ^ (1 << c) for x in base for a, b, c in [rng.sample(range(32), 3)]} | set(base))
    fp = np.array([x << 32 | 7 for x in other], dtype=np.uint64).view(np.int64)
    links = simhash._three(np.full(len(fp), 7, np.int64), fp, np.array(other, dtype=np.uint64))
    pairs = {frozenset((int(a) >> 32 & 0xFFFFFFFF, int(b) >> 32 & 0xFFFFFFFF)) for x, y in links for a, b in zip(x, y, strict=True) if a != b}
    assert all((min(p) ^ max(p)).bit_count() <= 3 for p in pairs)
    linked = defaultdict(set)
    for p in pairs:
        a, b = tuple(p)
        linked[a].add(b)
        linked[b].add(a)
    for k, x in enumerate(other):
        for y in other[k + 1 :]:
            if (x ^ y).bit_count() <= 3:
                seen, front = {x}, [x]
                while front:
                    for z in linked[front.pop()] - seen:
                        seen.add(z)
                        front.append(z)
                assert y in seen


def test_representatives(docs, rows, empty):
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns and simhash.representatives(empty).count() == 0
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert sorted(i for i in ids if i is not None) == sorted({c for c in groups.values() if c is not None})


def test_representatives_of_null_and_repeated_ids(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(600)) for _ in range(6)]
    assert len({frozenset(g) for g in components({plain_fingerprint(t) for t in texts}).values()}) == 6
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[3]), (3, texts[3]), (None, texts[4]), (9, texts[4]), (8, texts[5]), (8, texts[5])]
    got = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, texts[0]), (None, texts[1]), (3, texts[3]), (7, texts[2]), (8, texts[5]), (9, texts[4])]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))

import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwarden.llm import paragraphs as P
from sparkwarden.llm.common import mix, word_hashes
from sparkwarden.llm.queries import QUERIES

N = P.PASSAGE


def words(text):
    return re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (text or "").lower())


def filler(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]


def laid_out(w, each):
    return "\n".join(" ".join(w[k : k + each]) for k in range(0, len(w), each))


def windows(w):
    return [tuple(w[k : k + N]) for k in range(len(w) - N + 1)]


def jaccard(x, y):
    a, b = (Counter(z[k : k + 5] for k in range(len(z) - 4)) for z in (x, y))
    return sum((a & b).values()) / sum((a | b).values())


def covered(rows):
    return {(r.doc_id, k) for r in rows for k in range(r.place, r.place + r.n_words)}


@pytest.fixture(scope="module")
def planted():
    """Passages of many lengths at any place, laid out in lines of any length, some with a changed, added or missing word."""
    rng = random.Random(12)
    runs = [filler(rng, n) for n in (50, 51, 52, 58, 75, 140)]
    texts = []
    for k in range(90):
        w = filler(rng, rng.randrange(5, 80))
        for run in rng.sample(runs, 2):
            cut = list(run[rng.choice([0, 0, len(run) // 3]) :])
            if k % 3 == 2:
                at = rng.randrange(len(cut))
                cut[at : at + rng.choice([0, 1])] = filler(rng, rng.choice([0, 1]))
            w += cut + filler(rng, rng.randrange(8, 60))  # fewer words between two passages would be a changed word of one
        texts.append((k, laid_out(w, rng.choice([7, 30, 400]))))
    lone = " ".join(filler(rng, 70))
    texts += [(190, None), (191, ""), (192, "a " * 300), (193, "b " * 120 + " ".join(filler(rng, 30))), (194, " ".join(filler(rng, 300)))]
    texts += [(None, texts[0][1]), (None, texts[1][1]), (7, texts[7][1]), (195, "É " + texts[3][1].upper()), (196, lone), (197, lone), (197, lone)]
    return texts


def test_exact_repeats_are_all_found_and_what_is_found_is_alike(spark, planted):
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in planted], "doc_id long, text string, t string, place int")
    rows = P.repeated_paragraphs(df).collect()
    texts, where = {t or "" for _, t in planted}, defaultdict(set)
    for t in texts:
        for g in windows(words(t)):
            where[g].add(t)
    copies = Counter(t for _, t in planted)
    want = set()
    for i, t in planted:
        w = words(t)
        for k in range(len(w) - N + 1):
            if len(where[tuple(w[k : k + N])]) > 1 or copies[t] > 1:
                want |= {(i, j) for j in range(k, k + N)}
    got = covered(rows)
    assert want <= got
    by_word = defaultdict(set)
    for g, ts in where.items():
        for x in g:
            by_word[x].add(g)
    more = sorted((i, k) for i, k in got - want if i is not None)
    for i, k in more[:: max(1, len(more) // 25)]:  # what is reported and repeats nowhere word by word stands in N words that are alike in another text
        t = next(t for j, t in planted if j == i)
        w = words(t)
        others = [g for g in set().union(*(by_word[x] for x in w[max(0, k - 20) : k + 20])) if where[g] - {t}]
        assert any(jaccard(tuple(w[a : a + N]), g) >= 0.8 for a in range(max(0, k - N + 1), min(k, len(w) - N) + 1) for g in others if len(set(w[a : a + N]) & set(g)) > 35)
    by_id = defaultdict(set)
    for i, t in planted:
        by_id[i].add((t or "").encode())
    for r in rows:
        assert r.n_words >= N - P.shift(0.8) and any(words(t[r.start_byte : r.end_byte].decode()) == words(t.decode())[r.place : r.place + r.n_words] for t in by_id[r.doc_id])
    lone = sorted((r.doc_id, r.remove) for r in rows if r.doc_id in (196, 197))
    assert lone == [(196, False), (197, True), (197, True)] and len({r.group_id for r in rows if r.doc_id in (196, 197)}) == 1
    assert not {r.doc_id for r in rows} & {190, 191, 192, 193, 194}


def test_near_passages(spark):
    """Recall of passages of 60 words with one word changed, against all pairs: most have 51 words in a row that are alike."""
    rng, texts, near = random.Random(3), [], 0
    for k in range(150):
        run = filler(rng, 60)
        other = list(run)
        other[rng.randrange(60)] = "changed"
        near += any(jaccard(tuple(run[a : a + N]), tuple(other[a : a + N])) >= 0.8 for a in range(10))
        texts += [(2 * k, " ".join(filler(rng, 40) + run + filler(rng, 40))), (2 * k + 1, " ".join(filler(rng, 33) + other + filler(rng, 20)))]
    rows = P.repeated_paragraphs(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    groups = defaultdict(set)
    for r in rows:
        groups[r.group_id].add(r.doc_id)
    assert all(len(g) == 2 and min(g) % 2 == 0 and max(g) == min(g) + 1 for g in groups.values())
    assert len(groups) >= 0.9 * near


@pytest.mark.parametrize("few", [16, 2])
def test_no_link_of_a_key_is_lost(spark, monkeypatch, few):
    """Twelve copies of a passage, each with a word of its own changed, added or left out, and no original: all pairs of
    paragraphs that share a key and are alike are found in one group, and cut unless they are the first."""
    monkeypatch.setattr(P, "FEW", few)
    rng, texts = random.Random(8), []
    for k in range(12):
        run = filler(rng, 64)
        for j in range(12):
            w, at = list(run), rng.choice([12, 30, 31, 48]) if j < 9 else rng.randrange(6, 58)
            w[at : at + rng.choice([0, 1, 1])] = filler(rng, 1) if j % 4 else []
            texts.append((100 * k + j, " ".join(filler(rng, rng.randrange(200, 300)) + w + filler(rng, 20))))
    rows = P.repeated_paragraphs(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    order = {r["doc_id"]: r["t"] for r in spark.createDataFrame(texts, "doc_id long, text string").selectExpr("doc_id", "xxhash64(text) t").collect()}
    group, cut = {}, set()
    for r in rows:
        group |= {(r.doc_id, p): r.group_id for p in range(r.place, r.place + r.n_words)}
        spans = [(c.start_byte, c.end_byte) for c in r.cuts]
        cut |= {(r.doc_id, p) for p in range(r.place, r.place + r.n_words) if any(a <= 6 * p and 6 * p + 5 <= b for a, b in spans)}
    shared = defaultdict(set)
    for i, text in texts:
        w = word_hashes(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))[0]
        for band in range(P.BANDS):
            for p, key in enumerate(P.keys(*P.hashes(w, P.KEY), P.KEY, band)[1].tolist()):
                shared[band, key].add((i, p))
    grams, seen = {i: text.split() for i, text in texts}, 0
    for members in shared.values():
        for i, p in members:
            for j, q in members:
                if i < j and abs(p - q) < 400 and i // 100 == j // 100:
                    a, b = tuple(grams[i][p : p + N]), tuple(grams[j][q : q + N])
                    if a[:5] == b[:5] and a[-5:] == b[-5:] and jaccard(a, b) >= 0.8:
                        seen += 1
                        assert all(group.get((i, p + x)) == group[j, q + y] for x in (0, N - 1) for y in (0, N - 1))
                        last, place = max((order[i], i, p), (order[j], j, q))[1:]
                        assert {(last, place + x) for x in (0, 25, N - 1)} <= cut
    assert seen > 1000


def test_cuts_leave_one_copy_of_everything(spark, planted):
    df = spark.createDataFrame([(i, t, "x", len(t or "")) for i, t in planted if i is not None and (i % 3 != 2 or i > 100)], "doc_id long, text string, t string, n_chars int")
    left = P.without_repeats(df)
    assert left.columns == df.columns and left.count() == df.count()
    before, after = df.collect(), left.collect()
    # passages are cut where an earlier text has them, so no word is cut everywhere
    vocabulary = lambda rows: {w for r in rows for w in words(r.text)}
    assert vocabulary(before) - vocabulary(after) == set()
    assert sum(len(words(r.text)) for r in after) < 0.8 * sum(len(words(r.text)) for r in before)
    by_id = {r.doc_id: r for r in after if r.doc_id not in (7, 197)}
    assert by_id[194].text == next(t for i, t in planted if i == 194) and by_id[190].text is None
    assert all(r.n_chars == len(r.text) for r in after if r.text is not None)


def test_a_key_that_says_something_else_elsewhere(spark):
    """A run of 30 words stands in many texts; two of them share 51 words around it, whatever the first and last text are."""
    rng = random.Random(4)
    common = filler(rng, 30)
    texts = [(k, " ".join(filler(rng, 60) + common + filler(rng, 60))) for k in range(400)]
    for k in range(20):
        a, b = filler(rng, 10), filler(rng, 11)
        texts += [(1000 + 2 * k + j, " ".join(filler(rng, 40) + a + common + b + filler(rng, 40))) for j in range(2)]
    rows = P.repeated_paragraphs(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.doc_id for r in rows} == set(range(1000, 1040)) and all(r.n_words == 51 for r in rows)
    assert len({r.group_id for r in rows}) == 20


def test_keys_are_those_of_the_least_shingle(monkeypatch):
    monkeypatch.setattr(P, "_CHUNK_BITS", 7)
    w = mix(np.arange(700, dtype=np.uint64) % np.uint64(450))
    for length, band in ((8, 0), (8, 2), (26, 0), (N, 0)):
        at, key = P.keys(*P.hashes(w, length), length, band)
        assert len(at) == len(w) - N + 1 and (at >= np.arange(len(at))).all() and (at + length <= np.arange(len(at)) + N).all()
        same = np.flatnonzero(np.arange(len(at)) + 450 < len(at))
        assert (key[same] == key[same + 450]).all()  # equal words, equal keys
    place = P.packed(np.array([5]), np.array([40]), np.array([43]))
    assert [int(x[0]) for x in P.unpacked(place)] == [5, 40, 43]


def test_alike_counts_shingles():
    rng = np.random.default_rng(1)
    a = rng.integers(1, 1 << 31, (6, P._SPAN)).astype(np.uint32)
    b = a.copy()
    b[1, 100:105] = rng.integers(1, 1 << 31, 5)  # one changed word
    b[2, 103:] = a[2, 100:-3]  # three added words
    b[3, 60:66] = rng.integers(1, 1 << 31, 6)
    a[4, 200:] = 0  # the text ends
    b[5, 3:] = b[5, 2]  # one shingle over and over
    for similarity in (0.8, 0.9):
        got, partner = P.alike(a, b, similarity)
        most = P.shift(similarity)
        assert ((partner < 0) | (np.take_along_axis(b, np.maximum(partner, 0), 1) == a)).all()
        for k in range(6):
            for p in range(P.BLOCK):
                x, y = a[k, p : p + 47].tolist(), b[k, p : p + 47].tolist()
                both = sum((Counter(x) & Counter(y)).values())
                ends = all(a[k, q] in b[k, max(0, q - most) : q + most + 1] for q in (p, p + 46))
                assert got[k, p] == (0 not in x and 0 not in y and both >= similarity * (94 - both) and ends), (k, p)


def test_registered_query_and_odd_documents(spark, docs, rows, empty, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["op5_paragraphs"](spark, str(tmp_path)).collect()
    assert {100, 107, 110, 115} <= {r.doc_id for r in found}
    assert not {r.doc_id for r in found} & {200, 201, 202, 203, 204, 300, 301, 302}
    assert P.repeated_paragraphs(empty).count() == 0 and P.without_repeats(empty).count() == 0
    assert P.without_repeats(docs).columns == docs.columns


def test_copies_around_an_original(spark):
    """Stars: a passage and eight copies of it, each with another word changed well inside. Two copies are not alike, each is like the original."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(5000)]
    some = lambda: [rng.choice(words) for _ in range(rng.randrange(25, 45))]
    rows = []
    for c in range(40):
        base = [rng.choice(words) for _ in range(60)]
        for j in range(9):
            t = list(base)
            if j:
                t[rng.randrange(9, 51)] = f"x{c}y{j}"
            rows.append((9 * c + j, " ".join(some() + t + some())))
    found = {r.doc_id for r in P.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(d % 9 == 0 for d in found) == 40 and sum(d % 9 > 0 for d in found) >= 0.9 * 320


def test_a_paragraph_that_several_texts_have_is_looked_at_once(spark, monkeypatch):
    rng, seen, real = random.Random(5), [], P.written
    word = lambda: f"w{rng.randrange(10**6)}"
    base = [word() for _ in range(P.PASSAGE)]
    variants = [[*base[:45], f"v{k}", *base[46:]] for k in range(20)]
    docs = [(2 * k + n, " ".join([word() for _ in range(9)] + v + [word() for _ in range(9)])) for k, v in enumerate(variants) for n in range(2)]

    def spy(df, what):
        out = real(df, what)
        if what == "paragraph-words":
            seen.append(max(r["count"] for r in out.groupBy("words", "gap").count().collect()))
        return out

    monkeypatch.setattr(P, "written", spy)
    got = P.repeated_paragraphs(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == list(range(40)) and len({r.group_id for r in got}) == 1
    assert seen == [20]  # not 40: one for each of the twenty, by the first text that has it
    assert P._again(np.array([0, 0, 0, 1, 1]), np.array([7, 8, 7, 7, 7])).tolist() == [False, False, True, False, True]


def test_shuffle_files_go_with_the_step_that_made_them(spark):
    disk, name = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def shuffled():
        files = disk.getAllFiles()
        return {f for f in (files.apply(k).getName() for k in range(files.size())) if f.startswith("shuffle_")}

    before, kept = shuffled(), spark.conf.get(name)
    assert len(P.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "test").collect()) == 7
    until = time.time() + 10
    while shuffled() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffled() - before and spark.conf.get(name) == kept

import hashlib
import random

from sparkwarden.llm import lz


def plain_phrases(text):
    known, out, i = set(), [], 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in known:
            j += 1
        if j > len(text):
            break
        known.add(text[i:j])
        out.append(text[i:j])
        i = j
    return out


def test_parse_is_the_incremental_dictionary():
    rng = random.Random(1)
    for n in (0, 1, 2, 50, 3000):
        for alphabet in ("a", "ab", "abcdefgh é\n𝛼"):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            phrases, ends = lz.parse(text)
            assert phrases == plain_phrases(text) and ends == [sum(map(len, phrases[: k + 1])) for k in range(len(phrases))]


def test_likeness_follows_the_phrase_sets():
    rng = random.Random(2)
    prose = lambda n: " ".join("".join(rng.choice("aeioulmnrst") for _ in range(5)) for _ in range(n))
    errors = []
    for _ in range(40):
        a = prose(200)
        b = a[: len(a) * 2 // 3] + prose(70)
        x, y = set(plain_phrases(a)), set(plain_phrases(b))
        errors.append(lz.likeness(lz.fingerprint(a), lz.fingerprint(b)) - len(x & y) / len(x | y))
    assert abs(sum(errors) / len(errors)) < 0.04 and max(map(abs, errors)) < 0.25
    assert lz.likeness(lz.fingerprint(""), lz.fingerprint("")) == 1.0 and lz.fingerprint("abc") == lz.fingerprint("abc")


def test_operator(spark, docs, rows, empty):
    key = lambda r: (r[0] is None, -(r[0] or 0), r[1] or "")
    order = [(i, t or "") for i, t, *_ in sorted(rows, key=key)]
    want = []
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        edited = lz.edited_text(t, following)
        assert edited == t[: len(t) - len(t) // 3] + following[: len(t) // 3]
        a, e, b = lz.fingerprint(t), lz.fingerprint(edited), lz.fingerprint(following)
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, e, round(lz.likeness(a, e), 9), round(lz.likeness(a, b), 9)))
    for parts in ("1", "4", "50"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = lz.edit_fingerprints(docs).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert sorted(map(str, [tuple(r) for r in got])) == sorted(map(str, want))
    assert lz.edit_fingerprints(empty).count() == 0
    one = lz.edit_fingerprints(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one.near_next == 1.0


def test_one_row_over_and_over_fills_no_range(spark):
    """Rows equal in id and text are dealt to many ranges, and so are the rows of null ids."""
    rows = [(7, "the same text again and again")] * 300 + [(None, f"text number {k % 90}") for k in range(300)] + [(k, f"{k} words") for k in range(100, 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found, plain = [], lz.written

    def watched(table, what):
        out = plain(table, what)
        found.append(out)
        return out

    lz.written = watched
    try:
        got = lz.edit_fingerprints(df).collect()
    finally:
        lz.written = plain
    assert len(got) == 700 and sum(r.doc_id == 7 and r.near_next == 1.0 for r in got) >= 299
    assert sum(r.doc_id is None and r.near_next == 1.0 for r in got) >= 200  # equal texts of null ids lie side by side
    assert max(r["count"] for r in found[0].groupBy("part").count().collect()) < 400

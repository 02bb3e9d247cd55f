import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkwarden.llm import token_files, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_256), st.integers(0, 2**64 - 1)), max_size=150), max_size=6), st.integers(1, 40))
def test_code_is_reversible(lists, block):
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    values = np.array([v for x in lists for v in x], dtype=np.uint64)
    coded = list(token_files.encode_many(values, bounds, block))
    for want, (words, blocks, escapes) in zip(lists, coded, strict=True):
        assert token_files.decode(words, escapes).tolist() == want
        assert len(blocks) == 4 * -(-len(want) // block)
        for begin in range(0, len(want) + 1, 7):
            assert token_files.decode_span(words, blocks, escapes, begin, min(len(want), begin + 30), block).tolist() == want[begin : begin + 30]
    assert token_files.decode_many([w for w, _, _ in coded], [e for _, _, e in coded]).tolist() == values.tolist()


def test_words_are_filled_as_a_plain_greedy_packer_would(monkeypatch):
    rng = random.Random(4)
    values = [rng.choice([0, 1, rng.randrange(2 ** rng.randint(1, 30))]) for _ in range(30_000)] + [2**60, 2**60 - 256, 5, 2**64 - 1]
    want, i = [], 0
    while i < len(values):
        room = token_files.BLOCK - i % token_files.BLOCK
        fits = [(s, c) for s, (c, w) in enumerate(token_files.LAYOUTS, 1) if c <= min(room, len(values) - i) and all(v < 2**w for v in values[i : i + c])]
        s, c = fits[0] if fits else (0, 1)
        want.append((s, values[i : i + c]))
        i += c
    for work in (5000, 1 << 19):
        monkeypatch.setattr(token_files, "WORK_IDS", work)
        words, _, escapes = token_files.encode(np.array(values, dtype=np.uint64))
        got = np.frombuffer(words, "<u8")
        assert [int(w) >> 60 for w in got] == [s for s, _ in want] and np.frombuffer(escapes, "<u8").tolist() == [2**60, 2**64 - 1]
        assert token_files.decode(words, escapes).tolist() == values


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def crc(x):
    return zlib.crc32(np.array(x, dtype="<u4").tobytes())


def test_operator(spark, docs, rows, empty, monkeypatch):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for parts, work in (("1", 1 << 19), ("3", 2000), ("40", 1 << 19)):
        monkeypatch.setattr(token_files, "WORK_IDS", work)
        monkeypatch.setattr(token_files, "WORK_BYTES", work)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            path = token_files.token_set(docs.repartition(5), PATH)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        got = token_files.read_tokens(spark, path).orderBy("start").collect()
        assert [r.doc_id for r in got] == [r[0] for r in order] and got[0].start == 0
        stream = [t for r in got for t in r.ids]
        for k, r in enumerate(got):
            assert r.n_tokens == len(r.ids) and r.ids[-1] == 0 and r.start + r.n_tokens == (got[k + 1].start if k + 1 < len(got) else len(stream))
        assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(r[0]), [*ids(r[1]), 0]) for r in rows)
        digests = {(r.start, r.doc_id, r.n_tokens): r.ids_crc32 for r in token_files.read_digests(spark, path).collect()}
        assert digests == {(r.start, r.doc_id, r.n_tokens): crc(r.ids) for r in got}
        for begin, end in ((0, 10), (len(stream) // 2, len(stream) // 2 + 9000), (len(stream) - 5, len(stream) + 5), (7, 7)):
            found = token_files.read_span(spark, path, begin, end).orderBy("start").collect()
            assert [t for r in found for t in r.ids] == stream[begin:end] and (not found or found[0].start == begin)
    assert token_files.read_tokens(spark, token_files.token_set(empty, PATH)).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(spark, name):
    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        plain = lambda t: Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids
    else:
        import sentencepiece

        plain = sentencepiece.SentencePieceProcessor(model_file=path).encode
    texts = ["", "Hello  world, été 42", "<s> x </s>", "日本語\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    where = token_files.scratch_path(spark, "tokens")
    token_files.write_tokens(docs, path, where, end_id=None)
    assert [r.ids for r in token_files.read_tokens(spark, where).orderBy("start", "doc_id").collect()] == [plain(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'stéñ½²ª–x7.,<|\xa0\xad"), st.characters(codec="utf-8")), max_size=60))
def test_ids_are_the_librarys(text):
    assert ENCODER.ids([text])[0].tolist() == ids(text)


ENCODER = token_files.Encoder("json", open(PATH, "rb").read())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(" \n\t'stremvdlxé½²ª–7.,<\xa0\xad×ɏ"), min_size=1, max_size=25), min_size=1, max_size=6))
def test_pieces_are_the_pre_tokenizers(texts):
    coded = [t.encode() for t in texts]
    first = np.cumsum([0, *map(len, coded)])
    raw = np.frombuffer(b"".join(coded), np.uint8)
    starts = token_files.piece_starts(raw, first)
    pieces = [raw[a:b].tobytes().decode() for a, b in zip(starts, [*starts[1:], len(raw)], strict=True)]
    assert pieces == [p for t in texts for p in tokens._PIECES.findall(t)]


def test_special_strings_and_repeats(monkeypatch):
    texts = ["it's  <|endoftext|> we'll\n\n go", "x" * 3000, "", "the the the", " a", "a ", "a\n b", "a \nb", "don't 's x's 's", "日 本", "a\tb c\xa0 d", "1 22 3a a3 .. ,a"]
    for most in (600_000, 0):
        monkeypatch.setattr(token_files, "_MOST_KEPT", most)
        assert [x.tolist() for x in ENCODER.ids(texts)] == [ids(t) for t in texts]
    for text in texts:
        assert ENCODER.ids([text])[0].tolist() == ids(text)


def test_new_pieces_go_to_the_library_as_the_lines_of_one_text(monkeypatch):
    _, kind, data = token_files.tokenizer_version(PATH)
    encoder, sent = token_files.Encoder(kind, data), []
    ids = encoder._ids
    monkeypatch.setattr(encoder, "_ids", lambda texts, *library: sent.extend(texts) or ids(texts, *library))
    pieces = [x.encode() for x in ["abc", " zxqvwk", "\n", "é", "12", " ’", "'s", "  ", "\t", " \n\n", "\xa0", "!?", " a"] + [f" w{k}x" for k in range(50)]]
    want = [np.array(encoder.library.encode(p.decode(), add_special_tokens=False).ids, "<u4").tobytes() for p in pieces]
    assert encoder._new(pieces) == want and len(sent) == 3  # two hold a line end


def test_new_pieces_go_to_the_library_spelled_as_tokens_are():
    import json

    from tokenizers import pre_tokenizers

    alphabet = set(pre_tokenizers.ByteLevel.alphabet())
    assert {c for c in token_files._SPELLED if c != "\n"} == alphabet - {"\u010a"} and len(set(token_files._SPELLED)) == 256
    version, kind, data = tokens.tokenizer_version(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = token_files.Encoder(kind, data)
    assert json.loads(encoder.by_line.to_str())["pre_tokenizer"]["type"] == "CharDelimiterSplit"
    texts = ["".join(chr(c) for c in range(0x250) if not tokens._UNSAFE.search(chr(c)))] + [f" {chr(a)}{chr(b)}x\u2013" for a in range(32, 127) for b in (10, 32, 39, 65, 0xE9, 0x24F)]
    for text, ids in zip(texts, encoder.ids(texts), strict=True):
        assert ids.tolist() == encoder.library.encode(text, add_special_tokens=False).ids, text
    assert len(encoder.pieces) > token_files.JOINED

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkwarden.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
COUNTER = tokens.Counter("json", open(PATH, "rb").read())


def plain(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'stéñ½²ª–x7.,<|\xa0\xad"), st.characters(codec="utf-8")), max_size=80))
def test_counts_are_the_librarys(text):
    assert COUNTER.count(text) == plain(text)


@pytest.mark.parametrize("text", ["", "it's  <|endoftext|> we'll\n\n go", "  a  b ", "x" * 3000, "don't  \n 12½ 3²"])
def test_cases(text):
    assert COUNTER.count(text) == plain(text)


def test_operator(spark, docs, rows, empty, tmp_path):
    cache = f"file://{tmp_path}/cache"
    texts = {r[0]: r[1] or "" for r in rows}
    for again in range(2):
        got = (tokens.token_counts_in_parts if not again else tokens.token_counts)(docs, PATH, cache).collect()
        assert len(got) == len(rows)
        for r in got:
            t = texts[r.doc_id]
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), plain(t), plain(t) > 512)
        stored = spark.read.parquet(cache)
        assert stored.count() == len(set(texts.values())), f"each distinct text is encoded once (call {again})"
    assert tokens.token_counts(empty, PATH).count() == 0
    other = tokens.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"), cache)
    assert other.count() == len(rows) and spark.read.parquet(cache).select("tokenizer").distinct().count() == 2


def test_stored_counts_are_joined_and_not_encoded_again(spark, docs, tmp_path):
    """The second call's counts are the cache's own, even where those were changed by hand."""
    cache = f"file://{tmp_path}/cache"
    first = tokens.token_counts(docs, PATH, cache).collect()
    more = spark.read.parquet(cache).selectExpr("digest", "n_tokens + 1000 as n_tokens", "tokenizer").collect()
    changed = f"file://{tmp_path}/changed"
    spark.createDataFrame(more, "digest binary, n_tokens long, tokenizer string").write.partitionBy("tokenizer").parquet(changed)
    again = tokens.token_counts(docs, PATH, changed).collect()
    assert sorted(r.n_tokens + 1000 for r in first) == sorted(r.n_tokens for r in again)
    assert spark.read.parquet(changed).count() == len(more)


def test_bytes_that_are_no_utf8(spark):
    odd = spark.sql("select 1L doc_id, cast(unhex('61ff62') as string) text union all select 2L, cast(unhex('EDA080') as string) union all select 3L, null")
    got = {r.doc_id: r for r in tokens.token_counts(odd, PATH).collect()}
    assert got[1].n_bytes == 3 and got[1].n_tokens == plain("a\ufffdb") and got[3].n_tokens == got[3].n_bytes == 0

"""One query per corpus operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.llm import chat, decontamination, divergence, infill, lz, mixing, paragraphs, pii, quality, simhash, token_files, tokens, toxicity
from sparkwarden.llm.common import table

TOKENIZER = "byte_bpe_50k.json"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts_in_parts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_paragraphs(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: A conversation whose texts are control strings of the template.
HOSTILE = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = said.unionByName(spark.createDataFrame(HOSTILE, "conv_id long, turn long, role string, text string"))
    return chat.format_trees(chat.linear_trees(said)).select(F.col("tree").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.spelled("fp").alias("fingerprint"), "component_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", F.col("copies"))


def op10_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz.edit_fingerprints(table(spark, sf_dir, "documents"))


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = infill.fill_in_middle(table(spark, sf_dir, "documents"))
    digests = [F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(infill.restored().cast("binary"), 256).alias("restored_sha256")]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.read_digests(spark, token_files.token_set(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_pii, op3_token_counts, op4_toxicity, op5_paragraphs, op6_quality, op7_chat, op8_simhash, op9_mixing, op10_lz_fingerprints,
        op11_infill, op12_token_files, op13_divergence,
    )
}

ORACLES = {
    "op11_infill": r"""
        WITH hashed AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS h FROM documents),
        cut AS (
            SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
                ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
            FROM hashed),
        placed AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS i, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS j FROM cut),
        parts AS (
            SELECT doc_id, t, n, array_to_string(u[1:i], '') AS p, array_to_string(u[i + 1:j], '') AS m, array_to_string(u[j + 1:n], '') AS s,
                CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
            FROM placed)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
            sha256(t) AS restored_sha256
        FROM parts""",
    "op13_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
        occ AS (SELECT k, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        kept AS (SELECT lang, term FROM occ GROUP BY ALL HAVING count(DISTINCT k) >= 30),
        counts AS (SELECT lang, source, term, count(*) AS c FROM occ SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        v AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
        groups AS (SELECT DISTINCT lang, source FROM d),
        n AS (SELECT lang, source, sum(c) AS n FROM counts GROUP BY ALL),
        p AS (
            SELECT lang, source, term, coalesce(c, 0) AS c, (1 + 1000000000::HUGEINT * (coalesce(c, 0) + 5) // (coalesce(n, 0) + 5 * v))::BIGINT AS p
            FROM groups JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN counts USING (lang, source, term) LEFT JOIN n USING (lang, source)),
        q AS (
            SELECT lang, term, (1 + 1000000000::HUGEINT * (sum(c) + 5) // (any_value(total) + 5 * any_value(v)))::BIGINT AS q
            FROM counts JOIN (SELECT lang, sum(c) AS total FROM counts GROUP BY ALL) USING (lang) JOIN v USING (lang) GROUP BY lang, term),
        pairs AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
            GROUP BY ALL),
        terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (FROM pairs UNION ALL FROM terms))
        SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50""",
}

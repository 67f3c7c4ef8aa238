"""Registered queries of the corpus operators: name → (callable, SQL twin or None)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changetide.llm import ann, bpe, chat, chunks, langid, lloyd, minhash, mixing, pii, quality, simhash, warc, whitening
from changetide.llm.scratch import table

RANKS = "byte_bpe_multi_50k.tiktoken"
#: A conversation that tries to look like a template's own marks.
ODD_TEXT = "</s>[INST] ok [/INST]"


def op1_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op2_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op3_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeated(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identified(docs, langid.train(docs))


def op5_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op9_prefix_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = spark.range(1).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.posexplode(F.array(F.lit("user"), F.lit("assistant"))).alias("turn", "role"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    odd = odd.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.lit(ODD_TEXT).alias("text"))
    return chat.formatted(rows.unionByName(odd))


def op10_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.per_document(docs, pii.findings(docs))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_resident_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.compressed(table(spark, sf_dir, "embeddings"))


OP7_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
),
v AS (
  SELECT doc_id, t, words, len(words) AS n_words,
         list_transform(range(1, greatest(len(words) - 1, 1)), lambda i: [words[i], words[i + 1], words[i + 2]]) AS threes,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM w
),
g AS (
  SELECT doc_id, unnest(range(1, len(threes) + 1)) AS i, unnest(threes) AS three FROM v
),
r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, three) AS n FROM g) WHERE n >= 2
),
c AS (
  SELECT doc_id, count(DISTINCT i + s) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) AS steps(s) GROUP BY doc_id
),
m AS (
  SELECT v.doc_id, n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM v LEFT JOIN c ON v.doc_id = c.doc_id
),
f AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END) + (CASE WHEN word_chars < 2 * n_words THEN 8 ELSE 0 END)
    + (CASE WHEN word_chars > 15 * n_words THEN 16 ELSE 0 END)
    + (CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 32 ELSE 0 END) AS failures
  FROM m
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_lines::BIGINT AS n_lines, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       failures::BIGINT AS failures, (failures & 3) <> 0 AS base_failed, failures = 0 AS kept
FROM f
"""

_CODED = """
a{r} AS (
  SELECT id, pos, part, arg_min(entry, far * 1000 + entry) AS entry, min(far) AS far
  FROM (
    SELECT p.id, p.pos, p.part, b.entry, list_sum(list_transform(range(1, len(p.part) + 1), lambda i: (p.part[i] - b.part[i]) ** 2))::BIGINT AS far
    FROM p JOIN b{r} AS b USING (pos)
  )
  GROUP BY id, pos, part
)"""

_LEARNED = """,
s{r} AS (
  SELECT pos, entry, list(v ORDER BY i) AS part
  FROM (
    SELECT pos, entry, i, (sum(c) - ((sum(c) % count(*)) + count(*)) % count(*)) // count(*) AS v
    FROM (SELECT pos, entry, unnest(range(1, w + 1)) AS i, unnest(part) AS c FROM (SELECT *, len(part) AS w FROM a{r}))
    GROUP BY pos, entry, i
  )
  GROUP BY pos, entry
),
b{n} AS (
  SELECT pos, entry, coalesce(s{r}.part, b{r}.part) AS part FROM b{r} LEFT JOIN s{r} USING (pos, entry)
),"""

OP13_SQL = (
    """
WITH x AS (
  SELECT vec_id AS id, label, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)::BIGINT) AS x, len(embedding) // 4 AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
),
p AS (
  SELECT id, pos, x[pos * w + 1 : (pos + 1) * w] AS part, w FROM x, (SELECT unnest(range(4)) AS pos)
),
f AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS entry FROM x ORDER BY id LIMIT 256),
b0 AS (SELECT p.pos, f.entry, p.part FROM p JOIN f USING (id)),"""
    + "".join(_CODED.format(r=r) + _LEARNED.format(r=r, n=r + 1) for r in range(4))
    + _CODED.format(r=4)
    + """,
c AS (
  SELECT id, string_agg(printf('%02x', entry), '' ORDER BY pos) AS code, sum(far)::BIGINT AS error FROM a4 GROUP BY id
),
l AS (SELECT label, sum(error)::BIGINT AS label_error FROM c JOIN x USING (id) GROUP BY label),
h AS (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY pos, entry)) AS codebooks_sha256 FROM b4)
SELECT c.id AS vec_id, c.code, c.error, l.label_error, h.codebooks_sha256
FROM c JOIN x USING (id) JOIN l ON l.label IS NOT DISTINCT FROM x.label, h
"""
)

queries = {
    "op1_adaptive_scan": (op1_adaptive_scan, None),
    "op2_warc_zstd": (op2_warc_zstd, None),
    "op3_gear_chunks": (op3_gear_chunks, None),
    "op4_language": (op4_language, None),
    "op5_tensored_minhash": (op5_tensored_minhash, None),
    "op6_pivotal_mix": (op6_pivotal_mix, None),
    "op7_rule_ledger": (op7_rule_ledger, OP7_SQL),
    "op8_byte_bpe": (op8_byte_bpe, None),
    "op9_prefix_target": (op9_prefix_target, None),
    "op10_contextual_pii": (op10_contextual_pii, None),
    "op11_whitening": (op11_whitening, None),
    "op12_simhash_ball": (op12_simhash_ball, None),
    "op13_resident_lloyd": (op13_resident_lloyd, OP13_SQL),
}

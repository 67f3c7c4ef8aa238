"""From raw documents to token digests: the stages of a training corpus, each one operator.

Every stage takes (spark, docs, sf_dir), works on all of docs and returns a DataFrame; all but the
last keep the columns of documents, others included, whatever their names and types. `run` stores each
stage's result and reads it again. An empty table passes every stage as an empty one; whole texts are
read, however long; rows without an id, source or language are rows like others.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changetide.llm import bpe, langid, minhash, mixing, pii
from changetide.llm.queries import RANKS
from changetide.llm.scratch import stored, table

# The model, the hashes and the draws of the stages have no SQL form.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told.

    Rows with a null text or without a letter go, as do those told with little certainty. Repeated rows
    stay or go together. Rows without a language teach nothing; if none has one, all rows go."""
    return langid.accepted(docs, langid.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each group of near duplicates, repeated rows and rows without an id included."""
    return minhash.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data replaced by their kind; n_chars follows the text, and stays null where it was.

    Null and empty texts stay as they are. Repeated rows are rewritten alike."""
    cleaned = pii.redacted(docs, pii.findings(docs))
    if "n_chars" not in docs.columns:
        return cleaned
    kind = docs.schema["n_chars"].dataType
    length = F.when(F.col("n_chars").isNotNull(), F.coalesce(F.char_length("text").cast(kind), F.col("n_chars")))
    return cleaned.withColumn("n_chars", length)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    Null and wordless texts have no size and are left out. A null source is a source. Rows alike in id and
    text are taken equally often."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document, encoded and decoded; a null text is an empty one."""
    return bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("mix", mix),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs

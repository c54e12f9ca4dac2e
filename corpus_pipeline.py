"""Documents through five corpus operators: each stage gets what the one before it kept, as Parquet read again.

Cases, for every stage: null texts are empty ones; null ids and sources are values of their own; repeated rows are rows
of their own, but for the near-copies, of which one stays; columns beside those of documents pass through all stages but
the last, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import mixing, pieces, secrets, simhash, toxicity
from linkloom.llm.common import cut, table

#: A token array has no SQL form, nor has a learned score.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under 0.7; without labels the grammar's own weights hold. Empty texts stay."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.filter(F.col("toxic_score") < 0.7).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id (null ids come last, of equal ones the least hash of the text). Empty texts are one group."""
    return simhash.one_of_each(docs, simhash.near_duplicates(docs))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark and n_chars of the new text; null texts stay null, with a null n_chars."""
    clean = secrets.redact(secrets.scan(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not, once or twice. Texts without words have no size and follow their hash."""
    return mixing.mixed(docs)


def to_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text; null texts have no ids and decode to the empty text."""
    coded = pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("toxicity", without_toxic),
    ("simhash near-dedup", without_near_copies),
    ("secret scans", without_secrets),
    ("mixing", to_weights),
    ("sentencepiece", to_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs

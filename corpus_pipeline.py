"""A corpus from raw documents to packed sequences: quality rules, near-duplicates, personal data, source mix, packing.

Each stage takes (spark, docs, sf_dir), where docs is all that the stage before it kept, and returns a DataFrame; all but
the last return the columns of documents. A stage's result is written before the next one reads it.

Defined cases, for every stage: an empty table gives an empty result; columns beyond those of documents are handed through,
whatever their names; repeated rows are rows of their own, but for near-duplicates, which they are; texts of any length are
taken whole; no stage looks at an order of rows, so ties are decided by values alone.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelake.llm import jaccard, mixing, packing, pii, quality
from usagelake.llm.store import cut


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. Null and blank texts have no words and are rejected."""
    return quality.quality_filter(docs)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest id (of equal ids, of the smallest hash of the text):
    five-word shingles, Jaccard similarity of 0.8 or more. Null and blank texts have no shingles and all stay."""
    return jaccard.keep_one(docs, n=5, threshold=Fraction(4, 5))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, spans of personal data replaced by their kind; n_chars follows the text. A null text stays null."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, not at all if it has no words. A null source is one of its own; rows with equal ids
    are taken alike."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, as op9 returns them. A null or empty text is one piece of the end id; a document that the mix took
    several times has its pieces as often, each with a sequence id of its own."""
    import public_tokenizers

    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), "gaps")
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", keep_quality), ("near_duplicates", keep_distinct), ("personal_data", without_personal_data), ("mix", mix_sources), ("pack", pack_sequences)]

#: Hash-seeded selection and tokenization aren't SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

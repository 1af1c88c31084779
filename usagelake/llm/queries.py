"""The queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, jaccard, languages, licenses, mixing, packing, pii, quality, sql, substrings, tokenfile, urls, vectors, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    n, repeated = F.col("quality.n_words"), F.col("quality.n_repeat_words")
    base_failed = (n < 50) | (100 * repeated > 50 * n)
    counts = [F.col(f"quality.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return quality.judge(docs).select("doc_id", *counts, base_failed.alias("base_failed"), (~base_failed & F.col("quality.rejected_by").isNull()).alias("kept"))


def op2_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("spans")


#: The base rules, and words of hosts that the method adds.
URL_RULES = [*(urls.prefix_rule(r, v) for r, v in (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))), *map(urls.word_rule, ("casino", "pills", "porn", "spam", "viagra", "xxx"))]


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.measure(_table(spark, sf_dir, "documents"))


def op5_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokenfile.write(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), "words")
    return tokenfile.read(manifest).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), "gaps")
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(_table(spark, sf_dir, "documents"), n=3, threshold=Fraction(9, 10))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = [k.name for k in pii.KINDS if k.base]
    found = pii.find(_table(spark, sf_dir, "documents").select("doc_id", "text"), as_col="found")
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in base]
    digest = F.sha2(pii.joined(F.filter("found", lambda s: s["kind"].isin(base))).cast("binary"), 256)
    score = F.coalesce(F.array_max(F.transform("found", lambda s: s["score"])), F.lit(0.0))
    return found.select("doc_id", *counts, digest.alias("base_sha256"), pii.joined(F.col("found")).alias("spans"), F.size("found").cast("long").alias("n_spans"), score.alias("score"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    known = languages.learn(docs.where(~languages.held_out("doc_id")))
    found = languages.identify(docs.select("doc_id", "text"), known)
    return found.select("doc_id", languages.held_out("doc_id").alias("held_out"), F.col("lang").alias("lang_pred"), "score", "accepted")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {q.__name__: q for q in (op1_quality, op2_vectors, op3_licenses, op4_mixing, op5_tokenfile, op6_urls, op7_jaccard, op8_pii, op9_packing, op10_substrings, op11_whitening, op12_language, op13_alignment)}
ORACLE_SQL = sql.ORACLE_SQL

"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import ann, bpe, collocations, decontam, langid, lexical, pii, quality, sharding, simhash, sql, toxicity, warc, wordbpe

#: Key of the surrogates in the registered queries; a deployment passes its own secret.
PII_KEY = "registered-query"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    records = warc.fetch(warc.captures(pages), warc.archive(pages))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find(documents, _table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.sort_array(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(documents, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace(documents, PII_KEY, count="n_entities")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), stored=True)
    return judged.select("doc_id", "lang", "perplexity", "threshold", "keep")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.assess(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.interleave(_table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return wordbpe.digests(documents, public_tokenizers.path("word_bpe_49k.json"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_decontamination": op2_decontamination,
    "op3_simhash": op3_simhash,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_language": op5_language,
    "op6_pii_surrogates": op6_pii_surrogates,
    "op7_neighbours": op7_neighbours,
    "op8_quality": op8_quality,
    "op9_toxicity": op9_toxicity,
    "op10_sharding": op10_sharding,
    "op11_word_bpe": op11_word_bpe,
    "op12_collocations": op12_collocations,
    "op13_search": op13_search,
}

ORACLES: dict[str, str] = {
    "op1_warc": sql.WARC, "op2_decontamination": sql.DECONTAMINATION, "op12_collocations": sql.COLLOCATIONS, "op13_search": sql.SEARCH}

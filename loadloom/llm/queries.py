"""The registered queries of the operators on texts, pages and vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path
from . import (ctw, decontaminate, dialogue, idstore, mixing, negatives, packing, quality, simhash, tokens, topk, toxicity,
               urls, warc)
from .text import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(make):
    """Register under the function's name."""
    QUERIES[make.__name__] = make
    return make


@query
def op8_rule_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Rule bits of every document and the verdict of the default policy; length alone rejects none."""
    return quality.apply_policy(quality.ledger(table(spark, folder, "documents"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "fail_bits")


@query
def op5_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target",
                                   (F.col("copies") * F.col("size")).alias("taken"))


@query
def op7_url_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    return urls.judge(table(spark, folder, "pages"))


@query
def op10_golay_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query
def op1_toxic_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, folder, "labels")))


@query
def op2_elias_fano_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as token ids in binary shards, read back."""
    path = scratch_path(spark, "ids")
    return idstore.read_documents(idstore.write_ids(
        table(spark, folder, "documents"), path, tokens.vocabulary("byte_bpe_50k.json"), end_id=2))


@query
def op9_pattern_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in sequences of 2048 tokens."""
    return packing.pack(table(spark, folder, "documents"), tokens.vocabulary("word_bpe_49k.json"), end_id=0)


@query
def op3_zstd_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as WARC records, read back from the archives."""
    archives = warc.write_archives(table(spark, folder, "pages"), scratch_path(spark, "warc"))
    return warc.read_archives(archives, payloads=False).drop("url", "html")


@query
def op4_block_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """Ten best rows for every vector whose id is divisible by 100."""
    vectors = topk.integers(table(spark, folder, "embeddings"))
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0), k=10)


@query
def op6_context_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Unigram and context-tree scores of every document."""
    return ctw.language_model(table(spark, folder, "documents"))


@query
def op13_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark passages in every document."""
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op11_threshold_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 100; labels of every seventh id are one off."""
    vectors = table(spark, folder, "embeddings").withColumn(
        "label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    rows = negatives.integers(vectors)
    return negatives.hard_negatives(rows, rows.filter(F.col("vec_id") % 100 == 0))


@query
def op12_path_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults and cheapest repair of every conversation."""
    return dialogue.repair(table(spark, folder, "conversations"))

"""The queries that apply each operator of this subpackage, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import ans, decontam, deleted, extendible, langid, mixing, omh, pivots, rulefit, separators, workspace

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: In flat files the end must be an id that no text has: the first one past the vocabulary.
FLAT_END_ID = 49_408
SHARD_BYTES = 1 << 20


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace.table_path(spark, "rans")
    ans.write(table(spark, sf_dir, "documents"), path, tokenizer_path(), END_ID)
    return ans.read_digests(spark, path)


def op2_ipf_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", *mixing.DIMS, "n_tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "selected")


def op3_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separators.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), FLAT_END_ID)


def op5_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return extendible.shard(docs, SHARD_BYTES).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), *extendible.OUT)


def op6_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rulefit.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_hierarchical_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.classes(table(spark, sf_dir, "documents"))


def op8_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.search(table(spark, sf_dir, "embeddings"))


def op9_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deleted.score(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op2_ipf_mixing": mixing.sql(), "op3_positional_index": decontam.sql(), "op5_extendible_shards": extendible.sql(SHARD_BYTES), "op8_pivot_search": pivots.sql()}

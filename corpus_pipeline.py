"""A corpus pipeline of five of the operators in tessera.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
keep the columns of ``documents``. ``run`` writes what a stage returns as Parquet
to the shared folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontam, extendible, langid, mixing, omh, queries, workspace

#: Target shares are the observed ones to this power.
MIX_POWER = 0.9
#: Share of the tokens that the mix keeps.
MIX_KEEP = 0.9


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that is told; the others go."""
    return langid.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate class."""
    return omh.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no passage of a benchmark item occurs."""
    return decontam.keep_clean(docs, queries.table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by the raked weights of source, language and topic."""
    return mixing.sample(docs, keep=MIX_KEEP, power=MIX_POWER)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard."""
    return extendible.shard(docs, queries.SHARD_BYTES)


STAGES = [("language ID", language), ("near-duplicates", near_duplicates), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shards)]
#: Neither language ID nor alignment can be put in SQL; the tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = workspace.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

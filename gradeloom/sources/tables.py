"""Reading splits and named vectors, writing completions, summaries and shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_split(
    spark: SparkSession, path: str, split: str | None = None, fmt: str = "parquet", schema: str | None = None
) -> DataFrame:
    """A dataset, or one split of it. Written with ``split`` as partition column,
    other splits are never opened."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    return df if split is None else df.where(F.col("split") == split)


def append_json(df: DataFrame, path: str) -> None:
    """Completions or log records as JSON lines, added to what is there."""
    df.write.mode("append").json(path)


def write_summary(metrics: DataFrame, path: str, run_id: str, split: str) -> None:
    """Metrics of one run and split. An existing result is kept: writing it again fails."""
    metrics.withColumn("split", F.lit(split)).write.mode("errorifexists").json(
        f"{path}/run_id={run_id}/part={split}"
    )


def write_summaries(metrics: DataFrame, path: str, run_id: str) -> None:
    """Metrics of one run with their ``split``, all splits in one pass; an existing run is kept."""
    stored = metrics.withColumn("part", F.col("split"))
    stored.write.mode("errorifexists").partitionBy("part").json(f"{path}/run_id={run_id}")


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """All summaries below a path, with ``run_id`` and ``part`` from the folders."""
    return spark.read.json(path)


def write_shards(df: DataFrame, path: str, shard: str = "shard") -> None:
    """Named shards as folders, so that reading one shard opens only its files."""
    df.write.mode("errorifexists").partitionBy(shard).parquet(path)


def write_params(params: DataFrame, path: str) -> None:
    """Named vectors per owner: ``params(owner, name, values)``."""
    params.write.mode("errorifexists").partitionBy("owner").parquet(path)


def read_params(spark: SparkSession, path: str, owner: Column | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if owner is None else df.where(F.col("owner") == owner)


def labelled_union(sources: dict[str, DataFrame], question: dict[str, Column]) -> DataFrame:
    """Questions of differently shaped sources under one label each."""
    parts = [
        df.select(question[label].alias("question"), F.lit(label).alias("label"))
        for label, df in sources.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out

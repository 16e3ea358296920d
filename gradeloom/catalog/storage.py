"""Reading splits and writing results, shards and vectors: written tables read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.catalog.registry import query, table
from gradeloom.functions.extract import completion_body, explanation
from gradeloom.operators.reports import metric_bundle
from gradeloom.operators.splits import equal_shards
from gradeloom.session import new_folder
from gradeloom.sources import tables


@query("SELECT doc_id, source, n_chars FROM documents WHERE lang = 'fr'")
def named_split(spark: SparkSession, sf: str) -> DataFrame:
    """One split of a dataset stored with the split as partition column."""
    path = new_folder(spark, "named-split")
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars", F.col("lang").alias("split"))
    docs.write.partitionBy("split").parquet(path)
    return tables.read_split(spark, path, "fr").select("doc_id", "source", "n_chars")


@query(
    """
    SELECT page_id AS task_id, md5(html) AS completion, md5('see ' || url) AS explanation FROM pages
    UNION ALL SELECT doc_id, md5(text), md5('see ' || lang) FROM documents
    """
)
def completions_as_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Completions appended twice as JSON lines and read back whole."""
    path = new_folder(spark, "completions")
    pages = table(spark, sf, "pages").select(
        F.col("page_id").alias("task_id"), F.concat("html", F.lit("```see "), "url").alias("text")
    )
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("task_id"), F.concat("text", F.lit("```\nsee "), "lang").alias("text")
    )
    for part in (pages, docs):
        rows = part.select(
            "task_id",
            completion_body(F.col("text")).alias("completion"),
            explanation(F.col("text")).alias("explanation"),
        )
        tables.append_json(rows, path)
    stored = spark.read.schema("task_id bigint, completion string, explanation string").json(path)
    return stored.select("task_id", F.md5("completion").alias("completion"), F.md5("explanation").alias("explanation"))


@query(
    """
    WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS place FROM documents),
    size AS (SELECT count(*) // 11 AS n FROM documents)
    SELECT doc_id FROM p, size WHERE place // n = 3
    """
)
def stored_shard(spark: SparkSession, sf: str) -> DataFrame:
    """One of ten shards, read back by its folder."""
    path = new_folder(spark, "shards")
    docs = table(spark, sf, "documents").select("doc_id")
    tables.write_shards(equal_shards(docs, "doc_id", 42), path)
    return spark.read.parquet(path).where(F.col("shard") == 3).select("doc_id")


@query(
    """
    SELECT event_type AS split, unnest(['value/mean', 'value/std', 'value/min', 'value/max']) AS metric,
           round(unnest([avg(value), stddev_pop(value), min(value), max(value)]), 6) AS value
    FROM events GROUP BY event_type
    """
)
def stored_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Summaries of all splits next to each other under one run."""
    path = new_folder(spark, "summaries")
    events = table(spark, sf, "events")
    bundle = metric_bundle(events, F.col("value"), "value", ["event_type"])
    tables.write_summaries(bundle.withColumnRenamed("event_type", "split"), path, "run-1")
    stored = tables.read_summaries(spark, path)
    return stored.select("split", "metric", F.round("value", 6).alias("value"))


@query("SELECT vec_id::VARCHAR AS name, list_transform(embedding, v -> round(v::DOUBLE, 6) + 0.0) AS values FROM embeddings WHERE label = 4"
       .replace("v -> ", "lambda v: "))
def stored_params(spark: SparkSession, sf: str) -> DataFrame:
    """The vectors of one owner, from a table partitioned by owner."""
    path = new_folder(spark, "params")
    params = table(spark, sf, "embeddings").select(
        F.col("label").alias("owner"),
        F.col("vec_id").cast("string").alias("name"),
        F.col("embedding").cast("array<double>").alias("values"),
    )
    tables.write_params(params, path)
    mine = tables.read_params(spark, path, F.lit(4))
    return mine.select("name", F.transform("values", lambda v: F.round(v, 6)).alias("values"))

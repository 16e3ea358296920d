"""Run logs and contact rounds: text and JSON files read into rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONTACT_SCHEMA = "array<map<string,array<int>>>"
FLAT_OBJECT = r"\{[^{}]+\}"


def read_logs(spark: SparkSession, path: str, node_pattern: str = r"/([0-9]+)/") -> DataFrame:
    """Whole log files: (node, path, text), the node taken from the path."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    name = F.col("_metadata.file_path")
    node = F.nullif(F.regexp_extract(name, node_pattern, 1), F.lit("")).cast("int")
    return files.select(node.alias("node"), name.alias("path"), F.col("value").alias("text"))


def quote_names(block: Column) -> Column:
    """Quotes around bare member names. Also changes strings that hold ``, word:``."""
    return F.regexp_replace(block, r"([,{])\s*([A-Za-z0-9_]+)\s*:", '$1 "$2":')


def log_records(
    logs: DataFrame, schema: str, text: str = "text", repair: bool = False
) -> DataFrame:
    """One row per flat JSON object in a text: (..., pos, record, corrupt).

    Nested objects give their innermost parts. Blocks that are not JSON keep
    their text in ``corrupt`` instead of failing the job. Bare member names are
    read as they are; ``repair`` quotes them in the text first.
    """
    blocks = F.regexp_extract_all(F.col(text), F.lit(FLAT_OBJECT), F.lit(0))
    rest = [c for c in logs.columns if c != text]
    rows = logs.select(*rest, F.posexplode(blocks).alias("pos", "block"))
    read = quote_names(F.col("block")) if repair else F.col("block")
    options = {
        "allowUnquotedFieldNames": "true",
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": "_corrupt",
    }
    parsed = F.from_json(read, f"{schema}, _corrupt string", options)
    return rows.select(
        *rest, "pos", parsed.dropFields("_corrupt").alias("record"), parsed["_corrupt"].alias("corrupt")
    )


def corrupt_blocks(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """How many blocks could not be read."""
    return records.groupBy(*by).agg(
        F.count_if(F.col("corrupt").isNotNull()).alias("corrupt"), F.count(F.lit(1)).alias("blocks")
    )


def contact_edges(rounds: DataFrame, text: str = "text") -> DataFrame:
    """(..., round, node, neighbour) from a JSON list of maps.

    A node with an empty list stays, with a null neighbour.
    """
    rest = [c for c in rounds.columns if c != text]
    parsed = F.from_json(F.col(text), CONTACT_SCHEMA)
    per_round = rounds.select(*rest, F.posexplode(parsed).alias("round", "contacts"))
    per_node = per_round.select(*rest, "round", F.explode("contacts").alias("node", "neighbours"))
    return per_node.select(
        *rest,
        "round",
        F.col("node").cast("int").alias("node"),
        F.explode_outer("neighbours").alias("neighbour"),
    )


def read_contact_rounds(spark: SparkSession, path: str) -> DataFrame:
    """Contact graph per round from a JSON file."""
    return contact_edges(spark.read.text(path, wholetext=True).toDF("text"))


def chosen_checkpoint(paths: DataFrame, pick: str = "last", node: str = "node", path: str = "path") -> DataFrame:
    """The last (largest) or the first path of each node."""
    choose = {"last": F.max, "first": F.min}[pick]
    return paths.groupBy(node).agg(choose(path).alias(path))

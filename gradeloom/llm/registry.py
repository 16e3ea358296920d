"""The folder's registered queries, and small helpers that its operators share."""

from __future__ import annotations

import pickle
import sys
import types
import uuid
from collections.abc import Callable, Iterable

from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.session import new_folder

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL where SQL can express it."""

    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again.

    Unlike a checkpoint it carries nothing of the old plan along, which loops need: the
    constraints of a checkpointed plan are inferred anew in every round and multiply.
    """
    folder = new_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def beside(df: DataFrame, result: Column, fields: Iterable[str]) -> DataFrame:
    """``df`` with the fields of a struct column added; own columns of these names are replaced.

    The rows travel as one value meanwhile, so no name of theirs can clash with a working column.
    """
    names = list(fields)
    packed = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), result.alias("new"))
    own = [F.col("row")[c].alias(c) for c in df.columns if c not in names]
    return packed.select(*own, *[F.col("new")[n].alias(n) for n in names])


def hashed_sample(df: DataFrame, most: int, *keys: str) -> DataFrame:
    """About ``most`` rows of ``df``, those with the lowest hashes of ``keys``; all if there are no more.

    Rows are let through by a threshold from their number, so no task sends more than its share.
    """
    span = 1 << 40
    share = min(1.0, most / max(1, df.count()))
    return df.where(F.pmod(F.xxhash64(*keys), F.lit(span)) < F.lit(int(span * share)))


def once_per_worker(key: object, make: Callable[[], object]) -> object:
    """A value made once in a Python worker and kept for its later tasks.

    What no task of the running stage has asked for goes when a new value is made, so a worker
    that serves many stages holds what one of them needs. Functions go to the workers by value,
    so a module variable would not last.
    """
    store = sys.modules.setdefault("gradeloom_worker_values", types.ModuleType("gradeloom_worker_values"))
    values = store.__dict__.setdefault("values", {})  # key -> (stage that asked last, value)
    task = TaskContext.get()
    stage = task.stageId() if task else None
    if key not in values:
        for old in [k for k, (asked, _) in values.items() if asked != stage]:
            del values[old]
        value = make()
    else:
        value = values[key][1]
    values[key] = stage, value
    return value


def shared_value(spark: SparkSession, value: object) -> Callable[[], object]:
    """``value`` for the Python workers, sent once to each and made once in each.

    It travels with its class, as functions do, so workers need not have this package.
    """
    sent, key = spark.sparkContext.broadcast(cloudpickle.dumps(value)), uuid.uuid4().hex
    return lambda: once_per_worker(("shared", key), lambda: pickle.loads(sent.value))


#: Stands for a null id where ids go through pandas, which would make doubles of all of them.
NO_ID = -(1 << 63)


def without_null_ids(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.withColumn(key, F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)))


def with_null_ids(df: DataFrame, key: str = "doc_id") -> DataFrame:
    return df.withColumn(key, F.when(F.col(key) != NO_ID, F.col(key)))

"""Every registered query against its SQL, and the plans behind them."""

import re

import duckdb
import pytest
from conftest import SF

import __spark_entry__ as entry
from gradeloom import catalog
from tools.check_sql import TABLES, rows_of

QUERIES, SQL = catalog.QUERIES, catalog.SQL

# Python runs in these only: parsing code, and factoring matrices.
PYTHON = {
    "cleaned_code", "cleaning_report", "code_parses", "eval_code_details",
    "svd_reconstruct", "composed_matrix",
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    python = re.search(r"ArrowEvalPython|InPandas|BatchEvalPython", plan)
    assert bool(python) == (name in PYTHON)
    assert "BatchEvalPython" not in plan
    duck.execute(SQL[name])
    columns = [d[0] for d in duck.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, duck.fetchall())


@pytest.mark.parametrize(
    "name", ["parity_split", "seeded_split", "completion_numbers", "running_mean_reset", "mix_experts", "latex_equiv"]
)
def test_partitions_do_not_matter(spark, name):
    results = []
    for partitions in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << (27 if partitions == 1 else 14))
        df = QUERIES[name](spark, SF)
        results.append(rows_of(df.columns, [tuple(r) for r in df.collect()]))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 27)
    assert results[0] == results[1]


def test_only_needed_columns_are_read(spark):
    plan = QUERIES["sequence_loglik"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "l_shipdate" not in plan
    plan = QUERIES["chosen_split"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,fr)]" in plan
    assert re.search(r"ReadSchema: struct<doc_id:bigint,lang:string,source:string>", plan)


@pytest.mark.parametrize("name, steps", [("svd_reconstruct", 2), ("svd_energy", 0), ("composed_matrix", 2)])
def test_matrices_are_decomposed_once(spark, name, steps):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapCoGroupsInPandas") == steps


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["lang", "n", "acc"] and df.count() > 0

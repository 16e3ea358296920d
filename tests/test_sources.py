"""Files and folders: contact rounds, run logs, shards, summaries, vectors."""

import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from gradeloom.operators import runs
from gradeloom.sources import runlogs, tables


def test_contact_rounds(spark, tmp_path):
    path = tmp_path / "contacts.json"
    path.write_text(json.dumps([{"0": [1, 2], "1": []}, {"2": [0]}], indent=2))
    got = sorted(map(tuple, runlogs.read_contact_rounds(spark, str(path)).collect()), key=str)
    assert got == [(0, 0, 1), (0, 0, 2), (0, 1, None), (1, 2, 0)]


def test_run_logs(spark, tmp_path):
    for node in (0, 1):
        folder = tmp_path / "results" / str(node) / "run"
        folder.mkdir(parents=True)
        lines = [json.dumps({"iter": i, "loss": i + node / 2, "rewards/mean": None if i else 1.0}, indent=4) for i in range(3)]
        (folder / "log.json").write_text("\n".join(lines) + '\n{oops}\n{"b": {"iter": 7}}\n{iter: 8}')
    logs = runlogs.read_logs(spark, str(tmp_path / "results"))
    schema = "iter bigint, loss double, `rewards/mean` double"
    records = runlogs.log_records(logs, schema)
    assert sorted(map(tuple, runlogs.corrupt_blocks(records, ["node"]).collect())) == [(0, 1, 6), (1, 1, 6)]
    good = records.where("corrupt is null").select("node", "path", "pos", "record.*")
    inner = good.where("node = 0 and pos = 4").first()
    assert inner.iter == 7
    assert good.where("node = 0 and pos = 5").first().iter == 8
    series = sorted(map(tuple, runs.step_series(good, "loss").where("node = 1").collect()))
    assert series == [(1, 0, 0.5, True), (1, 1, 1.5, False), (1, 2, 2.5, False)]
    means = runs.step_series(good, "rewards/mean").where("node = 0").collect()
    assert [(r.step, r.value) for r in means] == [(0, 1.0)]


def test_quoting_names(evaluate):
    assert evaluate(runlogs.quote_names, ['{a: 1, b : "x"}']) == ['{ "a": 1, "b": "x"}']


def test_chosen_checkpoint(spark):
    df = spark.createDataFrame([(0, "a/1"), (0, "a/2"), (1, "b/1")], "node int, path string")
    assert dict(map(tuple, runlogs.chosen_checkpoint(df).collect())) == {0: "a/2", 1: "b/1"}
    assert dict(map(tuple, runlogs.chosen_checkpoint(df, "first").collect())) == {0: "a/1", 1: "b/1"}


def test_splits_are_pruned(spark, tmp_path):
    path = str(tmp_path / "d")
    spark.range(10).withColumn("split", F.when(F.col("id") < 4, "train").otherwise("test")).write.partitionBy("split").parquet(path)
    train = tables.read_split(spark, path, "train")
    assert train.count() == 4 and len(train.inputFiles()) >= 1
    plan = train._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    assert tables.read_split(spark, path).count() == 10


def test_results_are_never_overwritten(spark, tmp_path):
    metrics = spark.createDataFrame([("acc", 0.5)], "metric string, value double")
    path = str(tmp_path / "summary")
    tables.write_summary(metrics, path, "r1", "test")
    tables.write_summary(metrics, path, "r1", "transfer")
    with pytest.raises(AnalysisException):
        tables.write_summary(metrics, path, "r1", "test")
    assert {r.split for r in tables.read_summaries(spark, path).collect()} == {"test", "transfer"}


def test_lines_are_appended(spark, tmp_path):
    path = str(tmp_path / "lines")
    for i in (1, 2):
        tables.append_json(spark.createDataFrame([(i, "text\nmore")], "task_id int, completion string"), path)
    assert {(r.task_id, r.completion) for r in spark.read.json(path).collect()} == {(1, "text\nmore"), (2, "text\nmore")}


def test_shards_and_params(spark, tmp_path):
    path = str(tmp_path / "p")
    params = spark.createDataFrame([(0, "a", [1.0]), (1, "a", [2.0])], "owner int, name string, values array<double>")
    tables.write_params(params, path)
    assert tables.read_params(spark, path, F.lit(1)).first()["values"] == [2.0]
    shards = str(tmp_path / "s")
    tables.write_shards(params.withColumn("shard", F.col("owner")), shards)
    assert spark.read.parquet(shards).where("shard = 0").count() == 1


def test_labelled_union(spark):
    a = spark.createDataFrame([("q",)], "question string")
    b = spark.createDataFrame([("i", 1)], "instruction string, n int")
    got = tables.labelled_union({"math": a, "code": b}, {"math": F.col("question"), "code": F.col("instruction")})
    assert sorted(map(tuple, got.collect())) == [("i", "code"), ("q", "math")]

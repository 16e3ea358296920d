"""Positions, ranks and running values against brute force, with hot groups."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gradeloom.operators import positions as P
from gradeloom.operators import reports, runs


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds two thirds of all rows; some groups are null."""
    rng = random.Random(5)
    orders = rng.sample(range(10_000), 900)
    rows = [
        (None if i % 50 == 7 else "hot" if i % 3 else f"g{i % 11}", o, rng.choice([None, rng.randint(-9, 9)]))
        for i, o in enumerate(orders)
    ]
    return rows, spark.createDataFrame(rows, "g string, o bigint, v int").repartition(7)


def _grouped(rows):
    groups = defaultdict(list)
    for g, o, v in sorted(rows, key=lambda r: r[1]):
        groups[g].append((o, v))
    return groups


@pytest.mark.parametrize("width, levels", [(1, 1), (64, 1), (1 << 20, 1), (1, 2), (30, 2), (8, 3)])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running_sum_and_max(skewed, width, levels, inclusive):
    rows, df = skewed
    values = {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}
    got = P.running(df, ["g"], ["o"], values, width=width, inclusive=inclusive, levels=levels)
    want = {}
    for g, entries in _grouped(rows).items():
        for i, (o, _) in enumerate(entries):
            seen = [v for _, v in entries[: i + inclusive] if v is not None]
            want[g, o] = (sum(seen), max(seen)) if seen else (None, None)
    assert {(r.g, r.o): (r.s, r.m) for r in got.collect()} == want


def test_positions_in_groups_and_overall(skewed):
    rows, df = skewed
    want = {(g, o): i for g, entries in _grouped(rows).items() for i, (o, _) in enumerate(entries)}
    got = P.with_position(df, ["o"], ["g"], width=100).collect()
    assert {(r.g, r.o): r.ordinal for r in got} == want
    overall = P.with_position(df, ["o"], width=100).collect()
    assert [r.ordinal for r in sorted(overall, key=lambda r: r.o)] == list(range(len(rows)))


def test_rows_without_an_order_are_kept(spark):
    df = spark.createDataFrame([("a", None), ("a", 5), ("a", 3)], "g string, o bigint")
    got = P.with_position(df, ["o"], ["g"], width=1).collect()
    assert sorted((r.ordinal, r.o) for r in got) == [(0, None), (1, 3), (2, 5)]


def test_sort_position_on_texts_and_doubles(spark):
    rows = [(f"k{i % 13}", (i * 37 % 101) / 7) for i in range(500)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "k string, x double, n int")
    got = P.with_sort_position(df.repartition(5), [F.desc("k"), F.col("x"), F.col("n")]).collect()
    want = sorted(range(500), key=lambda i: (rows[i][1], i))
    want.sort(key=lambda i: rows[i][0], reverse=True)
    assert [r.n for r in sorted(got, key=lambda r: r.ordinal)] == want


def test_sort_position_in_groups(skewed):
    rows, df = skewed
    want = {(g, o): i for g, entries in _grouped(rows).items() for i, (o, _) in enumerate(entries)}
    got = P.with_sort_position(df, [F.col("o")], "n", ["g"]).collect()
    assert {(r.g, r.o): r.n for r in got} == want


def test_hash_position_is_a_permutation_and_ignores_partitions(spark):
    df = spark.range(3000)
    one, many = (
        {r.id: r.ordinal for r in P.with_hash_position(df.repartition(n), "id", 3).collect()} for n in (1, 9)
    )
    assert one == many
    assert sorted(one.values()) == list(range(3000))
    other = {r.id: r.ordinal for r in P.with_hash_position(df, "id", 4).collect()}
    assert other != one


@pytest.mark.parametrize("width", [1, 40, 3000])
def test_hash_blocks_follow_the_rows(spark, width, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_ROWS", 64)
    seen, original = [], P.running

    def watched(df, group, order, values, block, *rest, **more):
        if "_digest" in df.columns:
            seen.extend(r["count"] for r in df.groupBy(block.alias("b")).count().collect())
        return original(df, group, order, values, block, *rest, **more)

    want = {r.id: r.ordinal for r in P.with_hash_position(spark.range(1500), "id", 3).collect()}
    monkeypatch.setattr(P, "running", watched)
    got = {r.id: r.ordinal for r in P.with_hash_position(spark.range(1500), "id", 3, width=width).collect()}
    assert got == want and sum(seen) == 1500
    assert max(seen) <= max(2 * width, 4)


ORDERS = {
    "dense": "id",
    "hashed": "xxhash64(id)",
    "far": "if(id % 2 = 0, id - 9223372036854775807, 9223372036854775807 - id)",
    "crowded": "if(id < 10, id * 100000000000, 500000000000 + id)",
    "equal": "7",
}


@pytest.mark.parametrize("kind", sorted(ORDERS))
def test_blocks_from_data(spark, kind):
    df = spark.range(20_000).selectExpr(f"{ORDERS[kind]} as o")
    blocks = df.select("o", P.data_blocks(df, "o", width=500).alias("b")).groupBy("b").agg(
        F.count("*").alias("n"), F.min("o").alias("low"), F.max("o").alias("high")
    ).orderBy("b").collect()
    assert all(a.high < b.low for a, b in zip(blocks, blocks[1:]))
    if kind in ("dense", "hashed"):
        assert len(blocks) <= 4 * 20_000 / 500 + 2
    if kind in ("dense", "hashed", "far"):
        assert max(r.n for r in blocks) <= 1000


def test_a_million_hashed_orders(spark):
    """Sparse orders give few blocks, and none with many rows."""
    df = spark.range(1_000_000).selectExpr("xxhash64(id) as o")
    width = 1 << 14
    counts = df.groupBy(P.data_blocks(df, "o", width).alias("b")).count().collect()
    assert len(counts) <= 4 * 1_000_000 / width + 2 and max(r["count"] for r in counts) <= 2 * width


def test_attempts_with_sparse_ordinals(spark, monkeypatch):
    monkeypatch.setattr(reports, "data_blocks", lambda df, order: P.data_blocks(df, order, width=16, cells=8))
    rows = [("hot" if i % 3 else f"t{i % 7}", (i * 7919 % 1009) ** 5 - 10**9) for i in range(800)] + [("t0", None)]
    df = spark.createDataFrame(rows, "task string, o bigint")
    got = {(r.task, r.o): r.completion_id for r in reports.numbered_attempts(df, "task", "o").collect()}
    want = {}
    for task in {t for t, _ in rows}:
        mine = sorted((o for t, o in rows if t == task), key=lambda o: (o is not None, o or 0))
        want |= {(task, o): i for i, o in enumerate(mine)}
    assert got == want


@pytest.mark.parametrize("salts", [1, 8])
def test_first_k_per_group(skewed, salts):
    rows, df = skewed
    got = P.first_k_per_group(df, ["g"], ["o"], 5, salts).collect()
    want = {(g, o) for g, entries in _grouped(rows).items() for o, _ in entries[:5]}
    assert {(r.g, r.o) for r in got} == want


def test_first_k_limits_before_the_shuffle(skewed):
    plan = P.first_k_per_group(skewed[1], ["g"], ["o"], 5)._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_best_so_far(spark):
    rows = [(0, 0.0, 0.9), (1, 0.3, 0.5), (2, 0.3, 0.6), (3, 0.2, 0.7), (4, None, 0.1), (5, float("nan"), 0.2)]
    df = spark.createDataFrame([(7, *r) for r in rows] + [(8, 0, 0.0, 0.4)], "run int, step bigint, valid_acc double, test_acc double")
    for width in (1, 2, 1 << 20):
        got = sorted(runs.best_so_far(df, ["run"], "step", width=width).collect())
        assert [r.best_val_acc for r in got] == [0, 0.3, 0.3, 0.3, 0.3, 0.3, 0]
        assert [r.test_at_best_val for r in got] == [0, 0.5, 0.5, 0.5, 0.5, 0.5, 0]


def test_best_so_far_carries_transfer(spark):
    df = spark.createDataFrame([(0, 0.1, 0.2, 0.3), (1, 0.4, 0.5, 0.6)], "step bigint, valid_acc double, test_acc double, transfer_acc double")
    got = sorted(runs.best_so_far(df, [], "step", carried=["test_acc", "transfer_acc"]).collect())
    assert [r.transfer_at_best_val for r in got] == [0.3, 0.6]


def _running_mean(rows, bias=1e-8):
    total, count, latest, out = 0.0, bias, 0.0, []
    for value, reset, is_set in rows:
        if is_set:
            total, count = value, 1.0
        elif value is not None:
            total, count = total + value, count + 1
        if count >= 1:
            latest = total / count
        out.append(latest)
        if reset:
            total, count = 0.0, bias
    return out


@pytest.mark.parametrize("width", [3, 50, 1 << 20])
def test_running_mean(spark, width):
    rng = random.Random(11)
    per_metric = {
        m: [
            (None if rng.random() < 0.4 else rng.random(), rng.random() < 0.15, False)
            for _ in range(120)
        ]
        for m in ("loss", "kl")
    }
    sets = per_metric["kl"]
    per_metric["kl"] = [(v, r, v is not None and i % 9 == 0) for i, (v, r, _) in enumerate(sets)]
    rows = [(m, i, *r) for m, entries in per_metric.items() for i, r in enumerate(entries)]
    df = spark.createDataFrame(rows, "metric string, seq bigint, value double, reset boolean, is_set boolean")
    got = runs.running_mean(df, ["metric"], "seq", sets="is_set", width=width).collect()
    for metric, entries in per_metric.items():
        ours = [r.running_mean for r in sorted(got, key=lambda r: r.seq) if r.metric == metric]
        assert ours == pytest.approx(_running_mean(entries), abs=1e-12)


def test_step_series(spark):
    rows = [(0, "b", 0, 0, 1.0), (0, "a", 0, 0, None), (0, "a", 1, 2, 3.0), (1, "a", 0, 1, 5.0)]
    df = spark.createDataFrame(rows, "node int, path string, pos int, iter int, loss double")
    got = sorted(map(tuple, runs.step_series(df, "loss").collect()))
    assert got == [(0, 1, 3.0, False), (0, 2, 1.0, True), (1, 0, 5.0, False)]

"""Splits are disjoint and complete, samples exact, results independent of partitions."""

import pytest
from pyspark.sql import functions as F

from gradeloom.operators import joins as J
from gradeloom.operators import splits as S
from gradeloom.operators.positions import chunk_of
from gradeloom.plans.spec import TASKS, few_shot


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(25).withColumn("ordinal", F.col("id")).repartition(3)


def test_equal_shards_leave_the_rest_out(rows):
    got = S.equal_shards(rows.select("id"), "id", 42, n_parts=11, n_keep=10).collect()
    sizes = [sum(r.shard == s for r in got) for s in range(10)]
    assert len({r.id for r in got}) == 20 and sizes == [2] * 10
    with pytest.raises(ValueError):
        S.equal_shards(rows.limit(5), "id", 42)


def test_cap_is_one_less(spark):
    df = spark.range(500).select(F.lit("s").alias("source"), F.col("id"))
    kept = S.cap_per_source(df, "source", "id", 400)
    assert kept.agg(F.count("id"), F.max("id")).first() == (399, 398)


def test_tail_holdout(rows):
    got = {r.id: r.split for r in S.tail_holdout(rows, 10, 3).collect()}
    assert got == {i: "valid" if i >= 7 else "train" for i in range(10)}
    with pytest.raises(ValueError):
        S.tail_holdout(rows, 26)


def test_repeated_positions_repeat_rows(rows, spark):
    picks = spark.createDataFrame([(3,), (3,), (99,)], "ordinal bigint")
    assert [r.id for r in S.pick_positions(rows, picks).collect()] == [3, 3]
    assert S.pick_positions(rows, None).count() == 25


def test_seeded_split_is_complete(rows):
    for n in (1, 7):
        split = S.seeded_split(rows.select("id").repartition(n), "id", 16, 7).collect()
        chosen = sorted(r.id for r in split if r.split == "train")
        assert len(split) == 25 and len(chosen) == 7
        first = chosen if n == 1 else first
        assert chosen == first


def test_parts_of_position_splits(rows):
    place = F.col("ordinal")
    got = rows.select(
        "ordinal",
        S.parity_split(place).alias("half"),
        S.parity_position(place).alias("in_half"),
        S.four_to_one_split(place).alias("part"),
        S.four_to_one_position(place).alias("in_part"),
    ).collect()
    for split, inner in (("half", "in_half"), ("part", "in_part")):
        for name in {r[split] for r in got}:
            places = [r[inner] for r in sorted(got, key=lambda r: r.ordinal) if r[split] == name]
            assert places == list(range(len(places)))


@pytest.mark.parametrize("n, size", [(25, 10), (25, 25), (25, 99), (2, 1), (1, 4), (1013, 200)])
def test_step_batches_never_repeat(spark, n, size):
    df = spark.range(n).withColumn("ordinal", F.col("id"))
    steps = spark.range(12).withColumnRenamed("id", "step")
    got = S.step_batches(df, steps, size, 5).collect()
    drawn = {}
    for r in got:
        drawn.setdefault(r.step, []).append(r.id)
    assert len(drawn) == 12
    assert all(len(ids) == len(set(ids)) == min(size, n) for ids in drawn.values())
    if n > 100:
        assert len({tuple(sorted(ids)) for ids in drawn.values()}) == 12


def test_random_batch(rows):
    def drawn(df, size, step):
        batch = S.random_batch(df, size, 3, step).orderBy("draw").collect()
        return [r.id for r in batch]

    one = drawn(rows, 6, 1)
    assert len(set(one)) == 6 and one == drawn(rows.repartition(5), 6, 1) and one != drawn(rows, 6, 2)
    assert sorted(drawn(rows, 99, 0)) == sorted(r.id for r in rows.collect())
    steps = rows.sparkSession.range(4).select(F.col("id").alias("step"))
    batches = S.step_batches(rows, steps, 6, 3).where("step = 1").orderBy("draw").collect()
    assert [r.id for r in batches] == one


def test_draws_are_random(spark):
    """Pairs of positions meet about equally often, and no step walks in constant strides."""
    steps = spark.range(3000).select(F.col("id").alias("step"))
    batches = {}
    for r in S.step_draws(11, steps, 4, 9).collect():
        batches.setdefault(r.step, {})[r.draw] = r.ordinal
    pairs, strides = {}, 0
    for batch in batches.values():
        places = [batch[i] for i in range(4)]
        strides += len({(b - a) % 11 for a, b in zip(places, places[1:])}) == 1
        for i, a in enumerate(places):
            for b in places[:i]:
                pairs[min(a, b), max(a, b)] = pairs.get((min(a, b), max(a, b)), 0) + 1
    expected = 3000 * 6 / 55
    assert len(pairs) == 55 and all(0.7 * expected < n < 1.3 * expected for n in pairs.values())
    assert strides < 120


def test_choose_split_and_overlap(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "b")], "k int, split string")
    assert S.split_overlap(df, "k", "a", "b").first().overlap == 1
    with pytest.raises(ValueError):
        S.choose_split(df, "c", {"a": "acc"})


def test_requests_and_chunks(rows):
    repeated = J.repeat_requests(rows, 3)
    assert repeated.groupBy("id").count().where("count <> 3").isEmpty()
    sizes = rows.groupBy(chunk_of(F.col("ordinal"), 10).alias("c")).count().collect()
    assert sorted(map(tuple, sizes)) == [(0, 10), (1, 10), (2, 5)]


def test_task_splits(spark):
    df = spark.range(410).select(F.col("id").alias("task_id"), F.col("id").alias("ordinal"))
    counts = dict(map(tuple, TASKS["mbpp"].split(df).groupBy("split").count().collect()))
    assert counts == {"train": 200, "valid": 100, "test": 110}
    counts = dict(map(tuple, TASKS["category"].split(df).groupBy("split").count().collect()))
    assert counts == {"train": 164, "valid": 164, "test": 82}
    rows = df.select(F.col("task_id").alias("sample_id"), F.lit("test").alias("split"))
    counts = dict(map(tuple, few_shot("math").split(rows).groupBy("split").count().collect()))
    assert counts == {"train": 5, "valid": 405}
    with pytest.raises(ValueError):
        few_shot("math", "transfer")

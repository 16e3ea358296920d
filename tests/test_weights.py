"""Vector tables, matrices and populations: golden values and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.functions import vectors as V
from gradeloom.operators import matrices, population, ranking, weights

PARAMS = "node int, name string, values array<double>"
EDGES = "round int, node int, neighbour int"


def _state(df):
    return {(r.node, r.name): list(r["values"]) for r in df.collect()}


def test_masks(spark):
    df = spark.createDataFrame([([0.0, 2.0],)], "v array<double>")
    row = df.select(V.sigmoid_mask(F.col("v"), 1.0), V.soft_mask(F.lit(4), F.lit(0.3))).first()
    assert row[0] == [0.5, 1 / (1 + math.exp(-2))]
    assert row[1] == pytest.approx([1.0, 0.2, 0.0, 0.0])


def test_exchange_golden(spark):
    params = spark.createDataFrame([(0, "w", [1.0]), (1, "w", [3.0]), (2, "w", [5.0])], PARAMS)
    edges = spark.createDataFrame([(0, 0, 1), (0, 0, 2), (0, 1, None)], EDGES)
    assert _state(weights.exchanged(params, edges)) == {(0, "w"): [2.0], (1, "w"): [3.0], (2, "w"): [5.0]}


def test_exchange_keeps_the_mean_on_a_regular_graph(spark):
    rng = np.random.default_rng(1)
    rows = [(n, name, rng.normal(size=size).tolist()) for n in range(6) for name, size in (("a", 150), ("b", 3))]
    params = spark.createDataFrame(rows, PARAMS)
    ring = [(r, n, (n + d) % 6) for r in range(3) for n in range(6) for d in (1, 5)]
    got = _state(weights.exchange_rounds(params, spark.createDataFrame(ring, EDGES), 3))
    want = {(n, name): np.array(v) for n, name, v in rows}
    for _ in range(3):
        want = {
            (n, k): v + 0.5 / 3 * sum(want[(n + d) % 6, k] - v for d in (1, 5)) for (n, k), v in want.items()
        }
    for key, values in want.items():
        assert got[key] == pytest.approx(values.tolist())
    for name in "ab":
        before = np.mean([v for _, k, v in rows if k == name], axis=0)
        assert np.mean([v for (_, k), v in got.items() if k == name], axis=0) == pytest.approx(before)


def test_training_between_rounds(spark):
    params = spark.createDataFrame([(0, "w", [1.0]), (1, "w", [3.0])], PARAMS)
    edges = spark.createDataFrame([(0, 0, 1), (1, 1, 0)], EDGES)

    def train(state, number):
        return state.withColumn("values", F.transform("values", lambda v: v + number))

    got = _state(weights.exchange_rounds(params, edges, 2, 1.0, train))
    # Round 0: node 0 moves to 2. Round 1: both gain 1, then node 1 moves to 3.5.
    assert got == {(0, "w"): [3.0], (1, "w"): [3.5]}


def test_mix_identity_and_shared_weights(spark):
    vector = [float(i) for i in range(130)]
    rows = [(0, "a", vector), (1, "a", [2 * v for v in vector]), (0, "b", [1.0]), (1, "b", [3.0])]
    params = spark.createDataFrame(rows, "expert int, name string, values array<double>")
    one = spark.createDataFrame([(0, "a", 1.0), (0, "b", 1.0)], "expert int, name string, weight double")
    got = {r.name: list(r["values"]) for r in weights.mixed(params, one).collect()}
    assert got == {"a": vector, "b": [1.0]}
    shared = spark.createDataFrame([(0, 1.0), (1, 3.0)], "expert int, weight double")
    shares = weights.normalized_coefficients(shared.withColumn("name", F.lit("x"))).drop("name")
    got = {r.name: list(r["values"]) for r in weights.mixed(params, shares, shared=True).collect()}
    assert got["b"] == [2.5] and got["a"] == pytest.approx([1.75 * v for v in vector])


def test_default_coefficients(spark):
    names = spark.createDataFrame([("a",), ("b",)], "name string")
    got = weights.default_coefficients(names, [3, 4, 5, 6]).collect()
    assert len(got) == 8 and {r.weight for r in got} == {0.25}


def test_init_vectors(spark):
    shapes = spark.createDataFrame([("a", 40, 9000), ("b", 3, 2)], "name string, rows int, cols int")
    got = {r.name: r["values"] for r in weights.init_vectors(shapes, 0.1, 1).collect()}
    assert len(got["a"]) == 40 and len(got["b"]) == 2
    assert abs(np.mean(got["a"]) - 0.1) < 0.01 and 0.005 < np.std(got["a"]) < 0.02


def test_random_numbers(spark):
    df = spark.range(4000).select(V.uniform(1, F.col("id")).alias("u"), V.gaussian(1, F.col("id")).alias("g"))
    u, g = np.array([tuple(r) for r in df.collect()]).T
    assert 0 < u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.03
    assert abs(g.mean()) < 0.06 and abs(g.std() - 1) < 0.05


@pytest.fixture(scope="module")
def matrix_rows(spark):
    rng = np.random.default_rng(2)
    tall = rng.normal(size=(300, 5))
    low_rank = np.outer(np.arange(1.0, 31), [1.0, 2, 3])
    mats = {"mlp.tall": tall, "mlp.wide": rng.normal(size=(3, 40)), "attn.low": low_rank}
    rows = [(k, i, r.tolist()) for k, m in mats.items() for i, r in enumerate(m)]
    return mats, spark.createDataFrame(rows, "name string, row bigint, values array<double>")


@pytest.mark.parametrize("block", [7, 4096])
def test_decomposition(matrix_rows, block):
    mats, df = matrix_rows
    parts = matrices.decompose(df, block)
    got = parts.singular.collect()
    for r in got:
        want = np.linalg.svd(mats[r.name], compute_uv=False)
        assert list(r["values"]) == pytest.approx(want.tolist(), abs=1e-9)
    again = matrices.reconstruct(parts, block).collect()
    assert len(again) == 333
    assert max(np.abs(np.array(r["values"]) - mats[r.name][r.row]).max() for r in again) < 1e-9


def _stored(spark, mats):
    rows = [(name, i, [float(v) for v in row]) for name, m in mats.items() for i, row in enumerate(m)]
    return spark.createDataFrame(rows, "name string, row bigint, values array<double>").repartition(5)


def _whole(df):
    found = {}
    for r in sorted(df.collect(), key=lambda r: r.row):
        found.setdefault(r.name, []).append(list(r["values"]))
    return {name: np.array(rows) for name, rows in found.items()}


@pytest.mark.parametrize("block", [8, 4096])
def test_factors_are_orthogonal(spark, block):
    """Ill-conditioned, wide and deficient matrices: both sides orthogonal, the product exact."""
    rng = np.random.default_rng(3)

    def made(m, n, s):
        u, v = (np.linalg.qr(rng.normal(size=(k, len(s))))[0] for k in (m, n))
        return (u * s) @ v.T

    mats = {
        "ill": made(120, 12, np.logspace(0, -10, 12)),
        "wide": made(9, 200, np.logspace(0, -10, 9)),
        "square": made(30, 30, np.logspace(3, -7, 30)),
        "low": made(60, 8, np.array([3.0, 2.0, 1e-3])),
        "row": rng.normal(size=(1, 70)),
        "none": np.zeros((5, 3)),
    }
    parts = matrices.decompose(_stored(spark, mats), block)
    left, right = _whole(parts.left), _whole(parts.right)
    singular = {r.name: np.array(r["values"]) for r in parts.singular.collect()}
    assert {name: len(s) for name, s in singular.items()} == {name: min(m.shape) for name, m in mats.items()}
    for name, m in mats.items():
        u, s, v = left[name], singular[name], right[name]
        assert u.shape == (m.shape[0], len(s)) and v.shape == (m.shape[1], len(s))
        rank = int((s > s.max() * 1e-13).sum())
        for side in (u, v):
            assert np.abs(side[:, :rank].T @ side[:, :rank] - np.eye(rank)).max(initial=0) < 1e-10
        assert np.abs((u * s) @ v.T - m).max() <= 1e-13 * max(1.0, s.max()) * 10
    again = _whole(matrices.reconstruct(parts, block).where("name <> 'none'"))
    for name in ("ill", "wide", "row"):
        assert np.abs(again[name] - mats[name]).max() < 1e-11


def test_single_precision_entries_come_back_exactly(spark):
    """Odd multiples of 1/128 are ties at six digits: their last bits decide what they are rounded to."""
    rng = np.random.default_rng(4)
    mat = ((2 * rng.integers(-40, 40, size=(200, 12)) + 1) / 128).astype("float32")
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(mat)]
    df = spark.createDataFrame(rows, "row bigint, values array<float>").withColumn("name", F.lit("a"))
    again = matrices.reconstruct(matrices.decompose(df, 64))
    assert again.schema["values"].dataType.simpleString() == "array<float>"
    assert (_whole(again)["a"] == mat).all()


def test_wide_triangles_merge_in_pairs(spark, monkeypatch):
    monkeypatch.setattr(matrices, "MERGE_NUMBERS", 10)
    m = np.random.default_rng(4).normal(size=(300, 6))
    singular = matrices.decompose(_stored(spark, {"m": m}), 10).singular.first()["values"]
    assert singular == pytest.approx(np.linalg.svd(m, compute_uv=False).tolist())


def test_compose(matrix_rows, spark):
    mats, df = matrix_rows
    parts = matrices.decompose(df, 64)
    mask = [0.5, 1.0, 0.25, 2.0, 0.0]
    masks = spark.createDataFrame(
        [("mlp.tall", mask), ("mlp.wide", [0.0] * 3), ("attn.low", [1.0] * 3)], "name string, values array<double>"
    )
    composed = matrices.compose(parts, masks, 64)
    u, s, vt = np.linalg.svd(mats["mlp.tall"], full_matrices=False)
    want = (u * (s * mask)) @ vt * (s.sum() / (s * mask).sum())
    rows = composed.collect()
    tall = {r.row: r["values"] for r in rows if r.name == "mlp.tall"}
    assert max(np.abs(np.array(tall[i]) - want[i]).max() for i in range(300)) < 1e-9
    wide = [r for r in rows if r.name == "mlp.wide"]
    assert len(wide) == 3 and all(r.degenerate and r["values"] is None for r in wide)
    applied = {(r.name, r.row): r["values"] for r in matrices.apply_composed(df, composed).collect()}
    assert applied["attn.low", 4] == pytest.approx(mats["attn.low"][4].tolist())
    assert applied["mlp.tall", 4] == pytest.approx(want[4].tolist())


def test_best_member_ties(spark):
    perf = spark.createDataFrame([(0, 0.5, -3.0), (1, 0.7, -2.0), (2, 0.7, -1.0)], "member int, perf double, mean_ll double")
    assert ranking.best_member(perf).first().member == 1
    assert ranking.best_member_by_likelihood(perf).first().member == 2
    assert [r.member for r in ranking.elites(perf, 0.34).collect()] == [1]
    with pytest.raises(ValueError):
        ranking.elites(perf, 0.2)


def test_elite_moments_and_blend(spark):
    pop = spark.createDataFrame([(m, i, float(m * 10 + i)) for m in range(4) for i in range(2)], "member int, i int, value double")
    one = population.elite_moments(pop, pop.select("member").where("member = 3")).orderBy("i").collect()
    assert [(r.mean, r.std) for r in one] == [(30.0, None), (31.0, None)]
    two = population.elite_moments(pop, pop.select("member").where("member > 1").distinct())
    first = two.orderBy("i").first()
    assert first.mean == 25.0 and first.std == pytest.approx(math.sqrt(50))
    old = spark.createDataFrame([(0, 5.0, 1.0), (1, 5.0, 1.0)], "i int, mean double, std double")
    assert population.blended_moments(two, old, 0.2).orderBy("i").first().mean == pytest.approx(21.0)


def test_populations(spark):
    moments = spark.createDataFrame([(i, 0.0, 0.5, 9.0) for i in range(200)], "i int, mean double, std double, best double")
    drawn = population.gaussian_population(moments, 10, -0.6, 0.6, 3)
    assert drawn.where("member = 0 and value <> 9").isEmpty()
    rest = [r.value for r in drawn.where("member > 0").collect()]
    assert len(rest) == 1800 and min(rest) == -0.6 and max(rest) == 0.6
    same = population.gaussian_population(moments.repartition(7), 10, -0.6, 0.6, 3)
    assert sorted(same.collect()) == sorted(drawn.collect())


def test_member_likelihood(spark):
    members = spark.createDataFrame([(0,), (1,)], "member int")
    lls = spark.createDataFrame([(0, -1.0, True), (0, -3.0, True), (1, -5.0, False)], "member int, mean_lp double, correct boolean")
    got = dict(map(tuple, population.member_likelihood(members, lls).collect()))
    assert got == {0: -2.0, 1: 0.0}


@pytest.mark.parametrize("width", [1, 4, 64, 1024])
def test_flatten_and_split(spark, width):
    lengths = [3, 0, 70, 1, 1, 1, 1, 0, 9]
    rows = [
        (o, p, f"n{9 - p}", [float(p * 100 + i) for i in range(n)]) for o in "op" for p, n in enumerate(lengths)
    ]
    params = spark.createDataFrame(rows, "owner string, position int, name string, values array<double>")
    flat = weights.flattened(params, width)
    pieces = flat.where("owner = 'o'").orderBy("first").collect()
    assert [v for r in pieces for v in r["values"]] == [v for o, *_, values in rows if o == "o" for v in values]
    assert all(r["first"] // width == (r["first"] + len(r["values"]) - 1) // width for r in pieces)
    sizes = params.select("owner", "position", "name", F.size("values").alias("n"))
    again = weights.split_by_sizes(flat.drop("name"), sizes, width).collect()
    assert {(r.owner, r.name): list(r["values"]) for r in again} == {(o, name): v for o, _, name, v in rows}


def test_no_row_per_entry(spark):
    """Two long vectors are flattened and split in rows of slices, not of entries."""
    params = spark.range(2).selectExpr(
        "'o' as owner", "id as position", "string(id) as name", "transform(sequence(1, 100001), x -> double(x)) as values"
    )
    flat = weights.flattened(params)
    assert flat.count() <= 2 * (100_001 // 1024 + 2)
    sizes = params.selectExpr("owner", "position", "name", "size(values) as n")
    again = weights.split_by_sizes(flat, sizes)
    assert again.selectExpr("sum(values[0])", "sum(values[100000])", "sum(size(values))").first()[:] == (2.0, 200002.0, 200002)

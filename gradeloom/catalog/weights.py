"""Tables of vectors, matrices and populations on the given tables.

An embedding is a named vector: its label is the expert that owns it, and its
number stands for the name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.catalog.registry import query, table
from gradeloom.functions.vectors import soft_mask
from gradeloom.operators import matrices, population, ranking, reports, weights
from gradeloom.operators.positions import with_position

_LONG = """
    e AS (SELECT vec_id, label, unnest(range(64))::INT AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)
"""


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("values")
    )


def _rounded(values: str, digits: int = 6) -> F.Column:
    return F.transform(F.col(values), lambda v: F.round(v, digits))


def _list(expr: str, order: str = "i") -> str:
    # Adding zero turns a rounded -0 into 0, as Spark rounds it.
    return f"array_agg(round({expr}, 6) + 0.0 ORDER BY {order})"


@query(f"WITH {_LONG} SELECT vec_id, {_list('2.0 / (1 + exp(-v))')} AS values FROM e GROUP BY vec_id")
def mask_values(spark: SparkSession, sf: str) -> DataFrame:
    masked = weights.masked(_vectors(spark, sf), 2.0)
    return masked.select("vec_id", _rounded("values").alias("values"))


@query(
    """
    SELECT vec_id, list_transform(range(1, 1 + label), lambda i: round(1.0 - least(1.0, greatest(0.0,
             i::DOUBLE - ((vec_id % 5) / 4.0) * label)), 6)) AS mask FROM embeddings
    """
)
def soft_masks(spark: SparkSession, sf: str) -> DataFrame:
    mask = soft_mask(F.col("label"), (F.col("vec_id") % 5) / 4.0)
    return _vectors(spark, sf).select("vec_id", F.transform(mask, lambda m: F.round(m, 6)).alias("mask"))


def _unit_sql(seed: int, rest: str) -> str:
    return f"((('0x' || substr(md5('{seed}:' || {rest}), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)"


def _gauss_sql(seed: int, rest: str) -> str:
    radius = _unit_sql(seed, rest + " || ':r'")
    angle = _unit_sql(seed, rest + " || ':a'")
    return f"(sqrt(-2.0 * ln({radius})) * cos(2.0 * pi() * {angle}))"


@query(
    f"""
    SELECT vec_id::VARCHAR AS name, list_transform(range(0, vec_id % 5), lambda i:
      0.0 + round(0.1 + 0.01 * {_gauss_sql(7, "vec_id || ':' || i")}, 6)) AS values FROM embeddings
    """
)
def init_vectors(spark: SparkSession, sf: str) -> DataFrame:
    shapes = table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("name"),
        F.lit(64).alias("rows"),
        (F.col("vec_id") % 5).cast("int").alias("cols"),
    )
    start = weights.init_vectors(shapes, 0.1, 7)
    return start.select("name", _rounded("values").alias("values"))


# A vector's name is its place among the vectors of its label, in number order.
_PLACED = """
    placed AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS name FROM embeddings)
"""
# An expert's weight for a name: from the first entry of its vector.
_COEFFICIENTS = f"""
    {_PLACED}, c AS (SELECT label AS expert, name, 1.0 + abs(embedding[1]::DOUBLE) AS weight FROM placed)
"""


def _named(spark: SparkSession, sf: str) -> DataFrame:
    """(expert, name, values): every vector, named by its place among those of its label."""
    placed = with_position(_vectors(spark, sf), ["vec_id"], ["label"], "name")
    return placed.select(F.col("label").alias("expert"), "name", "values")


def _coefficients(spark: SparkSession, sf: str) -> DataFrame:
    weight = 1.0 + F.abs(F.get("values", F.lit(0)))
    return _named(spark, sf).select("expert", "name", weight.alias("weight"))


@query(
    f"""
    WITH {_COEFFICIENTS}
    SELECT expert, name, round(weight / sum(weight) OVER (PARTITION BY name), 6) AS weight FROM c
    """
)
def norm_coefficients(spark: SparkSession, sf: str) -> DataFrame:
    normal = weights.normalized_coefficients(_coefficients(spark, sf))
    return normal.withColumn("weight", F.round("weight", 6))


@query(f"WITH {_COEFFICIENTS} SELECT expert, round(avg(weight), 6) AS mean_weight FROM c GROUP BY expert")
def mean_mix_weight(spark: SparkSession, sf: str) -> DataFrame:
    means = reports.mean_weight_per_expert(_coefficients(spark, sf))
    return means.withColumn("mean_weight", F.round("mean_weight", 6))


_NAMED = f"""
    {_LONG}, {_PLACED},
    p AS (SELECT placed.label AS expert, name, i, v FROM placed JOIN e USING (vec_id))
"""


@query(
    f"""
    WITH {_NAMED}, c AS (SELECT label AS expert, name, 1.0 + abs(embedding[1]::DOUBLE) AS weight FROM placed),
    n AS (SELECT expert, name, weight / sum(weight) OVER (PARTITION BY name) AS w FROM c),
    s AS (SELECT name, i, sum(w * v) AS v FROM p JOIN n USING (expert, name) GROUP BY name, i)
    SELECT name, {_list('v')} AS values FROM s GROUP BY name
    """
)
def mix_experts(spark: SparkSession, sf: str) -> DataFrame:
    normal = weights.normalized_coefficients(_coefficients(spark, sf))
    mix = weights.mixed(_named(spark, sf), normal)
    return mix.select("name", _rounded("values").alias("values"))


@query(
    f"""
    WITH {_NAMED}, s AS (SELECT name, i, sum(v / 10) AS v FROM p GROUP BY name, i)
    SELECT name, {_list('v')} AS values FROM s GROUP BY name
    """
)
def mix_experts_default(spark: SparkSession, sf: str) -> DataFrame:
    """Default weights: one over the number of experts, the same for all names."""
    params = _named(spark, sf)
    names = params.select("name").distinct()
    mix = weights.mixed(params, weights.default_coefficients(names, list(range(10))))
    return mix.select("name", _rounded("values").alias("values"))


@query(
    f"""
    WITH {_LONG}, n AS (SELECT vec_id, avg(v) AS mean, sqrt(sum(v * v)) AS norm FROM e GROUP BY vec_id)
    SELECT vec_id, round(mean, 6) + 0.0 AS mean, round(norm, 6) AS norm FROM n
    """
)
def vector_norms(spark: SparkSession, sf: str) -> DataFrame:
    stats = reports.vector_stats(_vectors(spark, sf).drop("label"))
    return stats.select("vec_id", F.round("mean", 6).alias("mean"), F.round("norm", 6).alias("norm"))


@query(
    f"""
    WITH {_LONG}, n AS (SELECT label, vec_id, avg(v) AS mean, sqrt(sum(v * v)) AS norm FROM e GROUP BY ALL)
    SELECT label, unnest(['mags/mean', 'mags/std', 'mags/min', 'mags/max']) AS metric,
           round(unnest([avg(norm), stddev_pop(norm), min(norm), max(norm)]), 6) AS value FROM n GROUP BY label
    """
)
def magnitude_bundle(spark: SparkSession, sf: str) -> DataFrame:
    stats = reports.vector_stats(_vectors(spark, sf))
    bundle = reports.metric_bundle(stats, F.col("norm"), "mags", ["label"])
    return bundle.withColumn("value", F.round("value", 6))


# A ring with chords: node n hears n + 1 and n + 2 modulo 10.
def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    return _named(spark, sf).withColumnRenamed("expert", "node")


def _edges(spark: SparkSession, sf: str, rounds: int = 1) -> DataFrame:
    labels = table(spark, sf, "embeddings").select(F.col("label").alias("node")).distinct()
    reach = F.when(F.col("node") == 9, F.array().cast("array<int>")).otherwise(F.array(F.lit(1), F.lit(2)))
    linked = labels.select("node", F.explode_outer(reach).alias("_by")).select(
        "node", ((F.col("node") + F.col("_by")) % 10).alias("neighbour")
    )
    return linked.select(F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"), "*")


def _exchange_sql(source: str, target: str) -> str:
    return f"""
    {target}_sums AS (
      SELECT l.expert, l.name, l.i, any_value(l.v) AS v, count(*) AS k, sum(n.v - l.v) AS d
      FROM {source} l JOIN {source} n
        ON l.name = n.name AND l.i = n.i AND l.expert < 9 AND n.expert IN ((l.expert + 1) % 10, (l.expert + 2) % 10)
      GROUP BY l.expert, l.name, l.i),
    {target} AS (
      SELECT p.expert, p.name, p.i, p.v + coalesce(0.5 / (s.k + 1) * s.d, 0) AS v
      FROM {source} p LEFT JOIN {target}_sums s USING (expert, name, i))
    """


@query(
    f"""
    WITH {_NAMED}, {_exchange_sql('p', 'q')}
    SELECT expert AS node, name, {_list('v')} AS values FROM q GROUP BY expert, name
    """
)
def neighbour_exchange(spark: SparkSession, sf: str) -> DataFrame:
    moved = weights.exchanged(_nodes(spark, sf), _edges(spark, sf).drop("round"))
    return moved.select("node", "name", _rounded("values").alias("values"))


@query(
    f"""
    WITH {_NAMED}, {_exchange_sql('p', 'q1')}, {_exchange_sql('q1', 'q2')}, {_exchange_sql('q2', 'q3')}
    SELECT expert AS node, name, {_list('v')} AS values FROM q3 GROUP BY expert, name
    """
)
def exchange_rounds(spark: SparkSession, sf: str) -> DataFrame:
    moved = weights.exchange_rounds(_nodes(spark, sf), _edges(spark, sf, 3), 3)
    return moved.select("node", "name", _rounded("values").alias("values"))


# Matrices: the vectors of a label, in number order, are the rows of its matrix; entries as they are stored.
def _matrices(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.concat(F.lit("layers."), F.col("label").cast("string"), F.when(F.col("label") < 7, ".mlp").otherwise(".attn")).alias("name"),
        F.col("vec_id").alias("row"),
        F.col("embedding").alias("values"),
    )


_NAME_SQL = "'layers.' || label || CASE WHEN label < 7 THEN '.mlp' ELSE '.attn' END"


@query(
    f"""
    WITH {_LONG}
    SELECT {_NAME_SQL} AS name, vec_id AS row, {_list('v')} AS values FROM e GROUP BY label, vec_id
    """
)
def svd_reconstruct(spark: SparkSession, sf: str) -> DataFrame:
    """Decomposing and composing again gives back the matrix."""
    again = matrices.reconstruct(matrices.decompose(_matrices(spark, sf)))
    whole = again.withColumn("values", F.col("values").cast("array<double>"))
    return whole.select("name", "row", _rounded("values").alias("values"))


# Products of the columns of a matrix: A^T A.
_GRAM = f"""
    {_LONG}, g AS (SELECT a.label, a.i AS c, b.i AS d, sum(a.v * b.v) AS g FROM e a JOIN e b USING (vec_id) GROUP BY ALL)
"""


@query(
    f"""
    WITH {_GRAM}
    SELECT {_NAME_SQL} AS name, round(sum(g) FILTER (c = d), 6) AS energy, round(sum(g * g), 3) AS fourth
    FROM g GROUP BY label
    """
)
def svd_energy(spark: SparkSession, sf: str) -> DataFrame:
    """Squares of the singular values sum to the squared entries, fourth powers to those of A^T A."""
    singular = matrices.decompose(_matrices(spark, sf), 512).singular
    energy = F.aggregate("values", F.lit(0.0), lambda acc, s: acc + s * s)
    fourth = F.aggregate("values", F.lit(0.0), lambda acc, s: acc + s * s * s * s)
    return singular.select("name", F.round(energy, 6).alias("energy"), F.round(fourth, 3).alias("fourth"))


@query(
    f"""
    WITH {_GRAM}, cubed AS (
      SELECT label, vec_id, d AS i, sum(v * g) AS v FROM e JOIN g USING (label) WHERE e.i = g.c GROUP BY ALL),
    x AS (SELECT * FROM cubed WHERE label < 7 UNION ALL SELECT label, vec_id, i, v FROM e WHERE label >= 7)
    SELECT {_NAME_SQL} AS name, vec_id AS row, array_agg(round(v, 4) + 0.0 ORDER BY i) AS values FROM x GROUP BY label, vec_id
    """
)
def composed_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Chosen matrices masked by their squared singular values, others as they are.

    Without the scale that keeps the sum of the singular values this is A A^T A.
    """
    base = _matrices(spark, sf)
    parts = matrices.decompose(weights.choose_params(base))
    squares = parts.singular.select("name", F.transform("values", lambda s: s * s).alias("values"))
    cubes = F.aggregate("values", F.lit(0.0), lambda acc, s: acc + s * s * s)
    total = F.aggregate("values", F.lit(0.0), lambda acc, s: acc + s)
    scale = parts.singular.select("name", (cubes / total).alias("scale"))
    applied = matrices.apply_composed(base, matrices.compose(parts, squares)).join(scale, "name", "left")
    factor = F.coalesce(F.col("scale"), F.lit(1.0))
    values = F.transform("values", lambda v: F.round(v * factor, 4))
    return applied.select("name", "row", values.alias("values"))


# --- populations ----------------------------------------------------------

_MOMENTS = """
    m AS (SELECT i, avg(v) AS mean, stddev_samp(v) AS std, max(v) AS best FROM e GROUP BY i)
"""


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(spark, sf).select("vec_id", "label", F.posexplode("values").alias("i", "value"))


def _moments(spark: SparkSession, sf: str) -> DataFrame:
    return _entries(spark, sf).groupBy("i").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.max("value").alias("best")
    )


@query(
    f"""
    WITH {_LONG}, {_MOMENTS}, x AS (SELECT i, best, unnest(range(32))::INT AS member FROM m)
    SELECT member, i, 0.0 + round(CASE WHEN member = 0 THEN best ELSE -1.0 + {_unit_sql(11, "member || ':' || i")} * 2.0 END, 6) AS value
    FROM x
    """
)
def uniform_population(spark: SparkSession, sf: str) -> DataFrame:
    drawn = population.uniform_population(_moments(spark, sf), 32, -1.0, 1.0, 11)
    return drawn.withColumn("value", F.round("value", 6))


@query(
    f"""
    WITH {_LONG}, {_MOMENTS}, x AS (SELECT *, unnest(range(32))::INT AS member FROM m)
    SELECT member, i, 0.0 + round(CASE WHEN member = 0 THEN best
      ELSE greatest(-0.1, least(0.1, mean + std * {_gauss_sql(11, "member || ':' || i")})) END, 6) AS value
    FROM x
    """
)
def gaussian_population(spark: SparkSession, sf: str) -> DataFrame:
    drawn = population.gaussian_population(_moments(spark, sf), 32, -0.1, 0.1, 11)
    return drawn.withColumn("value", F.round("value", 6))


def _performance(spark: SparkSession, sf: str) -> DataFrame:
    first = F.get("values", F.lit(0))
    return _vectors(spark, sf).select(F.col("vec_id").alias("member"), first.alias("perf"))


_ELITES = """
    r AS (SELECT vec_id, row_number() OVER (ORDER BY embedding[1] DESC, vec_id) AS n FROM embeddings),
    elite AS (SELECT vec_id FROM r WHERE n <= floor(0.2 * (SELECT count(*) FROM embeddings)))
"""


def _elite_moments(spark: SparkSession, sf: str) -> DataFrame:
    members = _entries(spark, sf).withColumnRenamed("vec_id", "member")
    return population.elite_moments(members, ranking.elites(_performance(spark, sf), 0.2))


@query(
    f"""
    WITH {_LONG}, {_ELITES}
    SELECT i, round(avg(v), 6) + 0.0 AS mean, round(stddev_samp(v), 6) AS std FROM e JOIN elite USING (vec_id) GROUP BY i
    """
)
def elite_moments(spark: SparkSession, sf: str) -> DataFrame:
    moments = _elite_moments(spark, sf)
    return moments.select("i", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(
    f"""
    WITH {_LONG}, {_ELITES}, {_MOMENTS},
    n AS (SELECT i, avg(v) AS mean, stddev_samp(v) AS std FROM e JOIN elite USING (vec_id) GROUP BY i)
    SELECT i, round(n.mean * 0.7 + 0.3 * m.mean, 6) + 0.0 AS mean, round(n.std * 0.7 + 0.3 * m.std, 6) AS std
    FROM n JOIN m USING (i)
    """
)
def blended_moments(spark: SparkSession, sf: str) -> DataFrame:
    blended = population.blended_moments(_elite_moments(spark, sf), _moments(spark, sf), 0.3)
    return blended.select("i", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(
    f"""
    WITH {_LONG}, {_MOMENTS}, b AS (SELECT vec_id FROM embeddings ORDER BY embedding[1] DESC, vec_id LIMIT 1)
    SELECT i, round(v * 0.9 + 0.1 * best, 6) + 0.0 AS best FROM e JOIN b USING (vec_id) JOIN m USING (i)
    """
)
def blended_best(spark: SparkSession, sf: str) -> DataFrame:
    member = ranking.best_member(_performance(spark, sf))
    members = _entries(spark, sf).withColumnRenamed("vec_id", "member")
    blended = population.blended_best(members, _moments(spark, sf), member, 0.1)
    return blended.withColumn("best", F.round("best", 6))


def _owned(spark: SparkSession, sf: str) -> DataFrame:
    """Parameters of an owner in number order; a vector and its first entries once more, one in seven empty."""
    again = F.slice("values", F.lit(1), (F.col("vec_id") % 64).cast("int"))
    whole = F.concat("values", again)
    return _vectors(spark, sf).select(
        F.col("label").alias("owner"),
        F.col("vec_id").alias("position"),
        F.col("vec_id").cast("string").alias("name"),
        F.when(F.col("vec_id") % 7 > 0, whole).otherwise(F.array().cast("array<double>")).alias("values"),
    )


_FLAT = f"""
    w AS (SELECT label, vec_id, CASE WHEN vec_id % 7 > 0 THEN list_concat(embedding, embedding[1:vec_id % 64]) ELSE [] END AS whole
          FROM embeddings),
    f AS (
      SELECT label AS owner, vec_id, i, v, row_number() OVER (PARTITION BY label ORDER BY vec_id, i) - 1 AS flat
      FROM (SELECT label, vec_id, unnest(range(len(whole))) AS i, unnest(whole)::DOUBLE AS v FROM w))
"""


@query(f"WITH {_FLAT} SELECT owner, vec_id::VARCHAR AS name, flat, round(v, 6) + 0.0 AS value FROM f")
def flatten_params(spark: SparkSession, sf: str) -> DataFrame:
    flat = weights.flattened(_owned(spark, sf))
    entries = flat.select("owner", "name", "first", F.posexplode("values").alias("i", "value"))
    return entries.select("owner", "name", (F.col("first") + F.col("i")).alias("flat"), F.round("value", 6).alias("value"))


@query(
    f"""
    WITH {_FLAT}
    SELECT label AS owner, vec_id AS position, vec_id::VARCHAR AS name, coalesce(any_value(vs), []) AS values
    FROM w LEFT JOIN (SELECT vec_id, {_list('v')} AS vs FROM f GROUP BY vec_id) USING (vec_id) GROUP BY label, vec_id
    """
)
def split_params(spark: SparkSession, sf: str) -> DataFrame:
    owned = _owned(spark, sf)
    sizes = owned.select("owner", "position", "name", F.size("values").alias("n"))
    again = weights.split_by_sizes(weights.flattened(owned), sizes)
    return again.select("owner", "position", "name", _rounded("values").alias("values"))

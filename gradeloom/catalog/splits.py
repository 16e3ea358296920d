"""Selections, splits, shards, samples and batches on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.catalog.registry import query, table
from gradeloom.operators import splits as S
from gradeloom.operators.joins import repeat_requests
from gradeloom.operators.positions import chunk_of, with_hash_position, with_position
from gradeloom.operators.runs import present
from gradeloom.operators.weights import choose_params


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their position in id order."""
    ids = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    return with_position(ids, ["doc_id"])


_PLACED = """
    placed AS (SELECT doc_id, source, lang, n_chars,
                      row_number() OVER (ORDER BY doc_id) - 1 AS ordinal FROM documents)
"""


def _shuffled_sql(seed: int, name: str = "shuffled") -> str:
    return f"""
        {name} AS (SELECT *, row_number() OVER (ORDER BY md5('{seed}:' || doc_id), doc_id) - 1 AS place
                   FROM documents)
    """


@query(
    f"""
    WITH {_PLACED}, picks AS (
      SELECT doc_id AS ordinal FROM labels
      UNION ALL SELECT doc_id FROM labels WHERE quality = 1)
    SELECT ordinal, doc_id, n_chars FROM placed JOIN picks USING (ordinal)
    """
)
def picked_positions(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("ordinal"), "quality")
    picks = labels.select("ordinal").unionByName(labels.where("quality = 1").select("ordinal"))
    return S.pick_positions(_documents(spark, sf), picks).select("ordinal", "doc_id", "n_chars")


@query(
    f"""
    WITH {_PLACED}
    SELECT doc_id, ordinal, CASE WHEN ordinal % 2 = 0 THEN 'train' ELSE 'valid' END AS split FROM placed
    """
)
def parity_split(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select(
        "doc_id", "ordinal", S.parity_split(F.col("ordinal")).alias("split")
    )


@query(
    f"""
    WITH {_PLACED}
    SELECT doc_id, CASE WHEN ordinal % 5 < 4 THEN 'train' ELSE 'test' END AS split FROM placed
    """
)
def mod5_split(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select("doc_id", S.four_to_one_split(F.col("ordinal")).alias("split"))


@query(
    f"""
    WITH {_PLACED}
    SELECT doc_id, CASE WHEN ordinal >= 150 - 32 THEN 'valid' ELSE 'train' END AS split
    FROM placed WHERE ordinal < 150
    """
)
def tail_holdout(spark: SparkSession, sf: str) -> DataFrame:
    return S.tail_holdout(_documents(spark, sf), 150, 32).select("doc_id", "split")


@query(
    f"""
    WITH {_PLACED}
    SELECT doc_id, CASE WHEN ordinal < 300 THEN 'train' ELSE 'test' END AS split FROM placed
    """
)
def prefix_cut(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select("doc_id", S.cut_split(F.col("ordinal"), 300).alias("split"))


@query(
    f"""
    WITH {_shuffled_sql(16)}
    SELECT doc_id, place AS shuffled, CASE WHEN place < 200 THEN 'train' ELSE 'valid' END AS split FROM shuffled
    """
)
def seeded_split(spark: SparkSession, sf: str) -> DataFrame:
    return S.seeded_split(table(spark, sf, "documents").select("doc_id"), "doc_id", 16, 200)


@query(
    f"""
    WITH {_shuffled_sql(16)}
    SELECT doc_id, source FROM shuffled WHERE place >= 200
    """
)
def split_complement(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source")
    train = S.seeded_split(docs, "doc_id", 16, 200).where("split = 'train'")
    return S.complement(docs, train, ["doc_id"])


@query(
    f"""
    WITH {_shuffled_sql(42)}, size AS (SELECT count(*) // 11 AS n FROM documents)
    SELECT doc_id, (place // n)::INT AS shard FROM shuffled, size WHERE place // n < 10
    """
)
def equal_shards(spark: SparkSession, sf: str) -> DataFrame:
    return S.equal_shards(table(spark, sf, "documents").select("doc_id"), "doc_id", 42)


@query(
    """
    SELECT event_type, event_id FROM (
      SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n
      FROM events) WHERE n < 400
    """
)
def source_cap(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_type", "event_id")
    return S.cap_per_source(events, "event_type", "event_id", 400)


# Feistel rounds on a position's row and column, as the library draws.
def _permuted_sql(source: str) -> str:
    """``source`` has n, rows, cols, draw, step and j; the result has j where the permutation puts it."""

    def key(number: int, at: int) -> str:
        return f"('0x' || substr(md5('5:' || step || ':{number}'), {at}, 7))::BIGINT"

    sql = f"SELECT *, j // cols AS r, j % cols AS c FROM ({source})"
    for number in range(S.ROUNDS):
        half, other, size = ("r", "c", "rows") if number % 2 == 0 else ("c", "r", "cols")
        sql = f"SELECT *, ({other} + {key(number, 1)}) % {S.PRIME} AS x FROM ({sql})"
        sql = f"SELECT * EXCLUDE x, ((x * x) % {S.PRIME} + {key(number, 8)}) % {S.PRIME} AS y FROM ({sql})"
        sql = f"SELECT * EXCLUDE y REPLACE (({half} + (y * y) % {S.PRIME}) % {size} AS {half}) FROM ({sql})"
    return f"SELECT step, draw, n, rows, cols, r * cols + c AS j FROM ({sql})"


def _draws_sql(steps: str) -> str:
    """Places outside are permuted again until they are inside."""
    return f"""
    RECURSIVE {_PLACED}, train AS (SELECT doc_id, ordinal // 2 AS split_ordinal FROM placed WHERE ordinal % 2 = 0),
    n AS (SELECT *, (n + rows - 1) // rows AS cols
          FROM (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS rows FROM train)),
    walk AS (
        SELECT * FROM ({_permuted_sql(f"SELECT step, n, rows, cols, draw, draw::BIGINT AS j FROM (SELECT step, n, rows, cols, unnest(range(0, least(16, n))) AS draw FROM ({steps}), n)")})
        UNION ALL
        SELECT * FROM ({_permuted_sql("SELECT step, n, rows, cols, draw, j FROM walk WHERE j >= n")})),
    kept AS (SELECT step, draw, j AS split_ordinal FROM walk WHERE j < n)
    """


def _train(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    """Train documents with their positions, and how many: the larger half of all, so nothing is numbered to count."""
    place = F.col("ordinal")
    rows = _documents(spark, sf).where(S.parity_split(place) == "train")
    positions = rows.select("doc_id", S.parity_position(place).alias("split_ordinal"))
    return positions, (table(spark, sf, "documents").count() + 1) // 2


@query(
    f"""
    WITH {_draws_sql('SELECT 3 AS step')}
    SELECT draw::INT AS draw, doc_id FROM kept JOIN train USING (split_ordinal)
    """
)
def random_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Step 3 of :func:`step_batches`, drawn by itself."""
    rows, n = _train(spark, sf)
    return S.random_batch(rows, 16, 5, step=3, ordinal="split_ordinal", n=n).select("draw", "doc_id")


@query(
    f"""
    WITH {_draws_sql('SELECT doc_id AS step FROM documents')}
    SELECT step, draw::INT AS draw, doc_id FROM kept JOIN train USING (split_ordinal)
    """
)
def step_batches(spark: SparkSession, sf: str) -> DataFrame:
    """A batch of 16 train documents for as many steps as there are documents."""
    steps = table(spark, sf, "documents").select(F.col("doc_id").alias("step"))
    rows, n = _train(spark, sf)
    batches = S.step_batches(rows, steps, 16, 5, "split_ordinal", n)
    return batches.select("step", "draw", "doc_id")


@query(
    f"""
    WITH {_PLACED}, s AS (
      SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS split_ordinal
      FROM placed WHERE ordinal % 2 = 0)
    SELECT doc_id, split_ordinal FROM s WHERE split_ordinal < 64
    """
)
def train_head(spark: SparkSession, sf: str) -> DataFrame:
    place = F.col("ordinal")
    split = _documents(spark, sf).withColumns(
        {"split": S.parity_split(place), "split_ordinal": S.parity_position(place)}
    )
    return S.head_of_split(split, "train", 64).select("doc_id", "split_ordinal")


@query("SELECT doc_id, source, 'acc_fr' AS metric FROM documents WHERE lang = 'fr'")
def chosen_split(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumnRenamed("lang", "split")
    rows, metric = S.choose_split(docs, "fr", {"en": "acc", "fr": "acc_fr"})
    return rows.select("doc_id", "source", F.lit(metric).alias("metric"))


@query(
    f"""
    WITH {_shuffled_sql(9)}
    SELECT lang, count(*) AS n, sum((place // 100) + 1)::BIGINT AS chunks FROM shuffled GROUP BY lang
    """
)
def shuffled_chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = with_hash_position(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 9)
    chunked = docs.withColumn("chunk", chunk_of(F.col("ordinal"), 100))
    return chunked.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("chunk") + 1).alias("chunks")
    )


@query(
    f"""
    WITH {_PLACED}
    SELECT doc_id, unnest(range(3))::INT AS completion_no, ordinal // 100 AS chunk FROM placed
    """
)
def repeated_requests(spark: SparkSession, sf: str) -> DataFrame:
    repeated = repeat_requests(_documents(spark, sf), 3)
    return repeated.select("doc_id", "completion_no", chunk_of(F.col("ordinal"), 100).alias("chunk"))


@query(
    """
    WITH a AS (SELECT doc_id FROM documents WHERE lang = 'en'),
         b AS (SELECT doc_id FROM labels)
    SELECT count(*) AS overlap FROM a JOIN b USING (doc_id)
    """
)
def split_overlap(spark: SparkSession, sf: str) -> DataFrame:
    train = table(spark, sf, "documents").where("lang = 'en'").select("doc_id")
    test = table(spark, sf, "labels").select("doc_id")
    rows = train.withColumn("split", F.lit("train")).unionByName(
        test.withColumn("split", F.lit("test"))
    )
    return S.split_overlap(rows, "doc_id", "train", "test")


@query(
    """
    SELECT event_id, CASE event_type WHEN 'error' THEN NULL ELSE value END AS value
    FROM events WHERE event_type NOT IN ('error', 'view')
    """
)
def present_points(spark: SparkSession, sf: str) -> DataFrame:
    value = F.when(F.col("event_type") == "view", F.lit(float("nan"))).when(
        F.col("event_type") != "error", F.col("value")
    )
    return present(table(spark, sf, "events").select("event_id", value.alias("value")), "value")


@query(
    """
    SELECT o_orderkey, o_orderpriority FROM orders WHERE o_custkey = 7
    """
)
def one_task(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_custkey")
    return orders.where(F.col("o_custkey") == 7).drop("o_custkey")


@query(
    """
    SELECT vec_id, 'layers.' || label || '.mlp.' || vec_id AS name FROM embeddings WHERE vec_id % 3 = 0
    """
)
def chosen_params(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.get(
        F.array(F.lit("mlp"), F.lit("attn"), F.lit("mlp_norm")), (F.col("vec_id") % 3).cast("int")
    )
    name = F.concat_ws(".", F.lit("layers"), F.col("label").cast("string"), kind, F.col("vec_id").cast("string"))
    params = table(spark, sf, "embeddings").select("vec_id", name.alias("name"))
    return choose_params(params, "mlp", unlike="norm")

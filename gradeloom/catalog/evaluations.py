"""Whole evaluations: samples and generations taken from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.catalog.answers import _SHAPES, _answer_pairs
from gradeloom.catalog.registry import query, table
from gradeloom.operators.positions import with_position
from gradeloom.operators.splits import parity_position, parity_split
from gradeloom.plans import evaluate as V
from gradeloom.plans.spec import TASKS, few_shot

_LETTER = "regexp_extract_all(text, '[A-E]')[-1]"


def _letters(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    samples = table(spark, sf, "labels").select(
        F.col("doc_id").alias("sample_id"),
        F.col("doc_id").alias("ordinal"),
        F.char(F.lit(65) + F.col("quality")).alias("answer"),
    )
    generations = table(spark, sf, "documents").select(
        F.col("doc_id").alias("sample_id"), F.col("text").alias("generation")
    )
    return samples, generations


@query(
    f"""
    WITH g AS (SELECT chr(65 + quality) IS NOT DISTINCT FROM {_LETTER} AS ok, lang
               FROM documents JOIN labels USING (doc_id)),
    a AS (SELECT avg(ok::INT::DOUBLE) AS acc, avg((ok AND lang = 'en')::INT::DOUBLE) AS acc_en FROM g)
    SELECT unnest(['acc', 'acc_en']) AS metric, unnest([acc, acc_en]) AS value FROM a
    """
)
def eval_letters(spark: SparkSession, sf: str) -> DataFrame:
    """The table has English as its only language column."""
    samples, generations = _letters(spark, sf)
    lang = table(spark, sf, "documents").select(
        F.col("doc_id").alias("sample_id"), F.when(F.col("lang") == "en", 1.0).otherwise(0.0).alias("lang_en")
    )
    return V.letter_answers(samples.join(lang, "sample_id"), generations).metrics


@query(
    f"""
    SELECT doc_id AS sample_id, chr(65 + quality) AS answer, {_LETTER} AS prediction,
           CASE WHEN chr(65 + quality) IS NOT DISTINCT FROM {_LETTER} THEN 1.0 ELSE -1.0 END::DOUBLE AS reward
    FROM documents JOIN labels USING (doc_id) JOIN (SELECT DISTINCT doc_id FROM conversations, documents
      WHERE conv_id = doc_id) USING (doc_id)
    """
)
def eval_letters_details(spark: SparkSession, sf: str) -> DataFrame:
    """Detail rows and rewards of chosen positions."""
    positions = table(spark, sf, "conversations").select(F.col("conv_id").alias("ordinal")).distinct()
    spec = TASKS["aqua"]
    details = spec.evaluate(*_letters(spark, sf), positions).details
    return spec.rewards(details).select("sample_id", "answer", "prediction", "reward")


@query(
    """
    WITH g AS (
      SELECT CASE o_orderkey % 4 WHEN 0 THEN TRUE WHEN 1 THEN o_custkey = 234 WHEN 2 THEN TRUE ELSE o_custkey IS NULL END AS ok
      FROM orders)
    SELECT 'acc' AS metric, avg(ok::INT::DOUBLE) AS value FROM g
    """
)
def eval_numbers(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    customer, shape = F.col("o_custkey").cast("string"), F.col("o_orderkey") % 4
    said = (
        F.when(shape == 0, F.concat(F.lit("First 3, then #### "), customer))
        .when(shape == 1, F.lit("It is 1,234"))
        .when(shape == 2, F.concat(F.lit("so -"), customer, F.lit(".0 in all.")))
        .otherwise(F.lit("unsure"))
    )
    samples = orders.select(F.col("o_orderkey").alias("sample_id"), F.col("o_custkey").alias("answer"))
    generations = orders.select(F.col("o_orderkey").alias("sample_id"), said.alias("generation"))
    return TASKS["gsm8k"].evaluate(samples, generations).metrics


@query(
    """
    WITH g AS (
      SELECT p_partkey % 4 AS shape, chr(65 + (p_size % 3)) AS gold FROM part),
    c AS (SELECT CASE shape WHEN 0 THEN TRUE WHEN 1 THEN gold = 'B' WHEN 2 THEN gold = 'C' ELSE gold = 'A' END AS ok FROM g)
    SELECT 'acc' AS metric, avg(ok::INT::DOUBLE) AS value FROM c
    """
)
def eval_choices(spark: SparkSession, sf: str) -> DataFrame:
    shape, gold = F.col("p_partkey") % 4, F.char(F.lit(65) + F.col("p_size") % 3)
    said = (
        F.when(shape == 0, F.concat(F.lit("so the answer is ("), gold, F.lit(").")))
        .when(shape == 1, F.lit("C or maybe B"))
        .otherwise(F.lit("no idea"))
    )
    three = F.array("p_brand", "p_type", "p_name")
    options = F.when(shape == 2, three).otherwise(F.concat(three, F.array("p_brand")))
    parts = table(spark, sf, "part")
    samples = parts.select(
        F.col("p_partkey").alias("sample_id"), gold.alias("answer"), options.alias("options")
    )
    generations = parts.select(F.col("p_partkey").alias("sample_id"), said.alias("generation"))
    return V.choice_answers(samples, generations).metrics


_VERDICTS = ", ".join(f"({i}, {ok})" for i, (_, _, ok) in enumerate(_SHAPES))


@query(
    f"""
    SELECT p_type AS type, count(*) AS n, avg(verdict::INT::DOUBLE) AS acc,
           count(*) FILTER (NOT verdict AND shape <> 5) AS needs_symbolic
    FROM part JOIN (VALUES {_VERDICTS}) AS s(shape, verdict) ON p_partkey % {len(_SHAPES)} = shape GROUP BY p_type
    """
)
def eval_latex_by_type(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _answer_pairs(spark, sf).join(table(spark, sf, "part").select("p_partkey", "p_type"), "p_partkey")
    samples = pairs.select(
        F.col("p_partkey").alias("sample_id"), F.col("gold").alias("answer"), F.col("p_type").alias("type")
    )
    said = F.concat(F.lit("We get it.\nThe answer is: "), F.col("said"), F.lit(".\nDone"))
    generations = pairs.select(F.col("p_partkey").alias("sample_id"), said.alias("generation"))
    return V.latex_by_type(V.latex_answers(samples, generations).details)


@query("SELECT 'acc' AS metric, avg((event_id % 3 < 2)::INT::DOUBLE) AS value FROM events")
def eval_commands(spark: SparkSession, sf: str) -> DataFrame:
    shape, props = F.col("event_id") % 3, F.col("props")
    gold = F.concat(F.lit('{"text": "ok", "command": '), props, F.lit("}"))
    said = (
        F.when(shape == 0, F.concat(F.lit(' {"command": '), props, F.lit(', "x": [1]}')))
        .when(shape == 1, gold)
        .otherwise(F.concat(F.lit("Sure: "), gold))
    )
    events = table(spark, sf, "events")
    samples = events.select(
        F.col("event_id").alias("sample_id"),
        F.col("event_type").alias("user_input"),
        gold.alias("ai_output"),
    )
    generations = events.select(F.col("event_id").alias("sample_id"), said.alias("generation"))
    return V.command_answers(samples, generations).metrics


@query("SELECT 'acc' AS metric, avg((doc_id % 3 = 0)::INT::DOUBLE) AS value FROM documents")
def eval_category(spark: SparkSession, sf: str) -> DataFrame:
    shape = F.col("doc_id") % 3
    said = (
        F.when(shape == 0, F.concat(F.lit("Classification: \\boxed{"), "lang", F.lit("}")))
        .when(shape == 1, F.lit("\\boxed{}"))
        .otherwise(F.col("lang"))
    )
    docs = table(spark, sf, "documents")
    samples = docs.select(F.col("doc_id").alias("sample_id"), F.col("lang").alias("label"))
    generations = docs.select(F.col("doc_id").alias("sample_id"), said.alias("generation"))
    return V.category_answers(samples, generations).metrics


# Code: a customer is a problem, an order of that customer a completion.
def _code(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    name = F.concat(F.lit("f"), F.col("c_custkey").cast("string"))
    problems = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("task_id"),
        F.concat(F.lit("import math\n# "), F.col("c_mktsegment")).alias("prompt"),
        name.alias("entry_point"),
    )
    own = F.concat(F.lit("def f"), F.col("o_custkey").cast("string"))
    body = F.when(
        F.col("o_orderkey") % 2 == 0, F.concat(own, F.lit("(a):\n    return a\nprint(1)\n"))
    ).otherwise(F.concat(own, F.lit("(a):\n    pass\n")))
    orders = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("task_id"),
        F.col("o_orderkey").alias("ordinal"),
        F.concat(body, F.lit("```\n Because "), F.col("o_orderstatus"), F.lit(". ")).alias("generation"),
        F.when(F.col("o_orderstatus") == "F", "pass").otherwise("fail").alias("base_status"),
        F.when(F.col("o_orderpriority") > "2", "pass").otherwise("fail").alias("plus_status"),
    )
    completions = orders.select("task_id", "ordinal", "generation")
    verdicts = orders.select("task_id", F.col("ordinal").alias("completion_id"), "base_status", "plus_status")
    return problems, completions, verdicts


@query(
    """
    WITH t AS (
      SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS b,
             count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority > '2') AS p FROM orders GROUP BY o_custkey)
    SELECT unnest(['shop_base_pass@1', 'shop_plus_pass@1']) AS metric,
           round(unnest([avg(b / n), avg(p / n)]), 9) AS value FROM t
    """
)
def eval_code(spark: SparkSession, sf: str) -> DataFrame:
    metrics = V.code_answers(*_code(spark, sf), "shop", clean=True, ks=[1]).metrics
    return metrics.withColumn("value", F.round("value", 9))


@query(
    """
    WITH t AS (
      SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS base_correct,
             count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority > '2') AS plus_correct FROM orders GROUP BY o_custkey)
    SELECT o_custkey AS task_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS completion_id,
           'Because ' || o_orderstatus || '.' AS explanation, base_correct, plus_correct,
           'import math' || chr(10) || '# ' || c_mktsegment || CASE WHEN o_orderkey % 2 = 0 THEN
             chr(10) || 'def f' || o_custkey || '(a):' || chr(10) || '    return a' ELSE '' END AS solution
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN t USING (o_custkey)
    """
)
def eval_code_details(spark: SparkSession, sf: str) -> DataFrame:
    details = V.code_answers(*_code(spark, sf), "shop", clean=True).details
    return details.select(
        "task_id", "completion_id", "explanation", "base_correct", "plus_correct", "solution"
    )


@query(
    f"""
    WITH s AS (
      SELECT CASE lang WHEN 'en' THEN 'code' WHEN 'fr' THEN 'math' WHEN 'de' THEN 'reasoning' ELSE 'other' END AS expert_label,
             chr(65 + quality) AS answer,
             CASE lang WHEN 'en' THEN {_LETTER} WHEN 'fr' THEN regexp_extract_all(text, '[A-E]')[1] END AS said
      FROM documents JOIN labels USING (doc_id))
    SELECT expert_label, count(*) AS num_samples, avg((answer IS NOT DISTINCT FROM said)::INT::DOUBLE) AS test_acc
    FROM s WHERE expert_label IN ('code', 'math') GROUP BY expert_label
    UNION ALL
    SELECT 'final_test_acc', count(*), count(*) FILTER (expert_label IN ('code', 'math')
           AND answer IS NOT DISTINCT FROM said) / count(*) FROM s
    """
)
def eval_routed(spark: SparkSession, sf: str) -> DataFrame:
    samples, texts = _letters(spark, sf)
    names = F.create_map(*[F.lit(x) for x in ("en", "code", "fr", "math", "de", "reasoning", "es", "poetry")])
    box = F.concat(F.lit("Classification: \\boxed{"), names[F.col("lang")], F.lit("}"))
    classified = table(spark, sf, "documents").select(
        F.col("doc_id").alias("sample_id"), box.alias("classification")
    )
    answers = F.array(
        F.struct(F.lit("code").alias("expert_label"), F.col("generation").alias("generation")),
        F.struct(F.lit("math").alias("expert_label"), F.reverse("generation").alias("generation")),
    )
    generations = texts.select("sample_id", F.inline(answers))
    experts = spark.createDataFrame([("code",), ("math",)], "expert_label string")
    return V.routed_answers(
        samples, classified, generations, experts, V.grade_letters
    ).metrics


@query(
    f"""
    WITH d AS (SELECT doc_id, text, quality, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal
               FROM documents JOIN labels USING (doc_id)),
    s AS (SELECT *, CASE WHEN ordinal % 2 = 0 THEN 'train' ELSE 'valid' END AS split FROM d),
    p AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY ordinal) - 1 AS split_ordinal FROM s)
    SELECT split, split || '_acc' AS metric, count(*) AS num_samples,
           avg((chr(65 + quality) IS NOT DISTINCT FROM {_LETTER})::INT::DOUBLE) AS value
    FROM p WHERE split <> 'train' OR split_ordinal < 64 GROUP BY split
    """
)
def split_report(spark: SparkSession, sf: str) -> DataFrame:
    samples, generations = _letters(spark, sf)
    placed = with_position(samples.drop("ordinal"), ["sample_id"])
    place = F.col("ordinal")
    split = placed.withColumns(
        {"split": parity_split(place), "split_ordinal": parity_position(place)}
    )
    details = V.letter_answers(split, generations, languages=()).details
    return V.split_report(details, train_head=64)


@query(
    """
    WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY md5('16:' || doc_id), doc_id) - 1 AS place
               FROM documents WHERE lang = 'de')
    SELECT doc_id AS sample_id, place AS shuffled, CASE WHEN place < 5 THEN 'train' ELSE 'valid' END AS split FROM p
    """
)
def few_shot_split(spark: SparkSession, sf: str) -> DataFrame:
    """The German rows stand for the test split of a task."""
    split = F.when(F.col("lang") == "de", "test").otherwise("train")
    samples = table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"), split.alias("split"))
    return few_shot("math", "test", shots=5).split(samples)


@query(
    """
    WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal FROM documents),
    t AS (SELECT *, row_number() OVER (PARTITION BY ordinal % 5 < 4 ORDER BY ordinal) - 1 AS inner_ordinal FROM p)
    SELECT doc_id, CASE WHEN ordinal % 5 = 4 THEN 'test' WHEN inner_ordinal % 2 = 0 THEN 'train' ELSE 'valid' END AS split
    FROM t
    """
)
def category_split(spark: SparkSession, sf: str) -> DataFrame:
    placed = with_position(table(spark, sf, "documents").select("doc_id"), ["doc_id"])
    return TASKS["category"].split(placed).select("doc_id", "split")


@query(
    """
    WITH pool AS (SELECT c_custkey, row_number() OVER (ORDER BY md5('16:' || c_custkey), c_custkey) AS n
                  FROM customer WHERE c_custkey < 300)
    SELECT c_custkey AS task_id, CASE WHEN n <= 200 THEN 'train' ELSE 'valid' END AS split FROM pool
    UNION ALL SELECT c_custkey, 'test' FROM customer WHERE c_custkey >= 300
    """
)
def code_split(spark: SparkSession, sf: str) -> DataFrame:
    problems = with_position(
        table(spark, sf, "customer").select(F.col("c_custkey").alias("task_id")), ["task_id"]
    )
    return TASKS["mbpp"].split(problems).select("task_id", "split")

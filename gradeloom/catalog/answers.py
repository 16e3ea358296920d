"""Extraction and grading on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.catalog.registry import query, table
from gradeloom.functions import extract as E
from gradeloom.functions import grade as G
from gradeloom.functions import latex
from gradeloom.operators.code import clean_code, parses
from gradeloom.operators.reports import changed_rows, normalized_rewards

NUMBER_SQL = r"try_cast(regexp_extract_all(text, '\d*\.?\d+')[-1] AS DOUBLE)"


@query(
    f"""
    SELECT 'documents' AS origin, doc_id AS id, 0::BIGINT AS part, {NUMBER_SQL} AS number
    FROM documents
    UNION ALL
    SELECT 'conversations', conv_id, turn, {NUMBER_SQL} FROM conversations
    """
)
def last_number_from_text(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(
        F.lit("documents").alias("origin"),
        F.col("doc_id").alias("id"),
        F.lit(0).cast("bigint").alias("part"),
        E.last_number(F.col("text")).alias("number"),
    )
    turns = table(spark, sf, "conversations").select(
        F.lit("conversations").alias("origin"),
        F.col("conv_id").alias("id"),
        F.col("turn").alias("part"),
        E.last_number(F.col("text")).alias("number"),
    )
    return docs.unionByName(turns)


@query(
    """
    SELECT doc_id, regexp_extract_all(text, '[A-E]')[-1] AS letter FROM documents
    """
)
def last_option_letter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", E.last_option_letter(F.col("text")).alias("letter")
    )


# Attempts as generated text: a letter from the return flag or the line number.
_CHOICE_TEXT_SQL = r"""
    CASE l_linenumber
      WHEN 1 THEN 'the answer is (' || l_returnflag || '), not B'
      WHEN 2 THEN 'first' || chr(10) || 'Answer: ' || l_returnflag || ' or Answer: C' || chr(10) || 'Answer: D'
      WHEN 3 THEN 'I would say ' || l_linestatus || ' or ' || l_returnflag
      WHEN 4 THEN 'answer:' || chr(10) || chr(10) || 'B'
      WHEN 5 THEN 'E. No BAD word, 1A 2B'
      WHEN 6 THEN 'A' || chr(13) || 'Answer: G' || chr(13) || 'x'
      ELSE 'nothing here' END
"""


def _choice_text() -> F.Column:
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    cases = [
        F.concat(F.lit("the answer is ("), flag, F.lit("), not B")),
        F.concat(F.lit("first\nAnswer: "), flag, F.lit(" or Answer: C\nAnswer: D")),
        F.concat(F.lit("I would say "), status, F.lit(" or "), flag),
        F.lit("answer:\n\nB"),
        F.lit("E. No BAD word, 1A 2B"),
        F.lit("A\rAnswer: G\rx"),
    ]
    out = F.when(F.col("l_linenumber") == 1, cases[0])
    for number, text in enumerate(cases[1:], start=2):
        out = out.when(F.col("l_linenumber") == number, text)
    return out.otherwise(F.lit("nothing here"))


@query(
    rf"""
    WITH texts AS (
      SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
             (l_linenumber % 6) AS n_options,
             substr('ABCDE', 1 + (l_orderkey % 5)::INT, 1) AS gold, {_CHOICE_TEXT_SQL} AS text
      FROM lineitem),
    said AS (
      SELECT *, coalesce(
        nullif(regexp_extract(text, 'answer is \(?([A-J])\)?', 1), ''),
        nullif(regexp_extract(text, '(?m)^.*[aA]nswer:\s*([A-J])', 1), ''),
        nullif(regexp_extract(text, '(?s)^.*(?:^|[^\pL\pN_])([A-J])(?:[^\pL\pN_]|$)', 1), '')) AS letter
      FROM texts)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, letter,
           CASE WHEN letter IS NOT NULL THEN letter = gold
                WHEN n_options IN (1, 2, 4, 5) THEN gold = 'A'
                WHEN n_options = 3 THEN gold = 'C' ELSE FALSE END AS correct
    FROM said
    """
)
def choice_cascade(spark: SparkSession, sf: str) -> DataFrame:
    letters = F.substring(F.lit("ABCDE"), F.lit(1) + (F.col("l_orderkey") % 5).cast("int"), F.lit(1))
    items = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        letters.alias("gold"),
        E.choice_letter(_choice_text()).alias("letter"),
    )
    correct = G.choice_correct(F.col("gold"), F.col("letter"), F.col("l_linenumber") % 6)
    return items.withColumn("correct", correct).drop("gold")


@query(
    r"""
    WITH texts AS (
      SELECT p_partkey, CASE p_partkey % 4
        WHEN 0 THEN 'so \boxed{' || p_brand || '} or \boxed{x}'
        WHEN 1 THEN '\boxed{' || p_type || chr(10) || '}'
        WHEN 2 THEN 'empty \boxed{} box' ELSE 'no box {' || p_name || '}' END AS text FROM part)
    SELECT p_partkey,
           CASE WHEN regexp_matches(text, '\\boxed\{[^}]*\}')
                THEN regexp_extract(text, '\\boxed\{([^}]*)\}', 1) END AS box
    FROM texts
    """
)
def boxed_answer(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey") % 4
    text = (
        F.when(key == 0, F.concat(F.lit("so \\boxed{"), "p_brand", F.lit("} or \\boxed{x}")))
        .when(key == 1, F.concat(F.lit("\\boxed{"), "p_type", F.lit("\n}")))
        .when(key == 2, F.lit("empty \\boxed{} box"))
        .otherwise(F.concat(F.lit("no box {"), "p_name", F.lit("}")))
    )
    return table(spark, sf, "part").select("p_partkey", E.first_box(text).alias("box"))


# The expected content is stated shape by shape.
@query(
    r"""
    SELECT p_partkey, CASE p_partkey % 8
      WHEN 0 THEN 'a{' || p_name || '}c'
      WHEN 1 THEN p_brand
      WHEN 4 THEN p_name
      WHEN 6 THEN ''
      WHEN 7 THEN '{{' || p_name || '}{' || p_type || '}}' END AS box
    FROM part
    """
)
def balanced_box(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey") % 8
    name, brand, kind = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    text = (
        F.when(key == 0, F.concat(F.lit("x \\boxed{a{"), name, F.lit("}c} tail }")))
        .when(key == 1, F.concat(F.lit("\\boxed{"), kind, F.lit("} then \\boxed{"), brand, F.lit("}")))
        .when(key == 2, F.concat(F.lit("\\boxed{"), name))
        .when(key == 3, F.concat(F.lit("\\fbox{"), name, F.lit("}")))
        .when(key == 4, F.concat(F.lit("\\boxed{"), name, F.lit("} \\fbox{2}")))
        .when(key == 5, F.concat(F.lit("\\boxed "), name, F.lit(" {1}")))
        .when(key == 6, F.lit("\\boxed{}"))
        .otherwise(F.concat(F.lit("\\boxed{{{"), name, F.lit("}{"), kind, F.lit("}}} {}")))
    )
    return table(spark, sf, "part").select("p_partkey", E.last_balanced_box(text).alias("box"))


@query(
    r"""
    SELECT o_orderkey, CASE o_orderkey % 4
      WHEN 0 THEN o_orderpriority
      WHEN 1 THEN o_orderstatus
      WHEN 2 THEN o_orderpriority || '. more'
      ELSE o_orderstatus END AS answer
    FROM orders
    """
)
def final_answer_phrase(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey") % 4
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    text = (
        F.when(key == 0, F.concat(F.lit("The answer is: no. The answer is:  "), priority, F.lit(" .\nx")))
        .when(key == 1, F.concat(F.lit("Steps.\nThe answer is: "), status))
        .when(key == 2, F.concat(F.lit("The answer is: "), priority, F.lit(". more.")))
        .otherwise(F.concat(F.lit("Thus \\boxed{"), status, F.lit("}.")))
    )
    return table(spark, sf, "orders").select("o_orderkey", E.final_answer(text).alias("answer"))


@query(
    """
    WITH pairs AS (
      SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events),
    outs AS (
      SELECT event_id, k, event_id % 5 AS shape FROM pairs)
    SELECT event_id,
           CASE WHEN shape IN (0, 1) THEN '{"k":' || k || ',"on":true}'
                WHEN shape = 2 THEN '{"k":"' || k || '","on":true}'
                WHEN shape = 3 THEN 'null' END AS prediction,
           '{"k":' || k || ',"on":true}' AS answer,
           shape = 4 AS malformed,
           shape IN (0, 1) AS correct
    FROM outs
    """
)
def json_command_match(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    shape = F.col("event_id") % 5
    output = (
        F.when(shape == 0, F.concat(F.lit('{"command":{"k":'), k, F.lit(',"on":true}}')))
        .when(shape == 1, F.concat(F.lit(' {"x":[1], "command":{"on":true, "k":'), k, F.lit(".0}}")))
        .when(shape == 2, F.concat(F.lit('{"command":{"k":"'), k, F.lit('","on":true}}')))
        .when(shape == 3, F.lit('{"command":null}'))
        .otherwise(F.concat(F.lit('{"command":{"k":'), k, F.lit("}")))
    )
    gold = F.concat(F.lit('{"command":{"k":'), k, F.lit(', "on":true}}'))
    rows = table(spark, sf, "events").select(
        "event_id",
        E.json_command(output).alias("prediction"),
        E.json_command(gold).alias("answer"),
        E.malformed_json(output).alias("malformed"),
    )
    return rows.withColumn("correct", G.command_correct(F.col("answer"), F.col("prediction")))


@query(
    """
    WITH texts AS (
      SELECT page_id, CASE WHEN page_id % 3 = 0 THEN html
             ELSE html || '```' || chr(10) || ' ' || url || ' ' || chr(10) END AS text
      FROM pages)
    SELECT page_id, md5(split_part(text, '```', 1)) AS body,
           md5(CASE WHEN strpos(text, '```') > 0
                THEN trim(substr(text, strpos(text, '```') + 3), ' ' || chr(10) || chr(9) || chr(13))
                ELSE trim(substr(text, 3), ' ' || chr(10) || chr(9) || chr(13)) END) AS explanation
    FROM texts
    """
)
def fence_parts(spark: SparkSession, sf: str) -> DataFrame:
    fenced = F.concat(F.col("html"), F.lit("```\n "), F.col("url"), F.lit(" \n"))
    text = F.when(F.col("page_id") % 3 == 0, F.col("html")).otherwise(fenced)
    return table(spark, sf, "pages").select(
        "page_id",
        F.md5(E.completion_body(text)).alias("body"),
        F.md5(E.explanation(text)).alias("explanation"),
    )


@query(
    """
    SELECT doc_id, CASE WHEN lang IN ('en', 'fr', 'de') THEN lang ELSE 'other' END AS label,
           CASE WHEN strpos(text, ' the ') = 0 AND strpos(text, ', ') = 0 THEN length(text)
                WHEN strpos(text, ' the ') = 0 THEN strpos(text, ', ') - 1
                WHEN strpos(text, ', ') = 0 THEN strpos(text, ' the ') - 1
                ELSE least(strpos(text, ' the '), strpos(text, ', ')) - 1 END::INT AS kept_chars
    FROM documents
    """
)
def labels_and_stops(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id",
        E.expert_label(F.col("lang"), ["en", "fr", "de"]).alias("label"),
        F.length(E.cut_at_stops(F.col("text"), [" the ", ", "])).alias("kept_chars"),
    )


_PRICES_SQL = """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS gold,
           CASE l_linenumber % 5 WHEN 0 THEN l_extendedprice / 100
             WHEN 1 THEN l_extendedprice * 100 WHEN 2 THEN l_extendedprice * 1.00005
             WHEN 3 THEN l_extendedprice * 1.0002 ELSE l_extendedprice END AS said
    FROM lineitem
"""


@query(
    f"""
    WITH p AS ({_PRICES_SQL})
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           abs(said - gold) <= 1e-4 * greatest(abs(said), abs(gold))
           OR abs(said / 100 - gold) <= 1e-4 * greatest(abs(said / 100), abs(gold))
           OR abs(said * 100 - gold) <= 1e-4 * greatest(abs(said * 100), abs(gold)) AS agree
    FROM p
    """
)
def numeric_close(spark: SparkSession, sf: str) -> DataFrame:
    gold, shape = F.col("l_extendedprice"), F.col("l_linenumber") % 5
    said = (
        F.when(shape == 0, gold / 100)
        .when(shape == 1, gold * 100)
        .when(shape == 2, gold * 1.00005)
        .when(shape == 3, gold * 1.0002)
        .otherwise(gold)
    )
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        G.numbers_agree(gold, said).alias("agree"),
    )


# Gold and answer around a number, written @ here, and whether they agree.
_SHAPES = [
    ("\\frac@2", "\\frac{@}{2}", True),
    ("x=@", "@", True),
    ("@\\text{ cm}", "@", True),
    ("(@, 2)", "@, 2", True),
    ("(@.0,2)", "(@,2.0)", True),
    ("@", "@.01", False),
    ("@/7", "\\frac{@}{7}", True),
    ("\\sqrt5@", "\\sqrt{5}@", True),
    ("@\\%", "@", True),
    ("\\left[@,@\\right]", "[@,@]", True),
    ("@\\text{ a}\\text{ b}", "@", False),
    ("2\\sqrt", "2\\sqrt", True),
    ("\\dfrac{1}{@}", "\\tfrac1@", True),
    ("yx = @", "x=@", False),
    ("@^\\circ", "@\\$", True),
    ("[(@.0)]", "[(@)]", True),
    ("@,000", "@000.0", True),
    ("(1,@)", "(@,1,1)", False),
]
_SHAPE_VALUES = ", ".join(f"({i}, {verdict})" for i, (_, _, verdict) in enumerate(_SHAPES))


def _answer_pairs(spark: SparkSession, sf: str) -> DataFrame:
    shapes = F.array(*[F.struct(F.lit(g).alias("g"), F.lit(p).alias("p")) for g, p, _ in _SHAPES])
    shape = F.get(shapes, (F.col("p_partkey") % len(_SHAPES)).cast("int"))
    n = F.col("p_size").cast("string")
    return table(spark, sf, "part").select(
        "p_partkey",
        F.replace(shape["g"], F.lit("@"), n).alias("gold"),
        F.replace(shape["p"], F.lit("@"), n).alias("said"),
    )


@query(
    f"""
    SELECT p_partkey, verdict AS correct
    FROM part JOIN (VALUES {_SHAPE_VALUES}) AS s(shape, verdict)
      ON p_partkey % {len(_SHAPES)} = shape
    """
)
def latex_equiv(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _answer_pairs(spark, sf)
    return pairs.select("p_partkey", G.latex_equal(F.col("gold"), F.col("said")).alias("correct"))


@query(
    """
    SELECT p_partkey, replace(form, '@', p_size::VARCHAR) AS normal FROM part JOIN (VALUES
      (0, '\\frac{1}{@}'), (1, '@'), (2, '\\sqrt{2}@+\\sqrt{3}'), (3, '\\frac{@}{7}'),
      (4, '0.@7'), (5, '(@,0.5)'), (6, '\\frac{1}{2}')) AS s(shape, form)
      ON p_partkey % 7 = shape
    """.replace("\\\\", "\\")
)
def latex_normal_form(spark: SparkSession, sf: str) -> DataFrame:
    forms = [
        "\\tfrac{1}{@}", "x = @\\text{ km}", "\\sqrt2@ + \\sqrt{3}", "@/7", ".@7", "\\left(@, .5\\right)", " 0.5",
    ]
    shape = F.get(F.array(*[F.lit(f) for f in forms]), (F.col("p_partkey") % 7).cast("int"))
    text = F.replace(shape, F.lit("@"), F.col("p_size").cast("string"))
    return table(spark, sf, "part").select("p_partkey", latex.normalize(text).alias("normal"))


@query(
    f"""
    WITH said AS (
      SELECT d.doc_id, d.lang, d.n_chars / 10000.0 AS prob,
             chr(65 + l.quality) IS NOT DISTINCT FROM regexp_extract_all(d.text, '[A-E]')[-1] AS hit
      FROM documents d JOIN labels l USING (doc_id))
    SELECT lang, count(*) AS n, avg(hit::INT::DOUBLE) AS acc,
           avg((hit AND prob > 0.5)::INT::DOUBLE) AS acc_fluent
    FROM said GROUP BY lang
    """
)
def language_gated(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(
        "doc_id",
        "lang",
        (F.col("n_chars") / 10000.0).alias("prob"),
        E.last_option_letter(F.col("text")).alias("said"),
    )
    labels = table(spark, sf, "labels").select("doc_id", F.char(F.lit(65) + F.col("quality")).alias("gold"))
    graded = docs.join(labels, "doc_id").withColumn(
        "hit", G.same_answer(F.col("gold"), F.col("said"))
    )
    fluent = G.in_language(F.col("hit"), F.col("prob"))
    return graded.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("hit").cast("int")).alias("acc"),
        F.avg(fluent.cast("int")).alias("acc_fluent"),
    )


# Generated programs: the name of the function, and the text the cleaner must leave.
_PROGRAMS = [
    (
        "Sure!\n```python\nimport os\n\ndef @(a):\n    b = a\n    return b\n\nprint(@(1))\n```\nDone.",
        "import os\n\ndef @(a):\n    b = a\n    return b",
    ),
    (
        "def helper(x):\n    return x\ndef broken(:\n    return 1\ndef @(a):\n    return helper(a)\nstray = 1\n",
        "def helper(x):\n    return x\ndef @(a):\n    return helper(a)",
    ),
    ("def @(a):\n   b = a\n   c = 2\n    return b\n", "def @(a):\n    b = a\n    c = 2\n    return b"),
    ("def @(a):\n    pass\n", ""),
    ("no code at all", "no code at all"),
    ("def @ (a):\n    return a\n<end>\ndef other():\n    return 1", "def @(a):\n    return a"),
]


def _programs(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.lit("f"), F.col("p_partkey").cast("string"))
    texts = F.array(*[F.lit(raw) for raw, _ in _PROGRAMS])
    raw = F.get(texts, (F.col("p_partkey") % len(_PROGRAMS)).cast("int"))
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("task_id"),
        name.alias("entry_point"),
        F.replace(raw, F.lit("@"), name).alias("code"),
    )


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_CLEANED_VALUES = ", ".join(f"({i}, {_sql_text(out)})" for i, (_, out) in enumerate(_PROGRAMS))


@query(
    f"""
    SELECT p_partkey AS task_id, replace(cleaned, '@', 'f' || p_partkey) AS cleaned
    FROM part JOIN (VALUES {_CLEANED_VALUES}) AS s(shape, cleaned)
      ON p_partkey % {len(_PROGRAMS)} = shape
    """
)
def cleaned_code(spark: SparkSession, sf: str) -> DataFrame:
    programs = _programs(spark, sf)
    cleaned = clean_code(programs, "code", "entry_point", "cleaned", eofs=["\n<end>"])
    return cleaned.select("task_id", "cleaned")


@query(
    f"""
    SELECT count(*) FILTER (WHERE p_partkey % {len(_PROGRAMS)} <> 4)::BIGINT AS changed, count(*) AS total
    FROM part
    """
)
def cleaning_report(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = clean_code(_programs(spark, sf), "code", "entry_point", "cleaned", eofs=["\n<end>"])
    return changed_rows(cleaned, "code", "cleaned")


@query("SELECT p_partkey AS task_id, p_partkey % 3 = 0 AS valid FROM part")
def code_parses(spark: SparkSession, sf: str) -> DataFrame:
    name, key = F.translate("p_name", " ", "_"), F.col("p_partkey") % 3
    code = (
        F.when(key == 0, F.concat(F.lit("def "), name, F.lit("(a):\n    return a\n")))
        .when(key == 1, F.concat(F.lit("def "), name, F.lit("(a:\n    return a\n")))
        .otherwise(F.concat(name, F.lit(" = 1\x00")))
    )
    return table(spark, sf, "part").select(F.col("p_partkey").alias("task_id"), parses(code).alias("valid"))


@query(
    """
    WITH r AS (
      SELECT CASE WHEN l_orderkey % 50 > 0 THEN l_orderkey END AS l_orderkey, l_linenumber, l_partkey, l_suppkey,
             CASE WHEN l_returnflag = 'N' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS reward
      FROM lineitem),
    m AS (SELECT l_orderkey, avg(reward) AS mean, stddev_pop(reward) AS std FROM r GROUP BY l_orderkey)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, reward,
           round(greatest(-1.5, least(1.5, (reward - mean) / greatest(std, 1e-7))), 6)::DOUBLE + 0.0 AS norm_reward
    FROM r JOIN (SELECT l_orderkey AS k, mean, std FROM m) ON l_orderkey IS NOT DISTINCT FROM k
    """
)
def reward_norm_clip(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").select(
        # Some rows belong to no batch.
        F.when(F.col("l_orderkey") % 50 > 0, F.col("l_orderkey")).alias("l_orderkey"),
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        G.reward(F.col("l_returnflag") == "N").alias("reward"),
    )
    normal = normalized_rewards(items, ["l_orderkey"], clip=1.5)
    return normal.withColumn("norm_reward", F.round("norm_reward", 6))

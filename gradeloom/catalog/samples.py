"""Prompts, messages, chat renderings and unions on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.catalog.registry import query, table
from gradeloom.functions import prompts as P
from gradeloom.operators import chats
from gradeloom.operators.joins import missing
from gradeloom.plans.spec import TASKS
from gradeloom.sources.tables import labelled_union as union_of

_WS = "' ' || chr(9) || chr(10) || chr(13)"
_OPTIONS_SQL = "[p_brand, p_type, p_size::VARCHAR]"


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").withColumn(
        "options", F.array("p_brand", "p_type", F.col("p_size").cast("string"))
    )


@query(
    f"""
    SELECT p_partkey, p_name || chr(10) || 'Options: ' || chr(10)
           || array_to_string({_OPTIONS_SQL}, chr(10)) AS prompt FROM part
    """
)
def mcq_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(spark, sf).select(
        "p_partkey", P.options_prompt(F.col("p_name"), F.col("options")).alias("prompt")
    )


@query(
    """
    SELECT p_partkey, p_name || chr(10) || 'Options:' || chr(10) || 'A. ' || p_brand || chr(10)
             || 'B. ' || p_type || chr(10) || 'C. ' || p_size || chr(10)
             || CASE WHEN p_partkey % 4 < 3 THEN '' ELSE 'D. ' || p_brand || chr(10)
             || 'E. ' || p_type || chr(10) || 'F. ' || p_size || chr(10) END AS prompt,
           CASE WHEN p_partkey % 4 = 3 THEN '6 options, but only 5 letters' END AS error FROM part
    """
)
def lettered_options(spark: SparkSession, sf: str) -> DataFrame:
    many = F.concat(F.col("options"), F.col("options"))
    options = F.when(F.col("p_partkey") % 4 < 3, F.col("options")).otherwise(many)
    return _parts(spark, sf).select(
        "p_partkey",
        P.lettered_options(F.col("p_name"), options).alias("prompt"),
        P.options_error(options).alias("error"),
    )


@query(
    """
    SELECT p_partkey, floor(p_retailprice) AS gold FROM part
    """
)
def gold_number(spark: SparkSession, sf: str) -> DataFrame:
    solution = F.concat(
        F.lit("It has "), F.col("p_size").cast("string"), F.lit(" parts.\n#### "),
        F.col("p_retailprice").cast("string"),
    )
    return table(spark, sf, "part").select("p_partkey", P.gold_number(solution).alias("gold"))


@query(
    """
    SELECT p_partkey, p_type AS type, 'n{' || p_size || '}' AS gold FROM part
    """
)
def gold_box(spark: SparkSession, sf: str) -> DataFrame:
    solution = F.concat(
        F.lit("First \\boxed{0}, then \\boxed{n{"), F.col("p_size").cast("string"), F.lit("}}.")
    )
    return table(spark, sf, "part").select(
        "p_partkey", F.col("p_type").alias("type"), P.gold_box(solution).alias("gold")
    )


@query(
    """
    SELECT p_partkey,
           CASE WHEN p_partkey % 3 < 2 THEN 'Make a ' || p_name || '. Your code should satisfy the following assertion:'
             || chr(10) || '```python' || chr(10) || 'assert f(' || p_size || ') == "a"' || chr(10) || '```' END AS instruction,
           '```python' AS response_prefix FROM part
    """
)
def code_task_docstring(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey") % 3
    stop = F.when(key == 0, F.lit(".")).otherwise(F.lit(""))
    prompt = F.concat(
        F.lit('"""\nMake a '), F.col("p_name"), stop, F.lit("\nassert f("),
        F.col("p_size").cast("string"), F.lit(') == "a"\n'),
        F.when(key == 2, F.lit("")).otherwise(F.lit('"""\n')),
    )
    instruction, prefix = P.code_task_from_docstring(prompt)
    return table(spark, sf, "part").select(
        "p_partkey", instruction.alias("instruction"), prefix.alias("response_prefix")
    )


@query(
    """
    SELECT p_partkey,
           'Write a solution to the following problem:' || chr(10) || '```python' || chr(10)
             || 'def f' || p_partkey || '(x):' || chr(10) || '```' AS instruction,
           '```python' || chr(10) || 'def f' || p_partkey || '(x):' AS response_prefix FROM part
    """
)
def code_task_bare(spark: SparkSession, sf: str) -> DataFrame:
    prompt = F.concat(F.lit("\n\ndef f"), F.col("p_partkey").cast("string"), F.lit("(x):\n  "))
    instruction, prefix = P.code_task_from_prompt(prompt)
    return table(spark, sf, "part").select(
        "p_partkey", instruction.alias("instruction"), prefix.alias("response_prefix")
    )


@query(
    """
    SELECT text AS question, 'reasoning' AS label FROM documents
    UNION ALL SELECT text, 'math' FROM benchmark
    UNION ALL SELECT url, 'code' FROM pages
    """
)
def labelled_union(spark: SparkSession, sf: str) -> DataFrame:
    return union_of(
        {
            "reasoning": table(spark, sf, "documents"),
            "math": table(spark, sf, "benchmark"),
            "code": table(spark, sf, "pages"),
        },
        {"reasoning": F.col("text"), "math": F.col("text"), "code": F.col("url")},
    )


@query(
    """
    SELECT conv_id, turn, coalesce(CASE WHEN role = 'user' THEN text END,
           CASE WHEN role = 'system' THEN role END, 'none') AS problem FROM conversations
    """
)
def problem_text(spark: SparkSession, sf: str) -> DataFrame:
    columns = [
        F.when(F.col("role") == "user", F.col("text")),
        F.when(F.col("role") == "system", F.col("role")),
        F.lit("none"),
    ]
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", P.problem_text(columns).alias("problem")
    )


def _head_sql(role: str) -> str:
    return f"'<|start_header_id|>{role}<|end_header_id|>' || chr(10) || chr(10)"


_TRIMMED = f"trim(text, {_WS})"


@query(
    f"""
    SELECT doc_id,
      md5('<s>' || {_head_sql('system')} || 'Be brief.<|eot_id|>' || {_head_sql('user')} || {_TRIMMED}
          || '<|eot_id|>' || {_head_sql('assistant')}) AS header,
      md5('<s>' || {_head_sql('system')} || 'Be brief.<|eot_id|>' || {_head_sql('user')} || {_TRIMMED}
          || '<|eot_id|>' || {_head_sql('assistant')} || 'Let''s think step by step') AS step_by_step,
      md5('<|im_start|>system' || chr(10) || 'Be brief.<|im_end|><|im_start|>user' || chr(10) || {_TRIMMED}
          || '<|im_end|><|im_start|>assistant' || chr(10) || '<think>' || chr(10) || chr(10) || '</think>'
          || chr(10) || chr(10)) AS im_start,
      md5('Be brief.' || chr(10) || chr(10) || '@@ Instruction:' || chr(10) || {_TRIMMED} || chr(10) || chr(10)
          || '@@ Response:' || lang) AS instruction
    FROM documents
    """
)
def rendered_prompts(spark: SparkSession, sf: str) -> DataFrame:
    system = F.lit(" Be brief.\n")
    plain = P.build_messages(F.col("text"), system)
    started = P.build_messages(F.col("text"), system, F.col("lang"))
    return table(spark, sf, "documents").select(
        "doc_id",
        F.md5(P.render_header_style(plain, "<s>")).alias("header"),
        F.md5(P.render_header_style(plain, "<s>", suffix=P.STEP_BY_STEP)).alias("step_by_step"),
        F.md5(P.render_im_start_style(plain)).alias("im_start"),
        F.md5(P.render_with_prefill(started, P.render_instruction_style)).alias("instruction"),
    )


@query(
    f"""
    SELECT doc_id, md5({_head_sql('system')} || trim('{TASKS["math"].system}', {_WS}) || '<|eot_id|>'
      || {_head_sql('user')} || {_TRIMMED} || '<|eot_id|>' || {_head_sql('assistant')}) AS prompt
    FROM documents
    """
)
def task_prompt(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumnRenamed("text", "problem")
    return docs.select("doc_id", F.md5(TASKS["math"].prompt()).alias("prompt"))


_TURNS = """
    t AS (SELECT *, min(turn) OVER c AS first_turn, max(turn) OVER c AS last_turn,
                 first(role) OVER (PARTITION BY conv_id ORDER BY turn) AS first_role
          FROM conversations WINDOW c AS (PARTITION BY conv_id))
"""
_RUNNING = "sum(length(piece)) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT"


@query(
    f"""
    WITH {_TURNS}, p AS (
      SELECT conv_id, turn, CASE WHEN turn = first_turn THEN '<s>' ELSE '' END
        || '<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10) || {_TRIMMED} || '<|eot_id|>'
        || CASE WHEN turn = last_turn THEN {_head_sql('assistant')} ELSE '' END AS piece FROM t)
    SELECT conv_id, turn, piece, {_RUNNING} AS stop, {_RUNNING} - length(piece) AS start FROM p
    """
)
def chat_header(spark: SparkSession, sf: str) -> DataFrame:
    return chats.header_pieces(table(spark, sf, "conversations"), "<s>")


@query(
    f"""
    WITH {_TURNS}, p AS (
      SELECT conv_id, turn, '<|im_start|>' || role || chr(10) || {_TRIMMED} || '<|im_end|>'
        || CASE WHEN turn = last_turn THEN '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) || chr(10)
             || '</think>' || chr(10) || chr(10) ELSE '' END AS piece FROM t)
    SELECT conv_id, turn, piece, {_RUNNING} AS stop, {_RUNNING} - length(piece) AS start FROM p
    """
)
def chat_im_start(spark: SparkSession, sf: str) -> DataFrame:
    return chats.im_start_pieces(table(spark, sf, "conversations"))


@query(
    f"""
    WITH {_TURNS}, m AS (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 - (first_role = 'system')::INT AS place FROM t),
    w AS (
      SELECT *, bool_or(place >= 0 AND (role = 'user') <> (place % 2 = 0)) OVER (PARTITION BY conv_id) AS wrong
      FROM m),
    p AS (
      SELECT conv_id, turn, CASE WHEN wrong THEN 'roles must alternate' END AS error,
        CASE WHEN NOT wrong THEN
          CASE WHEN role = 'system' AND turn = first_turn THEN {_TRIMMED} || chr(10) || chr(10)
               WHEN role = 'user' THEN '@@ Instruction:' || chr(10) || {_TRIMMED} || chr(10) || chr(10)
               WHEN role = 'assistant' THEN '@@ Response:' || chr(10) || {_TRIMMED} ELSE '' END
          || CASE WHEN turn = last_turn AND role = 'user' THEN '@@ Response:' ELSE '' END END AS piece
      FROM w)
    SELECT conv_id, turn * 3 + turn % 2 AS turn, piece, error, {_RUNNING} AS stop, {_RUNNING} - length(piece) AS start FROM p
    """
)
def chat_instruction(spark: SparkSession, sf: str) -> DataFrame:
    # The same turns, numbered with gaps.
    gaps = F.col("turn") * 3 + F.col("turn") % 2
    return chats.instruction_pieces(table(spark, sf, "conversations").withColumn("turn", gaps))


@query(
    f"""
    WITH {_TURNS}, p AS (
      SELECT conv_id, turn, role,
        length(CASE WHEN turn = first_turn THEN '<s>' ELSE '' END || '<|start_header_id|>' || role
               || '<|end_header_id|>') + 2 AS head,
        length({_TRIMMED}) + 10 AS said,
        CASE WHEN turn = last_turn THEN length({_head_sql('assistant')}) ELSE 0 END AS tail FROM t),
    o AS (
      SELECT *, (sum(head + said + tail) OVER (PARTITION BY conv_id ORDER BY turn) - head - said - tail)::BIGINT AS base
      FROM p)
    SELECT conv_id, turn, base AS start, base + head AS stop, FALSE AS mask FROM o
    UNION ALL SELECT conv_id, turn, base + head, base + head + said, role = 'assistant' FROM o
    UNION ALL SELECT conv_id, turn, base + head + said, base + head + said + tail, FALSE FROM o WHERE tail > 0
    """
)
def assistant_spans(spark: SparkSession, sf: str) -> DataFrame:
    return chats.assistant_spans(table(spark, sf, "conversations"), "<s>")


@query(
    """
    WITH picked AS (
      SELECT doc_id, text, row_number() OVER (ORDER BY md5('3:0:' || doc_id), doc_id) AS n FROM documents)
    SELECT md5(string_agg(n || '. ' || text, chr(10) ORDER BY n)) AS questions FROM picked WHERE n <= 100
    """
)
def question_digest(spark: SparkSession, sf: str) -> DataFrame:
    digest = chats.digest_text(table(spark, sf, "documents"), "doc_id", "text", 100, 3)
    return digest.select(F.md5("questions").alias("questions"))


@query(
    """
    SELECT d.doc_id, md5(CASE WHEN l.quality = 1 THEN d.lang ELSE d.source || d.text END) AS joined,
           md5(CASE WHEN l.quality = 1 THEN d.lang ELSE d.source || chr(10) || d.text END) AS joined_by_line
    FROM documents d JOIN labels l USING (doc_id)
    """
)
def full_source(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    solution = F.when(F.col("quality") == 1, F.col("lang"))
    return rows.select(
        "doc_id",
        F.md5(P.full_source(F.col("source"), F.col("text"), solution)).alias("joined"),
        F.md5(P.full_source(F.col("source"), F.col("text"), solution, "\n")).alias("joined_by_line"),
    )


@query(
    "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"
)
def missing_generations(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return missing(docs, table(spark, sf, "labels"), "doc_id")

"""Accuracy, pass@k, verdict and population reports, run histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.catalog.registry import query, table
from gradeloom.functions import extract as E
from gradeloom.functions import grade as G
from gradeloom.operators import joins as J
from gradeloom.operators import ranking, reports, runs

from gradeloom.operators.population import member_likelihood as of_members
from gradeloom.operators.positions import with_position
from gradeloom.session import cut_lineage
from gradeloom.sources import runlogs


@query(
    """
    SELECT lang, count(*) AS n,
           avg((chr(65 + quality) IS NOT DISTINCT FROM regexp_extract_all(text, '[A-E]')[-1])::INT::DOUBLE) AS acc
    FROM documents JOIN labels USING (doc_id) GROUP BY lang
    """
)
def letter_accuracy_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    said = table(spark, sf, "documents").select(
        "doc_id", "lang", E.last_option_letter(F.col("text")).alias("prediction")
    )
    gold = table(spark, sf, "labels").select(
        "doc_id", F.char(F.lit(65) + F.col("quality")).alias("answer")
    )
    graded = said.join(gold, "doc_id").withColumn(
        "correct", G.same_answer(F.col("answer"), F.col("prediction"))
    )
    return reports.accuracy_report(graded, ["lang"])


@query(
    """
    WITH g AS (
      SELECT quality = 1 AS ok, CASE lang WHEN 'en' THEN 0.9 ELSE 0.2 END AS en,
             CASE lang WHEN 'fr' THEN 0.5 ELSE 0.6 END AS fr
      FROM documents LEFT JOIN labels USING (doc_id))
    SELECT avg(coalesce(ok, FALSE)::INT::DOUBLE) AS acc,
           avg(coalesce(ok AND en > 0.5, FALSE)::INT::DOUBLE) AS acc_en,
           avg(coalesce(ok AND fr > 0.5, FALSE)::INT::DOUBLE) AS acc_fr FROM g
    """
)
def accuracy_by_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    details = docs.join(labels, "doc_id", "left").select(
        (F.col("quality") == 1).alias("correct"),
        F.when(F.col("lang") == "en", 0.9).otherwise(0.2).alias("lang_en"),
        F.when(F.col("lang") == "fr", 0.5).otherwise(0.6).alias("lang_fr"),
    )
    return reports.language_report(details, ["en", "fr"])


@query(
    """
    SELECT doc_id, count(*) AS n_rows FROM (
      SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM labels WHERE toxic = 1)
    GROUP BY doc_id HAVING count(*) <> 1
    """
)
def duplicate_details(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels")
    twice = labels.select("doc_id").unionByName(labels.where("toxic = 1").select("doc_id"))
    return J.not_single(twice, "doc_id")


@query(
    """
    SELECT count(*) AS n_rows, count(DISTINCT (l_orderkey, l_linenumber)) AS n_distinct,
           count(*) = count(DISTINCT (l_orderkey, l_linenumber)) AS complete FROM lineitem
    """
)
def identifier_completeness(spark: SparkSession, sf: str) -> DataFrame:
    return J.completeness(
        table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"),
        ["l_orderkey", "l_linenumber"],
    ).withColumn("n_rows", F.col("n_rows").cast("bigint"))


@query(
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderpriority AS problem
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    """
)
def completions_with_problem(spark: SparkSession, sf: str) -> DataFrame:
    problems = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("sample_id"), F.col("o_orderpriority").alias("problem")
    )
    completions = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("sample_id"), "l_linenumber", "l_partkey", "l_suppkey"
    )
    return J.with_generations(problems, completions).withColumnRenamed("sample_id", "l_orderkey")


@query(
    """
    SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
    """
)
def only_correct(spark: SparkSession, sf: str) -> DataFrame:
    details = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("correct"))
    return J.only_correct(table(spark, sf, "documents").select("doc_id", "lang"), details, "doc_id")


@query(
    """
    SELECT event_type, unnest([event_type || '/mean', event_type || '/std', event_type || '/min', event_type || '/max']) AS metric,
           round(unnest([avg(value), stddev_pop(value), min(value), max(value)]), 6) AS value
    FROM events GROUP BY event_type
    """
)
def metric_bundle(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_type", "value")
    bundle = reports.metric_bundle(events, F.col("value"), F.col("event_type"), ["event_type"])
    return bundle.withColumn("value", F.round("value", 6))


# Attempts: a line item is an attempt at its order, numbered by part and supplier.
def _attempts(spark: SparkSession, sf: str) -> DataFrame:
    def status(flag: str, value: str) -> F.Column:
        return F.when(F.col(flag) == value, F.lit("pass")).otherwise(F.lit("fail"))

    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("task_id"),
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        "l_extendedprice",
        "l_quantity",
        status("l_returnflag", "N").alias("base_status"),
        status("l_linestatus", "O").alias("plus_status"),
    )


def _verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts with their number. Ranges of part keys are the blocks of an order."""
    order = ["l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity"]
    arrived = with_position(_attempts(spark, sf), order, ["task_id"], "completion_id", width=1024)
    return arrived.select("task_id", "completion_id", "base_status", "plus_status")


_VERDICTS_SQL = """
    v AS (SELECT l_orderkey AS task_id,
            row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity) - 1 AS completion_id,
            CASE WHEN l_returnflag = 'N' THEN 'pass' ELSE 'fail' END AS base_status,
            CASE WHEN l_linestatus = 'O' THEN 'pass' ELSE 'fail' END AS plus_status
          FROM lineitem)
"""
_PER_TASK_SQL = f"""
    {_VERDICTS_SQL},
    t AS (SELECT task_id, count(*) AS attempts, count(*) FILTER (base_status = 'pass') AS base,
                 count(*) FILTER (base_status = 'pass' AND plus_status = 'pass') AS plus
          FROM v GROUP BY task_id)
"""


def _flags() -> dict[str, F.Column]:
    base, plus = F.col("base_status"), F.col("plus_status")
    return {"base": G.base_passed(base), "plus": G.plus_passed(base, plus)}


@query(
    f"""
    WITH {_VERDICTS_SQL}
    SELECT task_id, completion_id, base_status, plus_status FROM v
    """
)
def completion_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return _verdicts(spark, sf)


@query(f"WITH {_PER_TASK_SQL} SELECT task_id, attempts, base, plus FROM t")
def attempts_per_task(spark: SparkSession, sf: str) -> DataFrame:
    return reports.attempts_per_task(_attempts(spark, sf), _flags())


def _pass_sql(passes: str, k: int) -> str:
    """The estimate as binomial coefficients, as the published formula states it."""
    ratio = (
        f"list_product([({passes} * 0 + attempts - {passes} - j)::DOUBLE / (attempts - j) "
        f"for j in range({k})])"
    )
    return (
        f"SELECT 'lines_{passes}_pass@{k}' AS metric, "
        f"round(avg(CASE WHEN attempts - {passes} < {k} THEN 1.0 ELSE 1.0 - {ratio} END), 9) AS value "
        f"FROM t HAVING min(attempts) >= {k}"
    )


@query(
    f"WITH {_PER_TASK_SQL} "
    + " UNION ALL ".join(_pass_sql(p, k) for p in ("base", "plus") for k in (1, 10, 100))
)
def pass_at_k(spark: SparkSession, sf: str) -> DataFrame:
    per_task = reports.attempts_per_task(_attempts(spark, sf), _flags())
    report = reports.pass_at_k_report(per_task, ["base", "plus"], prefix="lines_")
    return report.select("metric", F.round("value", 9).alias("value"))


# The same over suppliers and parts: enough attempts per task for larger k.
@query(
    """
    WITH t AS (SELECT l_suppkey AS task_id, count(*) AS attempts,
                      count(*) FILTER (l_returnflag = 'N') AS base FROM lineitem GROUP BY l_suppkey)
    """
    + " UNION ALL ".join(_pass_sql("base", k) for k in (1, 10, 100))
)
def pass_at_k_many_attempts(spark: SparkSession, sf: str) -> DataFrame:
    verdicts = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("task_id"), "l_returnflag")
    per_task = reports.attempts_per_task(verdicts, {"base": F.col("l_returnflag") == "N"})
    report = reports.pass_at_k_report(per_task, ["base"], prefix="lines_")
    return report.select("metric", F.round("value", 9).alias("value"))


@query(
    f"""
    WITH {_VERDICTS_SQL}
    SELECT task_id, completion_id, base_status AS base, plus_status AS plus,
           count(*) OVER (PARTITION BY task_id) AS nfiles
    FROM v
    """
)
def verdict_lists(spark: SparkSession, sf: str) -> DataFrame:
    return reports.verdict_lists(cut_lineage(_verdicts(spark, sf)))


@query(
    f"""
    WITH {_PER_TASK_SQL}
    SELECT c.o_orderkey AS task_id, o_orderpriority, coalesce(attempts, 0) AS attempts, coalesce(base, 0) AS base,
           coalesce(plus, 0) AS plus, attempts IS NOT NULL AS has_verdicts
    FROM (SELECT o_orderkey, o_orderpriority FROM orders
          UNION ALL SELECT -c_custkey, 'none' FROM customer) c LEFT JOIN t ON o_orderkey = task_id
    """
)
def verdict_counts_on_details(spark: SparkSession, sf: str) -> DataFrame:
    details = table(spark, sf, "orders").select(F.col("o_orderkey").alias("task_id"), "o_orderpriority")
    # Tasks that no verdict is about.
    untested = table(spark, sf, "customer").select(-F.col("c_custkey"), F.lit("none"))
    details = details.union(untested)
    per_task = reports.attempts_per_task(_attempts(spark, sf), _flags())
    return reports.with_verdict_counts(details, per_task)


@query(
    """
    WITH g AS (
      SELECT CASE WHEN lang IN ('en', 'fr', 'de') THEN lang ELSE 'other' END AS expert_label, quality = 1 AS ok
      FROM documents LEFT JOIN labels USING (doc_id)),
    routed AS (SELECT *, expert_label IN ('en', 'fr') AS evaluated FROM g)
    SELECT expert_label, count(*) AS num_samples, avg(coalesce(ok, FALSE)::INT::DOUBLE) AS test_acc
    FROM routed WHERE evaluated GROUP BY expert_label
    UNION ALL
    SELECT 'final_test_acc', count(*), count(*) FILTER (evaluated AND ok) / count(*) FROM routed
    """
)
def dispatch_report(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(
        "doc_id", E.expert_label(F.col("lang"), ["en", "fr", "de"]).alias("expert_label")
    )
    labels = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("correct"))
    experts = docs.select("expert_label").where(F.col("expert_label").isin("en", "fr"))
    routed = J.with_experts(docs, experts).join(labels, "doc_id", "left")
    return reports.routed_report(routed)


@query("SELECT count(*) AS num_samples FROM documents")
def sample_count(spark: SparkSession, sf: str) -> DataFrame:
    return reports.sample_count(table(spark, sf, "documents").select("doc_id"))


# --- runs -----------------------------------------------------------------


@query(
    """
    WITH h AS (
      SELECT user_id, event_id, (value - 20) / 500 AS valid_acc, value / 500 AS test_acc,
             coalesce(max(CASE WHEN value > 20 THEN value END) OVER w, 0) AS top
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    b AS (
      SELECT a.user_id, a.event_id, CASE WHEN a.top > 0 THEN (a.top - 20) / 500 ELSE 0 END AS best_val_acc,
             CASE WHEN a.top > 0 THEN a.top / 500 ELSE 0 END AS test_at_best_val FROM h a)
    SELECT user_id, event_id, round(best_val_acc, 9) AS best_val_acc,
           round(test_at_best_val, 9) AS test_at_best_val FROM b
    """
)
def best_so_far(spark: SparkSession, sf: str) -> DataFrame:
    """Test scores here are a function of the validation score, so ties carry the same one."""
    history = table(spark, sf, "events").select(
        "user_id",
        "event_id",
        ((F.col("value") - 20) / 500).alias("valid_acc"),
        (F.col("value") / 500).alias("test_acc"),
    )
    best = runs.best_so_far(history, ["user_id"], "event_id")
    return best.select(
        "user_id",
        "event_id",
        F.round("best_val_acc", 9).alias("best_val_acc"),
        F.round("test_at_best_val", 9).alias("test_at_best_val"),
    )


@query(
    """
    WITH h AS (
      SELECT event_type, event_id, floor(value / 10) / 100 AS valid_acc, event_id / 1000000 AS test_acc FROM events),
    top AS (SELECT event_type, event_id, max(valid_acc) OVER (PARTITION BY event_type ORDER BY event_id) AS best_val_acc
            FROM h),
    firsts AS (SELECT event_type, valid_acc AS best_val_acc, min(event_id) AS first_at FROM h GROUP BY ALL)
    SELECT event_type, event_id, best_val_acc, CASE WHEN best_val_acc > 0 THEN first_at / 1000000 ELSE 0 END AS test_at_best_val
    FROM top JOIN firsts USING (event_type, best_val_acc)
    """
)
def best_so_far_ties(spark: SparkSession, sf: str) -> DataFrame:
    """Coarse scores with many ties: the score at the earliest of them is carried."""
    history = table(spark, sf, "events").select(
        "event_type",
        "event_id",
        (F.floor(F.col("value") / 10) / 100).alias("valid_acc"),
        (F.col("event_id") / 1000000).alias("test_acc"),
    )
    best = runs.best_so_far(history, ["event_type"], "event_id")
    return best.drop("valid_acc", "test_acc")


@query(
    """
    WITH h AS (
      SELECT user_id AS run, event_id AS iter, (value - 20) / 500 AS valid_acc, value / 500 AS test_acc,
             coalesce(max(CASE WHEN value > 20 THEN value END) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS top
      FROM events),
    s AS (
      SELECT run, iter, unnest(['valid_acc', 'test_acc', 'best_val_acc', 'test_at_best_val']) AS metric,
             unnest([valid_acc, test_acc, CASE WHEN top > 0 THEN (top - 20) / 500 ELSE 0 END,
                     CASE WHEN top > 0 THEN top / 500 ELSE 0 END]) AS value FROM h)
    SELECT run, iter, metric, round(value, 9) AS value FROM s
    UNION ALL
    SELECT user_id, event_id, 'rewards/' || event_type, round(value, 9) FROM events
    """
)
def step_records(spark: SparkSession, sf: str) -> DataFrame:
    """What is logged at each evaluation step, as one row per scalar."""
    events = table(spark, sf, "events").select(
        F.col("user_id").alias("run"), F.col("event_id").alias("iter"), "event_type", "value"
    )
    history = events.select(
        "run",
        "iter",
        ((F.col("value") - 20) / 500).alias("valid_acc"),
        (F.col("value") / 500).alias("test_acc"),
    )
    running = events.select(
        "run", "iter", F.concat(F.lit("rewards/"), "event_type").alias("metric"), "value"
    )
    records = runs.step_records(history, running)
    return records.withColumn("value", F.round("value", 9))


_LOG_TEXT_SQL = """
    l AS (SELECT (user_id % 4)::INT AS node, 'results/' || (user_id % 4) || '/' || lpad(event_id::VARCHAR, 12, '0') AS path,
                 event_id, value FROM events)
"""


def _logs(spark: SparkSession, sf: str) -> DataFrame:
    """One small log file per event: two good records and a bad block."""
    node = (F.col("user_id") % 4).cast("int")
    number, value = F.col("event_id").cast("string"), F.col("value").cast("string")
    text = F.concat(
        F.lit('{\n    "iter": '), F.lit("0"), F.lit(',\n    "loss": '), value,
        F.lit("\n}\n{\n    iter: "), number, F.lit(", nested: {loss: null, iter: "), number,
        F.lit("}\n}\n{ bad } tail"),
    )
    path = F.concat(
        F.lit("results/"), node.cast("string"), F.lit("/"), F.lpad(number, 12, "0")
    )
    return table(spark, sf, "events").select(node.alias("node"), path.alias("path"), text.alias("text"))


@query(
    f"""
    WITH {_LOG_TEXT_SQL}
    SELECT node, path, 0::INT AS pos, 0::BIGINT AS iter, value AS loss, FALSE AS corrupt FROM l
    UNION ALL SELECT node, path, 1, event_id, NULL, FALSE FROM l
    UNION ALL SELECT node, path, 2, NULL, NULL, TRUE FROM l
    """
)
def parsed_run_log(spark: SparkSession, sf: str) -> DataFrame:
    records = runlogs.log_records(_logs(spark, sf), "iter bigint, loss double")
    return records.select(
        "node", "path", "pos", "record.iter", "record.loss", F.col("corrupt").isNotNull().alias("corrupt")
    )


@query(
    f"""
    WITH {_LOG_TEXT_SQL}
    SELECT node, count(*) AS corrupt, 3 * count(*) AS blocks FROM l GROUP BY node
    """
)
def corrupt_log_blocks(spark: SparkSession, sf: str) -> DataFrame:
    records = runlogs.log_records(_logs(spark, sf), "iter bigint, loss double", repair=True)
    return runlogs.corrupt_blocks(records, ["node"])


@query(
    f"""
    WITH {_LOG_TEXT_SQL},
    r AS (SELECT node, path, 0 AS pos, value FROM l UNION ALL SELECT node, path, 1, NULL FROM l),
    s AS (SELECT node, row_number() OVER (PARTITION BY node ORDER BY path, pos) - 1 AS step, value FROM r)
    SELECT node, step, value, TRUE AS at_start FROM s WHERE value IS NOT NULL
    """
)
def step_series(spark: SparkSession, sf: str) -> DataFrame:
    records = runlogs.log_records(_logs(spark, sf), "iter bigint, loss double")
    good = records.where(F.col("corrupt").isNull()).select("node", "path", "pos", "record.*")
    return runs.step_series(good, "loss")


@query(
    """
    WITH e AS (
      SELECT event_type, event_id, CASE WHEN event_id % 3 > 0 THEN value END AS v, event_id % 50 = 0 AS reset FROM events),
    p AS (
      SELECT *, coalesce(sum(reset::INT) OVER (PARTITION BY event_type ORDER BY event_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM e),
    m AS (
      SELECT *, count(v) OVER w AS n, sum(v) OVER w AS s FROM p
      WINDOW w AS (PARTITION BY event_type, epoch ORDER BY event_id)),
    x AS (SELECT event_type, event_id, CASE WHEN n >= 1 THEN s / (n + 1e-8) END AS mean FROM m)
    SELECT event_type, event_id, round(coalesce(last_value(mean IGNORE NULLS) OVER
             (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0), 6) AS running_mean FROM x
    """
)
def running_mean_reset(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "events").select(
        "event_type",
        "event_id",
        F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("value"),
        (F.col("event_id") % 50 == 0).alias("reset"),
    )
    means = runs.running_mean(log, ["event_type"], "event_id")
    return means.select("event_type", "event_id", F.round("running_mean", 6).alias("running_mean"))


@query(
    """
    SELECT l_suppkey AS node, max('results/' || l_suppkey || '/' || strftime(l_shipdate, '%Y-%m-%d')) AS path
    FROM lineitem GROUP BY l_suppkey
    """
)
def latest_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    paths = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("node"),
        F.concat(F.lit("results/"), F.col("l_suppkey").cast("string"), F.lit("/"), day).alias("path"),
    )
    return runlogs.chosen_checkpoint(paths)


@query(
    """
    SELECT o_orderkey, 0::INT AS round, o_custkey::INT AS node, (o_orderkey % 7)::INT AS neighbour FROM orders
    UNION ALL SELECT o_orderkey, 0, o_custkey::INT, 99 FROM orders
    UNION ALL SELECT o_orderkey, 0, 100000, NULL FROM orders
    UNION ALL SELECT o_orderkey, 1, 3, o_custkey::INT FROM orders
    """
)
def contact_rounds(spark: SparkSession, sf: str) -> DataFrame:
    customer = F.col("o_custkey").cast("string")
    near = (F.col("o_orderkey") % 7).cast("string")
    text = F.concat(
        F.lit('[{"'), customer, F.lit('": ['), near, F.lit(', 99], "100000": []}, {"3": ['),
        customer, F.lit("]}]"),
    )
    rounds = table(spark, sf, "orders").select("o_orderkey", text.alias("text"))
    return runlogs.contact_edges(rounds)


# --- choosing members -------------------------------------------------------


def _performance(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("member"),
        F.col("o_orderpriority").alias("perf"),
        (-F.floor(F.col("o_totalprice") / 1000)).cast("bigint").alias("mean_ll"),
    )


_PERFORMANCE_SQL = """
    p AS (SELECT o_orderkey AS member, o_orderpriority AS perf,
                 -floor(o_totalprice / 1000)::BIGINT AS mean_ll FROM orders)
"""


@query(f"WITH {_PERFORMANCE_SQL} SELECT * FROM p ORDER BY perf DESC, member LIMIT 1")
def best_member(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.best_member(_performance(spark, sf))


@query(f"WITH {_PERFORMANCE_SQL} SELECT * FROM p ORDER BY perf DESC, mean_ll DESC, member LIMIT 1")
def best_member_by_likelihood(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.best_member_by_likelihood(_performance(spark, sf))


@query(
    f"""
    WITH {_PERFORMANCE_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY mean_ll DESC, member) AS n FROM p)
    SELECT member, perf, mean_ll FROM r WHERE n <= floor(0.2 * (SELECT count(*) FROM p))
    """
)
def elite_members(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.elites(_performance(spark, sf), 0.2, "mean_ll")


@query(
    """
    SELECT user_id AS member, coalesce(avg(value) FILTER (event_type IN ('click', 'view') AND value > 200), 0) AS mean_ll
    FROM events GROUP BY user_id
    """.replace("coalesce(avg", "round(coalesce(avg").replace("0) AS mean_ll", "0), 6) AS mean_ll")
)
def member_likelihood(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    members = events.select(F.col("user_id").alias("member")).distinct()
    samples = events.select(
        F.col("user_id").alias("member"),
        F.col("value").alias("mean_lp"),
        (F.col("event_type").isin("click", "view") & (F.col("value") > 200)).alias("correct"),
    )
    return of_members(members, samples).withColumn("mean_ll", F.round("mean_ll", 6))

"""Composed evaluations, reports and joins on small hand-made tables."""

import pytest
from pyspark.sql import functions as F

from gradeloom.functions.estimates import pass_at_k
from gradeloom.operators import joins as J
from gradeloom.operators import logprobs, reports
from gradeloom.operators.joins import with_experts
from gradeloom.plans import evaluate as V
from gradeloom.plans.spec import TASKS


def _metrics(evaluation):
    return {r.metric: r.value for r in evaluation.metrics.collect()}


def _generations(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "sample_id bigint, generation string")


def test_letters_and_languages(spark):
    samples = spark.createDataFrame([(0, "A", 0.9), (1, None, 0.4), (2, "B", 1.0)], "sample_id bigint, answer string, lang_ja double")
    said = _generations(spark, ["so A", "none", "so C"])
    got = _metrics(V.letter_answers(samples, said))
    assert got == pytest.approx({"acc": 2 / 3, "acc_ja": 1 / 3})
    named = _metrics(V.letter_answers(samples, said, languages=("ja", "en")))
    assert named == pytest.approx({"acc": 2 / 3, "acc_ja": 1 / 3, "acc_en": 2 / 3})
    strict = _metrics(V.letter_answers(samples, said, languages=(), null_is_correct=False))
    assert strict == pytest.approx({"acc": 1 / 3})


def test_numbers(spark):
    samples = spark.createDataFrame([(0, 234), (1, 5), (2, None), (3, 7)], "sample_id bigint, answer bigint")
    evaluation = V.number_answers(samples, _generations(spark, ["1,234", "it is -5.0", "?", "7.5"]), languages=())
    assert _metrics(evaluation) == {"acc": 0.75}
    rewarded = TASKS["gsm8k"].rewards(evaluation.details)
    assert [r.reward for r in rewarded.orderBy("sample_id").collect()] == [1.0, 1.0, 1.0, -1.0]


def test_positions_select_samples(spark):
    samples = spark.createDataFrame([(0, 0, "A"), (1, 1, "A")], "sample_id bigint, ordinal bigint, answer string")
    picks = spark.createDataFrame([(1,), (1,)], "ordinal bigint")
    details = V.letter_answers(samples, _generations(spark, ["A", "B"]), picks, ()).details
    assert [(r.sample_id, r.correct) for r in details.collect()] == [(1, False), (1, False)]


def test_choices(spark):
    samples = spark.createDataFrame(
        [(0, "B", ["x", "y"]), (1, "C", ["x", "y", "z"]), (2, "A", []), (3, "A", ["x"] * 4)],
        "sample_id bigint, answer string, options array<string>",
    )
    evaluation = V.choice_answers(samples, _generations(spark, ["the answer is B", "?", "?", "Answer: B"]))
    rows = evaluation.details.orderBy("sample_id").collect()
    assert [(r.correct, r.guess_undefined) for r in rows] == [(True, False), (True, False), (False, True), (False, False)]
    assert _metrics(evaluation) == {"acc": 0.5}


def test_latex_by_type(spark):
    samples = spark.createDataFrame([(0, "1/2", "algebra"), (1, "x+1", "algebra"), (2, None, "other")], "sample_id bigint, answer string, type string")
    said = _generations(spark, ["The answer is: \\frac12.\n", "\\boxed{1+x}", "none"])
    report = V.latex_by_type(V.latex_answers(samples, said).details)
    assert sorted(map(tuple, report.collect())) == [("algebra", 2, 0.5, 1), ("other", 1, 1.0, 0)]


def test_commands_and_categories(spark):
    samples = spark.createDataFrame([(0, '{"command": {"a": 1}}'), (1, '{"command": 2}'), (2, "bad")], "sample_id bigint, ai_output string")
    evaluation = V.command_answers(samples, _generations(spark, ['{"command": {"a": 1.0}}', '{"command": "2"}', "bad"]))
    assert _metrics(evaluation) == pytest.approx({"acc": 1 / 3})
    labels = spark.createDataFrame([(0, "code"), (1, "math")], "sample_id bigint, label string")
    assert _metrics(V.category_answers(labels, _generations(spark, ["\\boxed{code}", "math"]))) == {"acc": 0.5}


def test_code(spark):
    problems = spark.createDataFrame([("t1", "# one", "f"), ("t2", "# two", "g")], "task_id string, prompt string, entry_point string")
    body = "def {0}(a):\n    return a\n```\nwhy"
    completions = spark.createDataFrame(
        [("t1", 5, body.format("f")), ("t1", 3, "def f(:"), ("t2", 1, body.format("g")), ("t2", 2, body.format("g"))],
        "task_id string, ordinal bigint, generation string",
    )
    verdicts = spark.createDataFrame(
        [("t1", 0, "fail", "pass"), ("t1", 1, "pass", "fail"), ("t2", 0, "pass", "pass"), ("t2", 1, "pass", "pass")],
        "task_id string, completion_id int, base_status string, plus_status string",
    )
    evaluation = V.code_answers(problems, completions, verdicts, "mbpp", clean=True, ks=[1, 2, 3])
    assert _metrics(evaluation) == {
        "mbpp_base_pass@1": 0.75, "mbpp_base_pass@2": 1.0, "mbpp_plus_pass@1": 0.5, "mbpp_plus_pass@2": 0.5,
    }
    rows = {(r.task_id, r.completion_id): r for r in evaluation.details.collect()}
    assert rows["t1", 1].solution == "# one\ndef f(a):\n    return a" and rows["t1", 1].explanation == "why"
    assert rows["t1", 0].base_correct == 1 and rows["t2", 0].plus_correct == 2
    plain = V.code_answers(problems, completions, verdicts, "he", clean=False, ks=[1], base_only=True)
    assert _metrics(plain) == {"he_base_pass@1": 0.75}
    assert plain.details.where("task_id = 't1' and completion_id = 0").first().solution == "# onedef f(:"
    rewards = TASKS["mbpp"].rewards(evaluation.details).select("task_id", "reward").distinct()
    assert dict(map(tuple, rewards.collect())) == {"t1": 1.0, "t2": -1.0}


def test_routing_counts_unrouted_samples(spark):
    samples = spark.createDataFrame([(i, "A") for i in range(4)], "sample_id bigint, answer string")
    boxes = ["\\boxed{code}", "\\boxed{code}", "\\boxed{poem}", "none"]
    classified = spark.createDataFrame(list(enumerate(boxes)), "sample_id bigint, classification string")
    generations = spark.createDataFrame([(i, "code", "A") for i in range(4)], "sample_id bigint, expert_label string, generation string")
    experts = spark.createDataFrame([("code",), ("math",)], "expert_label string")
    report = V.routed_answers(samples, classified, generations, experts, V.grade_letters).metrics
    assert sorted(map(tuple, report.collect())) == [("code", 2, 1.0), ("final_test_acc", 4, 0.5)]


def test_split_report(spark):
    rows = [("train", 0, True), ("train", 1, False), ("train", 2, False), ("test", 0, None), ("test", 1, True)]
    details = spark.createDataFrame(rows, "split string, split_ordinal bigint, correct boolean")
    got = sorted(map(tuple, V.split_report(details, {"test": "score"}, train_head=2).collect()))
    assert got == [("test", "score", 2, 0.5), ("train", "train_acc", 2, 0.5)]


@pytest.mark.parametrize("n, c, k, want", [(4, 1, 1, 0.25), (1, 1, 10, None), (5, 0, 3, 0.0), (5, 3, 3, 1.0), (10, 4, 3, 1 - 20 / 120)])
def test_pass_at_k(spark, n, c, k, want):
    got = spark.range(1).select(pass_at_k(F.lit(n), F.lit(c), k).alias("p")).first().p
    assert got is None if want is None else got == pytest.approx(want)


def test_pass_at_k_of_a_huge_task(spark):
    """The estimate has k terms, also for a task with billions of attempts."""
    got = spark.range(1).select(pass_at_k(F.lit(3_000_000_000), F.lit(1_500_000_000), 10).alias("p")).first().p
    assert got == pytest.approx(1 - 0.5**10)


def test_verdict_lists_keep_one_shape(spark):
    rows = [("t", i, "pass" if i % 2 else "fail", "pass") for i in range(25)] + [("u", 0, "pass", None)]
    verdicts = spark.createDataFrame(rows, "task_id string, completion_id int, base_status string, plus_status string")
    lists = reports.verdict_lists(verdicts.repartition(4)).orderBy("task_id", "completion_id").collect()
    assert [(r.task_id, r.completion_id, r.base, r.plus) for r in lists] == rows
    assert [r.nfiles for r in lists] == [25] * 25 + [1]


def test_details_without_verdicts_stay(spark):
    details = spark.createDataFrame([("t",), ("u",)], "task_id string")
    per_task = spark.createDataFrame([("t", 2, 1)], "task_id string, attempts bigint, base bigint")
    got = sorted(map(tuple, reports.with_verdict_counts(details, per_task).collect()))
    assert got == [("t", 2, 1, True), ("u", 0, 0, False)]


def test_rewards_without_a_batch_stay(spark):
    df = spark.createDataFrame([(None, 1.0), (None, -1.0), (1, 1.0)], "b int, reward double")
    got = sorted((r.b or 0, r.norm_reward) for r in reports.normalized_rewards(df, ["b"]).collect())
    assert got == [(0, -1.0), (0, 1.0), (1, 0.0)]


def test_routed_samples_count_once(spark):
    samples = spark.createDataFrame([(i, "A") for i in range(4)], "sample_id bigint, answer string")
    classified = spark.createDataFrame([(i, "\\boxed{code}") for i in (0, 1, 2)], "sample_id bigint, classification string")
    generations = spark.createDataFrame(
        [(0, "code", "A"), (0, "code", "B"), (1, "code", "A")], "sample_id bigint, expert_label string, generation string"
    )
    experts = spark.createDataFrame([("code",)], "expert_label string")
    evaluation = V.routed_answers(samples, classified, generations, experts, V.grade_letters)
    report = sorted((r.expert_label, r.num_samples, round(r.test_acc, 6)) for r in evaluation.metrics.collect())
    assert report == [("code", 3, round(2 / 3, 6)), ("final_test_acc", 4, 0.5)]
    assert evaluation.details.count() == 4


def test_reward_normalisation(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 1.0), (1, 1.0), (1, -1.0)], "b int, reward double")
    got = sorted((r.b, r.norm_reward) for r in reports.normalized_rewards(df, ["b"]).collect())
    assert got == [(0, 0.0), (0, 0.0), (1, -1.0), (1, 1.0)]
    clipped = reports.normalized_rewards(df, ["b"], clip=0.5, normalize=False).select("norm_reward").collect()
    assert sorted(r[0] for r in clipped) == [-0.5, 0.5, 0.5, 0.5]


def test_bundle_and_counts(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "v double")
    got = {r.metric: r.value for r in reports.metric_bundle(df, F.col("v"), "x").collect()}
    assert got == {"x/mean": 2.0, "x/std": 1.0, "x/min": 1.0, "x/max": 3.0}
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), (None, "b")], "o string, n string")
    assert tuple(reports.changed_rows(pairs, "o", "n").first()) == (2, 3)
    ids = spark.createDataFrame([(1,), (1,), (2,)], "i int")
    assert tuple(J.completeness(ids, ["i"]).first()) == (3, 2, False)
    assert reports.accuracy_report(spark.createDataFrame([], "correct boolean")).first().acc is None


def test_log_softmax_and_kl(spark):
    df = spark.createDataFrame([(0, 0, 1000.0), (0, 0, 1000.0), (0, 1, -5.0)], "sample_id int, pos int, logit double")
    got = sorted(round(r.logp, 9) for r in logprobs.log_softmax(df).collect())
    assert got == [-0.693147181, -0.693147181, 0.0]
    same = spark.createDataFrame([(0, -1.0, -1.0), (0, -2.0, -2.0)], "sample_id int, logp double, ref_logp double")
    assert logprobs.kl_to_reference(same).first().kl_div == 0.0


def test_masked_nll(spark):
    df = spark.createDataFrame([(0, -1.0, True), (0, -2.0, False), (0, -4.0, None), (1, -3.0, False)], "sample_id int, logp double, mask boolean")
    got = sorted(map(tuple, logprobs.masked_nll(df).collect()))
    assert got == [(0, 1.0, 1), (1, 0.0, 0)]


@pytest.mark.parametrize("most", [0, 1, 2, 1000])
def test_experts_by_dictionary_and_by_join(spark, most):
    """Few labels are looked up where the samples are; the join gives the same."""
    samples = spark.range(900).selectExpr("id", "if(id % 3 < 2, 'math', if(id % 2 = 0, 'code', null)) as expert_label")
    experts = spark.createDataFrame([("math",), ("law",), (None,), ("math",)], "expert_label string")
    found = with_experts(samples, experts, most=most)
    assert dict(map(tuple, found.groupBy("evaluated").count().collect())) == {True: 600, False: 300}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ("Join" in plan or "Exchange" in plan) == (most < 2)


def test_no_experts(spark):
    samples = spark.range(3).selectExpr("id", "'a' as expert_label")
    none = spark.createDataFrame([], "expert_label string")
    assert not any(r.evaluated for r in with_experts(samples, none).collect())

"""Samples, messages and chat renderings."""

from pyspark.sql import functions as F

from gradeloom.functions import prompts as P
from gradeloom.operators import chats
from gradeloom.plans.spec import TASKS

MESSAGES = "m array<struct<role:string,content:string>>"
HEAD = "<|start_header_id|>{}<|end_header_id|>\n\n"


def _render(spark, conversations, render):
    rows = [(i, c) for i, c in enumerate(conversations)]
    df = spark.createDataFrame(rows, "i int, " + MESSAGES)
    return [r.t for r in df.select("i", render(F.col("m")).alias("t")).orderBy("i").collect()]


def test_renderings(spark):
    chat = [("system", " s "), ("user", "u\n"), ("assistant", "a")]
    ask = [("user", "u")]
    got = _render(spark, [chat, ask, []], lambda m: P.render_header_style(m, "<b>"))
    front = "<b>" + HEAD.format("system") + "s<|eot_id|>" + HEAD.format("user") + "u<|eot_id|>"
    assert got[0] == front + HEAD.format("assistant") + "a<|eot_id|>" + HEAD.format("assistant")
    assert got[2] == HEAD.format("assistant")
    steps = _render(spark, [ask], lambda m: P.render_header_style(m, suffix=P.STEP_BY_STEP))[0]
    assert steps.endswith("<|end_header_id|>\n\nLet's think step by step")
    im = _render(spark, [ask], lambda m: P.render_im_start_style(m, generation=False))[0]
    assert im == "<|im_start|>user\nu<|im_end|><think>\n\n</think>\n\n"
    plain = _render(spark, [chat, ask, [("assistant", "a")], [("user", "u"), ("user", "v")]], P.render_instruction_style)
    assert plain[0] == "s\n\n@@ Instruction:\nu\n\n@@ Response:\na"
    assert plain[1] == "@@ Instruction:\nu\n\n@@ Response:"
    assert plain[2:] == [None, None]


def test_prefill(spark):
    good = [("user", "u"), ("assistant_prefill", "```python")]
    early = [("assistant_prefill", "x"), ("user", "u")]
    twice = [("user", "u"), ("assistant_prefill", "x"), ("assistant_prefill", "y")]
    got = _render(spark, [good, early, twice], lambda m: P.render_with_prefill(m, P.render_instruction_style))
    assert got == ["@@ Instruction:\nu\n\n@@ Response:```python", None, None]
    errors = _render(spark, [good, early, twice], P.prefill_error)
    assert errors == [None, "prefill is not the last message", "more than one prefill"]


def test_turn_tables_render_like_message_arrays(spark):
    chats_ = {
        1: [("system", " s "), ("user", "u"), ("assistant", "a"), ("user", "q")],
        2: [("user", "u1"), ("assistant", "a1")],
        3: [("user", "x"), ("user", "y")],
        4: [("system", "s"), ("assistant", "y")],
    }
    turns = spark.createDataFrame(
        [(c, t + c, r, x) for c, ms in chats_.items() for t, (r, x) in enumerate(ms)],
        "conv_id bigint, turn bigint, role string, text string",
    )

    def joined(pieces):
        out = {}
        for r in sorted(pieces.collect(), key=lambda r: (r.conv_id, r.turn)):
            text = out.get(r.conv_id, "")
            if r.piece is not None:
                assert r.start == len(text) and r.stop == len(text + r.piece)
            out[r.conv_id] = None if r.piece is None else text + r.piece
        return [out[c] for c in sorted(out)]

    conversations = list(chats_.values())
    for pieces, render in (
        (chats.header_pieces(turns, "<b>"), lambda m: P.render_header_style(m, "<b>")),
        (chats.im_start_pieces(turns), P.render_im_start_style),
        (chats.instruction_pieces(turns), P.render_instruction_style),
    ):
        assert joined(pieces) == _render(spark, conversations, render)
    assert {r.conv_id for r in chats.instruction_pieces(turns).where("error is not null").collect()} == {3, 4}

    spans = sorted(chats.assistant_spans(turns, "<b>").collect(), key=lambda r: (r.conv_id, r.start))
    texts = _render(spark, conversations, lambda m: P.render_header_style(m, "<b>"))
    for conv, text in zip(chats_, texts):
        mine = [s for s in spans if s.conv_id == conv]
        assert [s.start for s in mine] == [0] + [s.stop for s in mine][:-1]
        assert mine[-1].stop == len(text)
        trained = "".join(text[s.start : s.stop] for s in mine if s.mask)
        said = "".join(x.strip() + "<|eot_id|>" for r, x in chats_[conv] if r == "assistant")
        assert trained == said


def test_samples(evaluate, spark):
    assert evaluate(P.gold_number, ["is 12.9", "#### 1,000", "none"]) == [12.0, 0.0, None]
    prompts = ['"""\nAdd a and b\nassert add(1,2)==3\n"""\n', '"""No check."""', "no quotes"]
    got = evaluate(lambda t: P.code_task_from_docstring(t)[0], prompts)
    want = "Add a and b. Your code should satisfy the following assertion:\n```python\nassert add(1,2)==3\n```"
    assert got == [want, None, None]
    many = spark.createDataFrame([(["x"] * 6,), (["x", "y"],)], "o array<string>")
    texts = [r[0] for r in many.select(P.lettered_options(F.lit("q"), F.col("o"))).collect()]
    assert texts == ["q\nOptions:\n" + "".join(f"{c}. x\n" for c in "ABCDEF"), "q\nOptions:\nA. x\nB. y\n"]
    errors = [r[0] for r in many.select(P.options_error(F.col("o"))).collect()]
    assert errors == ["6 options, but only 5 letters", None]


def test_digest(spark):
    df = spark.range(50).select(F.col("id"), F.concat(F.lit("q"), "id").alias("t"))
    lines = chats.digest_text(df, "id", "t", 5, 1).first().questions.split("\n")
    assert [line.split(". ")[0] for line in lines] == ["1", "2", "3", "4", "5"]
    assert len({line.split(". ")[1] for line in lines}) == 5


def test_every_task_renders(spark):
    row = spark.createDataFrame(
        [("Q?", "sys", "do", "\n\"\"\"\nDo it\nassert f()\n\"\"\"", ["x", "y"], (["x", "y"],))],
        "question string, system string, user_input string, prompt string, options array<string>, choices struct<text:array<string>>",
    ).withColumn("problem", F.col("question"))
    for name, spec in TASKS.items():
        text = row.select(spec.prompt()).first()[0]
        assert text, name
        if spec.system is not None:
            assert spec.system.strip() in text
    assert row.select(TASKS["mbpp"].prompt()).first()[0].endswith("@@ Response:```python")

"""Operators on Python workers that can't import the package, and ids that are null or large."""

import os
import subprocess
import sys

import numpy as np
from rows import SF, odd_texts  # noqa: F401

from gradeloom.llm import packing, registry, repair_shards, token_ids
from gradeloom.llm.decontaminate import scan

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
NAMES = "op1_main_text op2_toxicity op3_language_ppm op4_repair_shards op11_filter_audit op12_fill_in_middle".split()

CODE = f"""
import sys
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as entry
from pyspark.sql import functions as F
from gradeloom.session import build_session
spark = build_session(4, 4)

@F.udf("string")
def importable(_):
    import importlib.util
    return str(importlib.util.find_spec("gradeloom"))

assert spark.range(1).select(importable("id")).first()[0] == "None"
for name in {NAMES!r}:
    print(name, entry.queries()[name](spark, {SF!r}).count())
"""


def test_workers_need_no_package(tmp_path):
    """The path of the driver only names the package; workers start without it."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
    counts = dict(line.split() for line in done.stdout.splitlines() if line.startswith("op"))
    assert set(counts) == set(NAMES) and all(int(n) > 0 for n in counts.values())


def test_values_of_other_stages_go(monkeypatch):
    """A worker keeps what the running stage asks for, not the encoder of one long over."""
    monkeypatch.delitem(sys.modules, "gradeloom_worker_values", raising=False)
    made = []

    def ask(stage, key):
        task = type("Task", (), {"stageId": lambda self: stage})()
        monkeypatch.setattr(registry, "TaskContext", type("Now", (), {"get": lambda: task}), raising=False)
        registry.once_per_worker(key, lambda: made.append(key) or np.zeros(1))

    for stage, key in [(1, "encoder"), (1, "powers"), (1, "encoder"), (2, "powers"), (3, "scorer"), (3, "scorer")]:
        ask(stage, key)
    assert made == ["encoder", "powers", "scorer"]
    ask(3, "encoder")
    assert made == ["encoder", "powers", "scorer", "encoder"]
    monkeypatch.delitem(sys.modules, "gradeloom_worker_values")


def test_working_arrays_of_the_encoder_stay_small(monkeypatch):
    monkeypatch.delitem(sys.modules, "gradeloom_worker_values", raising=False)
    texts = ["some plain words " * 6_000] * 50  # five million characters
    found = sum(len(ids) for _, ids in packing.encoded(texts, token_ids.default_tokenizer()))
    assert found == 50 * (3 * 6_000 + 1)
    assert len(token_ids.powers(1)[0]) < 1_200_000
    monkeypatch.delitem(sys.modules, "gradeloom_worker_values", raising=False)


def test_null_and_large_ids(spark, tmp_path):
    big = 9007199254740993
    rows = [(None, "some words here"), (big, "more words"), (big + 1, None), (None, "last"), (-3, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = sorted((i is not None, i or 0) for i, _ in rows)
    packed = packing.pack(docs, window=64, open_windows=2).collect()
    assert sorted({((r.doc_id is not None), r.doc_id or 0) for r in packed}) == sorted(set(want))
    folder = str(tmp_path / "ids")
    repair_shards.write_shards(docs, folder)
    read = repair_shards.read_shards(spark, folder).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in read) == want


def test_null_item_ids(spark):
    text = " ".join(f"word{i}" for i in range(20))
    items = spark.createDataFrame([(None, text.replace("word", "w")), ("q", text)], "item_id string, text string")
    docs = spark.createDataFrame([(1, text), (2, text.replace("word", "w")), (3, None)], "doc_id long, text string")
    found = {r.doc_id: (r.n_hit, r.item_ids) for r in scan(docs, items).collect()}
    assert found == {1: (20, ["q"]), 2: (20, [""]), 3: (0, [])}

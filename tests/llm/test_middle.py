"""Fill-in-the-middle against tokens cut one by one."""

import hashlib
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from rows import SF, no_docs, odd_docs, odd_texts  # noqa: F401

from gradeloom.llm import QUERIES
from gradeloom.llm.fill_in_middle import ERROR, arranged, boundaries, fill_in_middle, fitted, restored


def tokens(text):
    return re.findall(r"[A-Za-z]+|[^A-Za-z]", text)


def want(doc_id, text, seed=1):
    """(n, form, prefix_chars, middle_chars, output), from the list of tokens."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    text = text or ""
    units = tokens(text)
    n = len(units)
    if text == "" or re.search("<[PSM]>", text) or c % 100 >= 90:
        return n, "plain", None, None, text
    i, j = sorted((a % (n + 1), b % (n + 1)))
    prefix, middle, suffix = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if d % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op12_fill_in_middle"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        n, form, prefix, middle, output = want(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, prefix, middle)
        assert (r.output_sha256, r.restored_sha256) == (sha(output), sha(texts[r.doc_id]))
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_odd_rows(spark, odd_docs, odd_texts):
    rows = fill_in_middle(odd_docs).select("*", restored(F.col("output"), F.col("form")).alias("again")).collect()
    assert len(rows) == len(odd_texts) + 1 and {r["_row"] for r in rows} == {"r"}
    for r in rows:
        assert tuple(r[c] for c in ("n", "form", "prefix_chars", "middle_chars", "output")) == want(r.doc_id, r.text)
        assert r.again == (r.text or "")


def test_ids_and_marks(spark):
    texts = ["plain words of a text", "a<P>b", "x<S>", "<M>", "<S <P <M <", "<<S", "S>P>M>", "<\U0001f600>S>é"]
    ids = [None, 0, -7, 9007199254740993, 9007199254740992, *range(100, 140)]
    rows = [(i, t) for i in ids for t in texts]
    docs = spark.createDataFrame(rows, "id long, body string").repartition(3)
    out = fill_in_middle(docs, "body", "id", seed=5).withColumn("again", restored(F.col("output"), F.col("form")))
    got = out.select("id", "body", "n", "form", "prefix_chars", "middle_chars", "output", "again").collect()
    by_row = {(r.id, r.body): r for r in got}
    assert set(by_row) == set(rows)
    for (i, text), r in by_row.items():
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == want(i, text, 5)
        assert r.again == text


def test_empty_table(no_docs):
    assert fill_in_middle(no_docs).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(1, 3), st.integers(1, 2000)), max_size=900), st.sampled_from([1, 7, ERROR]))
def test_index_is_exact_and_bounded(widths, error):
    offsets = np.concatenate([[0], np.cumsum(np.array(widths, "int64"))]).astype("int64")
    index = fitted(offsets, error)
    ranks = np.arange(len(offsets))
    assert index.offsets(ranks).tolist() == offsets.tolist()
    assert np.abs(offsets - index.predicted(ranks)).max() <= error + 1
    # Each segment but the last ends because its line would have left the bound.
    for a, b in zip(index.first[:-1], index.first[1:]):
        run, rise = np.arange(1, b - a + 1), offsets[a + 1 : b + 1] - offsets[a]
        assert ((rise - error) / run).max() > ((rise + error) / run).min()
    assert len(index.first) <= 2 + offsets[-1] // error


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("aZ <>PSMé\n\U0001f600"), max_size=60), st.tuples(*[st.integers(0, 2**32 - 1)] * 4))
def test_boundaries_and_cuts(text, draws):
    units = tokens(text)
    assert boundaries(text).tolist() == [len("".join(units[:i])) for i in range(len(units) + 1)]
    n, form, prefix, middle, output = arranged(text, draws)
    i, j = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    if form != "plain":
        assert (prefix, middle) == (len("".join(units[:i])), len("".join(units[i:j])))


@pytest.mark.parametrize("unit", ["word and ", "a" * 1000 + " . . . . ", " " * 400 + "b" * 397])
def test_very_long_text(unit):
    text = unit * (4_000_000 // len(unit))
    offsets = boundaries(text)
    started = time.time()
    index = fitted(offsets)
    assert time.time() - started < 20
    ranks = np.linspace(0, len(offsets) - 1, 1000).astype("int64")
    assert index.offsets(ranks).tolist() == offsets[ranks].tolist()
    assert index.residual.dtype == np.int8

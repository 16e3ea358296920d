"""The filter audit against a removal that is played through, document by document."""

import re
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest
from rows import SF, no_docs, odd_texts  # noqa: F401

from gradeloom.llm import QUERIES, filter_audit
from gradeloom.llm.filter_audit import COUNTS, FAR, audit, failures, patterns


def fails(text, words_at_least=200):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    capitals = len(re.findall("[A-Z]", text))
    found = {
        "A": len(words) < words_at_least,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * capitals > 2 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)),
    }
    return {f for f, failed in found.items() if failed}


def played(docs, labels):
    """(part, order, step) -> counts, by removing the documents of each order one filter after the other."""
    first = {}
    for i, text, _ in docs:
        if i is not None and i < first.get(text or "", i + 1):
            first[text or ""] = i
    rows = []
    for i, text, source in docs:
        own = fails(text or "")
        if i is not None and i > first[text or ""]:
            own.add("E")
        quality, toxic = labels.get(i, (0, 0))
        rows.append((source or "", own, quality == 1, toxic == 1))
    out = {}
    for part in {r[0] for r in rows}:
        mine, sums = [r for r in rows if r[0] == part], defaultdict(int)
        for order in permutations("ABCDE"):
            left, gone = list(mine), []
            for step, f in enumerate(order, 1):
                now = [r for r in left if f in r[1]]
                redundant = sum(f in r[1] for r in gone)
                left = [r for r in left if f not in r[1]]
                gone += now
                sums[f] += len(now)
                out[part, "".join(order), step] = [
                    len(left), len(now), redundant, sum(r[1] == {f} for r in mine),
                    sum(r[2] for r in now), sum(r[3] for r in now),
                ]
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(sums[f])
    return out


def by_key(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COUNTS] for r in df.collect()}


def test_query(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    want = played(docs, labels)
    assert by_key(QUERIES["op11_filter_audit"](spark, SF)) == want
    assert {r[5] for r in want.values()} > {0}


@pytest.fixture(scope="module")
def odd_rows(odd_texts):
    sources = ("s", None, "", "t", "s")
    rows = [(i, t, sources[i % 5]) for i, t in enumerate(odd_texts)]
    rows += [rows[5], (None, odd_texts[5], "s"), (None, None, None), ((1 << 53) + 1, odd_texts[5], "t"), (-4, "", "t")]
    return rows + [(100 + i, "The SAME", "hot") for i in range(300)]


def test_odd_rows(spark, odd_rows):
    schema = "doc_id long, text string, source string, part string, mask int, id string, good int, digest int"
    docs = spark.createDataFrame([(*r, "x", 1, "i", 1, 1) for r in odd_rows], schema).repartition(7)
    marks = [(5, 1, None), (5, None, 1), (7, 0, 0), (8, 1, 1), (None, 1, 1), (102, 1, 1), (100, 1, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    want = played(odd_rows, {5: (1, 1), 7: (0, 0), 8: (1, 1), 102: (1, 1), 100: (1, 0)})
    assert by_key(audit(patterns(failures(docs, labels)))) == want


def test_patterns_are_bounded(spark, odd_rows):
    docs = spark.createDataFrame(odd_rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = patterns(failures(docs, labels)).where("part = 'hot'").collect()
    assert sorted((r["mask"], r.n) for r in found) == [(0b00101, 1), (0b10101, 299)]


def test_empty_tables(spark, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit(patterns(failures(no_docs, labels))).count() == 0


def test_min_plus_product():
    masks = np.array([[True, False, False], [False, True, True], [False, False, False]])
    places = np.argsort([[0, 1, 2], [2, 0, 1]], axis=1)
    steps = filter_audit.removal_steps(masks, places)
    assert np.minimum(steps, FAR).tolist() == [[0, 1], [1, 0], [FAR, FAR]]
    assert filter_audit.scattered(steps, np.array([5, 7, 2]), 3).tolist() == [[5, 7, 0, 2], [7, 5, 0, 2]]


def test_too_many_filters(spark):
    found = spark.createDataFrame([], "part string, mask int, n long, good long, toxic long")
    with pytest.raises(ValueError):
        audit(found, "ABCDEFGHIJ")

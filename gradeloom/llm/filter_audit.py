"""Interaction audit of filters: what every order of them removes, and what it would remove twice.

A document fails a set of filters, a row of a mask matrix: 0 where it fails, infinity
where it passes. The places of the filters in every order are the inverse permutations, a
second matrix. Their min-plus product (add, then take the minimum over the filters) is the
step at which each order removes each document, or infinity. Counts of documents are
scattered over these steps, with weights for good and for toxic documents; what remains,
what was removed before and the Shapley sums follow from the scattered counts.

Documents enter as patterns (part, failed filters, label) with counts: at most
``4 * 2^filters`` rows a part, added up before the shuffle. So a part with a third of all
documents costs no more than another one, and the matrices have a fixed size. The only
row-wise exchanges hold ids and digests: labels are joined on ``doc_id``, and the first
document of each text is found as the least id of its digest, then joined back on
(``doc_id``, digest), so a text in a third of all rows is no hot key either.

Filters here: too few words, too few distinct words, too many capitals, signs, and copies
of a text with a smaller ``doc_id``. Null texts count as empty (and as copies of each
other), a null source is the part "". Texts are compared by their SHA-256. Rows with
equal ``doc_id`` and text fail alike; a row without ``doc_id`` is no copy, makes no copy and
has no label. Of several labels of one id the highest counts. An empty table has no parts and
gives no rows. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions.text import let
from gradeloom.llm.registry import query, table

SPACES = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"
SIGNS = r"[#$%&*|]"
FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT = 50
MOST_CAPITALS = 2
#: Orders are all permutations, so their number is bounded by the number of filters.
MOST_FILTERS = 7
#: What a passed filter adds to a place: more than any step.
FAR = 1 << 20
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_failures(text: Column) -> list[Column]:
    """Whether a text fails the filters that look at it alone: A, B, C and D."""

    def by_words(words: Column) -> Column:
        n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
        return F.struct((n < LEAST_WORDS).alias("A"), (100 * distinct < LEAST_DISTINCT * n).alias("B"))

    words = F.filter(F.split(F.btrim(text, F.lit(SPACES)), GAP, -1), lambda w: w != "")
    found = let(by_words, words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    return [
        found["A"],
        found["B"],
        100 * capitals > MOST_CAPITALS * F.length(text).cast("long"),
        F.rlike(text, F.lit(SIGNS)),
    ]


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) for every document; bit i of the mask is set where it fails filter i."""
    text = F.coalesce(docs["text"], F.lit(""))
    marks = [failed.cast("int") * (1 << i) for i, failed in enumerate(text_failures(text))]
    rows = docs.select(
        F.coalesce(docs["source"], F.lit("")).alias("part"),
        docs["doc_id"].alias("id"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        sum(marks[1:], marks[0]).alias("mask"),
    )
    firsts = rows.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    labelled = labels.groupBy(F.col("doc_id").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    return (
        rows.join(firsts, ["id", "digest"], "left")
        .join(labelled, "id", "left")
        .select(
            "part",
            (F.col("mask") + copy.cast("int") * (1 << len(marks))).alias("mask"),
            F.coalesce("good", F.lit(0)).alias("good"),
            F.coalesce("toxic", F.lit(0)).alias("toxic"),
        )
    )


def patterns(failed: DataFrame) -> DataFrame:
    """Documents by part and failed filters: (part, mask, n, good, toxic)."""
    return failed.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")
    )


def removal_steps(fails: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Min-plus product: the step (from 0) at which each order removes each pattern, ``FAR`` or more for never.

    ``fails`` is patterns x filters, ``places`` orders x filters.
    """
    masks = np.where(fails, 0, FAR)
    steps = np.full((len(masks), len(places)), FAR, "int64")
    for mask, place in zip(masks.T, places.T):
        np.minimum(steps, mask[:, None] + place[None, :], out=steps)
    return steps


def scattered(steps: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Orders x (n + 1): the weights of the patterns by the step that removes them; the last is never."""
    out = np.zeros((steps.shape[1], n + 1), "int64")
    orders = np.broadcast_to(np.arange(steps.shape[1]), steps.shape)
    np.add.at(out, (orders, np.minimum(steps, n)), np.broadcast_to(weights[:, None], steps.shape))
    return out


def audited(group: pd.DataFrame, letters: str) -> pd.DataFrame:
    """All orders and steps of one part, from its patterns."""
    n = len(letters)
    orders = np.array(list(permutations(range(n))))
    places = np.argsort(orders, axis=1)
    fails = (group["mask"].to_numpy("int64")[:, None] >> np.arange(n) & 1).astype(bool)
    weight = {c: group[c].to_numpy("int64") for c in ("n", "good", "toxic")}
    steps = removal_steps(fails, places)
    by_step = {c: scattered(steps, w, n) for c, w in weight.items()}
    removed = by_step["n"][:, :n]
    failing = weight["n"] @ fails
    alone = weight["n"] @ (fails & (fails.sum(axis=1) == 1)[:, None])
    shapley = np.take_along_axis(removed, places, axis=1).sum(axis=0)
    found = {
        "kept": weight["n"].sum() - removed.cumsum(axis=1),
        "removed": removed,
        "redundant": failing[orders] - removed,
        "unique_fails": alone[orders],
        "good_lost": by_step["good"][:, :n],
        "toxic_lost": by_step["toxic"][:, :n],
        "shapley": shapley[orders],
    }
    names = ["".join(letters[i] for i in order) for order in orders.tolist()]
    return pd.DataFrame(
        {
            "part": group["part"].iat[0],
            "filter_order": np.repeat(names, n),
            "step": np.tile(np.arange(1, n + 1, dtype="int32"), len(orders)),
            **{c: found[c].ravel() for c in COUNTS},
        }
    )


def audit(found: DataFrame, letters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from the :func:`patterns` of the parts."""
    if len(letters) > MOST_FILTERS:
        raise ValueError(f"all orders of {len(letters)} filters are too many; {MOST_FILTERS} at most")
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
    return found.groupBy("part").applyInPandas(lambda group: audited(group, letters), schema)


_SQL = f"""
WITH d AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
    FROM documents
),
f AS (
    SELECT doc_id, part,
           (CASE WHEN len(w) < {LEAST_WORDS} THEN 'A' ELSE '' END)
           || (CASE WHEN 100 * len(list_distinct(w)) < {LEAST_DISTINCT} * len(w) THEN 'B' ELSE '' END)
           || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * length(t) THEN 'C' ELSE '' END)
           || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
           || (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails
    FROM d
),
g AS (
    SELECT part, fails, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
    FROM f LEFT JOIN labels USING (doc_id) GROUP BY part, fails
),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (
    SELECT a.c || b.c || c.c || d.c || e.c AS filter_order
    FROM l a JOIN l b ON b.c <> a.c JOIN l c ON c.c NOT IN (a.c, b.c)
    JOIN l d ON d.c NOT IN (a.c, b.c, c.c) JOIN l e ON e.c NOT IN (a.c, b.c, c.c, d.c)
),
r AS (
    SELECT g.*, filter_order,
           CASE WHEN fails = '' THEN 99
                ELSE list_min(list_transform(string_split(fails, ''), lambda x: instr(filter_order, x))) END AS gone
    FROM g, o
),
s AS (
    SELECT part, filter_order, step::INTEGER AS step, filter_order[step] AS letter,
           sum(n) FILTER (gone > step) AS kept, sum(n) FILTER (gone = step) AS removed,
           sum(n) FILTER (contains(fails, filter_order[step]) AND gone < step) AS redundant,
           sum(n) FILTER (fails = filter_order[step]) AS unique_fails,
           sum(good) FILTER (gone = step) AS good_lost, sum(toxic) FILTER (gone = step) AS toxic_lost
    FROM r, range(1, 6) AS u(step) GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, {", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in COUNTS[:-1])},
       coalesce(sum(removed) OVER (PARTITION BY part, letter), 0)::BIGINT AS shapley
FROM s
"""


@query("op11_filter_audit", _SQL)
def op11_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    return audit(patterns(failures(docs, table(spark, sf, "labels"))))

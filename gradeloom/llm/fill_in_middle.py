"""Fill-in-the-middle: texts cut at two token boundaries and put in another order for training.

A boundary's rank (how many tokens stand before it) leads to its place in the text through a
learned index of the document: a piecewise-linear function of the rank is fitted to all
boundary offsets, each segment as long as one straight line from its first boundary stays
within ``ERROR`` code points of every boundary (the cone of possible slopes shrinks until it is
empty). A cut is predicted from its segment and corrected by the stored residual of its
rank, a signed byte, so it is exact. A new segment needs a drift of more than ``ERROR`` code
points, so a text has no more segments than its length divided by that, and the fit is linear.

Tokens are runs of ASCII letters and single other code points, in order. The two cuts, whether
a text stays plain and the order of the parts come from a digest of seed and ``doc_id``, so they
do not change with partitions or retries. :func:`restored` puts a text together again from output
and form.

A null text is an empty one; empty texts and texts that hold a mark stay plain. A null
``doc_id`` is drawn as an empty number. Rows with equal ``doc_id`` and text get the same output;
equal texts under other ids get their own. Texts of any length are cut whole, one text at a time.
An empty table gives no rows. Other columns pass through; those named like a result are replaced.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions.text import let
from gradeloom.llm.registry import beside, query, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
#: Of a hundred texts, those from this draw on stay plain; of the others, those below get the suffix first.
PLAIN_FROM, SUFFIX_FIRST = 90, 20
#: Code points between a boundary and its line; residuals fit a signed byte.
ERROR = 100
#: Boundaries that the fit looks at first; more and more as long as the line holds.
STEP = 256
FIELDS = ("n", "form", "prefix_chars", "middle_chars", "output")
SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string"


class RankIndex(NamedTuple):
    """Segments (first rank, offset there, slope) and the residual of every rank."""

    first: np.ndarray
    origin: np.ndarray
    slope: np.ndarray
    residual: np.ndarray

    def predicted(self, ranks: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.first, ranks, side="right") - 1
        return self.origin[at] + np.floor(self.slope[at] * (ranks - self.first[at])).astype("int64")

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        """Exact offsets of the boundaries with these ranks."""
        return self.predicted(ranks) + self.residual[ranks]


def boundaries(text: str) -> np.ndarray:
    """Offsets in code points before each token, and the end of the text."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    letter = (codes | 32) - np.uint32(97) < 26
    inside = np.zeros(len(codes) + 1, bool)
    inside[1:-1] = letter[1:] & letter[:-1]
    return np.flatnonzero(~inside)


def fitted(offsets: np.ndarray, error: int = ERROR) -> RankIndex:
    """The index of increasing offsets: greedy segments, each from its first boundary on."""
    n, at = len(offsets), 0
    first, slope = [], []
    while at < n:
        low, high, end, step = -np.inf, np.inf, at + 1, STEP
        while end < n:
            stop = min(n, end + step)
            run, rise = np.arange(end - at, stop - at), offsets[end:stop] - offsets[at]
            lows = np.maximum.accumulate(np.maximum((rise - error) / run, low))
            highs = np.minimum.accumulate(np.minimum((rise + error) / run, high))
            held = int(np.argmax(lows > highs)) if lows[-1] > highs[-1] else stop - end
            if held:
                low, high = lows[held - 1], highs[held - 1]
            end, step = end + held, 2 * step
            if end < stop:
                break
        first.append(at)
        slope.append((low + high) / 2 if end > at + 1 else 0.0)
        at = end
    starts = np.array(first, "int64")
    index = RankIndex(starts, offsets[starts], np.array(slope), np.zeros(0, "int8"))
    residual = offsets - index.predicted(np.arange(n))
    return index._replace(residual=residual.astype(np.min_scalar_type(-int(np.abs(residual).max()) - 1)))


def arranged(text: str, draws: tuple[int, int, int, int]) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    offsets = boundaries(text)
    n = len(offsets) - 1
    if not text or draws[2] % 100 >= PLAIN_FROM or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    ranks = np.sort(np.array([draws[0] % (n + 1), draws[1] % (n + 1)], "int64"))
    start, stop = fitted(offsets).offsets(ranks).tolist()
    prefix, middle, suffix = text[:start], text[start:stop], text[stop:]
    if draws[3] % 100 < SUFFIX_FIRST:
        return n, "spm", start, stop - start, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", start, stop - start, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def draws_of(key: Column, seed: int = SEED) -> list[Column]:
    """Four whole numbers below 2^32 from the digest of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """Add n (tokens), form, prefix_chars, middle_chars and output to ``docs``."""

    def run(texts: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        rows = [arranged(t, draws) for t, *draws in zip(texts, a, b, c, d)]
        return pd.DataFrame(rows, columns=FIELDS, dtype=object)

    made = F.pandas_udf(run, SCHEMA)(F.coalesce(docs[text], F.lit("")), *draws_of(docs[key], seed))
    return beside(docs, made, FIELDS)


def restored(output: Column, form: Column) -> Column:
    """The text again, from output and form.

    No part holds a mark and no mark ends as it begins, so the first place of a mark is its own.
    """

    def taken(rest: Column, mark: str) -> Column:
        """What stands before the first mark, and what behind it."""

        def split(rest: Column) -> Column:
            part = F.substring_index(rest, mark, 1)
            tail = F.substring(rest, F.length(part) + len(mark) + 1, F.length(rest))
            return F.struct(part.alias("part"), tail.alias("rest"))

        return let(split, rest)

    def joined(second: str, put) -> Column:
        body = F.substring(output, F.lit(len(PREFIX) + 1), F.length(output))
        return let(
            lambda one: let(lambda two: put(one["part"], two["part"], two["rest"]), taken(one["rest"], MIDDLE)),
            taken(body, second),
        )

    return (
        F.when(form == "psm", joined(SUFFIX, lambda prefix, suffix, middle: F.concat(prefix, middle, suffix)))
        .when(form == "spm", joined(PREFIX, lambda suffix, prefix, middle: F.concat(prefix, middle, suffix)))
        .otherwise(output)
    )


_SQL = f"""
WITH t AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h,
           regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u
    FROM documents
),
d AS (
    SELECT doc_id, text, u, len(u)::BIGINT AS n,
           ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
           ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
    FROM t
),
c AS (
    SELECT doc_id, text, n,
           CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}')
                     OR h3 % 100 >= {PLAIN_FROM} THEN 'plain'
                WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form,
           array_to_string(u[1 : least(h1 % (n + 1), h2 % (n + 1))], '') AS prefix,
           array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1 : greatest(h1 % (n + 1), h2 % (n + 1))], '') AS middle,
           array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1 : n], '') AS suffix
    FROM d
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'spm' THEN '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle
                        ELSE '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM c
"""


@query("op12_fill_in_middle", _SQL)
def op12_fill_in_middle(spark: SparkSession, sf: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )

"""Benchmark decontamination by one Aho-Corasick automaton.

Texts are normalised to lower-case words joined by single spaces; the automaton holds
every window of ``WINDOW`` consecutive words of the benchmark's questions and answers
(a shorter item is one window) with a space on either side, and a text is scanned once.
Matches are mapped to word numbers and, through the words' byte offsets, to the text.

The automaton is built in each worker from the benchmark's distinct texts, which are
broadcast. A benchmark is small by nature; its size is checked, and a larger one is dealt over
automata of ``MOST_BYTES`` each, every one of which scans the texts once.

Null and empty texts have no words and are clean; items without words, a null item text
and an empty benchmark match nothing; items with equal texts are all reported; repeated
rows are judged one by one. Other columns of the documents are kept by ``clean``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.registry import beside, once_per_worker, query, table

WINDOW = 13
MOST_BYTES = 16_000_000
#: A document is contaminated when at least one word in so many is hit.
SHARE = 20

# Lower-case A-Z; every other ASCII character that is no digit or letter separates words.
_FOLD = bytearray(range(256))
for _c in range(128):
    _FOLD[_c] = _c if 48 <= _c <= 57 or 97 <= _c <= 122 else _c + 32 if 65 <= _c <= 90 else 32
_FOLD = bytes(_FOLD)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split(b" ") if text else []


def folded(text: str | None) -> str:
    """Words between single spaces, with one before the first and one behind the last."""
    words = [w for w in words_of(text) if w]
    return (b" " + b" ".join(words) + b" ").decode("utf-8", "surrogatepass") if words else ""


class Windows:
    """The automaton: a window's value is (its number of words, numbers of its items)."""

    def __init__(self, texts: list[str], window: int = WINDOW):
        self.window = window
        owners: dict[str, set[int]] = {}
        for number, text in enumerate(texts):
            # At the ASCII blank only: other white space is part of a word, here as in the texts.
            line = folded(text)
            words = line[1:-1].split(" ") if line else []
            for i in range(max(1, len(words) - window + 1) if words else 0):
                owners.setdefault(" " + " ".join(words[i : i + window]) + " ", set()).add(number)
        self.automaton = ahocorasick.Automaton()
        for key, numbers in owners.items():
            self.automaton.add_word(key, (len(key) - 1, key.count(" ") - 1, tuple(numbers)))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def scan(self, line: str) -> list[tuple[int, int, tuple[int, ...]]]:
        """(begin, words, items) of every window in a folded line; begin is the place of its leading space."""
        if self.empty or not line:
            return []
        return [(end - size, n, items) for end, (size, n, items) in self.automaton.iter(line)]


def hit_words(line: str, found: list[tuple[int, int, tuple[int, ...]]]) -> np.ndarray:
    """For each word of the line, whether a window covers it."""
    spaces = np.flatnonzero(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4") == 32)
    hit = np.zeros(max(0, len(spaces) - 1), bool)
    if found:
        begin = np.searchsorted(spaces, np.fromiter((f[0] for f in found), np.int64, len(found)))
        edge = np.zeros(len(hit) + 1, np.int64)
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + np.fromiter((f[1] for f in found), np.int64, len(found)), -1)
        hit = np.cumsum(edge[:-1]) > 0
    return hit


def spans(text: str | None, hit: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges of the original text from the first to the last word of each run of hits."""
    at, places = 0, []
    for word in words_of(text):
        if word:
            places.append((at, at + len(word)))
        at += len(word) + 1
    out = []
    for (a, b), marked, before in zip(places, hit.tolist(), [False, *hit.tolist()]):
        if marked and before:
            out[-1] = (out[-1][0], b)
        elif marked:
            out.append((a, b))
    return out


HITS = "n_words long, n_hit long, item_ids array<string>, spans array<struct<begin:long,end:long>>"


def benchmark_parts(items: DataFrame, most_bytes: int = MOST_BYTES) -> list[list[tuple[str, str]]]:
    """(item_id, text) in parts of bounded size, a null id as the empty one; the benchmark is the one table that is brought together.

    Rows arrive one partition at a time.
    """
    parts, size = [[]], 0
    for row in items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))).toLocalIterator():
        if size and size + len(row[1]) > most_bytes:
            parts.append([])
            size = 0
        parts[-1].append((row[0], row[1]))
        size += len(row[1])
    return parts


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Add n_words, n_hit, item_ids (sorted, distinct) and spans (byte ranges) to ``docs``."""
    spark = docs.sparkSession
    parts = [
        (uuid.uuid4().hex, spark.sparkContext.broadcast(part)) for part in benchmark_parts(items, most_bytes)
    ]

    def automaton_of(part) -> tuple[Windows, list[str]]:
        return Windows([text for _, text in part.value], window), [item for item, _ in part.value]

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automata = [
            once_per_worker(("windows", key), lambda p=part: automaton_of(p)) for key, part in parts
        ]
        for column in texts:
            rows = []
            for text in column:
                line = folded(text)
                found, ids = [], set()
                for automaton, names in automata:
                    own = automaton.scan(line)
                    found += own
                    ids.update(names[i] for i in {i for f in own for i in f[2]})
                if not found:
                    rows.append((max(0, line.count(" ") - 1), 0, [], []))
                    continue
                hit = hit_words(line, found)
                rows.append((len(hit), int(hit.sum()), sorted(ids, key=lambda i: i.encode()), spans(text, hit)))
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "item_ids", "spans"])

    scanned = F.pandas_udf(run, HITS)
    return beside(docs, scanned(docs["text"]), ["n_words", "n_hit", "item_ids", "spans"])


def is_contaminated(n_hit: Column, n_words: Column, share: int = SHARE) -> Column:
    return (n_hit > 0) & (F.lit(share) * n_hit >= n_words)


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the contaminated ones, with its own columns only."""
    hits = scan(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs["text"]), items)
    return hits.where(~is_contaminated(F.col("n_hit"), F.col("n_words"))).select("_row.*")


def digest_of(ids: Column) -> Column:
    return F.sha2(F.array_join(ids, ","), 256)


@query("op10_decontaminate")
def op10_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    hits = scan(docs, table(spark, sf, "benchmark"))
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        digest_of(F.col("item_ids")).alias("items_sha256"),
        is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )

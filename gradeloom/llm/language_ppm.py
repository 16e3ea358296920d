"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to three bytes with frozen counts. A
byte seen in a context costs -log2(count / (total + distinct)); any other escapes with
probability distinct / (total + distinct) to the next shorter context, from whose
distribution the bytes already ruled out are taken away (escape method C with
exclusion), down to a uniform distribution over byte classes. So the probabilities of a context
sum to one and the sum of the costs is an exact code length. The language
with the shortest code wins.

As the counts are frozen, a byte's cost depends only on itself and the longest kept context
in front of it. Training spells these costs out as one table per context for all languages, and
scoring a batch of texts is two table reads per byte.

Training reads at most about ``DOCS_PER_LANGUAGE`` documents of each language, chosen by
a hash of their numbers; a shorter language gives all it has. Scoring reads every byte.

A null text and one without a letter are ``und`` with score 0. Rows without language are
not learned from; with no language learned at all, every row is ``und``. Equal code
lengths go to the first language by name. Repeated rows are scored one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.registry import beside, query, shared_value, table
from gradeloom.llm.token_ids import batches_of

DOCS_PER_LANGUAGE = 600
ORDER = 3
LEAST_COUNT = 4  # contexts of more than one byte seen less often in all languages are cut off
EVIDENCE = 64  # bytes whose code lengths count in full for the score
LEAD = b"\n" * ORDER


def codes_of(texts: list[bytes], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte classes of the texts, each behind ``LEAD``; starts and ends of the texts."""
    data = classes[np.frombuffer(LEAD + LEAD.join(texts) if texts else LEAD, np.uint8)]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + ORDER)
    return data, ends - lengths, ends


class Model:
    """Context trees of all languages, spelled out as cost tables."""

    def __init__(self, samples: dict[str, list[bytes]]):
        self.languages = sorted(samples)
        seen = np.zeros(256, bool)
        seen[10] = True
        for texts in samples.values():
            for text in texts:
                seen[np.frombuffer(text, np.uint8)] = True
        # Bytes never seen share the last class.
        size = int(seen.sum()) + 1
        self.size = size
        self.classes = np.full(256, size - 1, np.int32)
        self.classes[seen] = np.arange(size - 1)
        counts = [self._counts(samples[name]) for name in self.languages]
        self._spell(counts)

    def _counts(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each order the keys (context and byte in base ``size``) and their counts."""
        data, starts, ends = codes_of(texts, self.classes)
        inside = np.zeros(len(data) + 1, np.int8)
        np.add.at(inside, starts, 1)
        np.add.at(inside, ends, -1)
        place = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        wide, out = data.astype(np.int64), []
        for order in range(ORDER + 1):
            key = wide[place]
            for back in range(1, order + 1):
                key = key + wide[place - back] * self.size**back
            out.append(np.unique(key, return_counts=True))
        return out

    def _spell(self, counts: list) -> None:
        size, many = self.size, len(self.languages)
        # Contexts kept for all languages: number of each kept context by order.
        uniform = np.full((many, 1, size), 1.0 / size)
        chance, kept = uniform, np.zeros(1, np.int64)
        tables, longest = [], None
        for order in range(ORDER + 1):
            total = {}
            for language in counts:
                keys, n = language[order]
                owners, at = np.unique(keys // size, return_inverse=True)
                for c, v in zip(owners.tolist(), np.bincount(at, n).tolist()):
                    total[c] = total.get(c, 0) + v
            least = LEAST_COUNT if order > 1 else 1
            own = np.array(sorted(c for c, v in total.items() if v >= least), np.int64)
            if order == 0:
                own = np.zeros(1, np.int64)
                shorter = np.zeros(1, np.int64)
            else:
                # The context without its oldest byte; contexts whose parent was cut off go too.
                parent = own % size ** (order - 1)
                shorter = np.searchsorted(kept, parent)
                good = (shorter < len(kept)) & (kept[np.minimum(shorter, len(kept) - 1)] == parent)
                own, shorter = own[good], shorter[good]
            new = np.empty((many, len(own), size))
            for i, language in enumerate(counts):
                keys, n = language[order]
                row = np.searchsorted(own, keys // size)
                good = (row < len(own)) & (own[np.minimum(row, len(own) - 1)] == keys // size) if len(own) else np.zeros(len(keys), bool)
                here = np.zeros((len(own), size))
                here[row[good], keys[good] % size] = n[good]
                base = chance[i][shorter]
                sums, distinct = here.sum(1, keepdims=True), (here > 0).sum(1, keepdims=True)
                free = np.where(here > 0, 0.0, base)
                left = free.sum(1, keepdims=True)
                # All classes seen: nothing to escape to, so no escape is set aside.
                escape = np.where(left > 1e-12, distinct, 0)
                share = np.maximum(sums + escape, 1)
                new[i] = np.where(here > 0, here / share, free * (escape / share) / np.maximum(left, 1e-300))
                new[i] = np.where(sums > 0, new[i], base)
            tables.append((own, new))
            chance, kept = new, own
        # State of every possible context of three classes: the longest kept one.
        first = np.cumsum([0] + [len(own) for own, _ in tables])
        state = np.zeros(1, np.int32)
        for order in range(1, ORDER + 1):
            state = np.tile(state, size)
            state[tables[order][0]] = first[order] + np.arange(len(tables[order][0]))
        self.state = state.astype(np.int32)
        cost = -np.log2(np.concatenate([t for _, t in tables], axis=1))
        self.cost = np.ascontiguousarray(np.moveaxis(cost, 0, 2)).astype(np.float32).reshape(-1, many)

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        if not texts:
            return np.zeros((0, len(self.languages)))
        data, starts, ends = codes_of(texts, self.classes)
        context = data[2:-1] + self.size * data[1:-2] + self.size**2 * data[:-3]
        spot = self.state[context].astype(np.int64)
        spot *= self.size
        spot += data[3:]
        out = np.zeros((len(texts), len(self.languages)))
        filled = np.flatnonzero(ends > starts)
        if len(filled):
            edges = np.stack([starts[filled], ends[filled]], 1).ravel() - ORDER
            padded = np.append(spot, 0)
            for i in range(len(self.languages)):
                column = np.ascontiguousarray(self.cost[:, i])
                out[filled, i] = np.add.reduceat(column[padded], edges, dtype=np.float64)[::2]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        bits = self.code_lengths(raw)
        best = bits.argmin(1)
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        weight = np.minimum(1.0, EVIDENCE / np.maximum(lengths, 1))
        gap = (bits - bits.min(1, keepdims=True)) * weight[:, None]
        score = 1.0 / np.exp2(-gap).sum(1)
        names, lettered = [], np.zeros(len(texts))
        for i, text in enumerate(texts):
            known = bool(text) and has_letter(text)
            names.append(self.languages[best[i]] if known else UNKNOWN)
            lettered[i] = known
        return names, score * lettered


UNKNOWN = "und"


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def bounded_sample(docs: DataFrame, most: int) -> DataFrame:
    """About ``most`` rows of each language: those with the lowest hashes of their number."""
    counts = docs.groupBy("lang").count().collect()  # one row per language
    span = 1 << 40
    place = F.pmod(F.xxhash64("doc_id"), F.lit(span))
    keep = F.lit(False)
    for row in counts:
        keep = keep | ((F.col("lang") == row["lang"]) & (place < F.lit(min(span, span * most // row["count"]))))
    return docs.where(keep)


def train(docs: DataFrame, most: int = DOCS_PER_LANGUAGE) -> Model | None:
    """Model from ``docs`` (doc_id, text, lang); None if there is nothing to learn from."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    samples: dict[str, list[bytes]] = {}
    for row in bounded_sample(labelled.select("doc_id", "text", "lang"), most).toLocalIterator():
        samples.setdefault(row["lang"], []).append(row["text"].encode("utf-8", "surrogatepass"))
    return Model(samples) if samples else None


def classify(docs: DataFrame, model: Model | None) -> DataFrame:
    """Add lang_pred and score to ``docs``; only the text is looked at."""
    fields = ("lang_pred", "score")
    if model is None:
        unknown = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
        return beside(docs, unknown, fields)
    shared = shared_value(docs.sparkSession, model)

    def run(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in columns:
            texts, names, scores = column.tolist(), [], []
            for a, b in batches_of(texts):
                some, values = shared().predict(texts[a:b])
                names += some
                scores.append(values)
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pd.DataFrame({"lang_pred": names, "score": score})

    predict = F.pandas_udf(run, "lang_pred string, score double")
    return beside(docs, predict(docs["text"]), fields)


def held_out(rest: int, of: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % of == rest


@query("op3_language_ppm")
def op3_language_ppm(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out(1, 3)))
    return classify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(1, 3).alias("held_out"), "lang_pred", "score"
    )

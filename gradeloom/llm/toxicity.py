"""Toxicity behind a noisy channel: restore disguised words, then score the text.

Words may be disguised by digits and signs for letters, by signs or spaces between
letters, by repeated letters and by letters masked with a star. A disguised word is a lattice:
each observed character may stand for itself, for letters it is used for, or for
nothing. Viterbi decoding under a letter model takes the likeliest path, and the
restored text is scored.

* Every word that mixes a letter with signs or digits is decoded; its plain letters count, too.
  Runs of spaced characters are read as one word and as all words whose ends are likely where they stand.
* The letter model is the trigram statistics of all texts' words, counted in tasks and
  summed over slices of a fixed table.
* The scorer knows pieces of words (whole words, their first letters and runs of
  ``PIECE`` letters) and the share of toxic documents among those that hold the piece.
  A text's score joins its words' chances: 1 - product of (1 - chance). Pieces are
  learned from at most about ``LABELLED_DOCS`` labelled documents, equal texts once, and kept
  only if so pure a piece is no accident among so many.

Null and empty texts score the lowest value. With no labelled documents every text gets
that value, too. Labels are the only training signal; number, language and source are
not read by the scorer. Rows repeated in the documents are scored one by one, and a
document labelled twice is taken as toxic if either label says so.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.registry import beside, query, shared_value, table
from gradeloom.session import cut_lineage

LABELLED_DOCS = 16_000
THRESHOLD = 0.3
LOWEST = 0.01
PIECE = 5
PREFIXES = range(3, 7)
SURENESS = 3.0  # nats by which a piece's labels must beat the best that chance finds among all pieces
SHARES = (0.95, 0.8)  # least share of toxic documents, round by round
MOST_PIECES = 20_000

# Letters that signs and digits are used for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "€": "e", "£": "l",
    "¡": "i", "§": "s", "×": "x", "&": "a",
}
MASKS = "*#%?"
# Signs used for two letters, read as the one and as the other throughout a word.
EITHER = [str.maketrans({sign: s[k] for sign, s in STANDS_FOR.items() if len(s) > 1}) for k in (0, 1)]
SEPARATORS = " .-_*~'`·,:;/\\|^+=​‌‍﻿­"
ZERO_WIDTH = "​‌‍﻿­"
LATIN = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœ"
# Letters of other scripts that look like Latin ones, and accents that hide a plain letter.
LOOKALIKES = dict(zip("аеорсухіјѕԁһαορν", "aeopcyxijsdhaopv"))

_SIGNS = "".join(STANDS_FOR) + MASKS
#: A run of three or more single characters with white space between them.
SPACED = re.compile(r"(?<!\S)\S(?:\s+\S(?!\S)){2,}")
#: Letters of the longest word that is looked for inside a spaced run; the whole run is read, too.
SPACED_WORD = 24
DOUBLED = re.compile(r"(.)\1+")
TRIPLE = re.compile(r"([^\W\d_])\1\1")
#: A sign or digit next to a letter, or letters with one sign between them.
MIXED = re.compile(rf"[^\W\d_][{re.escape(_SIGNS + SEPARATORS)}{ZERO_WIDTH}]+[^\W_]|[{re.escape(_SIGNS)}][^\W\d_]|[^\W\d_][{re.escape(_SIGNS)}]")
#: Single characters with the same sign in every gap.
GAPPED = re.compile(r"\w([^\w\s]|_)\w(?:\1\w)+")
LETTERS = re.compile(r"[^\W\d_]+")
TRAILING = "!*#%?&|<>+~_"
EDGE = "\"'()[]{}<>.,;:?«»“”„‘’…¿"


class LetterModel:
    """Trigram costs of letters inside words; class 0 is the end of a word, the last any other letter."""

    def __init__(self, counts: np.ndarray):
        size = len(LATIN) + 2
        three = counts.reshape(size, size, size).astype(np.float64)
        two, one = three.sum(0), three.sum((0, 1))
        base = (one + 1) / (one.sum() + size)
        middle = (two + 2 * base) / (two.sum(1, keepdims=True) + 2)
        full = (three + 4 * middle[None]) / (three.sum(2, keepdims=True) + 4)
        self.cost = -np.log(full)
        self.number = {c: i + 1 for i, c in enumerate(LATIN)}
        self.other = size - 1

    def of(self, c: str) -> int:
        return self.number.get(c, self.other)


CLASSES = len(LATIN) + 2


def count_letters(texts: list[str]) -> np.ndarray:
    """Trigram counts of the texts' lower-case words, each padded with two word ends in front and one behind."""
    point = np.full(1 << 16, CLASSES - 1, np.uint8)
    for i, c in enumerate(LATIN):
        point[ord(c)] = i + 1
    point[[ord(c) for c in " \t\n\v\f\r"]] = 0
    point[33:65] = 0
    codes = np.frombuffer((" " + " ".join(texts).lower() + " ").encode("utf-16-le", "replace"), "<u2")
    classes = point[codes].astype(np.int64)
    before = np.concatenate([[0], classes[:-1]])
    # Behind a word end nothing older counts.
    older = np.where(before == 0, 0, np.concatenate([[0, 0], classes[:-2]]))
    real = ~((classes == 0) & (before == 0))
    key = (older * CLASSES + before) * CLASSES + classes
    return np.bincount(key[real], minlength=CLASSES**3)


def letter_counts(docs: DataFrame, slices: int = 64) -> np.ndarray:
    """Trigram counts of all texts: a fixed-size table per task, summed slice by slice."""

    def count(columns: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CLASSES**3, np.int64)
        for frame in columns:
            texts = [t for t in frame["text"].tolist() if t]
            for i in range(0, len(texts), 200):
                total += count_letters(texts[i : i + 200])
        parts = np.array_split(total, slices)
        yield pd.DataFrame({"slice": range(slices), "counts": [p.astype("<i8").tobytes() for p in parts]})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, "<i8") for c in rows["counts"])
        return pd.DataFrame({"slice": rows["slice"].iloc[:1], "counts": [total.tobytes()]})

    schema = "slice int, counts binary"
    rows = docs.select("text").mapInPandas(count, schema).groupBy("slice").applyInPandas(add, schema).collect()
    parts = {r["slice"]: np.frombuffer(r["counts"], "<i8") for r in rows}
    if not parts:
        return np.zeros(CLASSES**3, np.int64)
    return np.concatenate([parts[i] for i in range(slices)])


class Decoder:
    """Viterbi search over the readings of a disguised word."""

    SWAP, DROP, LOST, MASKED, REPEAT = 1.0, 0.6, 4.0, 1.5, 0.4
    NEAR = 6.0  # nats

    def __init__(self, letters: LetterModel, masked: int = 3):
        self.letters = letters
        self.swaps = {
            sign: [(s, letters.of(s), self.SWAP) for s in stands] for sign, stands in STANDS_FOR.items()
        }
        # A mask stands for the likeliest letters behind the two before it.
        best = np.argsort(letters.cost[:, :, 1:27], axis=2)[:, :, :masked]
        self.likely = {}
        for a in range(CLASSES):
            for b in range(CLASSES):
                self.likely[a, b] = [(LATIN[i], int(i) + 1, self.MASKED) for i in best[a, b]]
        self.costs = letters.cost.tolist()

    def readings(self, word: str, i: int) -> list[tuple[str, int, float]]:
        """What the i-th character may stand for, its class and the channel's cost; '' is nothing."""
        c = word[i]
        if c.isalpha():
            c = LOOKALIKES.get(c, c)
            out = [(c, self.letters.of(c), 0.0)]
            if i and word[i - 1] == word[i]:
                out.append(("", 0, self.REPEAT))
            return out
        out = list(self.swaps.get(c, ()))
        if i and word[i - 1] == c:
            out.append(("", 0, self.REPEAT))
        if c in MASKS:
            out.append(("", 0, self.LOST))
        elif c in SEPARATORS or not out:
            out.append(("", 0, self.DROP))
        return out

    def step(self, states: dict, word: str, i: int) -> dict:
        """The states behind the i-th character: last two classes -> (cost, path as linked pairs)."""
        new: dict = {}
        costs, readings, mask = self.costs, self.readings(word, i), word[i] in MASKS
        for (a, b), (total, path) in states.items():
            ahead = costs[a][b]
            for c, n, paid in readings + self.likely[a, b] if mask else readings:
                if c:
                    key, value, way = (b, n), total + paid + ahead[n], (c, path)
                else:
                    key, value, way = (a, b), total + paid, path
                if key not in new or value < new[key][0]:
                    new[key] = (value, way)
        return new

    def ended(self, states: dict) -> tuple[float, tuple | None]:
        """Cost and path of the likeliest word that ends here."""
        return min(
            ((total + self.costs[a][b][0], path) for (a, b), (total, path) in states.items()), key=lambda x: x[0]
        )

    def decode(self, word: str) -> str:
        """The likeliest letters behind the word; costs grow with its length only."""
        if GAPPED.fullmatch(word):
            word = word[::2]
        states = {(0, 0): (0.0, None)}
        for i in range(len(word)):
            states = self.step(states, word, i)
        return letters_of(self.ended(states)[1])

    def words(self, run: str) -> set[str]:
        """Words behind characters that stood apart, where any gap may be the end of a word.

        Those on a path of the lattice that costs at most ``NEAR`` more than the likeliest one.
        """
        n = len(run)
        ahead, found = [0.0] + [math.inf] * n, []
        for i in range(n):
            states = {(0, 0): (0.0, None)}
            for j in range(i, min(n, i + SPACED_WORD)):
                states = self.step(states, run, j)
                cost, path = self.ended(states)
                found.append((i, j + 1, cost, path))
                ahead[j + 1] = min(ahead[j + 1], ahead[i] + cost)
        behind = [math.inf] * n + [0.0]
        for i, j, cost, _ in reversed(found):
            behind[i] = min(behind[i], cost + behind[j])
        most = ahead[n] + self.NEAR
        return {letters_of(path) for i, j, cost, path in found if ahead[i] + cost + behind[j] <= most}


def letters_of(path: tuple | None) -> str:
    out = []
    while path:
        out.append(path[0])
        path = path[1]
    return "".join(reversed(out))


def bare(word: str) -> str:
    """The word without marks around it: punctuation, and signs that trail it or come in threes."""
    word = word.strip(EDGE)
    while word and (word[-1] in TRAILING or word[-3:] == word[-1] * 3 and not word[-1].isalnum()):
        word = word.rstrip(word[-1]).rstrip(EDGE)
    return word.lstrip("*#%_~")


def disguised(word: str) -> bool:
    """At least one letter mixed with signs, tripled letters or lookalikes, however many of the characters are signs."""
    return bool(MIXED.search(word) or TRIPLE.search(word) or any(c in LOOKALIKES for c in word))


def squeezed(word: str) -> str:
    """Runs of a letter as one letter: disguise by repetition leaves the same."""
    return DOUBLED.sub(r"\1", word)


def restored_words(text: str, decoder: Decoder, known: dict[str, tuple[str, ...]]) -> set[str]:
    """Distinct words of a text, disguised ones restored, runs of letters squeezed.

    ``known`` remembers what became of a word.
    """
    lower = text.lower()
    words = set(lower.split())
    out: set[str] = set()
    for word in words:
        got = known.get(word)
        if got is None:
            part, found = bare(word), set()
            if part.isalpha() and part.isascii() and not TRIPLE.search(part):
                found.add(squeezed(part))
            else:
                if disguised(part):
                    ways = {part, *(part.translate(way) for way in EITHER)}
                    found.update(squeezed(decoder.decode(way)) for way in ways)
                found.update(squeezed(p) for p in LETTERS.findall(part))
            found.discard("")
            got = known[word] = tuple(found)
        out.update(got)
    for run in SPACED.findall(lower):
        run = "".join(run.split())
        out.add(squeezed(decoder.decode(run)))
        out.update(map(squeezed, decoder.words(run)))
    out.discard("")
    return out


def pieces(word: str) -> list[str]:
    """The whole word, its first letters and its runs of letters."""
    out = [f"={word}"]
    out += [f"^{word[:n]}" for n in PREFIXES if len(word) > n]
    out += [word[i : i + PIECE] for i in range(len(word) - PIECE + 1)]
    return out


KEPT_WORDS = 300_000
KEPT_PIECES = 50_000  # words whose pieces a task remembers while it counts
COUNTED_PIECES = 100_000  # pieces that a task counts before it hands the counts on


class Scorer:
    """Chance of each word by its pieces, and of a text by its words."""

    def __init__(self, decoder: Decoder, chances: dict[str, float]):
        self.decoder, self.chances = decoder, chances
        self.known: dict[str, tuple[str, ...]] = {}
        self.words: dict[str, float] = {}

    def word(self, word: str) -> float:
        if word not in self.words:
            get = self.chances.get
            self.words[word] = max((get(p, 0.0) for p in pieces(word)), default=0.0)
        return self.words[word]

    def score(self, text: str | None) -> float:
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        if len(self.words) > KEPT_WORDS:
            self.words.clear()
        clean = 1.0 - LOWEST
        for word in restored_words(text, self.decoder, self.known) if text else ():
            chance = self.word(word)
            if chance:
                clean *= 1.0 - chance
        return 1.0 - clean


def sampled_labels(labels: DataFrame, most: int) -> DataFrame:
    """About ``most`` labelled numbers, those with the lowest hashes."""
    once = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    span = 1 << 40
    place = F.pmod(F.xxhash64("doc_id"), F.lit(span))
    part = min(1.0, most / max(1, once.count()))
    # The bound holds whatever the hash does, so the rows may be broadcast.
    return once.where(place < F.lit(int(span * part))).orderBy(place, "doc_id").limit(2 * most)


def learn(docs: DataFrame, labels: DataFrame, letters: LetterModel, most: int = LABELLED_DOCS) -> dict[str, float]:
    """Share of toxic documents for the pieces that tell them.

    The purest pieces are learned first; weaker ones must tell something about the
    documents that hold none of these.
    """
    sample = F.broadcast(sampled_labels(labels, most))
    rows = cut_lineage(
        docs.select("doc_id", "text")
        .join(sample, "doc_id")
        .where(F.col("text").isNotNull())
        .dropDuplicates(["text"])
        .select("text", "toxic")
    )
    chances: dict[str, float] = {}
    for least in SHARES:
        chances |= _purest(rows, letters, dict(chances), least)
    return chances


def count_pieces(
    frames: Iterable[pd.DataFrame], decoder: Decoder, told: dict[str, float], most: int = COUNTED_PIECES
) -> Iterator[pd.DataFrame]:
    """Toxic and clean texts with each piece, of those that hold none of ``told``.

    A piece's counts come in several rows: they go out whenever ``most`` pieces are counted.
    """
    of_word = functools.lru_cache(KEPT_PIECES)(pieces)
    known: dict[str, tuple[str, ...]] = {}
    toxic, clean = Counter(), Counter()
    for frame in frames:
        for text, label in zip(frame["text"], frame["toxic"]):
            if len(known) > KEPT_WORDS:
                known.clear()
            found = {p for w in restored_words(text, decoder, known) for p in of_word(w)}
            # An empty piece, which no word has, counts the documents.
            if told.keys().isdisjoint(found):
                (toxic if label == 1 else clean).update(found | {""})
            if len(toxic) + len(clean) >= most:
                yield counted(toxic, clean)
                toxic, clean = Counter(), Counter()
    yield counted(toxic, clean)


def counted(toxic: Counter, clean: Counter) -> pd.DataFrame:
    names = [*toxic, *(p for p in clean if p not in toxic)]
    return pd.DataFrame({"piece": names, "toxic": [toxic[p] for p in names], "clean": [clean[p] for p in names]})


def _purest(rows: DataFrame, letters: LetterModel, told: dict[str, float], least: float) -> dict[str, float]:
    """Pieces with a share of ``least`` among the rows that hold none of ``told``."""

    shared = shared_value(rows.sparkSession, Decoder(letters))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from count_pieces(frames, shared(), told)

    counts = (
        rows.mapInPandas(count, "piece string, toxic long, clean long")
        .groupBy("piece")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .withColumn("share", F.col("toxic") / (F.col("toxic") + F.col("clean") + 1.0))
    )
    tried = Observation()
    kept = {
        r["piece"]: r
        for r in counts.observe(tried, F.count(F.lit(1)).alias("n"))
        .where((F.col("share") >= least) | (F.col("piece") == ""))
        .orderBy(F.col("piece") != "", F.desc("toxic"), "piece")
        .limit(MOST_PIECES)
        .collect()
    }
    whole = kept.pop("", None)
    if not whole or not whole["toxic"]:
        return {}
    base = whole["toxic"] / (whole["toxic"] + whole["clean"])
    least_evidence = math.log(tried.get["n"]) + SURENESS
    return {p: r["share"] for p, r in kept.items() if evidence(r["toxic"], r["clean"], base) >= least_evidence}


def evidence(toxic: int, clean: int, base: float) -> float:
    """Log likelihood ratio of a piece's labels against the share of toxic documents."""
    n = toxic + clean
    out = toxic * math.log(toxic / (n * base)) if toxic else 0.0
    return out + (clean * math.log(clean / (n * (1 - base))) if clean and base < 1 else 0.0)


def train(docs: DataFrame, labels: DataFrame, learned: Column | None = None, most: int = LABELLED_DOCS) -> Scorer:
    """Letter model from all of ``docs``, scorer from the labels of the rows where ``learned`` holds."""
    letters = LetterModel(letter_counts(docs))
    shown = docs if learned is None else docs.where(learned)
    numbers = labels if learned is None else labels.where(learned)
    return Scorer(Decoder(letters), learn(shown, numbers, letters, most))


def score_texts(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """Add ``score`` to ``docs``."""
    shared = shared_value(docs.sparkSession, scorer)

    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Scorer(shared().decoder, shared().chances)
        for column in columns:
            yield pd.Series([own.score(t) for t in column], dtype="float64")

    score = F.pandas_udf(run, "double")(docs["text"])
    return beside(docs, F.struct(score.alias("score")), ["score"])


def drop_toxic(docs: DataFrame, labels: DataFrame, learned: Column | None = None) -> DataFrame:
    """``docs`` without the texts that the scorer rejects, with its own columns only."""
    scorer = train(docs.select("doc_id", "text"), labels, learned)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs["text"])
    return score_texts(rows, scorer).where(F.col("score") < THRESHOLD).select("_row.*")


def in_training() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4 != 2


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    scorer = train(docs, table(spark, sf, "labels"), in_training())
    return score_texts(docs, scorer).select(
        "doc_id",
        (~in_training()).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )

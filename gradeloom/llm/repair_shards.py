"""Token ids in shards compressed by a Re-Pair grammar, with random access.

The file format is a Parquet table with one record per shard. A record holds the
documents' ids in ascending ``doc_id`` order as a sequence of symbols; a symbol below
``base`` is a token id, any other names a rule, a pair of earlier symbols. Rules come
with the length of their expansion, and every document with its number of symbols, so
one document is found by two sums and only its own symbols are expanded.

Re-Pair here works in rounds: a round counts all adjacent pairs, gives each pair that
occurs often enough a new symbol, and replaces its occurrences, more frequent pairs
first where two overlap. Rounds end when one shortens the shard by less than a
hundredth. A pair never reaches over the end of a document.

Null texts are empty documents (the end id alone); null ids stand first, as the least number. Rows with equal ``doc_id`` are kept
and stand in the order of their texts. An empty table gives an empty file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.llm.packing import END_ID, crc_of, encoded
from gradeloom.llm.registry import query, table, with_null_ids, without_null_ids
from gradeloom.llm.token_ids import default_tokenizer, encoder
from gradeloom.session import new_folder

SHARD_TOKENS = 1 << 18  # a shard is closed once it has as many
LEAST_COUNT = 4  # a rule costs two symbols and a length
LEAST_GAIN = 0.01

SHARDS = (
    "part long, shard int, before long, n_tokens long, base int, doc_ids binary, doc_tokens binary, "
    "doc_symbols binary, rules binary, rule_lengths binary, rule_rounds binary, low binary, high binary"
)


def compress(ids: np.ndarray, ends: np.ndarray, base: int) -> dict:
    """Grammar of the ids of one shard; ``ends`` holds where each document ends."""
    symbols = ids.astype(np.uint32)
    final = np.zeros(len(symbols), bool)  # the symbol closes a document
    final[ends - 1] = True
    left, right, rounds = [], [], []
    rules, turn = base, 0
    while len(symbols) > 1:
        turn += 1
        bits = max(10, min(20, int(len(symbols)).bit_length() + 1))
        mix = np.uint32(0x9E3779B1 + 2 * turn)
        slot = (symbols[:-1] * mix ^ symbols[1:]) * np.uint32(0x85EBCA6B)
        slot >>= np.uint32(32 - bits)
        slot[final[:-1]] = 0  # slot 0 is given up for pairs that may not be joined
        count = np.bincount(slot, minlength=1 << bits).astype(np.int32)
        count[0] = 0
        # Pairs that share a slot: the one written last stands for it in this round.
        owner = np.zeros(1 << bits, np.uint32)
        owner[slot] = np.arange(len(slot), dtype=np.uint32)
        mine = owner[slot]
        weight = count[slot]
        weight[(weight < LEAST_COUNT) | (symbols[mine] != symbols[:-1]) | (symbols[mine + 1] != symbols[1:])] = 0
        around = np.zeros(len(weight) + 2, np.int32)
        around[1:-1] = weight
        peak = (weight > 0) & (weight >= around[:-2]) & (weight >= around[2:])
        # Of peaks in a row, which are equally frequent, every other one.
        peaks = np.flatnonzero(peak)
        row = peaks[np.maximum.accumulate(np.where(np.diff(peaks, prepend=-2) > 1, np.arange(len(peaks)), 0))]
        chosen = peaks[(peaks - row) % 2 == 0]
        names = slot[chosen]
        often = np.bincount(names, minlength=1 << bits) >= LEAST_COUNT
        chosen = chosen[often[names]]
        if len(chosen) < LEAST_GAIN * len(symbols):
            break
        new = np.flatnonzero(often)
        number = np.zeros(1 << bits, np.uint32)
        number[new] = rules + np.arange(len(new), dtype=np.uint32)
        left.append(symbols[owner[new]])
        right.append(symbols[owner[new] + 1])
        rounds.append(len(new))
        rules += len(new)
        symbols[chosen] = number[slot[chosen]]
        final[chosen] = final[chosen + 1]
        kept = np.ones(len(symbols), bool)
        kept[chosen + 1] = False
        symbols, final = symbols[kept], final[kept]
    pairs = np.stack([np.concatenate(left), np.concatenate(right)], 1) if left else np.zeros((0, 2), np.uint32)
    lengths = np.ones(rules, np.uint32)
    done = base
    for n in rounds:
        lengths[done : done + n] = lengths[pairs[done - base : done - base + n]].sum(1)
        done += n
    return {
        "base": base,
        "doc_tokens": np.diff(ends, prepend=0).astype("<u4").tobytes(),
        "doc_symbols": np.diff(np.flatnonzero(final) + 1, prepend=0).astype("<u4").tobytes(),
        "rules": pairs.astype("<u4").tobytes(),
        "rule_lengths": lengths[base:].astype("<u4").tobytes(),
        "rule_rounds": np.array(rounds, "<u4").tobytes(),
        "low": (symbols & 0xFFFF).astype("<u2").tobytes(),
        "high": (symbols >> 16).astype("u1").tobytes() if rules <= 1 << 24 else (symbols >> 16).astype("<u2").tobytes(),
    }


class Shard:
    """One record, ready to expand all documents or a part of one."""

    def __init__(self, record):
        self.base = int(record.base)
        self.doc_ids = np.frombuffer(record.doc_ids, "<i8")
        self.doc_tokens = np.frombuffer(record.doc_tokens, "<u4").astype(np.int64)
        self.doc_symbols = np.frombuffer(record.doc_symbols, "<u4").astype(np.int64)
        low = np.frombuffer(record.low, "<u2")
        high = np.frombuffer(record.high, "u1" if len(record.high) == len(low) else "<u2")
        self.symbols = low.astype(np.int64) | high.astype(np.int64) << 16
        self.pairs = np.frombuffer(record.rules, "<u4").reshape(-1, 2).astype(np.int64)
        self.lengths = np.concatenate(
            [np.ones(self.base, np.int64), np.frombuffer(record.rule_lengths, "<u4").astype(np.int64)]
        )
        self.rounds = np.frombuffer(record.rule_rounds, "<u4").astype(np.int64)

    def all_ids(self) -> np.ndarray:
        """Every id of the shard: the rules are spelled out once, round by round."""
        begin = np.cumsum(self.lengths) - self.lengths
        spelled = np.empty(int(self.lengths.sum()), np.uint32)
        spelled[: self.base] = np.arange(self.base)
        done = 0
        for n in self.rounds.tolist():
            both = self.pairs[done : done + n].ravel()
            target = begin[self.base + done]
            part = gathered(spelled, begin[both], self.lengths[both])
            spelled[target : target + len(part)] = part
            done += n
        return gathered(spelled, begin[self.symbols], self.lengths[self.symbols])

    def document(self, i: int, start: int = 0, length: int | None = None) -> np.ndarray:
        """Ids [start, start + length) of the shard's i-th document; only its symbols are expanded."""
        first = int(self.doc_symbols[:i].sum())
        own = self.symbols[first : first + int(self.doc_symbols[i])]
        stop = int(self.doc_tokens[i]) if length is None else start + length
        ends = np.cumsum(self.lengths[own])
        a = int(np.searchsorted(ends, start, side="right"))
        b = int(np.searchsorted(ends, stop, side="left")) + 1
        skipped = int(ends[a - 1]) if a else 0
        part = own[a:b]
        while (part >= self.base).any():
            rule = part >= self.base
            wide = np.repeat(part, 1 + rule)
            at = np.flatnonzero(rule) + np.arange(int(rule.sum()))
            wide[at], wide[at + 1] = self.pairs[part[rule] - self.base].T
            part = wide
        return part[start - skipped : stop - skipped].astype(np.uint32)


def gathered(source: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ranges of ``source`` one after the other."""
    before = np.cumsum(lengths) - lengths
    return source[np.arange(int(lengths.sum())) + np.repeat(begin - before, lengths)]


def write_shards(docs: DataFrame, folder: str, tokenizer: str | None = None, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode ``docs`` (doc_id, text) and write their ids to ``folder``.

    Range partitions of the id hold the documents in order; a partition numbers its own
    shards, and its first id names it.
    """
    path = tokenizer or default_tokenizer()

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, shard, before, kept, owners, size, base = None, 0, 0, [], [], 0, None

        def close() -> pd.DataFrame:
            lengths = np.array([len(ids) for ids in kept])
            record = compress(np.concatenate(kept), np.cumsum(lengths), base)
            record |= {"part": part, "shard": shard, "before": before, "n_tokens": size}
            record["doc_ids"] = np.array(owners, "<i8").tobytes()
            return pd.DataFrame([record])[[c.split()[0] for c in SHARDS.split(", ")]]

        for frame in frames:
            ids_of = frame["doc_id"].tolist()
            for i, ids in encoded(frame["text"].tolist(), path):
                if part is None:
                    part, base = ids_of[i], vocabulary_size(path)
                kept.append(ids)
                owners.append(ids_of[i])
                size += len(ids)
                if size >= shard_tokens:
                    yield close()
                    shard, before, kept, owners, size = shard + 1, before + size, [], [], 0
        if kept:
            yield close()

    (
        without_null_ids(docs.select("doc_id", "text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInPandas(write, SHARDS)
        .write.option("compression", "zstd")
        .parquet(folder)
    )


def vocabulary_size(path: str) -> int:
    return len(encoder(path).last)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: doc_id, part, offset (ids before it in its part), ids."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for record in frame.itertuples(index=False):
                shard = Shard(record)
                ids = shard.all_ids()
                ends = np.cumsum(shard.doc_tokens)
                parts = np.split(ids, ends[:-1])
                yield pd.DataFrame(
                    {
                        "doc_id": shard.doc_ids,
                        "part": record.part,
                        "offset": ends - shard.doc_tokens + record.before,
                        "n_tokens": shard.doc_tokens,
                        "ids_crc32": [crc_of(p) for p in parts],
                    }
                )

    schema = "doc_id long, part long, offset long, n_tokens long, ids_crc32 long"
    return with_null_ids(spark.read.schema(SHARDS).parquet(folder).mapInPandas(read, schema))


def part_starts(spark: SparkSession, folder: str) -> DataFrame:
    """Ids before each part: one row per range partition, summed in the order of the parts."""
    totals = (
        spark.read.schema(SHARDS).parquet(folder).groupBy("part").agg(F.sum("n_tokens").alias("total"))
    )
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("base"))


@query("op4_repair_shards")
def op4_repair_shards(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_folder(spark, "token-ids")
    write_shards(table(spark, sf, "documents"), folder)
    # One row per range partition: as many as the writing job had tasks.
    starts = F.broadcast(part_starts(spark, folder))
    return (
        read_shards(spark, folder)
        .join(starts, "part")
        .select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
    )

"""Jaccard self-join on word n-grams by T-occurrence search (DivideSkip).

Two documents link when the Jaccard similarity of their sets of distinct 5-word
shingles is at least 0.8. Documents with equal sets are one class. The join runs in
four steps, none of which loses a link:

1. *Sets.* Numpy cuts the texts into words and hashes shingles to 64 bits; a class is known
   by a hash of its set. In the same pass a table of fixed size counts how often shingles
   fall into each of its slots, over all documents.
2. *Candidate families.* The order of shingles, common to all sets, puts rare slots first, so that
   passages shared by many come last. Each shingle that one of two sets lacks parts one pair of neighbours of
   their overlap at most, so sets that link have a pair of neighbours in common, and among the first 0.4 n
   of each; its place bounds the sizes that a set can link with by it. Two shingles side by side in both sets are
   seldom chance, as one alone often is in a large corpus. Sets with such a pair in common and
   fitting sizes are put into one family: connected components of these contacts, found
   by contraction.
3. *Search.* Families go to cells of bounded size, small ones together. A large one is dealt
   by bands of sizes, as sets further apart than two neighbouring bands cannot link, and a large
   pair of bands in a grid of pairs of blocks; each pair of sets is counted in one cell. A cell holds
   inverted lists of its sets' shingles. For each set, DivideSkip sets aside the longest
   lists, merges the short ones, keeps sets that occur often enough in these, and
   probes the long lists by binary search; what reaches the required overlap is a link.
4. *Components.* A cell returns a spanning forest and link counts; a second contraction
   joins the forests.

Null and empty texts and texts of white space have an empty set and link with nothing,
not with each other either. A text of fewer than five words is one shingle. Rows with the same
``doc_id`` share a class if their texts have the same set, and are judged one by one. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.components import components
from gradeloom.llm.registry import query, table, written
from gradeloom.llm.token_ids import LOWER, SPACE_TABLE, batches_of, piece_hashes, word_bounds
from gradeloom.session import new_folder

WORDS = 5
PERCENT = 80
SLOTS = 1 << 20  # of the table that ranks shingles; only speed depends on it
FILTER_BITS = 1 << 26  # of the filter in front of the texts' shuffle; only speed depends on it
SLICES = 64
BUCKETS = 4  # of contact records, for each shuffle partition
_SIZES = lambda kind: np.dtype([("low", "<u4"), ("high", "u1"), ("n", kind), ("reach", kind), ("a", "<i8")])
NARROW, WIDE = _SIZES("<u2"), _SIZES("<u4")
BLOCK = 800  # sets in a block of a cell
BAND = 1.3  # ratio of sizes that a band spans; above 100 / PERCENT, so links reach the next band at most
BATCH = 2_000_000  # characters of texts read together
SHORT = 0.02  # DivideSkip's weight of probing against merging


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = x + np.uint64(0x9E3779B97F4A7C15 * (2 * seed + 1) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the texts, ascending in each, and where each text's begin."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
    starts, ends = word_bounds(data, SPACE_TABLE)
    edges = np.concatenate([[0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)])
    first = np.searchsorted(starts, edges)
    count = np.diff(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(raw) + 1, np.int64)
    hashes = piece_hashes(data, starts, ends)
    long_ones = np.maximum(count - words + 1, 0)
    owner = np.repeat(np.arange(len(raw)), long_ones)
    at = np.arange(int(long_ones.sum())) + np.repeat(first[:-1] - (np.cumsum(long_ones) - long_ones), long_ones)
    value = np.zeros(len(at), np.uint64)
    for k in range(words):
        value += hashes[at + k] * np.uint64(2 * (0x5851F42D4C957F2D * (k + 1) & 0x3FFFFFFFFFFFFFFF) + 1)
    value = mixed(value)
    brief = np.flatnonzero((count > 0) & (count < words))
    if len(brief):
        whole = np.zeros(len(brief), np.uint64)
        for k in range(words - 1):
            there = count[brief] > k
            whole[there] += mixed(hashes[first[brief[there]] + k], k + 1)
        owner = np.concatenate([owner, brief])
        value = np.concatenate([value, mixed(whole + count[brief].astype(np.uint64), 7)])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])])
    owner, value = owner[new], value[new]
    return value, np.searchsorted(owner, np.arange(len(raw) + 1))


def set_keys(value: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A hash of each set, as signed 64 bits; empty sets get zero."""
    n = np.diff(begin)
    out = np.zeros(len(n), np.uint64)
    filled = np.flatnonzero(n > 0)
    if len(filled):
        sums = np.add.reduceat(mixed(value, 3), begin[:-1][filled])
        out[filled] = mixed(sums + n[filled].astype(np.uint64), 5)
    return out.view(np.int64)


def slot_of(value: np.ndarray, slots: int) -> np.ndarray:
    return (value >> np.uint64(64 - (slots.bit_length() - 1))).astype(np.int64)


def summed_slices(parts: DataFrame, dtype: str, merge) -> np.ndarray | None:
    """One array from tasks' arrays (slice, counts), merged slice by slice."""

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        total = None
        for part in rows["counts"]:
            part = np.frombuffer(part, dtype)
            total = part.copy() if total is None else merge(total, part)
        return pd.DataFrame({"slice": rows["slice"].iloc[:1], "counts": [total.tobytes()]})

    rows = parts.groupBy("slice").applyInPandas(join, "slice int, counts binary").collect()
    found = {r["slice"]: np.frombuffer(r["counts"], dtype) for r in rows}
    return np.concatenate([found[i] for i in range(SLICES)]) if found else None


def in_slices(table_: np.ndarray) -> dict:
    parts = np.array_split(table_, SLICES)
    return {"slice": range(SLICES), "counts": [p.tobytes() for p in parts]}


READ = "doc_id long, n int, key long, slice int, counts binary"


def read_sets(docs: DataFrame, folder: str) -> None:
    """One pass over the texts: size and key of each set, and the tasks' shingle counts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(SLOTS, np.uint32)
        for frame in frames:
            texts, ids = frame["text"].tolist(), frame["doc_id"].to_numpy()
            for a, b in batches_of(texts, BATCH):
                value, begin = shingle_sets(texts[a:b])
                counts += np.bincount(slot_of(value, SLOTS), minlength=SLOTS).astype(np.uint32)
                yield pd.DataFrame(
                    {"doc_id": ids[a:b], "n": np.diff(begin).astype(np.int32), "key": set_keys(value, begin), "slice": None, "counts": None}
                )
        yield pd.DataFrame({"doc_id": None, "n": None, "key": None} | in_slices(counts))

    docs.select("doc_id", "text").mapInPandas(run, READ).write.parquet(folder)


def reach_of(size: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The largest size of a set that links and has its first unspoiled pair at this place of a set of this size.

    Of sets of n and m shingles with Jaccard t, one lacks at most (n - t m) / (1 + t) of its own in the other and that one
    (m - t n) / (1 + t). Each of them spoils one pair of neighbours in the overlap at most, so the first unspoiled pair
    stands no further behind than twice the one plus the other.
    """
    far = ((200 - PERCENT) * size - (100 + PERCENT) * place) // (2 * PERCENT - 100)
    return np.minimum(far, 100 * size // PERCENT)


def records(h: np.ndarray, n: np.ndarray, reach: np.ndarray, key: np.ndarray) -> np.ndarray:
    """One array of rows (low bits of h, n, reach, a), in two bytes a size where these do."""
    found = np.empty(len(h), NARROW if not len(h) or max(n.max(), reach.max()) < 1 << 16 else WIDE)
    found["low"], found["high"] = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) & np.uint64(0xFF)
    found["n"], found["reach"], found["a"] = n, reach, key
    return found


def chained(parts: list[np.ndarray]) -> pd.DataFrame:
    """Links (a, b) between the sets of one bucket's records."""
    h = np.concatenate([p["high"].astype(np.int64) << 32 | p["low"] for p in parts])
    order = np.argsort(h, kind="stable")
    equal = h[order][1:] == h[order][:-1]
    shared = np.zeros(len(h), bool)  # what one set alone has is passed over at once
    shared[1:] |= equal
    shared[:-1] |= equal
    order = order[shared]
    h = h[order]
    n, reach, key = (np.concatenate([p[c].astype(np.int64) for p in parts])[order] for c in ("n", "reach", "a"))
    order = np.lexsort((key, reach, n, h))
    # A run holds sets that may reach each other; its leader, furthest reach and least size
    # are all that the next row has to know.
    last, furthest, least, leader = None, 0, 0, 0
    pairs = set()
    for value, size, far, key_ in zip(*(r[order].tolist() for r in (h, n, reach, key))):
        if value != last or size > furthest:
            last, furthest, least, leader = value, far, size, key_
        elif far >= least:
            furthest = max(furthest, far)
            if key_ != leader:
                pairs.add((leader, key_))
    return pd.DataFrame(list(pairs), columns=["a", "b"], dtype="int64")


def contacts(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """Links (a, b) between sets that share two neighbours in their prefixes and fit in size.

    Sets of equal size that share them within a batch are linked at once, and one of them goes on.
    Rows travel as records, those of one bucket of hashes and one batch together.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(counts)
    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def prefixes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].tolist()
            for a, b in batches_of(texts, BATCH):
                value, begin = shingle_sets(texts[a:b])
                keys = set_keys(value, begin)
                n = np.diff(begin)
                _, once = np.unique(keys, return_index=True)
                first = np.zeros(len(n), bool)
                first[once] = True
                owner = np.repeat(np.arange(len(n)), n)
                kept = first[owner]
                owner, value = owner[kept], value[kept]
                order = np.lexsort((value, shared.value[slot_of(value, SLOTS)], owner))
                owner, value = owner[order], value[order]
                place = np.arange(len(owner)) - np.searchsorted(owner, owner)
                size = n[owner]
                reach = reach_of(size, place)
                head = np.flatnonzero((reach >= (PERCENT * size + 99) // 100) & (place + 1 < size))
                owner, size, reach = owner[head], size[head], reach[head]
                value = mixed(value[head] + mixed(value[head + 1], 13), 14)
                key = keys[owner]
                order = np.lexsort((key, -reach, size, value))
                value, size, key, reach = value[order], size[order], key[order], reach[order]
                # Sets of one size that reach each other: the one that reaches furthest goes on.
                same = np.zeros(len(value), bool)
                same[1:] = (value[1:] == value[:-1]) & (size[1:] == size[:-1]) & (reach[1:] >= size[1:])
                lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(same)))) if len(same) else same
                pairs = np.unique(np.stack([key[lead[same]], key[same]], 1), axis=0) if same.any() else np.zeros((0, 2), np.int64)
                # A pair goes on as two rows that share a name of their own and reach each other.
                name = mixed(pairs[:, 0].view(np.uint64) + mixed(pairs[:, 1].view(np.uint64), 11), 12)
                one = np.ones(2 * len(pairs), np.int64)
                h = np.concatenate([value[~same], name, name])
                bucket = (h >> np.uint64(40)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                found = records(
                    h[order],
                    np.concatenate([size[~same], one])[order],
                    np.concatenate([reach[~same], one])[order],
                    np.concatenate([key[~same], pairs[:, 0], pairs[:, 1]])[order],
                )
                names, at = np.unique(bucket[order], return_index=True)
                ends = [*at[1:].tolist(), len(found)]
                yield pd.DataFrame(
                    {
                        "bucket": names.astype(np.int32),
                        "wide": found.dtype == WIDE,
                        "records": [found[i:j].tobytes() for i, j in zip(at.tolist(), ends)],
                    }
                )

    def chains(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, parts = None, []
        for frame in frames:
            for bucket, wide, rows in zip(frame["bucket"].tolist(), frame["wide"].tolist(), frame["records"]):
                if bucket != now and parts:
                    yield chained(parts)
                    parts = []
                now = bucket
                parts.append(np.frombuffer(rows, WIDE if wide else NARROW))
        if parts:
            yield chained(parts)

    return (
        docs.select("doc_id", "text")
        .mapInPandas(prefixes, "bucket int, wide boolean, records binary")
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInPandas(chains, "a long, b long")
    )


class Cell:
    """Inverted lists of some sets, searched by DivideSkip."""

    def __init__(self, value: np.ndarray, begin: np.ndarray):
        """Sets stand in ascending order of their sizes; ``value`` holds their shingles."""
        self.n = np.diff(begin)
        owner = np.repeat(np.arange(len(self.n)), self.n)
        order = np.argsort(value, kind="stable")
        ordered = value[order]
        head = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, bool)
        number = np.cumsum(head) - 1
        length = np.bincount(number) if len(number) else np.zeros(0, np.int64)
        # A shingle that one set alone has cannot be in an overlap.
        shared = length > 1
        self.length = length[shared]
        self.first = np.cumsum(self.length) - self.length
        self.lists = owner[order][shared[number]] if len(number) else owner
        renamed = np.cumsum(shared) - 1
        of_value = np.empty(len(value), np.int64)
        of_value[order] = np.where(shared[number], renamed[number], -1) if len(number) else 0
        kept = of_value >= 0
        self.own = of_value[kept]
        self.begin = np.searchsorted(owner[kept], np.arange(len(self.n) + 1))

    def partners(self, q: int) -> np.ndarray:
        """Sets before the q-th that link with it."""
        n = int(self.n[q])
        need = (PERCENT * n + 99) // 100  # least overlap with any set of fitting size
        mine = self.own[self.begin[q] : self.begin[q + 1]]
        low = int(np.searchsorted(self.n, need))
        if len(mine) < need or low >= q:
            return np.zeros(0, np.int64)
        length = self.length[mine]
        order = np.argsort(length, kind="stable")
        mine, length = mine[order], length[order]
        aside = min(need - 1, int(need / (SHORT * np.log2(int(length[-1]) + 1) + 1)), len(mine) - 1)
        short, long = mine[: len(mine) - aside], mine[len(mine) - aside :]
        size = self.length[short]
        before = np.cumsum(size) - size
        merged = self.lists[np.arange(int(size.sum())) + np.repeat(self.first[short] - before, size)]
        # The lists are sorted runs; a stable sort merges them.
        merged = np.sort(merged[(merged >= low) & (merged < q)], kind="stable")
        if not len(merged):
            return merged
        head = np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1]]))
        candidate, found = merged[head], np.diff(np.append(head, len(merged)))
        good = found >= need - aside
        candidate, found = candidate[good], found[good]
        left = aside
        for number in long[::-1] if len(candidate) else ():
            # What cannot reach the overlap any more is not probed further.
            good = found + left >= need
            candidate, found = candidate[good], found[good]
            if not len(candidate):
                break
            begin, end = self.first[number], self.first[number] + self.length[number]
            run = self.lists[begin:end]
            at = np.searchsorted(run, candidate)
            found = found + (run[np.minimum(at, len(run) - 1)] == candidate)
            left -= 1
        return candidate[100 * found >= PERCENT * (n + self.n[candidate] - found)]


def search(rows: pd.DataFrame) -> pd.DataFrame:
    """Forest and link counts of one cell (text, key, copies, block, across, band, top)."""
    texts = rows["text"].tolist()
    parts = [shingle_sets(texts[i:j]) for i, j in batches_of(texts, BATCH)]
    value = np.concatenate([v for v, _ in parts])
    begin = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(b) for _, b in parts]))])
    keys = set_keys(value, begin)
    rows = rows.assign(n=np.diff(begin), place=np.arange(len(rows)))
    rows = rows[keys == rows["key"].to_numpy()].drop_duplicates("key").sort_values(["n", "key"])
    place = rows["place"].to_numpy()
    size = rows["n"].to_numpy()
    ends = np.cumsum(size)
    value = value[np.arange(int(size.sum())) + np.repeat(begin[:-1][place] - (ends - size), size)]
    cell = Cell(value, np.concatenate([[0], ends]))
    key, copies, block = rows["key"].to_numpy(), rows["copies"].to_numpy(), rows["block"].to_numpy()
    across = bool(rows["across"].iloc[0]) if len(rows) else False
    # Of two bands in a cell, pairs within the lower one belong to another cell.
    upper = (rows["top"] < 0).to_numpy() | (rows["band"] == rows["top"]).to_numpy()
    root = list(range(len(rows)))
    links = np.zeros(len(rows), np.int64)

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for q in range(len(rows)):
        found = cell.partners(q)
        if across:
            found = found[block[found] != block[q]]
        if not upper[q]:
            found = found[upper[found]]
        if len(found):
            links[q] += copies[found].sum()
            links[found] += copies[q]
            for i in found.tolist():
                root[top(i)] = top(q)
    linked = np.flatnonzero(links)
    return pd.DataFrame(
        {"a": key[[top(i) for i in linked.tolist()]] if len(linked) else key[:0], "b": key[linked], "links": links[linked]}
    )


def id_filter(ids: DataFrame, column: str) -> np.ndarray:
    """A bitmap of fixed size that has a bit for every id in ``column``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(FILTER_BITS, bool)
        for frame in frames:
            bits[bit_of(frame[column].to_numpy())] = True
        yield pd.DataFrame(in_slices(np.packbits(bits)))

    few = ids.select(column).coalesce(8)
    found = summed_slices(few.mapInPandas(run, "slice int, counts binary"), "u1", np.bitwise_or)
    return np.zeros(FILTER_BITS // 8, np.uint8) if found is None else found


def bit_of(ids: np.ndarray) -> np.ndarray:
    return (mixed(ids.astype(np.int64).view(np.uint64), 9) >> np.uint64(64 - (FILTER_BITS.bit_length() - 1))).astype(np.int64)


def only_ids(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """Documents whose number may be in the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def test(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        flags = np.unpackbits(shared.value).view(bool)
        for column in ids:
            yield pd.Series(flags[bit_of(column.fillna(0).to_numpy())])

    return docs.where(F.pandas_udf(test, "boolean")(F.col("doc_id")))


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links for each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    folder = new_folder(spark, "sets")
    read_sets(docs, folder)
    stored = spark.read.schema(READ).parquet(folder)
    sets = stored.where("counts IS NULL").select("doc_id", "n", "key")
    counts = summed_slices(stored.where("counts IS NOT NULL").select("slice", "counts"), "<u4", np.add)
    if counts is None:
        counts = np.zeros(SLOTS, np.uint32)
    families = components(contacts(docs, counts))
    classes = sets.where("n > 0").groupBy("key").agg(
        F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.min("n").alias("n")
    )

    members = (
        families.join(classes, families["node"] == classes["key"])
        .select("key", "root", "first", "copies", F.floor(F.log(F.col("n")) / F.log(F.lit(BAND))).cast("int").alias("band"))
    )
    total = max(1, members.count())
    large = members.groupBy("root").agg(F.count("*").alias("size")).withColumn("large", F.col("size") > BLOCK)
    # A large family is searched in pairs of neighbouring bands: a set is in two.
    dealt = members.join(large.select("root", "large"), "root").select(
        *members.columns,
        F.explode(F.when(F.col("large"), F.array(F.col("band"), F.col("band") + 1)).otherwise(F.array(F.lit(-1)))).alias("top"),
    )
    sizes = dealt.groupBy("root", "top").agg(F.count("*").alias("size"))
    here = F.pmod(F.xxhash64("key", F.lit(1)), F.col("blocks")).cast("int")
    cells = F.when(
        F.col("top") < 0,
        # Small families share cells.
        F.array(
            F.struct(
                F.pmod(F.xxhash64("root"), F.lit(max(1, 2 * total // BLOCK))).alias("cell"),
                F.lit(-1).alias("i"),
                F.lit(-1).alias("j"),
            )
        ),
    ).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.col("blocks") - 1),
            lambda other: F.struct(
                F.xxhash64("root", "top").alias("cell"),
                F.least(other, "block").alias("i"),
                F.greatest(other, "block").alias("j"),
            ),
        )
    )
    wanted = written(
        dealt.join(sizes, ["root", "top"])
        .withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
        .withColumn("block", here)
        .select("key", "first", "copies", "band", "top", "block", F.explode(cells).alias("c"))
        .select("key", "first", "copies", "band", "top", "block", "c.*", (F.col("c.i") < F.col("c.j")).alias("across")),
        "cells",
    )
    texts = only_ids(docs.select("doc_id", "text"), id_filter(wanted, "first"))
    found = written(
        wanted.join(texts, wanted["first"] == texts["doc_id"])
        .groupBy("cell", "i", "j")
        .applyInPandas(search, "a long, b long, links long"),
        "forest",
    )

    roots = components(found.select("a", "b"))
    # Every linked class is in the forest, so its root and its smallest document are known.
    smallest = (
        roots.join(classes, roots["node"] == classes["key"])
        .groupBy("root")
        .agg(F.min("first").alias("component_id"))
    )
    linked = (
        roots.join(smallest, "root")
        .select(F.col("node").alias("key"), "component_id")
        .join(found.groupBy(F.col("b").alias("key")).agg(F.sum("links").alias("links")), "key", "left")
    )
    about = classes.join(linked, "key", "left").select(
        F.col("key").alias("_key"),
        F.coalesce("component_id", "first").alias("_component"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("_links"),
    )
    return sets.join(about, (sets["key"] == about["_key"]) & (sets["n"] > 0), "left").select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("_component", "doc_id").alias("component_id"),
        F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with the smallest ``doc_id`` of each component, its own columns only.

    Rows without a number stay, as no other row can stand for them by name.
    """
    first = (
        link(docs.where(F.col("doc_id").isNotNull()))
        .where("doc_id = component_id")
        .select(F.col("doc_id").alias("_first"))
        .distinct()
    )
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs["doc_id"].alias("_id"))
    kept = rows.join(first, F.col("_id") == F.col("_first"), "left_semi")
    return kept.unionByName(rows.where(F.col("_id").isNull())).select("_row.*")


@query("op5_set_join")
def op5_set_join(spark: SparkSession, sf: str) -> DataFrame:
    return link(table(spark, sf, "documents"))

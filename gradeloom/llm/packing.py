"""Bounded-space online packing of token ids into fixed windows.

Each input partition keeps ``open_windows`` windows open. A document's ids first fill
whole windows; what is left goes to the open window with the least free space that
still holds it. When none does, the fullest window is topped up with the front of the
piece and emitted, and the rest of the piece looks for a place again. Windows still
open at the end of a partition are merged over a few partitions each.

Nothing but those last windows moves between tasks. Nulls in the text are empty
documents (one end id), a null id stays null; equal ids, repeated rows and empty tables need no special
care: each row is packed by itself. Other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.registry import query, table, with_null_ids, without_null_ids
from gradeloom.llm.token_ids import batches_of, default_tokenizer, encoder
from gradeloom.session import new_folder

WINDOW = 4096
OPEN_WINDOWS = 32
MERGED_PARTITIONS = 4
END_ID = 2
#: Characters encoded at once; the encoder's working arrays take about 40 bytes for each.
ENCODED_AT_ONCE = 1_000_000

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, ids binary"
)


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class Packer:
    """The open windows of one partition; ``place`` returns the windows it completes."""

    def __init__(self, window: int = WINDOW, open_windows: int = OPEN_WINDOWS):
        self.window, self.most = window, open_windows
        self.free: list[tuple[int, int]] = []  # (free space, number), ascending
        self.pieces: dict[int, list[tuple]] = {}
        self.numbers = 0

    def place(self, doc: int, ids: np.ndarray) -> list[list[tuple]]:
        """Pieces are (doc, start, ids, tokens of the document)."""
        done, start, total = [], 0, len(ids)
        while total - start >= self.window:
            done.append([(doc, start, ids[start : start + self.window], total)])
            start += self.window
        while start < total:
            need = total - start
            at = bisect_left(self.free, (need, -1))
            if at == len(self.free) and len(self.free) < self.most:
                self.pieces[self.numbers] = []
                insort(self.free, (self.window, self.numbers))
                self.numbers += 1
                at = bisect_left(self.free, (need, -1))
            if at == len(self.free):
                at = 0  # none holds it: the fullest takes what it can and leaves
            space, number = self.free.pop(at)
            part = ids[start : start + min(space, need)]
            self.pieces[number].append((doc, start, part, total))
            start += len(part)
            if len(part) == space:
                done.append(self.pieces.pop(number))
            else:
                insort(self.free, (space - len(part), number))
        return done

    def leftovers(self) -> list[list[tuple]]:
        return [self.pieces[number] for _, number in self.free]


def rows_of_window(pieces: list[tuple], sequence: int, keep_ids: bool) -> Iterator[tuple]:
    offset = 0
    for doc, start, ids, total in pieces:
        raw = ids.astype("<u4").tobytes()
        yield doc, start, len(ids), zlib.crc32(raw), total, sequence, offset, raw if keep_ids else None
        offset += len(ids)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])


def encoded(texts: list[str | None], path: str) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its ids and the end id) for each text."""
    tokens = encoder(path)
    for a, b in batches_of(texts, ENCODED_AT_ONCE):
        ids, at = tokens.encode(texts[a:b])
        for i in range(a, b):
            yield i, np.append(ids[at[i - a] : at[i - a + 1]], np.array(END_ID, ids.dtype))


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): where it came from and where it went.

    ``sequence_id`` and ``offset`` name its place. Leftover windows are cut and joined
    to full ones; the rest of such a merge is cut at powers of two, so nothing is padded.
    """
    path = tokenizer or default_tokenizer()

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, base = Packer(window, open_windows), TaskContext.get().partitionId() << 32
        number = 0
        for frame in frames:
            rows, docs_of = [], frame["doc_id"].tolist()
            for i, ids in encoded(frame["text"].tolist(), path):
                for pieces in packer.place(docs_of[i], ids):
                    rows.extend(rows_of_window(pieces, base + number, False))
                    number += 1
            yield _frame(rows)
        rows = []
        for pieces in packer.leftovers():
            rows.extend(rows_of_window(pieces, base + number, True))
            number += 1
        yield _frame(rows)

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["sequence_id", "offset"])
        stream = [
            (r.doc_id, r.start, np.frombuffer(r.ids, "<u4"), r.doc_tokens) for r in rows.itertuples(index=False)
        ]
        left = sum(len(p[2]) for p in stream)
        # Above the numbers that partitions use below their 32nd bit.
        sequence, out, at, skip = int(rows["sequence_id"].iloc[0]) | 1 << 31, [], 0, 0
        while left:
            room = size = window if left >= window else 1 << (left.bit_length() - 1)
            pieces = []
            while room:
                doc, start, ids, total = stream[at]
                part = ids[skip : skip + room]
                pieces.append((doc, start + skip, part, total))
                room -= len(part)
                skip += len(part)
                if skip == len(ids):
                    at, skip = at + 1, 0
            left -= size
            out.extend(rows_of_window(pieces, sequence, False))
            sequence += 1
        return _frame(out)

    folder = new_folder(docs.sparkSession, "packing")
    without_null_ids(docs.select("doc_id", "text")).mapInPandas(fill, PIECES).write.parquet(folder)
    # Written once: both branches read it, and the texts are encoded a single time.
    written = docs.sparkSession.read.schema(PIECES).parquet(folder)
    merged = (
        written.where(F.col("ids").isNotNull())
        .groupBy(F.floor(F.shiftright("sequence_id", 32) / MERGED_PARTITIONS).alias("batch"))
        .applyInPandas(merge, PIECES)
    )
    return with_null_ids(written.where(F.col("ids").isNull()).unionByName(merged).drop("ids"))


@query("op8_packing")
def op8_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack(table(spark, sf, "documents"))

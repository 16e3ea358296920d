"""Token ids of whole texts by a public tokenizer, with each distinct word encoded once.

The tokenizer drops white space and never joins across it, so the ids of a text are
the ids of its white-space separated pieces one after the other. A batch of texts is
cut into pieces with numpy, every distinct piece is encoded by the library, and the
ids are gathered back. Pieces that worker has met stay in a table of bounded size.
"""

from __future__ import annotations

import json
import os

import numpy as np

from gradeloom.llm.registry import once_per_worker

KEPT_PIECES = 1_500_000  # distinct pieces a worker remembers; beyond it the table starts anew
SPACES = b" \t\n\v\f\r"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse modulo 2^64."""

    def make() -> list[np.ndarray]:
        return [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]

    kept = once_per_worker("hash powers", make)
    if len(kept[0]) < n:
        for i, step in enumerate((HASH_BASE, pow(HASH_BASE, -1, 1 << 64))):
            kept[i] = np.full(n, step, np.uint64)
            kept[i][0] = 1
            np.multiply.accumulate(kept[i], out=kept[i])
    return kept[0], kept[1]


def piece_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges ``[start, end)``; equal bytes give equal hashes."""
    up, back = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    values = BYTE_VALUES[data]
    values *= up[: len(data)]
    np.cumsum(values, out=sums[1:])
    out = sums[ends]
    out -= sums[starts]
    out *= back[starts]
    out ^= (ends - starts).astype(np.uint64) << np.uint64(48)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


HASH_BASE = 0x9E3779B97F4A7C15
#: One odd 64-bit number for each byte value, from the multiplicative rule x -> a * (x + 1) mixed twice.
BYTE_VALUES = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
BYTE_VALUES ^= BYTE_VALUES >> np.uint64(31)
BYTE_VALUES *= np.uint64(0x94D049BB133111EB)
BYTE_VALUES |= np.uint64(1)


def word_bounds(data: np.ndarray, is_space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not white space."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~is_space[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


SPACE_TABLE = np.zeros(256, bool)
SPACE_TABLE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTER = np.zeros(256, bool)
LETTER[97:123] = True


class PieceEncoder:
    """Encodes batches of texts; ids fit the 16 bits of the vocabulary's size."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            raw = json.load(file)
        self.whole = Tokenizer.from_str(json.dumps(raw))
        # The same model for words of ASCII letters, which need neither normalisation nor splitting.
        plain = raw | {
            "normalizer": None,
            "added_tokens": [],
            "pre_tokenizer": {
                "type": "Sequence",
                "pretokenizers": [
                    {"type": "WhitespaceSplit"},
                    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False},
                ],
            },
        }
        self.words = Tokenizer.from_str(json.dumps(plain))
        vocabulary = self.whole.get_vocab()
        self.wide = np.uint16 if len(vocabulary) <= 1 << 16 else np.uint32
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.tails = np.array([self.whole.encode(t, add_special_tokens=False).ids[0] for t in ".,"], self.wide)
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.flat = np.zeros(0, self.wide)

    def learn(self, hashes: np.ndarray, pieces: list[str], plain: np.ndarray) -> None:
        """Add distinct pieces, given in the order of their ascending hashes.

        ``plain`` marks the pieces made of ASCII letters only.
        """
        words = [p for p, simple in zip(pieces, plain.tolist()) if simple]
        other = [p for p, simple in zip(pieces, plain.tolist()) if not simple]
        lines = [" ".join(words[i : i + 500]) for i in range(0, len(words), 500)]
        count = np.zeros(len(pieces), np.int64)
        first = np.zeros(len(pieces), np.int64)
        parts = [np.array(e.ids, self.wide) for e in self.words.encode_batch_fast(lines, add_special_tokens=False)]
        flat = np.concatenate(parts) if parts else np.zeros(0, self.wide)
        stops = np.flatnonzero(self.last[flat]) + 1
        if len(stops) != len(words):
            raise ValueError("the tokenizer does not end every word with one marked id")
        count[plain] = np.diff(stops, prepend=0)
        first[plain] = stops - count[plain]
        parts = [np.array(e.ids, self.wide) for e in self.whole.encode_batch_fast(other, add_special_tokens=False)]
        count[~plain] = np.fromiter(map(len, parts), np.int64, len(parts))
        first[~plain] = len(flat) + np.cumsum(count[~plain]) - count[~plain]
        at = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, at, hashes)
        self.first = np.insert(self.first, at, first + len(self.flat))
        self.count = np.insert(self.count, at, count)
        self.flat = np.concatenate([self.flat, flat, *parts])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's ids begin (one more entry than texts)."""
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
        data = LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)] if raw else np.zeros(0, np.uint8)
        starts, ends = word_bounds(data, SPACE_TABLE)
        if not len(starts):
            return np.zeros(0, self.wide), np.zeros(len(raw) + 1, np.int64)
        # One full stop or comma behind an ASCII letter is an id of its own.
        back, before = data[ends - 1], data[np.maximum(ends - 2, 0)]
        tail = ((back == 46) | (back == 44)) & (ends - starts > 1) & LETTER[before]
        ends = ends - tail
        hashes = piece_hashes(data, starts, ends)
        order = np.argsort(hashes)
        ordered = hashes[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        distinct = ordered[new]
        number = np.empty(len(hashes), np.int64)
        number[order] = np.cumsum(new) - 1
        if len(self.known) > KEPT_PIECES:
            self.forget()
        at = np.searchsorted(self.known, distinct)
        missing = np.ones(len(distinct), bool)
        inside = at < len(self.known)
        missing[inside] = self.known[at[inside]] != distinct[inside]
        if missing.any():
            sample = order[new][missing]
            a, b = starts[sample], ends[sample]
            letters = np.concatenate([[0], np.cumsum(LETTER[data], dtype=np.int32)])
            whole = data.tobytes()
            pieces = [whole[i:j] for i, j in zip(a.tolist(), b.tolist())]
            pieces = b"\n".join(pieces).decode("utf-8", "surrogatepass").split("\n")
            self.learn(distinct[missing], pieces, letters[b] - letters[a] == b - a)
            at = np.searchsorted(self.known, distinct)
        spot = at[number]
        count = self.count[spot]
        total = np.concatenate([[0], np.cumsum(count + tail)])
        index = np.arange(int(total[-1])) + np.repeat(self.first[spot] - total[:-1], count + tail)
        behind = total[1:][tail] - 1
        index[behind] = 0
        ids = self.flat[index]
        ids[behind] = self.tails[(back[tail] == 44).astype(np.int64)]
        edges = np.concatenate([[0], np.cumsum(lengths)])
        return ids, total[np.searchsorted(starts, edges)]


def encoder(path: str) -> PieceEncoder:
    return once_per_worker(("pieces", path), lambda: PieceEncoder(path))


def batches_of(texts: list[str | None], most: int = 4_000_000):
    """Ranges of texts with at most ``most`` characters, or one longer text each."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text or "") + 1
        if size and size + n > most:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)

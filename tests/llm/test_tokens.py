"""Token ids, shards and packing against the tokenizer library itself."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from rows import SF, no_docs, odd_docs, odd_texts  # noqa: F401
from tokenizers import Tokenizer

from gradeloom.llm import packing, repair_shards
from gradeloom.llm.registry import QUERIES
from gradeloom.llm.token_ids import PieceEncoder, default_tokenizer


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_tokenizer())


def ids_of(library, text):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def crc(ids):
    return zlib.crc32(ids.astype("<u4").tobytes())


def test_pieces_give_the_librarys_ids(library, odd_texts):
    texts = [*odd_texts, "Don't I'll x.y, a.b. Σας Å é x y \x1c .,., ﬁ ǅ"]
    own = PieceEncoder(default_tokenizer())
    for _ in range(2):  # the second time from memory
        ids, at = own.encode(texts)
        for i, text in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == ids_of(library, text)[:-1].tolist()


@pytest.mark.parametrize("seed", range(4))
def test_shard_round_trip(seed):
    random = np.random.default_rng(seed)
    docs = [np.append(random.integers(3, 3 + 4 ** (seed + 1), random.integers(0, 900)), 2) for _ in range(30)]
    docs.append(np.append(np.full(2000, 7), 2))
    ids, ends = np.concatenate(docs), np.cumsum([len(d) for d in docs])
    made = repair_shards.compress(ids, ends, 49408)
    record = type("Record", (), made | {"doc_ids": np.arange(len(docs)).astype("<i8").tobytes()})
    shard = repair_shards.Shard(record)
    assert shard.all_ids().tolist() == ids.tolist()
    assert len(shard.symbols) < len(ids)
    for i, doc in enumerate(docs):
        assert shard.document(i).tolist() == doc.tolist()
        a = len(doc) // 3
        assert shard.document(i, a, 5).tolist() == doc[a : a + 5].tolist()


def test_shards_of_odd_documents(spark, odd_docs, odd_texts, library, tmp_path):
    folder = str(tmp_path / "shards")
    repair_shards.write_shards(odd_docs, folder, shard_tokens=5000)
    rows = repair_shards.read_shards(spark, folder).collect()
    want = sorted([*range(len(odd_texts)), 5])
    assert sorted(r.doc_id for r in rows) == want
    for r in rows:
        ids = ids_of(library, odd_texts[r.doc_id])
        assert (r.n_tokens, r.ids_crc32) == (len(ids), crc(ids))
    starts = {r.part: r.base for r in repair_shards.part_starts(spark, folder).collect()}
    at = 0
    for r in sorted(rows, key=lambda r: (r.doc_id, starts[r.part] + r.offset)):
        assert starts[r.part] + r.offset == at
        at += r.n_tokens


def check_pieces(rows, want, window):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        ids = want[r.doc_id]
        assert r.doc_tokens == len(ids) and crc(ids[r.start : r.start + r.length]) == r.ids_crc32
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == window or at & (at - 1) == 0
    return by_doc


def test_packing_of_odd_documents(odd_docs, odd_texts, library):
    want = {i: ids_of(library, t) for i, t in enumerate(odd_texts)}
    rows = packing.pack(odd_docs, window=256, open_windows=3).collect()
    by_doc = check_pieces(rows, want, 256)
    for doc, pieces in by_doc.items():
        covered = np.zeros(len(want[doc]), int)
        for r in pieces:
            covered[r.start : r.start + r.length] += 1
        assert set(covered.tolist()) == {2 if doc == 5 else 1}


def test_best_fit():
    packer = packing.Packer(window=10, open_windows=2)
    ids = np.arange(100)
    assert packer.place(1, ids[:6]) == [] and packer.place(2, ids[:7]) == []
    [full] = packer.place(3, ids[:3])  # fits the second exactly
    assert [p[0] for p in full] == [2, 3]
    assert packer.place(4, ids[:8]) == []
    [full] = packer.place(5, ids[:5])  # fits none: the fullest takes two and leaves
    assert [(p[0], p[1], len(p[2])) for p in full] == [(4, 0, 8), (5, 0, 2)]
    assert sorted((p[0], len(p[2])) for w in packer.leftovers() for p in w) == [(1, 6), (5, 3)]


def test_empty_tables(spark, no_docs, tmp_path):
    assert packing.pack(no_docs).count() == 0
    folder = str(tmp_path / "none")
    repair_shards.write_shards(no_docs, folder)
    assert repair_shards.read_shards(spark, folder).count() == 0


def test_queries(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {i: ids_of(library, t) for i, t in texts.items()}
    at = 0
    for r in sorted(QUERIES["op4_repair_shards"](spark, SF).collect(), key=lambda r: r.doc_id):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(want[r.doc_id]), crc(want[r.doc_id]))
        at += r.n_tokens
    assert at == sum(map(len, want.values()))
    by_doc = check_pieces(QUERIES["op8_packing"](spark, SF).collect(), want, 4096)
    assert {d: sum(r.length for r in p) for d, p in by_doc.items()} == {d: len(w) for d, w in want.items()}

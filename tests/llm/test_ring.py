"""The hash ring against rows that walk around it one by one."""

import hashlib
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from rows import SF, no_docs, odd_docs, odd_texts  # noqa: F401

from gradeloom.llm import QUERIES, hash_ring
from gradeloom.llm.hash_ring import Ring, bounds, played, ring_of, sharded, write_shards


def digest(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def arc(ring, key):
    return bisect_left(ring.places, digest("" if key is None else str(key))) % len(ring.places)


def walked(ring, rows, most):
    """The shard of each row: all rows step from place to place together until a shard takes them.

    ``rows`` are (arc, order in the arc), any comparable order.
    """
    n, held, found = len(ring.places), Counter(), {}
    waiting = sorted(range(len(rows)), key=lambda i: rows[i])
    step = 0
    while waiting:
        left = []
        for i in sorted(waiting, key=lambda i: ((rows[i][0] + step) % n, rows[i][1:])):
            shard = ring.owners[(rows[i][0] + step) % n]
            if held[shard] < most[shard]:
                held[shard] += 1
                found[i] = shard
            else:
                left.append(i)
        waiting, step = left, step + 1
    return [found[i] for i in range(len(rows))]


def check_slots(rows):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    for found in slots.values():
        assert sorted(found) == list(range(len(found)))
    return {s: len(found) for s, found in slots.items()}


def test_query(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op13_hash_ring"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    sizes = check_slots(rows)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    ring, ids = ring_of(), [r.doc_id for r in rows]
    places = [(arc(ring, i), digest(str(i))) for i in ids]
    assert [r.shard for r in rows] == walked(ring, places, bounds(len(ids), 8))
    for r in rows:
        assert (r["size"], r.text_crc32) == (len(docs[r.doc_id]) + 1, zlib.crc32(docs[r.doc_id]))
        assert (r.law, r.grown_shard) == ("rows", None)


def test_plan_is_native(spark):
    plan = QUERIES["op13_hash_ring"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and "Arrow" not in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_rounds_on_counts(data):
    """Counts that are played give what single rows walk to, and no shard was passed by that had room."""
    shards = data.draw(st.integers(1, 5))
    ring = ring_of(shards, data.draw(st.integers(1, 6)))
    counts = data.draw(st.lists(st.integers(0, 9), min_size=len(ring.places), max_size=len(ring.places)))
    most = bounds(sum(counts), shards, data.draw(st.sampled_from([0.0, 0.2, 3.0])))
    pieces = played(ring, counts, most)
    rows = [(a, k) for a, n in enumerate(counts) for k in range(n)]
    got = {(p.arc, k): p.shard for p in pieces for k in range(p.start, p.stop)}
    assert [got[row] for row in rows] == walked(ring, rows, most)
    held = Counter(got.values())
    for (a, _), shard in got.items():
        step = a
        while ring.owners[step % len(ring.owners)] != shard:
            passed = ring.owners[step % len(ring.owners)]
            assert held[passed] == most[passed]
            step += 1


def test_few_pieces():
    ring = ring_of()
    pieces = played(ring, [1000] * len(ring.places), bounds(1000 * len(ring.places), 8))
    assert len(pieces) <= len(ring.places) + 8
    with pytest.raises(ValueError):
        ring_of(1 << 12, 1 << 12)


@pytest.mark.parametrize("block_rows", [4, 1 << 18])
def test_odd_rows_and_a_hot_key(spark, odd_docs, block_rows):
    hot = spark.range(3000).selectExpr(
        "if(id % 3 = 0, null, if(id % 3 = 1, 9007199254740993, id)) as doc_id", "if(id % 2 = 0, 'same', string(id)) as text",
        "'en' as lang", "'hot' as source", "4 as n_chars", "1.0D as score", "'r' as _row", "'t' as _text", "1L as _key",
        "'w' as n_words", "1 as row", "2 as new", "'k' as _kept",
    )
    docs = odd_docs.unionByName(hot)
    rows = sharded(docs, shards=5, replicas=16, block_rows=block_rows).collect()
    assert sorted(map(str, (tuple(r[c] for c in docs.columns) for r in rows))) == sorted(map(str, map(tuple, docs.collect())))
    sizes = check_slots(rows)
    assert len(sizes) == 5 and max(sizes.values()) - min(sizes.values()) <= 1


def test_blocks_stay_small(spark):
    """A third of the rows without a key are ranked in many blocks."""
    docs = spark.range(6000).selectExpr("if(id < 2000, null, id) as doc_id", "string(id) as text")
    seen = []
    original = hash_ring.with_position

    def watched(rows, order, group, name, block):
        seen.extend(rows.groupBy(*group, block.alias("b")).count().select("count").collect())
        return original(rows, order, group, name, block)

    hash_ring.with_position = watched
    try:
        assert sharded(docs, replicas=4, block_rows=100).count() == 6000
    finally:
        hash_ring.with_position = original
    assert max(r["count"] for r in seen) <= 200


def test_a_new_shard_moves_little(spark):
    docs = spark.range(40000).selectExpr("id as doc_id")
    by_shards = {
        (n, slack): {r.doc_id: r.shard for r in sharded(docs, shards=n, slack=slack).collect()}
        for n in (8, 9)
        for slack in (0.0, 0.25)
    }
    for slack, most in ((0.0, 0.35), (0.25, 0.13)):
        before, after = by_shards[8, slack], by_shards[9, slack]
        assert sum(before[i] != after[i] for i in before) <= most * len(before)
    counts = Counter(by_shards[9, 0.25].values())
    assert max(counts.values()) <= 40000 * 1.25 / 9 + 1


def test_empty_table(no_docs):
    assert sharded(no_docs).count() == 0


def test_one_place():
    assert [p.shard for p in played(Ring([5], [0]), [7], [7])] == [0]


def test_written_shards(spark, tmp_path):
    rows = sharded(spark.range(1000).selectExpr("id as doc_id"), shards=4)
    write_shards(rows, str(tmp_path / "out"), file_rows=100)
    again = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, again.select("doc_id", "shard", "slot").collect())) == sorted(
        map(tuple, rows.select("doc_id", "shard", "slot").collect())
    )
    per_file = again.selectExpr("input_file_name() as f").groupBy("f").count().collect()
    assert max(r["count"] for r in per_file) <= 100

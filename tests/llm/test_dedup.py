"""Near copies, repeated bytes and repeated lines against brute force."""

import hashlib
import random
import re

import duckdb
import pytest
from rows import SF, no_docs, odd_docs, odd_texts  # noqa: F401

from gradeloom.llm import line_dedup, set_join, suffix_dedup
from gradeloom.llm.components import components
from gradeloom.llm.registry import QUERIES, SQL
from tools.check_sql import TABLES, rows_of


def shingles(text):
    lower = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", lower)
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_links(rows):
    """(doc_id, text) -> {row: (n, component, links)} by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[top(i)] = top(j)
                links[i] += 1
                links[j] += 1
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), doc), doc)
    return [(doc, len(sets[i]), least[top(i)], links[i]) for i, (doc, _) in enumerate(rows)]


def linked(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in df.collect())


@pytest.fixture(scope="module")
def copies():
    """A group of near copies that chain, a shared passage, exact copies, singles."""
    made = random.Random(3)
    word = lambda: "".join(made.choice("abcdefgh") for _ in range(made.randint(2, 7)))
    base = [word() for _ in range(60)]
    rows = []
    for i in range(70):
        words = list(base)
        for _ in range(made.randint(0, 3)):
            words[made.randrange(len(words))] = word()
        rows.append((500 - i, " ".join(words)))
    passage = " ".join(word() for _ in range(55))
    rows += [(600 + i, " ".join(word() for _ in range(made.randint(5, 30))) + " " + passage) for i in range(40)]
    rows += [(700 + i, rows[i % 3][1]) for i in range(9)]
    rows += [(800 + i, " ".join(word() for _ in range(made.randint(1, 8)))) for i in range(60)]
    return rows


@pytest.mark.parametrize("block", [10, 1000])
def test_all_links_are_found(spark, copies, block, monkeypatch):
    monkeypatch.setattr(set_join, "BLOCK", block)
    docs = spark.createDataFrame(copies, "doc_id long, text string").repartition(5)
    got, want = linked(set_join.link(docs)), sorted(brute_links(copies))
    assert got == want
    assert len({r[2] for r in want}) < len(want) - 30


def test_chance_shingles_make_no_family(spark):
    """Texts in a ring share five single shingles with the next, which the order cannot tell from others."""
    import numpy as np

    made = random.Random(11)
    word = lambda: "".join(made.choice("abcdefghij") for _ in range(8))
    runs = [[" ".join(word() for _ in range(5)) for _ in range(5)] for _ in range(60)]
    rows = []
    for i in range(60):
        shared = [*runs[i], *runs[i - 1]]
        made.shuffle(shared)
        rows.append((i, " ".join(" ".join([*(word() for _ in range(15)), run]) for run in shared)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert set_join.contacts(docs, np.zeros(set_join.SLOTS, np.uint32)).count() <= 3
    near = [(100 + i, f"{text} {word()}") for i, text in rows]
    docs = docs.union(spark.createDataFrame(near, docs.schema))
    found = components(set_join.contacts(docs, np.zeros(set_join.SLOTS, np.uint32)))
    assert found.count() == 120 and found.groupBy("root").count().where("count > 4").isEmpty()


def test_sets_that_link_share_neighbours_in_reach():
    import numpy as np

    made = random.Random(5)
    met = 0
    for _ in range(4000):
        n = made.randint(4, 60)
        kept = made.sample(range(n), n - made.randint(0, n // 5))
        a, b = [*range(n)], [*kept, *range(100, 100 + made.randint(0, n // 4))]
        if len(kept) == len(a) == len(b) or 100 * len(kept) < 80 * (len(a) + len(b) - len(kept)):
            continue
        order = made.sample(range(200), 200)
        a, b = (sorted(s, key=order.__getitem__) for s in (a, b))
        far = [set_join.reach_of(np.full(len(s), len(s)), np.arange(len(s))) for s in (a, b)]
        heads = [
            {pair for pair, reach in zip(zip(s, s[1:]), f) if reach >= len(other)}
            for s, f, other in ((a, far[0], b), (b, far[1], a))
        ]
        assert heads[0] & heads[1]
        met += 1
    assert met > 500


def test_records_of_wide_sets():
    import numpy as np

    h = np.array([7 << 41 | 5, 7 << 41 | 5, 9], np.uint64)
    one = np.array([1, 2, 3])
    wide = set_join.records(h, np.array([70000, 70001, 1]), np.array([87500, 87501, 1]), one)
    narrow = set_join.records(h, np.array([6, 7, 1]), np.array([7, 8, 1]), one + 3)
    assert (wide.dtype, narrow.dtype) == (set_join.WIDE, set_join.NARROW)
    found = set_join.chained([wide, narrow])
    assert sorted(map(tuple, found.to_numpy().tolist())) == [(1, 2), (3, 6), (4, 5)]


def test_links_of_odd_documents(odd_docs, odd_texts):
    rows = [*enumerate(odd_texts), (5, odd_texts[5])]
    assert linked(set_join.link(odd_docs)) == sorted(brute_links(rows))


def test_one_of_each(odd_docs, odd_texts):
    kept = set_join.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    want = {d for d, _, c, _ in brute_links(list(enumerate(odd_texts))) if d == c}
    assert {r.doc_id for r in kept.collect()} == want


def test_partners_by_brute_force():
    import numpy as np

    made = random.Random(1)
    sets = sorted(
        (sorted(made.sample(range(40), made.randint(1, 30))) for _ in range(120)), key=len
    )
    value = np.array([v for s in sets for v in s], np.uint64)
    cell = set_join.Cell(value, np.cumsum([0] + [len(s) for s in sets]))
    for q, own in enumerate(sets):
        want = [
            i for i in range(q) if 100 * len({*own} & {*sets[i]}) >= 80 * len({*own} | {*sets[i]})
        ]
        # Sets of one size may come in any order; pairs are met once.
        assert sorted(cell.partners(q).tolist()) == want


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.root, set()).add(r.node)
    assert sorted(map(sorted, groups.values())) == [list(range(61)), list(range(100, 140))]


def brute_bytes(rows):
    """Covered bytes by a table of all strings of 50 bytes and the smallest document that has each."""
    least = {}
    for doc, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - 49):
            s = raw[i : i + 50]
            least[s] = min(least.get(s, doc), doc)
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 49):
            if least[raw[i : i + 50]] < doc:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((doc, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def removed(df):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_repeated_bytes(spark, copies, monkeypatch):
    made = random.Random(5)
    few = [(i, "".join(made.choice("ab ") for _ in range(made.randint(0, 400)))) for i in range(30)]
    tied = [(1000 + i, "x" * (48 + i)) for i in range(5)] + [(2000, "x" * 300), (1001, "x" * 90)]
    rows = [*copies, *few, *tied, (3000, copies[0][1][7:] + copies[5][1]), (3001, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert removed(suffix_dedup.remove_repeats(docs)) == brute_bytes(rows)
    monkeypatch.setattr(suffix_dedup, "batches_of", lambda texts, most: ((i, min(i + 3, len(texts))) for i in range(0, len(texts), 3)))
    assert removed(suffix_dedup.remove_repeats(docs)) == brute_bytes(rows)


def test_repeated_bytes_of_odd_documents(odd_docs, odd_texts):
    rows = [*enumerate(odd_texts), (5, odd_texts[5])]
    assert removed(suffix_dedup.remove_repeats(odd_docs)) == brute_bytes(rows)


def test_lines_of_odd_documents(odd_docs, odd_texts):
    rows = {r["_row"]["doc_id"]: r for r in line_dedup.dedup_lines(odd_docs).collect()}
    assert rows[0]["_kept"] is None and rows[1]["_kept"] == "" and rows[2]["_kept"] == odd_texts[2]
    kept = line_dedup.without_repeats(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(len(odd_texts)))


def test_shifted_passages_lose_the_same_chunks(spark):
    lines = [f"line {i} of the passage {i * i}" for i in range(30)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["new start", *lines, "new end"])), (3, "\n".join(lines)), (4, "alone\nhere")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["_row"]["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    assert got[1]["_n_removed"] == 0 and got[4]["_n_removed"] == 0
    assert got[3]["_kept"] == "" and got[3]["_n_removed"] == 30
    assert got[2]["_n_removed"] >= 20 and got[2]["_kept"].startswith("new start") and got[2]["_kept"].endswith("new end")
    kept = {r.doc_id: r.text for r in line_dedup.without_repeats(docs).collect()}
    assert sorted(kept) == [1, 2, 4]


def test_repeated_passages_in_any_lines(spark):
    made = random.Random(9)
    word = lambda: "".join(made.choice("abcdefghij") for _ in range(made.randint(3, 8)))
    own = lambda n: " ".join(word() for _ in range(n))
    one, few = own(60), "\n".join(own(20) for _ in range(3))
    around = [own(30) for _ in range(8)]
    rows = [
        (1, f"{around[0]}\n{one}\n{around[1]}\n{few}"),
        (2, f"{around[2]}\n{one}\n{around[3]}"),  # one long line
        (3, f"{around[4]}\n{few}\n{around[5]}"),  # three lines
        (4, f"{around[6]} {one} {around[7]}"),  # inside a line
        (5, one),
        (6, "  " + own(5) + " " + "\n".join(["ab cd ef"] * 40)),  # repeats across itself keep one window
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["_row"]["doc_id"]: r["_kept"] for r in line_dedup.dedup_lines(docs).collect()}
    assert got[1] == rows[0][1]
    assert got[2].split() == f"{around[2]} {around[3]}".split()
    assert got[3].split() == f"{around[4]} {around[5]}".split()
    left = got[4].split()
    assert left[:30] == around[6].split() and left[-30:] == around[7].split() and len(left) <= 60 + 25
    assert got[5] == "" and rows[5][1].startswith(got[6][:30]) and len(got[6].split()) >= 5
    assert {r.doc_id for r in line_dedup.without_repeats(docs).collect()} == {1, 2, 3, 4, 6}


def test_hashes_of_all_windows_are_not_read_again(spark):
    """What is done with repeated hashes reads their rows only, not those of the whole corpus."""
    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, f"other {text}"), (3, "a\nb\nc\nd")], "doc_id long, text string")
    read = {f.split("/")[-2].split("-")[0] for f in line_dedup.dedup_lines(docs).inputFiles()}
    assert "found" in read and "chunks" not in read


def test_every_passage_of_fifty_words_is_found(spark):
    """Passages at any place of other texts lose all words between their first and last window."""
    made = random.Random(21)
    word = lambda: "".join(made.choice("abcdefghij") for _ in range(made.randint(4, 8)))
    own = lambda n: [word() for _ in range(n)]
    passages = [own(made.choice([50, 51, 60, 90])) for _ in range(25)]
    rows, holds = [], {}
    for i in range(80):
        passage = made.choice(passages)
        sep = made.choice([" ", "\n"])
        rows.append((i, " ".join(own(made.randint(0, 40))) + sep + " ".join(passage) + sep + " ".join(own(made.randint(0, 40)))))
        holds.setdefault(" ".join(passage), []).append(i)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["_row"]["doc_id"]: (r["_kept"] or "").split() for r in line_dedup.dedup_lines(docs).collect()}
    for passage, found in holds.items():
        words = passage.split()
        assert set(words) <= set(got[found[0]])
        for i in found[1:]:
            assert sum(w in got[i] for w in words) <= 2 * (line_dedup.SPAN - 1)
            assert sum(w not in got[i] for w in words) >= line_dedup.WINDOW
            rest = set(rows[i][1].split()) - set(words)
            assert rest <= set(got[i])


def test_empty_tables(no_docs):
    assert set_join.link(no_docs).count() == 0
    assert set_join.one_of_each(no_docs).columns == no_docs.columns
    assert suffix_dedup.remove_repeats(no_docs).count() == 0
    assert line_dedup.without_repeats(no_docs).count() == 0


def test_queries(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert linked(QUERIES["op5_set_join"](spark, SF)) == sorted(brute_links(rows))
    assert removed(QUERIES["op6_suffix_dedup"](spark, SF)) == brute_bytes(rows)


NATIVE = {"op7_quality_rules", "op9_line_dedup"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    duck = duckdb.connect()
    for table in TABLES:
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert name not in NATIVE or not re.search("Python|Pandas|Arrow", plan)
    duck.execute(SQL[name])
    columns = [d[0] for d in duck.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, duck.fetchall())

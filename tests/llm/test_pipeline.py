"""The corpus pipeline, stage by stage on its own input."""

import pytest
from rows import SF

import __spark_entry__ as entry
import corpus_pipeline
from gradeloom.llm import decontaminate, line_dedup, set_join, toxicity
from gradeloom.session import new_folder


@pytest.fixture(scope="module")
def stages(spark):
    """(input, output) of each stage, written and read again."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        folder = new_folder(spark, "pipeline-test")
        stage(spark, docs, SF).write.parquet(folder)
        after = spark.read.parquet(folder)
        out.append((name, docs, after))
        docs = after
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns_and_order(stages):
    assert [name for name, _, _ in stages] == [
        "toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing",
    ]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns
        assert set(ids(after)) <= set(ids(before))


def test_toxicity_stage(spark, stages):
    _, before, after = stages[0]
    scorer = toxicity.train(before, spark.read.parquet(f"{SF}/labels.parquet"), toxicity.in_training())
    want = [r.doc_id for r in before.collect() if scorer.score(r.text) < toxicity.THRESHOLD]
    assert ids(after) == sorted(want)


def test_line_stage(stages):
    _, before, after = stages[1]
    lost = {r["_row"]["doc_id"]: r for r in line_dedup.dedup_lines(before).collect()}
    texts = {r.doc_id: r for r in after.collect()}
    for doc, r in lost.items():
        if r["_n_chunks_removed"] and r["_n_removed"] == r["_n_lines"]:
            assert doc not in texts
        else:
            assert texts[doc].text == r["_kept"] and texts[doc].n_chars == len(r["_kept"])


def test_join_stage(stages):
    _, before, after = stages[2]
    rows = set_join.link(before).collect()
    assert ids(after) == sorted(r.doc_id for r in rows if r.doc_id == r.component_id)


def test_benchmark_stage(spark, stages):
    _, before, after = stages[3]
    hits = decontaminate.scan(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
    assert ids(after) == sorted(r.doc_id for r in hits if not (r.n_hit > 0 and 20 * r.n_hit >= r.n_words))


def test_packing_stage(stages):
    _, before, after = stages[4]
    rows = after.collect()
    assert {r.doc_id for r in rows} == set(ids(before))
    for doc, total in {(r.doc_id, r.doc_tokens) for r in rows}:
        assert sum(r.length for r in rows if r.doc_id == doc) == total


def test_registered():
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert "pipeline" not in entry.oracle_sql()

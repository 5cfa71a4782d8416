"""Every corpus query on the smallest tables: against its SQL where it has one, and the pipeline stage by stage."""
import re
from pathlib import Path

import pytest

import corpus_pipeline
from docledger.llm import queries
from tests.llm.test_duplicates import ASCII, _components
from tests.llm.test_scans import _contaminated
from tools.compare import connect, rows_of

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert {"doc_id", "vec_id"} & set(df.columns)
    if name in queries.ORACLES:
        cur = connect(SF).execute(queries.ORACLES[name])
        assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())
    else:
        assert df.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_pipeline_keeps_copies(spark):
    """A group of exact copies keeps its text through the line stage and ends as one document; site lines still go."""
    text = "\n".join(f"line {k} of a clean document with words of its own" for k in range(8))
    rows = [(i, text, "en", "s", len(text)) for i in range(5)]
    rows += [(10 + i, f"Site line.\npage {i} is about thing {i * i} and nothing else at all", "en", "s", 60) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.line_dedup(spark, docs, SF)
    by = {r.doc_id: r.text for r in kept.collect()}
    assert all(by[i] == text for i in range(5)) and not any("Site line." in by[10 + i] for i in range(40))
    assert [r.doc_id for r in corpus_pipeline.jaccard_join(spark, kept, SF).where("doc_id < 10").collect()] == [0]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF).cache()
        seen[name] = (before.collect(), docs.collect())
        if name != "byte_bpe":
            assert docs.columns == columns
    was, now = seen["language_id"]
    assert {r.doc_id for r in now} == {r.doc_id for r in was if r.text and any(map(str.isalpha, r.text))}
    was, now = seen["line_dedup"]
    assert {r.doc_id for r in now} == {r.doc_id for r in was} and sum(len(r.text) for r in now) < sum(len(r.text) for r in was)
    assert all(r.n_chars == len(r.text) for r in now)
    was, now = seen["jaccard_join"]
    assert {r.doc_id for r in now} == {c for _, c in _components({r.doc_id: r.text for r in was}).values()} and len(now) < len(was)
    was, now = seen["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {r.doc_id for r in now} == {r.doc_id for r in was if not _contaminated(r.text, items)[1]}
    was, now = seen["byte_bpe"]
    assert {r.doc_id for r in now} == {r.doc_id for r in was} and all(len(r.token_ids) == r.n_tokens for r in now)
    assert sorted(r.ids_sha256 for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r.ids_sha256 for r in now)

"""The pipeline against its stages by brute force, and the queries against SQL."""

import duckdb
import pytest

import corpus_pipeline
from checks.compare import rows as plain_rows
from sumtrail.llm import line_quality, pii
from sumtrail.llm.queries import ORACLE, QUERIES
from sumtrail.session import written
from tests.llm.test_ngram_join import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    first = written(stages["quality rules"](spark, docs, sf))
    want = {r.doc_id: line_quality.judge(r.text)[-1] for r in docs.collect() if line_quality.judge(r.text)[-2]}
    assert {r.doc_id: r.text for r in first.collect()} == want
    second = written(stages["n-gram Jaccard join"](spark, first, sf))
    groups = brute(list(want.items()))
    assert sorted(r.doc_id for r in second.collect()) == sorted({c for _, c in groups.values()})
    third = written(stages["personal data"](spark, second, sf))
    trees = pii.fit(second)
    (texts, ids) = zip(*[(r.text, r.doc_id) for r in second.collect()])
    redacted = {i: pii.redact(t, spans) for i, t, (_, spans) in zip(ids, texts, pii.find(list(texts), trees))}
    assert {r.doc_id: r.text for r in third.collect()} == redacted
    assert not [t for t in redacted.values() if pii.base_spans(t)]
    fourth = written(stages["mixing"](spark, third, sf))
    for before, after in ((docs, first), (first, second), (second, third), (third, fourth)):
        assert after.columns == before.columns == COLUMNS
    copies = {r.doc_id: r["count"] for r in fourth.groupBy("doc_id").count().collect()}
    assert set(copies) <= set(redacted) and max(copies.values()) <= 2
    assert {r.text for r in fourth.collect()} <= set(redacted.values())
    last = stages["bpe"](spark, fourth, sf).collect()
    assert len(last) == sum(copies.values())
    assert {r.doc_id for r in last} == set(copies)


def test_run_equals_its_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf))
    key = lambda df: sorted((r.doc_id, r.n_tokens, bytes(r.ids)) for r in df.collect())
    assert key(corpus_pipeline.run(spark, sf)) == key(docs)


def test_empty_and_odd_tables(spark, sf):
    df = spark.createDataFrame([(None, None, None, None, None, 1), (2, "", "en", None, 0, 2), (3, "short", None, "s", 5, 3)],
                               "doc_id long, text string, lang string, source string, n_chars long, ids int")
    for start in (df, df.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            out = written(stage(spark, start, sf))
            assert out.count() <= 3
        chained = start
        for _, stage in corpus_pipeline.STAGES:
            chained = written(stage(spark, chained, sf))
        assert chained.count() == 0


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_matches_sql(spark, con, sf, name):
    df = QUERIES[name](spark, sf)
    result = con.sql(ORACLE[name])
    names = list(result.columns)
    assert sorted(names) == sorted(df.columns)
    assert plain_rows(df.columns, [tuple(r) for r in df.collect()]) == plain_rows(names, result.fetchall())


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE])
def test_query_covers_its_table(spark, con, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.count() > 0
    if name.startswith("op"):
        id_ = "page_id" if "page_id" in df.columns else "doc_id"
        of = "pages" if id_ == "page_id" else "documents"
        assert isinstance(con, duckdb.DuckDBPyConnection)
        want = [r[0] for r in con.sql(f"SELECT {id_} FROM {of} ORDER BY 1").fetchall()]
        assert sorted(r[0] for r in df.select(id_).collect()) == want

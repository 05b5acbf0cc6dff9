"""The stages against their operators, and the whole run."""

import corpus_pipeline
from tests_llm import frame, sf

from meterlight.llm import queries


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{sf()}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf()).cache()
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before
        before = docs.count()
    ids = {r["doc_id"] for r in docs.collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf())
    assert {r["doc_id"] for r in packed.collect()} == ids
    texts = [r["text"] for r in docs.collect()]
    assert len(set(texts)) == len(texts)


def test_stages_on_empty_tables(spark):
    docs = spark.read.parquet(f"{sf()}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf()).count() == 0


def test_copies_go(spark):
    text = " ".join(f"word{i}" for i in range(200))
    near = text.replace("word50 ", "other ")
    docs = frame(spark, [(1, text, None, None, None), (2, near, None, None, None), (3, text, None, None, None), (None, "x y z", None, None, None), (5, None, None, None, None)])
    kept = corpus_pipeline.drop_copies(spark, docs, sf())
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 2, 3, 5]
    kept = corpus_pipeline.drop_near_copies(spark, kept, sf())
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 2, 5]


def test_registered(spark):
    import __spark_entry__ as entry

    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(queries.ORACLES) <= set(entry.oracle_sql())
    assert len(queries.QUERIES) == 13

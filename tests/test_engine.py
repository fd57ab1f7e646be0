"""The engine over many calls: one table of answers, timings by stage, statistics that grow."""

import time

from tarn.operators import bm25, search
from tarn.runtime import materialise, written


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def hits(result):
    return sorted((r.query_id, r.rank, r.doc_id, round(r.score, 9)) for r in result["hits"].collect())


def source(spark):
    rows = [(f"d{i}", f"Common words stand here. Number{i} is rare. So is topic{i % 7} at times.") for i in range(40)]
    return spark.createDataFrame(rows, "doc_id string, text string")


def test_answers_stay_one_table(spark):
    engine = search.Engine.build(source(spark))
    engine.search(asked(spark, "number1"), k=3)
    before, results = written(), []
    for i in range(4):
        results.append((i, engine.search(asked(spark, f"number{i + 2}", "number1"), k=3)))
        assert len(engine._cache) == 1
        # Two tables for the caller, and one of answers in place of the one before.
        assert written() - before == 2 * (i + 1)
    cache = engine._cache[(3, "hybrid", True)].hits
    assert {r.text_key for r in cache.collect()} == {f"number{i}" for i in range(1, 6)}
    assert len(cache.inputFiles()[0].split("/answers-")) == 2 and len({f.rsplit("/", 1)[0] for f in cache.inputFiles()}) == 1
    # Results of earlier calls can still be read, and are those of an engine that has kept nothing.
    fresh = search.Engine(engine.settings, engine.documents, engine.vectors, engine.terms)
    for i, result in results:
        assert {r.query_id: r.cache_hit for r in result["cached"].collect()} == {0: False, 1: True}
        assert hits(result) == hits(fresh.search(asked(spark, f"number{i + 2}", "number1"), k=3))
    assert engine.search(asked(spark, "number3"), k=2)["cache_hit"] is False  # other options
    assert len(engine._cache) == 2


def test_a_text_without_hits_is_kept_as_well(spark):
    engine = search.Engine.build(source(spark))
    first = engine.search(asked(spark, "zzz"), k=3, strategy="sparse", rerank=False)
    again = engine.search(asked(spark, "zzz"), k=3, strategy="sparse", rerank=False)
    assert again["cache_hit"] and hits(first) == hits(again)


def test_answers_run_out(spark):
    engine = search.Engine.build(source(spark), search.Settings(cache_ttl=1))
    assert not engine.search(asked(spark, "topic1"), k=3)["cache_hit"]
    time.sleep(1.1)
    assert not engine.search(asked(spark, "topic1", "topic2"), k=3)["cache_hit"]
    kept = {r.text_key: r.expires for r in engine._cache[(3, "hybrid", True)].hits.collect()}
    assert set(kept) == {"topic1", "topic2"} and len(set(kept.values())) == 1
    never = search.Engine.build(source(spark), search.Settings(cache_ttl=0))
    never.search(asked(spark, "topic1"), k=3)
    assert not never.search(asked(spark, "topic1"), k=3)["cache_hit"] and not never._cache


def test_timings_by_stage(spark):
    engine = search.Engine.build(source(spark), reranker=search.fuse.lexical_score)
    stages = lambda **how: set(engine.search(asked(spark, "topic3"), k=2, **how)["timings_ms"])
    assert stages() == {"dense", "sparse", "fuse", "rerank", "total"}
    assert stages(strategy="sparse", rerank=False) == {"sparse", "total"}
    assert stages(strategy="dense") == {"dense", "rerank", "total"}
    assert stages() == {"total"}  # nothing was searched


def test_ingest_adds_to_the_statistics(spark):
    """As if the index had been built from what is there now; only what arrives is tokenised."""
    engine = search.Engine.build(source(spark))
    more = spark.createDataFrame([("d1", "Changed words. And more of them."), ("e", "A new one about topic3.")], "doc_id string, text string")
    for mode in ("append", "replace"):
        grown = engine.ingest(more, mode=mode)
        fresh = bm25.build(materialise(grown.documents, "documents"))
        for name in ("postings", "lengths"):
            columns = sorted(getattr(fresh, name).columns)
            rows = lambda index: sorted(map(tuple, getattr(index, name).select(*columns).collect()))  # noqa: E731, B023
            assert rows(grown.terms) == rows(fresh)
        round_ = lambda index: sorted((r.term, r.df, round(r.idf, 9)) for r in index.terms.collect())
        assert round_(grown.terms) == round_(fresh)

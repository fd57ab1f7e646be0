"""Indexes, fusion, metrics, feedback and stores on small inputs."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_plans import plan

from tarn.operators import bm25, dense, evaluate, feedback, fuse, index, search, stores


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


CORPUS = [(0, "the cat sat on the mat"), (1, "dogs and cats"), (2, "a quick brown fox"), (3, "the the the"), (4, "")]


def bm25_model(corpus, query):
    toks = {d: t.lower().split() for d, t in corpus}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df = Counter(w for t in toks.values() for w in set(t))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else floor for w, v in idf.items()}
    score = lambda t: sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in query.lower().split())
    return sorted(((round(score(t), 9), d) for d, t in toks.items()), key=lambda x: (-x[0], x[1]))


@pytest.mark.parametrize("text", ["the cat", "cat cat", "unknown", "THE fox"])
def test_bm25(spark, text):
    got = bm25.search(bm25.build(docs(spark, CORPUS)), asked(spark, text), 10).orderBy("rank").collect()
    assert [(round(r.score, 9), r.doc_id) for r in got] == bm25_model(CORPUS, text)


def test_bm25_grows(spark):
    more = docs(spark, [(4, "the cat again"), (9, "quick quick fox"), (10, None)])
    grown = bm25.grow(bm25.build(docs(spark, CORPUS)), more)
    want = bm25.build(docs(spark, CORPUS[:4]).unionByName(more))
    for name in ("postings", "lengths", "terms"):
        assert sorted(map(tuple, getattr(grown, name).collect())) == sorted(map(tuple, getattr(want, name).collect()))
    assert {(r.term, r.tf) for r in grown.postings.filter("doc_id = 9").collect()} == {("quick", 2), ("fox", 1)}


def test_bm25_counts_terms_without_a_shuffle(spark):
    assert "Exchange" not in plan(bm25.postings_of(docs(spark, CORPUS)))


def test_postings_sort_the_tokens_of_a_text_once(spark):
    """No filter on the counts is pushed to the texts, where it would sort a text anew for each of its tokens."""
    assert bm25.postings_of(docs(spark, CORPUS))._jdf.queryExecution().optimizedPlan().toString().count("sort_array") == 1


def test_bm25_search_shuffles_only_the_best(spark):
    text = plan(bm25.search(bm25.build(docs(spark, CORPUS)), asked(spark, "the cat", "fox"), 2)).split("\n\n")[0]
    assert "Join" not in text and text.count("Exchange") == 1 and "Exchange" not in text[text.index("MapInArrow") :]


def test_bm25_without_rows_of_counts_and_with_odd_ids(spark):
    """Postings alone, repeated and null ids, ids that are strings, several blocks: as the sums over postings."""
    rows = [(i % 7 or None, f"w{i % 5} w{i % 3} the cat w{i}") for i in range(40)] + [(50, ""), (51, None)]
    queries = query_terms = asked(spark, "w1 the", "w4 w4 cat w39", "nothing here", "", "w2")
    repeated = bm25.build(docs(spark, rows))
    assert repeated.counts is None
    idf = {r.term: r.idf for r in repeated.terms.collect()}
    avg = repeated.lengths.agg(F.avg("dl")).first()[0]
    want = {}
    for q in bm25.query_terms(query_terms).collect():
        mine = want.setdefault(q.query_id, {d: 0.0 for d, _ in rows})
        for p in repeated.postings.collect():
            if p.term == q.term:
                mine[p.doc_id] += q.qtf * idf[p.term] * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * p.dl / avg))
    best = {q: sorted(((-round(s, 9), d is not None, d) for d, s in w.items()))[:6] for q, w in want.items()}
    got = lambda found: {q: [(-round(r.score, 9), r.doc_id is not None, r.doc_id) for r in rs] for q, rs in by_query(found).items()}
    assert got(bm25.search(repeated, queries, 6)) == best
    assert got(bm25.search_terms(repeated, bm25.query_terms(queries), 6, block_queries=2)) == best
    named = bm25.build(docs(spark, CORPUS).withColumn("doc_id", F.concat(F.lit("d"), "doc_id")))
    assert [r.doc_id for r in bm25.search(named, asked(spark, "cat"), 2).orderBy("rank").collect()] == ["d0", "d1"]
    assert bm25.search(named, asked(spark, ""), 2).count() == 0 and bm25.search(bm25.build(docs(spark, [])), asked(spark, "cat"), 2).count() == 0


def by_query(found):
    hits = {}
    for r in found.orderBy("query_id", "rank").collect():
        hits.setdefault(r.query_id, []).append(r)
    return hits


def test_flat_search_encodes_once_for_all_blocks(spark):
    queries, encoded = search.encode(asked(spark, *(f"w{i}" for i in range(9))), "query_id"), search.encode(docs(spark, CORPUS), "doc_id")
    found = dense.flat_search(queries, encoded, 2, block_queries=2)
    text = plan(found)
    assert "EvalPython" not in text and text.count("MapInArrow") > 2
    assert sorted(found.collect()) == sorted(dense.flat_search(queries, encoded, 2).collect())


def test_flat_search_of_long_and_odd_vectors(spark):
    """Single precision only chooses: scores are those of double precision, also where it tells nothing."""
    rng = np.random.default_rng(5)
    for scale in (1.0, 1e6, 1e200):
        rows = (scale * np.repeat(rng.normal(size=(60, 8)), 2, axis=0) * (1 + 1e-8 * rng.integers(0, 2, size=(120, 1)))).tolist()
        v = spark.createDataFrame([*enumerate(rows), (200, [float("nan")] * 8)], "doc_id long, vector array<double>").coalesce(1)
        q = spark.createDataFrame(list(enumerate(rows[:3])), "query_id long, vector array<double>")
        got = by_query(dense.flat_search(q, v, 5))
        exact = np.array(rows[:3]) @ np.array(rows).T
        for i in range(3):
            order = sorted((-float(np.round(s, 9)), d) for d, s in enumerate(exact[i]) if np.isfinite(s))[:5]
            assert np.allclose([r.score for r in got.get(i, [])], [-s for s, _ in order], rtol=1e-12)
            if scale == 1.0:
                assert [r.doc_id for r in got[i]] == [d for _, d in order]


def test_bm25_blank_query_and_single_document(spark):
    index = bm25.build(docs(spark, [(7, "Hello World")]))
    got = bm25.search(index, asked(spark, "   ", "hello"), 10).collect()
    assert [(r.query_id, r.doc_id) for r in got] == [(1, 7)] and got[0].score < 0


def vectors(spark, m, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(m)], "doc_id long, vector array<double>")


def unit(n, d, seed):
    m = np.random.Generator(np.random.PCG64(seed)).normal(size=(n, d))
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def test_flat(spark):
    m = unit(50, 16, 1)
    v = vectors(spark, m)
    got = dense.flat_search(v.withColumnRenamed("doc_id", "query_id").filter("query_id < 5"), v.unionByName(v), 3).collect()
    for q in range(5):
        rows = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert rows[0].doc_id == rows[1].doc_id == q and rows[0].score > 0.99
        assert [r.score for r in rows] == sorted((r.score for r in rows), reverse=True)
    assert dense.flat_search(v.withColumnRenamed("doc_id", "query_id"), v.limit(0), 3).count() == 0


def test_flat_ties_blocks_and_bad_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(50, [2.0, 0.0]), (51, None), (None, [3.0, 0.0])]
    v = spark.createDataFrame(rows, "doc_id long, vector array<double>").filter("doc_id is not null").repartition(3)
    q = v.filter("doc_id < 20 OR doc_id = 51").withColumnRenamed("doc_id", "query_id")
    for block in (4096, 3):
        got = dense.flat_search(q, v, 4, block_queries=block).collect()
        assert {r.query_id for r in got} == set(range(20))
        assert sorted({(r["rank"], r.doc_id) for r in got}) == [(0, 50), (1, 0), (2, 1), (3, 2)]
    odd = v.unionByName(spark.createDataFrame([(60, [1.0]), (61, [1.0, 2.0, 3.0])], "doc_id long, vector array<double>"))
    with pytest.raises(Exception, match="in an index of 2"):
        dense.flat_search(q, odd, 4).collect()


def test_best_equals_a_full_sort():
    r = np.random.Generator(np.random.PCG64(2))
    best, docs, scores = dense.Best(7, 5), [], []
    for _ in range(30):
        d, s = r.integers(0, 1000, 9), np.round(r.normal(size=(7, 9)), 1)
        best.offer(np.arange(7), d, s)
        docs.append(d)
        scores.append(s)
    docs, scores = np.concatenate(docs), np.concatenate(scores, axis=1)
    for q in range(7):
        order = np.lexsort((docs, -scores[q]))[:5]
        assert best.doc[best.query == q].tolist() == docs[order].tolist() and best.score[best.query == q].tolist() == scores[q][order].tolist()


def test_hnsw_recall(spark):
    """10,000 vectors of 64 numbers, 100 queries, in one shard and in several."""
    m, q = unit(10_000, 64, 0), unit(100, 64, 42)
    v = vectors(spark, m)
    queries = vectors(spark, q).withColumnRenamed("doc_id", "query_id")
    exact = dense.flat_search(queries, v, 10).select("query_id", "doc_id")
    for shard_rows in (20_000, 4000):
        made = index.HnswIndex.build(v, shard_rows=shard_rows, ef_search=200)
        assert evaluate.recall_at_k(made.search(queries, 10), exact, 10).agg(F.avg("recall")).first()[0] >= 0.95
    assert "Exchange" not in plan(made.graph.mapInArrow(lambda b: b, dense.GRAPH))


def test_hnsw_index(spark):
    m = unit(200, 16, 3)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(0, m[1].tolist()), (999, None)], "doc_id long, vector array<float>")
    made = index.HnswIndex.build(rows.filter("doc_id < 150 or doc_id = 999"), m=8, ef_construction=50, ef_search=50, shard_rows=90)
    shards = lambda x: {r.shard: r.n for r in x.graph.select("shard", "n").collect()}
    assert made.size() == 150 and len(shards(made)) == 2
    queries = lambda ids: spark.createDataFrame([(i, m[i].tolist()) for i in ids], "query_id long, vector array<float>")
    best = lambda x, ids: {r.query_id: r.doc_id for r in x.search(queries(ids), 1).collect()}
    assert best(made, range(150)) == {i: i for i in range(150)}
    # Twenty more go into the graphs that are there; what was in them is found as before.
    grown = made.add(rows.filter("doc_id < 170"))
    assert grown.size() == 170 and set(shards(grown)) == set(shards(made))
    assert best(grown, range(170)) == {i: i for i in range(170)}
    # One more touches one shard only.
    one = grown.add(rows.filter("doc_id = 170"))
    assert sum(shards(one)[s] != shards(grown)[s] for s in shards(one)) == 1
    # Nothing new changes nothing; more than there is room for makes new shards.
    assert one.add(rows.filter("doc_id < 5")) is one
    full = one.add(rows.filter("doc_id >= 170"))
    assert full.size() == 200 and len(shards(full)) == 3
    assert best(full, range(200)) == {i: i for i in range(200)}
    with pytest.raises(Exception, match="in an index of 16"):
        full.add(spark.createDataFrame([(5000, [1.0, 0.0])], "doc_id long, vector array<float>")).size()
    assert index.HnswIndex.build(rows.limit(0)).search(queries([1]), 3).count() == 0


def test_ivf(spark, tmp_path):
    m = unit(400, 16, 5)
    v, q = vectors(spark, m), vectors(spark, m[:10]).withColumnRenamed("doc_id", "query_id")
    centers = dense.ivf_train(v, 8)
    exact = sorted(map(tuple, dense.flat_search(q, v, 5).select("query_id", "rank", "doc_id").collect()))
    full = sorted(map(tuple, dense.ivf_search(q, dense.ivf_cells(v, centers), centers, 5, n_probe=8).select("query_id", "rank", "doc_id").collect()))
    assert full == exact
    path = str(tmp_path / "ivf")
    dense.ivf_save(dense.ivf_cells(v, centers), centers, path)
    cells, centers = dense.ivf_load(spark, path)
    some = dense.ivf_search(q, cells, centers, 5, n_probe=2)
    assert "PartitionFilters: [isnotnull(cell" in plan(some) or "PartitionFilters: [cell" in plan(some)
    assert {(r.query_id, r.doc_id) for r in some.filter("rank = 0").collect()} == {(i, i) for i in range(10)}


def ranked(spark, *lists):
    rows = [(0, i, d, 1.0) for x in lists for i, d in enumerate(x)]
    return spark.createDataFrame(rows, "query_id long, rank int, doc_id long, score double")


def order(df):
    return [r.doc_id for r in df.orderBy("rank").collect()]


def test_rrf(spark):
    a, b = ranked(spark, [1, 2, 3]), ranked(spark, [2, 4])
    assert order(fuse.rrf_fuse([a, b])) == [2, 1, 4, 3]
    assert order(fuse.rrf_fuse([ranked(spark, [1]), ranked(spark, [2])])) == [1, 2]
    assert order(fuse.rrf_fuse([a, ranked(spark)], top=2)) == [1, 2]
    got = {r.doc_id: r.score for r in fuse.rrf_fuse([a, b]).collect()}
    assert got[2] == pytest.approx(1 / 62 + 1 / 61)


def test_search_rules(spark):
    d = docs(spark, CORPUS)
    v, index, q = search.encode(d, "doc_id"), bm25.build(d), asked(spark, "the cat")
    assert search.search(None, index, q, strategy="dense").count() == 0
    with pytest.raises(RuntimeError):
        search.search(None, None, q)
    with pytest.raises(ValueError):
        search.search(v, index, q, k=101)
    raw = search.search(v, None, q, k=3, strategy="hybrid", rerank=False)
    assert order(raw) == order(search.search(v, None, q, k=3, strategy="dense", rerank=False))
    best = search.search(v, index, q, k=2, documents=d, reranker=fuse.lexical_score)
    assert order(best)[0] == 0


def test_engine(spark, tmp_path):
    rows = [("a", "The cat sat. On the mat."), ("b", "A quick brown fox.")]
    source = spark.createDataFrame(rows, "doc_id string, text string")
    engine = search.Engine.build(source)
    q = asked(spark, "What fox?")
    first = engine.search(q, k=1)
    assert [r.intent for r in first["intents"].collect()] == ["informational"] and not first["cache_hit"]
    assert engine.search(q, k=1)["cache_hit"]
    # The same text under another id, and a new one beside it.
    both = engine.search(spark.createDataFrame([(77, "what  FOX?"), (78, "the cat")], "query_id long, text string"), k=1)
    assert {r.query_id: r.cache_hit for r in both["cached"].collect()} == {77: True, 78: False} and not both["cache_hit"]
    hits = {r.query_id: r.doc_id for r in both["hits"].collect()}
    assert hits[77] == order(first["hits"])[0] and hits.keys() == {77, 78}
    engine.save(str(tmp_path / "i"))
    loaded = search.Engine.load(spark, str(tmp_path / "i"))
    assert order(loaded.search(q, k=1)["hits"]) == order(first["hits"])
    more = engine.ingest(spark.createDataFrame([("c", "Another text."), ("a", "New words.")], "doc_id string, text string"), mode="replace")
    assert more.health()["size"] == 3 and engine.health()["size"] == 2
    for bad in ("", "x" * 1025, None):
        with pytest.raises(Exception, match="a query must have"):
            engine.search(spark.createDataFrame([(0, bad)], "query_id long, text string"))
    for row in (("", "text"), ("x" * 257, "text"), ("c", ""), ("c", None)):
        with pytest.raises(Exception, match="must have"):
            engine.ingest(spark.createDataFrame([row], "doc_id string, text string"))
    with pytest.raises(ValueError):
        search.Settings(backend="other")
    events = str(tmp_path / "events")
    assert engine.feedback(fb(spark, ("a", 0, "click")), events) == 1 and spark.read.parquet(events).count() == 1
    with pytest.raises(Exception, match="invalid feedback"):
        engine.feedback(fb(spark, ("a", 0, "hover")), events)


@pytest.mark.parametrize("backend", ["flat", "hnsw", "ivf"])
def test_backends(spark, tmp_path, backend):
    m = unit(300, 8, 7)
    v, q = vectors(spark, m), vectors(spark, m[:5]).withColumnRenamed("doc_id", "query_id")
    parameters = {"ivf": {"n_cells": 4, "n_probe": 2}, "hnsw": {"m": 8, "shard_rows": 100}}.get(backend, {})
    made = index.build_index(backend, v, **parameters)
    made.save(str(tmp_path / "x"))
    again = index.load_index(spark, str(tmp_path / "x"))
    assert type(again) is type(made) and again.size() == 300
    assert {(r.query_id, r.doc_id) for r in again.search(q, 3).filter("rank = 0").collect()} == {(i, i) for i in range(5)}
    grown = again.add(vectors(spark, unit(10, 8, 9), first=1000))
    assert grown.size() == 310
    far = vectors(spark, unit(10, 8, 9)).withColumnRenamed("doc_id", "query_id")
    assert {(r.query_id, r.doc_id) for r in grown.search(far, 1).collect()} == {(i, 1000 + i) for i in range(10)}
    with pytest.raises(ValueError, match="unknown index kind"):
        index.build_index("other", v)


def test_metrics(spark):
    r = ranked(spark, [5, 6, 7])
    rel = spark.createDataFrame([(0, 6), (0, 9), (1, 3)], "query_id long, doc_id long")
    values = lambda df: {x[0]: x[1] for x in df.collect()}
    assert values(evaluate.recall_at_k(r, rel, 3)) == {0: 0.5, 1: 0.0}
    assert values(evaluate.mrr_at_k(r, rel)) == {0: 0.5, 1: 0.0}
    assert values(evaluate.mrr_at_k(r, rel, 1)) == {0: 0.0, 1: 0.0}
    want = (1 / math.log2(3)) / (1 + 1 / math.log2(3))
    assert values(evaluate.ndcg_at_k(r, rel, 3))[0] == pytest.approx(want)
    assert values(evaluate.ndcg_at_k(ranked(spark, [6, 9]), rel, 2))[0] == pytest.approx(1)
    pseudo = evaluate.with_pseudo_judgements(rel.filter("query_id = 1"), r)
    assert {tuple(x) for x in pseudo.collect()} == {(1, 3), (0, 5), (0, 6), (0, 7)}


def test_latency(spark):
    ten = spark.range(1, 11).select(F.col("id").cast("double").alias("v"))
    row = evaluate.latency_percentiles(ten, "v").first()
    assert (row.p50, row.mean, row.n) == (5.5, 5.5, 10)
    assert tuple(evaluate.latency_percentiles(ten.limit(0), "v").first()) == (0, 0, 0, 0, 0, 0)
    lines = [x.line for x in evaluate.exposition(evaluate.histogram(ten.selectExpr("v / 10 AS v"), "v"), "s").collect()]
    assert 's_bucket{le="0.5"} 5' in lines and 's_bucket{le="+Inf"} 10' in lines


def test_exposition(spark):
    rows = spark.createDataFrame([('a"b\\', 0.003), ('a"b\\', 2.0), ("c\n", None)], "route string, v double")
    lines = {x.line for x in evaluate.exposition(evaluate.histogram(rows, "v", labels=("route",)), "s", ("route",), "Seconds").collect()}
    told = 'route="a\\"b\\\\"'
    assert {"# HELP s Seconds", "# TYPE s histogram", f's_bucket{{{told},le="0.005"}} 1', f's_bucket{{{told},le="+Inf"}} 2', f"s_sum{{{told}}} 2.003", f"s_count{{{told}}} 2", 's_count{route="c\\n"} 0'} <= lines
    counted = evaluate.samples(evaluate.counter(rows, ("route",)), "n_total", "counter", ("route",))
    assert {x.line for x in counted.collect()} == {"# TYPE n_total counter", f"n_total{{{told}}} 2.0", 'n_total{route="c\\n"} 1.0'}


def fb(spark, *rows):
    return spark.createDataFrame([("q", "test", d, r, e, None, 0.0) for d, r, e in rows], feedback.SCHEMA)


def mined(df, n=1):
    return sorted((r.pos_doc_id, r.neg_doc_id) for r in feedback.triples(df, n).collect())


def test_feedback(spark):
    assert mined(fb(spark, ("a", 0, "click"), ("b", 1, "skip"))) == []
    assert mined(fb(spark, ("a", 0, "skip"), ("b", 1, "click"))) == [("b", "a")]
    assert mined(fb(spark, ("a", 0, "click"), ("a", 0, "dwell"), ("b", 1, "click"))) == [("b", "a")]
    assert mined(fb(spark, ("a", 0, "skip"), ("b", 1, "click")), 2) == []
    assert mined(fb(spark, ("a", 1, "skip"), ("b", 1, "click"))) == []
    with pytest.raises(Exception, match="invalid feedback"):
        feedback.validated(fb(spark, ("a", -1, "click"))).collect()


def test_training(spark):
    clicks = feedback.synthetic_clicks(spark, 200)
    triples = feedback.triples(clicks)
    parts = Counter(r.part for r in feedback.split(triples, max_rows=100).collect())
    assert parts == {"eval": 10, "train": 90}
    pairs = feedback.training_pairs(triples, clicks.selectExpr("doc_id", "concat('query ', doc_id) AS text").distinct())
    model = feedback.train_reranker(pairs)
    assert model.transform(feedback.with_lexical_features(pairs)).count() == 2 * triples.count()
    scored = spark.createDataFrame([(2.0, 1.0), (1.0, 1.0)], "pos_score double, neg_score double")
    assert tuple(feedback.pairwise_mrr(scored).first()) == (0.75, 2)


def test_reranker_report(spark):
    texts = spark.createDataFrame([(f"d{i}", "red apple pie" if i % 2 else "blue whale song") for i in range(10)], "doc_id string, text string")
    rows = [(f"q{i}", "red apple", f"d{1 + 2 * (i % 5)}", f"d{2 * (i % 3)}") for i in range(60)]
    triples = spark.createDataFrame(rows, "query_id string, query_text string, pos_doc_id string, neg_doc_id string")
    model, report = feedback.reranker_report(triples, texts)
    assert (report["n_train"], report["n_eval"]) == (54, 6) and report["mrr_after"] == report["mrr_before"] == 1 and report["uplift"] == 0
    with pytest.raises(ValueError, match="no training triples"):
        feedback.reranker_report(triples.limit(0), texts)


def test_embedding_cache(spark):
    texts = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "y"), ("c", "z")], "key string, text string")
    cache = spark.createDataFrame([("a", [9.0, 9.0], 2), ("b", [1.0], 1)], "key string, vector array<double>, dim int")
    encode = lambda rows: rows.select("key", F.array(F.lit(0.0), F.length("text").cast("double")).alias("vector"))
    found, after = stores.embed_cached(texts, cache, encode, 2)
    assert sorted(map(tuple, found.collect())) == [("a", [9.0, 9.0], True), ("b", [0.0, 1.0], False), ("c", [0.0, 1.0], False)]
    assert sorted(map(tuple, after.collect())) == [("a", [9.0, 9.0], 2), ("b", [0.0, 1.0], 2), ("c", [0.0, 1.0], 2)]
    found, after = stores.embed_cached(texts, cache, encode, 2, use_cache=False)
    assert {r.hit for r in found.collect()} == {False} and found.count() == 3 and after.count() == 2


def test_stores(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v int")
    assert sorted(map(tuple, stores.upsert(rows(("a", 1), ("b", 2)), rows(("b", 3)), ["k"]).collect())) == [("a", 1), ("b", 3)]
    assert sorted(map(tuple, stores.keep_first(rows(("a", 1)), rows(("a", 2), ("b", 5), ("b", 4)), ["k"], F.col("v")).collect())) == [("a", 1), ("b", 4)]
    assert [tuple(r) for r in stores.keep_last(rows(("a", 1), ("a", 2)), ["k"], F.col("v")).collect()] == [("a", 2)]
    cache = spark.createDataFrame([("x", [1.0], 1), ("y", [1.0, 2.0], 2)], "key string, vec array<float>, dim int")
    got = stores.embedding_lookup(spark.createDataFrame([("x",), ("y",), ("y",)], "key string"), cache, 2).collect()
    assert sorted(map(tuple, got)) == [("x", False), ("y", True)]


@pytest.mark.parametrize("hold", [100, 65_536])
def test_percentiles_in_bounded_buffers(spark, hold):
    r = np.random.default_rng(6)
    groups = {"a": r.normal(size=1500).tolist(), "b": [1.0] * 990 + [2.0] * 30, "c": [5.0], None: r.integers(0, 4, 500).astype(float).tolist(), "d": [-1e300, 0.0, 1e300]}
    rows = [(k, x) for k, v in groups.items() for x in v] + [("a", None), ("a", float("nan")), ("e", None)]
    df = spark.createDataFrame(rows, "kind string, v double").repartition(3)
    got = {(x.kind, x.p): (x.value, x.n) for x in evaluate.percentiles(df, "v", labels=("kind",), points=(0.0, 0.5, 0.99, 1.0), hold=hold).collect()}
    assert len(got) == 4 * len(groups)
    for (kind, p), (value, n) in got.items():
        assert n == len(groups[kind]) and value == pytest.approx(np.percentile(groups[kind], 100 * p), rel=1e-12, abs=1e-12)
    one = evaluate.percentiles(df.filter("kind = 'a'"), "v", points=(0.5,), hold=hold).collect()
    assert len(one) == 1 and one[0].value == pytest.approx(np.median(groups["a"]))
    assert evaluate.percentiles(df.limit(0), "v", labels=("kind",), hold=hold).count() == 0

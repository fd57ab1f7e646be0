"""BM25 over blocks of postings gives what plain BM25 gives, with fewer postings read."""

import random

import pytest

from tarn.operators import blockmax, bm25


def hits(df):
    return sorted((r.query_id, r.rank, r.doc_id, round(r.score, 8)) for r in df.collect())


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    odds = [1 / (i + 1) for i in range(400)]
    rows = [(i, " ".join(r.choices(words, odds, k=r.randrange(1, 120)))) for i in range(1500)]
    rows += [(5000 + i, rows[i][1]) for i in range(40)] + [(9000, None), (9001, "")]  # ties, and texts without words
    asked = [(i, " ".join(r.choices(words, k=r.randrange(1, 12)))) for i in range(60)]
    asked += [(100, "w399 w399 w0"), (101, "unknown"), (102, ""), (103, None), (104, rows[3][1]), (105, "w0 w1 w2")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, text string")


@pytest.mark.parametrize("block_docs,k,block_queries", [(64, 10, 4096), (7, 3, 16), (5000, 30, 4096)])
def test_same_as_plain(corpus, block_docs, k, block_queries):
    docs, asked = corpus
    plain = bm25.build(docs)
    made = blockmax.build(plain, block_docs=block_docs)
    counted = {}
    assert hits(blockmax.search(made, asked, k, block_queries=block_queries, counted=counted)) == hits(bm25.search(plain, asked, k))
    assert 0 < counted["read"] <= counted["postings"]


def test_reads_fewer_postings(spark):
    """One rare word decides; the frequent ones are hardly read."""
    r = random.Random(2)
    rows = [(i, "the of and " * r.randrange(1, 4) + " ".join(r.choices([f"x{j}" for j in range(2000)], k=20)) + (" needle haystack pin" if i % 250 == 0 else "")) for i in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    asked = spark.createDataFrame([(0, "the needle of haystack and pin")], "query_id long, text string")
    plain, counted = bm25.build(docs), {}
    made = blockmax.build(plain, block_docs=32)
    assert hits(blockmax.search(made, asked, 10, counted=counted)) == hits(bm25.search(plain, asked, 10))
    assert counted["read"] < 0.5 * counted["postings"]


def test_blocks_are_read_where_they_lie(corpus):
    docs, asked = corpus
    made = blockmax.build(bm25.build(docs), block_docs=100)
    plan = blockmax.search(made, asked.filter("query_id = 105"), 5)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    # Blocks go from the scan to their scorer: no postings, no lengths, no exchange below it.
    below = plan[plan.index("MapInArrow") :]
    assert "blocks-" in below and "postings-" not in plan and "Exchange hashpartitioning" not in below
    sizes = made.blocks.selectExpr("size(docs) AS n").groupBy().max("n").first()[0]
    assert sizes < 2.5 * 100


def test_empty(spark, corpus):
    docs, asked = corpus
    made = blockmax.build(bm25.build(docs.limit(0)))
    assert blockmax.search(made, asked, 5).count() == 0
    made = blockmax.build(bm25.build(docs))
    assert blockmax.search(made, asked.limit(0), 5).count() == 0

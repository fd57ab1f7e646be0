"""Physical plans: pruned scans, top-k before the shuffle, no nested loops where keys exist."""

import contextlib
import io

import numpy as np
from pyspark.sql import functions as F

from tarn.functions import text as fn
from tarn.operators import dense, encoder
from tarn.plans import catalogue


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_scans_read_only_what_is_used(spark, sf_dir):
    text = plan(catalogue.QUERIES["approx_tokens"](spark, sf_dir))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
    text = plan(catalogue.QUERIES["latency_percentiles"](spark, sf_dir))
    assert "ReadSchema: struct<value:double>" in text


def test_filters_reach_the_scan(spark, sf_dir):
    text = plan(catalogue.user_turns(spark, sf_dir))
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,user)]" in text


def test_ranking_limits_before_the_exchange(spark, sf_dir):
    text = plan(catalogue.QUERIES["flat_topk"](spark, sf_dir))
    assert text.count("WindowGroupLimit") >= 2
    assert "TakeOrderedAndProject" in plan(catalogue.QUERIES["limit_docs"](spark, sf_dir))


def test_skip_above_is_an_equi_join(spark, sf_dir):
    text = plan(catalogue.QUERIES["feedback_triples"](spark, sf_dir))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_small_tables_are_dealt_out(spark, sf_dir):
    assert catalogue.documents(spark, sf_dir).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_term_statistics_have_a_row_for_each_term(spark, sf_dir):
    got = catalogue.QUERIES["bm25_term_stats"](spark, sf_dir)
    words = catalogue.documents(spark, sf_dir).select(F.explode(fn.tokenize(F.col("text"))).alias("term")).distinct()
    assert got.columns == ["term", "df", "idf"] and got.count() == words.count()


def test_texts_are_encoded_once(spark, sf_dir):
    """A filter on a vector ran the encoder a second time, below the exchange of the texts."""
    runs = lambda df: df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")
    for name in ("embed_hashing", "search_fallback", "rrf_fuse", "rrf_top_k"):
        assert runs(catalogue.QUERIES[name](spark, sf_dir)) == 1, name
    learnt = encoder.Encoder(np.ones(8), np.ones((8, 2)), np.ones(2))
    docs = catalogue.documents(spark, sf_dir)
    assert runs(dense.flat_search(learnt.encode(docs.filter("doc_id < 3"), "doc_id").withColumnRenamed("doc_id", "query_id"), learnt.encode(docs, "doc_id"))) == 1

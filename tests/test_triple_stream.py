"""Triples of complete queries from a stream."""

from pyspark.sql import functions as F

from tarn.operators import feedback
from tarn.streaming import ingest


def rows(spark, *events):
    """(query, hour, id, document, type)"""
    made = [(q, f"user {q}", d, t, h * 3_600_000_000, i) for q, h, i, d, t in events]
    return spark.createDataFrame(made, "query_id string, query_text string, doc_id string, event_type string, at long, event_id long").withColumn("ts", F.timestamp_micros("at"))


def test_goes_out_once_when_the_gap_has_passed(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def arrive(*events):
        made = rows(spark, *events)
        made.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(made.schema).parquet(source)
        ingest.triple_stream(stream, out, state, gap="10 hours", late="1 hour").awaitTermination()
        found = spark.read.schema("query_id string, query_text string, pos_doc_id string, neg_doc_id string").parquet(out)
        return sorted((r.query_id, r.pos_doc_id, r.neg_doc_id) for r in found.collect())

    assert arrive(("q", 0, 1, "a", "skip"), ("q", 2, 3, "c", "click"), ("r", 1, 4, "x", "click")) == []
    # Late, but before the end: it takes its place between the two.
    assert arrive(("q", 1, 2, "b", "dwell"), ("s", 5, 5, "y", "skip")) == []
    q = [("q", "c", "a"), ("q", "c", "b")]
    assert arrive(("t", 20, 6, "z", "skip")) == q
    # Too late: dropped. And what has gone out doesn't go out again.
    assert arrive(("q", 3, 7, "d", "click"), ("t", 21, 8, "w", "click")) == q
    # After the pause the same name is a query of its own.
    assert arrive(("q", 40, 9, "e", "skip"), ("q", 41, 10, "f", "click"), ("u", 80, 11, "z", "skip")) == sorted([*q, ("q", "f", "e"), ("t", "w", "z")])


def test_arrays_give_the_triples_of_the_join(spark, sf_dir):
    events = feedback.with_rank(feedback.from_events(spark.read.parquet(f"{sf_dir}/events.parquet")))
    whole = events.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "event_type", "query_text"))).alias("e"))
    for n in (1, 2):
        want = sorted(map(tuple, feedback.triples(events, n).collect()))
        assert want and sorted(map(tuple, feedback.triples_of(whole, n).select("query_id", "query_text", "pos_doc_id", "neg_doc_id").collect())) == want

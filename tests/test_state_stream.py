"""Entries that run out of a stream's state, and metrics that a stream tells of itself."""

import pytest
from pyspark.sql import functions as F

from tarn.operators.chunk import chunk_documents
from tarn.streaming import expiry, ingest, observed

PUT = "key string, minute long, value string"
ENTRY = "key string, value string, first_put timestamp, last_put timestamp, runs_out timestamp, n_puts long"


def test_an_entry_leaves_the_state_when_it_has_run_out(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def put(*rows):
        made = spark.createDataFrame(rows, PUT).select("key", F.timestamp_seconds(F.col("minute") * 60).alias("ts"), "value")
        made.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(made.schema).parquet(source)
        running = expiry.entry_stream(stream, ["key"], out, state)
        running.awaitTermination()
        told = lambda df: sorted(((r.key, r.value, r.n_puts, int(r.runs_out.timestamp()) // 60) for r in df.collect()), key=str)
        return told(expiry.live_entries(spark, state, ["key"])), told(spark.read.schema(ENTRY).parquet(out))

    # Repeated puts and a null key; a put without a time is none; at equal times the greater value is the later.
    live, gone = put(("a", 0, "x"), ("a", 0, "x"), ("a", 30, "v"), ("a", 30, "u"), (None, 10, "n"), ("b", None, "never"))
    assert (live, gone) == ([("a", "v", 4, 90), (None, "n", 1, 70)], [])
    # Time reaches 75: the null key's entry runs out, that of ``a`` is put again and lives on.
    live, gone = put(("a", 75, "w"))
    assert (live, gone) == ([("a", "w", 5, 135)], [(None, "n", 1, 70)])
    # At the very end of its life an entry is gone; a late put of no living entry is dropped; the key begins anew.
    live, gone = put(("c", 135, "c"))
    assert live == [("c", "c", 1, 195)] and ("a", "w", 5, 135) in gone
    live, gone = put(("a", 20, "late"), ("a", 140, "new"))
    assert live == [("a", "new", 1, 200), ("c", "c", 1, 195)] and len(gone) == 2


def test_observations_are_those_of_a_batch_count(spark, tmp_path):
    source, out, state, told, text = (str(tmp_path / x) for x in ("in", "out", "state", "told", "text"))

    def arrive(*texts):
        made = spark.createDataFrame([(f"{i}-{len(t or '')}", t) for i, t in enumerate(texts)], "doc_id string, text string")
        made.coalesce(1).write.mode("append").parquet(source)
        docs = spark.readStream.schema(made.schema).parquet(source)
        start = lambda: ingest.chunk_stream(docs, out, state, observe="tarn_chunks")
        observed.reported(start, spark, "tarn_chunks", told, ingest.CHUNK_BUCKETS, text)
        return {r.le: r.cumulative for r in observed.totals(spark, told, ingest.CHUNK_BUCKETS, "chunks").collect()}

    def counted():
        n = F.greatest(F.lit(1), F.floor(F.length("text") / 4))
        row = chunk_documents(spark.read.parquet(source)).select(n.alias("n")).agg(F.count("n").alias("+Inf"), *(F.count_if(F.col("n") <= b).alias(str(b)) for b in ingest.CHUNK_BUCKETS)).first()
        return row.asDict()

    assert arrive("One. Two.", None, "", "A sentence of words. " * 400) == counted()
    # A second run adds its batches to those told before; one without news changes nothing.
    both = arrive("Other words. " * 30)
    assert both == counted() and both["+Inf"] > 3
    start = lambda: ingest.chunk_stream(spark.readStream.schema("doc_id string, text string").parquet(source), out, state, observe="tarn_chunks")
    observed.reported(start, spark, "tarn_chunks", told, ingest.CHUNK_BUCKETS, text)
    lines = [r.value for r in spark.read.text(text).collect()]
    assert f'tarn_chunks_values_count{{stream="tarn_chunks"}} {both["+Inf"]}' in lines
    rates = observed.throughput(spark, told).collect()
    assert sorted(r.batch for r in rates) == [0, 1] and sum(r.n for r in rates) == both["+Inf"] and all(r.per_second > 0 for r in rates)


def test_a_stream_without_input_has_zeros_and_failures_are_raised(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id string, text string")
    empty.write.parquet(str(tmp_path / "in"))
    docs = spark.readStream.schema(empty.schema).parquet(str(tmp_path / "in"))
    start = lambda: ingest.chunk_stream(docs, str(tmp_path / "out"), str(tmp_path / "state"), observe="none")
    observed.reported(start, spark, "none", str(tmp_path / "told"), (1, 2))
    assert {(r.le, r.cumulative, r.total, r.sum) for r in observed.totals(spark, str(tmp_path / "told"), (1, 2), "x").collect()} == {("1", 0, 0, 0.0), ("2", 0, 0, 0.0), ("+Inf", 0, 0, 0.0)}
    reporter = observed.Reporter(spark, "none", str(tmp_path / "told"), (1, 2))
    reporter.failed.append(ValueError("told"))
    with pytest.raises(ValueError, match="told"):
        spark.streams.addListener(reporter)
        try:
            reporter.wait(start())
        finally:
            spark.streams.removeListener(reporter)

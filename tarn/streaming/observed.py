"""Metrics of running streams: observed by the query itself, told by a listener, without a second pass."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from tarn.operators import evaluate

ROW = "rows_in long, millis long, n long, sum double, counts array<long>"


def observed(df: DataFrame, name: str, v: Column, buckets) -> DataFrame:
    """``df``, counting its rows, the sum of a value and the rows up to each bound as it runs.

    The figures are accumulated in the tasks that make the rows. A null value is no
    observation.
    """
    counts = F.array(*(F.count_if(v <= b) for b in buckets))
    return df.observe(name, F.count(v).alias("n"), F.coalesce(F.sum(v.cast("double")), F.lit(0.0)).alias("sum"), counts.alias("counts"))


class Reporter(StreamingQueryListener):
    """Writes what a stream has observed under ``name``, a folder ``batch=<id>`` below ``path`` for each micro-batch.

    With a ``text`` folder the totals are written there as exposition text after each
    batch. A batch that is told again, as after a restart, replaces its folder, so it counts
    once. Triggers without rows write nothing. Other streams of the session are not its
    business. What goes wrong in it is kept and raised by ``wait``: a listener must not
    stop the stream.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, buckets=(), text: str = ""):
        self.spark, self.name, self.path, self.buckets, self.text = spark, name, path, buckets, text
        self.failed: list[Exception] = []
        self._ended: dict[str, threading.Event] = {}
        self._lock = threading.Lock()
        # A stream that takes in nothing has its zeros.
        self._write(-1, (0, 0, 0, 0.0, [0] * len(buckets)))

    def _write(self, batch: int, row: tuple) -> None:
        self.spark.createDataFrame([row], ROW).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        if self.text:
            lines = evaluate.exposition(totals(self.spark, self.path, self.buckets, self.name), f"{self.name}_values", ("stream",))
            lines.coalesce(1).write.mode("overwrite").text(self.text)

    def _end(self, run: str) -> threading.Event:
        with self._lock:
            return self._ended.setdefault(str(run), threading.Event())

    def onQueryStarted(self, event):
        self._end(event.runId)

    def onQueryIdle(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        seen = p.observedMetrics.get(self.name)
        if seen is None or not p.numInputRows:
            return
        try:
            self._write(p.batchId, (p.numInputRows, int(p.durationMs.get("addBatch", 0)), seen["n"], seen["sum"], list(seen["counts"])))
        except Exception as e:  # noqa: BLE001
            self.failed.append(e)

    def onQueryTerminated(self, event):
        self._end(event.runId).set()

    def wait(self, query: StreamingQuery, seconds: float = 600) -> None:
        """Until the query has ended and its last batch is told."""
        query.awaitTermination()
        if not self._end(query.runId).wait(seconds):
            raise TimeoutError("the end of the stream has not been told")
        if self.failed:
            raise self.failed[0]


def reported(start, spark: SparkSession, name: str, path: str, buckets, text: str = "") -> StreamingQuery:
    """Runs the stream that ``start()`` gives to its end, its observations under ``name`` going to ``path``."""
    reporter = Reporter(spark, name, path, buckets, text)
    spark.streams.addListener(reporter)
    try:
        running = start()
        reporter.wait(running)
        return running
    finally:
        spark.streams.removeListener(reporter)


def totals(spark: SparkSession, path: str, buckets, stream: str) -> DataFrame:
    """``stream, le, cumulative, total, sum`` over all batches told so far, as ``evaluate.histogram`` has it."""
    told = spark.read.schema(f"{ROW}, batch long").parquet(path)
    every = told.agg(F.sum("n").alias("total"), F.sum("sum").alias("sum"), *(F.sum(F.col("counts")[i]).alias(f"b{i}") for i in range(len(buckets))))
    bounds = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("cumulative")) for i, b in enumerate(buckets)]
    rows = every.select("*", F.explode(F.array(*bounds, F.struct(F.lit("+Inf").alias("le"), F.col("total").alias("cumulative")))).alias("b"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c.split(".")[-1])
    return rows.select(F.lit(stream).alias("stream"), "b.le", zero("b.cumulative"), zero("total"), zero("sum"))


def throughput(spark: SparkSession, path: str) -> DataFrame:
    """``batch, rows_in, n, per_second``: what each batch took in and gave out, and its rows given out a second."""
    told = spark.read.schema(f"{ROW}, batch long").parquet(path)
    return told.filter("batch >= 0").select("batch", "rows_in", "n", (F.col("n") * 1000 / F.greatest("millis", F.lit(1))).alias("per_second"))

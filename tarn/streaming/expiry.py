"""Entries that run out, kept as the state of a stream instead of a table that is filtered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def entry_stream(puts: DataFrame, keys: list[str], out: str, checkpoint: str, *, ttl: str = "3600 seconds", late: str = "0 seconds", ts_col: str = "ts", value_col: str = "value") -> StreamingQuery:
    """Puts (``keys``, a time, a value) into a store whose entries live for ``ttl`` after their last put.

    The state store is the store: an entry is a session of its key, holding its first and
    last put, their number and the value of the last (the greater value at equal times).
    Two puts of a key less than ``ttl`` apart, or just so far, are of one entry, a later
    one begins another. An entry has run out once the watermark, ``late`` behind the
    greatest time seen, has reached the end of its life: it then leaves the state and is
    appended to ``out`` once. So the state grows with the entries that are alive, not with
    those ever put. Puts before the watermark that belong to no living entry are dropped,
    as are those without a time; a null key is a key. Equal puts of a hot key are
    combined before the shuffle.
    """
    last = F.max(F.struct(F.col(ts_col).alias("ts"), F.col(value_col).alias("value"))).alias("last")
    entries = (
        puts.filter(F.col(ts_col).isNotNull())
        .withWatermark(ts_col, late)
        .groupBy(*keys, F.session_window(ts_col, ttl).alias("life"))
        .agg(last, F.count(F.lit(1)).alias("n_puts"))
    )
    told = entries.select(*keys, "last.value", F.col("life.start").alias("first_put"), F.col("last.ts").alias("last_put"), F.col("life.end").alias("runs_out"), "n_puts")
    return told.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def live_entries(spark: SparkSession, checkpoint: str, keys: list[str]) -> DataFrame:
    """The entries that an ``entry_stream`` holds after its last batch, in the columns of those that have run out."""
    state = spark.read.format("statestore").load(checkpoint).select("value.*")
    # The state names the aggregates by their functions, in the order of the stream's plan.
    last, count = state.columns[-2:]
    window = F.col("session_window")
    return state.select(*keys, F.col(f"{last}.value").alias("value"), window["start"].alias("first_put"), F.col(f"{last}.ts").alias("last_put"), window["end"].alias("runs_out"), F.col(count).alias("n_puts"))

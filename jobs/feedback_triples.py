"""Incremental job: training triples from files of events as they arrive.

    python jobs/feedback_triples.py EVENTS OUT CHECKPOINT [--config jobs/feedback_triples.json]

EVENTS is a folder of Parquet files (or one file) with ``event_id, ts, user_id,
event_type, value, props``. A file stream takes the files that the checkpoint doesn't
know yet and ends when there are none left. A user's day is a query. Each batch

* adds its events to ``OUT/log``, partitioned by batch and day,
* puts events of unknown type, or without user or time, into ``OUT/rejected`` instead,
* mines the triples of all days that it touches anew, out of the whole log of these
  days, and replaces these days in ``OUT/triples``, partitioned by day.

So a late event corrects its day, however late, and days without news aren't read. A
batch that is run again after a failure writes the same partitions again. An event id
that arrives again changes nothing. A second run over the same files does nothing.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    from jobs import common
except ModuleNotFoundError:  # run as a file
    import common

from tarn.operators import feedback
from tarn.operators.stores import keep_last

log = logging.getLogger("feedback_triples")
DEFAULTS = {"min_clicks": 1, "max_files": 1000}
LOG = "event_id long, query_id string, query_text string, doc_id string, event_type string, dwell_ms int, at long, arrived long, day string"
TRIPLES = "query_id string, query_text string, pos_doc_id string, neg_doc_id string, day string"


def run(spark: SparkSession, events: str, out: str, checkpoint: str, config: str | None = None) -> dict[str, int]:
    """Takes what is new in ``events``; the numbers of batches, events, rejected events and touched days."""
    chosen = common.settings(spark, config, DEFAULTS)
    counts = {"batches": 0, "events": 0, "rejected": 0, "days": 0}

    def add(batch: DataFrame, number: int) -> None:
        typed = feedback.from_events(batch).withColumn("arrived", F.lit(number).cast("long"))
        ok = F.col("event_type").isNotNull() & F.col("query_id").isNotNull() & F.col("event_id").isNotNull()
        replaced(typed.filter(ok), f"{out}/log", "arrived", "day")
        replaced(typed.filter(~ok).drop("day"), f"{out}/rejected", "arrived")
        taken = logged(spark, out).filter(F.col("arrived") == number)
        # A row for each day that has news.
        days = {r.day: r["count"] for r in taken.groupBy("day").count().collect()}
        if days:
            whole = keep_last(logged(spark, out).filter(F.col("day").isin(list(days))), ["event_id"], -F.col("arrived"))
            mined = feedback.triples(feedback.with_rank(whole), chosen["min_clicks"])
            replaced(mined.withColumn("day", F.substring_index("query_id", "-", -3)), f"{out}/triples", "day")
        arrived, kept = batch.count(), sum(days.values())
        for name, n in (("batches", 1), ("events", kept), ("rejected", arrived - kept), ("days", len(days))):
            counts[name] += n
        log.info("batch %d: read %d events from %s, logged %d, rejected %d, mined %d days anew into %s/triples", number, arrived, events, kept, arrived - kept, len(days), out)

    query = arriving(spark, events, chosen["max_files"]).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("took %(events)d new events in %(batches)d batches, rejected %(rejected)d, replaced %(days)d days", counts)
    return counts


def arriving(spark: SparkSession, events: str, max_files: int) -> DataFrame:
    """The files of ``events`` as a stream; of one file its folder, without the other files in it."""
    table = spark.read.parquet(events)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", max_files)
    if not common.is_file(table, events):
        return stream.parquet(events)
    folder, name = events.rstrip("/").rsplit("/", 1)
    return stream.option("pathGlobFilter", name).parquet(folder)


def replaced(rows: DataFrame, path: str, *by: str) -> None:
    """Writes the partitions that ``rows`` have, over what they had."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def logged(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(f"{out}/log")


def result(spark: SparkSession, out: str) -> DataFrame:
    """All triples as they stand, with the day of their query."""
    return spark.read.schema(TRIPLES).parquet(f"{out}/triples")


if __name__ == "__main__":
    common.command_line("feedback_triples", {"events": "folder of Parquet files of events", "out": "folder of the result", "checkpoint": "folder of the stream's checkpoint"}, run)

"""Structured Streaming: documents into chunks and live indexes, feedback events into a table, running counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarn.functions.text import approx_tokens
from tarn.operators import bm25, feedback
from tarn.operators.chunk import chunk_documents
from tarn.operators.search import encode
from tarn.runtime import materialise, spread
from tarn.streaming.observed import observed


#: Bounds of chunk sizes in tokens.
CHUNK_BUCKETS = (32, 64, 128, 256, 512)


def chunk_stream(documents: DataFrame, out: str, checkpoint: str, *, max_tokens: int = 512, overlap_tokens: int = 32, observe: str = "") -> StreamingQuery:
    """Chunks of arriving documents, appended as Parquet; stateless, exactly once. Their
    number and sizes are observed under the name ``observe``, if it is given."""
    chunked = chunk_documents(documents, max_tokens, overlap_tokens)
    if observe:
        chunked = observed(chunked, observe, approx_tokens(F.col("text")), CHUNK_BUCKETS)
    return chunked.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_stream(documents: DataFrame, path: str, checkpoint: str, *, dim: int = 64, max_tokens: int = 512, overlap_tokens: int = 32) -> StreamingQuery:
    """Arriving documents (doc_id, text) into a live index below ``path``.

    Each micro-batch is chunked, encoded and counted, and appended as a folder
    ``batch=<id>`` of the tables ``texts`` (chunk_id, doc_id, text), ``vectors``
    (chunk_id, vector) and ``counts`` (chunk_id, text_key, dl, counts): a row for each
    chunk in each of them. A batch that is run again after a failure writes the same
    folder again, so it counts once. ``live_index`` reads the tables as they stand.
    """

    def add(batch: DataFrame, number: int) -> None:
        def put(name: str, df: DataFrame) -> DataFrame:
            folder = f"{path}/{name}/batch={number}"
            df.write.mode("overwrite").option("compression", "zstd").parquet(folder)
            return df.sparkSession.read.schema(df.schema).parquet(folder)

        made = chunk_documents(spread(batch.select("doc_id", "text"), "doc_id"), max_tokens, overlap_tokens)
        # The texts as written are what the others are made of: no copy of them lies beside.
        texts = put("texts", made.select("chunk_id", "doc_id", "text"))
        put("vectors", encode(texts, "chunk_id", dim=dim))
        counted = bm25.term_counts(texts.withColumn("row", F.struct("chunk_id", _text_key().alias("text_key"))), "row")
        put("counts", counted.select("doc_id.*", "dl", "counts"))

    return documents.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _text_key() -> Column:
    return F.xxhash64("text")


def live_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, bm25.Bm25Index]:
    """Texts, vectors and BM25 index of what ``index_stream`` has written so far.

    Of a chunk that arrived in several batches the last text and its counts count,
    and the first vector; of several texts in that batch the one of the greatest hash.
    Statistics are taken from the counts that count. Which chunks came again is told by
    their ids; where none did, the tables are read as they lie, without a copy or an
    exchange of their rows. Where some did, the counts that count are written once more.
    Chunks of a document without an id have none and are left out.
    """
    texts, vectors, counts = (spark.read.parquet(f"{path}/{name}").filter("chunk_id IS NOT NULL") for name in ("texts", "vectors", "counts"))
    last = F.max(F.struct("batch", "text_key"))
    again = counts.groupBy("chunk_id").agg(F.count("*").alias("n"), F.min("batch").alias("first"), last.alias("last")).filter("n > 1")
    again = materialise(again.select("chunk_id", "first", "last.batch", "last.text_key"), "arrived-again")
    if again.head(1):
        newest = again.drop("first")
        one = again.select("chunk_id", F.col("first").alias("batch"))

        def chosen(df: DataFrame, which: DataFrame) -> DataFrame:
            """The rows of chunks that came once, and one row of each other chunk."""
            found = df.join(which, which.columns, "left_semi").dropDuplicates(["chunk_id"])
            return df.join(again.select("chunk_id"), "chunk_id", "left_anti").unionByName(found)

        texts = chosen(texts.withColumn("text_key", _text_key()), newest)
        # Statistics and searches read the counts again and again: the choice is made once.
        vectors, counts = chosen(vectors, one), materialise(chosen(counts, newest), "counts")
    texts, vectors = texts.select("chunk_id", "doc_id", "text"), vectors.select("chunk_id", "vector")
    return texts, vectors, bm25.of_counts(counts.select(F.col("chunk_id").alias("doc_id"), "dl", "counts"))


def feedback_stream(events: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Arriving feedback events, appended as Parquet."""
    return events.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def triple_stream(events: DataFrame, out: str, checkpoint: str, *, gap: str = "24 hours", late: str = "1 hour", n: int = 1) -> StreamingQuery:
    """Triples of arriving events (query_id, query_text, doc_id, event_type, at, event_id, ts), appended as Parquet.

    A query is complete when ``gap`` has passed after its last event by the events' own
    time: its events are a session, kept in the state store until the watermark,
    ``late`` behind the latest event seen, has passed its end. Then its triples, those of
    ``feedback.triples`` with at least ``n`` clicks, go out once and its state goes. An
    event that comes later than that, behind the watermark, is dropped; one that comes
    late but before it takes its place in the order of time. A query that goes on after
    a longer pause is a query of its own. Events that arrive twice count twice.
    """
    item = F.struct("at", "event_id", "doc_id", "event_type", "query_text")
    sessions = events.withWatermark("ts", late).groupBy("query_id", F.session_window("ts", gap)).agg(F.sort_array(F.collect_list(item)).alias("e"))
    return feedback.triples_of(sessions, n).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def running_counts(events: DataFrame, ts_col: str, label: str, *, window: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """Events by label in tumbling windows; windows close ``late`` after their end."""
    return (
        events.withWatermark(ts_col, late)
        .groupBy(F.window(ts_col, window).alias("w"), label)
        .count()
        .select(F.col("w.start").alias("start"), label, F.col("count").alias("n"))
    )

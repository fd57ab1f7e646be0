"""Batch job: answers a set of queries over a document table by several strategies.

    python jobs/retrieval_run.py DOCUMENTS QUERIES OUT [--config jobs/retrieval_run.json]

DOCUMENTS and QUERIES are Parquet tables with ``doc_id, text`` and ``item_id, text``.
The result at OUT is a table partitioned by strategy, with the ``k`` best documents of
every query, their language, and whether the baseline strategy has them too, which is
what a change of strategy or encoder is judged by before it goes live. The index is
built once for all strategies. A run replaces the partitions of the strategies that it
runs and leaves others; run again over the same tables it writes the same rows.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    from jobs import common
except ModuleNotFoundError:  # run as a file
    import common

from tarn.operators import bm25, fuse, search
from tarn.runtime import materialise, release, spread, written

log = logging.getLogger("retrieval_run")
DEFAULTS = {"k": 10, "dim": 64, "strategies": ["dense", "sparse", "hybrid"], "baseline": "sparse"}
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
SCHEMA = "query_id long, rank int, doc_id long, score double, lang string, in_baseline boolean, strategy string"


def run(spark: SparkSession, documents: str, queries: str, out: str, config: str | None = None) -> dict[str, int]:
    """Rows written, by strategy. The tables are read whole; intermediates are deleted at the end."""
    chosen = common.settings(spark, config, DEFAULTS)
    k, strategies, baseline = chosen["k"], chosen["strategies"], chosen["baseline"]
    for s in {*strategies, baseline}:
        fuse.checked_options(k, s)
    since, batch = written(), spark.conf.get(BATCH_ROWS)
    try:
        docs = spread(spark.read.parquet(documents).select("doc_id", "text"), "doc_id")
        langs = spark.read.parquet(documents).select("doc_id", "lang")
        asked = spark.read.parquet(queries).select(F.col("item_id").alias("query_id"), "text")
        index = bm25.build(docs)
        log.info("read %d documents from %s, %d queries from %s", index.size.first()[0], documents, asked.count(), queries)
        needed = {*strategies, baseline}
        hits: dict[str, DataFrame] = {}
        if needed & {"sparse", "hybrid"}:
            hits["sparse"] = materialise(bm25.search(index, asked, k), "sparse-hits")
        if needed & {"dense", "hybrid"}:
            hits["dense"] = materialise(search.search_dense(search.encode(docs, "doc_id", dim=chosen["dim"]), asked, k, chosen["dim"]), "dense-hits")
        if "hybrid" in needed:
            hits["hybrid"] = materialise(fuse.hybrid(hits["dense"], hits["sparse"], k), "hybrid-hits")
        agreed = hits[baseline].select("query_id", "doc_id", F.lit(True).alias("agreed")).distinct()
        counts = {}
        for s in strategies:
            made = hits[s].filter(F.col("rank") < k).join(agreed, ["query_id", "doc_id"], "left").join(langs, "doc_id", "left")
            made = made.select("query_id", "rank", "doc_id", "score", "lang", F.coalesce("agreed", F.lit(False)).alias("in_baseline"), F.lit(s).alias("strategy"))
            made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("strategy").parquet(out)
            n, same = result(spark, out).filter(F.col("strategy") == s).agg(F.count("*"), F.count_if("in_baseline")).first()
            counts[s] = n
            log.info("wrote %d hits of strategy %s to %s, %d of them also by %s", n, s, out, same, baseline)
        return counts
    finally:
        spark.conf.set(BATCH_ROWS, batch)  # encoding bounds it
        release(spark, since)


def result(spark: SparkSession, out: str) -> DataFrame:
    """The table at ``out``."""
    return spark.read.schema(SCHEMA).parquet(out)


if __name__ == "__main__":
    common.command_line("retrieval_run", {"documents": "Parquet table of documents", "queries": "Parquet table of queries", "out": "folder of the result"}, run)

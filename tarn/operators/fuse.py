"""Fusion of ranked lists, and the search orchestration on top of it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.text import tokenize

RRF_K = 60
STRATEGIES = ("dense", "sparse", "hybrid")


def rrf_fuse(lists: list[DataFrame], *, k: int = RRF_K, top: int | None = None) -> DataFrame:
    """``query_id, rank, doc_id, score`` from lists with ``query_id, rank, doc_id``.

    The score sums ``1 / (k + rank + 1)`` over all places, repeats included. Ties
    keep the order of first sight: earlier list, then better place.
    """
    marked = [x.select("query_id", "rank", "doc_id", F.lit(i).alias("list")) for i, x in enumerate(lists)]
    summed = (
        reduce(DataFrame.unionByName, marked)
        .groupBy("query_id", "doc_id")
        .agg(F.sum(1.0 / (F.lit(k) + F.col("rank") + 1)).alias("score"), F.min(F.struct("list", "rank")).alias("seen"))
    )
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "seen")
    ranked = summed.withColumn("place", F.row_number().over(order))
    if top is not None:
        ranked = ranked.filter(F.col("place") <= top)
    return ranked.select("query_id", (F.col("place") - 1).alias("rank"), "doc_id", "score")


def fetch_size(k: int, rerank: bool) -> int:
    """How many candidates each retriever gives."""
    return max(5 * k, 50) if rerank else k


def fallback(first: DataFrame, second: DataFrame) -> DataFrame:
    """Per query the first list, or the second where the first has no hits."""
    return first.unionByName(second.join(first.select("query_id").distinct(), "query_id", "left_anti"))


def hybrid(dense: DataFrame, sparse: DataFrame, fetch: int) -> DataFrame:
    """RRF where a query has hits in both lists, else the raw hits of the one it has."""
    both = dense.select("query_id").distinct().join(sparse.select("query_id").distinct(), "query_id")
    fused = rrf_fuse([x.join(both, "query_id", "left_semi") for x in (dense, sparse)], top=fetch)
    return fallback(fused, fallback(dense, sparse))


def lexical_score(query, text):
    """Share of the query's distinct terms that the text has."""
    q, t = F.array_distinct(tokenize(query)), F.array_distinct(tokenize(text))
    n = F.size(q)
    return F.when(n > 0, F.size(F.array_intersect(q, t)) / n).otherwise(0.0)


def rerank(candidates: DataFrame, queries: DataFrame, documents: DataFrame, *, top: int | None = None, scorer=lexical_score) -> DataFrame:
    """Orders ``query_id, rank, doc_id`` anew by a score of (query text, document text).

    A document without a text is scored as an empty one; ties keep the given order.
    """
    asked = queries.select("query_id", F.col("text").alias("query_text"))
    texts = documents.select("doc_id", F.col("text").alias("doc_text"))
    scored = (
        candidates.join(asked, "query_id")
        .join(texts, "doc_id", "left")
        .withColumn("score", scorer(F.col("query_text"), F.coalesce("doc_text", F.lit(""))))
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    ranked = scored.withColumn("place", F.row_number().over(order))
    if top is not None:
        ranked = ranked.filter(F.col("place") <= top)
    return ranked.select("query_id", (F.col("place") - 1).alias("rank"), "doc_id", "score")


def checked_options(k: int, strategy: str) -> None:
    if not 1 <= k <= 100:
        raise ValueError("k must be from 1 to 100")
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")


@dataclass(frozen=True)
class Request:
    """A validated search request."""

    query: str
    k: int = 10
    strategy: str = "hybrid"
    rerank: bool = True

    def __post_init__(self):
        if not 1 <= len(self.query) <= 1024:
            raise ValueError("query must have 1 to 1024 characters")
        checked_options(self.k, self.strategy)

"""Keyed stores as tables: embedding cache, document store, result cache, index ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.runtime import materialise


def keep_last(rows: DataFrame, keys: list[str], version: Column) -> DataFrame:
    """The row of the highest version of each key."""
    order = Window.partitionBy(*keys).orderBy(version.desc())
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace stored rows of the same key.

    ``new`` must have one row a key; the stored rows are found by an anti-join.
    """
    return stored.join(new.select(*keys), keys, "left_anti").unionByName(new)


def keep_first(stored: DataFrame, new: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Rows whose key is stored already change nothing; of new ones the first counts."""
    first = keep_last(new, keys, -order)
    return stored.unionByName(first.join(stored.select(*keys), keys, "left_anti"))


def embedding_lookup(keys: DataFrame, cache: DataFrame, dim: int) -> DataFrame:
    """``key, hit``: distinct asked keys, and whether a vector of ``dim`` is cached."""
    cached = cache.filter(F.col("dim") == dim).select("key", F.lit(True).alias("found"))
    return keys.select("key").distinct().join(cached, "key", "left").select("key", F.coalesce("found", F.lit(False)).alias("hit"))


def embed_cached(texts: DataFrame, cache: DataFrame, encode, dim: int, *, use_cache: bool = True) -> tuple[DataFrame, DataFrame]:
    """Vectors of ``texts`` (key, text), and the cache with what was missing.

    The first table has a row ``key, vector, hit`` for each distinct key: vectors of
    ``dim`` numbers come from ``cache`` (key, vector, dim), the others from
    ``encode`` (rows of ``key, text`` to rows of ``key, vector``), which sees the
    missing texts only, and each once. The second is the cache after them: a new
    vector replaces a stored one of the same key. Without ``use_cache`` everything is
    encoded and the cache stays as it is.
    """
    asked = texts.select("key", "text").dropDuplicates(["key"])
    cached = cache.filter(F.col("dim") == dim).select("key", "vector")
    missing = asked.join(cached.select("key"), "key", "left_anti") if use_cache else asked
    # Encoding is the dear part: written, as both results read it.
    made = materialise(encode(missing).select("key", "vector"), "encoded")
    if not use_cache:
        return made.withColumn("hit", F.lit(False)), cache
    found = asked.select("key").join(cached, "key").withColumn("hit", F.lit(True))
    return found.unionByName(made.withColumn("hit", F.lit(False))), upsert(cache, made.withColumn("dim", F.lit(dim)).select(*cache.columns), ["key"])


def text_lookup(candidates: DataFrame, store: DataFrame) -> DataFrame:
    """Candidates with their text, empty where the store has none."""
    return candidates.join(store.select("chunk_id", "text"), "chunk_id", "left").withColumn("text", F.coalesce("text", F.lit("")))


def live(cache: DataFrame, now: Column, ttl_seconds: int = 3600) -> DataFrame:
    """Entries that have not expired: stored less than ``ttl_seconds`` ago."""
    return cache.filter(F.col("ts") + F.make_dt_interval(secs=F.lit(ttl_seconds)) > now)

"""The search engine over a document table: build, search, ingest, save, load."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions.text import classify_intent, hashing_vector, normalize_query
from tarn.operators import bm25, fuse, stores
from tarn.operators.chunk import chunk_documents
from tarn.operators.feedback import validated
from tarn.operators.index import BACKENDS, DenseIndex, FlatIndex, build_index, load_index
from tarn.runtime import delete, last_written, materialise, release, text_batches, written


@dataclass(frozen=True)
class Settings:
    dim: int = 64
    max_tokens: int = 512
    overlap_tokens: int = 32
    backend: str = "flat"  # flat, hnsw or ivf
    cache_ttl: int = 3600

    def __post_init__(self):
        if self.backend not in BACKENDS:
            raise ValueError(f"backend must be one of {sorted(BACKENDS)}")


def encode(rows: DataFrame, id_col: str, text_col: str = "text", dim: int = 64) -> DataFrame:
    """``id_col, vector`` by the hashing encoder."""
    return text_batches(rows).select(id_col, hashing_vector(F.coalesce(F.col(text_col), F.lit("")), dim).alias("vector"))


def search_dense(vectors: DataFrame | DenseIndex, queries: DataFrame, k: int, dim: int = 64) -> DataFrame:
    """Hits of an index, or of a table of vectors. Queries without any token have no
    direction and score zero everywhere."""
    index = FlatIndex(vectors) if isinstance(vectors, DataFrame) else vectors
    return index.search(encode(queries, "query_id", dim=dim), k)


def valid(rows: DataFrame, column: str, least: int, most: int | None, what: str) -> DataFrame:
    """Fails the query on a text that is null or of another length than allowed."""
    n = F.length(F.col(column).cast("string"))
    ok = (n >= least) if most is None else n.between(least, most)
    told = f"{what} must have {least} {'or more' if most is None else f'to {most}'} characters"
    return rows.filter(F.when(F.coalesce(ok, F.lit(False)), True).otherwise(F.raise_error(F.lit(told)).cast("boolean")))


def search(vectors: DataFrame | DenseIndex | None, index: bm25.Bm25Index | None, queries: DataFrame, *, k: int = 10, strategy: str = "hybrid", rerank: bool = True, documents: DataFrame | None = None, reranker=None, dim: int = 64, timings: dict | None = None) -> DataFrame:
    """``query_id, rank, doc_id, score`` for a batch of queries (query_id, text).

    With ``rerank`` each retriever gives ``max(5k, 50)`` candidates, also where
    there is no reranker; the lists are fused where both have hits, else the one
    with hits passes on raw; then the reranker, if any, or the order so far cuts
    to ``k``. A strategy without its index has no hits. ``timings`` gets the milliseconds
    of each stage that ran (``dense``, ``sparse``, ``fuse``, ``rerank``); each is then
    written when it is done.
    """

    def stage(name: str, df: DataFrame, write: bool = False) -> DataFrame:
        if timings is None:
            return materialise(df, f"{name}-hits") if write else df
        began = time.perf_counter()
        df = materialise(df, f"{name}-hits")
        timings[name] = 1000 * (time.perf_counter() - began)
        return df

    if vectors is None and index is None:
        raise RuntimeError("no index is loaded")
    fuse.checked_options(k, strategy)
    fetch = fuse.fetch_size(k, rerank)
    empty = queries.sparkSession.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    both = strategy == "hybrid"  # fusing reads each list several times: a list is a few rows per query
    by_vector = stage("dense", search_dense(vectors, queries, fetch, dim), both) if vectors is not None and strategy != "sparse" else empty
    by_term = stage("sparse", bm25.search(index, queries, fetch), both) if index is not None and strategy != "dense" else empty
    if both:
        hits = stage("fuse", fuse.hybrid(by_vector, by_term, fetch))
    else:
        hits = by_vector if strategy == "dense" else by_term
    if rerank and reranker is not None and documents is not None:
        return stage("rerank", fuse.rerank(hits, queries, documents, top=k, scorer=reranker))
    return hits.filter(F.col("rank") < k)


@dataclass(frozen=True)
class Answered:
    """What was found with some options: a row for each text and hit, and one without a hit for each text."""

    hits: DataFrame  # text_key, expires, rank, doc_id, score
    path: str


@dataclass
class Engine:
    """Handles to the tables of an index; every method works on batches."""

    settings: Settings = field(default_factory=Settings)
    documents: DataFrame | None = None
    vectors: DenseIndex | None = None
    terms: bm25.Bm25Index | None = None
    reranker: object = None
    _cache: dict[tuple, Answered] = field(default_factory=dict)

    @classmethod
    def build(cls, documents: DataFrame, settings: Settings = Settings(), **parts) -> Engine:
        """Chunks, encodes and indexes ``documents`` (doc_id, text). Ids of the
        index are numbers of chunks; ``chunk_id`` stays in the document table."""
        stored = stored_chunks(documents, settings)
        return cls(settings, stored, build_index(settings.backend, encode(stored, "doc_id", dim=settings.dim)), bm25.build(stored), **parts)

    def search(self, queries: DataFrame, *, k: int = 10, strategy: str = "hybrid", rerank: bool = True) -> dict:
        """``hits`` with the raw query, ``intents`` by the normalised one, timings and cache flags.

        Queries have 1 to 1,024 characters. Hits are kept by normalised text and
        options for ``cache_ttl`` seconds: a text that was asked before, under
        whatever id, is answered from there (``cached`` tells which), and the others
        are searched once each. ``cache_hit`` is true if nothing was searched. There is
        one table of kept answers for each set of options: each search that finds
        something new writes it anew without what has run out, and deletes the one
        before and its own intermediates. ``timings_ms`` has the stages that ran, and ``total``.
        """
        fuse.checked_options(k, strategy)
        began = time.perf_counter()
        spark, since = queries.sparkSession, written()
        now, options, timings = time.time(), (k, strategy, rerank), {}
        asked = valid(queries.select("query_id", "text"), "text", 1, 1024, "a query")
        asked = materialise(asked.withColumn("text_key", normalize_query("text")), "asked")
        before = self._cache.get(options)
        none = spark.createDataFrame([], "text_key string, expires double, rank int, doc_id long, score double")
        kept = before.hits.filter(F.col("expires") > now) if before else none
        known = materialise(kept.select("text_key").distinct().join(asked, "text_key", "left_semi"), "known")
        new = asked.join(known, "text_key", "left_anti").groupBy("text_key").agg(F.min_by("text", "query_id").alias("text"), F.min("query_id").alias("query_id"))
        new = materialise(new, "new-texts")
        searched = new.count()
        if searched:
            found = search(self.vectors, self.terms, new.select("query_id", "text"), k=k, strategy=strategy, rerank=rerank, documents=self.documents, reranker=self.reranker, dim=self.settings.dim, timings=timings)
            found = new.select("query_id", "text_key").join(found, "query_id", "left").withColumn("expires", F.lit(now + self.settings.cache_ttl))
            kept = materialise(kept.unionByName(found.select("text_key", "expires", "rank", "doc_id", "score")), "answers")
            answers = last_written()
        hits = asked.join(kept.filter("doc_id is not null"), "text_key").select("query_id", "rank", "doc_id", "score")
        flags = asked.join(known.withColumn("cache_hit", F.lit(True)), "text_key", "left").select("query_id", F.coalesce("cache_hit", F.lit(False)).alias("cache_hit"), classify_intent(F.col("text_key")).alias("intent"))
        # What the result reads is of this search alone, and written last.
        hits, flags = materialise(hits, "hits"), materialise(flags, "asked-flags")
        stays = searched and self.settings.cache_ttl
        release(spark, since, keep=2, but=answers if stays else "")
        if stays:
            self._cache[options] = Answered(kept, answers)
            if before:
                delete(spark, before.path)
        return {
            "search_id": str(uuid.uuid4()),
            "hits": hits,
            "intents": flags.select("query_id", "intent"),
            "cached": flags.select("query_id", "cache_hit"),
            "timings_ms": timings | {"total": 1000 * (time.perf_counter() - began)},
            "cache_hit": not searched,
        }

    def ingest(self, documents: DataFrame, mode: str = "append") -> Engine:
        """An engine with more documents. ``append`` keeps the first vector of a
        chunk and replaces its text; ``replace`` first drops what the documents had.
        Ids have 1 to 256 characters, texts at least one."""
        if self.vectors is None:
            raise RuntimeError("no dense index is loaded")
        if mode not in ("append", "replace"):
            raise ValueError("mode must be append or replace")
        documents = materialise(valid(valid(documents.select("doc_id", "text"), "doc_id", 1, 256, "an id"), "text", 1, None, "a text"), "arrived")
        new = materialise(stored_chunks(documents, self.settings).dropDuplicates(["doc_id"]), "new-chunks")
        old = self.documents
        if mode == "replace":
            old = old.join(documents.select(F.col("doc_id").alias("parent")), "parent", "left_anti").select(*self.documents.columns)
        stored = materialise(stores.upsert(old, new, ["doc_id"]), "documents")
        if mode == "replace":
            # What the documents had is gone from the index, so it is built anew.
            vectors = build_index(self.settings.backend, encode(stored, "doc_id", dim=self.settings.dim))
        else:
            vectors = self.vectors.add(encode(new.join(self.documents, "doc_id", "left_anti"), "doc_id", dim=self.settings.dim))
        gone = self.documents.join(stored.select("doc_id"), "doc_id", "left_anti").select("doc_id") if mode == "replace" else None
        return replace(self, documents=stored, vectors=vectors, terms=bm25.grow(self.terms, new, gone=gone), _cache={})

    def feedback(self, events: DataFrame, path: str) -> int:
        """Appends valid events to the table at ``path``; their number."""
        made = materialise(validated(events), "feedback")
        made.write.mode("append").parquet(path)
        return made.count()

    def health(self) -> dict:
        return {"status": "ok", "dense": self.vectors is not None, "sparse": self.terms is not None, "size": self.vectors.size() if self.vectors is not None else 0}

    def save(self, path: str) -> None:
        """Parquet tables and manifests under ``path``."""
        spark = self.documents.sparkSession
        self.documents.write.mode("overwrite").parquet(f"{path}/documents")
        self.vectors.save(f"{path}/dense")
        self.terms.postings.write.mode("overwrite").parquet(f"{path}/postings")
        self.terms.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
        self.terms.terms.write.mode("overwrite").parquet(f"{path}/terms")
        spark.createDataFrame([(json.dumps(self.settings.__dict__),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")

    @classmethod
    def load(cls, spark: SparkSession, path: str, **parts) -> Engine:
        """What ``save`` wrote; the dense index is of the kind that its manifest names."""
        kept = json.loads(spark.read.text(f"{path}/manifest").first()[0])
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        return cls(Settings(**kept), read("documents"), load_index(spark, f"{path}/dense"), bm25.Bm25Index(read("postings"), read("lengths"), read("terms")), **parts)


def stored_chunks(documents: DataFrame, settings: Settings) -> DataFrame:
    """``doc_id, chunk_id, parent, text``: chunks by number, one row for each chunk."""
    chunked = chunk_documents(documents, settings.max_tokens, settings.overlap_tokens)
    return chunked.select(F.xxhash64("chunk_id").alias("doc_id"), "chunk_id", F.col("doc_id").alias("parent"), "text")

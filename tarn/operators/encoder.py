"""An encoder learnt from the corpus, and models that a Python worker loads once.

Tokens fall into buckets by hash; a document is its weighted bucket counts, and the
encoder projects it on the leading right singular vectors of all documents' rows. The
singular vectors are found by subspace iteration: each pass multiplies the rows of a
partition with the subspace where they lie, and the partial products, whose size depends
on the parameters alone, are added up in a tree.
"""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions.text import run_once, tokenize
from tarn.runtime import materialise, text_batches


def once_a_worker(load: Callable[[], object]) -> Callable[[], object]:
    """A function for use in Python workers that gives what ``load`` gives, called at first use and once in each worker.

    ``load`` is shipped with the job and may read what was shipped with it: files added to
    the session (``SparkFiles.get``) or the value of a broadcast. The loaded object lives
    as long as its worker, through all tasks that the worker takes; a worker that is
    lost takes it along, and another loads its own. A failed load is tried again by the
    next task.
    """
    name = uuid.uuid4().hex

    def get():
        # Functions come to each task as new copies; what a worker keeps has to hang on the process.
        kept = sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker")).__dict__
        if name not in kept:
            kept[name] = load()
        return kept[name]

    return get


def buckets_of(text: Column, buckets: int) -> Column:
    """The bucket of each token; null has none."""
    return F.transform(tokenize(F.coalesce(text, F.lit(""))), lambda t: F.pmod(F.xxhash64(t), F.lit(buckets)).cast("int"))


def _rows_of(idf: np.ndarray, most: int = 40_000):
    """A function that cuts bucket lists into pieces of about ``most`` entries of the weighted, normalised sparse rows.

    It yields ``first, n, row, bucket, weight``; the rows are numbered from 0 in each piece.
    """
    size = len(idf)

    def pieces(lists: pa.ListArray):
        offsets = lists.offsets.to_numpy()
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = offsets - offsets[0]
        first = 0
        while first < len(offsets) - 1:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
            n = last - first
            row = np.repeat(np.arange(n), np.diff(offsets[first : last + 1]))
            key, tf = np.unique(row * size + flat[offsets[first] : offsets[last]], return_counts=True)
            row, bucket = key // size, key % size
            weight = (1.0 + np.log(tf)) * idf[bucket]
            length = np.sqrt(np.bincount(row, weight * weight, minlength=n))
            yield first, n, row, bucket, weight / length[row]
            first = last

    return pieces


def _projector():
    """A function for the product of sparse rows, sorted by row, with a matrix."""

    def project(n, row, bucket, weight, matrix):
        out = np.zeros((n, matrix.shape[1]))
        if len(row):
            start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            out[row[start]] = np.add.reduceat(weight[:, None] * matrix[bucket], start, axis=0)
        return out

    return project


@dataclass(frozen=True)
class Encoder:
    """Weights of the buckets (``idf``), their directions (``buckets`` by ``dim``), and the singular values."""

    idf: np.ndarray
    directions: np.ndarray
    singular: np.ndarray

    def encode(self, rows: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
        """``id_col, vector``: vectors of length one, zeros where a text has no token. A worker loads the model once."""
        sent = rows.sparkSession.sparkContext.broadcast((self.idf, self.directions))
        model = once_a_worker(lambda: sent.value)
        cut, project = _rows_of, _projector()
        pieces_of, dim = cut(self.idf), self.directions.shape[1]

        def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            _, directions = model()
            for lists in batches:
                found = np.zeros((len(lists), dim))
                for first, n, row, bucket, weight in pieces_of(lists):
                    found[first : first + n] = project(n, row, bucket, weight, directions)
                length = np.sqrt((found * found).sum(axis=1, keepdims=True))
                found /= np.where(length > 0, length, 1.0)
                yield pa.ListArray.from_arrays(np.arange(len(lists) + 1, dtype=np.int32) * dim, found.ravel())

        vector = run_once(F.arrow_udf(vectors, T.ArrayType(T.DoubleType())))
        return text_batches(rows).select(id_col, vector(buckets_of(F.col(text_col), len(self.idf))).alias("vector"))

    def save(self, spark: SparkSession, path: str) -> None:
        """A row for each bucket, and one with the singular values."""
        rows = [(i, float(w), v.tolist()) for i, (w, v) in enumerate(zip(self.idf, self.directions))] + [(-1, 0.0, self.singular.tolist())]
        spark.createDataFrame(rows, "bucket int, idf double, direction array<double>").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Encoder:
        rows = spark.read.parquet(path).orderBy("bucket").collect()
        return Encoder(np.array([r.idf for r in rows[1:]]), np.array([r.direction for r in rows[1:]]), np.array(rows[0].direction))


def fit(texts: DataFrame, text_col: str = "text", *, dim: int = 64, buckets: int = 4096, passes: int = 3, spare: int = 16, seed: int = 17) -> Encoder:
    """An encoder of ``dim`` numbers from all ``texts``.

    The weight of a bucket is its inverse document frequency over all texts. ``passes``
    over the rows turn a random subspace of ``dim + spare`` directions towards the
    leading ones; the driver and each task hold ``buckets`` times that many numbers, however many
    texts there are. Null texts and texts without a token count as documents and turn
    nothing; of an empty table the directions are random. Repeated rows count each.
    """
    rows = materialise(texts.select(buckets_of(F.col(text_col), buckets).alias("b")), "buckets")
    n = rows.count()
    idf = np.full(buckets, np.log(n + 1.0) + 1.0)
    for r in rows.select(F.explode(F.array_distinct("b")).alias("b")).groupBy("b").count().collect():
        idf[r.b] = np.log((n + 1.0) / (r["count"] + 1.0)) + 1.0
    width = min(buckets, dim + spare)
    basis, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(buckets, width)))
    product = np.zeros((buckets, width))
    for _ in range(passes):
        product = _gram_times(rows, idf, basis)
        spanned, _ = np.linalg.qr(product) if product.any() else (basis, None)
        last, basis = basis, spanned
    # Rayleigh-Ritz on the last subspace whose product is known.
    value, inner = np.linalg.eigh((small := last.T @ product) / 2 + small.T / 2)
    order = np.argsort(-value)[:dim]
    return Encoder(idf, last @ inner[:, order], np.sqrt(np.maximum(value[order], 0.0)))


def _gram_times(rows: DataFrame, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Of the matrix of all rows, its transpose times itself times ``basis``."""
    sent = rows.sparkSession.sparkContext.broadcast(basis)
    pieces_of, project, shape = _rows_of(idf), _projector(), basis.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, total = sent.value, np.zeros(shape)
        for batch in batches:
            for _, n, row, bucket, weight in pieces_of(batch.column(0)):
                if len(row):
                    order = np.argsort(bucket, kind="stable")
                    there = project(n, row, bucket, weight, matrix)
                    total += project(shape[0], bucket[order], row[order], weight[order], there)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    parts = rows.mapInArrow(partial, "part binary").rdd.map(lambda r: np.frombuffer(bytes(r[0])))
    return parts.treeReduce(lambda a, b: a + b).reshape(shape) if parts.getNumPartitions() else np.zeros(shape)

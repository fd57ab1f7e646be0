"""Dense indexes behind one interface: ``add``, ``search``, ``size``, ``save``; by name from ``build_index`` and ``load_index``."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators import dense


class DenseIndex(Protocol):
    """Vectors are ``doc_id, vector``, queries ``query_id, vector``, hits ``query_id, rank, doc_id, score``."""

    def add(self, vectors: DataFrame) -> DenseIndex: ...

    def search(self, queries: DataFrame, k: int) -> DataFrame: ...

    def size(self) -> int: ...

    def save(self, path: str) -> None: ...


def _new(vectors: DataFrame, stored: DataFrame) -> DataFrame:
    """One row for each id that is not stored; an id that is stored keeps its vector."""
    first = vectors.select("doc_id", "vector").dropDuplicates(["doc_id"])
    return first.join(stored.select("doc_id"), "doc_id", "left_anti")


@dataclass(frozen=True)
class FlatIndex:
    """Exact. Ids may repeat: each row is a document."""

    vectors: DataFrame
    kind = "flat"

    @classmethod
    def build(cls, vectors: DataFrame) -> FlatIndex:
        return cls(vectors.select("doc_id", "vector"))

    def add(self, vectors: DataFrame) -> FlatIndex:
        return FlatIndex(self.vectors.unionByName(vectors.select("doc_id", "vector")))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return dense.flat_search(queries, self.vectors, k)

    def size(self) -> int:
        return self.vectors.count()

    def save(self, path: str) -> None:
        self.vectors.write.mode("overwrite").parquet(f"{path}/vectors")
        _manifest(self.vectors.sparkSession, path, self.kind, {})

    @classmethod
    def load(cls, spark: SparkSession, path: str, parameters: dict) -> FlatIndex:
        return cls(spark.read.parquet(f"{path}/vectors"))


@dataclass(frozen=True)
class HnswIndex:
    """Graphs over shards of bounded size. An id keeps its first vector. New vectors are
    inserted into the graphs of the shards they fall on, as long as these have room, and
    make new shards after that."""

    graph: DataFrame
    parameters: dict = field(default_factory=dict)
    kind = "hnsw"

    @classmethod
    def build(cls, vectors: DataFrame, **parameters: int) -> HnswIndex:
        making = {p: n for p, n in parameters.items() if p != "ef_search"}
        return cls(dense.materialise(dense.hnsw_build(vectors, **making), "graph", max_records=1), parameters)

    def add(self, vectors: DataFrame) -> HnswIndex:
        making = {p: n for p, n in self.parameters.items() if p != "ef_search"}
        new = dense.materialise(_new(vectors.filter("vector is not null"), dense.hnsw_ids(self.graph)), "new-vectors")
        # A row for each shard.
        sizes = {r.shard: r.n for r in self.graph.select("shard", "n").collect()}
        shard_rows = making.pop("shard_rows", 20_000)
        open_ = sorted(s for s, n in sizes.items() if n < shard_rows)
        arriving = new.count()
        if not arriving:
            return self
        if open_ and arriving <= sum(shard_rows - sizes[s] for s in open_):
            grown, kept = dense.hnsw_insert(self.graph, new, open_, **making)
        else:
            grown, kept = dense.hnsw_build(new, shard_rows=shard_rows, first_shard=max(sizes, default=-1) + 1, **making), self.graph
        return replace(self, graph=kept.unionByName(dense.materialise(grown, "graph", max_records=1)))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return dense.hnsw_search(self.graph, queries, k, **{p: n for p, n in self.parameters.items() if p == "ef_search"})

    def size(self) -> int:
        return self.graph.agg(F.sum("n")).first()[0] or 0

    def save(self, path: str) -> None:
        self.graph.write.mode("overwrite").option("maxRecordsPerFile", 1).parquet(f"{path}/graph")
        _manifest(self.graph.sparkSession, path, self.kind, self.parameters)

    @classmethod
    def load(cls, spark: SparkSession, path: str, parameters: dict) -> HnswIndex:
        return cls(spark.read.parquet(f"{path}/graph"), parameters)


@dataclass(frozen=True)
class IvfIndex:
    """Cells around trained centres; a query reads the cells nearest to it."""

    cells: DataFrame
    centers: list
    n_probe: int = 8
    kind = "ivf"

    @classmethod
    def build(cls, vectors: DataFrame, *, n_cells: int = 64, n_probe: int = 8, **training: int) -> IvfIndex:
        centers = dense.ivf_train(vectors, n_cells, **training)
        return cls(dense.materialise(dense.ivf_cells(vectors, centers), "cells"), centers, n_probe)

    def add(self, vectors: DataFrame) -> IvfIndex:
        return replace(self, cells=self.cells.unionByName(dense.ivf_cells(vectors, self.centers)))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return dense.ivf_search(queries, self.cells, self.centers, k, n_probe=self.n_probe)

    def size(self) -> int:
        return self.cells.count()

    def save(self, path: str) -> None:
        dense.ivf_save(self.cells, self.centers, path)
        _manifest(self.cells.sparkSession, path, self.kind, {"n_probe": self.n_probe})

    @classmethod
    def load(cls, spark: SparkSession, path: str, parameters: dict) -> IvfIndex:
        return cls(*dense.ivf_load(spark, path), **parameters)


BACKENDS = {c.kind: c for c in (FlatIndex, HnswIndex, IvfIndex)}


def _backend(kind: str):
    if kind not in BACKENDS:
        raise ValueError(f"unknown index kind {kind}: one of {sorted(BACKENDS)}")
    return BACKENDS[kind]


def _manifest(spark: SparkSession, path: str, kind: str, parameters: dict) -> None:
    row = json.dumps({"kind": kind, "parameters": parameters})
    spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def build_index(backend: str, vectors: DataFrame, **parameters: int) -> DenseIndex:
    return _backend(backend).build(vectors, **parameters)


def load_index(spark: SparkSession, path: str) -> DenseIndex:
    """The index that was saved at ``path``, of the kind that its manifest names."""
    kept = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    return _backend(kept["kind"]).load(spark, path, kept["parameters"])

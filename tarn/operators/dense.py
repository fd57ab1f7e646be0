"""Exact and approximate nearest neighbours by inner product, batched over queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.operators.graph import NONE, Graph
from tarn.runtime import materialise

HITS = "query_id long, doc_id long, score double"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    # The limit is on the bare row number, so that it also holds before the exchange.
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select("query_id", (F.col("place") - 1).alias("rank"), "doc_id", "score")


def checked(vectors: DataFrame, dim: int) -> DataFrame:
    """Rows without a vector leave; a vector of another length fails the query."""
    vector = F.col("vector")
    fail = F.raise_error(F.concat(F.lit("a vector of "), F.size(vector).cast("string"), F.lit(f" in an index of {dim}")))
    return vectors.filter(vector.isNotNull()).withColumn("vector", F.when(F.size(vector) == dim, vector).otherwise(fail.cast(vectors.schema["vector"].dataType)))


def query_blocks(queries: DataFrame, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of at most about ``block`` queries at a time; queries without a vector ask nothing."""
    queries = queries.filter("vector is not null")
    n = queries.count()
    blocks = max(1, -(-n // block))
    if blocks > 1:
        queries = materialise(queries, "query-vectors")  # what gives the vectors runs once
    for b in range(blocks):
        part = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        rows = part.collect()
        if len({len(r.vector) for r in rows}) > 1:
            raise ValueError("query vectors of several lengths")
        if rows:
            yield np.array([r.query_id for r in rows], dtype=np.int64), np.array([r.vector for r in rows], dtype=np.float64)


class Best:
    """The ``k`` best documents of each query so far. Scores are compared to nine
    digits; ties go to the smaller id."""

    def __init__(self, queries: int, k: int, ids: type = np.int64):
        self.k = k
        self.query, self.doc, self.score = np.empty(0, dtype=np.int64), np.empty(0, dtype=ids), np.empty(0)
        self.least = np.full(queries, -np.inf)

    def offer(self, at: np.ndarray, docs: np.ndarray, scores: np.ndarray, slack: float = 1e-9, exact=None) -> None:
        """Scores of the queries at places ``at`` (rows) with ``docs`` (columns).

        Only scores that can be among the best are rounded and sorted. With ``exact``, a
        function of rows and columns, ``scores`` are within ``slack`` of what it gives.
        """
        floor = self.least[at]
        if scores.shape[1] > self.k and not np.isfinite(floor).all():
            finite = np.where(np.isfinite(scores), scores, -np.inf)
            floor = np.maximum(floor, np.partition(finite, -self.k, axis=1)[:, -self.k] - slack)
        # A score and its rounded value are less than 1e-9 apart.
        i, j = np.nonzero(scores >= (floor - slack - 1e-9).astype(scores.dtype)[:, None])
        found = np.concatenate([np.empty(0), *(exact(i[a : a + 50_000], j[a : a + 50_000]) for a in range(0, len(i), 50_000))]) if exact else scores[i, j]
        some = np.isfinite(found) & (np.round(found, 9) >= self.least[at[i]])
        if not some.any():
            return
        i, j, found = i[some], j[some], found[some]
        query, doc, score = (np.concatenate(x) for x in ((self.query, at[i]), (self.doc, docs[j]), (self.score, found)))
        order = np.lexsort((doc, -np.round(score, 9), query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        order, last = order[place < self.k], order[place == self.k - 1]
        self.least[query[place == self.k - 1]] = np.round(score[last], 9)
        self.query, self.doc, self.score = query[place < self.k], doc[order], score[order]

    def rows(self, ids: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids[self.query]), pa.array(self.doc), pa.array(self.score)], ["query_id", "doc_id", "score"])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), dim)


def flat_search(queries: DataFrame, vectors: DataFrame, k: int = 10, *, block_queries: int = 4096, exclude_self: bool = False) -> DataFrame:
    """``query_id, rank, doc_id, score`` of ``queries`` (query_id, vector) over ``vectors`` (doc_id, vector).

    Vectors stream through a matrix product with a broadcast block of queries, in
    tiles of bounded size; a partition passes on its ``k`` best per query, so the
    shuffle carries at most ``k`` rows per query and partition. Repeated ids stay
    repeated. Null vectors are no documents and no queries; a vector of another
    length than the queries' is an error.
    """
    spark = vectors.sparkSession
    found, stored = None, False
    for ids, matrix in query_blocks(queries.select("query_id", "vector"), block_queries):
        if len(ids) > block_queries // 2 and not stored:
            # There may be more blocks: what gives the vectors, as an encoder, runs once.
            vectors, stored = materialise(vectors.select("doc_id", "vector"), "searched-vectors"), True
        held = spark.sparkContext.broadcast((ids, matrix))
        part = checked(vectors.select("doc_id", "vector"), matrix.shape[1]).mapInArrow(_scorer(held, k, exclude_self), HITS)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], HITS)
    return _ranked(found, k)


def _scorer(held, k: int, exclude_self: bool, tile: int = 1_000_000):
    """Scores in single precision choose what is scored in double precision; the room left between them
    covers the rounding of both, in proportion to the lengths of the vectors."""

    def run(batches):
        ids, matrix = held.value
        best, every = Best(len(ids), k), np.arange(len(ids))
        rough = matrix.astype(np.float32)
        longest = np.sqrt((matrix * matrix).sum(axis=1)).max(initial=0.0)
        rows = max(1, tile // len(ids))
        for batch in batches:
            docs, every_m = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), _matrix(batch.column(1), matrix.shape[1])
            for a in range(0, len(docs), rows):
                m, there = every_m[a : a + rows], docs[a : a + rows]
                slack = (matrix.shape[1] + 4) * 1.2e-7 * longest * np.sqrt((m * m).sum(axis=1)).max(initial=0.0)
                if slack < 1e-3:
                    scores = rough @ m.astype(np.float32).T
                    exact = lambda i, j, m=m: np.einsum("nd,nd->n", matrix[i], m[j])
                else:
                    # Long vectors, or none that is finite: single precision would tell too little.
                    scores, slack, exact = matrix @ m.T, 1e-9, None
                if exclude_self:
                    scores[ids[:, None] == there[None, :]] = -np.inf
                best.offer(every, there, scores, slack, exact)
        yield best.rows(ids)

    return run


#: A row for each shard: its ids and vectors, and the links of all layers, as plain arrays.
GRAPH = "shard int, n int, dim int, m int, entry int, layers int, ids binary, vectors binary, links binary"
_TYPES = pa.schema([(c, pa.binary() if t == "binary" else pa.int32()) for c, t in (x.split() for x in GRAPH.split(", "))])


def _row(shard: int, graph: Graph, ids: np.ndarray) -> dict:
    links = b"".join(x.tobytes() for x in graph.links)
    return {"shard": shard, "n": len(graph), "dim": graph.dim, "m": graph.m, "entry": graph.entry, "layers": len(graph.links), "ids": ids.tobytes(), "vectors": graph.data.tobytes(), "links": links}


def _opened(row: dict, **parameters: int) -> tuple[Graph, np.ndarray]:
    """A shard's graph and the ids of its nodes."""
    graph, n, at = Graph(row["dim"], row["m"], **parameters), row["n"], 0
    graph.data = np.frombuffer(row["vectors"], dtype=np.float32).reshape(n, row["dim"])
    graph.entry = row["entry"]
    flat = np.frombuffer(row["links"], dtype=np.int32)
    for layer in range(row["layers"]):
        size = n * graph.width(layer)
        graph.links.append(flat[at : at + size].reshape(n, -1).copy())
        at += size
    return graph, np.frombuffer(row["ids"], dtype=np.int64)


def _filled(seed: int, m: int, ef_construction: int):
    """Adds a shard's new rows (shard, doc_id, vector) to its graph, or to an empty one."""

    def add(rows: pa.Table, stored: list[dict]) -> pa.Table:
        rows = rows.sort_by("doc_id")
        shard = rows.column("shard")[0].as_py()
        vectors = rows.column("vector").combine_chunks()
        sizes = np.unique(vectors.value_lengths().to_numpy())
        if stored:
            graph, ids = _opened(stored[0], ef_construction=ef_construction, seed=seed + shard)
        else:
            graph, ids = Graph(int(sizes[0]), m, ef_construction, seed + shard), np.zeros(0, dtype=np.int64)
        if sizes.tolist() != [graph.dim]:
            raise ValueError(f"a vector of {sizes[sizes != graph.dim][0]} in an index of {graph.dim}")
        new, first = np.unique(rows.column("doc_id").to_numpy(), return_index=True)  # an id counts once
        graph.add(_matrix(vectors, graph.dim)[first])
        return pa.Table.from_pylist([_row(shard, graph, np.concatenate([ids, new]))], schema=_TYPES)

    return add


def hnsw_build(vectors: DataFrame, *, shard_rows: int = 20_000, seed: int = 0, first_shard: int = 0, m: int = 16, ef_construction: int = 200) -> DataFrame:
    """Graphs of all vectors, one per shard of bounded size, a row each. A null vector is no document."""
    vectors = vectors.filter("vector is not null")
    shards = max(1, -(-vectors.count() // shard_rows))
    dealt = vectors.select((F.pmod(F.xxhash64("doc_id"), F.lit(shards)) + first_shard).cast("int").alias("shard"), "doc_id", F.col("vector").cast("array<double>").alias("vector"))
    add = _filled(seed, m, ef_construction)
    return dealt.groupBy("shard").applyInArrow(lambda rows: add(rows, []), GRAPH)


def hnsw_ids(graph: DataFrame) -> DataFrame:
    """``doc_id`` of all nodes."""

    def run(batches):
        for batch in batches:
            for ids in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids.as_py(), dtype=np.int64))], ["doc_id"])

    return graph.select("ids").mapInArrow(run, "doc_id long")


def hnsw_layers(graph: DataFrame) -> DataFrame:
    """``layer, nodes``: how many nodes each layer of the graphs has, those of one link or more."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                opened, _ = _opened(batch.slice(i, 1).to_pylist()[0])
                nodes = [len(opened)] + [int((x != NONE).any(axis=1).sum()) for x in opened.links[1:]]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(nodes)), pa.int32()), pa.array(nodes, pa.int64())], ["layer", "nodes"])

    return graph.mapInArrow(run, "layer int, nodes long").groupBy("layer").agg(F.sum("nodes").alias("nodes"))


def hnsw_insert(graph: DataFrame, vectors: DataFrame, shards: list[int], *, seed: int = 0, ef_construction: int = 200, m: int = 16) -> tuple[DataFrame, DataFrame]:
    """The rows of the ``shards`` that new vectors fall on, with these inserted, and the rows of the others."""
    number = F.pmod(F.xxhash64("doc_id"), F.lit(len(shards))) + 1
    dealt = vectors.filter("vector is not null").select(F.element_at(F.array(*map(F.lit, shards)), number.cast("int")).alias("shard"), "doc_id", F.col("vector").cast("array<double>").alias("vector"))
    dealt = materialise(dealt, "arrived")
    touched = F.broadcast(dealt.select("shard").distinct())  # at most a row for each shard
    add = _filled(seed, m, ef_construction)
    old = graph.join(touched, "shard", "left_semi")
    grown = dealt.groupBy("shard").cogroup(old.groupBy("shard")).applyInArrow(lambda rows, stored: add(rows, stored.to_pylist()), GRAPH)
    return grown, graph.join(touched, "shard", "left_anti")


def hnsw_search(graph: DataFrame, queries: DataFrame, k: int = 10, *, block_queries: int = 4096, ef_search: int = 100) -> DataFrame:
    """``query_id, rank, doc_id, score``: every shard is searched where it lies, the best are merged."""
    spark = graph.sparkSession
    found = None
    for ids, matrix in query_blocks(queries.select("query_id", "vector"), block_queries):
        part = graph.mapInArrow(_walker(spark.sparkContext.broadcast((ids, matrix)), k, ef_search), HITS)
        found = part if found is None else found.unionByName(part)
    return _ranked(found if found is not None else spark.createDataFrame([], HITS), k)


def _walker(held, k: int, ef_search: int):
    def run(batches):
        ids, matrix = held.value
        for batch in batches:
            for i in range(batch.num_rows):
                graph, docs = _opened(batch.slice(i, 1).to_pylist()[0])
                if graph.dim != matrix.shape[1]:
                    raise ValueError(f"a vector of {matrix.shape[1]} in an index of {graph.dim}")
                node, distance = graph.search(matrix, k, ef_search)
                q, c = np.nonzero(node != NONE)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(docs[node[q, c]]), pa.array(1.0 - distance[q, c].astype(np.float64))], ["query_id", "doc_id", "score"])

    return run


def ivf_train(vectors: DataFrame, n_cells: int, *, sample_rows: int = 10_000, seed: int = 0) -> list[list[float]]:
    """Centroids by k-means on a sample of at most about ``sample_rows`` vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = vectors.count()
    spread = 1 << 30
    sample = vectors.filter(F.pmod(F.xxhash64("doc_id"), F.lit(spread)) < min(spread, sample_rows * spread // max(n, 1)))
    features = sample.select(array_to_vector(F.transform("vector", lambda x: x.cast("double"))).alias("features"))
    return [c.tolist() for c in KMeans(k=n_cells, seed=seed, featuresCol="features").fit(features).clusterCenters()]


def nearest_cells(vector, centers: list[list[float]], n: int):
    """The ``n`` nearest cells as an array of ints, by squared distance."""

    def gap(c):
        return F.aggregate(F.zip_with(vector, F.array(*map(F.lit, c)), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)

    scored = F.array(*(F.struct(gap(c).alias("d"), F.lit(i).alias("cell")) for i, c in enumerate(centers)))
    return F.transform(F.slice(F.sort_array(scored), 1, n), lambda s: s["cell"])


def ivf_cells(vectors: DataFrame, centers: list[list[float]]) -> DataFrame:
    """``doc_id, vector, cell``: the vectors with their nearest cell."""
    return checked(vectors.select("doc_id", "vector"), len(centers[0])).withColumn("cell", nearest_cells(F.col("vector"), centers, 1)[0])


def ivf_save(cells: DataFrame, centers: list[list[float]], path: str) -> None:
    """The vectors in one folder a cell, and the centres."""
    cells.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
    rows = cells.sparkSession.createDataFrame(list(enumerate(centers)), "cell int, center array<double>")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/centers")


def ivf_load(spark, path: str) -> tuple[DataFrame, list[list[float]]]:
    return spark.read.parquet(f"{path}/cells"), [list(r.center) for r in spark.read.parquet(f"{path}/centers").orderBy("cell").collect()]


def ivf_search(queries: DataFrame, cells: DataFrame, centers: list[list[float]], k: int = 10, *, n_probe: int = 8, block_queries: int = 4096) -> DataFrame:
    """``query_id, rank, doc_id, score`` over the cells nearest to each query.

    ``cells`` is made by ``ivf_cells``. A block of queries reads the cells that some
    query of it probes, and no others: of a saved index, only their folders.
    Vectors meet the queries that probe their cell; a partition passes on its ``k``
    best per query. With all cells probed the result is the exact one.
    """
    spark = cells.sparkSession
    probing = checked(queries.select("query_id", "vector"), len(centers[0])).withColumn("cells", nearest_cells(F.col("vector"), centers, n_probe))
    blocks = max(1, -(-queries.count() // block_queries))
    found = None
    for b in range(blocks):
        rows = probing.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
        ids, matrix = np.array([r.query_id for r in rows], dtype=np.int64), np.array([r.vector for r in rows], dtype=np.float64).reshape(len(rows), len(centers[0]))
        probed = {c: np.array([i for i, r in enumerate(rows) if c in r.cells]) for c in sorted({c for r in rows for c in r.cells})}
        held = spark.sparkContext.broadcast((ids, matrix, probed))
        part = cells.filter(F.col("cell").isin(list(probed))).select("doc_id", "vector", "cell").mapInArrow(_cell_scorer(held, k), HITS)
        found = part if found is None else found.unionByName(part)
    return _ranked(found, k)


def _cell_scorer(held, k: int, tile: int = 4_000_000):
    def run(batches):
        ids, matrix, probed = held.value
        best = Best(len(ids), k)
        for batch in batches:
            docs, m = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), _matrix(batch.column(1), matrix.shape[1])
            cell = batch.column(2).to_numpy(zero_copy_only=False)
            for c in np.unique(cell):
                at, own = probed[int(c)], np.flatnonzero(cell == c)
                rows = max(1, tile // len(at))
                for a in range(0, len(own), rows):
                    some = own[a : a + rows]
                    best.offer(at, docs[some], matrix[at] @ m[some].T)
        yield best.rows(ids)

    return run

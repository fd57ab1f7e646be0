"""Exact top-k inner-product search over a paged M-tree.

Vectors are dealt to shards of bounded size, by their place, so that repeated rows
spread as others do. Every shard is bulk-loaded into an M-tree: pages with a
routing vector, a covering radius, the distance to the parent page's routing
vector, the largest norm below, and, in leaves, the entries with their distances
to the routing vector. The trees are written once, a shard's pages in one table
row, and searches read them as they lie, without an exchange.

A query visits pages best first: one, then the best two of those that wait, four and so
on, so that the queries of a block meet a page together, in a product of matrices. For a page at distance at least ``lb`` from the
query, ``<q, x> = (|q|^2 + |x|^2 - d(q, x)^2) / 2`` gives a bound on every score
below it. Before any distance to a child is computed, ``lb`` comes from the
stored parent distance alone: ``|d(q, parent) - d(child, parent)| - radius``;
leaf entries are held back in the same way. What the bounds can't discard is
computed exactly, so the result is exact.

Queries are taken in blocks of bounded size; only a block is broadcast. Each query
is first asked of one shard, and its ``k``-th score there is the bound with which
it comes to all the others. Each shard returns its ``k`` best per query that reach
the bound, and these are ranked per query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.runtime import materialise, spread

SHARDS = (
    "dim int, shard int, pages array<struct<page: int, parent: int, leaf: boolean, center: array<double>, radius: double, "
    "to_parent: double, norm2: double, ids: array<long>, entries: array<double>, to_center: array<double>>>"
)


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``vec_id, v``: components turned into ``floor(scale * x)``. Rows without an
    id, and vectors that are null or hold a null or non-finite component, leave."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    return (
        df.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))
        .filter(
            F.col("vec_id").isNotNull()
            & F.col("x").isNotNull()
            & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
        )
        .select("vec_id", F.transform("x", lambda c: F.floor(c * F.lit(float(scale))).cast("double")).alias("v"))
    )


def build_pages(ids: np.ndarray, vectors: np.ndarray, *, page_rows: int, fanout: int) -> list[dict]:
    """Bulk load: split by nearest of ``fanout`` spread-out members until a page holds the rest.

    A group that does not split (equal vectors) is cut by position.
    """
    pages: list[dict] = []
    norms = np.einsum("ij,ij->i", vectors, vectors)
    stack = [(np.arange(len(ids)), -1)]
    while stack:
        rows, parent = stack.pop()
        own = vectors[rows]
        middle = own.mean(axis=0) if len(rows) else np.zeros(vectors.shape[1])
        center = own[np.argmin(((own - middle) ** 2).sum(axis=1))] if len(rows) else middle
        to_center = np.sqrt(((own - center) ** 2).sum(axis=1))
        up = pages[parent]["center"] if parent >= 0 else center
        page = {
            "page": len(pages),
            "parent": parent,
            "leaf": len(rows) <= page_rows,
            "center": center,
            "radius": float(to_center.max(initial=0.0)),
            "to_parent": float(np.sqrt(((center - up) ** 2).sum())),
            "norm2": float(norms[rows].max(initial=0.0)),
            "ids": ids[rows] if len(rows) <= page_rows else ids[:0],
            "entries": own if len(rows) <= page_rows else vectors[:0],
            "to_center": to_center if len(rows) <= page_rows else to_center[:0],
        }
        pages.append(page)
        if page["leaf"]:
            continue
        # Farthest-first members as seeds.
        seeds, gap = [int(np.argmax(to_center))], np.full(len(rows), np.inf)
        for _ in range(min(fanout, -(-len(rows) // page_rows) + 1) - 1):
            gap = np.minimum(gap, ((own - own[seeds[-1]]) ** 2).sum(axis=1))
            if not gap.max() > 0:
                break
            seeds.append(int(np.argmax(gap)))
        near = np.argmin(((own**2).sum(axis=1)[:, None] - 2 * own @ own[seeds].T + (own[seeds] ** 2).sum(axis=1)[None, :]), axis=1)
        parts = [rows[near == s] for s in range(len(seeds))]
        if len(seeds) < 2 or max(map(len, parts)) == len(rows):
            parts = [rows[a : a + page_rows] for a in range(0, len(rows), page_rows)]
        stack += [(p, page["page"]) for p in parts if len(p)]
    return pages


class Shard:
    """A loaded tree."""

    def __init__(self, pages: list[dict]):
        pages = sorted(pages, key=lambda p: p["page"])
        self.center = np.array([p["center"] for p in pages])
        self.center2 = (self.center**2).sum(axis=1)
        self.radius = np.array([p["radius"] for p in pages])
        self.norm2 = np.array([p["norm2"] for p in pages])
        self.to_parent = np.array([p["to_parent"] for p in pages])
        self.leaf = [p["leaf"] for p in pages]
        parent = np.array([p["parent"] for p in pages])
        self.children = [np.flatnonzero(parent == p["page"]) for p in pages]
        self.ids = [np.asarray(p["ids"], dtype=np.int64) for p in pages]
        dim = self.center.shape[1]
        self.entries = [np.asarray(p["entries"], dtype=np.float64).reshape(-1, dim) for p in pages]
        self.entry2 = [(e**2).sum(axis=1) for e in self.entries]
        self.to_center = [np.asarray(p["to_center"], dtype=np.float64) for p in pages]
        self.computed = 0

    def search(self, q: np.ndarray, own: int, k: int, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """``search_all`` for one query: its ids and scores."""
        _, ids, scores = self.search_all(q[None, :], np.array([own]), k, np.array([least]))
        return ids, scores

    def search_all(self, queries: np.ndarray, own: np.ndarray, k: int, least: np.ndarray, cells: int = 2_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of queries, ids and scores: of each query the ``k`` best but its ``own`` id
        that score ``least`` or more; ties to the smaller id. Queries go in blocks of bounded size."""
        step = max(1, min(4096, cells // len(self.radius)))
        found = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0))]
        for a in range(0, len(queries), step):
            place, ids, scores = self._search_block(queries[a : a + step], own[a : a + step], k, least[a : a + step].astype(np.float64))
            found.append((place + a, ids, scores))
        place, ids, scores = (np.concatenate(x) for x in zip(*found))
        return place, ids, scores

    def _search_block(self, q: np.ndarray, own: np.ndarray, k: int, least: np.ndarray):
        q2 = np.einsum("ij,ij->i", q, q)
        slack = 1e-9 * (q2 + float(self.norm2.max(initial=0.0)) + 1)
        top_id, top = np.zeros((len(q), k), dtype=np.int64), np.full((len(q), k), -np.inf)
        # Of each query and page: the bound on its scores if the page waits for a visit, and the distance to its center.
        bound, far = np.full((len(q), len(self.radius)), -np.inf), np.zeros((len(q), len(self.radius)))
        bound[:, 0] = np.inf
        far[:, 0] = np.sqrt(np.maximum(0.0, q2 - 2 * (q @ self.center[0]) + self.center2[0]))
        self.computed += len(q)
        width = 1
        while True:
            visit = (bound > -np.inf) & (bound + slack[:, None] >= least[:, None])
            if not visit.any():
                break
            if width < bound.shape[1]:
                visit &= bound >= np.partition(bound, -width, axis=1)[:, -width][:, None]
            width *= 2
            for page in np.flatnonzero(visit.any(axis=0)):
                at = np.flatnonzero(visit[:, page])
                may = bound[at, page] + slack[at] >= least[at]  # pages before this one may have raised it
                bound[at, page] = -np.inf
                at = at[may]
                if not len(at):
                    continue
                if self.leaf[page]:
                    self._offer(page, at, q, q2, far[at, page], slack, own, least, top_id, top)
                    continue
                kids = self.children[page]
                lb = np.maximum(0.0, np.abs(far[at, page][:, None] - self.to_parent[kids]) - self.radius[kids])
                near = (q2[at, None] + self.norm2[kids] - lb * lb) * 0.5 + slack[at, None] >= least[at, None]
                self.computed += int(near.sum())
                dots = q[at] @ self.center[kids].T
                ds = np.sqrt(np.maximum(0.0, q2[at, None] - 2 * dots + self.center2[kids]))
                lb = np.maximum(0.0, ds - self.radius[kids])
                ub = np.minimum((q2[at, None] + self.norm2[kids] - lb * lb) * 0.5, dots + np.sqrt(q2[at, None]) * self.radius[kids])
                bound[np.ix_(at, kids)], far[np.ix_(at, kids)] = np.where(near, ub, -np.inf), ds
        place, column = np.nonzero(top > -np.inf)
        return place, top_id[place, column], top[place, column]

    def _offer(self, page: int, at: np.ndarray, q, q2, d, slack, own, least, top_id, top) -> None:
        """Entries of a leaf to the queries at places ``at``; changes ``least``, ``top_id`` and ``top``."""
        gap = d[:, None] - self.to_center[page]
        may = (q2[at, None] + self.entry2[page] - gap * gap) * 0.5 + slack[at, None] >= least[at, None]
        may &= self.ids[page] != own[at, None]
        self.computed += int(may.sum())
        some = np.flatnonzero(may.any(axis=0))
        scores = np.rint(q[at] @ self.entries[page][some].T)
        i, j = np.nonzero(may[:, some] & (scores >= least[at, None]))
        if not len(i):
            return
        rows, i_row = np.unique(i, return_inverse=True)
        k = top.shape[1]
        query = np.concatenate([np.repeat(np.arange(len(rows)), k), i_row])
        ids = np.concatenate([top_id[at[rows]].ravel(), self.ids[page][some[j]]])
        found = np.concatenate([top[at[rows]].ravel(), scores[i, j]])
        order = np.lexsort((ids, -found, query))
        # Each query has k places or more in this order; the first k of them stay.
        best = order[np.searchsorted(query[order], np.arange(len(rows)))[:, None] + np.arange(k)]
        top_id[at[rows]], top[at[rows]] = ids[best], found[best]
        least[at[rows]] = np.maximum(least[at[rows]], found[best[:, -1]])


def build_index(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, shard_rows: int = 8192, page_rows: int = 128, fanout: int = 16) -> DataFrame:
    """The paged M-trees of all vectors: one row per shard, with its pages. Shards of a
    length of vectors are numbered from 0."""
    vectors = quantised(df, id_col, vector_col, scale).withColumn("dim", F.size("v"))
    sizes = {r.dim: r["count"] for r in vectors.groupBy("dim").count().collect()}
    shards = F.lit(1)
    for dim, n in sizes.items():
        shards = F.when(F.col("dim") == dim, -(-n // shard_rows)).otherwise(shards)
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), shards).cast("int"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        vectors = np.stack(pdf["v"].to_numpy()).reshape(len(pdf), -1)
        pages = build_pages(pdf["vec_id"].to_numpy(dtype=np.int64), vectors, page_rows=page_rows, fanout=fanout)
        plain = [{k: v.ravel().tolist() if isinstance(v, np.ndarray) else v for k, v in p.items()} for p in pages]
        return pd.DataFrame({"dim": [int(pdf["dim"].iloc[0])], "shard": [int(pdf["shard"].iloc[0])], "pages": [plain]})

    return dealt.groupBy("dim", "shard").applyInPandas(build, SHARDS)


#: No queries.
_NONE = (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty((0, 0)), np.empty(0), 1)


def _pages(stored: pa.ListScalar) -> list[dict]:
    """A shard's pages; numbers in lists stay arrays."""
    fields = dict(zip((f.name for f in stored.type.value_type), stored.values.flatten()))
    plain = {c: [x.values.to_numpy() for x in a] if pa.types.is_list(a.type) else a.to_pylist() for c, a in fields.items()}
    return [dict(zip(plain, values)) for values in zip(*plain.values())]


def _searcher(held, k: int, first: bool):
    """Searches the shards for a broadcast block of queries. ``first``: a query is asked
    of one shard only, and its ``k``-th score there is the answer."""

    def search(batches):
        for batch in batches:
            for dim, number, pages in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                ids, prints, vectors, least, shards = held.value.get(dim, _NONE)
                asked = np.flatnonzero(prints % shards == number) if first else np.arange(len(ids))
                at, got, scores = asked[:0], ids[:0], least[:0]
                if len(asked):
                    at, got, scores = Shard(_pages(pages)).search_all(vectors[asked], ids[asked], k, least[asked])
                    if first:
                        # A query's hits lie one after the other, the best first.
                        kth = np.arange(len(at)) - np.searchsorted(at, at) == k - 1
                        at, got, scores = at[kth], got[kth], scores[kth]
                columns = ids[asked[at]], prints[asked[at]], got, scores.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "print", "vec_id", "score"])

    return search


def search_index(index: DataFrame, queries: DataFrame, k: int = 20, *, block_queries: int = 20_000) -> DataFrame:
    """``query_id, rank, vec_id, score`` for ``queries`` (vec_id, v) against a built index."""
    spark = index.sparkSession
    context, schema = spark.sparkContext, "query_id long, print long, vec_id long, score long"
    asked = queries.select("vec_id", "v", F.xxhash64("v").alias("print")).dropDuplicates(["vec_id", "print"])
    shards = {r.dim: r.n for r in index.groupBy("dim").agg((F.max("shard") + 1).alias("n")).collect()}
    blocks = max(1, -(-asked.count() // block_queries))
    found = None
    for block in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("vec_id", "print"), F.lit(blocks)) == block) if blocks > 1 else asked
        by_dim: dict = {}
        for r in part.collect():
            by_dim.setdefault(len(r.v), []).append((r.vec_id, r.print, r.v))

        def block_of(least: dict):
            return {
                d: (
                    np.array([x[0] for x in q], dtype=np.int64),
                    np.array([x[1] for x in q], dtype=np.int64),
                    np.array([x[2] for x in q], dtype=np.float64).reshape(len(q), d),
                    np.array([least.get(x[:2], -np.inf) for x in q]),
                    shards.get(d, 1),
                )
                for d, q in by_dim.items()
            }

        # A bound for each query of the block.
        tried = index.mapInArrow(_searcher(context.broadcast(block_of({})), k, True), schema) if max(shards.values(), default=1) > 1 else None
        least = {(r.query_id, r.print): float(r.score) for r in tried.collect()} if tried else {}
        got = index.mapInArrow(_searcher(context.broadcast(block_of(least)), k, False), schema)
        found = got if found is None else found.unionByName(got)
    order = Window.partitionBy("query_id", "print").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_k(df: DataFrame, k: int = 20, *, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, **sizes: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` best of all other rows.

    Queries are the rows whose id is divisible by ``every``. The score is the
    integer inner product of quantised vectors; ties go to the smaller id. Fewer
    than ``k`` candidates give as many rows. Only vectors of equal length meet.

    Rows with a null id, null vectors and vectors with a null or non-finite
    component take no part. Repeated rows are candidates each; a query that is
    repeated with the same vector is asked once, and rows that share its id are
    its own and no candidates. Other columns are not read; an empty table gives
    an empty result.
    """
    index = spread(materialise(build_index(df, id_col=id_col, vector_col=vector_col, scale=scale, **sizes), "mtree"), "shard")
    queries = quantised(df, id_col, vector_col, scale).filter(F.col("vec_id") % every == 0)
    return search_index(index, queries, k)

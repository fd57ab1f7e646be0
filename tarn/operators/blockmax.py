"""BM25 top-k over postings in blocks, best blocks first against a running k-th score.

Documents are dealt to ranges by hash. A block holds the postings of one term in one
range: the documents, the part of the score that each can add for a unit of weight, and
the largest such part. The blocks are written once, those of a range together.

A batch of queries is broadcast as weights of numbered terms; only blocks of asked terms
reach Python. There a query's bound in a range is the sum of what its terms' blocks can
add. Of the ranges at hand a query takes those of the highest bound first and leaves
out all whose bound lies below its k-th score so far. In a range its blocks are read
from the one that can add most downwards. Documents that cannot reach the k-th score with what is left
are given up; once few remain they are looked up in the further blocks, and with none
the range is left. The result is the one of ``bm25.search``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.operators import bm25
from tarn.runtime import materialise

#: Room for the rounding of sums.
SLACK = 1e-6
FOUND = "query_id long, doc_id long, score double, read long"


@dataclass(frozen=True)
class BlockIndex:
    plain: bm25.Bm25Index
    blocks: DataFrame  # range, term, most, docs, parts


def build(index: bm25.Bm25Index, *, block_docs: int = 256) -> BlockIndex:
    """The blocks of an index, with about ``block_docs`` documents in a range."""
    docs, avgdl = index.lengths.agg(F.count("*"), F.avg("dl")).first()
    ranges = max(1, -(-docs // block_docs))
    tf, dl = F.col("tf"), F.col("dl")
    part = tf * (bm25.K1 + 1) / (tf + bm25.K1 * (1 - bm25.B + bm25.B * dl / F.lit(avgdl or 1.0)))
    placed = index.postings.select(F.pmod(F.xxhash64("doc_id"), F.lit(ranges)).cast("int").alias("range"), "term", "doc_id", part.alias("part"))
    listed = placed.repartition("range").groupBy("range", "term").agg(F.max("part").alias("most"), F.sort_array(F.collect_list(F.struct("doc_id", "part"))).alias("p"))
    blocks = listed.select("range", "term", "most", F.col("p.doc_id").alias("docs"), F.col("p.part").alias("parts"))
    return BlockIndex(index, materialise(blocks.sortWithinPartitions("range", "term"), "blocks"))


def search(index: BlockIndex, queries: DataFrame, k: int = 10, *, block_queries: int = 4096, counted: dict | None = None, **columns: str) -> DataFrame:
    """``query_id, rank, doc_id, score``, as ``bm25.search``.

    Queries that fewer than ``k`` documents can answer, or with a term that doesn't help,
    are scored in full. ``counted`` gets the number of postings of all terms asked by the
    other queries (``postings``), and of those that were read or looked up (``read``).
    """
    terms = materialise(bm25.query_terms(queries, **columns), "asked-terms")
    short = bm25.short_queries(terms, index.plain.terms, k)
    asked = terms.join(short, "query_id", "left_anti").join(index.plain.terms.select("term", "df", "idf"), "term")
    asked = materialise(asked.select("query_id", "term", "df", (F.col("qtf") * F.col("idf")).alias("weight")), "weights")
    spark = asked.sparkSession
    # At most one number for each query.
    n = asked.select("query_id").distinct().count()
    found = spark.createDataFrame([], FOUND)
    for b in range(max(1, -(-n // block_queries))):
        rows = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(-(-n // block_queries))) == b).select("query_id", "term", "weight").collect() if n else []
        if not rows:
            continue
        number = {t: i for i, t in enumerate(sorted({r.term for r in rows}))}
        ids = np.array(sorted({r.query_id for r in rows}), dtype=np.int64)
        query = np.searchsorted(ids, np.array([r.query_id for r in rows], dtype=np.int64))
        order = np.argsort(query, kind="stable")
        held = spark.sparkContext.broadcast((ids, query[order], np.array([number[r.term] for r in rows])[order], np.array([r.weight for r in rows])[order], len(number)))
        numbered = F.broadcast(spark.createDataFrame(list(number.items()), "term string, number int"))  # terms of a bounded block of queries
        blocks = index.blocks.join(numbered, "term").select("range", "number", "most", "docs", "parts")
        found = found.unionByName(blocks.mapInArrow(_scorer(held, k), FOUND))
    if counted is not None:
        found = materialise(found, "block-hits")
        counted |= {"postings": asked.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0], "read": found.agg(F.coalesce(F.sum("read"), F.lit(0))).first()[0]}
    found = bm25.top_k(found.filter("doc_id is not null").drop("read"), k).select("query_id", "rank", "doc_id", "score")
    if short.head(1):
        found = found.unionByName(bm25.search_terms(index.plain, terms.join(short, "query_id", "left_semi"), k))
    return found


class _Running:
    """The best documents of each query so far, and its k-th score."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.kth = np.full(queries, -np.inf)
        self.kept: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, dtype=np.int64), np.zeros(0))] * queries

    def offer(self, q: int, docs: np.ndarray, scores: np.ndarray) -> None:
        docs, scores = np.concatenate([self.kept[q][0], docs]), np.concatenate([self.kept[q][1], scores])
        best = np.lexsort((docs, -np.round(scores, 9)))[: self.k]
        self.kept[q] = docs[best], scores[best]
        if len(best) == self.k:
            self.kth[q] = scores[best[-1]]


def _scorer(held, k: int, ranges_at_once: int = 16):
    def score(blocks: list[dict], running: _Running) -> int:
        """Offers what some ranges have to give; the number of postings read."""
        _, query, term, weight, terms = held.value
        queries = len(running.kth)
        begin = np.searchsorted(query, np.arange(queries + 1))
        most = np.zeros((len(blocks), terms))
        for i, r in enumerate(blocks):
            most[i, r["number"]] = r["most"]
        bounds = np.stack([np.bincount(query, weight * most[i, term], minlength=queries) for i in range(len(blocks))])
        read = 0
        for q in range(queries):
            mine, w = term[begin[q] : begin[q + 1]], weight[begin[q] : begin[q + 1]]
            for i in np.argsort(-bounds[:, q]).tolist():
                if bounds[i, q] <= 0 or bounds[i, q] < running.kth[q] - SLACK:
                    break
                r = blocks[i]
                can = w * most[i, mine]
                left, total, alive = bounds[i, q], np.zeros(len(r["docs"])), None
                for t in np.argsort(-can).tolist():
                    if can[t] <= 0:
                        continue
                    floor = running.kth[q] - SLACK - left
                    a, b = r["at"][mine[t]]
                    if alive is None:
                        if total.max() < floor:
                            break
                        some = np.flatnonzero(total >= floor)
                        if 4 * len(some) < b - a:
                            alive = some
                    else:
                        alive = alive[total[alive] >= floor]
                    if alive is None:
                        total[r["place"][a:b]] += w[t] * r["parts"][a:b]
                        read += b - a
                    elif not len(alive):
                        break
                    else:
                        # Few documents are left: they are looked up in the block.
                        at = np.searchsorted(r["place"][a:b], alive)
                        at = a + np.minimum(at, b - a - 1)
                        has = r["place"][at] == alive
                        total[alive[has]] += w[t] * r["parts"][at[has]]
                        read += len(alive)
                    left -= can[t]
                else:
                    some = np.arange(len(total)) if alive is None else alive
                    some = some[(total[some] > 0) & (total[some] >= running.kth[q] - SLACK)]
                    if len(some):
                        running.offer(q, r["docs"][some], total[some])
        return read

    def run(batches):
        ids = held.value[0]
        running, read, waiting, last = _Running(len(ids), k), 0, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            number = batch.column(0).to_numpy()
            for a, b in zip(cuts := [0, *(np.flatnonzero(np.diff(number)) + 1).tolist()], [*cuts[1:], len(number)]):
                if last == number[a]:
                    waiting[-1].append(batch.slice(a, b - a))  # a range goes on from the batch before
                else:
                    if len(waiting) == ranges_at_once:
                        read, waiting = read + score([_opened(x) for x in waiting], running), []
                    waiting.append([batch.slice(a, b - a)])
                    last = number[a]
        if waiting:
            read += score([_opened(x) for x in waiting], running)
        query = np.repeat(np.arange(len(ids)), [len(d) for d, _ in running.kept])
        docs, scores = (np.concatenate([np.zeros(0, dtype=d), *(x[c] for x in running.kept)]) for c, d in ((0, np.int64), (1, np.float64)))
        names = ["query_id", "doc_id", "score", "read"]
        yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(docs), pa.array(scores), pa.nulls(len(docs), pa.int64())], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64()), pa.array([read])], names)

    return run


def _opened(parts: list[pa.RecordBatch]) -> dict:
    """A range's blocks as arrays: documents, and where the postings of each term lie."""
    joined = pa.Table.from_batches(parts).combine_chunks()
    docs = joined.column(3).combine_chunks()
    ends = np.cumsum(docs.value_lengths().to_numpy()).tolist()
    number = joined.column(1).to_numpy()
    all_docs, place = np.unique(docs.flatten().to_numpy(), return_inverse=True)
    return {"number": number, "most": joined.column(2).to_numpy(), "docs": all_docs, "place": place,
            "parts": joined.column(4).combine_chunks().flatten().to_numpy(), "at": dict(zip(number.tolist(), zip([0, *ends], ends)))}

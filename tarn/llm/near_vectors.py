"""Near-duplicate vectors by cosine, over navigable small-world graphs per shard.

Distinct vectors are dealt to shards of bounded size by hash. Each shard builds a
graph and audits it: vectors turned away from stored ones to just above the threshold
are searched for, and the beam is doubled until the mean share of their links that is
found reaches the wanted recall (measured against the product with the whole shard).
Every shard's vectors then query every shard's graph, each pair of shards in one
direction, as a link counts for both its ends. Candidates are verified by cosine in
double precision. A beam that links fill from end to end may hide more of them: such a
query is held against its whole shard, which is exact, and so is a shard whose beams
would have to be as wide as an eighth of it.

Equal vectors are one node with a number of copies, and within a pair of shards links
are counted and reduced to a spanning forest where they are found, so neither a group
of copies nor one of near copies sends its pairs anywhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.simhash import components, forest
from tarn.operators.graph import NONE, Graph
from tarn.runtime import materialise

PAGE = "shard int, last int, page int, n int, ef int, entry int, layers int, copies binary, unit binary, links binary"
LINKED = "node long, n long, other long"
#: Room for rounding of single precision when candidates are taken from beams.
ROUNDING = 1e-4


def usable(v: Column) -> Column:
    """Whether a vector has only finite components and some that isn't zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def units(v: np.ndarray) -> np.ndarray:
    """Rows of length one. Scaled first, so that squares neither overflow nor vanish."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def links_of(graph: Graph, unit: np.ndarray, queries: np.ndarray, ef: int, threshold: float, batch: int = 256):
    """For batches of queries: their first number, and the pairs (query in the batch, node)
    of cosine ``threshold`` or more. With ``ef`` zero all are held against all."""
    for at in range(0, len(queries), batch):
        q = queries[at : at + batch]
        row, node = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        exact = np.arange(len(q))
        if ef:
            found, dist = graph.search(q, ef, ef)
            near = (found != NONE) & (dist <= 1 - threshold + ROUNDING)
            full = near.all(axis=1)
            exact = np.flatnonzero(full)
            row, c = np.nonzero(near & ~full[:, None])
            node = found[row, c].astype(np.int64)
            sure = np.einsum("id,id->i", q[row], unit[node]) >= threshold
            row, node = row[sure], node[sure]
        if len(exact):
            r, n = np.nonzero(q[exact] @ unit.T >= threshold)
            row, node = np.concatenate([row, exact[r]]), np.concatenate([node, n])
        yield at, row, node


def audited(graph: Graph, unit: np.ndarray, ef: int, threshold: float, probes: int, recall: float, seed: int) -> int:
    """The least beam, doubled from ``ef`` on, that finds ``recall`` of the links of ``probes``
    turned away from stored vectors; zero where an eighth of the shard wouldn't do."""
    picked = unit[np.unique(np.linspace(0, len(unit) - 1, min(probes, len(unit))).astype(np.int64))]
    turn = np.random.Generator(np.random.PCG64([seed, 1])).normal(size=picked.shape)
    turn -= (turn * picked).sum(axis=1, keepdims=True) * picked
    size = np.sqrt((turn * turn).sum(axis=1, keepdims=True))
    cosine = threshold + 0.02 * (1 - threshold)
    away = np.where(size > 1e-9, cosine * picked + np.sqrt(1 - cosine * cosine) * turn / np.maximum(size, 1e-9), picked)
    true = np.bincount(np.nonzero(away @ unit.T >= threshold)[0], minlength=len(away))
    while ef * 8 <= len(unit):
        found = np.zeros(len(away), dtype=np.int64)
        for at, row, _ in links_of(graph, unit, away, ef, threshold):
            found[at : at + 256] += np.bincount(row, minlength=256)[: len(found) - at]
        if (found[true > 0] / true[true > 0]).mean() >= recall:
            return ef
        ef *= 2
    return 0


def graphs(nodes: DataFrame, m: int, ef_construction: int, ef: int, threshold: float, probes: int, recall: float, page_rows: int = 512) -> DataFrame:
    """Pages of each shard's graph, with the audited width of its beams."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        shard, last = table.column("shard")[0].as_py(), table.column("last")[0].as_py()
        v = table.column("v").combine_chunks()
        unit = units(v.flatten().to_numpy().reshape(len(v), -1))
        copies = table.column("copies").to_numpy()
        graph = Graph(unit.shape[1], m, ef_construction, seed=shard)
        graph.add(unit, own=m)
        width = audited(graph, unit, ef, threshold, probes, recall, shard)
        pages = []
        for page, a in enumerate(range(0, len(unit), page_rows)):
            b = min(a + page_rows, len(unit))
            links = b"".join(x[a:b].tobytes() for x in graph.links)
            pages.append((shard, last, page, b - a, width, graph.entry, len(graph.links), copies[a:b].tobytes(), unit[a:b].tobytes(), links))
        names = [p.split()[0] for p in PAGE.split(", ")]
        types = [pa.int32()] * 7 + [pa.binary()] * 3
        return pa.table([pa.array(c, t) for c, t in zip(zip(*pages), types)], names=names)

    return nodes.select("shard", "last", "pos", "copies", "v").groupBy("shard").applyInArrow(build, PAGE)


def opened(pages: list[dict], m: int) -> tuple[Graph, np.ndarray, np.ndarray, int]:
    """Graph, unit vectors, copies and beam width of a shard's pages."""
    pages = sorted(pages, key=lambda p: p["page"])
    n = sum(p["n"] for p in pages)
    unit = np.frombuffer(b"".join(p["unit"] for p in pages)).reshape(n, -1)
    copies = np.frombuffer(b"".join(p["copies"] for p in pages), dtype=np.int64)
    graph = Graph(unit.shape[1], m)
    graph.data, graph.entry = unit.astype(np.float32), pages[0]["entry"]
    if pages[0]["links"] is not None:
        parts = [[] for _ in range(pages[0]["layers"])]
        for p in pages:
            flat, at = np.frombuffer(p["links"], dtype=np.int32), 0
            for layer, part in enumerate(parts):
                width = graph.width(layer)
                part.append(flat[at : at + p["n"] * width].reshape(p["n"], width))
                at += p["n"] * width
        graph.links = [np.concatenate(x) for x in parts]
    return graph, unit, copies, pages[0]["ef"]


def linked(pages: DataFrame, m: int, threshold: float) -> DataFrame:
    """``node, n, other`` of linked nodes, from each pair of shards: how many vectors it
    links to there, and the least node that the links of the pair connect it with."""
    # ``last`` is the last shard of vectors of that length.
    asked = pages.withColumn("graph", F.col("shard")).withColumn("queries", F.explode(F.sequence("shard", "last")))
    asking = pages.filter("shard > first").withColumn("queries", F.col("shard")).withColumn("graph", F.explode(F.sequence("first", F.col("shard") - 1))).withColumn("links", F.lit(None).cast("binary"))
    both = asked.unionByName(asking).drop("first", "last")

    def search(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        g, q = rows[0]["graph"], rows[0]["queries"]
        graph, unit, copies, ef = opened([r for r in rows if r["shard"] == g], m)
        n = len(unit)
        if g == q:
            counts, root = inside(graph, unit, copies, ef, threshold)
            name = (np.int64(g) << 32) + np.arange(n)
        else:
            _, queries, many, _ = opened([r for r in rows if r["shard"] == q], m)
            counts = np.zeros(n + len(queries), dtype=np.int64)

            def pairs():
                for at, row, node in links_of(graph, unit, queries, ef, threshold):
                    np.add.at(counts, node, many[at + row])
                    np.add.at(counts, n + at + row, copies[node])
                    yield node, n + at + row

            root = forest(len(counts), pairs())
            name = np.concatenate([(np.int64(g) << 32) + np.arange(n), (np.int64(q) << 32) + np.arange(len(queries))])
        some = np.flatnonzero(counts)
        return pa.table([pa.array(name[some]), pa.array(counts[some]), pa.array(name[root[some]])], names=["node", "n", "other"])

    return both.groupBy("graph", "queries").applyInArrow(search, LINKED)


def inside(graph: Graph, unit: np.ndarray, copies: np.ndarray, ef: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Counts and roots of a shard's nodes under the links among them. A link is found
    from either end; a table of bits, bounded as the shard is, puts both together."""
    n, wide = len(unit), -(-len(unit) // 8)
    bits = np.zeros((n, wide), dtype=np.uint8)
    for at, row, node in links_of(graph, unit, unit, ef, threshold):
        hit = np.zeros((min(256, n - at), wide * 8), dtype=bool)
        hit[row, node] = True
        bits[at : at + 256] = np.packbits(hit, axis=1)
    counts = np.zeros(n, dtype=np.int64)

    def pairs():
        for at in range(0, n, 256):
            end = min(at + 256, n)
            hit = np.unpackbits(bits[at:end], axis=1, count=n).astype(bool)
            hit |= np.unpackbits(bits[:, at // 8 : -(-end // 8)], axis=1)[:, : end - at].T.astype(bool)
            hit[np.arange(end - at), np.arange(at, end)] = False
            counts[at:end] = hit @ copies
            row, node = np.nonzero(hit)
            yield row + at, node

    root = forest(n, pairs())
    return counts, root


def near_vectors(
    vectors: DataFrame,
    *,
    threshold: float = 0.95,
    shard_rows: int = 8192,
    m: int = 12,
    ef_construction: int = 64,
    ef: int = 32,
    probes: int = 256,
    recall: float = 0.99,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row for each row of ``vectors``.

    Vectors of cosine ``threshold`` or more, in double precision, are linked, if a beam
    finds them; no others are. ``n_links`` counts other rows, ``component_id`` is the
    smallest id that links lead to, the row's own included, and ``kept`` tells whether
    it is that id.

    A vector that is null, empty, all zero, or that holds a null or a number that isn't
    finite links with nothing, nor do vectors of different lengths. Repeated rows and
    equal vectors are linked with each other, always. Rows with a null id are counted
    and connect, but have no say in the name; a component of null ids only has a null
    name and keeps its rows. Other columns are neither read nor returned; an empty
    table gives an empty result.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + F.lit(0.0)).alias("v"))
    alone = rows.filter(~usable(F.col("v"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    # 128 bits of hash stand for a vector from here on; no -0.0 is left.
    keyed = rows.filter(usable(F.col("v"))).select("vec_id", "v", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), F.col("v")).alias("k2"))
    distinct = materialise(keyed.groupBy("k1", "k2", "v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first_id")), "distinct")
    # A row for each length that vectors have.
    sizes = distinct.groupBy(F.size("v").alias("dim")).count().orderBy("dim").collect()
    ranges, at = [], 0
    for r in sizes:
        shards = -(-r["count"] // shard_rows)
        ranges.append((r["dim"], at, at + shards - 1))
        at += shards
    spark = vectors.sparkSession
    ranges = F.broadcast(spark.createDataFrame(ranges, "dim int, first int, last int"))
    dealt = distinct.join(ranges, F.size("v") == F.col("dim")).withColumn("shard", (F.col("first") + F.pmod(F.col("k1"), F.col("last") - F.col("first") + 1)).cast("int"))
    place = F.row_number().over(Window.partitionBy("shard").orderBy("k1", "k2", "v")) - 1
    nodes = materialise(dealt.withColumn("pos", place), "nodes")
    pages = materialise(graphs(nodes, m, ef_construction, ef, threshold, probes, recall), "graphs")
    pages = pages.join(ranges.select("first", F.col("last").alias("l")), F.col("last") == F.col("l")).drop("l")
    found = materialise(linked(pages, m, threshold), "linked")
    roots = components(found.select(F.col("other").alias("a"), F.col("node").alias("b")).filter("a <> b").distinct())
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    named = nodes.select((F.shiftleft(F.col("shard").cast("long"), 32) + F.col("pos")).alias("node"), "k1", "k2", "copies", "first_id")
    rooted = named.join(counts.hint("merge"), "node", "left").join(roots.hint("merge"), "node", "left")
    rooted = materialise(rooted.select("k1", "k2", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "first_id", F.coalesce("root", "node").alias("root")), "rooted")
    # Written, so that the join's sides are plain exchanges, which can be split where a key is hot.
    names = materialise(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "names").hint("merge")
    by_key = materialise(rooted.join(names, "root").select("k1", "k2", "n_links", "component_id"), "components").hint("merge")
    told = keyed.select("vec_id", "k1", "k2").join(by_key, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    return told.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

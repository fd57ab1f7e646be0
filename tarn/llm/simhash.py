"""SimHash near-duplicates with pivot distance tables.

Fingerprints are made once per document and reduced to distinct values. Pairs
are looked for inside buckets: of six blocks of bits, two fingerprints that
differ in at most four bits agree in at least two blocks, so each fingerprint
goes to a bucket for every two blocks. In a bucket each fingerprint has a row in
a table of its Hamming distances to many reference fingerprints (pivots). By the
triangle inequality no coordinate of that table can differ by more than the
allowed distance; the bucket is sorted by the first pivot so that only a window
of rows is looked at, other pivots discard pairs by their largest coordinate
difference, and survivors are verified by their own distance.

A bucket gives a spanning forest of what is connected in it, not its pairs:
at most one link per fingerprint. The fingerprints of a bucket of more than
``cell_rows`` go on to smaller buckets: the bits that they don't share by being
in it are cut into six blocks again, and so on. Four times over, at most 14 bits
are left, so no bucket can hold more than ``max(cell_rows, 2**14)``. Links never
come to the driver; components are found by contracting stars, each round
written to the shared folder.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.runtime import materialise, text_batches

BITS = 64
#: A-Z to a-z; the blanks that separate words to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
#: bytes.split() without an argument would also split at 0x1C-0x1F, which are parts of words here.
_SIMPLE = bytes(range(0x1C, 0x20))


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text after A-Z are lower-cased."""
    if not text:
        return []
    folded = text.translate(_FOLD)
    if any(c in folded for c in _SIMPLE):
        return [w for w in folded.split(b" ") if w]
    return folded.split()


def shingle_hashes(words: list[bytes], size: int, seed: int = 42) -> list[int]:
    """XXH64 of every shingle of ``size`` words, repeats included."""
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, seed)]
    digest = xxhash.xxh64_intdigest
    starts = [0]
    at = 0
    for w in words:
        at += len(w) + 1
        starts.append(at)
    return [digest(joined[a : b - 1], seed) for a, b in zip(starts, starts[size:])]


def fingerprint(words: list[bytes], size: int) -> int:
    """A bit is one if more than half of the shingle hashes have it; none: zero."""
    hashes = shingle_hashes(words, size)
    if not hashes:
        return 0
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        block = np.array(hashes[at : at + 65_536], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int.from_bytes(bits.tobytes(), "little")


def fingerprints(documents: DataFrame, *, size: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp``: the fingerprint of each document row as a signed long."""
    docs = text_batches(documents).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("body"))

    def make(batches):
        for batch in batches:
            found = [fingerprint(words_of(body), size) for body in batch.column(1).to_pylist()]
            fp = np.array(found, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    schema = T.StructType([T.StructField("doc_id", documents.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    return docs.mapInArrow(make, schema)


def pivots(n: int, seed: int = 7) -> np.ndarray:
    """Reference fingerprints: ``n`` seeded random 64-bit values."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, n, dtype=np.uint64, endpoint=False)


def distance_table(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distance of every fingerprint to every pivot."""
    return np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int16)


def bucket_masks(mask: int, distance: int) -> list[int]:
    """Bits that buckets below a bucket share: its own (``mask``) and two blocks out of
    ``distance + 2`` of the others, as ``distance`` differing bits leave two alike.
    None where fewer bits are left than blocks."""
    left = [b for b in range(BITS) if not mask >> b & 1]
    edges = [round(i * len(left) / (distance + 2)) for i in range(distance + 3)]
    if len(left) < distance + 2:
        return []
    blocks = [sum(1 << b for b in left[x:y]) for x, y in zip(edges, edges[1:])]
    return [mask | x | y for x, y in combinations(blocks, 2)]


def signed(bits: int) -> int:
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


def close_pairs(fps: np.ndarray, group: np.ndarray, refs: np.ndarray, distance: int, counts: dict | None = None):
    """Pairs (i, j) of rows of one group within ``distance``.

    Yields arrays in chunks, for all groups at once. Rows are sorted by group and
    the first pivot's distance; a row is held against the following rows of its
    group whose first coordinate differs by at most ``distance``, then against
    the other coordinates, then verified. ``counts`` gathers how many pairs were
    in the windows and how many the whole table left.
    """
    table = distance_table(fps, refs)
    key = group.astype(np.int64) * (4 * BITS) + table[:, 0]
    order = np.argsort(key, kind="stable")
    key, table, fps_o = key[order], table[order], fps[order]
    width = np.searchsorted(key, key + distance, side="right") - np.arange(len(key)) - 1
    upto = np.cumsum(width)
    at = 0
    while at < len(key):
        # As many rows as make about a million candidates.
        before = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, before + 1_000_000, side="right")))
        w = width[at:end]
        i = np.repeat(np.arange(at, end), w)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(w) - w, w)
        if counts is not None:
            counts["window"] = counts.get("window", 0) + len(i)
        for c in range(1, table.shape[1]):
            keep = np.abs(table[i, c] - table[j, c]) <= distance
            i, j = i[keep], j[keep]
        if counts is not None:
            counts["survivors"] = counts.get("survivors", 0) + len(i)
        keep = np.bitwise_count(fps_o[i] ^ fps_o[j]) <= distance
        yield order[i[keep]], order[j[keep]]
        at = end


def forest(n: int, pairs) -> np.ndarray:
    """Root of each row under the pairs: the smallest row index connected to it."""
    root = np.arange(n)

    def flatten():
        while (up := root[root]).tobytes() != root.tobytes():
            root[:] = up

    for a, b in pairs:
        while True:
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                break
            x, y = x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            flatten()
    return root


def buckets(distinct: DataFrame, distance: int, cell_rows: int) -> DataFrame:
    """``fp, mask, bits``: each fingerprint in its buckets, none of which is crowded
    unless no bits are left to tell its fingerprints apart."""

    def below(rows: DataFrame, masks: list[int]) -> DataFrame:
        return rows.select("fp", F.explode(F.array(*(F.lit(signed(m)) for m in masks))).alias("mask")).withColumn("bits", F.col("fp").bitwiseAND(F.col("mask")))

    spark = distinct.sparkSession
    known = {signed(m): m for m in bucket_masks(0, distance)}
    level, done = below(distinct, list(known.values())), []
    while True:
        crowded = level.groupBy("mask", "bits").count().filter(F.col("count") > cell_rows).select("mask", "bits")
        crowded = materialise(crowded, "crowded")
        # A row for each set of bits that some crowded bucket shares: 15 to the power of the level at most.
        masks = [known[r.mask] for r in crowded.select("mask").distinct().collect()]
        finer = {m: found for m in masks if (found := bucket_masks(m, distance))}
        if not finer:
            return reduce(DataFrame.unionByName, done, level)
        steps = spark.createDataFrame([(signed(m), [signed(x) for x in found]) for m, found in finer.items()], "mask long, finer array<long>")
        hot = crowded.join(F.broadcast(steps), "mask")
        done.append(level.join(hot.select("mask", "bits").hint("merge"), ["mask", "bits"], "left_anti"))
        on = level.join(hot.hint("merge"), ["mask", "bits"]).select("fp", F.explode("finer").alias("mask")).distinct()
        level = materialise(on.withColumn("bits", F.col("fp").bitwiseAND(F.col("mask"))), "finer-buckets")
        known = {signed(x): x for found in finer.values() for x in found}


def links(distinct: DataFrame, *, distance: int = 4, n_pivots: int = 16, cell_rows: int = 20_000) -> DataFrame:
    """``a, b`` (a < b): links of fingerprints that connect all within ``distance``.

    ``distinct`` has a row per fingerprint in its column ``fp``.
    """
    refs = pivots(n_pivots)
    cells = buckets(distinct, distance, cell_rows)
    gathered = cells.groupBy("mask", "bits").agg(F.collect_list("fp").alias("rows")).filter(F.size("rows") > 1)

    def within(batches):
        for batch in batches:
            rows = batch.column(0)
            fps = rows.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            group = np.repeat(np.arange(len(rows)), rows.value_lengths().to_numpy())
            root = forest(len(fps), close_pairs(fps.view(np.uint64), group, refs, distance))
            linked = np.flatnonzero(root != np.arange(len(fps)))
            yield pa.RecordBatch.from_arrays([pa.array(fps[root[linked]]), pa.array(fps[linked])], ["a", "b"])

    return gathered.select("rows").mapInArrow(within, "a long, b long").distinct()


def _connected(batches):
    """``node, root`` of a partition's links."""
    empty = np.zeros(0, dtype=np.int64)
    held = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
    a, b = (np.concatenate([empty, *(h[k] for h in held)]) for k in range(2))
    node, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = forest(len(node), [(place[: len(a)], place[len(a) :])])
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[root])], ["node", "root"])


def components(edges: DataFrame, *, together: int = 1 << 20) -> DataFrame:
    """``node, root``: the smallest node connected to each node of ``edges`` (a, b).

    Alternates large and small stars until the links no longer change. A round
    is a group-by and a join over the links, written to the shared folder. At most
    ``together`` links, some megabytes, are connected in one task instead, with the
    same result.
    """
    links_now = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "links")
    if links_now.count() <= together:
        return links_now.coalesce(1).mapInArrow(_connected, "node long, root long")
    seen = None
    while True:
        # Large star: every larger neighbour of a node goes to the node's smallest neighbour.
        both = links_now.select("a", "b").unionByName(links_now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        low = materialise(low, "stars")  # so that a join with a hot centre can be split
        large = both.join(low, both.a == low.n).filter(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        large = materialise(large, "stars")
        small_low = materialise(large.groupBy(F.col("b").alias("n")).agg(F.min("a").alias("m")), "stars")
        small = (
            large.join(small_low, large.b == small_low.n)
            .select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b")))).alias("l"))
            .select("l.a", "l.b")
            .filter("a < b")
            .distinct()
        )
        links_now = materialise(small, "links")
        now = links_now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == seen:
            break
        seen = now
    leaves = links_now.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
    roots = links_now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    return leaves.unionByName(roots)


def near_duplicates(
    documents: DataFrame,
    *,
    size: int = 4,
    distance: int = 4,
    n_pivots: int = 16,
    cell_rows: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document row: ``doc_id, fp (long), component_id``.

    ``component_id`` is the smallest id reachable over fingerprints that differ
    in at most ``distance`` bits, the document's own included.

    A null text is as an empty one: fingerprint zero, linked like any other.
    Repeated rows and equal texts share a fingerprint. Rows with a null id have
    a fingerprint and a component, but no say in its name; a component of null
    ids only has a null name. Other columns are neither read nor returned; an
    empty table gives an empty result.
    """
    made = materialise(fingerprints(documents, size=size, id_col=id_col, text_col=text_col), "fingerprints")
    named = materialise(made.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    found = components(links(named.select("fp"), distance=distance, n_pivots=n_pivots, cell_rows=cell_rows))
    rooted = named.join(found, named.fp == found.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted, "rooted")
    # Written, so that both sides of the join are plain exchanges, which adaptive
    # execution can split where a component is hot.
    names = materialise(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "names").hint("merge")
    by_print = materialise(rooted.join(names, "root").select(F.col("fp").alias("p"), "component_id"), "components")
    return made.join(by_print, made.fp == by_print.p).select("doc_id", "fp", "component_id")

"""Uniform sharding with exact shard sizes.

How many rows of each input partition go to each shard is a matrix whose rows sum
to the partitions' counts and whose columns sum to the shard sizes, N/K rounded
down or up. It is drawn by halves: multivariate hypergeometric draws part the room
of every shard between the first and the second half of the partitions, and so on
down to one partition. All draws depend on the seed and the half, so a task finds
its own row of the matrix in as many draws as the logarithm of the number of
partitions, and no task or broadcast holds the matrix. Each partition gives its rows
a random permutation of these labels as they stream by (the local permutation),
the rows are exchanged, and permuted again inside their shard. Every assignment
of rows to slots is equally likely.

The driver holds a count for each partition, and tasks get their running sums: eight
bytes for each input partition, whatever the number of shards. A shard is
permuted in cells: each row draws a cell at random, cells have a bounded
expected size, and the slot is the cell's offset plus the row's rank by a random
key inside it. All draws depend on the seed, the partition and the position in
it, so a recomputed task gives the same result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shard_sizes(total: int, shards: int) -> np.ndarray:
    """Sizes at most one apart, the larger first."""
    return np.array([total // shards + (k < total % shards) for k in range(shards)], dtype=np.int64)


def some_of(rng: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """How many of ``n`` things fall on each kind, drawn one by one without return from ``counts`` of them."""
    ends = np.cumsum(counts)
    taken = np.zeros(0, dtype=np.int64)
    while len(taken) < n:
        # As many more as are missing: the first ``n`` different ones of a sequence.
        taken = np.unique(np.concatenate([taken, rng.integers(0, int(ends[-1]), n - len(taken))]))
    return np.bincount(np.searchsorted(ends, taken, side="right"), minlength=len(counts))


def drawn(rng: np.random.Generator, room: np.ndarray, n: int) -> np.ndarray:
    """How many of ``n`` rows, drawn without return, fall on each shard's room: exact at any size.

    The library draws hypergeometric numbers below 10**9. Above, each place is taken by
    itself with a chance of ``n`` by all, which is a binomial number for each shard, and
    as many places as are too many or too few in all, about the square root of all, are
    drawn one by one out of the taken or the free ones. Of places taken in this way any
    ``n`` are equally likely, as no step prefers a place, so the law is the same.
    """
    total = int(room.sum())
    if total >= 10**9:
        taken = rng.binomial(room, n / total)
        over = int(taken.sum()) - n
        return taken - some_of(rng, taken, over) if over >= 0 else taken + some_of(rng, room - taken, -over)
    out = np.zeros(len(room), dtype=np.int64)
    rest = total
    for k, good in enumerate(room.tolist()):
        bad = rest - good
        out[k] = x = int(rng.hypergeometric(good, bad, n)) if n and good else 0
        rest, n = bad, n - x
    return out


def matrix_row(ends: np.ndarray, shards: int, seed: int, partition: int) -> np.ndarray:
    """Rows of a partition that go to each shard; ``ends`` are the running sums of the partitions' counts, from 0."""
    low, high = 0, len(ends) - 1
    room = shard_sizes(int(ends[-1]), shards)
    while high - low > 1:
        middle = (low + high) // 2
        left = drawn(np.random.Generator(np.random.PCG64([seed, low, high])), room, int(ends[middle] - ends[low]))
        if partition < middle:
            room, high = left, middle
        else:
            room, low = room - left, middle
    return room


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows of partition p that go to shard k: row sums are ``counts``, column sums the shard sizes."""
    ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    return np.array([matrix_row(ends, shards, seed, p) for p in range(len(counts))], dtype=np.int64).reshape(len(counts), shards)


def labels(row: np.ndarray, cells: int, seed: int, partition: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shard, cell and sort key of each row of a partition, by position."""
    rng = np.random.Generator(np.random.PCG64([seed, partition]))
    shard = rng.permutation(np.repeat(np.arange(len(row), dtype=np.int32), row))
    cell = rng.integers(0, cells, len(shard), dtype=np.int32)
    return shard, cell, rng.integers(0, 2**62, len(shard), dtype=np.int64)


def shard_rows(df: DataFrame, shards: int = 24, *, seed: int = 20, cell_rows: int = 50_000) -> DataFrame:
    """All columns and rows of ``df`` plus ``shard`` (int) and ``slot`` (long).

    Slots are gapless from 0 in every shard. Columns of ``df`` that are called
    ``shard`` or ``slot`` are replaced. Rows are told apart by their place, so
    nulls, repeated rows and ties need no rule; an empty table stays empty.

    ``df`` must give the same rows per partition each time it is read, as a scan
    or a written table does; a task that finds another number of rows than was
    counted fails instead of returning uneven shards. Of the same number of other rows,
    or of rows in another order, each still goes to one slot, but a task that is run
    again may not repeat itself: write such an upstream first.
    """
    spark = df.sparkSession
    counted = df.groupBy(F.spark_partition_id().alias("p")).count().collect()
    sizes = {r.p: r["count"] for r in counted}
    counts = [sizes.get(p, 0) for p in range(max(sizes, default=-1) + 1)]
    total = sum(counts)
    cells = max(1, -(-total // (shards * cell_rows)))
    # Eight bytes for each input partition.
    ends = spark.sparkContext.broadcast(np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]))

    kept = df.drop("shard", "slot")
    mark = "__shard"
    while any(c.startswith(mark) for c in kept.columns):
        mark = "_" + mark
    added = [T.StructField(mark, T.IntegerType()), T.StructField(mark + "_cell", T.IntegerType()), T.StructField(mark + "_key", T.LongType()), T.StructField(mark + "_at", T.LongType())]

    def deal(batches):
        p = TaskContext.get().partitionId()
        row = matrix_row(ends.value, shards, seed, p) if p < len(ends.value) - 1 else np.zeros(shards, dtype=np.int64)
        shard, cell, key = labels(row, cells, seed, p)
        at = 0
        for batch in batches:
            end = at + batch.num_rows
            if end > len(shard):
                break
            extra = [
                pa.array(shard[at:end], pa.int32()),
                pa.array(cell[at:end], pa.int32()),
                pa.array(key[at:end], pa.int64()),
                pa.array(np.arange(at, end, dtype=np.int64) + (p << 40), pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, *(f.name for f in added)])
            at = end
        else:
            end = at
        if end != len(shard):
            raise RuntimeError(f"partition {p} was counted with {len(shard)} rows and now has another number")

    def cell_counts(batches):
        for batch in batches:
            for p in batch.column(0).to_pylist():
                shard, cell, _ = labels(matrix_row(ends.value, shards, seed, p), cells, seed, p)
                n = np.bincount(shard.astype(np.int64) * cells + cell, minlength=shards * cells)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["bin", "n"])

    dealt = kept.mapInArrow(deal, T.StructType([*kept.schema.fields, *added]))
    bins = (
        spark.range(len(counts)).mapInArrow(cell_counts, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n"))
        if counts
        else spark.createDataFrame([], "bin long, n long")
    )
    in_shard = Window.partitionBy(F.floor(F.col("bin") / cells)).orderBy("bin")
    offsets = bins.select(
        F.floor(F.col("bin") / cells).cast("int").alias(mark + "_s"),
        (F.col("bin") % cells).cast("int").alias(mark + "_c"),
        (F.sum("n").over(in_shard) - F.col("n")).alias(mark + "_offset"),
    )
    rank = F.row_number().over(Window.partitionBy(mark, mark + "_cell").orderBy(mark + "_key", mark + "_at"))
    ranked = dealt.withColumn(mark + "_rank", rank)
    return ranked.join(
        offsets, (F.col(mark) == F.col(mark + "_s")) & (F.col(mark + "_cell") == F.col(mark + "_c"))
    ).select(*kept.columns, F.col(mark).alias("shard"), (F.col(mark + "_rank") - 1 + F.col(mark + "_offset")).alias("slot"))

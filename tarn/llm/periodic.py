"""Periodic runs of words, by divide and conquer with Z-functions (Main and Lorentz).

A run is a stretch of consecutive words in which words q apart are identical, q being
the smallest such distance, and which no neighbouring word extends. Words become
numbers of their own document. A stretch that is worked on is cut in the middle: each
run in it either crosses the cut or lies in one half. For every distance p the
Z-functions of the two halves, read from the cut forwards and backwards, tell how far
words p apart agree on both sides of the cut, which is the whole extent of a
repetition that holds p words on the left of the cut or p words on its right. Every
run crosses the cut of the first stretch on the way down whose middle it contains, and
lies wholly in that stretch; a shorter part of it, met further down, could be extended
and is left out. Of several periods of one interval the smallest counts.

Before that, words that occur fewer times than a run repeats them cut the document
into pieces, again and again until nothing is cut: no run can contain such a word.
That is exact, and leaves little of ordinary prose.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.runtime import text_batches

RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


def z_function(s: np.ndarray) -> np.ndarray:
    """For each place, how many words from there on agree with the beginning of ``s``.

    ``s`` holds numbers from 0 on, or separators below -1. Only places of the first
    word are visited: at all others the value is zero.
    """
    z = [0] * len(s)
    if not z:
        return np.zeros(0, dtype=np.int64)
    text = s.tolist()
    text.append(-1)  # differs from all, so a comparison ends
    left = right = 0
    for i in np.flatnonzero(s == s[0])[1:].tolist():
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while text[i + k] == text[k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    z[0] = len(s)
    return np.array(z, dtype=np.int64)


def crossing(s: np.ndarray, begin: int, cut: int, end: int, least: int, times: int) -> np.ndarray:
    """``start, end, period`` of the repetitions of ``s[begin:end]`` that cross ``cut``."""
    u, v = s[begin:cut], s[cut:end]
    most = (end - begin) // times
    apart = np.array([-2])
    found = []
    # Forwards: the right half, then all that begins up to ``most`` words before the cut.
    back = min(len(u), most)
    forward = z_function(np.concatenate([v, apart, s[cut - back : end]]))
    # Backwards: the left half, then all that ends up to ``most`` words behind the cut.
    on = min(len(v), most)
    backward = z_function(np.concatenate([u[::-1], apart, s[begin : cut + on][::-1]]))
    if back:
        p = np.arange(1, back + 1)
        behind = np.append(backward[: len(u)], 0)[p]  # words before cut - p that agree with those before the cut
        ahead = forward[len(v) + 1 + back - p]  # words from the cut on that agree with those from cut - p on
        found.append((cut - p - behind, cut + ahead, p))
    if on:
        p = np.arange(1, on + 1)
        ahead = np.append(forward[: len(v)], 0)[p]
        behind = backward[len(u) + 1 + on - p]
        found.append((cut - behind, cut + p + ahead, p))
    start, stop, period = (np.concatenate([f[k] for f in found]) for k in range(3))
    long = stop - start >= np.maximum(least, times * period)
    return np.stack([start[long], stop[long], period[long]], axis=1)


def runs_of_piece(s: np.ndarray, least: int, times: int) -> np.ndarray:
    """All runs of a piece as rows ``start, end, period``, by start and period."""
    stack, found = [(0, len(s))], []
    while stack:
        begin, end = stack.pop()
        if end - begin < least:
            continue
        cut = (begin + end) // 2
        got = crossing(s, begin, cut, end, least, times)
        if len(got):
            start, stop, period = got.T
            grows = (start > 0) & (s[start - 1] == s[np.minimum(start - 1 + period, len(s) - 1)])
            grows |= (stop < len(s)) & (s[np.minimum(stop, len(s) - 1)] == s[stop - period])
            got = got[~grows]
            # Of the periods of an interval the smallest.
            got = got[np.lexsort((got[:, 2], got[:, 1], got[:, 0]))]
            new = np.ones(len(got), dtype=bool)
            new[1:] = (got[1:, :2] != got[:-1, :2]).any(axis=1)
            found.append(got[new])
        stack += [(begin, cut), (cut, end)]
    if not found:
        return np.zeros((0, 3), dtype=np.int64)
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), dtype=bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[new]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def pieces(ids: np.ndarray, least: int, times: int):
    """``begin, end`` of the stretches of at least ``least`` words that each occur at
    least ``times`` times in their stretch."""
    stack = [(0, len(ids))]
    while stack:
        begin, end = stack.pop()
        if end - begin < least:
            continue
        part = ids[begin:end]
        _, number, count = np.unique(part, return_inverse=True, return_counts=True)
        rare = np.flatnonzero(count[number] < times)
        if not len(rare):
            yield begin, end
            continue
        edges = np.concatenate([[-1], rare, [end - begin]]) + begin
        wide = np.flatnonzero(np.diff(edges) > least)
        stack += [(int(edges[i]) + 1, int(edges[i + 1])) for i in wide]


def runs_of(ids: np.ndarray, least: int = 24, times: int = 3) -> np.ndarray:
    """All runs of a document's word numbers as rows ``start, length, period``, by start and period.

    A run has at least ``least`` words and ``times`` periods (2 or more).
    """
    found = [runs_of_piece(ids[a:b], least, times) + np.array([a, a, 0]) for a, b in sorted(pieces(ids, least, times))]
    runs = np.concatenate(found) if found else np.zeros((0, 3), dtype=np.int64)
    runs[:, 1] -= runs[:, 0]
    return runs


def dropped(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words some run contains after its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:n]) > 0


def collapse_runs(documents: DataFrame, *, least: int = 24, times: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, runs, text``, one row for each document row.

    ``runs`` are all maximal repetitions of at least ``least`` words and ``times``
    times their smallest period, by start and period: ``start`` is a word number from
    0, ``length`` and ``period`` count words. ``text`` is the whole text with each run
    collapsed to its first period, its words joined by one space. Words are what
    stands between blanks (0x20, 0x09-0x0D), as bytes: neither case nor bytes that
    aren't UTF-8 are touched.

    A null or empty text has no words, no runs and an empty text. Repeated rows and
    rows with a null id are documents like any other. Other columns are neither read
    nor returned; an empty table gives an empty result. Each document is one row's
    work, so equal texts need no exchange and no key is hot.
    """
    if times < 2 or least < 1:
        raise ValueError("a run repeats at least twice")
    docs = text_batches(documents).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("body"))
    fields = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])

    def collapse(batches):
        for batch in batches:
            counts, texts, ends, rows = [], [], [0], []
            for body in batch.column(1).to_pylist():
                words = (body or b"").split()  # of bytes: 0x20 and 0x09-0x0D only
                numbers: dict[bytes, int] = {}
                runs = runs_of(np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64), least, times)
                if len(runs):
                    out = dropped(len(words), runs)
                    kept = [words[i] for i in np.flatnonzero(~out).tolist()]
                else:
                    kept = words
                counts.append(len(words))
                texts.append(b" ".join(kept))
                rows.append(runs)
                ends.append(ends[-1] + len(runs))
            flat = np.concatenate(rows) if rows else np.zeros((0, 3), dtype=np.int64)
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(fields)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), listed, pa.array(texts, pa.binary())], ["doc_id", "n_words", "runs", "text"])

    schema = T.StructType([T.StructField("doc_id", documents.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("text", T.BinaryType())])
    return docs.mapInArrow(collapse, schema).withColumn("text", F.col("text").cast("string"))


def strongest(runs: Column) -> Column:
    """The run of the greatest exact length / period; of equal ones the first by start, then period. Null without runs."""

    def before(a: Column, b: Column) -> Column:
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        first = (x > y) | ((x == y) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] < b["period"]))))
        return F.when(first, F.lit(-1)).when((x == y) & (a["start"] == b["start"]) & (a["period"] == b["period"]), F.lit(0)).otherwise(F.lit(1))

    return F.get(F.array_sort(runs, before), F.lit(0))


def listed(runs: Column) -> Column:
    """``start,length,period`` and a line feed for each run."""
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    return F.array_join(F.transform(runs, lambda r: F.concat(line(r), F.lit("\n"))), "")

"""Benchmark decontamination as a prefix-filtered containment join.

A benchmark item is cut into windows of ``window_words`` words (an item with
fewer words is one window). A window is contained in a document only if all of
its shingles (word pairs) are, so the overlap that is required equals the size
of the window's shingle set and the necessary prefix is one shingle: the rarest.
The plan is

1. windows of all items, distinct, in blocks of bounded size;
2. document frequency of the windows' shingles, counted over all documents;
3. per window the rarest shingle as join token. A window with a shingle that no
   document has can't occur and leaves;
4. documents probe the join tokens; a match at a position is kept if the window,
   placed by the token's offset, starts and ends inside the document (the
   positional and length bounds), and then verified word by word.

A block of windows is bounded by ``block_windows`` and only a block is
broadcast; more windows mean more passes, never a larger broadcast. Documents
are never shuffled: only counters for benchmark shingles are.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.runtime import text_batches

#: Bytes to bytes: A-Z to a-z, ASCII other than letters and digits to a space.
#: UTF-8 bytes from 0x80 up are parts of words, so bytes split as code points do.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)

SPAN = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text after A-Z are lower-cased."""
    return text.translate(_FOLD).split() if text else []


def windows_of(words: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    if not words:
        return set()
    n = min(size, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def shingles_of(window: tuple[bytes, ...]) -> list[tuple[bytes, ...]]:
    """Word pairs of a window in order; the word itself if there is but one."""
    return list(zip(window, window[1:])) if len(window) > 1 else [window]


def occurring(words: list[bytes]):
    """All shingles of a document, by position, as windows could hold them."""
    return zip(words, words[1:])


def _benchmark_windows(benchmark: DataFrame, size: int, item_col: str, text_col: str) -> DataFrame:
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("binary").alias("body")
    )

    def cut(batches):
        for batch in batches:
            item, window = [], []
            for i, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w in windows_of(words_of(body), size):
                    item.append(i)
                    window.append(b" ".join(w))
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(window, pa.binary())], ["item", "window"])

    return items.mapInArrow(cut, "item string, window binary").distinct()


def _count_shingles(docs: DataFrame, wanted) -> dict:
    """Documents that hold each wanted shingle. The result has a row per wanted
    shingle at most, whatever the number of documents."""

    def count(batches):
        pairs = {k for k in wanted.value if len(k) == 2}
        singles = {k[0] for k in wanted.value if len(k) == 1}
        seen: dict = defaultdict(int)
        for batch in batches:
            for body in batch.column(0).to_pylist():
                words = words_of(body)
                for k in set(filter(pairs.__contains__, occurring(words))):
                    seen[k] += 1
                if singles:
                    for w in singles.intersection(words):
                        seen[(w,)] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([b" ".join(k) for k in seen], pa.binary()), pa.array(list(seen.values()), pa.int64())],
            ["shingle", "n"],
        )

    counted = docs.select("body").mapInArrow(count, "shingle binary, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    return {tuple(bytes(r.shingle).split(b" ")): r.n for r in counted.collect()}


def prefix_index(windows: dict, frequency: dict) -> dict:
    """Join tokens: rarest shingle -> [(offset, length, {window: items})].

    Ties in rarity go to the shingle that sorts first, then to the first offset.
    """
    index: dict = defaultdict(dict)
    for window, items in windows.items():
        parts = shingles_of(window)
        counts = [frequency.get(p, 0) for p in parts]
        if not min(counts):
            continue
        rarest = min(range(len(parts)), key=lambda i: (counts[i], parts[i], i))
        index[parts[rarest]].setdefault((rarest, len(window)), {})[window] = items
    return {k: [(off, n, found) for (off, n), found in v.items()] for k, v in index.items()}


def matches(words: list[bytes], pairs: dict, singles: dict) -> tuple[list[tuple[int, int]], set]:
    """Verified occurrences in one document: merged word spans and item ids."""
    total, spans, items = len(words), [], set()
    at = [(i, k) for i, k in enumerate(occurring(words)) if k in pairs] if pairs else []
    if singles:
        at += [(i, w) for i, w in enumerate(words) if w in singles]
    for i, key in at:
        for offset, n, candidates in pairs[key] if type(key) is tuple else singles[key]:
            first = i - offset
            if first < 0 or first + n > total:
                continue
            found = candidates.get(tuple(words[first : first + n]))
            if found:
                spans.append((first, first + n))
                items.update(found)
    return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


def decontaminate(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    window_words: int = 10,
    block_windows: int = 200_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document row: ``doc_id, n_words, n_hit, spans, items`` (and ``keep``).

    ``spans`` are the merged word ranges ``[first, end)`` covered by windows of
    the benchmark, ``n_hit`` the words inside them, ``items`` the sorted ids (as
    strings) of items with an occurring window.

    Null or empty texts have no words and no hits. A null item id counts as an
    empty string; items without words have no window. Repeated document rows
    each get their row, repeated benchmark rows count once. Columns outside ``keep``
    are neither read nor returned. Empty tables give an empty result, or no hits.
    """
    spark = documents.sparkSession
    docs = text_batches(documents).select(F.col(text_col).cast("binary").alias("body"))
    windows = _benchmark_windows(benchmark, window_words, item_col, item_text_col)
    blocks = max(1, -(-windows.count() // block_windows))
    id_field, body_field = T.StructField("doc_id", documents.schema[id_col].dataType), T.StructField("body", T.BinaryType())
    # One struct carries what is kept, so that its names can't clash with the result's.
    kept = F.struct(*(F.col(c) for c in keep)) if keep else F.lit(None).cast("boolean")
    hits = [T.StructField("spans", SPAN), T.StructField("items", T.ArrayType(T.StringType()))]
    state = text_batches(documents).select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("body"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in hits), kept.alias("kept")
    )
    kept_field = state.schema["kept"]

    for block in range(blocks):
        part = windows.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block) if blocks > 1 else windows
        held: dict = defaultdict(list)
        for r in part.collect():
            held[tuple(bytes(r.window).split(b" "))].append(r["item"])
        wanted = spark.sparkContext.broadcast({s for w in held for s in shingles_of(w)})
        index = spark.sparkContext.broadcast(prefix_index(held, _count_shingles(docs, wanted)))
        last = block == blocks - 1
        fields = [id_field, T.StructField("n_words", T.LongType()) if last else body_field, *hits, kept_field]
        state = state.mapInArrow(_prober(index, last), T.StructType(fields))

    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["first"])
    return state.select("doc_id", "n_words", covered.alias("n_hit"), "spans", "items", *(F.col("kept")[c].alias(c) for c in keep))


def _prober(index, last: bool):
    """Probes one block. The last pass returns the number of words in place of the text."""
    span_type = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))

    def probe(batches):
        pairs = {k: v for k, v in index.value.items() if len(k) == 2}
        singles = {k[0]: v for k, v in index.value.items() if len(k) == 1}
        for batch in batches:
            total, spans, items = [], [], []
            for body, old, had in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                words = words_of(body)
                found, ids = matches(words, pairs, singles)
                total.append(len(words))
                spans.append(merged([(s["first"], s["end"]) for s in old or ()] + found))
                items.append(sorted({*ids, *(had or ())}))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(total, pa.int64()) if last else batch.column(1),
                    pa.array([[{"first": a, "end": b} for a, b in s] for s in spans], span_type),
                    pa.array(items, pa.list_(pa.string())),
                    batch.column(4),
                ],
                ["doc_id", "n_words" if last else "body", "spans", "items", "kept"],
            )

    return probe

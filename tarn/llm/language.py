"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of order 0 to ``order``. The
probability of a byte is that of the longest context that has been followed by
it, times the escape probabilities of the longer contexts (method C: a context
that was seen n times with q different bytes escapes with q / (n + q)), down to
a uniform order -1 over 256 bytes. Bytes that a context has been followed by are
left out of what it escapes to. Statistics are frozen after training. A text's
exact code length under a language is the sum of -log2 of these probabilities;
the language with the shortest code wins.

The trees of all languages are stored together, order by order: the byte strings
of a context and its next byte that any language has seen, with their code
lengths under every language, and the contexts with the bits that an escape from
them costs. A byte is scored at the longest order at which its string is stored,
and pays the escapes of the orders above. No context, byte or count is left out,
and nothing is rounded or clipped.

Training texts are a sample of about ``sample_rows`` rows for each label at most,
taken by a hash of the id; the bound is a parameter. They are counted where they
lie, and only counts of byte strings come to the driver. Every text is scored
whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.runtime import text_batches

UNKNOWN = "und"
#: Bytes of a text that are scored at a time.
CHUNK = 1 << 16


def fold(text: bytes) -> bytes:
    """What is scored: ASCII letters lower-cased, so that a language has one tree for both cases."""
    return text.lower()


def strings(text: bytes, order: int) -> np.ndarray:
    """Every byte of a text with the ``order`` bytes before it, as a number; blanks stand before the text."""
    data = np.frombuffer(b" " * order + text, dtype=np.uint8).astype(np.uint64)
    n = len(data) - order
    code = np.zeros(n, dtype=np.uint64)
    for k in range(order + 1):
        code = code << np.uint64(8) | data[k : k + n]
    return code


def place(table: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each asked value in a sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(asked), dtype=np.int64), np.zeros(len(asked), dtype=bool)
    at = np.minimum(np.searchsorted(table, asked), len(table) - 1)
    return at, table[at] == asked


def direct_index(every: np.ndarray, contexts: np.ndarray, order: int, most: int = 1 << 22) -> tuple | None:
    """The row of each string of the longest order by two lookups in place of a search:
    symbols of the bytes, the place of each context, and the row by place and last symbol.

    Bytes that no text has share a symbol, as they share all that is asked here.
    None if the table of contexts would have more than ``most`` cells.
    """
    seen = np.unique(np.concatenate([every >> np.uint64(8 * k) & np.uint64(255) for k in range(order + 1)])).astype(np.int64)
    size = len(seen) + 1
    if size**order > most:
        return None
    symbol = np.full(256, size - 1, dtype=np.int32)
    symbol[seen] = np.arange(len(seen))

    def number(codes: np.ndarray, length: int) -> np.ndarray:
        out = np.zeros(len(codes), dtype=np.int64)
        for k in range(length - 1, -1, -1):
            out = out * size + symbol[(codes >> np.uint64(8 * k) & np.uint64(255)).astype(np.int64)]
        return out

    places = np.full(size**order, len(contexts), dtype=np.int32)
    places[number(contexts, order)] = np.arange(len(contexts))
    rows = np.full((len(contexts) + 1) * size, -1, dtype=np.int32)
    last = symbol[(every & np.uint64(255)).astype(np.int64)]
    rows[np.searchsorted(contexts, every >> np.uint64(8)) * size + last] = np.arange(len(every))
    return symbol, size, places, rows


def train(counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = 3) -> tuple:
    """The model of the counted strings of each language: languages, order, for each
    order from 0 up strings, their bits, contexts and the bits of an escape, and an
    index of the longest strings.

    It is made of arrays, numbers and names only, so that workers need no code to read it.
    """
    if not 0 <= order <= 7:
        raise ValueError("the order must be from 0 to 7")
    languages = sorted(counts)
    layers = []
    for o in range(order + 1):
        mask = np.uint64(2 ** (8 * (o + 1)) - 1)
        own = {}
        for lang in languages:
            code, n = counts[lang]
            keys, back = np.unique(code & mask, return_inverse=True)
            own[lang] = keys, np.bincount(back, weights=n, minlength=len(keys))
        every = np.unique(np.concatenate([own[lang][0] for lang in languages]))
        contexts = np.unique(every >> np.uint64(8))
        of = np.searchsorted(contexts, every >> np.uint64(8))
        if o:
            shorter = layers[-1][1][np.searchsorted(layers[-1][0], every & np.uint64(2 ** (8 * o) - 1))]
        else:
            shorter = np.full((len(every), len(languages)), 8.0)
        bits, escape = np.empty((len(every), len(languages))), np.empty((len(contexts), len(languages)))
        for k, lang in enumerate(languages):
            n = np.zeros(len(every))
            n[np.searchsorted(every, own[lang][0])] = own[lang][1]
            total, kinds = np.bincount(of, weights=n, minlength=len(contexts)), np.bincount(of, weights=n > 0, minlength=len(contexts))
            # What the shorter context gives to the bytes that were not seen here.
            left = 1.0 - np.bincount(of, weights=np.where(n > 0, np.exp2(-shorter[:, k]), 0.0), minlength=len(contexts))
            # A context that all 256 bytes have followed has nothing to escape to.
            full = kinds == 256
            room = np.where(full, total, total + kinds)
            escape[:, k] = np.where((kinds > 0) & ~full, -np.log2(np.where(kinds > 0, kinds, 1.0) / np.maximum(room, 1)) + np.log2(np.maximum(left, 1e-300)), 0.0)
            bits[:, k] = np.where(n > 0, -np.log2(np.maximum(n, 1) / np.maximum(room[of], 1)), escape[of, k] + shorter[:, k])
        layers.append((every, bits, contexts, escape))
    return tuple(languages), order, tuple(layers), direct_index(layers[-1][0], layers[-1][2], order)


def code_lengths(model: tuple, text: bytes) -> np.ndarray:
    """Bits of a text under each language."""
    languages, order, layers, direct = model
    total = np.zeros(len(languages))
    for at in range(0, len(text), CHUNK):
        data = np.frombuffer(b" " * max(0, order - at) + text[max(0, at - order) : at + CHUNK], dtype=np.uint8)
        n = len(data) - order
        if direct:
            symbol, size, places, rows = direct
            coded = symbol[data]
            context = np.zeros(n, dtype=np.int32)
            for k in range(order):
                context = context * np.int32(size) + coded[k : k + n]
            row = rows[places[context] * np.int64(size) + coded[order:]]
            found = row >= 0
            left = np.flatnonzero(~found)
            total += layers[-1][1][row[found]].sum(axis=0)
        else:
            left = np.arange(n)
        code = np.zeros(len(left), dtype=np.uint64)
        for k in range(order + 1):
            code = code << np.uint64(8) | data[left + k]
        for o in range(order, -1, -1):
            every, bits, contexts, escape = layers[o]
            code = code & np.uint64(2 ** (8 * (o + 1)) - 1)
            if o < order or not direct:
                row, found = place(every, code)
                total += bits[row[found]].sum(axis=0)
                code = code[~found]
            if not len(code):
                break
            row, known = place(contexts, code >> np.uint64(8))
            total += escape[row[known]].sum(axis=0)
        else:
            total += 8.0 * len(code)
    return total


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def classify(model: tuple | None, text: bytes | None) -> tuple[str, float]:
    """Language and its share of the probability of the text under all languages."""
    if not text or model is None or not has_letter(text.decode("utf-8", "replace")):
        return UNKNOWN, 0.0
    lengths = code_lengths(model, fold(text))
    best = int(np.argmin(lengths))
    share = 1.0 / float(np.exp2(np.maximum(lengths[best] - lengths, -1000.0)).sum())
    return model[0][best], share


def held_out(doc_id) -> object:
    """Documents that are never learnt from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def counted(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The strings of texts and how often each occurs."""
    found = [np.unique(strings(fold(t), order), return_counts=True) for t in texts if t]
    if not found:
        return np.empty(0, dtype=np.uint64), np.empty(0)
    keys, back = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(back, weights=np.concatenate([n for _, n in found]), minlength=len(keys))


def fit(documents: DataFrame, *, sample_rows: int = 600, order: int = 3, max_labels: int = 256, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple | None:
    """Learn from labelled documents that are not held out; None if there are none.

    The driver holds counts of strings of ``order + 1`` bytes of about
    ``sample_rows`` texts a label, and never a text. More than ``max_labels``
    labels are an error: the model has a column for each.
    """
    labelled = documents.filter(F.col(lang_col).isNotNull() & (F.length(text_col) > 0) & F.col(id_col).isNotNull() & ~held_out(id_col))
    sizes = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().limit(max_labels + 1).collect()}
    if len(sizes) > max_labels:
        raise ValueError(f"more than {max_labels} languages to learn")
    if not sizes:
        return None
    spread = 1 << 30
    draw = F.pmod(F.xxhash64(id_col), F.lit(spread))
    chosen = F.lit(False)
    for lang, n in sorted(sizes.items()):
        chosen = chosen | ((F.col(lang_col) == lang) & (draw < min(spread, sample_rows * spread // n)))
    rows = labelled.filter(chosen).select(F.col(lang_col).alias("l"), F.col(text_col).cast("binary").alias("b"))

    def count(batches):
        for batch in batches:
            texts: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts.setdefault(lang, []).append(text)
            for lang, some in texts.items():
                keys, n = counted(some, order)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["l", "s", "n"])

    found = rows.mapInArrow(count, "l string, s long, n long").groupBy("l", "s").agg(F.sum("n").alias("n")).toArrow()
    label, code, n = found.column(0).to_numpy(), found.column(1).to_numpy(), found.column(2).to_numpy()
    counts = {}
    for lang in np.unique(label.astype(str)) if len(label) else ():
        own = label == lang
        counts[str(lang)] = code[own].view(np.uint64), n[own].astype(np.float64)
    return train(counts, order) if counts else None


def identify(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = (), required: bool = False, **parameters: int) -> DataFrame:
    """One row per document row: ``doc_id, held_out, lang_pred, score`` (and ``keep``).

    ``score`` is the share of the winning language in the text's probability,
    from 0 to 1. A text that is null or has no letter is ``und`` with score 0, as
    is every text if nothing could be learnt; with ``required`` that is an error
    where there are texts. Ties go to the label that sorts first. A null id is not
    held out and not learnt from. Repeated rows each keep a row; columns outside
    ``keep`` are not returned; those named in ``keep`` come after the result's own.
    Bytes that are not UTF-8 are scored like any others and are no letters.
    """
    learnt = fit(documents, id_col=id_col, text_col=text_col, lang_col=lang_col, **parameters)
    if learnt is None and required and documents.filter(F.length(text_col) > 0).head(1):
        raise ValueError("no labelled documents to learn languages from")
    model = documents.sparkSession.sparkContext.broadcast(learnt)
    rows = text_batches(documents).select(
        F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("binary").alias("body"), *(F.col(c) for c in keep)
    )

    def run(batches):
        for batch in batches:
            found = [classify(model.value, b.as_py()) for b in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), *batch.columns[3:]],
                names,
            )

    fields = [
        T.StructField("doc_id", documents.schema[id_col].dataType),
        T.StructField("held_out", T.BooleanType()),
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
    schema = T.StructType([*fields, *(documents.schema[c] for c in keep)])
    names = schema.names
    return rows.mapInArrow(run, schema)

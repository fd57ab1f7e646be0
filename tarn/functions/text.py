"""Text functions as column expressions; Python only for Unicode normal forms."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The words that tell a query's intent.
NAVIGATIONAL = ("site:", "page", "homepage", "official", "url")
QUESTION = ("what", "why", "how", "when", "who", "where", "explain", "define", "compare")
TRANSACTIONAL = ("download", "buy", "install", "get", "purchase", "subscribe")
CACHE_PREFIX = "tarn:"
#: White space as Python has it: Java's Unicode class and four separators.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def tokenize(text: Column) -> Column:
    """Runs of letters, numbers and underscores, lower-cased."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), F.lower)


def approx_tokens(text: Column) -> Column:
    """A quarter of the code points, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def sentences(text: Column) -> Column:
    """Sentences end at ``.!?`` before white space and an ASCII capital."""
    return F.filter(F.split(collapse(text), r"(?<=[.!?])\s+(?=[A-Z])", -1), lambda s: s != "")


@F.pandas_udf(T.StringType())
def normalize_query(text: pd.Series) -> pd.Series:
    """NFC, white space collapsed, case-folded; null stays null."""
    space = re.compile(r"\s+")
    return text.map(lambda t: t if t is None else space.sub(" ", unicodedata.normalize("NFC", t).strip()).casefold())


def classify_intent(normalized: Column) -> Column:
    """``navigational`` by substring, else ``informational`` by prefix, else
    ``transactional`` by token, else ``informational``."""
    navigational = F.lit(False)
    for w in NAVIGATIONAL:
        navigational = navigational | normalized.contains(w)
    transactional = F.arrays_overlap(F.split(normalized, " "), F.array(*map(F.lit, TRANSACTIONAL)))
    return (
        F.when(navigational, "navigational")
        .when(normalized.rlike("^(" + "|".join(QUESTION) + ")"), "informational")
        .when(transactional, "transactional")
        .otherwise("informational")
    )


def expand_query(text: Column) -> Column:
    """The query itself is its only variant."""
    return F.array(text)


def text_key(text: Column) -> Column:
    return F.sha2(text, 256)


def html_id(source: Column) -> Column:
    return F.concat(F.lit("html-"), F.substring(F.sha1(source), 1, 12))


def json_string(text: Column) -> Column:
    """A JSON string as an ASCII writer puts it: other characters are ``\\uXXXX``, in two halves beyond 16 bits."""
    code = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))
    short = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}

    def character(c):
        n = F.ascii(c)  # the code point, beyond ASCII too
        out = F.when(n > 0xFFFF, F.concat(code(F.shiftright(n - 0x10000, 10) + 0xD800), code((n - 0x10000).bitwiseAND(0x3FF) + 0xDC00)))
        for plain, escaped in short.items():
            out = out.when(c == plain, escaped)
        return out.when((n < 32) | (n > 126), code(n)).otherwise(c)

    safe = ~text.rlike(r'[^ !#-\[\]-~]')
    every = F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), character), "")
    return F.concat(F.lit('"'), F.when(safe, text).otherwise(every), F.lit('"'))


def json_plain(value: Column) -> Column:
    """A whole number or a truth value as JSON."""
    return F.coalesce(value.cast("string"), F.lit("null"))


def cache_key(*parts: Column | str | int | float | bool | None) -> Column:
    """Prefixed SHA-256 (32 digits) of the parts as a JSON list. Columns hold JSON, as of
    ``json_string`` and ``json_plain``; other parts are constants."""
    made = [F.coalesce(p, F.lit("null")) if isinstance(p, Column) else F.lit(json.dumps(p)) for p in parts]
    return F.concat(F.lit(CACHE_PREFIX), F.substring(F.sha2(F.concat(F.lit("["), F.concat_ws(", ", *made), F.lit("]")), 256), 1, 32))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` evaluated once, also where ``then`` uses it in a loop."""
    return F.transform(F.array(value), then)[0]


def l2_normalize(vector: Column) -> Column:
    """The vector by its length; a zero vector stays."""

    def by_length(wide):
        return let(F.sqrt(dot(wide, wide)), lambda n: F.when(n > 0, F.transform(wide, lambda x: x / n)).otherwise(wide))

    return let(F.transform(vector, lambda x: x.cast("double")), by_length)


def run_once(encode):
    """A Python function of whole texts that no filter on its result may take along.

    Filters on a vector, also those that Spark infers from an explode, are pushed down to the
    texts otherwise, and with them a second run of the function in workers of its own.
    """
    return encode.asNondeterministic()


def hashing_batches(dim: int):
    """A function from batches of token lists to batches of vectors, for use in Python workers."""

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bucket: dict[str, int] = {}
        for lists in batches:
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat, counts = lists.flatten(), np.zeros(len(lists) * dim)
            row = np.repeat(np.arange(len(lists), dtype=np.int32), sizes)
            # Tokens stay in Arrow, some at a time; only distinct ones become strings of Python.
            for a in range(0, len(flat), 200_000):
                coded = flat.slice(a, 200_000).dictionary_encode()
                if len(bucket) > 200_000:
                    bucket.clear()
                distinct = coded.dictionary.to_pylist()
                for t in distinct:
                    if t not in bucket:
                        bucket[t] = int(hashlib.md5(t.encode()).hexdigest()[:7], 16) % dim
                at = row[a : a + 200_000] * np.int64(dim) + np.array([bucket[t] for t in distinct], dtype=np.int64)[coded.indices.to_numpy()]
                first, last = int(at[0]) // dim * dim, int(row[min(a + 200_000, len(row)) - 1] + 1) * dim
                counts[first:last] += np.bincount(at - first, minlength=last - first)
            counts = counts.reshape(len(lists), dim)
            length = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
            counts /= np.where(length > 0, length, 1.0)
            yield pa.ListArray.from_arrays(np.arange(len(lists) + 1, dtype=np.int32) * dim, counts.ravel())

    return encode


def hashing_vector(text: Column, dim: int = 64) -> Column:
    """Token counts in ``dim`` buckets by MD5 (first seven hex digits), L2-normalised."""
    return run_once(F.arrow_udf(hashing_batches(dim), T.ArrayType(T.DoubleType())))(tokenize(text))

"""Packing by concatenating and cutting.

All documents' tokens form one stream, cut every ``length`` tokens. Pass one
encodes the documents once and writes their ids with the running token count in
their partition. The partitions' totals (one number each) give every partition's
place in the stream by a prefix sum; pass two adds it and cuts each document at
the fixed windows. A document that crosses a window's border gives a piece per
window. No row is shuffled and no task needs another's rows.
"""

from __future__ import annotations

import json
import re
import sys
import types
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.runtime import materialise, text_batches


class WordEncoder:
    """Ids of texts by a ``tokenizers`` file, as bytes.

    A tokenizer that folds case, drops white space, cuts the rest into pieces by a
    pattern and encodes each piece by itself (``NORMALIZER``, ``SPLITTER`` and a BPE
    model that marks the ends of pieces) is taken at its pieces: they recur, and are
    encoded once while they are held. A text of Latin script, where lower case and
    normal form are a matter of single characters, is cut into pieces here; new
    pieces are encoded in one call and told apart by the tokens that end a piece.
    Any other text is cut at spaces and line ends, which the tokenizer never joins
    across, and its new parts are encoded one by one. About ``hold`` pieces are held
    at most, of up to ``piece_chars`` characters each, in two generations: when the
    younger is half of that, it becomes the older, from which pieces come back when
    asked.

    Any other tokenizer encodes whole texts.
    """

    # The parts of a tokenizer file that the shortcut stands for.
    NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
    SPLITTER = {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    }
    #: Characters beyond plain Latin script, and those that are so in lower case.
    OTHER = re.compile("[\x1c-\x1f\x85\u0130\u0250-\U0010ffff%s]" % "".join(c for c in map(chr, range(0x80, 0x250)) if max(c.lower()) >= "\u0250"))
    #: The tokenizer's pattern, written out for lower-cased ASCII and Latin script.
    ASCII = re.compile(r"[a-z]+|'(?:[stmd]|re|ve|ll)|[0-9]|[^\sa-z0-9]+")
    PIECE = re.compile(r"[a-zªµºÀ-ÖØ-öø-ɏ]+|'(?:[stmd]|re|ve|ll)|[0-9²³¹¼½¾]|[^\sa-z0-9ªµºÀ-ÖØ-öø-ɏ²³¹¼½¾]+")

    def __init__(self, path: str, hold: int = 400_000, piece_chars: int = 64):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        parts = json.loads(self.tokenizer.to_str())
        model = parts["model"]
        added = [t["content"] for t in parts["added_tokens"]]
        self.by_piece = (
            (parts["normalizer"], parts["pre_tokenizer"]) == (self.NORMALIZER, self.SPLITTER)
            and (model["type"], model.get("end_of_word_suffix"), model.get("dropout")) == ("BPE", "</w>", None)
            # Strings that are one token stand for themselves in any text that holds this mark.
            and all(t.startswith("<|") and not re.search(r"\s", t) for t in added)
        )
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u4")
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.hold, self.piece_chars = hold, piece_chars
        self.held: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    @classmethod
    def of_worker(cls, path: str) -> WordEncoder:
        """One encoder per Python worker and file, kept from task to task."""
        cache = sys.modules.setdefault("_tarn_word_encoders", types.ModuleType("_tarn_word_encoders")).__dict__
        if path not in cache:
            cache[path] = cls(path)
        return cache[path]

    def _direct(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype=self.dtype).tobytes() for x in got]

    def _together(self, pieces: list[str]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode(" ".join(pieces), add_special_tokens=False).ids, dtype=self.dtype)
        stops = (np.flatnonzero(self.ends[ids]) + 1) * self.dtype.itemsize
        if len(stops) != len(pieces):
            return self._direct(pieces)
        data, stops = ids.tobytes(), stops.tolist()
        return [data[a:b] for a, b in zip([0, *stops], stops)]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_piece:
            return self._direct([t or "" for t in texts])
        if len(self.held) > self.hold // 2:
            self.older, self.held = self.held, {"": b""}
        held = self.held
        out, later, plain, other = [], [], set(), set()
        for text in texts:
            if not text:
                out.append(b"")
                continue
            latin = "<|" not in text and not self.OTHER.search(text)
            if latin:
                pieces = (self.ASCII if text.isascii() else self.PIECE).findall(text.lower())
            else:
                pieces = text.replace("\n", " ").split(" ")
            found = list(map(held.get, pieces))
            if None in found:
                missing = [p for p, x in zip(pieces, found) if x is None]
                (plain if latin else other).update(missing)
                later.append((len(out), found, missing))
                out.append(None)
            else:
                out.append(b"".join(found))
        long: dict[str, bytes] = {}
        for asked, encode in ((plain, self._together), (other, self._direct)):
            again = asked.intersection(self.older)
            held.update((p, self.older[p]) for p in again)
            new = [p for p in asked - again if p not in held]
            for a in range(0, len(new), 20_000):
                some = new[a : a + 20_000]
                for piece, ids in zip(some, encode(some)):
                    (held if len(piece) <= self.piece_chars else long)[piece] = ids
        for at, found, missing in later:
            rest = iter([held[p] if p in held else long[p] for p in missing])
            out[at] = b"".join([next(rest) if x is None else x for x in found])
        return out


def encoded(documents: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, ids, n, part, before``: ids with the end id, their number, the
    partition, and the tokens before the document in it."""
    docs = text_batches(documents).select(F.col(id_col).alias("doc_id"), F.make_valid_utf8(F.col(text_col)).alias("text"))

    def encode(batches):
        encoder = WordEncoder.of_worker(tokenizer_path)
        end = np.array([end_id], dtype=encoder.dtype).tobytes()
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                piece = batch.slice(at, 1024)
                ids = [x + end for x in encoder.encode_all(piece.column(1).to_pylist())]
                n = [len(x) // encoder.dtype.itemsize for x in ids]
                starts = list(accumulate(n, initial=before))
                before = starts.pop()
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(ids, pa.binary()), pa.array(n, pa.int64()), pa.array([part] * len(n), pa.int32()), pa.array(starts, pa.int64())],
                    ["doc_id", "ids", "n", "part", "before"],
                )

    schema = T.StructType(
        [
            T.StructField("doc_id", documents.schema[id_col].dataType),
            T.StructField("ids", T.BinaryType()),
            T.StructField("n", T.LongType()),
            T.StructField("part", T.IntegerType()),
            T.StructField("before", T.LongType()),
        ]
    )
    return docs.mapInArrow(encode, schema)


def padded_length(tokens: int, length: int) -> int:
    """A full window, unless what it holds is a power of two long."""
    return tokens if tokens > 0 and tokens & (tokens - 1) == 0 else length


def pack(documents: DataFrame, *, tokenizer_path: str, length: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset, padded``.

    ``ids`` are little-endian unsigned 32-bit ids, ``start`` the document's ids
    before the piece, ``padded`` the padded length of its sequence. All sequences
    but the last are full.

    A null or empty text is the end id alone; bytes that are not UTF-8 become U+FFFD. Repeated rows and null ids are
    documents like any other, in the order in which the partitions hold them.
    Other columns are neither read nor returned; an empty table has no pieces.
    """
    spark = documents.sparkSession
    stream = materialise(encoded(documents, tokenizer_path, end_id, id_col, text_col), "tokens")
    totals = sorted((r.part, r.n) for r in stream.groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("n")).collect())
    sums = list(accumulate((n for _, n in totals), initial=0))
    total = sums[-1]
    final = padded_length(total % length, length) if total % length else length
    # A row per partition of the first pass.
    bases = spark.createDataFrame([(p, base) for (p, _), base in zip(totals, sums)], "part int, base long")
    placed = stream.join(F.broadcast(bases), "part").select("doc_id", "ids", "n", (F.col("base") + F.col("before")).alias("first"))

    first, end = F.col("first"), F.col("first") + F.col("n")
    windows = F.sequence(F.floor(first / length), F.floor((end - 1) / length))

    def piece(s):
        low, high = F.greatest(first, s * length), F.least(end, (s + 1) * length)
        ids = F.substring("ids", ((low - first) * 4 + 1).cast("int"), ((high - low) * 4).cast("int"))
        padded = F.when(s == total // length, final).otherwise(length)
        return F.struct((low - first).alias("start"), (high - low).alias("length"), ids.alias("ids"), s.alias("sequence_id"), (low - s * length).alias("offset"), padded.cast("int").alias("padded"))

    # Cut inside the array, so that a long document is copied once, not once a piece.
    cut = placed.select("doc_id", F.col("n").alias("doc_tokens"), F.explode(F.transform(windows, piece)).alias("p"))
    return cut.select("doc_id", "p.start", "p.length", "p.ids", "doc_tokens", "p.sequence_id", "p.offset", "p.padded")

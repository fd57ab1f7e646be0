"""Text functions and the chunker against plain Python models."""

import hashlib
import json
import re
import tracemalloc
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarn.functions import text as fn
from tarn.functions.html import html_text
from tarn.operators.chunk import chunk_documents, hard_split
from tarn.runtime import table


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", expression(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


NORMAL = ["  Hello   World  ", "café", "STRASSE", "Straße", "a  b", "", None]


def test_normalize_query(spark):
    want = [v if v is None else re.sub(r"\s+", " ", unicodedata.normalize("NFC", v).strip()).casefold() for v in NORMAL]
    assert column(spark, NORMAL, fn.normalize_query) == want
    assert want[2] == want[3] == "strasse"


@pytest.mark.parametrize(
    "text, intent",
    [
        ("curl tutorial", "navigational"),
        ("howl download", "informational"),
        ("forget me", "informational"),
        ("get page", "navigational"),
        ("buy shoes", "transactional"),
        ("what is it", "informational"),
    ],
)
def test_intent(spark, text, intent):
    assert column(spark, [text], lambda c: fn.classify_intent(fn.normalize_query(c))) == [intent]


def test_tokenize(spark):
    assert column(spark, ["a_b 12½ Foo-bar", "😀", ""], fn.tokenize) == [["a_b", "12½", "foo", "bar"], [], []]


def test_sentences(spark):
    got = column(spark, ["A. B. C", "fin. École", "x.Y", "?! Yes", " \n "], fn.sentences)
    assert got == [["A.", "B.", "C"], ["fin. École"], ["x.Y"], ["?!", "Yes"], []]


def test_approx_tokens(spark):
    assert column(spark, ["", "abc", "a" * 9], fn.approx_tokens) == [1, 1, 2]


def test_cache_key(spark):
    df = spark.createDataFrame([("é x", 10, True)], "q string, k int, r boolean")
    got = df.select(fn.cache_key("search", fn.json_string(F.col("q")), fn.json_plain(F.col("k")), fn.json_plain(F.col("r")))).first()[0]
    assert got == fn.CACHE_PREFIX + hashlib.sha256(json.dumps(["search", "é x", 10, True]).encode()).hexdigest()[:32]


def test_json_strings(spark):
    texts = ["plain ~ text", "", 'q"b\\s/', "\n\r\t\b\f\x00\x1f\x7f", "é ß 日 \u2028", "😀a\U0010ffff", None]
    got = column(spark, texts, fn.json_string)
    assert got == [None if t is None else json.dumps(t) for t in texts]


def test_html():
    page = "<title>T</title><nav>x<b>y</b></nav>a &amp; b<!-- c -->d<p>e<script>var t='</p>';</script>"
    assert html_text(page) == "T\na & b\nd\ne"
    assert html_text("<nav>never closed") == "" and html_text(None) == ""


class Chunker:
    """The fold, one sentence at a time."""

    def __init__(self, size, overlap):
        self.size, self.overlap = size, overlap

    def tokens(self, s):
        return max(1, len(s) // 4)

    def carry(self, held):
        out, total = [], 0
        if self.overlap > 0:
            for s in reversed(held):
                if out and total + self.tokens(s) > self.overlap:
                    break
                out.insert(0, s)
                total += self.tokens(s)
        return out

    def pieces(self, sentence):
        line = ""
        out, n = [], 0
        for w in sentence.split():
            if line and n + len(w) + 1 > 4 * self.size:
                out.append(line)
                line, n = "", 0
            line = f"{line} {w}" if line else w
            n += len(w) + 1
        return out + [line] if line else out

    def chunks(self, text):
        flat = " ".join(text.split())
        sentences = [s for s in re.split(r"(?<=[.!?])\s+(?=[A-Z])", flat) if s]
        out, held = [], []
        for s in sentences:
            total = sum(map(self.tokens, held))
            if self.tokens(s) > self.size:
                if held:
                    out.append(" ".join(held))
                    held = self.carry(held)
                out += self.pieces(s)
                continue
            if total + self.tokens(s) > self.size:
                out.append(" ".join(held))
                held = self.carry(held)
            held.append(s)
        return out + [" ".join(held)] if held else out


EDGE = ["", " ", "One. Two.", "Short. " + "x" * 200 + " y. Then more words here.", "w " * 300, "A b. " * 40, "Ab cd ef. " + "Long " * 60 + ". " + "More " * 70]


@pytest.mark.parametrize("size, overlap", [(512, 32), (24, 6), (10, 0), (15, 5)])
def test_chunks(spark, sf_dir, size, overlap):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    edge = spark.createDataFrame([(-i - 1, t) for i, t in enumerate(EDGE)], docs.schema)
    texts = dict(docs.unionByName(edge).collect())
    got = {r.chunk_id: r.text for r in chunk_documents(docs.unionByName(edge), size, overlap).collect()}
    model = Chunker(size, overlap)
    assert got == {f"{d}::{i}": c for d, t in texts.items() for i, c in enumerate(model.chunks(t))}


def test_hard_split(spark):
    got = column(spark, ["word " * 100, "x" * 99, ""], lambda c: hard_split(c, 10))
    assert got == [Chunker(10, 0).pieces("word " * 100), ["x" * 99], []]


def test_overlap_must_be_smaller(spark):
    with pytest.raises(ValueError):
        chunk_documents(spark.createDataFrame([("a", "b")], "doc_id string, text string"), 5, 5)


def peak(run):
    tracemalloc.start()
    out = run()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, most / 2**20


def test_encoder_holds_no_string_for_each_token():
    """Two million tokens in a batch; as strings of Python they would take more than 100 MB."""
    words = pa.array([f"word{i}" for i in range(1000)])
    flat = words.take(pa.array(np.arange(2_000_000) % 1000))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 2_000_001, 1000), pa.int32()), flat)
    (vectors,), most = peak(lambda: list(fn.hashing_batches(64)(iter([lists]))))
    assert len(vectors) == 2000 and most < 40
    want = np.bincount([int(hashlib.md5(f"word{i}".encode()).hexdigest()[:7], 16) % 64 for i in range(1000)], minlength=64)
    assert np.allclose(vectors[1999].as_py(), want / np.linalg.norm(want))
    odd = pa.array([["a", "a", "b"], [], None, ["b"]], pa.list_(pa.string()))
    (found,) = fn.hashing_batches(64)(iter([odd]))
    assert [round(sum(x * x for x in v), 9) for v in found.to_pylist()] == [1, 0, 0, 1]


def test_encoder_holds_no_more_for_more_batches_of_new_words():
    def batches(n):
        for b in range(n):
            yield pa.ListArray.from_arrays(pa.array([0, 100_000], pa.int32()), pa.array([f"{b}word{i}" for i in range(100_000)]))

    few, many = (peak(lambda: sum(len(v) for v in fn.hashing_batches(64)(batches(n)))) for n in (3, 6))
    assert (few[0], many[0]) == (3, 6) and many[1] < 1.2 * few[1]


def test_html_is_read_a_page_at_a_time():
    from tarn.functions.html import extract_html

    pages = pa.array(["<script>" + "x" * 20_000 + "</script><p>kept</p>"] * 1000 + [None])
    found, most = peak(lambda: extract_html.func(pages))
    assert found.to_pylist() == ["kept"] * 1000 + [""] and most < 5

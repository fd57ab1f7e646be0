"""Sentence-aligned chunks with overlap, as one fold over a document's sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.text import SPACE, approx_tokens, sentences


def hard_split(sentence: Column, max_tokens: int) -> Column:
    """Pieces of whole words up to ``4 * max_tokens`` characters, a space counted after each word."""
    budget = 4 * max_tokens
    words = F.filter(F.split(sentence, SPACE, -1), lambda w: w != "")
    start = F.struct(
        F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("held"), F.lit(0).alias("n")
    )

    def step(acc, w):
        size = F.length(w).cast("int") + 1
        full = (acc["n"] + size > budget) & (F.size(acc["held"]) > 0)
        return F.struct(
            F.when(full, F.concat(acc["out"], F.array(F.array_join(acc["held"], " ")))).otherwise(acc["out"]).alias("out"),
            F.when(full, F.array(w)).otherwise(F.concat(acc["held"], F.array(w))).alias("held"),
            F.when(full, size).otherwise(acc["n"] + size).alias("n"),
        )

    def finish(acc):
        return F.when(F.size(acc["held"]) > 0, F.concat(acc["out"], F.array(F.array_join(acc["held"], " ")))).otherwise(acc["out"])

    return F.aggregate(words, start, step, finish)


def _carry(held: Column, overlap: int) -> Column:
    """The longest run of last sentences within ``overlap`` tokens, at least one sentence."""
    none = F.array().cast("array<string>")
    if overlap <= 0:
        return none
    # Token counts are at least one, so sums over suffixes grow with their length.
    fitting = F.filter(F.sequence(F.lit(1), F.size(held)), lambda m: _tokens(F.slice(held, -m, m)) <= overlap)
    m = F.greatest(F.lit(1), F.size(fitting))
    return F.when(F.size(held) > 0, F.slice(held, -m, m)).otherwise(none)


def _tokens(held: Column) -> Column:
    return F.aggregate(held, F.lit(0), lambda n, s: n + approx_tokens(s))


def chunks(text: Column, max_tokens: int = 512, overlap_tokens: int = 32) -> Column:
    """The chunks of a text. A sentence over the budget is cut into pieces of its
    own, while the overlap before it stays pending."""
    if overlap_tokens >= max_tokens:
        raise ValueError("overlap_tokens must be less than max_tokens")
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("out"), none.alias("held"), F.lit(0).alias("n"))

    def step(acc, s):
        t = approx_tokens(s)
        large = t > max_tokens
        flush = (large & (F.size(acc["held"]) > 0)) | (~large & (acc["n"] + t > max_tokens))
        carried = F.when(flush, _carry(acc["held"], overlap_tokens)).otherwise(acc["held"])
        emitted = F.when(flush, F.array(F.array_join(acc["held"], " "))).otherwise(none)
        pieces = F.when(large, hard_split(s, max_tokens)).otherwise(none)
        carried_n = F.when(flush, _tokens(_carry(acc["held"], overlap_tokens))).otherwise(acc["n"])
        return F.struct(
            F.when(flush | large, F.concat(acc["out"], emitted, pieces)).otherwise(acc["out"]).alias("out"),
            F.when(large, carried).otherwise(F.concat(carried, F.array(s))).alias("held"),
            F.when(large, carried_n).otherwise(carried_n + t).alias("n"),
        )

    def finish(acc):
        return F.when(F.size(acc["held"]) > 0, F.concat(acc["out"], F.array(F.array_join(acc["held"], " ")))).otherwise(acc["out"])

    return F.aggregate(sentences(text), start, step, finish)


def chunk_documents(documents: DataFrame, max_tokens: int = 512, overlap_tokens: int = 32, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``chunk_id, doc_id, pos, text``; documents without sentences have no chunks."""
    return documents.select(
        F.col(id_col).alias("doc_id"), F.posexplode(chunks(F.coalesce(F.col(text_col), F.lit("")), max_tokens, overlap_tokens)).alias("pos", "text")
    ).select(F.concat(F.col("doc_id").cast("string"), F.lit("::"), F.col("pos").cast("string")).alias("chunk_id"), "doc_id", "pos", "text")

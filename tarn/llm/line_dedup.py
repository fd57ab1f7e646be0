"""Line deduplication with DataFrame functions only.

Lines are exploded as (document, position, hash of the normalised line) without
their text. Distinct documents are counted per hash; positions of lines over the
threshold go back to their document, which is then cut and joined by position.

Skew: the distinct count first aggregates by (hash, document), so a line that a
third of all documents share is spread, and then sums partial counts. The table
of repeated lines has a row per hash and grows with the corpus, so the joins are
sort-merge joins at every size, whose skewed partitions adaptive execution
splits. Positions are gathered per document, so a group is never larger than its
document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.runtime import materialise

#: What a key loses at both ends, and the letters that it folds.
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def dedup_lines(
    documents: DataFrame,
    *,
    min_chars: int = 40,
    min_documents: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document row: ``doc_id, n_lines, n_dropped, text`` (and ``keep``).

    A line whose key has at least ``min_chars`` code points and occurs in at
    least ``min_documents`` distinct documents is dropped from all documents but
    the one with the largest id. Repeats inside that document stay.

    Null and empty texts are one empty line. A document is told by its id:
    repeated rows of one id count once, and each row is cut alike. A null id is
    no document for the count and never the one that keeps a line. Columns outside
    ``keep`` are neither read nor returned; empty input gives an empty result.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    kept = F.struct(*(F.col(c) for c in keep)) if keep else F.lit(None)
    docs = documents.select(F.col(id_col).alias("doc_id"), body.alias("text"), kept.alias("kept")).withColumn("print", F.xxhash64("text"))
    lines = F.split("text", "\n", -1)

    exploded = docs.select("doc_id", "print", F.posexplode(lines).alias("pos", "line")).withColumn(
        "key", F.btrim("line", F.lit(BLANK))
    )
    keyed = exploded.filter(F.length("key") >= min_chars).select(
        "doc_id", "print", "pos", F.unhex(F.md5(F.translate("key", UPPER, LOWER))).alias("hash")
    )
    keyed = materialise(keyed, "line-keys")

    repeated = (
        keyed.groupBy("hash")
        .agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper"))
        .filter(F.col("n") >= min_documents)
        .select("hash", "keeper")
    )
    # Written, so that both sides of the join are plain exchanges, which adaptive
    # execution can split where a hash is hot.
    repeated = materialise(repeated, "repeated-lines")
    cut = (
        keyed.join(repeated.hint("merge"), "hash")
        .filter(F.col("doc_id").isNull() | (F.col("doc_id") != F.col("keeper")))
        .groupBy("doc_id", "print")
        .agg(F.sort_array(F.collect_set("pos")).alias("cut"))
    )
    cut = materialise(cut, "line-cuts")

    # Kept lines are the runs between cut positions: work in proportion to the lines.
    ends = F.concat(F.array(F.lit(-1)), F.col("cut"), F.array(F.size("lines")))
    runs = F.transform(
        F.arrays_zip(F.slice("ends", 1, F.size("ends") - 1).alias("a"), F.slice("ends", 2, F.size("ends") - 1).alias("b")),
        lambda x: F.slice("lines", x["a"] + 2, x["b"] - x["a"] - 1),
    )
    joined = docs.alias("d").join(
        cut.alias("c").hint("merge"), F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.print") == F.col("c.print")), "left"
    )
    return (
        joined.select("d.doc_id", "d.text", "d.kept", "c.cut")
        .withColumn("lines", lines)
        .withColumn("ends", F.when(F.col("cut").isNotNull(), ends))
        .select(
            "doc_id",
            F.size("lines").cast("long").alias("n_lines"),
            F.coalesce(F.size("cut"), F.lit(0)).cast("long").alias("n_dropped"),
            F.when(F.col("cut").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(runs), "\n")).alias("text"),
            *(F.col("kept")[c].alias(c) for c in keep),
        )
    )

"""File sources and sinks: JSON lines, HTML and PDF files, query sets, index tables."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.functions.html import html_text
from tarn.functions.text import html_id
from tarn.runtime import materialise


def parse_json_lines(lines: DataFrame, *, value: str = "value", id_field: str = "id", text_field: str = "text", where=None) -> DataFrame:
    """``doc_id, text, metadata`` from lines of JSON objects; blank lines are dropped.

    A line that is not an object, or that lacks the id or the text, fails the
    query with its place. Id and text are written as strings (a JSON null as
    ``None``); all other fields stay, as JSON, in the map ``metadata``.
    """
    where = F.lit("line") if where is None else where
    line = F.trim(F.col(value))
    parsed = lines.filter(line != "").select(
        line.alias("line"), where.alias("place"), F.from_json(line, "map<string,string>").alias("fields"), F.get_json_object(line, "$").alias("whole")
    )
    bad = F.col("fields").isNull() | F.col("whole").isNull() | ~F.col("line").startswith("{")
    checked = parsed.withColumn(
        "fields", F.when(bad, F.raise_error(F.concat(F.col("place"), F.lit(": invalid JSON"))).cast("map<string,string>")).otherwise(F.col("fields"))
    )

    def required(name: str):
        missing = ~F.map_contains_key("fields", name)
        fail = F.raise_error(F.concat(F.col("place"), F.lit(f": missing field {name}"))).cast("string")
        return F.when(missing, fail).otherwise(F.coalesce(F.col("fields")[name], F.lit("None")))

    rest = F.map_filter("fields", lambda k, v: ~k.isin(id_field, text_field))
    return checked.select(required(id_field).alias("doc_id"), required(text_field).alias("text"), rest.alias("metadata"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value, file, line`` of text files; lines count from 1 in their file.

    A split's lines have consecutive numbers, so a line's place is its place in the
    split and the lines of the file's earlier splits. Those come from a pass that
    counts lines: a row for each split, and no text is shuffled.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")
    )
    splits = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")
    splits = materialise(splits.select("file", "block", "first", before.alias("before")), "splits")
    return lines.join(splits, ["file", "block"]).select("value", "file", (F.col("id") - F.col("first") + F.col("before") + 1).alias("line"))


def read_jsonl(spark: SparkSession, path: str, *, numbered: bool = False, **fields: str) -> DataFrame:
    """Documents of JSON line files. An error names the file, and with ``numbered`` the
    line, which takes a pass that counts lines first."""
    if numbered:
        lines = numbered_lines(spark, path)
        return parse_json_lines(lines, where=F.concat("file", F.lit(":"), F.col("line").cast("string")), **fields)
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"))
    return parse_json_lines(lines, where=F.col("file"), **fields)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def read_doc_store(spark: SparkSession, path: str) -> DataFrame:
    """``chunk_id, doc_id, text`` of a chunk store; the last line of a chunk counts.

    Lines are ordered by file and by their place in it; a file is read whole.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("at", "line"))
    rows = files.filter(F.trim("line") != "").select("file", "at", F.from_json("line", "chunk_id string, doc_id string, text string").alias("r"))
    last = rows.groupBy("r.chunk_id").agg(F.max_by("r", F.struct("file", "at")).alias("r"))
    return last.select("r.chunk_id", "r.doc_id", "r.text")


def read_query_set(spark: SparkSession, path: str) -> DataFrame:
    """``query, relevant``; no judgements are an empty array."""
    rows = spark.read.schema("query string, relevant array<string>").json(path)
    return rows.filter(F.col("query").isNotNull()).select("query", F.coalesce("relevant", F.array().cast("array<string>")).alias("relevant"))


def read_html(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, text`` of HTML files: the id is the file's name without its suffix.
    Bytes that are not UTF-8 are ignored."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def parse(frames):
        for pdf in frames:
            stems = pdf["path"].map(lambda p: p.rsplit("/", 1)[-1].rsplit(".", 1)[0])
            yield pd.DataFrame({"doc_id": stems, "text": pdf["content"].map(lambda b: html_text(bytes(b).decode("utf-8", "ignore")))})

    return files.mapInPandas(parse, "doc_id string, text string")


def html_strings(df: DataFrame, source: str) -> DataFrame:
    """``doc_id, text`` of a column of HTML; the id is made of its SHA-1."""
    from tarn.functions.html import extract_html

    return df.select(html_id(F.col(source)).alias("doc_id"), extract_html(F.col(source)).alias("text"))


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, text`` of PDF files, pages joined by a blank line. Needs ``pypdf``;
    a page that fails, or has no text, is empty."""
    import importlib.util

    if importlib.util.find_spec("pypdf") is None:
        raise ModuleNotFoundError("reading PDF files needs pypdf", name="pypdf")
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def parse(frames):
        import io

        from pypdf import PdfReader

        def page_text(page):
            try:
                return page.extract_text() or ""
            except Exception:
                return ""

        for pdf in frames:
            stems = pdf["path"].map(lambda p: p.rsplit("/", 1)[-1].rsplit(".", 1)[0])
            texts = pdf["content"].map(lambda b: "\n\n".join(map(page_text, PdfReader(io.BytesIO(bytes(b))).pages)))
            yield pd.DataFrame({"doc_id": stems, "text": texts})

    return files.mapInPandas(parse, "doc_id string, text string")


def save_index(spark: SparkSession, path: str, kind: str, tables: dict[str, DataFrame], **parameters) -> None:
    """Tables of an index below ``path``, with a manifest of its kind and parameters."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    manifest = json.dumps({"kind": kind, "tables": sorted(tables), "parameters": parameters})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load_index(spark: SparkSession, path: str) -> tuple[str, dict[str, DataFrame], dict]:
    """Kind, tables and parameters of a saved index."""
    kept = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if kept["kind"] not in ("flat", "hnsw", "ivf", "bm25"):
        raise ValueError(f"unknown index kind {kept['kind']}")
    return kept["kind"], {t: spark.read.parquet(f"{path}/{t}") for t in kept["tables"]}, kept["parameters"]

"""Files in and out, and streams."""

import json

import pytest
from pyspark.sql import functions as F

from tarn.operators import dense
from tarn.plans import catalogue
from tarn.runtime import shared_dir, table
from tarn.sources import files
from tarn.streaming import ingest


def test_jsonl(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"id": 7, "text": "x", "k": {"n": 1}, "s": "t"}\n\n  \n{"id": "b", "text": null}\n')
    rows = {r.doc_id: r for r in files.read_jsonl(spark, str(path)).collect()}
    assert rows["7"].text == "x" and json.loads(rows["7"].metadata["k"]) == {"n": 1} and rows["7"].metadata["s"] == "t"
    assert rows["b"].text == "None" and rows["b"].metadata == {}


@pytest.mark.parametrize("line, says", [("{bad", "invalid JSON"), ('{"id": 1}', "missing field text"), ('["a"]', "invalid JSON")])
def test_jsonl_fails(spark, tmp_path, line, says):
    (tmp_path / "b.jsonl").write_text(line + "\n")
    with pytest.raises(Exception, match=says):
        files.read_jsonl(spark, str(tmp_path / "b.jsonl")).collect()


def test_doc_store_and_query_set(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"chunk_id": "a::0", "doc_id": "a", "text": "old"}\n{"chunk_id": "a::0", "doc_id": "a", "text": "new"}\n')
    assert [tuple(r) for r in files.read_doc_store(spark, str(tmp_path / "s.jsonl")).collect()] == [("a::0", "a", "new")]
    (tmp_path / "q.jsonl").write_text('{"query": "x", "relevant": ["1"]}\n\n{"query": "y"}\n')
    assert sorted((r.query, r.relevant) for r in files.read_query_set(spark, str(tmp_path / "q.jsonl")).collect()) == [("x", ["1"]), ("y", [])]


def test_html_files(spark, tmp_path):
    (tmp_path / "page.html").write_bytes(b"<p>a\xff</p><footer>f</footer>b")
    assert [tuple(r) for r in files.read_html(spark, str(tmp_path / "*.html")).collect()] == [("page", "a\nb")]
    row = files.html_strings(spark.createDataFrame([("<p>x</p>",)], "h string"), "h").first()
    assert row.doc_id.startswith("html-") and len(row.doc_id) == 17 and row.text == "x"


def test_pdf_needs_a_reader(spark, tmp_path):
    try:
        import pypdf  # noqa: F401
    except ModuleNotFoundError:
        with pytest.raises(ModuleNotFoundError, match="pypdf"):
            files.read_pdf(spark, str(tmp_path))


def test_index_round_trip(spark, tmp_path):
    v = spark.createDataFrame([(i, [float(i == j) for j in range(8)]) for i in range(8)], "doc_id long, vector array<float>")
    q = v.withColumnRenamed("doc_id", "query_id")
    graph = dense.hnsw_build(v)
    files.save_index(spark, str(tmp_path / "i"), "hnsw", {"graph": graph}, dim=8, ef_search=50)
    kind, tables, parameters = files.load_index(spark, str(tmp_path / "i"))
    assert (kind, parameters) == ("hnsw", {"dim": 8, "ef_search": 50})
    key = lambda g: sorted(map(tuple, dense.hnsw_search(g, q, 2).collect()))
    assert key(tables["graph"]) == key(graph)
    files.save_index(spark, str(tmp_path / "j"), "other", {})
    with pytest.raises(ValueError):
        files.load_index(spark, str(tmp_path / "j"))


def test_streams_equal_batches(spark, sf_dir):
    streamed = catalogue.QUERIES["stream_ingest"](spark, sf_dir)
    batch = catalogue.QUERIES["chunk_documents"](spark, sf_dir).select("chunk_id", "doc_id", "pos", "digest")
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))


def test_running_counts(spark, sf_dir, tmp_path):
    stream = catalogue.stream_of(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    counted = ingest.running_counts(stream, "ts", "event_type", window="1 day")
    run = counted.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM counts").first()[0] == table(spark, sf_dir, "events").count()


def test_jsonl_errors_name_the_line(spark, tmp_path):
    row = '{"id": 1, "text": "x"}\n'
    (tmp_path / "a.jsonl").write_text(row * 700 + "\n" + "{broken\n" + row)
    (tmp_path / "b.jsonl").write_text(row * 3)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        lines = files.numbered_lines(spark, str(tmp_path)).collect()
        assert sorted(r.line for r in lines if r.file.endswith("a.jsonl")) == list(range(1, 704))
        assert sorted(r.line for r in lines if r.file.endswith("b.jsonl")) == [1, 2, 3]
        with pytest.raises(Exception, match=r"a\.jsonl:702: invalid JSON"):
            files.read_jsonl(spark, str(tmp_path), numbered=True).collect()
        assert files.read_jsonl(spark, str(tmp_path / "b.jsonl"), numbered=True).count() == 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_doc_store_round_trip(spark, tmp_path):
    rows = [("a::0", "a", "one\ntwo \"x\""), ("a::1", "a", "é")]
    files.write_jsonl(spark.createDataFrame(rows, "chunk_id string, doc_id string, text string"), str(tmp_path / "s"))
    assert sorted(map(tuple, files.read_doc_store(spark, str(tmp_path / "s")).collect())) == sorted(rows)


def test_live_index(spark, tmp_path):
    """Two runs of a stream: the second brings a document again, with another text."""
    from tarn.operators import bm25

    source, live, state = (str(tmp_path / n) for n in ("in", "live", "state"))
    schema = "doc_id long, text string"

    def arrive(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        ingest.index_stream(stream, live, state).awaitTermination()
        return ingest.live_index(spark, live)

    texts, vectors, index = arrive((1, "the cat sat"), (2, "a quick fox"))
    first = {r.chunk_id: r.vector for r in vectors.collect()}
    assert {r.chunk_id for r in texts.collect()} == first.keys() == {"1::0", "2::0"}
    texts, vectors, index = arrive((2, "a slow dog"), (3, "the cat again"))
    assert {r.chunk_id: r.text for r in texts.collect()} == {"1::0": "the cat sat", "2::0": "a slow dog", "3::0": "the cat again"}
    assert {r.chunk_id: r.vector for r in vectors.filter("chunk_id = '2::0'").collect()} == {"2::0": first["2::0"]} and vectors.count() == 3
    want = bm25.build(texts.withColumnRenamed("chunk_id", "c").select("c", "text"), id_col="c")
    assert sorted(map(tuple, index.terms.collect())) == sorted(map(tuple, want.terms.collect()))
    asked = spark.createDataFrame([(0, "dog")], "query_id long, text string")
    assert bm25.search(index, asked, 1).first().doc_id == "2::0"


def test_live_index_copies_no_rows(spark, tmp_path):
    """Without a chunk that came again the tables are read as they lie: neither an exchange nor a second copy of texts or postings."""
    import os

    source, live, state = (str(tmp_path / n) for n in ("in", "live", "state"))
    schema = "doc_id long, text string"
    held = lambda: set(os.listdir(shared_dir(spark).removeprefix("file:")))
    before = held()
    for first in (0, 50):
        spark.createDataFrame([(i, f"The cat of house {i} sat.") for i in range(first, first + 50)], schema).coalesce(1).write.mode("append").parquet(source)
        ingest.index_stream(spark.readStream.schema(schema).parquet(source), live, state).awaitTermination()
    texts, vectors, index = ingest.live_index(spark, live)
    for df, rows in ((texts, 100), (vectors, 100), (index.lengths, 100), (index.postings, 600)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString() and df.count() == rows
    # What came again, and a row for each term; no folder of chunks, postings or lengths.
    assert {n.rsplit("-", 1)[0] for n in held() - before if not n.startswith(".")} == {"arrived-again", "terms"}


def test_live_index_counts_the_text_it_keeps(spark, tmp_path):
    """A chunk that is twice in one batch has the terms of one text, the one that is kept; a document without an id has no chunk."""
    source, live, state = (str(tmp_path / n) for n in ("in", "live", "state"))
    schema = "doc_id long, text string"
    made = spark.createDataFrame([(1, "red fox"), (1, "blue birds sing"), (2, "red fox"), (2, "red fox"), (None, "lost")], schema)
    made.coalesce(1).write.parquet(source)
    ingest.index_stream(spark.readStream.schema(schema).parquet(source), live, state).awaitTermination()
    texts, vectors, index = ingest.live_index(spark, live)
    kept = {r.chunk_id: set(r.text.split()) for r in texts.collect()}
    assert kept.keys() == {"1::0", "2::0"} == {r.chunk_id for r in vectors.collect()} and vectors.count() == texts.count() == 2
    terms = {}
    for r in index.postings.collect():
        terms.setdefault(r.doc_id, []).append(r.term)
    assert {i: set(t) for i, t in terms.items()} == kept and all(len(t) == len(set(t)) for t in terms.values())
    assert {r.doc_id: r.dl for r in index.lengths.collect()} == {i: len(t) for i, t in kept.items()}

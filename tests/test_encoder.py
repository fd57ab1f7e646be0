"""The learnt encoder against a whole decomposition, and models loaded once a worker."""

import os
import random

import numpy as np
from pyspark.sql import functions as F

from tarn.operators import dense, encoder, evaluate, search


def test_directions_are_those_of_the_whole_decomposition(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(r.choices(words[(i % 6) * 40 : (i % 6) * 40 + 60], k=r.randrange(1, 60))) for i in range(400)] + [None, "", "?!"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    size, dim = 128, 8
    made = encoder.fit(frame, dim=dim, buckets=size, passes=8)
    rows = frame.orderBy("doc_id").select(encoder.buckets_of(F.col("text"), size).alias("b")).collect()
    tf = np.array([np.bincount(x.b, minlength=size) if x.b else np.zeros(size) for x in rows])
    idf = np.log((len(texts) + 1) / ((tf > 0).sum(axis=0) + 1)) + 1
    a = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0) * idf
    a /= np.maximum(np.sqrt((a * a).sum(axis=1, keepdims=True)), 1e-300)
    _, singular, right = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(made.idf, idf) and np.allclose(made.singular, singular[:dim], rtol=1e-3)
    # The first six directions, one for each kind of text, stand apart from the rest; together they span the same space.
    assert np.allclose(np.linalg.svd(made.directions[:, :6].T @ right[:6].T)[1], 1, atol=1e-3)
    want = a @ made.directions
    got = {x.doc_id: x.vector for x in made.encode(frame, "doc_id").collect()}
    want /= np.maximum(np.sqrt((want * want).sum(axis=1, keepdims=True)), 1e-300)
    assert np.allclose([got[i] for i in range(len(texts))], want) and not any(got[400]) and not any(got[402])


def test_saved_empty_and_long(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    made = encoder.fit(empty, dim=4, buckets=32)
    made.save(spark, str(tmp_path / "encoder"))
    again = encoder.Encoder.load(spark, str(tmp_path / "encoder"))
    assert np.array_equal(made.directions, again.directions) and np.array_equal(made.idf, again.idf) and not again.singular.any()
    assert made.encode(empty, "doc_id").count() == 0
    # A text longer than a piece, and words that all fall on few buckets.
    long = spark.createDataFrame([(1, "word other " * 50_000), (2, "word other"), (3, None)], "doc_id long, text string")
    made = encoder.fit(long, dim=2, buckets=8)
    v = {r.doc_id: r.vector for r in made.encode(long, "doc_id").collect()}
    assert np.allclose(v[1], v[2]) and not any(v[3])


def test_finds_by_topic_what_the_hashing_encoder_misses(spark):
    """Queries share a topic with their documents but rarely a word."""
    r = random.Random(8)
    topics = [[f"t{t}x{i}" for i in range(80)] for t in range(12)]
    common = [f"c{i}" for i in range(40)]
    text = lambda t, n: " ".join(r.choices(topics[t], k=n) + r.choices(common, k=n))
    docs = spark.createDataFrame([(i, text(i % 12, 25)) for i in range(480)], "doc_id long, text string")
    queries = spark.createDataFrame([(i, text(i % 12, 4)) for i in range(60)], "query_id long, text string")
    relevant = queries.select("query_id", F.explode(F.sequence(F.col("query_id") % 12, F.lit(479), F.lit(12))).alias("doc_id"))
    made = encoder.fit(docs, dim=16)

    def recall(encode):
        hits = dense.flat_search(encode(queries, "query_id"), encode(docs, "doc_id"), 40)
        return evaluate.recall_at_k(hits, relevant, 40).agg(F.avg("recall")).first()[0]

    hashed = recall(lambda rows, c: search.encode(rows, c, dim=16))
    assert recall(made.encode) > 0.9 > hashed + 0.3


def test_a_model_is_loaded_once_a_worker(spark, tmp_path):
    """The model comes from a file that is shipped with the job."""
    shipped = tmp_path / "model.txt"
    shipped.write_text("7")
    spark.sparkContext.addFile(str(shipped))
    loads = spark.sparkContext.accumulator(0)

    def load():
        from pyspark import SparkFiles

        loads.add(1)
        with open(SparkFiles.get("model.txt")) as f:
            return int(f.read())

    model = encoder.once_a_worker(load)

    def score(batches):
        for b in batches:
            yield b.assign(pid=os.getpid(), y=b["id"] * model())

    rows = spark.range(4000).repartition(40)
    workers = set()
    for _ in range(2):
        got = rows.mapInPandas(score, "id long, pid long, y long").collect()
        assert len(got) == 4000 and all(x.y == 7 * x.id for x in got)
        workers |= {x.pid for x in got}
    assert loads.value == len(workers) < 40

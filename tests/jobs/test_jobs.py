"""The two jobs: growing input, reruns, failures in the middle, command lines."""

import json
import logging
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import catalogue, common, feedback_triples, retrieval_run
from tarn.operators import feedback

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def files(spark, out):
    named = spark.read.schema(feedback_triples.TRIPLES).parquet(f"{out}/triples").select("day", F.input_file_name().alias("f"))
    return {r.day: r.f for r in named.groupBy("day").agg(F.min("f").alias("f")).collect()}


def mined(spark, events):
    found = feedback.triples(feedback.with_rank(feedback.from_events(events)))
    return rows(found.withColumn("day", F.substring_index("query_id", "-", -3)).select("query_id", "query_text", "pos_doc_id", "neg_doc_id", "day"))


@pytest.fixture
def events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def test_takes_only_what_is_new(spark, events, tmp_path, caplog):
    caplog.set_level(logging.INFO)
    source, out, state = (str(tmp_path / x) for x in ("events", "out", "state"))
    first, second = events.filter("event_id % 3 <> 0"), events.filter("event_id % 3 = 0")
    first.coalesce(2).write.parquet(source)
    counts = feedback_triples.run(spark, source, out, state)
    assert counts["events"] == first.count() and counts["batches"] == 1 and counts["rejected"] == 0
    assert rows(feedback_triples.result(spark, out)) == mined(spark, first)
    # Nothing new: nothing is taken, and nothing changes.
    assert feedback_triples.run(spark, source, out, state) == {"batches": 0, "events": 0, "rejected": 0, "days": 0}
    # Later and late events, of days that are there already.
    second.coalesce(1).write.mode("append").parquet(source)
    counts = feedback_triples.run(spark, source, out, state)
    assert counts["events"] == second.count() and counts["batches"] == 1
    assert rows(feedback_triples.result(spark, out)) == mined(spark, events)
    assert any("read" in r.message and source in r.message for r in caplog.records if r.name == "feedback_triples")
    assert {p for p in os.listdir(f"{out}/log") if p.startswith("arrived=")} == {"arrived=0", "arrived=1"}


def test_only_touched_days_are_replaced(spark, events, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("events", "out", "state"))
    events.write.parquet(source)
    feedback_triples.run(spark, source, out, state)
    before = files(spark, out)
    day = min(before)
    one = events.filter(F.to_date("ts") == F.lit(day)).limit(1).withColumn("event_id", F.lit(10**9).cast("long"))
    one.write.mode("append").parquet(source)
    assert feedback_triples.run(spark, source, out, state)["days"] == 1
    after = files(spark, out)
    assert [d for d in before if before[d] != after[d]] == [day]
    assert rows(feedback_triples.result(spark, out)) == mined(spark, events.unionByName(one))


def test_bad_and_repeated_events(spark, events, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("events", "out", "state"))
    events.write.parquet(source)
    feedback_triples.run(spark, source, out, state)
    some = events.limit(20)
    odd = [some, some.withColumn("event_type", F.lit("unheard of")), some.withColumn("user_id", F.lit(None).cast("long")), some.withColumn("ts", F.lit(None).cast("timestamp_ntz"))]
    for df in odd:
        df.coalesce(1).write.mode("append").parquet(source)
    counts = feedback_triples.run(spark, source, out, state)
    assert counts["rejected"] == 60 and counts["events"] == 20
    assert rows(feedback_triples.result(spark, out)) == mined(spark, events)
    assert spark.read.parquet(f"{out}/rejected").count() == 60


def test_goes_on_after_a_failure(spark, events, tmp_path, monkeypatch):
    source, out, state = (str(tmp_path / x) for x in ("events", "out", "state"))
    events.write.parquet(source)
    real = feedback_triples.replaced

    def failing(df, path, *by):
        if path.endswith("/triples"):
            raise RuntimeError("lost on the way")
        real(df, path, *by)

    monkeypatch.setattr(feedback_triples, "replaced", failing)
    with pytest.raises(Exception, match="lost on the way"):
        feedback_triples.run(spark, source, out, state)
    monkeypatch.setattr(feedback_triples, "replaced", real)
    assert feedback_triples.run(spark, source, out, state)["batches"] == 1
    assert rows(feedback_triples.result(spark, out)) == mined(spark, events)
    assert spark.read.parquet(f"{out}/log").count() == events.count()


def test_files_are_taken_in_bounded_batches(spark, events, tmp_path):
    source, out, state, config = (str(tmp_path / x) for x in ("events", "out", "state", "c.json"))
    events.repartition(5).write.parquet(source)
    with open(config, "w") as f:
        json.dump({"max_files": 2}, f)
    assert feedback_triples.run(spark, source, out, state, config)["batches"] == 3
    assert rows(feedback_triples.result(spark, out)) == mined(spark, events)
    with open(config, "w") as f:
        json.dump({"max_file": 2}, f)
    with pytest.raises(ValueError, match="max_file"):
        feedback_triples.run(spark, source, out, state, config)


def test_retrieval_run_again_gives_the_same(spark, sf_dir, tmp_path, caplog):
    caplog.set_level(logging.INFO)
    out, config = str(tmp_path / "run"), str(tmp_path / "c.json")
    tables = f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet"
    counts = retrieval_run.run(spark, *tables, out)
    assert set(counts) == {"dense", "sparse", "hybrid"} and {p for p in os.listdir(out) if "=" in p} == {f"strategy={s}" for s in counts}
    before = rows(retrieval_run.result(spark, out))
    assert all(r.in_baseline for r in retrieval_run.result(spark, out).filter("strategy = 'sparse'").collect())
    # Fewer strategies: the others stay as they are.
    with open(config, "w") as f:
        json.dump({"strategies": ["sparse"]}, f)
    assert set(retrieval_run.run(spark, *tables, out, config)) == {"sparse"}
    assert rows(retrieval_run.result(spark, out)) == before
    assert sum(r.name == "retrieval_run" and "wrote" in r.message for r in caplog.records) == 4
    with open(config, "w") as f:
        json.dump({"strategies": ["psychic"]}, f)
    with pytest.raises(ValueError):
        retrieval_run.run(spark, *tables, out, config)


def test_settings(spark):
    for name, defaults in (("retrieval_run", retrieval_run.DEFAULTS), ("feedback_triples", feedback_triples.DEFAULTS)):
        assert common.settings(spark, f"{ROOT}/jobs/{name}.json", {k: None for k in defaults}) == defaults


def test_queries_run_twice(spark, sf_dir, events):
    assert rows(catalogue.job2_feedback_triples(spark, sf_dir)) == mined(spark, events)


def test_command_lines(tmp_path, sf_dir):
    """In a process and folder of their own."""
    for name, paths in (("feedback_triples", [f"{sf_dir}/events.parquet", "out", "state"]), ("retrieval_run", [f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", "run"])):
        paths = [p if p.startswith("/") else str(tmp_path / p) for p in paths]
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_SUBMIT_ARGS": "--master local[2] pyspark-shell"}
        done = subprocess.run([sys.executable, f"{ROOT}/jobs/{name}.py", *paths, "--config", f"{ROOT}/jobs/{name}.json"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
        assert done.returncode == 0, done.stderr[-3000:]
        assert name in done.stderr and "read" in done.stderr
    assert any(p.startswith("strategy=") for p in os.listdir(tmp_path / "run"))

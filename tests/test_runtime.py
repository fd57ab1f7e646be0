"""Durable intermediates."""

import pytest

from tarn import runtime


def test_materialise_and_release(spark):
    runtime.release(spark)
    kept = runtime.materialise(spark.range(5), "five")
    assert kept.count() == 5 and runtime.shared_dir(spark).split(":")[-1].lstrip("/") in kept.inputFiles()[0]
    assert runtime.release(spark) == 1 and runtime.release(spark) == 0


def test_settle_replaces_what_it_was_made_from(spark):
    runtime.release(spark)
    before = runtime.materialise(spark.range(2), "before")
    since = runtime.written()
    one = runtime.settle(runtime.materialise(spark.range(5), "part"), "one", since)
    two = runtime.settle(one.filter("id > 1"), "two", since)
    assert runtime.written() == 2 and two.count() == 3 and before.count() == 2
    assert runtime.release(spark) == 2


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.shared_dir(Session())


def test_text_batches_keep_a_chosen_bound(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "77")
    runtime.text_batches(spark.range(1))
    assert spark.conf.get(key) == "77"
    spark.conf.set(key, "10000")
    runtime.text_batches(spark.range(1))
    assert spark.conf.get(key) == "1000"
    spark.conf.set(key, before)

"""Session helpers: table loading and durable intermediate tables.

Intermediate results that several stages read, or that end an iteration, are
written as Parquet under the folder named by ``spark.checkpoint.dir``. Executors
may come and go; the files stay readable by all of them.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


#: Paths of intermediates, for each thread its own.
_HERE = threading.local()


def session(app: str = "tarn", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the package relies on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return builder.config(map=settings | conf).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """A scan that has fewer partitions than the session has cores, dealt out by ``key``.

    For work that is heavy for each row over inputs of one or a few files. A scan
    with enough partitions, as any large one, stays as it is. ``df`` must be a
    scan with projections or filters: its partitions are counted by planning it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder for durable intermediates.

    It is ``spark.checkpoint.dir`` where the session has one. Only a local session
    without one, as in tests, gets a temporary folder; on a cluster, where each
    executor would write to a disk of its own, that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        found = context.getCheckpointDir()
        if not found:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            made = tempfile.mkdtemp(prefix="tarn-shared-")
            atexit.register(shutil.rmtree, made, ignore_errors=True)
            context.setCheckpointDir("file://" + os.path.abspath(made))
            found = context.getCheckpointDir()
    return found.rstrip("/")


def materialise(df: DataFrame, label: str = "table", codec: str = "zstd", max_records: int = 0) -> DataFrame:
    """Write ``df`` once to the shared folder, in files of ``max_records`` if asked, and return the written table.

    The written table has file sizes that the optimizer can see, so a join with
    a small one becomes a broadcast below the session's threshold and a shuffle
    join above it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written().append(path)
    df.write.option("compression", codec).option("maxRecordsPerFile", max_records).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _written() -> list[str]:
    if not hasattr(_HERE, "written"):
        _HERE.written = []
    return _HERE.written


def written() -> int:
    """How many intermediates this thread has written and not released."""
    return len(_written())


def last_written() -> str:
    """The path of the intermediate that this thread wrote last."""
    return _written()[-1]


def delete(spark: SparkSession, path: str) -> bool:
    """Deletes an intermediate, wherever it lies."""
    if path in _written():
        _written().remove(path)
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True))


def release(spark: SparkSession, since: int = 0, keep: int = 0, but: str = "") -> int:
    """Deletes the intermediates that this thread has written after the first
    ``since``, but for the last ``keep`` and the one at ``but``, once results that read
    them are stored. Returns their number."""
    paths = _written()
    gone = [p for p in paths[since : len(paths) - keep] if p != but]
    return sum(delete(spark, p) for p in gone)


def settle(df: DataFrame, label: str, since: int) -> DataFrame:
    """Writes ``df``, then deletes what was written ``since``: the new table stands for it."""
    made = materialise(df, label)
    release(df.sparkSession, since, keep=1)
    return made


def text_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df``, after bounding the rows of an Arrow batch for its session.

    Python workers and their JVM hold a few batches at a time. The default of
    10,000 rows is meant for numbers; with whole texts it is tens of megabytes a
    batch. A session that has set its own bound keeps it.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if conf.get(key) == "10000":
        conf.set(key, str(rows))
    return df

"""Corpus queries where Python workers have no copy of this package."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from tarn import runtime
spark = runtime.session("bare", master="local[4]", shuffle_partitions=4, **{{"spark.driver.memory": "4g"}})
spark.sparkContext.setLogLevel("ERROR")
queries = entry.queries()
for name in sorted(queries):
    if name == "pipeline" or name.startswith("op"):
        try:
            queries[name](spark, {sf_dir!r}).write.format("noop").mode("overwrite").save()
        except Exception as e:
            print("FAILED", name, str(e)[-600:])
        runtime.release(spark)
        print("ran", name)
"""


def test_workers_need_no_copy_of_the_package(tmp_path, sf_dir):
    """The driver finds the package by its own path; workers start in another folder without it."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT, sf_dir=sf_dir)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=1800)
    assert done.returncode == 0 and "FAILED" not in done.stdout, done.stdout + done.stderr[-2000:]
    assert done.stdout.count("ran ") >= 11

"""What the jobs' command lines share: settings read by Spark, a session of their own, a log."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def settings(spark: SparkSession, path: str | None, defaults: dict) -> dict:
    """``defaults``, and over them the JSON object in the file at ``path``; an unknown name is an error."""
    given = json.loads(spark.read.text(path, wholetext=True).first()[0]) if path else {}
    if unknown := sorted(set(given) - set(defaults)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return defaults | given


def is_file(table: DataFrame, path: str) -> bool:
    """Whether a table that was read from ``path`` is one file, not a folder of files."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return not any(f"/{name}/" in f for f in table.inputFiles()[:1])


def command_line(name: str, arguments: dict[str, str], run: Callable[..., dict]) -> None:
    """Parses paths, creates a session, runs the job and stops the session."""
    from tarn import runtime

    parser = argparse.ArgumentParser(prog=name)
    for argument, told in arguments.items():
        parser.add_argument(argument, help=told)
    parser.add_argument("--config", help="JSON file of settings")
    given = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = runtime.session(name)
    try:
        run(spark, **given)
    finally:
        spark.stop()

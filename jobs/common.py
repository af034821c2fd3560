"""What the jobs share: the command line and the config file, which Spark reads."""

from __future__ import annotations

import argparse
import json
import logging
from dataclasses import fields
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

C = TypeVar("C")


def arguments(about: str, *paths: str) -> argparse.Namespace:
    """A path each for the names given, the config file, and the folder that driver and executors share."""
    parser = argparse.ArgumentParser(description=about)
    for name in paths:
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", help="a JSON file; settings that it leaves out keep their defaults")
    parser.add_argument("--shared", help="spark.checkpoint.dir, where the cluster does not set it")
    return parser.parse_args()


def session(name: str, shared: str | None) -> SparkSession:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    builder = SparkSession.builder.appName(name)
    return (builder.config("spark.checkpoint.dir", shared) if shared else builder).getOrCreate()


def config(spark: SparkSession, path: str | None, kind: type[C]) -> C:
    """The settings of a JSON file; a name that the job does not know is an error."""
    given = json.loads(spark.read.text(path, wholetext=True).first()[0]) if path else {}
    if unknown := set(given) - {f.name for f in fields(kind)}:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return kind(**given)


def tally(rows: DataFrame, by: str) -> dict[str, int]:
    """Number of rows by the values of a column that has few."""
    return {r[0]: r[1] for r in rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(by).collect()}

"""The package's code on the executors: sent along where they cannot import it themselves."""

from __future__ import annotations

import functools
import os
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once, unless the workers' path holds it already."""
    app = spark.sparkContext.applicationId
    paths = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if app in _sent or ROOT in paths:
        return
    base = Path(tempfile.mkdtemp(prefix="spark-")) / "evidex"
    spark.sparkContext.addPyFile(shutil.make_archive(str(base), "zip", ROOT, "evidex"))
    _sent.add(app)


def with_code(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run

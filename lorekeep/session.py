"""Getting the package to the executors."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package's sources to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    fd, name = tempfile.mkstemp(prefix="lorekeep-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(name)
    _shipped.add(app)


def shipped[T](f: Callable[..., T]) -> Callable[..., T]:
    """``f``, whose first argument is a session, with the package sent to its executors first."""

    @functools.wraps(f)
    def run(spark: SparkSession, *args, **options) -> T:
        ship(spark)
        return f(spark, *args, **options)

    return run

"""What the operators share: the shared folder, materialised tables, text batches."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder path below ``spark.checkpoint.dir``.

    Where the session names no such folder (tests on one machine), a temporary
    folder of this process stands in and goes when the process ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="lorekeep-"))
            atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
        root = f"file://{_own_dir[0]}"
    return f"{root.rstrip('/')}/lorekeep-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; cuts the lineage."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def batch_bytes(spark: SparkSession, size: str) -> Iterator[None]:
    """What runs within sends Arrow batches of about ``size`` to Python, or smaller ones where the session says so.

    A batch lies in the executor several times, outside its heap (vectors that
    double as they grow, the same bytes on their way) and once more in the worker.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    as_bytes = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    spark.conf.set(key, min(before, size, key=as_bytes))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: What worker processes keep between tasks, by module; see ``lean``.
held: dict[str, dict] = {}


def lean(keep: str = "") -> None:
    """Gives back what earlier stages left in this worker, but for what ``keep`` names, and freed memory to the system."""
    for name, kept in held.items():
        if name != keep:
            kept.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def leanly(run: Callable[..., Iterator[pa.RecordBatch]], keep: str = "") -> Callable[..., Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, lean before and after."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean(keep)
        yield from run(batches)
        lean(keep)

    return outer


def forget(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files that nothing refers to any more, before the next phase writes its own."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def place(df: DataFrame, name: str) -> int:
    """Where the column ``name`` stands: the one spelt so, else the only one that differs in letter case."""
    exact = [i for i, c in enumerate(df.columns) if c == name]
    found = exact or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if len(found) != 1:
        raise ValueError(f"{len(found)} columns named {name!r} in {df.columns}")
    return found[0]


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named by their places, so that any names (dots, repeats, letter case, an operator's own) do."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Some columns of ``df`` under new names, whatever else it has."""
    return numbered(df).select(*[F.col(f"c{place(df, old)}").alias(new) for new, old in columns.items()])


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id (long), text."""
    return pick(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")


def crc32_mod(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % n


def by_bytes(batches: Iterator[pa.RecordBatch], text: int, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose text column holds about ``limit`` bytes at most (one row at least)."""
    for batch in batches:
        start, size = 0, 0
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
        for i, n in enumerate(lengths):
            if i > start and size + n > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if batch.num_rows > start:
            yield batch.slice(start)

"""What the operators of this subpackage share: tables, shared folders, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that an operator turns into Python objects at once.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir.  Where that is unset, as in tests, below a temporary one: on a single machine only."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='verisift-')}"
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{what}-{uuid.uuid4().hex}"


#: Folders written within scratch(), innermost last.
_SCRATCH: list[list[str]] = []


def keep(df: DataFrame, what: str, for_result: bool = False) -> DataFrame:
    """The frame written to the shared folder and read again: lineage ends there.  What a result is read from goes when the driver ends."""
    at = shared_dir(df.sparkSession, what)
    df.write.parquet(at)
    if _SCRATCH and not for_result:
        _SCRATCH[-1].append(at)
    else:
        drop_at_end(df.sparkSession, at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes what keep() writes within, but for what the result is read from."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for at in _SCRATCH.pop():
            drop_dir(spark, at)


def _file_system(spark: SparkSession, at: str) -> tuple[Any, Any]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def drop_dir(spark: SparkSession, at: str) -> None:
    files, path = _file_system(spark, at)
    files.delete(path, True)


def drop_at_end(spark: SparkSession, at: str) -> None:
    """Deletes the folder when the driver's JVM ends."""
    files, path = _file_system(spark, at)
    files.deleteOnExit(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut into pieces of about `most` bytes, so that a batch of long rows is no peak of memory."""
    for batch in batches:
        step = max(1, min(batch.num_rows, int(batch.num_rows * most / max(batch.nbytes, 1)) or 1))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def texts(column: pa.Array) -> list[str]:
    """Python strings; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def per_process(key: tuple, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task: the object of one key, the last asked for."""
    held = sys.__dict__.setdefault("_verisift_held", {})
    if key not in held:
        forget()
        held[key] = make()
    return held[key]


def forget() -> None:
    """Gives back what the worker keeps from an earlier operator."""
    if held := sys.__dict__.get("_verisift_held"):
        held.clear()
        gc.collect()
        with suppress(OSError, AttributeError):  # glibc alone has it
            ctypes.CDLL(None).malloc_trim(0)

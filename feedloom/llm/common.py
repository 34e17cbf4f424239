"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from contextlib import contextmanager, suppress
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the white space of the contracts (space and TAB to CR).
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Fixed value: the same characters, for translate().
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def words(text: Column) -> Column:
    """Words of a text as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="feedloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame, kind: str = "cut") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a
    lost executor costs a re-read rather than a recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of df has."""
    taken = {c.lower() for c in df.columns}
    return [next(x for x in (n, *(f"{n}_{i}" for i in range(len(taken) + 1))) if x.lower() not in taken) for n in names]


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Python workers are given batches of so many rows by what is run within; the session's own setting comes back after."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def tidy(f):
    """f, a function of Arrow batches, so that its worker gives free memory back to the system at the end of a task: a worker that waits for its
    next one stands beside an executor that needs it."""

    @wraps(f)
    def run(batches):
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    """Gives free memory back to the system."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def local_path(uri: str) -> str:
    return uri[len("file:"):] if uri.startswith("file:") else uri


def open_fs(uri: str):
    """(filesystem, path) for a URI of a shared folder: local, HDFS or an object store."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(uri)
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + local_path(uri).lstrip("/")
    return fs.FileSystem.from_uri(uri)

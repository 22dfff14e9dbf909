"""The shared folder, tables written there to cut lineage, and memory given back by workers."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where spark.checkpoint.dir is unset, and then only by a session on one machine, as in tests.
UNSET_FOLDER = "/tmp/stallmark-checkpoints"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Most rows in an Arrow batch: what a worker and its executor hold at a time is some MB.
BATCH_ROWS = 1000


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return named or UNSET_FOLDER


def place(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: a lost executor costs one read.

    The step's shuffle files go when it ends.
    """
    spark, schema, path = df.sparkSession, df.schema, place(df.sparkSession, name)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(schema).parquet(path)
    out.written_to = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Empty tables of ``written`` that no later plan reads."""
    for table in tables:
        table.sparkSession.range(0).coalesce(1).write.mode("overwrite").parquet(table.written_to)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker gives back the memory that Arrow and the C library keep for it: workers outlive tasks."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return one


def trim() -> None:
    """Give back free memory, where the C library can."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give is not None:
        give(0)


def lowered(c: Column) -> Column:
    """A-Z in lower case and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unused(name: str, columns: list[str]) -> str:
    """``name``, or a longer one that no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows at most from now on in this session, unless it asks for fewer."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")

"""Tables written to the shared folder, to cut lineage between the barriers of a ranking."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where spark.checkpoint.dir is unset, and then only by a session on one machine, as in tests.
UNSET_FOLDER = "/tmp/stallmark-checkpoints"


def place(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(named or UNSET_FOLDER).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder: evaluated once, read by all that follows."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly over as many tasks as the session shuffles to: before columns that cost far more than reading, as
    a small file's few row groups would keep them in as few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def removed(spark: SparkSession, path: str) -> None:
    """Remove a file or folder, wherever Spark can write."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

"""Ranks over whole sets without putting a set into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cut import written


def spread(df: DataFrame, order: list[Column], parts: int) -> DataFrame:
    """``df`` range-partitioned by ``order``, written, with the number of its range as _part.

    The ranges are written, so that a task that runs again meets the same ones.
    """
    ranged = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    return written(ranged, "ranges")


def global_row_number(df: DataFrame, by: list[str], order: list[Column], name: str, parts: int = 200) -> DataFrame:
    """Adds ``name``: 1, 2, ... by ``order`` within ``by``. Each range is numbered on its own and shifted by the counts of those before."""
    rows = spread(df, [*(F.col(c) for c in by), *order], parts)
    counts = rows.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    # One row per key and range: at most ``parts`` more than there are keys.
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))
    return rows.withColumn("_own", own).join(before, [*by, "_part"]).withColumn(name, (F.col("_before") + F.col("_own")).cast("long")).drop("_own", "_before", "_part")


def global_percent_rank(df: DataFrame, by: list[str], value: Column, name: str, parts: int = 200) -> DataFrame:
    """Adds ``name``: the share of rows of ``by`` strictly below, 0 to 1; ties share it; null for a single row."""
    rows = written(df.withColumn("_v", value), "valued")
    levels = global_sum_before(rows.groupBy(*by, "_v").agg(F.count("*").alias("_n")), by, [F.col("_v")], "_n", "_below", parts)
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_all"))
    below = levels.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_v").alias("_level"), "_below")
    same = [F.col(c) == F.col(f"_{c}") for c in by] + [F.col("_v").eqNullSafe(F.col("_level"))]
    out = rows.join(below, same).drop("_level", *(f"_{c}" for c in by)).join(sizes, by)
    return out.withColumn(name, F.when(F.col("_all") > 1, F.col("_below") / (F.col("_all") - 1))).drop("_v", "_below", "_all")


def global_sum_before(df: DataFrame, by: list[str], order: list[Column], column: str, name: str, parts: int = 200) -> DataFrame:
    """Adds ``name``: the sum of ``column`` over all rows of ``by`` that come before by ``order``."""
    rows = spread(df, [*(F.col(c) for c in by), *order], parts)
    sums = rows.groupBy(*by, "_part").agg(F.sum(column).alias("_s"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_s").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    own = F.coalesce(F.sum(column).over(Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_own", own).join(before, [*by, "_part"]).withColumn(name, F.col("_before") + F.col("_own")).drop("_own", "_before", "_part")


def global_medians(df: DataFrame, by: list[str], columns: list[str], parts: int | None = None) -> DataFrame:
    """(by..., <column>...): the exact median of each column's known values within ``by``, the mean of two middle ones.

    Values are counted by level and the counts summed over ranges of their order, all columns in one pass: no buffer holds a
    set's distinct values. A column without a known value is null.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = F.array(*(F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)))
    long = df.select(*by, F.inline(pairs)).where(F.col("v").isNotNull())
    levels = written(long.groupBy(*by, "i", "v").agg(F.count("*").alias("_n")), "levels")
    sizes = levels.groupBy(*by, "i").agg(F.sum("_n").alias("_all"))
    line = global_sum_before(levels, [*by, "i"], [F.col("v")], "_n", "_under", parts).join(sizes, [*by, "i"])

    def at(place: Column) -> Column:
        return (F.col("_under") <= place) & (place < F.col("_under") + F.col("_n"))

    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    middle = line.where(at(low) | at(high)).groupBy(*by, "i").agg((F.max(F.when(at(low), F.col("v"))) * 0.5 + F.max(F.when(at(high), F.col("v"))) * 0.5).alias("m"))
    return middle.groupBy(*by).agg(*(F.max(F.when(F.col("i") == i, F.col("m"))).alias(c) for i, c in enumerate(columns)))

"""Price observations: the append-only store, summaries, series and small charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.maths import jround


def to_append(observations: DataFrame) -> DataFrame:
    """One row for each key, platform and time: the last offer of a run stands."""
    latest = Window.partitionBy("key", "platform", "ts").orderBy(F.desc("ord"))
    return observations.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")


def stats(observations: DataFrame) -> DataFrame:
    """Per key: extremes, mean, latest price, its position between the extremes, and its trend against all before."""
    out = observations.groupBy("key").agg(
        F.min("price").alias("low"), F.max("price").alias("high"), F.sum("price").alias("total"), F.count("*").alias("observations"),
        F.max_by("price", F.struct("ts", "ord")).alias("current"), F.count_distinct("ts").alias("runs"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
    )
    earlier = (F.col("total") - F.col("current")) / (F.col("observations") - 1)
    position = F.when(F.col("high") > F.col("low"), (F.col("current") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0)
    trend = F.when(F.col("observations") < 2, "stable").when(F.col("current") < earlier * 0.98, "falling").when(F.col("current") > earlier * 1.02, "rising").otherwise("stable")
    days = F.greatest(F.lit(0), jround(F.expr("timestampdiff(SECOND, first_seen, last_seen)") / 86400)).cast("long")
    return out.select("key", "low", "high", jround(F.col("total") / F.col("observations")).alias("average"), "current", "observations", "runs", "first_seen", "last_seen", days.alias("days_tracked"), jround(position, 4).alias("position"), trend.alias("trend"))


def tracked(observations: DataFrame, limit: int = 50) -> DataFrame:
    """The summaries of the keys that were seen last."""
    return stats(observations).orderBy(F.desc("last_seen"), "key").limit(limit)


def series(observations: DataFrame, cap: int) -> DataFrame:
    """The lowest price of each time among a key's last ``cap`` observations."""
    tail = Window.partitionBy("key").orderBy(F.desc("ts"), F.desc("ord"))
    return observations.withColumn("_n", F.row_number().over(tail)).where(F.col("_n") <= cap).groupBy("key", "ts").agg(F.min("price").alias("price"))


def latest(rows: DataFrame, key: str, as_of: Column, ttl_seconds: int) -> DataFrame:
    """The cache as of a time: each key's newest row, if it has not expired."""
    newest = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("ord"))
    fresh = rows.where((F.col("ts") <= as_of) & (F.col("ts") > as_of - F.make_interval(secs=F.lit(ttl_seconds))))
    return fresh.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def buckets(series_: DataFrame, levels: int = 8) -> DataFrame:
    """Each point's level between the key's extremes; the middle one for a flat series."""
    w = Window.partitionBy("key")
    low, high = F.min("price").over(w), F.max("price").over(w)
    level = F.when(high > low, F.least(F.lit(levels - 1), F.floor((F.col("price") - low) / (high - low) * levels).cast("int"))).otherwise(3)
    return series_.withColumn("level", level)

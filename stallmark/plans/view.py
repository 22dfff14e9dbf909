"""The shipped tables as catalogue tables: listings, intents, observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An offer for each line item: prices in whole paise, ratings and stock from the keys."""
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    ord_ = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rows = l.join(p, l.l_partkey == p.p_partkey)
    size = F.col("p_size")
    return rows.select(
        ord_.alias("ord"),
        F.concat(F.lit("p"), F.col("l_suppkey") % 4).alias("platform"),
        F.col("p_name").alias("model"),
        F.when(size % 5 == 0, F.concat(F.lit("?r-"), size % 3 * 64 + 64, F.lit("s"))).otherwise(F.concat(size % 4 * 2 + 4, F.lit("r-"), size % 3 * 64 + 64, F.lit("s"))).alias("config"),
        F.col("p_brand").alias("brand"),
        F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity") + 0.5).alias("price"),
        F.floor(F.col("l_discount") * 100 + 0.5).alias("discount"),
        F.when(F.col("l_linestatus") == "O", True).when(F.col("l_returnflag") == "R", False).alias("in_stock"),
        F.when(ord_ % 7 != 0, (ord_ % 20 + 30) / 10.0).alias("rating"),
        F.when(ord_ % 7 != 0, ord_ * 37 % 1500).alias("rating_count"),
        F.col("p_type").alias("type"),
        size.alias("size"),
    )


LISTING = """listing AS (SELECT l_orderkey * 10 + l_linenumber AS ord, 'p' || (l_suppkey % 4) AS platform, p_name AS model,
 CASE WHEN p_size % 5 = 0 THEN '?r-' || (p_size % 3 * 64 + 64) || 's' ELSE (p_size % 4 * 2 + 4) || 'r-' || (p_size % 3 * 64 + 64) || 's' END AS config, p_brand AS brand,
 CAST(floor(l_extendedprice * 100 / l_quantity + CAST(0.5 AS DOUBLE)) AS BIGINT) AS price, CAST(floor(l_discount * 100 + CAST(0.5 AS DOUBLE)) AS BIGINT) AS discount,
 CASE WHEN l_linestatus = 'O' THEN true WHEN l_returnflag = 'R' THEN false END AS in_stock,
 CASE WHEN (l_orderkey * 10 + l_linenumber) % 7 <> 0 THEN ((l_orderkey * 10 + l_linenumber) % 20 + 30) / CAST(10 AS DOUBLE) END AS rating,
 CASE WHEN (l_orderkey * 10 + l_linenumber) % 7 <> 0 THEN (l_orderkey * 10 + l_linenumber) * 37 % 1500 END AS rating_count, p_type AS type, p_size AS size
 FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as price observations in whole paise."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("key"), F.col("event_type").alias("platform"), "ts", F.floor(F.col("value") * 100 + 0.5).alias("price"), F.col("event_id").alias("ord"))


OBSERVATION = "observation AS (SELECT user_id AS key, event_type AS platform, ts, CAST(floor(value * 100 + CAST(0.5 AS DOUBLE)) AS BIGINT) AS price, event_id AS ord FROM events)"

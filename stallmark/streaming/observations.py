"""An extension: price observations as a stream, with late data up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "key string, platform string, ts timestamp, price double"


def read(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_at_once).parquet(path)


def daily(observations: DataFrame, late: str = "2 days") -> DataFrame:
    """Lowest, highest and number of prices per key and day."""
    return observations.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "key").agg(F.min("price").alias("low"), F.max("price").alias("high"), F.count("*").alias("n"))


def append(df: DataFrame, to: str, checkpoint: str) -> StreamingQuery:
    """Everything that is there, once, appended to Parquet."""
    flat = df.select("key", F.col("window.start").alias("day"), "low", "high", "n")
    return flat.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(to)

"""op12_main_text: the main text of every page."""

from pyspark.sql import DataFrame, SparkSession

from .maintext import extracted


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))

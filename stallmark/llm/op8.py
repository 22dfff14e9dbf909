"""op8_secrets: counts and digests of the secrets in every document."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .secrets import BASE, scan
from .shared import documents


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, BASE), F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))

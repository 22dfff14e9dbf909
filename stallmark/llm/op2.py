"""op2_lm_scores: every document's score under a context-tree weighting model and a word model."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ctw import scores
from .shared import documents


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    out = scores(documents(spark, sf_dir), ~held)
    base = F.col("log_known") - F.col("n_tokens") * F.log10(F.col("train_tokens") + F.col("train_words") + 1.0)
    bits = F.when(F.col("n_bytes") > 0, -F.col("score") * 3.321928094887362 / F.col("n_bytes"))
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.col("train_tokens").cast("long").alias("train_tokens"), base.alias("base_score"), "score", bits.alias("bits_per_byte"))

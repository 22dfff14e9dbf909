"""op1_pack: every document in sequences of at most 2048 tokens."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .packing import pack_documents
from .shared import documents


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))

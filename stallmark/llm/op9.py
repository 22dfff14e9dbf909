"""op9_token_counts: tokens of every document under a unigram tokenizer made of a public vocabulary."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .shared import documents
from .tokencount import count_tokens


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))

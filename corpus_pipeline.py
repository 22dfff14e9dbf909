"""A training corpus from raw documents: five stages, each over all that the one before kept.

``run`` writes each stage's result as Parquet in the shared folder and reads it as the next one's input.

Defined results: null texts, empty ones and those without a letter go in the first stage; documents that
are equal but for their ids are copies, of which the smallest id stays; rows repeated whole, the id too, all stay where one
does; a document with a null id stays if it has no copy with an id; documents without words are no copies of one
another; very long texts are read whole, a slice at a time; an empty table gives an empty result;
columns of any further names pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from stallmark.llm.decontam import contamination
from stallmark.llm.langid import classified
from stallmark.llm.linededup import dedup_lines
from stallmark.llm.ngramjoin import near_components
from stallmark.llm.packing import pack_documents
from stallmark.llm.shared import documents, dropped, unused, written

#: A text whose language scores lower than this is rejected, as is one without a letter.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that can be told, learned from their own labels."""
    name = unused("found", docs.columns)
    out = classified(docs, F.lit(True), as_col=name)
    return out.where((F.col(f"{name}.lang_pred") != "und") & (F.col(f"{name}.score") >= LEAST_SCORE)).drop(name)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that another one is to keep; n_chars follows the text."""
    name = unused("stats", docs.columns)
    out = dedup_lines(docs, as_col=name).drop(name)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five words, 0.8) the document with the smallest id."""
    found = near_components(docs, n=5, num=80, den=100)
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(name := unused("kept", docs.columns))).distinct()
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep[name]), "left_semi")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where(F.col("n_hit") > 0)
    # Rows that share an id are told apart by their texts' digest as well; a digest alone decides nothing.
    bad = found.select(F.col("doc_id").alias(name := unused("bad", docs.columns)), F.col("key").alias(key := unused("bad_key", docs.columns))).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad[name]) & (F.xxhash64(docs["doc_id"], docs["text"]) == bad[key]), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("line_dedup", lines), ("ngram_join", near), ("decontaminate", decontaminate), ("pack", pack)]

#: The language model and the packing are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

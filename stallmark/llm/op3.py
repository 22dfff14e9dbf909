"""op3_unit_dedup, op3_sentences and op3_passages: every document without the lines, the sentences, or both, that an earlier one has."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents
from .unitdedup import dedup_units

_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), 'UNITS') AS tiles FROM documents),
u AS (SELECT doc_id, unnest(tiles) AS u, generate_subscripts(tiles, 1) AS i FROM t),
k AS (SELECT *, sum(length(u)) OVER (PARTITION BY doc_id ORDER BY i) AS e, regexp_replace(translate(trim(u, ' .!?' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\x0B\f\r\n]+', ' ', 'g') AS key FROM u),
g AS (SELECT *, length(key) >= 30 AND row_number() OVER (PARTITION BY key ORDER BY doc_id, i) > 1 AS gone FROM k),
a AS (SELECT doc_id, count(*) AS n_units, count(*) FILTER (WHERE gone) AS n_removed, string_agg(u, '' ORDER BY i) FILTER (WHERE NOT gone) AS kept, string_agg(CAST(e - length(u) AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY i) FILTER (WHERE gone) AS removed FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(removed, '') AS removed FROM documents d LEFT JOIN a USING (doc_id)
"""


SQL = _SQL.replace("UNITS", r"[^\n]+\n*|\n+")
SENTENCES_SQL = _SQL.replace("UNITS", r"[^.!?\n]+[.!?\n]*|[.!?\n]+")
_KEY = r"regexp_replace(translate(trim(UNIT, ' .!?' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\x0B\f\r\n]+', ' ', 'g')"
PASSAGES_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\n]+\n*|\n+') AS tiles FROM documents),
l AS (SELECT doc_id, unnest(tiles) AS line, generate_subscripts(tiles, 1) AS i FROM t),
lk AS (SELECT *, KEY_OF_LINE AS key FROM l),
lg AS (SELECT doc_id, i, regexp_extract_all(line, '[^.!?\n]+[.!?\n]*|[.!?\n]+') AS parts, length(key) >= 30 AND row_number() OVER (PARTITION BY key ORDER BY doc_id, i) > 1 AS whole FROM lk),
u AS (SELECT doc_id, i, whole, unnest(parts) AS u, generate_subscripts(parts, 1) AS j FROM lg),
k AS (SELECT *, sum(length(u)) OVER (PARTITION BY doc_id ORDER BY i, j) AS e, KEY_OF_PART AS key FROM u),
g AS (SELECT *, whole OR (length(key) >= 30 AND row_number() OVER (PARTITION BY key ORDER BY doc_id, i, j) > 1) AS gone FROM k),
a AS (SELECT doc_id, count(*) AS n_units, count(*) FILTER (WHERE gone) AS n_removed, string_agg(u, '' ORDER BY i, j) FILTER (WHERE NOT gone) AS kept, string_agg(CAST(e - length(u) AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY i, j) FILTER (WHERE gone) AS removed FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(removed, '') AS removed FROM documents d LEFT JOIN a USING (doc_id)
""".replace("KEY_OF_LINE", _KEY.replace("UNIT", "line")).replace("KEY_OF_PART", _KEY.replace("UNIT", "u"))


def summed(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "n_units", F.size("removed").cast("long").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"), F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("removed"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summed(dedup_units(documents(spark, sf_dir)))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences, which also repeat within lines that differ; the columns are those of ``query``."""
    return summed(dedup_units(documents(spark, sf_dir), unit="sentence"))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, and the sentences of lines that differ; counted and removed by sentences, the columns are those of ``query``."""
    return summed(dedup_units(documents(spark, sf_dir), parts="sentence"))

"""op5_fingerprints: Merkle fingerprints of every document and of its edited text."""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .merkle import differing, leaves, likeness, paragraphs, root, with_next
from .shared import documents

_SQL = r"""
WITH o AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first_value(coalesce(text, '')) OVER (ORDER BY doc_id)) AS nxt FROM documents),
e AS (SELECT doc_id, text, nxt, length(text) AS n, substr(text, 1, length(text) - length(text) // 4) || substr(nxt, 1, length(text) // 4) AS edited FROM o),
t AS (SELECT *, LEAVES(text) AS a, LEAVES(edited) AS b, LEAVES(nxt) AS c FROM e),
p AS (SELECT *, NODES(a) AS pa, NODES(b) AS pb FROM t),
q AS (SELECT *, SECTIONS(pa) AS sa, SECTIONS(pb) AS sb FROM p)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, sha256(coalesce(list_aggregate(sa, 'string_agg', ''), '')) AS fingerprint, sha256(coalesce(list_aggregate(sb, 'string_agg', ''), '')) AS edited_fingerprint,
  CASE WHEN len(a) + len(b) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(a, b)) / (len(list_distinct(a)) + len(list_distinct(b))) END AS near_edited,
  CASE WHEN len(a) + len(c) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(a, c)) / (len(list_distinct(a)) + len(list_distinct(c))) END AS near_next,
  CAST(len(list_filter(range(greatest(len(pa), len(pb))), lambda i: pa[i + 1] IS DISTINCT FROM pb[i + 1])) AS BIGINT) AS n_differing
FROM q
"""
#: The tree's levels, as in ``merkle``.
_LEVELS = {
    "LEAVES": (r"list_transform(regexp_extract_all({}, '[^\n]{{1,127}}?a |[^\n]{{1,128}}\n?|\n'), lambda p: sha256(p) || CASE WHEN p LIKE '%' || chr(10) THEN '|' ELSE '' END)"),
    "NODES": "list_transform(list_filter(string_split(coalesce(list_aggregate({}, 'string_agg', ''), ''), '|'), lambda s: s <> ''), lambda s: sha256(s))",
    "SECTIONS": "list_transform(list_filter(string_split(coalesce(list_aggregate(list_transform({}, lambda d: CASE WHEN substr(d, 1, 1) < '4' THEN d || '|' ELSE d END), 'string_agg', ''), ''), '|'), lambda s: s <> ''), lambda s: sha256(s))",
}
SQL = re.sub(r"(LEAVES|NODES|SECTIONS)\((\w+)\)", lambda m: _LEVELS[m[1]].format(m[2]), _SQL)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = with_next(documents(spark, sf_dir)).withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substring("next_text", F.lit(1), cut))
    rows = pairs.select("doc_id", "n_chars", edited.alias("edited"), leaves(F.col("text")).alias("own"), leaves(F.col("next_text")).alias("beside"))
    rows = rows.withColumn("changed", leaves(F.col("edited")))
    rows = rows.withColumn("own_lines", paragraphs(F.col("own"))).withColumn("changed_lines", paragraphs(F.col("changed")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        root(F.col("own_lines")).alias("fingerprint"),
        root(F.col("changed_lines")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("beside")).alias("near_next"),
        # How many paragraphs the trees' branches show to differ.
        F.size(differing(F.col("own_lines"), F.col("changed_lines"))).cast("long").alias("n_differing"),
    )

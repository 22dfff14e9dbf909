"""op11_turn_reassembly: what every conversation releases, rejects and closes with, batch by batch."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .turns import reassembled

BATCHES = 8

SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE turn IS NOT NULL),
g AS (SELECT conv_id, turn, min(struct_pack(payload := role || '|' || text, role := role)) AS own, min(text) AS text, ('0x' || substr(sha256(coalesce(conv_id::VARCHAR, '') || ':' || turn::VARCHAR), 1, 8))::UBIGINT AS h FROM t GROUP BY conv_id, turn),
a AS (SELECT conv_id, turn, (h % 8)::BIGINT AS batch, own.payload AS payload, own.role AS role FROM g UNION ALL SELECT conv_id, turn, ((h + 3) % 8)::BIGINT, 'user|' || text, 'user' FROM g WHERE h % 7 < 2),
f AS (SELECT conv_id, min(turn) AS first FROM t GROUP BY conv_id),
b AS (SELECT conv_id, batch, lead(batch) OVER (PARTITION BY conv_id ORDER BY batch) AS after FROM (SELECT DISTINCT conv_id, batch FROM a)),
c AS (SELECT conv_id, least(min(batch + 3), 8) AS closed FROM b WHERE after IS NULL OR after > batch + 3 GROUP BY conv_id),
k AS (SELECT a.*, c.closed, f.first, row_number() OVER (PARTITION BY a.conv_id, a.turn ORDER BY a.batch) AS n FROM a JOIN c ON a.conv_id IS NOT DISTINCT FROM c.conv_id JOIN f ON a.conv_id IS NOT DISTINCT FROM f.conv_id WHERE a.batch <= c.closed),
o AS (SELECT *, row_number() OVER w - 1 AS rank, max(batch) OVER w AS ready, lag(turn) OVER w AS prev, lag(role) OVER w AS prev_role FROM k WHERE n = 1 WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, turn - first = rank AS released FROM o)
SELECT 'release' AS event, sha256(payload) AS sha256, conv_id, turn, ready AS batch, NULL::BIGINT AS n_missing, NULL::BIGINT AS n_breaks FROM r WHERE released
UNION ALL SELECT 'reject', sha256(a.payload), a.conv_id, a.turn, a.batch, NULL, NULL FROM a JOIN c ON a.conv_id IS NOT DISTINCT FROM c.conv_id WHERE a.batch > c.closed
UNION ALL SELECT 'close', sha256(coalesce(string_agg(turn::VARCHAR, ',' ORDER BY turn) FILTER (WHERE NOT released), '')), conv_id, -1, any_value(closed), max(turn) - any_value(first) + 1 - count(*), count(*) FILTER (WHERE prev = turn - 1 AND prev_role = role) FROM r GROUP BY conv_id
"""


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's turns as they arrive: batch, conv_id, turn, first, role, text."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").where(F.col("turn").isNotNull()).select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # All rows of a turn arrive in the same two batches, so the smallest payload of either is known from one aggregate.
    turns = rows.groupBy("conv_id", "turn").agg(F.min(F.struct(F.concat("role", F.lit("|"), "text").alias("payload"), "role")).alias("own"), F.min("text").alias("text"))
    h = F.conv(F.substring(F.sha2(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.col("turn").cast("string")), 256), 1, 8), 16, 10).cast("long")
    own = F.struct((F.col("h") % BATCHES).alias("batch"), F.col("own.role").alias("role"), F.expr("substring(own.payload, char_length(own.role) + 2)").alias("text"))
    again = F.struct(((F.col("h") + 3) % BATCHES).alias("batch"), F.lit("user").alias("role"), F.col("text"))
    both = turns.withColumn("h", h).select("conv_id", "turn", F.explode(F.when(F.col("h") % 7 < 2, F.array(own, again)).otherwise(F.array(own))).alias("a"))
    firsts = rows.groupBy("conv_id").agg(F.min("turn").alias("first")).withColumnRenamed("conv_id", "of")
    return both.join(firsts.hint("merge"), F.col("conv_id").eqNullSafe(F.col("of"))).select("a.batch", "conv_id", "turn", "first", "a.role", "a.text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reassembled(arrivals(spark, sf_dir), BATCHES)
    content = F.when(F.col("event") == "close", F.array_join(F.col("unreleased").cast("array<string>"), ",")).otherwise(F.concat("role", F.lit("|"), "text"))
    return found.select("event", F.sha2(content, 256).alias("sha256"), "conv_id", "turn", "batch", "n_missing", "n_breaks")

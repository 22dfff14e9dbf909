"""op13_vector_codes: every vector's product code, its error, its label's error, and the digest of the codebooks."""

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written
from .vectorcodes import PARTS, ROUNDS, product_codes


def _rounds() -> str:
    """A round for SQL: nearest entries of book r, then book r + 1."""
    return "".join(
        f"""
n{r} AS MATERIALIZED (SELECT vec_id, part, v, arg_min(struct_pack(entry := entry, d := d), d * 256 + entry) AS best FROM (SELECT p.vec_id, p.part, p.v, b.entry, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts p JOIN b{r} b ON p.part = b.part) GROUP BY vec_id, part, v)"""
        + (
            f""",
s{r} AS (SELECT part, entry, list(x ORDER BY place) AS v FROM (SELECT part, best.entry AS entry, place, floor(sum(v[place])::DOUBLE / count(*))::BIGINT AS x FROM n{r}, unnest(generate_series(1, len(v))) AS t(place) GROUP BY ALL) GROUP BY part, entry),
b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(s.v, b.v) AS v FROM b{r} b LEFT JOIN s{r} s ON b.part = s.part AND b.entry = s.entry),"""
            if r < ROUNDS
            else ""
        )
        for r in range(ROUNDS + 1)
    )


SQL = f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, part, list_slice(v, part * len(v) // {PARTS} + 1, (part + 1) * len(v) // {PARTS}) AS v FROM kept, unnest(generate_series(0, {PARTS} - 1)) AS t(part)),
b0 AS (SELECT p.part, o.entry, p.v FROM parts p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < 256) o ON p.vec_id = o.vec_id),{_rounds()},
c AS (SELECT vec_id, string_agg(lpad(lower(hex(best.entry)), 2, '0'), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM n{ROUNDS} GROUP BY vec_id),
d AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM b{ROUNDS}))
SELECT k.vec_id, c.code, c.error, sum(c.error) OVER (PARTITION BY k.label)::BIGINT AS label_error, d.codebooks_sha256 FROM kept k JOIN c ON k.vec_id = c.vec_id CROSS JOIN d
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = product_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    coded = written(coded, "codes")
    # Longs could overflow in the sum; it stops at the largest. Labels of rows without a code alone have none.
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.when(total.isNotNull(), F.least(total, F.lit(2**63 - 1))).cast("long").alias("label_error"))
    digest = hashlib.sha256(",".join(str(x) for book in books for x in book.reshape(-1).tolist()).encode()).hexdigest()
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))

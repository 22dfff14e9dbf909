"""Registered queries over runs of cards: files of JSON are written from ``part`` and taken in from there.

A file holds a hundred cards under ``products``; their keys, and the forms of their prices, differ from card to card.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cut import place
from ..sources import runs, saved
from .catalog import query
from .view import table


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cards of a run: of one shop known by its address, of one by its label, of one by nothing."""
    n, size = F.col("p_partkey"), F.col("p_size")
    file = F.floor(n / 100)
    shop, title = file % 3, F.when((n % 11 > 0) | (file % 3 == 0), F.concat(F.lit("Widget "), n))
    card = F.struct(
        F.when(shop == 1, "Amazon IN").alias("platform"),
        F.when(shop == 0, F.concat(F.lit("https://www.flipkart.com/widget-"), n, F.lit("/p/itm?pid=W"), n)).alias("product_url"),
        F.when(n % 2 == 0, title).alias("product_name"),
        F.when(n % 2 == 1, title).alias("title"),
        F.when(n % 3 == 0, F.struct((size * 100).alias("value"), F.lit("INR").alias("currency"))).alias("selling_price"),
        F.when(n % 3 == 1, F.concat(F.lit("₹"), size, F.lit(","), F.lpad((n % 1000).cast("string"), 3, "0"))).alias("final_price"),
        F.when(n % 5 == 0, size * 150).alias("original_price"),
        F.when(n % 7 == 0, "25% off").alias("discount_percentage"),
        F.when(n % 6 == 0, False).alias("in_stock"),
        F.when(n % 6 == 1, "In stock").when(n % 6 == 2, "Sold out").alias("availability"),
        F.when(n % 4 > 0, (n % 20 + 30) / 10.0).alias("rating"),
        F.when(n % 4 > 0, F.concat(n % 90 + 1, F.lit("K ratings"))).alias("review_count"),
        F.when(n % 8 == 0, "true").alias("sponsored"),
        F.when(n % 13 == 0, "timeout").alias("error"),
    )
    path = place(spark, "run")
    table(spark, sf_dir, "part").groupBy(file.alias("file")).agg(F.collect_list(card).alias("products")).select("products").write.option("maxRecordsPerFile", 1).json(path)
    return runs.cards(spark, path)


_CARD = """WITH t AS (SELECT p_partkey AS n, p_size AS size, p_partkey // 100 % 3 AS shop FROM part),
c AS (SELECT *, CASE shop WHEN 0 THEN 'flipkart' WHEN 1 THEN 'amazon' ELSE 'unknown' END AS platform, CASE n % 3 WHEN 0 THEN size * 100 WHEN 1 THEN size * 1000 + n % 1000 END AS price, n % 13 = 0 AS error FROM t),
m AS (SELECT *, CASE WHEN n % 5 = 0 AND n % 3 <> 1 THEN size * 150 END AS mrp FROM c)"""


@query(_CARD + """ SELECT platform, 'Widget ' || n AS title, CAST(price AS DOUBLE) AS price, CAST(mrp AS DOUBLE) AS mrp, CAST(CASE WHEN n % 7 = 0 THEN 25 WHEN mrp IS NOT NULL AND price IS NOT NULL THEN 33 END AS INTEGER) AS discount_pct, CASE n % 6 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN false END AS in_stock,
 CASE WHEN n % 4 > 0 THEN (n % 20 + 30) / CAST(10 AS DOUBLE) END AS rating, CASE WHEN n % 4 > 0 THEN CAST((n % 90 + 1) * 1000 AS BIGINT) END AS rating_count, n % 8 = 0 AS sponsored, concat_ws(',', CASE WHEN price IS NULL THEN 'price' END, CASE WHEN mrp IS NULL THEN 'mrp' END, CASE WHEN n % 4 = 0 THEN 'rating' END) AS missing FROM m WHERE NOT error AND (n % 11 > 0 OR shop = 0)""")
def card_listings(spark, sf_dir):
    """Cards of any shape to listings; error cards and those without a title or an address go."""
    out = runs.listings(_run(spark, sf_dir))
    return out.select("platform", "title", F.col("price").cast("double").alias("price"), F.col("mrp").cast("double").alias("mrp"), "discount_pct", "in_stock", F.col("rating").cast("double").alias("rating"), F.col("rating_count").cast("long").alias("rating_count"), "sponsored", F.array_join("missing", ",").alias("missing"))


@query(_CARD + " SELECT platform, count(*) AS raw_cards, count(*) FILTER (WHERE error) AS errors, CASE WHEN bool_or(error) THEN 'timeout' END AS first_error, CASE WHEN bool_or(NOT error) THEN 'ok' ELSE 'error' END AS status FROM m GROUP BY platform")
def scan_health(spark, sf_dir):
    return runs.health(_run(spark, sf_dir)).select("platform", "raw_cards", "errors", "first_error", "status")


@query("""WITH c AS (SELECT p_partkey AS n, p_size AS size, ['flipkart', 'amazon', 'reliance'][p_partkey % 3 + 1] AS platform, p_partkey % 5 + 1 AS page, CASE p_partkey % 4 WHEN 0 THEN p_size * 100 WHEN 1 THEN p_size * 1000 + p_partkey % 1000 WHEN 2 THEN p_size * 10 END AS price FROM part)
SELECT platform, page, count(*) AS cards, CAST(sum(price) AS BIGINT) AS total, min(n) AS first FROM c WHERE platform IN ('flipkart', 'amazon') AND page <= 2 AND price <= 20000 AND price > 100 GROUP BY ALL""")
def saved_cards(spark, sf_dir):
    """A run saved by platform and page, read again by a source that takes in what is asked of platform, page and budget."""
    n, size = F.col("p_partkey"), F.col("p_size")
    price = F.when(n % 4 == 1, F.concat(F.lit("₹"), size, F.lit(","), F.lpad((n % 1000).cast("string"), 3, "0"))).when(n % 4 == 2, (size * 10).cast("string"))
    card = F.struct(F.concat(F.lit("Widget "), n).alias("title"), F.when(n % 4 == 0, F.struct((size * 100).alias("value"))).alias("selling_price"), price.alias("final_price"), n.alias("id"))
    path = place(spark, "saved")
    platform = F.get(F.array(*map(F.lit, ["flipkart", "amazon", "reliance"])), (n % 3).cast("int"))
    saved.save(table(spark, sf_dir, "part").select(platform.alias("platform"), (n % 5 + 1).alias("page"), F.to_json(card).alias("raw")), path)
    rows = saved.saved_runs(spark, path).where(F.col("platform").isin("flipkart", "amazon") & (F.col("page") <= 2) & (F.col("price") <= 20000) & (F.col("price") > 100))
    return rows.groupBy("platform", F.col("page").cast("long").alias("page")).agg(F.count("*").alias("cards"), F.sum("price").cast("long").alias("total"), F.min(F.get_json_object("raw", "$.id").cast("long")).alias("first"))


@query(_CARD + " SELECT platform, count(*) AS raw_cards, count(*) FILTER (WHERE error) AS error_cards, CAST(0 AS BIGINT) AS title_recovered, count(*) FILTER (WHERE NOT error AND n % 11 = 0 AND shop > 0) AS dropped FROM m GROUP BY platform")
def scan_counts(spark, sf_dir):
    """What became of every platform's cards."""
    return runs.scan_counts(_run(spark, sf_dir))

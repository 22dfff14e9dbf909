"""Registered catalogue queries and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import maths as m
from ..functions import parse
from ..functions.cut import written
from ..operators import external, grouping, history, ranking, text
from ..operators.globalrank import global_medians, global_row_number
from .view import LISTING, OBSERVATION, listings, observations, table

KEYS = ["model", "config"]
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    """Register a function as a query of its own name with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


CANDIDATE = f"""WITH {LISTING},
off AS (SELECT model, config, platform, price, min(CASE WHEN in_stock THEN 0 WHEN in_stock IS NULL THEN 1 ELSE 2 END) AS stock FROM listing WHERE price IS NOT NULL GROUP BY ALL),
best AS (SELECT model, config, count(*) AS n_offers, arg_min(price, stock * 1000000000000 + price) AS price, max(price) - arg_min(price, stock * 1000000000000 + price) AS spread, min(stock) AS stock FROM off GROUP BY ALL),
rp AS (SELECT model, config, platform, arg_min(rating, -rating_count * 1000000000000 + ord) AS rating, max(rating_count) AS votes FROM listing WHERE rating IS NOT NULL GROUP BY ALL),
rr AS (SELECT model, config, floor(CASE WHEN sum(votes) > 0 THEN sum(rating * votes) / sum(votes) ELSE avg(rating) END * CAST(10 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(10 AS DOUBLE) AS rating, CAST(nullif(sum(votes), 0) AS BIGINT) AS rating_count FROM rp GROUP BY ALL),
attr AS (SELECT model, config, min(brand) AS brand, min(size) AS size, CAST(max(discount) AS BIGINT) AS discount FROM listing GROUP BY ALL),
cand AS (SELECT best.*, rr.rating, rr.rating_count, brand, size, discount FROM best LEFT JOIN rr USING (model, config) JOIN attr USING (model, config))"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per model and configuration: best offer, spread, blended rating, attributes."""
    # Written, so that line items meet their parts once and not for each of the three groupings.
    rows = written(listings(spark, sf_dir).drop("type"), "offered")
    offers = grouping.best_offers(rows, KEYS)
    best = offers.select(*KEYS, F.size("offers").cast("long").alias("n_offers"), F.col("best.price").alias("price"), "spread", F.col("best.stock").alias("stock"))
    rated = grouping.blend_rating(rows, KEYS)
    attr = rows.groupBy(*KEYS).agg(F.min("brand").alias("brand"), F.min("size").alias("size"), F.max("discount").alias("discount"))
    return best.join(rated, KEYS, "left").join(attr, KEYS)


def intents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("q1", 150000), ("q2", 120000), ("q3", None)], "query_id string, budget_max long")


INTENT = "intent AS (SELECT * FROM (VALUES ('q1', 150000), ('q2', 120000), ('q3', NULL)) AS t(query_id, budget_max))"

_SCORED = CANDIDATE + f""", {INTENT},
s0 AS (SELECT query_id, cand.* FROM cand, intent WHERE price > 0 AND (budget_max IS NULL OR price <= budget_max)),
s1 AS (SELECT *, CASE WHEN size <= 2 THEN 10 WHEN size <= 10 THEN 10 + (size - 2) / CAST(8 AS DOUBLE) * 50 WHEN size <= 50 THEN 60 + (size - 10) / CAST(40 AS DOUBLE) * 40 ELSE 100 END AS spec, avg(rating) OVER (PARTITION BY query_id) AS prior, median(price) OVER (PARTITION BY query_id) AS med FROM s0),
s2 AS (SELECT *, coalesce(rating_count, 0) / (coalesce(rating_count, 0) + CAST(500 AS DOUBLE)) * rating + 500 / (coalesce(rating_count, 0) + CAST(500 AS DOUBLE)) * coalesce(prior, 4) AS blended, least(greatest(CAST(0.35 AS DOUBLE) + log10(coalesce(rating_count, 0) + 1) / CAST(5.5 AS DOUBLE), CAST(0.35 AS DOUBLE)), CAST(1 AS DOUBLE)) AS ev FROM s1),
s3 AS (SELECT *, CASE WHEN rating IS NOT NULL THEN least(greatest(45 + (least(greatest((blended - 3) / CAST(1.7 AS DOUBLE) * 100, CAST(0 AS DOUBLE)), CAST(100 AS DOUBLE)) - 45) * ev, CAST(0 AS DOUBLE)), CAST(100 AS DOUBLE)) END AS trust,
 least(greatest(CAST(50 AS DOUBLE) + CASE WHEN discount > 55 THEN -6 ELSE CAST(0.6 AS DOUBLE) * CASE WHEN discount <= 40 THEN discount ELSE greatest(CAST(0 AS DOUBLE), 40 - CAST(2 AS DOUBLE) * (discount - 40)) END END + CASE WHEN n_offers > 1 THEN CASE WHEN spread > 0 THEN least(CAST(15 AS DOUBLE), spread / CAST(price AS DOUBLE) * 100) ELSE 0 END + 5 ELSE 0 END + CASE WHEN price < med THEN 5 ELSE 0 END, CAST(0 AS DOUBLE)), CAST(100 AS DOUBLE)) AS deal,
 spec / (price / CAST(1000 AS DOUBLE)) AS ratio FROM s2),
s4 AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY query_id) <= 1 THEN 50 ELSE percent_rank() OVER (PARTITION BY query_id ORDER BY ratio) * 100 END AS value FROM s3),
s5 AS (SELECT *, floor((CAST(0.35 AS DOUBLE) * value + CAST(0.30 AS DOUBLE) * spec + CAST(0.20 AS DOUBLE) * coalesce(trust, 45) + CAST(0.15 AS DOUBLE) * deal) * 10 + CAST(0.5 AS DOUBLE)) / CAST(10 AS DOUBLE) AS total FROM s4),
s6 AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY stock = 2, total DESC, price, model, config) AS INTEGER) AS rank FROM s5)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivors of every query with their scores and rank."""
    # Three queries, a row of the result for each candidate and query that it suits.
    rows = candidates(spark, sf_dir).join(intents(spark), F.lit(True))
    rows = rows.where((F.col("price") > 0) & F.coalesce(F.col("price") <= F.col("budget_max"), F.lit(True))).drop("budget_max")
    rows = written(rows.withColumn("spec", m.curve(F.col("size"), [(2, 10), (10, 60), (50, 100)])), "survivors")
    over = rows.groupBy("query_id").agg(F.coalesce(F.avg("rating"), F.lit(4.0)).alias("prior")).join(global_medians(rows, ["query_id"], ["price"]).withColumnRenamed("price", "med"), "query_id")
    rows = rows.join(over, "query_id")
    rows = rows.withColumn("trust", m.trust(F.col("rating"), F.col("rating_count"), F.col("prior")))
    rows = rows.withColumn("deal", m.deal(F.col("discount"), F.col("price"), F.col("price"), F.col("spread"), F.col("n_offers"), F.col("med")))
    rows = ranking.with_percentile(rows, F.col("spec") / (F.col("price") / 1000.0), "value")
    total = 0.35 * F.col("value") + 0.30 * F.col("spec") + 0.20 * F.coalesce("trust", F.lit(45.0)) + 0.15 * F.col("deal")
    rows = rows.withColumn("total", m.jround(total, 1)).withColumn("name", F.concat_ws(" ", "model", "config")).withColumn("in_stock", F.when(F.col("stock") == 2, False).when(F.col("stock") == 0, True))
    return ranking.ranked(rows, [F.col("stock") == 2, F.desc("total"), F.col("price"), F.col("model"), F.col("config")])


@query(_SCORED + " SELECT query_id, rank, model, config, brand, price, n_offers, rating, total FROM s6")
def catalog_rank(spark, sf_dir):
    return scored(spark, sf_dir).select("query_id", "rank", "model", "config", "brand", "price", "n_offers", "rating", "total")


@query(_SCORED + " SELECT query_id, rank, floor(value * 1000 + CAST(0.5 AS DOUBLE)) / 1000 AS value FROM s6")
def value_percentile(spark, sf_dir):
    return scored(spark, sf_dir).select("query_id", "rank", m.jround(F.col("value"), 3).alias("value"))


@query(_SCORED + " SELECT query_id, rank, floor(trust * 1000 + CAST(0.5 AS DOUBLE)) / 1000 AS trust FROM s6")
def trust_shrinkage(spark, sf_dir):
    return scored(spark, sf_dir).select("query_id", "rank", m.jround(F.col("trust"), 3).alias("trust"))


@query(_SCORED + " SELECT query_id, rank, floor(deal * 1000 + CAST(0.5 AS DOUBLE)) / 1000 AS deal FROM s6")
def deal_score(spark, sf_dir):
    return scored(spark, sf_dir).select("query_id", "rank", m.jround(F.col("deal"), 3).alias("deal"))


@query(_SCORED + ", f AS (SELECT query_id, model, min(rank) AS fr, arg_min(model || ' ' || config, rank) AS fn FROM s6 GROUP BY ALL) SELECT query_id, rank, CASE WHEN rank <> fr THEN fn END AS variant_of FROM s6 JOIN f USING (query_id, model)")
def variant_first(spark, sf_dir):
    return scored(spark, sf_dir).select("query_id", "rank", "variant_of")


@query(_SCORED + ", f AS (SELECT *, row_number() OVER (PARTITION BY query_id, model ORDER BY rank) AS n FROM s6) SELECT query_id, model, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM f WHERE n = 1) WHERE k <= 5")
def family_topn(spark, sf_dir):
    heads = grouping.topn_per(scored(spark, sf_dir), ["query_id", "model"], [F.col("rank")], 1, "n")
    return grouping.topn_per(heads, ["query_id"], [F.col("rank")], 5, "k").select("query_id", "model", "rank")


_BADGES = """, c0 AS (SELECT *, CASE WHEN size % 7 > 1 THEN size % 7 / CAST(7 AS DOUBLE) + CAST(0.1 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END AS confidence, size % 4 <> 0 AS chip, CASE WHEN size % 5 <> 0 THEN spec END AS speed, size * 2 % 37 + discount AS lasting FROM s6),
c1 AS (SELECT *, stock <> 2 AND confidence >= CAST(0.6 AS DOUBLE) AND chip AND coalesce(rating_count, 0) >= 100 AND coalesce(rating, 0) >= CAST(3.5 AS DOUBLE) AS sure, count(*) FILTER (WHERE confidence >= 0.5) OVER (PARTITION BY query_id) AS n FROM c0),
c2 AS (SELECT *, n < 2 OR confidence >= CAST(0.5 AS DOUBLE) AS pool FROM c1), c3 AS (SELECT *, count(*) FILTER (WHERE pool AND sure) OVER (PARTITION BY query_id) AS m FROM c2),
b AS (SELECT query_id, arg_min(rank, (-value, rank)) FILTER (WHERE pool AND (m < 2 OR sure)) AS bv, arg_min(rank, (price, rank)) AS ch, arg_min(rank, (-speed, rank)) FILTER (WHERE pool AND speed IS NOT NULL) AS fa, arg_min(rank, (-lasting, rank)) FILTER (WHERE pool) AS la, arg_min(rank, (-trust, rank)) FILTER (WHERE pool AND coalesce(rating_count, 0) > 500 AND trust IS NOT NULL) AS br, max(speed) FILTER (WHERE pool) AS ts, max(lasting) FILTER (WHERE pool) AS tl FROM c3 GROUP BY query_id),
d AS (SELECT query_id, count(*) FILTER (WHERE pool AND speed >= ts - CAST(0.5 AS DOUBLE)) AS ns, count(*) FILTER (WHERE pool AND lasting >= tl - CAST(0.5 AS DOUBLE)) AS nl FROM c3 JOIN b USING (query_id) GROUP BY query_id)
SELECT query_id, rank, CASE WHEN rank = 1 THEN 'TOP PICK,' ELSE '' END || CASE WHEN stock = 2 THEN 'OUT OF STOCK,' ELSE '' END || CASE WHEN rank = bv AND sure THEN 'BEST VALUE,' ELSE '' END || CASE WHEN rank = ch THEN 'CHEAPEST,' ELSE '' END || CASE WHEN rank = fa AND ns = 1 AND sure THEN 'FASTEST,' ELSE '' END || CASE WHEN rank = la AND nl = 1 THEN 'BATTERY KING,' ELSE '' END || CASE WHEN rank = br THEN 'BEST RATED,' ELSE '' END AS badges FROM c3 JOIN b USING (query_id) JOIN d USING (query_id)"""


@query(_SCORED + _BADGES)
def badge_argmax(spark, sf_dir):
    size = F.col("size")
    rows = scored(spark, sf_dir).withColumn("confidence", F.when(size % 7 > 1, size % 7 / 7.0 + 0.1).otherwise(0.3)).withColumn("soc_name", F.when(size % 4 != 0, "chip"))
    rows = rows.withColumn("performance", F.when(size % 5 != 0, F.col("spec"))).withColumn("battery", (size * 2 % 37 + F.col("discount")).cast("double")).withColumns({"antutu": F.lit(1), "battery_mah": F.lit(1)})
    out = ranking.badges(rows)
    return out.select("query_id", "rank", F.array_join(F.transform("badges", lambda b: F.concat(b, F.lit(","))), "").alias("badges"))


@query(CANDIDATE + " SELECT model, config, n_offers, price, spread, CAST(stock AS INTEGER) AS stock FROM cand")
def offers_dedup_best(spark, sf_dir):
    return candidates(spark, sf_dir).select(*KEYS, "n_offers", "price", "spread", "stock")


@query(CANDIDATE + " SELECT model, config, rating, rating_count FROM rr")
def blend_rating(spark, sf_dir):
    return grouping.blend_rating(listings(spark, sf_dir), KEYS).select(*KEYS, "rating", "rating_count")


@query(f"""WITH {LISTING}, c AS (SELECT *, (CASE WHEN rating IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN in_stock IS NOT NULL THEN 1 ELSE 0 END) AS completeness FROM listing)
SELECT model, config, arg_min(rating, -completeness * 1000000000000 + ord) FILTER (WHERE rating IS NOT NULL) AS rating, min_by(ord, -completeness * 1000000000000 + ord) FILTER (WHERE rating IS NOT NULL) AS rating_from, arg_min(in_stock, -completeness * 1000000000000 + ord) FILTER (WHERE in_stock IS NOT NULL) AS in_stock, CAST(max(completeness) AS INTEGER) AS completeness FROM c GROUP BY ALL""")
def merge_first_non_null(spark, sf_dir):
    rows = listings(spark, sf_dir).withColumn("completeness", F.col("rating").isNotNull().cast("int") + F.col("in_stock").isNotNull().cast("int"))
    return grouping.merge_fields(rows, KEYS, ["rating", "in_stock"]).select(*KEYS, "rating", "rating_from", "in_stock", "completeness")


@query(f"WITH {LISTING}, s AS (SELECT model, type, CAST(sum(discount) AS BIGINT) AS w, min(ord) AS o FROM listing GROUP BY ALL) SELECT model, arg_max(type, w * 1000000000000 - o) AS type, max(w) AS weight FROM s GROUP BY model")
def majority_category(spark, sf_dir):
    return grouping.majority(listings(spark, sf_dir), ["model"], "type", "discount").select("model", "type", "weight")


@query(f"""WITH {LISTING}, l AS (SELECT model, config, min(price) AS low FROM listing GROUP BY ALL)
SELECT a.model, a.config, coalesce(string_agg(b.config || ':' || b.low, ',' ORDER BY b.config), '') AS siblings FROM l a LEFT JOIN l b ON a.model = b.model AND a.config <> b.config GROUP BY ALL""")
def sibling_configs(spark, sf_dir):
    out = grouping.siblings(listings(spark, sf_dir))
    return out.select(*KEYS, F.array_join(F.transform("siblings", lambda s: F.concat_ws(":", s["config"], s["low"])), ",").alias("siblings"))


def _fold_sql(rows: str) -> str:
    """Folds one after another, in the order of first listings: the state is the list of known configurations."""
    return f"""WITH RECURSIVE {rows},
c AS (SELECT model, config, min(price) AS price, min(ord) AS ord FROM listing GROUP BY ALL),
k AS (SELECT model, list(struct_pack(price := coalesce(CAST(price AS DOUBLE), CAST('inf' AS DOUBLE)), ord := ord, config := config) ORDER BY ord, config) AS known FROM c WHERE config NOT LIKE '%?%' GROUP BY model),
p AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY ord, config) AS n FROM c WHERE config LIKE '%?%'),
f(model, n, known, config, target) AS (SELECT model, CAST(0 AS BIGINT), known, '', '' FROM k UNION ALL
 SELECT model, n, list_transform(known, lambda x: struct_pack(price := CASE WHEN x.config = t THEN least(x.price, price) ELSE x.price END, ord := x.ord, config := x.config)), config, coalesce(t, config) FROM (
  SELECT *, list_min(list_filter(CASE WHEN len(alike) > 0 THEN alike ELSE known END, lambda x: x.price < CAST('inf' AS DOUBLE))).config AS t FROM (
   SELECT f.model, p.n, f.known, p.config, coalesce(CAST(p.price AS DOUBLE), CAST('inf' AS DOUBLE)) AS price, list_filter(f.known, lambda x: split_part(x.config, '-', 2) = split_part(p.config, '-', 2)) AS alike FROM f JOIN p ON f.model = p.model AND p.n = f.n + 1)))
SELECT c.model, c.config, coalesce(f.target, c.config) AS target FROM c LEFT JOIN f ON c.model = f.model AND c.config = f.config"""


@query(_fold_sql(LISTING))
def fold_partial_configs(spark, sf_dir):
    return grouping.fold_configs(listings(spark, sf_dir))


@query(_fold_sql("""listing AS (SELECT 'm' || (l_orderkey // 4) AS model, ['8r-128s', '?r-128s', '6r-64s', '?r-?s', '4r-64s', '6r-?s', '8r-256s', '?r-256s', '?r-512s'][l_partkey % 9 + 1] AS config, CASE WHEN l_partkey % 5 > 0 THEN CAST(floor(l_extendedprice) AS BIGINT) END AS price, l_orderkey * 10 + l_linenumber AS ord FROM lineitem)"""))
def fold_in_order(spark, sf_dir):
    """Several partly unknown configurations of a model, some without a price: an earlier fold makes its target cheaper for the next."""
    n = F.col("l_partkey")
    configs = F.array(*map(F.lit, ["8r-128s", "?r-128s", "6r-64s", "?r-?s", "4r-64s", "6r-?s", "8r-256s", "?r-256s", "?r-512s"]))
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("m"), F.floor(F.col("l_orderkey") / 4)).alias("model"), F.get(configs, (n % 9).cast("int")).alias("config"), F.when(n % 5 > 0, F.floor("l_extendedprice")).alias("price"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return grouping.fold_configs(rows)


@query("WITH s AS (SELECT p_partkey, p_brand, CASE WHEN p_size % 3 <> 0 THEN CAST(p_size AS DOUBLE) END AS score FROM part), m AS (SELECT p_brand, coalesce(median(score), 50) * CAST(0.9 AS DOUBLE) AS peer FROM s GROUP BY p_brand) SELECT p_partkey, floor(coalesce(score, peer) * 1000 + CAST(0.5 AS DOUBLE)) / 1000 AS score FROM s JOIN m USING (p_brand)")
def peer_median_impute(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") % 3 != 0, F.col("p_size").cast("double")).alias("score"))
    out = ranking.imputed(rows, ["score"], "p_brand")
    return out.select("p_partkey", m.jround(F.coalesce("score", "score_peer"), 3).alias("score"))


def _curve_sql(x: str, points) -> str:
    out = f"CASE WHEN {x} <= {points[0][0]} THEN CAST({points[0][1]} AS DOUBLE)"
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        out += f" WHEN {x} <= {x1} THEN {y0} + ({x} - {x0}) / CAST({x1 - x0} AS DOUBLE) * {y1 - y0}"
    return out + f" ELSE CAST({points[-1][1]} AS DOUBLE) END"


@query(f"SELECT p_partkey, floor({_curve_sql('p_size', m.RAM)} * 1000 + CAST(0.5 AS DOUBLE)) / 1000 AS ram, floor({_curve_sql('(p_size * 100)', m.BATTERY)} * 1000 + CAST(0.5 AS DOUBLE)) / 1000 AS battery, floor(({_curve_sql('p_size', m.RAM)} / 2 + {_curve_sql('(p_size * 20)', m.STORAGE)} / 2) * 1000 + CAST(0.5 AS DOUBLE)) / 1000 AS memory FROM part")
def curve_scores(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", m.jround(m.curve(size, m.RAM), 3).alias("ram"), m.jround(m.curve(size * 100, m.BATTERY), 3).alias("battery"), m.jround(m.memory(size, size * 20), 3).alias("memory"))


@query(f"WITH {LISTING} SELECT brand, list_sort(list(price))[len(list(price)) // 2 + 1] AS median_price, count(*) AS n FROM listing GROUP BY brand")
def upper_median_price(spark, sf_dir):
    return listings(spark, sf_dir).groupBy("brand").agg(grouping.upper_median("price").cast("long").alias("median_price"), F.count("*").alias("n"))


_STATS = f"""WITH {OBSERVATION}, s AS (SELECT key, min(price) AS low, max(price) AS high, CAST(sum(price) AS BIGINT) AS total, count(*) AS observations, arg_max(price, (ts, ord)) AS current, count(DISTINCT ts) AS runs FROM observation GROUP BY key),
st AS (SELECT key, low, high, floor(total / CAST(observations AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS average, current, observations, runs, CASE WHEN high > low THEN floor((current - low) / CAST(high - low AS DOUBLE) * 10000 + CAST(0.5 AS DOUBLE)) / 10000 ELSE 0 END AS position,
 CASE WHEN observations < 2 THEN 'stable' WHEN current < (total - current) / CAST(observations - 1 AS DOUBLE) * CAST(0.98 AS DOUBLE) THEN 'falling' WHEN current > (total - current) / CAST(observations - 1 AS DOUBLE) * CAST(1.02 AS DOUBLE) THEN 'rising' ELSE 'stable' END AS trend FROM s)"""


@query(_STATS + " SELECT key, low, high, average, current, observations, runs, position, trend FROM st")
def price_stats(spark, sf_dir):
    return history.stats(observations(spark, sf_dir)).select("key", "low", "high", "average", "current", "observations", "runs", "position", "trend")


@query(_STATS + ", seen AS (SELECT key, max(ts) AS last_seen FROM observation GROUP BY key) SELECT key, last_seen, observations, trend FROM st JOIN seen USING (key) ORDER BY last_seen DESC, key LIMIT 20")
def tracked_topk(spark, sf_dir):
    return history.tracked(observations(spark, sf_dir), 20).select("key", "last_seen", "observations", "trend")


_SERIES = f"WITH {OBSERVATION}, t AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, ord DESC) AS n FROM observation), se AS (SELECT key, ts, min(price) AS price FROM t WHERE n <= 10 GROUP BY ALL)"


@query(_SERIES + " SELECT key, ts, price FROM se")
def price_series(spark, sf_dir):
    return history.series(observations(spark, sf_dir), 10)


@query(_SERIES + ", x AS (SELECT *, min(price) OVER (PARTITION BY key) AS lo, max(price) OVER (PARTITION BY key) AS hi FROM se) SELECT key, ts, price, CASE WHEN hi > lo THEN least(7, CAST(floor((price - lo) / CAST(hi - lo AS DOUBLE) * 8) AS INTEGER)) ELSE 3 END AS level FROM x")
def sparkline_bucket(spark, sf_dir):
    return history.buckets(history.series(observations(spark, sf_dir), 10))


@query(f"WITH {OBSERVATION}, m AS (SELECT max(ts) AS now FROM observation), t AS (SELECT o.*, row_number() OVER (PARTITION BY key ORDER BY ts DESC, ord DESC) AS n FROM observation o, m WHERE ts <= now AND ts > now - INTERVAL 7 DAY) SELECT key, ts, price FROM t WHERE n = 1")
def ttl_cache_latest(spark, sf_dir):
    rows = observations(spark, sf_dir)
    now = rows.agg(F.max("ts").alias("now"))
    return history.latest(rows.join(F.broadcast(now), F.lit(True)), "key", F.col("now"), 7 * 86400).select("key", "ts", "price")


@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'cached' ELSE 'fetch' END AS side FROM documents")
def cache_semi_split(spark, sf_dir):
    d, known = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id").distinct()
    return d.join(known, "doc_id", "left_semi").withColumn("side", F.lit("cached")).unionByName(d.join(known, "doc_id", "left_anti").withColumn("side", F.lit("fetch")))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def anti_second_source(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(good, "doc_id", "left_anti")


@query("WITH f AS (SELECT l_partkey AS part, arg_min(o_orderpriority, l_orderkey * 10 + l_linenumber) AS priority, min(l_orderkey * 10 + l_linenumber) AS ord FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY l_partkey) SELECT p_partkey AS part, f.priority FROM part LEFT JOIN f ON p_partkey = part")
def attach_first_match(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"))
    return grouping.attach_first(parts, l, o, "part", "id", ["priority"])


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#\d+;', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages""")
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.html_to_text(F.col("html")).alias("text"))


@query("""SELECT page_id, regexp_replace(url, '[?#].*$', '') || CASE page_id % 3 WHEN 0 THEN '?pid=P' || page_id WHEN 1 THEN '?pid=A&skuId=' || page_id ELSE '' END AS url FROM pages""")
def canonical_url(spark, sf_dir):
    n = F.col("page_id")
    more = F.when(n % 3 == 0, F.concat(F.lit("pid=P"), n, F.lit("&ref=x"))).when(n % 3 == 1, F.concat(F.lit("skuId="), n, F.lit("&utm=1&pid=A#top"))).otherwise("q=pid")
    given = F.concat(F.substring_index("url", "#", 1), F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), more)
    return table(spark, sf_dir, "pages").select("page_id", parse.canonical_url(given).alias("url"))


ASPECTS = [("service", r"\b(order|delivery|return)\b"), ("value", r"\b(price|cost|value)\b"), ("the", r"\bthe\b")]


@query(r"""WITH c AS (SELECT conv_id * 1000 + turn AS id, unnest(regexp_split_to_array(lower(text), '[.!?,;]+|\b(?:and|but)\b')) AS clause, generate_subscripts(regexp_split_to_array(lower(text), '[.!?,;]+|\b(?:and|but)\b'), 1) AS pos FROM conversations WHERE role = 'user'),
t AS (SELECT id, pos, trim(clause) AS clause FROM c WHERE length(trim(clause)) > 2),
a AS (SELECT id, pos, clause, 'service' AS aspect FROM t WHERE regexp_matches(clause, '\b(order|delivery|return)\b') UNION ALL SELECT id, pos, clause, 'value' FROM t WHERE regexp_matches(clause, '\b(price|cost|value)\b') UNION ALL SELECT id, pos, clause, 'the' FROM t WHERE regexp_matches(clause, '\bthe\b')),
s AS (SELECT *, CASE WHEN regexp_matches(clause, '\b(good|is)\b') AND NOT regexp_matches(clause, '\b(bad|was)\b') THEN CASE WHEN regexp_matches(clause, '\b(not|to)\b') THEN -1 ELSE 1 END WHEN regexp_matches(clause, '\b(bad|was)\b') AND NOT regexp_matches(clause, '\b(good|is)\b') THEN CASE WHEN regexp_matches(clause, '\b(not|to)\b') THEN 1 ELSE -1 END ELSE 0 END AS side FROM a)
SELECT aspect, count(*) FILTER (WHERE side > 0) AS positive, count(*) FILTER (WHERE side < 0) AS negative FROM s WHERE side <> 0 GROUP BY aspect""")
def clause_aspects(spark, sf_dir):
    users = table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return text.aspects(users, "id", "text", ASPECTS, r"\b(good|is)\b", r"\b(bad|was)\b", r"\b(not|to)\b").select("aspect", "positive", "negative")


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents), g AS (SELECT doc_id AS id, unnest(list_distinct(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))]))) AS phrase FROM w),
p AS (SELECT DISTINCT lower(n_name) AS phrase FROM nation UNION SELECT 'the of' UNION SELECT 'de la' UNION SELECT 'der die') SELECT id, arg_min(g.phrase, (-length(g.phrase), g.phrase)) AS phrase FROM g JOIN p ON g.phrase = p.phrase GROUP BY id""")
def dict_longest_match(spark, sf_dir):
    phrases = table(spark, sf_dir, "nation").select(F.col("n_name").alias("phrase")).unionByName(spark.createDataFrame([("the of",), ("de la",), ("der die",)], "phrase string"))
    return text.longest_match(table(spark, sf_dir, "documents"), "doc_id", "text", phrases)


@query("""WITH i AS (SELECT DISTINCT lower(p_brand) AS of, p_name AS name, 's' || (length(p_name) * 3 + p_size % 3) AS slug FROM part),
b AS (SELECT of, name, slug, regexp_replace(of || ' ' || name, '[^a-z0-9 ]', ' ', 'g') AS full FROM i), p AS (SELECT p_partkey, lower(p_brand) AS of, CASE WHEN p_size % 2 = 0 THEN p_name ELSE regexp_replace(lower(p_brand) || ' ' || p_name, '[^a-z0-9 ]', ' ', 'g') END AS wanted FROM part),
h AS (SELECT p_partkey, slug FROM p JOIN b ON p.of = b.of AND (p.wanted = b.name OR p.wanted = b.full)) SELECT p_partkey AS id, min(slug) AS slug FROM h GROUP BY p_partkey HAVING count(DISTINCT slug) = 1""")
def resolve_unambiguous(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    index = parts.select(F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.concat(F.lit("s"), F.length("p_name") * 3 + F.col("p_size") % 3).alias("slug")).distinct()
    brand = F.regexp_replace(F.lower("p_brand"), "[^a-z0-9 ]", " ")
    asked = parts.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.concat_ws(" ", brand, "p_name")).alias("name"), F.col("p_brand").alias("brand"))
    return external.resolve(asked, index)


@query(_SCORED + ", l AS (SELECT query_id, rank, unnest(['price', 'total', 'rating']) AS metric, unnest([CAST(price AS DOUBLE), total, rating]) AS x FROM s6 WHERE rank <= 3) SELECT query_id, metric, max(x) FILTER (WHERE rank = 1) AS r1, max(x) FILTER (WHERE rank = 2) AS r2, max(x) FILTER (WHERE rank = 3) AS r3 FROM l GROUP BY ALL")
def compare_matrix(spark, sf_dir):
    top = scored(spark, sf_dir).where("rank <= 3").select("query_id", "rank", F.col("price").cast("double").alias("price"), "total", "rating")
    long = top.unpivot(["query_id", "rank"], ["price", "total", "rating"], "metric", "x")
    return long.groupBy("query_id", "metric").pivot("rank", [1, 2, 3]).agg(F.max("x")).toDF("query_id", "metric", "r1", "r2", "r3")


@query(r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ('the', 'with')) AS a FROM documents), b AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS n, regexp_split_to_array(lower(text), '[^a-z0-9]+') AS b, count(*) OVER () AS size FROM benchmark)
SELECT doc_id, CAST(len(list_filter(a, lambda w: list_contains(b, w))) AS INTEGER) AS n FROM d JOIN b ON doc_id % size = n""")
def token_overlap(spark, sf_dir):
    """Each document against one benchmark item, by the items' places in their order; places come from ranges of it."""
    items = global_row_number(table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("other")), [], [F.col("item_id")], "place", int(spark.conf.get("spark.sql.shuffle.partitions")))
    size = items.agg(F.count("*").alias("size"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(size, F.lit(True))
    both = docs.withColumn("place", F.col("doc_id") % F.col("size") + 1).join(items, "place")
    return both.select("doc_id", text.token_overlap(F.col("text"), F.col("other"), ["the", "with"]).alias("n"))


@query("""WITH n AS (SELECT q.p_partkey AS q, k.p_retailprice / (k.p_size + 1) AS r, row_number() OVER (PARTITION BY q.p_partkey ORDER BY abs(q.p_size - k.p_size), k.p_partkey) AS i FROM part q, part k) SELECT q, floor(list_sort(list(r))[3] * 1000 + CAST(0.5 AS DOUBLE)) / 1000 AS ratio FROM n WHERE i <= 5 GROUP BY q""")
def knn_ratio(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("x"), (F.col("p_retailprice") / (F.col("p_size") + 1)).alias("r"))
    return grouping.nearest_ratio(parts.select(F.col("p_partkey").alias("k"), "x", "r"), parts.select(F.col("p_partkey").alias("q"), "x"), 5)


@query("""WITH p AS (SELECT p_partkey AS k, p_retailprice + p_size / CAST(1000 AS DOUBLE) AS x, CASE WHEN p_partkey % 3 > 0 THEN p_size / p_retailprice END AS r FROM part),
n AS (SELECT q.k AS q, o.r, row_number() OVER (PARTITION BY q.k ORDER BY abs(q.x - o.x), o.k) AS i FROM p q JOIN p o ON o.r IS NOT NULL) SELECT q, floor(list_sort(list(r))[3] * 1000 + CAST(0.5 AS DOUBLE)) / 1000 AS ratio FROM n WHERE i <= 5 GROUP BY q""")
def knn_continuous(spark, sf_dir):
    """Every part against those with a known ratio, by a price that hardly two share."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.col("p_retailprice") + F.col("p_size") / 1000.0).alias("x"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_size") / F.col("p_retailprice")).alias("r"))
    return grouping.nearest_ratio(parts, parts.select(F.col("k").alias("q"), "x"), 5)


@query(r"""WITH t AS (SELECT l_orderkey, l_linenumber, l_discount, CASE l_linenumber % 3 WHEN 0 THEN 'Rs. ' WHEN 1 THEN 'Rs ' ELSE '₹' END || CAST(CAST(floor(l_extendedprice) AS BIGINT) // 1000 AS VARCHAR) || ',' || lpad(CAST(CAST(floor(l_extendedprice) AS BIGINT) % 1000 AS VARCHAR), 3, '0') || ' only' AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN s LIKE 'Rs.%' THEN CAST('0.' || regexp_replace(s, '[^0-9]', '', 'g') AS DOUBLE) ELSE CAST(regexp_replace(s, '[^0-9]', '', 'g') AS DOUBLE) END AS amount, CASE WHEN l_discount > 0 THEN floor(l_discount * 100 + CAST(0.5 AS DOUBLE)) END AS pct FROM t""")
def money_parse(spark, sf_dir):
    """Digits and dots of the text as it is: the dot of an abbreviation comes first, and counts."""
    n = F.floor("l_extendedprice")
    sign = F.when(F.col("l_linenumber") % 3 == 0, "Rs. ").when(F.col("l_linenumber") % 3 == 1, "Rs ").otherwise("₹")
    whole = F.concat(sign, F.floor(n / 1000).cast("string"), F.lit(","), F.lpad((n % 1000).cast("string"), 3, "0"), F.lit(" only"))
    off = F.concat(F.floor(F.col("l_discount") * 100 + 0.5).cast("string"), F.lit("% OFF"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", parse.money(whole).alias("amount"), parse.percent(off).alias("pct"))


@query(r"""WITH n AS (SELECT o_orderkey, CAST(CAST(floor(o_totalprice + CAST(0.5 AS DOUBLE)) AS BIGINT) AS VARCHAR) AS s FROM orders), g AS (SELECT o_orderkey, s, reverse(left(s, greatest(length(s) - 3, 0))) AS head FROM n)
SELECT o_orderkey, '₹' || CASE WHEN length(s) > 3 THEN reverse(rtrim(regexp_replace(head, '(..)', '\1,', 'g'), ',')) || ',' || right(s, 3) ELSE s END AS shown FROM g""")
def inr_format(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", parse.rupees(F.col("o_totalprice")).alias("shown"))


@query("""WITH c AS (SELECT page_id, url, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(url, ''), lambda x: CAST(CASE WHEN x = '' THEN 0 ELSE unicode(x) END AS BIGINT))), lambda a, b: (a * 31 + b) % 4294967296) AS h FROM pages) SELECT page_id, h FROM c""")
def id_hash(spark, sf_dir):
    ids = parse.stable_id(F.lit("x"), F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", F.conv(F.upper(F.split(ids, ":")[1]), 36, 10).cast("long").alias("h"))

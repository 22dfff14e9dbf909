"""Registered queries over the whole way from cards to notes, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.cut import place
from ..operators import notes
from ..sources import runs
from . import rank_cards
from .catalog import _fold_sql, query
from .reports import _inr
from .view import table

# Cards of fifty parts are one model and one file: partly unknown configurations, no price, stock known and not, list prices of all kinds.
CARD = """CAST(floor(p_partkey / 50) AS BIGINT) AS m, p_partkey AS n, (p_partkey % 3 + 1) * 64 AS storage, CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 2 * 2 + 4 END AS ram, CASE WHEN p_partkey % 11 > 0 THEN 8000 + p_size * 100 + p_partkey % 700 END AS price,
 CASE WHEN p_partkey % 4 > 0 THEN 20000 + p_partkey % 3 * 30000 END AS mrp, CASE p_partkey % 6 WHEN 0 THEN false WHEN 1 THEN true END AS in_stock, p_partkey % 10 = 3 AS checked"""
#: What a page says: twice the card's price, or nearly the card's; some pages say nothing of stock.
CHECKOUT = """CASE WHEN n % 20 = 3 THEN coalesce(price, 9000) * 2 ELSE coalesce(price, 9000) + 10 END AS page_price, CASE WHEN n % 7 > 0 THEN 70000 END AS page_mrp, CASE WHEN n % 4 = 3 THEN false WHEN n % 4 = 1 THEN true END AS page_stock"""


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "part").selectExpr(f"inline(array(struct({CARD})))")
    title = F.concat(F.lit("Samsung Galaxy M"), "m", F.lit(" 5G (Ocean Blue, "), "storage", F.lit(" GB)"), F.coalesce(F.concat(F.lit(" "), "ram", F.lit(" GB RAM")), F.lit("")), F.lit(" smartphone"))
    host = F.when(F.col("m") % 2 == 0, "https://www.flipkart.com/g-").otherwise("https://www.amazon.in/g-")
    card = F.struct(title.alias("product_name"), F.concat(host, "n", F.lit("/p/itm?pid=G"), "n").alias("product_url"), F.col("price").alias("selling_price"), F.col("mrp").alias("original_price"), "in_stock", F.concat(F.lit("img"), "n").alias("image_url"))
    path = place(spark, "cards")
    c.groupBy("m").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", card.alias("card")))), lambda x: x["card"]).alias("products")).select("products").write.option("maxRecordsPerFile", 1).json(path)
    return runs.cards(spark, path)


_FOLDED = _fold_sql(f"""card AS (SELECT *, CASE WHEN checked THEN page_price END AS pp, CASE WHEN checked THEN page_mrp END AS pm, CASE WHEN checked THEN page_stock END AS ps FROM (SELECT *, {CHECKOUT} FROM (SELECT {CARD} FROM part))),
seen AS (SELECT *, price IS NOT NULL AND pp IS NOT NULL AND abs(pp - price) / CAST(price AS DOUBLE) > CAST(0.02 AS DOUBLE) AS moved, CASE WHEN price IS NULL OR (mrp > price AND mrp <= 5 * price) THEN mrp END AS list FROM card),
listing AS (SELECT 'samsung galaxy m' || m || ' 5g' AS model, coalesce(CAST(ram AS VARCHAR), '?') || 'r-' || storage || 's' AS config, n AS ord, n, m, CASE WHEN moved THEN pp ELSE price END AS price, CASE WHEN moved THEN coalesce(pm, list) ELSE list END AS list, in_stock, checked, pp, pm, ps FROM seen)""")

_CANDIDATES = _FOLDED.replace("\nSELECT c.model, c.config, coalesce(f.target, c.config) AS target FROM", ",\ntarget AS (SELECT c.model, c.config, coalesce(f.target, c.config) AS target FROM") + """),
own AS (SELECT l.* EXCLUDE (config), t.target AS config, CASE WHEN in_stock THEN 0 WHEN in_stock IS NULL THEN 1 ELSE 2 END AS stock FROM listing l JOIN target t ON l.model = t.model AND l.config = t.config),
offer AS (SELECT model, config, price, arg_min(struct_pack(stock := stock, n := n, list := list), (stock, n)) AS o FROM own WHERE price IS NOT NULL GROUP BY ALL),
best AS (SELECT model, config, count(*) AS offers, arg_min(struct_pack(price := price, stock := o.stock, n := o.n, list := o.list), (o.stock, price, o.n)) AS b FROM offer GROUP BY ALL),
page AS (SELECT model, config, arg_min(struct_pack(n := n, pp := pp, pm := pm, ps := ps, list := list), n) AS p FROM own WHERE checked GROUP BY ALL),
led AS (SELECT best.*, p, coalesce(p.n <> b.n AND abs(p.pp - b.price) / CAST(b.price AS DOUBLE) > CAST(0.02 AS DOUBLE), false) AS leads FROM best LEFT JOIN page USING (model, config)),
away AS (SELECT led.model, led.config, count(*) FILTER (WHERE offer.o.n <> led.p.n) AS others FROM led JOIN offer USING (model, config) GROUP BY ALL),
cand AS (SELECT model, config, CASE WHEN leads THEN p.pp ELSE b.price END AS price, CASE WHEN leads THEN coalesce(p.pm, p.list) ELSE b.list END AS list, CASE WHEN leads OR p.ps IS NOT NULL THEN p.ps WHEN b.stock = 0 THEN true WHEN b.stock = 2 THEN false END AS in_stock, CASE WHEN leads THEN others + 1 ELSE offers END AS n_offers FROM led JOIN away USING (model, config)),
past AS (SELECT 'samsung galaxy m' || m || ' 5g' AS model, (n % 2 * 2 + 4) || 'r-' || ((n % 3 + 1) * 64) || 's' AS config, CASE WHEN n % 4 = 0 THEN 100 ELSE 12000 END AS paid, n FROM card WHERE m % 2 = 0),
low AS (SELECT model, config, min(paid) AS low, count(DISTINCT n) AS runs FROM past GROUP BY ALL),
q AS (SELECT * FROM (VALUES ('a', 18000), ('b', 1000000)) t(query_id, most))"""


@query(_CANDIDATES + """
SELECT query_id, model || '|' || config AS key, 'Samsung Galaxy M' || split_part(split_part(model, ' m', 2), ' ', 1) || ' 5G smartphone' AS first_words, CAST(price AS DOUBLE) AS price, CAST(list AS DOUBLE) AS mrp, in_stock, CAST(n_offers AS INTEGER) AS n_offers, coalesce(runs >= 2 AND price <= low, false) AS lowest
FROM cand LEFT JOIN low USING (model, config) JOIN q ON price <= most""")
def ranked_cards(spark, sf_dir):
    """Cards of files with their pages and recorded prices to ranks and notes, for two wishes; what can be told without the scores."""
    raw = _cards(spark, sf_dir)
    n = F.regexp_extract("url", r"/g-(\d+)/", 1).cast("long")
    facts = table(spark, sf_dir, "part").selectExpr(f"inline(array(struct({CARD})))").where("checked").selectExpr("n", f"inline(array(struct({CHECKOUT})))").withColumnRenamed("page_stock", "in_stock")
    checkouts = runs.listings(raw).select("id", n.alias("n")).join(facts, "n").drop("n")
    m = F.floor(F.col("p_partkey") / 50)
    p = F.col("p_partkey")
    key = F.concat(F.lit("samsung galaxy m"), m, F.lit(" 5g|"), p % 2 * 2 + 4, F.lit("r-"), (p % 3 + 1) * 64, F.lit("s"))
    observed = table(spark, sf_dir, "part").where(m % 2 == 0).select(key.alias("key"), F.lit("x").alias("platform"), (F.timestamp_seconds(F.lit(1_700_000_000) + p * 86400)).alias("ts"), F.when(p % 4 == 0, 100.0).otherwise(12000.0).alias("price"), p.alias("ord"))
    wishes = spark.createDataFrame([("a", "phone", 18000, None, [], [], [], [], None), ("b", "unknown", None, None, [], [], [], ["value"], None)], "query_id string, category_wanted string, budget_max long, budget_min long, brands array<string>, exclude_brands array<string>, must_have array<string>, priorities array<string>, model_hint string")
    out, _ = rank_cards.ranked_cards(raw, wishes, checkouts=checkouts, observations=observed)
    lowest = F.coalesce(F.get("pros", F.lit(0)).startswith("lowest price"), F.lit(False))
    return out.select("query_id", "key", F.regexp_replace("name", r" \d GB RAM| \(.*$", "").alias("first_words"), F.col("price").cast("double").alias("price"), F.col("mrp").cast("double").alias("mrp"), "in_stock", "n_offers", lowest.alias("lowest"))


# A ranked product: every column that a note may speak of, unknown for some.
NOTED = """p_size % 5 AS query_id, 3000 + p_partkey * 7919 % 40000 AS price, CASE WHEN p_partkey % 3 > 0 THEN 'Chip ' || p_partkey % 9 END AS soc_name, CASE WHEN p_partkey % 3 > 0 THEN 100000 + p_partkey * 997 % 1500000 END AS antutu, CASE p_partkey % 4 WHEN 0 THEN 'AMOLED' WHEN 1 THEN 'IPS LCD' WHEN 2 THEN 'pOLED' END AS panel,
 CASE p_partkey % 7 WHEN 0 THEN 60 WHEN 1 THEN 90 WHEN 2 THEN 120 WHEN 3 THEN 144 END AS refresh_hz, CASE p_partkey % 5 WHEN 0 THEN 'HD+' WHEN 1 THEN 'FHD+' END AS resolution, CASE WHEN p_partkey % 6 > 0 THEN 3000 + p_partkey * 31 % 4000 END AS battery_mah, CASE WHEN p_partkey % 8 > 0 THEN p_partkey * 13 % 90 + 5 END AS charging_w,
 CASE WHEN p_partkey % 9 > 0 THEN p_partkey % 4 * 2 + 4 END AS ram_gb, CASE WHEN p_partkey % 10 > 0 THEN p_partkey % 3 * 128 + 64 END AS storage_gb, CASE p_partkey % 11 WHEN 0 THEN false WHEN 1 THEN true END AS has5g, p_partkey % 13 = 0 AS ois, CASE WHEN p_partkey % 12 = 0 THEN 'IP54' END AS ip_rating, p_partkey % 3 + 1 AS n_offers,
 CASE WHEN p_partkey % 7 > 0 THEN (p_partkey % 20 + 30) / CAST(10 AS DOUBLE) END AS rating, CASE WHEN p_partkey % 7 > 0 THEN p_partkey * 37 % 3000 END AS rating_count, CASE p_partkey % 5 WHEN 0 THEN false WHEN 1 THEN true END AS in_stock, p_partkey % 70 AS discount_pct, p_partkey % 11 / CAST(10 AS DOUBLE) AS confidence, CASE p_partkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'none' END AS kb_confidence,
 CASE p_partkey % 8 WHEN 0 THEN 'm #refurbished+open-box' WHEN 1 THEN 'm #carrier-locked' ELSE 'm' END AS model, 'Amazon' AS platform_name, p_partkey % 4 AS recorded_runs, CASE WHEN p_partkey % 9 = 0 THEN 90000 ELSE 2000 END AS recorded_low, 45000 AS recorded_high, p_partkey % 3 AS recorded_days, p_partkey % 11 / CAST(10 AS DOUBLE) AS recorded_position,
 CASE p_partkey % 5 WHEN 0 THEN 'falling' WHEN 1 THEN 'rising' ELSE 'stable' END AS recorded_trend, CASE WHEN p_partkey % 3 > 0 THEN p_partkey * 17 % 101 + p_size / CAST(1000 AS DOUBLE) END AS performance, p_partkey * 19 % 101 AS battery, CASE WHEN p_partkey % 4 < 3 THEN p_partkey * 23 % 101 END AS display, p_partkey * 29 % 101 AS camera, p_partkey * 41 % 101 AS value, p_size % 5 < 2 AS bargain, p_size % 5 = 2 AS games"""

_PROS = [
    ("runs2 AND price <= recorded_low", "CASE WHEN recorded_days >= 1 THEN 'lowest price in ' || recorded_days || ' day(s) of tracking' ELSE 'lowest price we have recorded so far' END"), ("soc_name IS NOT NULL AND antutu > med_antutu * CAST(1.15 AS DOUBLE)", "soc_name || ' — faster than most here (' || tier || ')'"), ("panel LIKE '%OLED'", "panel || ' panel'"), ("refresh_hz >= 120", "refresh_hz || 'Hz display'"),
    ("battery_mah >= med_battery * CAST(1.1 AS DOUBLE)", "battery_mah || 'mAh battery'"), ("charging_w >= 33", "charging_w || 'W charging'"), ("ram_gb > med_ram", "ram_gb || 'GB RAM'"), ("ois", "'OIS on main camera'"), ("ip_rating IS NOT NULL", "ip_rating || ' rated'"), ("price < med_price * CAST(0.85 AS DOUBLE)", f"{_inr('med_price - price')} || ' below segment median'"), ("n_offers > 1", "n_offers || ' offers — cheapest on Amazon'"),
    ("rating >= CAST(4.2 AS DOUBLE) AND rating_count > 1000", "regexp_replace(CAST(rating AS VARCHAR), '\\.0$', '') || '★ from ' || printf('%.1f', floor(rating_count / CAST(1000 AS DOUBLE) * 10 + CAST(0.5 AS DOUBLE)) / 10) || 'k buyers'"),
]
_CONS = [
    ("model <> 'm'", "CASE WHEN model LIKE '%locked' THEN 'carrier-locked SKU — cheaper but tied to one network' ELSE 'refurbished + open-box unit, not a standard new device' END"), ("in_stock = false", "'out of stock in this colour/variant right now'"), ("soc_name IS NULL AND coalesce(rating_count, 0) < 20", "'no chipset found and almost no buyers — nothing to verify'"), ("soc_name IS NULL", "'chipset unknown — performance not verified'"),
    ("antutu < med_antutu * CAST(0.8 AS DOUBLE)", "soc_name || ' is slower than the segment median'"), ("panel NOT LIKE '%OLED'", "panel || ' panel (no OLED)'"), ("refresh_hz <= 60", "'60Hz display'"), ("resolution = 'HD+'", "'HD+ resolution only'"), ("charging_w <= 15", "'slow ' || charging_w || 'W charging'"), ("storage_gb < med_storage", "'only ' || storage_gb || 'GB storage'"), ("has5g = false", "'4G only'"),
    ("rating < CAST(3.9 AS DOUBLE)", "'weak ' || regexp_replace(CAST(rating AS VARCHAR), '\\.0$', '') || '★ rating'"), ("coalesce(rating_count, 0) < 100", "'very few reviews — unproven'"), ("runs2 AND NOT (price <= recorded_low) AND recorded_position >= CAST(0.85 AS DOUBLE)", "'near its recorded high of ₹45,000'"), ("runs2 AND recorded_trend = 'falling'", "'price is still trending down — worth waiting'"), ("discount_pct > 55", "discount_pct || '% \"discount\" — inflated MRP likely'"),
    ("confidence < CAST(0.5 AS DOUBLE)", "'limited spec data — verify before buying'"), ("kb_confidence = 'low'", "'spec sheet partly unverified'"),
]


def _told(rules: list[tuple[str, str]], most: int) -> str:
    said = ", ".join(f"CASE WHEN {test} THEN {text} END" for test, text in rules)
    return f"array_to_string(list_slice(list_filter([{said}], lambda x: x IS NOT NULL), 1, {most}), ' / ')"


def _all(rules: list[tuple[str, str]]) -> str:
    said = ", ".join(f"CASE WHEN {test} THEN {text} END" for test, text in rules)
    return f"array_to_string(list_filter([{said}], lambda x: x IS NOT NULL), ' and ')"


_GOOD = _all([("performance >= 65", "'performance'"), ("battery >= 75", "'battery'"), ("display >= 75", "'display'"), ("camera >= 75", "'camera'")])
_WEAK = _all([("performance < 40 AND rank <> fastest", "'raw speed'"), ("display < 45", "'screen quality'"), ("battery < 45", "'battery'")])


@query(f"""WITH r AS (SELECT p_partkey, {NOTED} FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p_partkey) AS rank, recorded_runs >= 2 AS runs2, CASE WHEN antutu >= 1300000 THEN 'flagship' WHEN antutu >= 700000 THEN 'upper midrange' WHEN antutu >= 400000 THEN 'midrange' WHEN antutu >= 250000 THEN 'budget' ELSE 'entry' END AS tier FROM r),
o AS (SELECT query_id, median(price) AS med_price, median(battery_mah) AS med_battery, median(antutu) AS med_antutu, median(ram_gb) AS med_ram, median(storage_gb) AS med_storage, CASE WHEN count(*) FILTER (WHERE confidence >= CAST(0.5 AS DOUBLE)) >= 2 THEN arg_min(rank, (-performance, rank)) FILTER (WHERE performance IS NOT NULL AND confidence >= CAST(0.5 AS DOUBLE)) ELSE arg_min(rank, (-performance, rank)) FILTER (WHERE performance IS NOT NULL) END AS fastest FROM k GROUP BY query_id),
b AS (SELECT k.*, o.* EXCLUDE (query_id), {_inr('price')} AS shown FROM k JOIN o USING (query_id)), v AS (SELECT *, {_GOOD} AS good, {_WEAK} AS weak FROM b)
SELECT p_partkey, {_told(_PROS, 5)} AS pros, {_told(_CONS, 4)} AS cons, concat_ws('; ', CASE WHEN rank = 1 THEN 'Best overall pick at ' || shown WHEN bargain AND value >= 80 THEN 'Strong value at ' || shown WHEN bargain AND price < med_price * CAST(0.85 AS DOUBLE) THEN 'Cheapest way into this segment at ' || shown ELSE 'Solid option at ' || shown END,
 CASE WHEN good <> '' THEN 'leads on ' || good END, CASE WHEN weak <> '' THEN 'compromises on ' || weak END, CASE WHEN games AND performance < 50 THEN 'not ideal for gaming' END, CASE WHEN confidence < CAST(0.5 AS DOUBLE) THEN 'specs partly inferred' END) || '.' AS verdict FROM v""")
def product_notes(spark, sf_dir):
    """Pros, cons and verdicts of five results, in the order in which rules speak, with history, conditions of sale and stock in front."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(f"inline(array(struct({NOTED})))"))
    # Ranks of the sample: each part is a row of one of five results.
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("p_partkey")))
    rows = rows.withColumn("priorities", F.when(F.col("bargain"), F.array(F.lit("value"))).when(F.col("games"), F.array(F.lit("performance"))))
    out = notes.annotated(rows)
    return out.select("p_partkey", F.array_join("pros", " / ").alias("pros"), F.array_join("cons", " / ").alias("cons"), "verdict")

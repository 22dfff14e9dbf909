"""The whole ranking as a registered query: gates, components, trust, deals, confidence, ranks, variants and badges.

Candidates are made from ``part`` by expressions that both engines evaluate; the oracle follows the survey's formulas.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import maths as m
from . import rank_cards
from .catalog import query
from .products import _COMPONENTS, _NAMES, _sheet, _total_sql
from .view import table

#: What ``rank_cards`` calls the columns of the specification sheet.
FIELDS = {"antutu": "antutu", "ram": "ram_gb", "storage": "storage_gb", "panel": "panel", "refresh": "refresh_hz", "resolution": "resolution", "mah": "battery_mah", "watts": "charging_w", "mp": "main_camera_mp", "ois": "ois", "tele": "tele_mp", "wide": "ultra_wide_mp", "aperture": "aperture", "has5g": "has5g", "nfc": "nfc", "ip": "ip_rating", "updates": "os_upgrades"}
#: Three wishes: with a budget, priorities and a feature; for value and a model; for a class with a brand left out.
WISHES = [("w1", "phone", 30000, None, [], [], ["5g"], ["performance", "battery"], None), ("w2", "unknown", None, 4000, [], [], [], ["value"], "galaxy-m14"), ("w3", "earbuds", None, None, [], ["realme"], [], [], None)]

CANDIDATE = """CASE WHEN p_partkey % 10 = 9 THEN 'accessory' WHEN p_partkey % 10 = 8 THEN 'earbuds' ELSE 'phone' END AS category, CASE p_size % 3 WHEN 0 THEN 'Samsung' WHEN 1 THEN 'realme' END AS brand, p_size * 500 + p_partkey % 997 * 23 + 3001 AS price,
 CASE p_partkey % 6 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END AS in_stock, p_partkey % 3 + 1 AS n_offers, p_partkey % 5 * 100 AS spread, CASE WHEN p_partkey % 4 > 0 THEN 90000 END AS mrp, p_partkey % 70 AS discount_pct, CASE WHEN p_partkey % 7 > 0 THEN (p_partkey % 20 + 30) / CAST(10 AS DOUBLE) END AS rating,
 CASE WHEN p_partkey % 7 > 0 THEN p_partkey * 37 % 1500 END AS rating_count, CASE p_partkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'none' END AS kb_confidence, p_size % 11 / CAST(10 AS DOUBLE) AS completeness, CASE WHEN p_partkey % 3 > 0 THEN 'chip' END AS soc_name,
 concat('Galaxy M', p_size) AS name, concat('mk', p_partkey - p_partkey % 3) AS model"""
HISTORY = """CASE WHEN p_partkey % 9 = 0 THEN 90000 ELSE 2000 END AS low, p_partkey % 4 AS runs, p_partkey % 11 / CAST(10 AS DOUBLE) AS position, CASE p_partkey % 5 WHEN 0 THEN 'falling' WHEN 1 THEN 'rising' ELSE 'steady' END AS trend"""


def _d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def _within(x: str) -> str:
    return f"least(greatest({x}, {_d(0.0)}), {_d(100.0)})"


_RANKED = f"""WITH {_COMPONENTS}, prod AS (SELECT k.*, c.has5g, c.mah, {CANDIDATE.replace("p_partkey", "k.p_partkey").replace("p_size", "k.p_size")}, part.p_partkey % 2 = 0 AS told, {HISTORY.replace("p_partkey", "k.p_partkey")} FROM k JOIN c ON k.p_partkey = c.p_partkey JOIN part ON part.p_partkey = k.p_partkey),
s0 AS (SELECT 'w1' AS query_id, * FROM prod WHERE category = 'phone' AND price <= 30000 AND has5g IS DISTINCT FROM false UNION ALL SELECT 'w2', * FROM prod WHERE category <> 'accessory' AND price >= 4000 UNION ALL SELECT 'w3', * FROM prod WHERE category = 'earbuds' AND brand IS DISTINCT FROM 'realme'),
p AS (SELECT query_id, coalesce(avg(rating), 4) AS prior, median(price) AS med, {", ".join(f"coalesce(median({c}), 50) * {_d(0.9)} AS {c}_p" for c in _NAMES)} FROM s0 GROUP BY query_id),
s1 AS (SELECT *, {_within(f"CASE WHEN query_id = 'w1' THEN {_total_sql(0)[0]} ELSE {_total_sql(1)[0]} END")} * CASE WHEN coalesce(rating_count, 0) >= 5 THEN {_d(1.0)} WHEN kb_confidence = 'high' THEN {_d(0.95)} WHEN kb_confidence = 'medium' THEN {_d(0.85)} WHEN kb_confidence = 'low' THEN {_d(0.75)} ELSE {_d(0.6)} END AS spec,
 CASE WHEN query_id = 'w1' THEN {_total_sql(0)[1]} ELSE {_total_sql(1)[1]} END AS missing, coalesce(rating_count, 0) / (coalesce(rating_count, 0) + {_d(500.0)}) * rating + 500 / (coalesce(rating_count, 0) + {_d(500.0)}) * prior AS blended, least(greatest({_d(0.35)} + log10(coalesce(rating_count, 0) + 1) / {_d(5.5)}, {_d(0.35)}), {_d(1.0)}) AS evidence,
 coalesce(CASE WHEN told AND runs >= 2 THEN CASE WHEN price <= low THEN 20 WHEN position <= {_d(0.15)} THEN 12 WHEN position >= {_d(0.85)} THEN -12 ELSE 0 END + CASE trend WHEN 'falling' THEN -4 WHEN 'rising' THEN 4 ELSE 0 END END, 0) AS past FROM s0 JOIN p USING (query_id)),
s2 AS (SELECT *, CASE WHEN rating IS NOT NULL THEN {_within(f"45 + ({_within(f'(blended - 3) / {_d(1.7)} * 100')} - 45) * evidence")} END AS trust,
 {_within(f"{_d(50.0)} + CASE WHEN mrp IS NULL THEN 0 WHEN discount_pct > 55 THEN -6 ELSE {_d(0.6)} * CASE WHEN discount_pct <= 40 THEN discount_pct ELSE greatest({_d(0.0)}, 40 - {_d(2.0)} * (discount_pct - 40)) END END + CASE WHEN n_offers > 1 THEN CASE WHEN spread > 0 THEN least({_d(15.0)}, spread / CAST(price AS DOUBLE) * 100) ELSE 0 END + 5 ELSE 0 END + CASE WHEN price < med THEN 5 ELSE 0 END + past")} AS deal,
 CASE WHEN count(*) OVER (PARTITION BY query_id) <= 1 THEN 50 ELSE percent_rank() OVER (PARTITION BY query_id ORDER BY spec / (price / {_d(1000.0)})) * 100 END AS share,
 floor({_within(f"(1 - missing) * 60 + completeness * 20 + CASE WHEN rating IS NULL THEN 0 ELSE 10 END + CASE kb_confidence WHEN 'high' THEN 10 WHEN 'medium' THEN 6 WHEN 'low' THEN 3 ELSE 0 END")} / 100 * 100 + {_d(0.5)}) / 100 AS confidence FROM s1),
s3 AS (SELECT *, {_within(f"share * ({_d(0.45)} + {_d(0.55)} * (1 - missing))")} AS value FROM s2),
s4 AS (SELECT *, floor({_within(f"CASE WHEN query_id = 'w2' THEN {_d(0.35)} * value + {_d(0.3)} * spec + {_d(0.2)} * coalesce(trust, 45) + {_d(0.15)} * deal ELSE {_d(0.6)} * spec + {_d(0.25)} * coalesce(trust, 45) + {_d(0.15)} * deal END * ({_d(0.7)} + {_d(0.3)} * confidence)")} * 10 + {_d(0.5)}) / 10 * CASE WHEN soc_name IS NULL AND coalesce(rating_count, 0) < 20 THEN {_d(0.7)} ELSE {_d(1.0)} END AS total, query_id = 'w2' AND p_size = 14 AS exact FROM s3),
s5 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, coalesce(NOT in_stock, false), total DESC, confidence DESC, price, p_partkey) AS rank FROM s4),
c1 AS (SELECT *, in_stock IS DISTINCT FROM false AND confidence >= {_d(0.6)} AND soc_name IS NOT NULL AND coalesce(rating_count, 0) >= 100 AND coalesce(rating, 0) >= {_d(3.5)} AS sure, count(*) FILTER (WHERE confidence >= {_d(0.5)}) OVER (PARTITION BY query_id) AS n, bool_or(exact) OVER (PARTITION BY query_id) AS asked, arg_min(name, rank) OVER (PARTITION BY query_id, model) AS head, min(rank) OVER (PARTITION BY query_id, model) AS head_rank FROM s5),
c2 AS (SELECT *, n < 2 OR confidence >= {_d(0.5)} AS pool FROM c1), c3 AS (SELECT *, count(*) FILTER (WHERE pool AND sure) OVER (PARTITION BY query_id) AS m FROM c2),
b AS (SELECT query_id, arg_min(rank, (-value, rank)) FILTER (WHERE pool AND (m < 2 OR sure)) AS bv, arg_min(rank, (price, rank)) AS ch, arg_min(rank, (-performance, rank)) FILTER (WHERE pool AND performance IS NOT NULL) AS fa, arg_min(rank, (-battery, rank)) FILTER (WHERE pool AND battery IS NOT NULL) AS la, arg_min(rank, (-trust, rank)) FILTER (WHERE pool AND coalesce(rating_count, 0) > 500 AND trust IS NOT NULL) AS br, max(performance) FILTER (WHERE pool) AS ts, max(battery) FILTER (WHERE pool) AS tl FROM c3 GROUP BY query_id),
d AS (SELECT query_id, count(*) FILTER (WHERE pool AND performance >= ts - {_d(0.5)}) AS ns, count(*) FILTER (WHERE pool AND battery >= tl - {_d(0.5)}) AS nl FROM c3 JOIN b USING (query_id) GROUP BY query_id)
SELECT query_id, p_partkey, CAST(rank AS INTEGER) AS rank, CASE WHEN rank > head_rank THEN head END AS variant_of, floor(total * 1000 + {_d(0.5)}) / 1000 AS total, confidence, CASE WHEN rank = 1 THEN 'TOP PICK,' ELSE '' END || CASE WHEN in_stock = false THEN 'OUT OF STOCK,' ELSE '' END || CASE WHEN asked AND NOT exact THEN 'ALTERNATIVE,' ELSE '' END || CASE WHEN rank = bv AND sure THEN 'BEST VALUE,' ELSE '' END || CASE WHEN rank = ch THEN 'CHEAPEST,' ELSE '' END || CASE WHEN rank = fa AND ns = 1 AND sure THEN 'FASTEST,' ELSE '' END
 || CASE WHEN rank = la AND nl = 1 AND mah > 0 THEN 'BATTERY KING,' ELSE '' END || CASE WHEN rank = br THEN 'BEST RATED,' ELSE '' END || CASE WHEN told AND runs >= 2 AND price <= low THEN 'LOWEST YET,' ELSE '' END AS badges FROM c3 JOIN b USING (query_id) JOIN d USING (query_id)"""


@query(_RANKED)
def rank_products(spark, sf_dir):
    """Every part against three wishes through the whole of ``rank_cards.rank``."""
    part = table(spark, sf_dir, "part")
    sheet = _sheet()
    rows = part.select("p_partkey", F.expr(f"struct({CANDIDATE})").alias("own"), *(sheet[k].alias(v) for k, v in FIELDS.items()))
    cands = rows.select("own.*", *FIELDS.values(), F.struct(F.col("p_partkey").alias("ord")).alias("best"))
    stats = part.where("p_partkey % 2 = 0").select(F.expr("concat('mk', p_partkey - p_partkey % 3, '/', p_partkey)").alias("key"), F.expr(f"struct({HISTORY})").alias("own")).select("key", "own.*")
    cands = rank_cards.with_history(cands.withColumn("tracked", F.concat("model", F.lit("/"), "best.ord")), stats, "tracked")
    wishes = spark.createDataFrame(WISHES, "query_id string, category_wanted string, budget_max long, budget_min long, brands array<string>, exclude_brands array<string>, must_have array<string>, priorities array<string>, model_hint string")
    out = rank_cards.rank(cands, wishes)[0]
    badges = F.array_join(F.transform("badges", lambda b: F.concat(b, F.lit(","))), "")
    return out.select("query_id", F.col("best.ord").alias("p_partkey"), "rank", "variant_of", m.jround(F.col("total"), 3).alias("total"), "confidence", badges.alias("badges"))

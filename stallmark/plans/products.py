"""Registered queries over product titles, specifications and wishes that are made from the shipped tables.

Titles and wishes are one expression that both engines evaluate; what the oracles expect comes from the numbers it is
made of, not from reading it back, wherever that is possible.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import maths as m
from ..functions import parse
from ..functions.cut import dealt
from ..operators import intent, ranking, specs, text
from . import rank_cards
from .catalog import _curve_sql, query
from .view import table

TITLE = """concat(CASE p_partkey % 8 WHEN 0 THEN 'Samsung Galaxy M' WHEN 1 THEN 'POCO X' WHEN 2 THEN 'Noise Buds TWS ' WHEN 3 THEN 'Silicone Case for Sony WH-' WHEN 4 THEN 'Nokia keypad feature phone ' WHEN 5 THEN 'Sony over-ear headphones ' WHEN 6 THEN 'OnePlus in-ear wireless headphones ' ELSE 'Widget ' END, CAST(p_size AS STRING),
 CASE WHEN p_partkey % 3 = 0 THEN concat(' 5G (Ocean Blue, ', CAST(p_size % 4 * 64 + 64 AS STRING), ' GB)') ELSE '' END, CASE WHEN p_partkey % 5 < 2 THEN concat(' ', CAST(p_size % 6 * 2 + 2 AS STRING), ' GB RAM') ELSE '' END, CASE WHEN p_partkey % 7 < 3 THEN concat(' | ', CAST(p_size * 100 + 1000 AS STRING), ' mAh, ', CAST(p_size + 8 AS STRING), 'W fast charging') ELSE '' END,
 CASE WHEN p_partkey % 11 < 4 THEN concat(', 6.', CAST(p_size % 9 + 10 AS STRING), ' inch ', CASE WHEN p_size % 2 = 0 THEN 'FHD+ AMOLED' ELSE 'HD+ IPS' END, ' ', CASE WHEN p_size % 3 = 0 THEN '120' ELSE '75' END, 'Hz display') ELSE '' END, CASE WHEN p_partkey % 13 < 5 THEN concat(', ', CAST(p_size + 1 AS STRING), 'MP + 8MP camera, OIS, NFC, IP54, f/1.', CAST(p_size % 10 AS STRING)) ELSE '' END)"""


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size")).select("p_partkey", "p_size", F.expr(TITLE).alias("title"))


_TITLES = f"WITH t AS (SELECT p_partkey, p_size, {TITLE.replace('AS STRING', 'AS VARCHAR')} AS title FROM part)"


def _class_sql() -> str:
    """Scores of every category by its patterns, in order of precedence."""
    def hit(c, p):
        return f"CASE WHEN regexp_matches({c}, '(?i){p}') THEN 1 ELSE 0 END"

    out = []
    for name, yes, maybe, no in rank_cards.CATEGORIES:
        seen = "head" if name == "accessory" else "title"
        score = " + ".join([f"3 * {hit(seen, p)}" for p in yes] + [hit("title", p) for p in maybe])
        veto = " + ".join(hit("head", p) for p in no) or "0"
        out.append(f"CASE WHEN {veto} > 0 THEN 0 ELSE {score} END")
    names = ", ".join(f"'{c[0]}'" for c in rank_cards.CATEGORIES)
    return f"""{_TITLES}, h AS (SELECT *, substr(CASE WHEN length(split_part(title, '|', 1)) >= 12 THEN split_part(title, '|', 1) ELSE title END, 1, 90) AS head FROM t),
s AS (SELECT p_partkey, [{", ".join(out)}] AS s FROM h), r AS (SELECT p_partkey, s, list_max(s) AS top, list_reverse_sort(s)[2] AS second FROM s)
SELECT p_partkey, CASE WHEN top = 0 THEN 'unknown' ELSE [{names}][list_position(s, top)] END AS category, CASE WHEN top = 0 THEN 0 ELSE floor(least(CAST(1 AS DOUBLE), least(top, 6) / CAST(6 AS DOUBLE) * CAST(0.6 AS DOUBLE) + (top - second) / CAST(top AS DOUBLE) * CAST(0.4 AS DOUBLE)) * 100 + CAST(0.5 AS DOUBLE)) / 100 END AS category_confidence FROM r"""


@query(_class_sql())
def classify_text(spark, sf_dir):
    out = text.classified(titles(spark, sf_dir), F.col("title"), rank_cards.CATEGORIES, text.product_head(F.col("title")), {"accessory"})
    return out.select("p_partkey", "category", "category_confidence")


@query(f"""WITH s AS (SELECT *, p_partkey % 11 < 4 AS lit, p_partkey % 13 < 5 AS cam FROM part) SELECT p_partkey, CASE WHEN p_partkey % 5 < 2 THEN p_size % 6 * 2 + 2 END AS ram_gb, CASE WHEN p_partkey % 3 = 0 THEN p_size % 4 * 64 + 64 END AS storage_gb, CASE WHEN p_partkey % 7 < 3 AND p_size >= 5 THEN p_size * 100 + 1000 END AS battery_mah,
 CASE WHEN p_partkey % 7 < 3 AND p_size >= 2 THEN p_size + 8 END AS charging_w, CASE WHEN lit THEN CAST('6.' || (p_size % 9 + 10) AS DOUBLE) END AS display_inches, CASE WHEN lit AND p_size % 3 = 0 THEN 120 END AS refresh_hz, CASE WHEN lit THEN CASE WHEN p_size % 2 = 0 THEN 'AMOLED' ELSE 'IPS LCD' END END AS panel, CASE WHEN lit THEN CASE WHEN p_size % 2 = 0 THEN 'FHD+' ELSE 'HD+' END END AS resolution,
 CASE WHEN cam AND p_size >= 9 THEN p_size + 1 END AS main_camera_mp, CASE WHEN cam THEN CAST('1.' || (p_size % 10) AS DOUBLE) END AS aperture, CASE WHEN cam THEN true END AS ois, CASE WHEN cam THEN true END AS nfc, CASE WHEN cam THEN 'IP54' END AS ip_rating, CASE WHEN p_partkey % 3 = 0 THEN true END AS has5g, CASE WHEN p_partkey % 3 = 0 THEN 'Ocean Blue' END AS colour FROM s""")
def regex_specs(spark, sf_dir):
    fields = ["ram_gb", "storage_gb", "battery_mah", "charging_w", "display_inches", "refresh_hz", "panel", "resolution", "main_camera_mp", "aperture", "ois", "nfc", "ip_rating", "has5g", "colour"]
    out = specs.merged(specs.with_specs(titles(spark, sf_dir), F.col("title"), "title"), ["title"])
    return out.select("p_partkey", *fields)


# Titles and the model keys that the rules make of them; then texts and the lenses, panels and claims in them.
KEYED = [
    ("realme 12x 5G Twilight Purple", "realme 12x 5g"), ("Samsung Galaxy-M14 5G (Smoky Teal, 128 GB)", "samsung galaxy m14 5g"), ("POCO C61 refurbished phone", "poco c61"), ("Nothing Phone (4a) (Blue, 256 GB)", "nothing 4a"), ("Midnight Black Case", "midnight black case"),
    ("Moto G45 5G 8GB RAM 128 GB | Vegan leather", "moto g45 5g"), ("New latest smartphone vivo T3x", "vivo t3x"), ("Nothing Phone (4a) 2 (4b) Pro Blue", "nothing 2 pro 4a 4b"), ("one two three four five six seven", "one two three four five six"), ("OnePlus Nord CE4 locked with Jio Blue", "oneplus nord ce4"), ("(only brackets)", ""), ("Galaxy S24+ Titanium Grey", "galaxy s24+"), ("Starlight Midnight (2a)", "starlight midnight"),
]
LENSES = [
    ("8MP + 50MP camera", {"main_camera_mp": 50}), ("50MP + 8MP ultrawide + 10MP telephoto, 3x optical", {"main_camera_mp": 50, "ultra_wide_mp": 8, "tele_mp": 10}), ("ultra wide 12MP for groups and landscapes, telephoto 64MP", {"main_camera_mp": 12, "ultra_wide_mp": 12, "tele_mp": 64}), ("108MP + 12MP + 8MP + 2MP, 3x tele", {"main_camera_mp": 108, "ultra_wide_mp": 8, "tele_mp": 12}),
    ("6.5 inch LCD display", {"panel": "TFT LCD"}), ("IPX4 rated IPS screen", {"panel": "IPS LCD"}), ("IP68, PLS panel", {"ip_rating": "IP68", "panel": "PLS LCD"}), ("AnTuTu 1234", {}), ("AnTuTu: 62K", {"antutu": 62000}), ("antutu 1234567", {"antutu": 1234567}), ("AMOLED poster", {}), ("P-OLED touch, f/ 1.8", {"panel": "pOLED", "aperture": 1.8}),
    ("50MP telephoto", {"main_camera_mp": 50}), ("4+64GB (Deep Sea, 1 TB)", {"ram_gb": 4, "storage_gb": 64, "colour": "Deep Sea"}), ("33 W adapter, 45W radio", {"charging_w": 33}), ("2.4 inch IPS 60Hz HD 5G OIS 1000mAh", {}),
]


def _cases(values: list[object], n: str = "p_partkey") -> str:
    return f"CASE {n} % {len(values)} " + " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else repr(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'") for i, v in enumerate(values)) + " END"


@query(f"SELECT p_partkey, {_cases([k for _, k in KEYED])} AS model FROM part")
def title_keys(spark, sf_dir):
    """Colours and stop words before and after two words, tags in brackets, conditions of sale, memory sizes, hyphens."""
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(_cases([t for t, _ in KEYED])).alias("title")).select("p_partkey", specs.model_key(F.col("title")).alias("model"))


_LENS_FIELDS = ["ram_gb", "storage_gb", "battery_mah", "charging_w", "refresh_hz", "panel", "resolution", "main_camera_mp", "ultra_wide_mp", "tele_mp", "aperture", "ois", "has5g", "ip_rating", "antutu", "colour"]


@query("SELECT p_partkey, " + ", ".join(f"{_cases([want.get(f) for _, want in LENSES])} AS {f}" for f in _LENS_FIELDS if any(f in w for _, w in LENSES)) + " FROM part")
def lens_specs(spark, sf_dir):
    """Several cameras with labels before and after, panels near a screen and not, claims with and without a K, a screen too small for a phone."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(_cases([t for t, _ in LENSES])).alias("t"))
    out = specs.with_specs(rows, F.col("t"), "x")
    return out.select("p_partkey", *(F.col(f"x_{f}").alias(f) for f in _LENS_FIELDS if any(f in w for _, w in LENSES)))


@query("""SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'Samsung' WHEN 1 THEN 'POCO' WHEN 2 THEN 'Noise' WHEN 3 THEN 'Sony' WHEN 4 THEN 'Nokia' WHEN 5 THEN 'Sony' WHEN 6 THEN 'OnePlus' END AS brand FROM part""")
def brand_of_title(spark, sf_dir):
    return titles(spark, sf_dir).select("p_partkey", parse.brand(F.col("title")).alias("brand"))


WISH = """CASE p_partkey % 7 WHEN 0 THEN concat('best phones under ', CAST(p_size + 4 AS STRING), 'k') WHEN 1 THEN concat('gaming phone between ', CAST(p_size * 1000 AS STRING), ' and ', CAST(p_size * 1000 + 5000 AS STRING)) WHEN 2 THEN concat('earbuds around ', CAST(p_size * 100 AS STRING)) WHEN 3 THEN concat('laptop above ', CAST(p_size AS STRING), ' lakh')
 WHEN 4 THEN concat('samsung phone not realme ₹', CAST(p_size * 1000 AS STRING)) WHEN 5 THEN 'amoled 5g camera smartphone' ELSE concat('best value under ', CAST(p_size * 1000 AS STRING)) END"""


@query("""SELECT p_partkey AS query_id, CASE p_partkey % 7 WHEN 2 THEN 'earbuds' WHEN 3 THEN 'laptop' WHEN 6 THEN 'unknown' ELSE 'phone' END AS category_wanted,
 CASE p_partkey % 7 WHEN 1 THEN p_size * 1000 WHEN 2 THEN CAST(floor(p_size * 100 * CAST(0.85 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) WHEN 3 THEN p_size * 100000 END AS budget_min, CASE p_partkey % 7 WHEN 0 THEN (p_size + 4) * 1000 WHEN 1 THEN p_size * 1000 + 5000 WHEN 2 THEN CAST(floor(p_size * 100 * CAST(1.15 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) WHEN 4 THEN p_size * 1000 WHEN 6 THEN p_size * 1000 END AS budget_max,
 CASE p_partkey % 7 WHEN 1 THEN 'between' WHEN 2 THEN 'around' WHEN 3 THEN 'over' WHEN 5 THEN 'none' ELSE 'under' END AS budget_operator, CASE p_partkey % 7 WHEN 4 THEN 'Samsung' ELSE '' END AS brands, CASE p_partkey % 7 WHEN 4 THEN 'realme' ELSE '' END AS exclude_brands,
 CASE p_partkey % 7 WHEN 1 THEN 'performance' WHEN 5 THEN 'camera,display' WHEN 6 THEN 'value' ELSE '' END AS priorities, CASE p_partkey % 7 WHEN 5 THEN '5g,amoled' ELSE '' END AS must_have FROM part""")
def intent_parse(spark, sf_dir):
    wishes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.expr(WISH).alias("query"))
    lists = [F.array_join(c, ",").alias(c) for c in ("brands", "exclude_brands", "priorities", "must_have")]
    return intent.intents(wishes).select("query_id", "category_wanted", "budget_min", "budget_max", "budget_operator", *lists)


_PRODUCT = """product AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'phone' WHEN 1 THEN 'earbuds' WHEN 2 THEN 'headphone' WHEN 3 THEN 'accessory' ELSE 'unknown' END AS category, CASE WHEN p_size % 9 > 0 THEN p_size * 1000 END AS price, CASE p_size % 3 WHEN 0 THEN 'Samsung' WHEN 1 THEN 'realme' END AS brand, CASE p_size % 4 WHEN 0 THEN 'AMOLED' WHEN 1 THEN 'IPS LCD' END AS panel, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS has5g FROM part)"""
_WISHES = [("w1", "phone", 30000, 5000, [], [], ["5g"]), ("w2", "unknown", 25000, None, ["Samsung"], [], []), ("w3", "headphone", None, None, [], ["realme"], ["amoled"]), ("w4", "earbuds", 9000, None, [], [], [])]


def _products(spark, sf_dir):
    n, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.when(n % 5 == 0, "phone").when(n % 5 == 1, "earbuds").when(n % 5 == 2, "headphone").when(n % 5 == 3, "accessory").otherwise("unknown").alias("category"), F.when(size % 9 > 0, size * 1000).alias("price"),
        F.when(size % 3 == 0, "Samsung").when(size % 3 == 1, "realme").alias("brand"), F.when(size % 4 == 0, "AMOLED").when(size % 4 == 1, "IPS LCD").alias("panel"), F.when(n % 3 == 0, True).when(n % 3 == 1, False).alias("has5g"), F.lit(None).cast("boolean").alias("nfc"), F.lit(None).cast("boolean").alias("ois"),
    )


def _wishes(spark):
    return spark.createDataFrame(_WISHES, "query_id string, category_wanted string, budget_max long, budget_min long, brands array<string>, exclude_brands array<string>, must_have array<string>")


_REASONS = f"""WITH {_PRODUCT}, r AS (
SELECT 'w1' AS query_id, p_partkey, [CASE WHEN category <> 'phone' THEN 'category' END, CASE WHEN category = 'accessory' THEN 'accessory' END, CASE WHEN price IS NULL THEN 'no price' END, CASE WHEN price > 30000 THEN 'over budget' END, CASE WHEN price < 5000 THEN 'below budget' END, CASE WHEN has5g = false THEN 'no 5g' END] AS r FROM product
UNION ALL SELECT 'w2', p_partkey, [CASE WHEN category = 'accessory' THEN 'category' END, CASE WHEN category = 'accessory' THEN 'accessory' END, CASE WHEN price IS NULL THEN 'no price' END, CASE WHEN price > 25000 THEN 'over budget' END, CASE WHEN brand <> 'Samsung' THEN 'brand not requested' END] FROM product
UNION ALL SELECT 'w3', p_partkey, [CASE WHEN category NOT IN ('headphone', 'earbuds') THEN 'category' END, CASE WHEN category = 'accessory' THEN 'accessory' END, CASE WHEN price IS NULL THEN 'no price' END, CASE WHEN brand = 'realme' THEN 'brand excluded' END, CASE WHEN panel = 'IPS LCD' THEN 'not amoled' END] FROM product
UNION ALL SELECT 'w4', p_partkey, [CASE WHEN category NOT IN ('headphone', 'earbuds') THEN 'category' END, CASE WHEN category = 'accessory' THEN 'accessory' END, CASE WHEN price IS NULL THEN 'no price' END, CASE WHEN price > 9000 THEN 'over budget' END] FROM product),
s AS (SELECT query_id, p_partkey, list_aggregate(list_concat(list_filter(r, lambda x: x IS NOT NULL), ['']), 'string_agg', ',') AS reasons FROM r)"""


@query(_REASONS + " SELECT * FROM s")
def gate_reasons(spark, sf_dir):
    out = ranking.gated(_products(spark, sf_dir), _wishes(spark))
    return out.select("query_id", "p_partkey", F.array_join(F.concat("reasons", F.array(F.lit(""))), ",").alias("reasons"))


@query(_REASONS + " SELECT query_id, p_partkey FROM s WHERE reasons = ''")
def gate_survivors(spark, sf_dir):
    return ranking.survivors(_products(spark, sf_dir), _wishes(spark)).select("query_id", "p_partkey")


@query(_REASONS + ", x AS (SELECT query_id, unnest(string_split(reasons, ',')) AS reason FROM s) SELECT query_id, reason, count(*) AS n FROM x WHERE reason <> '' GROUP BY ALL")
def rejection_reasons(spark, sf_dir):
    out = ranking.gated(_products(spark, sf_dir), _wishes(spark))
    return out.select("query_id", F.explode("reasons").alias("reason")).groupBy("query_id", "reason").agg(F.count("*").alias("n"))


_D = "CAST({} AS DOUBLE)"
_PARTS = f"""c AS (SELECT p_partkey, p_size, CASE WHEN p_size % 4 > 0 THEN p_size * 40000 END AS antutu, CASE WHEN p_size % 3 > 0 THEN p_size % 16 + 1 END AS ram, CASE WHEN p_size % 5 > 0 THEN p_size * 20 END AS storage, CASE p_size % 6 WHEN 0 THEN 'AMOLED' WHEN 1 THEN 'IPS LCD' WHEN 2 THEN 'TFT LCD' WHEN 3 THEN 'OTHER' END AS panel, CASE WHEN p_size % 7 > 2 THEN p_size * 3 + 40 END AS refresh, CASE p_size % 4 WHEN 0 THEN 'QHD+' WHEN 1 THEN 'FHD+' WHEN 2 THEN 'HD+' END AS resolution,
 CASE WHEN p_size % 8 > 0 THEN p_size * 130 + 2000 END AS mah, CASE WHEN p_size % 9 > 3 THEN p_size * 2 + 5 END AS watts, CASE WHEN p_size % 10 > 1 THEN p_size * 3 END AS mp, CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END AS ois, CASE WHEN p_size % 5 = 1 THEN 10 END AS tele, CASE WHEN p_size % 7 = 2 THEN 8 END AS wide, CASE WHEN p_size % 2 = 0 THEN {_D.format('p_size % 5 + 14')} / 10 END AS aperture, CASE p_size % 5 WHEN 0 THEN true WHEN 1 THEN false END AS has5g, CASE p_size % 7 WHEN 0 THEN true WHEN 1 THEN false END AS nfc, CASE WHEN p_size % 6 = 5 THEN 'IP54' END AS ip, CASE WHEN p_size % 4 = 3 THEN p_size % 7 END AS updates FROM part)"""


def _mean_sql(parts: list[tuple[str, float]]) -> str:
    known = " + ".join(f"CASE WHEN {v} IS NULL THEN 0 ELSE {_D.format(w)} END" for v, w in parts)
    total = " + ".join(f"coalesce({v}, 0) * {_D.format(w)}" for v, w in parts)
    return f"CASE WHEN {known} > 0 THEN ({total}) / ({known}) END"


def _null(c: str, x: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN {x} END"


_COMPONENTS = f"""{_PARTS}, k AS (SELECT p_partkey, p_size, {_null('antutu', "least(greatest((ln(antutu) - ln(150000)) / (ln(2200000) - ln(150000)) * 100, 0), 100)")} AS performance, {_mean_sql([(_null('ram', _curve_sql('ram', m.RAM)), 0.5), (_null('storage', _curve_sql('storage', m.STORAGE)), 0.5)])} AS memory,
 {_mean_sql([("CASE panel WHEN 'AMOLED' THEN 100 WHEN 'IPS LCD' THEN 55 WHEN 'TFT LCD' THEN 40 WHEN 'OTHER' THEN 50 END", 0.4), (_null('refresh', _curve_sql('refresh', m.REFRESH)), 0.35), ("CASE resolution WHEN 'QHD+' THEN 100 WHEN 'FHD+' THEN 80 WHEN 'HD+' THEN 45 END", 0.25)])} AS display, {_mean_sql([(_null('mah', _curve_sql('mah', m.BATTERY)), 0.7), (_null('watts', _curve_sql('watts', m.CHARGING)), 0.3)])} AS battery,
 CASE WHEN mp IS NOT NULL OR ois IS NOT NULL THEN least(100, floor(CASE WHEN ois THEN least(100, coalesce({_null('mp', _curve_sql('mp', m.CAMERA))}, 50) + 12) ELSE coalesce({_null('mp', _curve_sql('mp', m.CAMERA))}, 50) END + CASE WHEN tele IS NULL THEN 0 ELSE 10 END + CASE WHEN wide IS NULL THEN 0 ELSE 6 END + CASE WHEN aperture <= {_D.format(1.7)} THEN 6 WHEN aperture <= 2 THEN 3 ELSE 0 END + {_D.format(0.5)})) END AS camera,
 CASE WHEN coalesce(has5g, nfc) IS NOT NULL OR ip IS NOT NULL OR updates IS NOT NULL THEN (CASE WHEN has5g THEN 35 ELSE 0 END + CASE WHEN nfc THEN 15 ELSE 0 END + CASE WHEN ip IS NULL THEN 0 ELSE 20 END + coalesce({_null('updates', _curve_sql('updates', m.UPDATES))}, 0)) / {_D.format('CASE WHEN has5g IS NULL THEN 0 ELSE 35 END + CASE WHEN nfc IS NULL THEN 0 ELSE 15 END + CASE WHEN ip IS NULL THEN 0 ELSE 20 END + CASE WHEN updates IS NULL THEN 0 ELSE 30 END')} * 100 END AS extras FROM c)"""


def _sheet() -> dict:
    """The specifications of ``_PARTS`` as columns of ``part``."""
    n = F.col("p_size")
    when = F.when
    return {
        "antutu": when(n % 4 > 0, n * 40000), "ram": when(n % 3 > 0, n % 16 + 1), "storage": when(n % 5 > 0, n * 20), "panel": when(n % 6 == 0, "AMOLED").when(n % 6 == 1, "IPS LCD").when(n % 6 == 2, "TFT LCD").when(n % 6 == 3, "OTHER"), "refresh": when(n % 7 > 2, n * 3 + 40),
        "resolution": when(n % 4 == 0, "QHD+").when(n % 4 == 1, "FHD+").when(n % 4 == 2, "HD+"), "mah": when(n % 8 > 0, n * 130 + 2000), "watts": when(n % 9 > 3, n * 2 + 5), "mp": when(n % 10 > 1, n * 3), "ois": when(n % 3 == 0, True).when(n % 3 == 1, False), "tele": when(n % 5 == 1, 10), "wide": when(n % 7 == 2, 8),
        "aperture": when(n % 2 == 0, (n % 5 + 14) / 10.0), "has5g": when(n % 5 == 0, True).when(n % 5 == 1, False), "nfc": when(n % 7 == 0, True).when(n % 7 == 1, False), "ip": when(n % 6 == 5, "IP54"), "updates": when(n % 4 == 3, n % 7),
    }


def _components(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", *(v.alias(k) for k, v in _sheet().items()))
    g = F.col
    return rows.select(
        "p_partkey", "p_size", m.performance(g("antutu")).alias("performance"), m.memory(g("ram"), g("storage")).alias("memory"), m.display(g("panel"), g("refresh"), g("resolution")).alias("display"), m.battery(g("mah"), g("watts")).alias("battery"),
        m.camera(g("mp"), g("ois"), g("tele"), g("wide"), g("aperture")).alias("camera"), m.extras(g("has5g"), g("nfc"), g("ip"), g("updates")).alias("extras"),
    )


_NAMES = ["performance", "memory", "display", "battery", "camera", "extras"]


@query(f"WITH {_COMPONENTS} SELECT p_partkey, " + ", ".join(f"floor({c} * 1000 + {_D.format(0.5)}) / 1000 AS {c}" for c in _NAMES) + " FROM k")
def component_scores(spark, sf_dir):
    return _components(spark, sf_dir).select("p_partkey", *(m.jround(F.col(c), 3).alias(c) for c in _NAMES))


# The weights as surveyed, with the lifts of a wish for speed and battery, for none, and for value, which lifts nothing.
_LIFTS = {0: {"performance": 0.45, "memory": 0.15, "display": 0.18, "battery": 0.32, "camera": 0.12, "extras": 0.08}, 1: {"performance": 0.30, "memory": 0.15, "display": 0.18, "battery": 0.17, "camera": 0.12, "extras": 0.08}}


def _total_sql(n: int) -> str:
    w = {k: v / sum(_LIFTS[n].values()) for k, v in _LIFTS[n].items()}
    return " + ".join(f"coalesce({c}, {c}_p) * {_D.format(repr(w[c]))}" for c in _NAMES), " + ".join(f"CASE WHEN {c} IS NULL THEN {_D.format(repr(w[c]))} ELSE 0 END" for c in _NAMES)


@query(f"""WITH {_COMPONENTS}, q AS (SELECT *, p_size % 3 AS query_id FROM k), p AS (SELECT query_id, {", ".join(f"coalesce(median({c}), 50) * {_D.format(0.9)} AS {c}_p" for c in _NAMES)} FROM q GROUP BY query_id)
SELECT p_partkey, floor(least(greatest(CASE WHEN query_id = 0 THEN {_total_sql(0)[0]} ELSE {_total_sql(1)[0]} END, 0), 100) * 1000 + {_D.format(0.5)}) / 1000 AS spec_total, floor((CASE WHEN query_id = 0 THEN {_total_sql(0)[1]} ELSE {_total_sql(1)[1]} END) * 1000 + {_D.format(0.5)}) / 1000 AS imputed_weight FROM q JOIN p USING (query_id)""")
def spec_totals(spark, sf_dir):
    """Components with peers for what is unknown, weighed by what each query asks for."""
    query_id = F.col("p_size") % 3
    wish = F.when(query_id == 0, F.array(F.lit("performance"), F.lit("battery"))).when(query_id == 1, F.array(F.lit("value"), F.lit("memory"))).otherwise(F.array().cast("array<string>"))
    rows = _components(spark, sf_dir).withColumn("query_id", query_id).withColumn("priorities", wish)
    out = ranking.totals(ranking.imputed(rows, _NAMES), F.col("priorities"))
    return out.select("p_partkey", m.jround(F.col("spec_total"), 3).alias("spec_total"), m.jround(F.col("imputed_weight"), 3).alias("imputed_weight"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_partkey % 8 = 0 WHEN 1 THEN p_size % 2 = 0 ELSE false END AS exact FROM part""")
def model_match(spark, sf_dir):
    """Hints: a model's own name; a short one that needs its brand; one without a digit; none."""
    n, size = F.col("p_partkey"), F.col("p_size")
    hint = F.when(n % 4 == 0, F.concat(F.lit("galaxy-m"), size)).when(n % 4 == 1, F.lit("x7")).when(n % 4 == 2, F.lit("galaxy"))
    name = F.when(n % 4 == 0, F.concat(F.when(n % 8 == 0, "Samsung Galaxy M").otherwise("Samsung Note Q"), size, F.lit(" 5G"))).when(n % 4 == 1, F.when(size % 2 == 0, "POCO X7 Pro").otherwise("Realme GX70")).otherwise("Samsung Galaxy")
    brands = F.when(n % 4 == 1, F.array(F.lit("POCO"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "part").select("p_partkey", ranking.model_matches(hint, brands, name).alias("exact"))


@query("""SELECT l_orderkey, l_linenumber, floor(l_quantity / 20 * 10 + CAST(0.5 AS DOUBLE)) / 10 AS hundred, l_linenumber % 5 + CAST(0.5 AS DOUBLE) AS five, CAST(l_linenumber * 1500 AS BIGINT) AS k, CAST(l_linenumber * 100000 AS BIGINT) AS lakh, CAST(l_partkey * 1000 + 234 AS BIGINT) AS plain, CASE l_returnflag WHEN 'A' THEN true WHEN 'N' THEN false END AS flag FROM lineitem""")
def scalar_parse(spark, sf_dir):
    """Ratings out of 100 and out of 5, counts with units and commas, flags."""
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_quantity") > 5, parse.rating(F.col("l_quantity"))).otherwise(m.jround(F.col("l_quantity") / 20, 1)).alias("hundred"), parse.rating(n % 5 + 0.5).alias("five"), parse.count_of(F.concat((n * 1.5).cast("string"), F.lit("K ratings"))).alias("k"),
        parse.count_of(F.concat(n.cast("string"), F.lit(" Lakh"))).alias("lakh"), parse.count_of(F.concat(F.lit("("), F.col("l_partkey").cast("string"), F.lit(",234)"))).alias("plain"), parse.flag(F.when(F.col("l_returnflag") == "A", " Yes").when(F.col("l_returnflag") == "N", "FALSE").otherwise("maybe")).alias("flag"),
    )


@query("""SELECT o_orderkey, CASE WHEN n >= 100000 THEN printf('%.1f', floor(n / CAST(10000 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / 10) || 'L' WHEN n >= 10000 THEN CAST(CAST(floor(n / CAST(1000 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS VARCHAR) || 'k' WHEN n >= 1000 THEN printf('%.1f', floor(n / CAST(100 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / 10) || 'k' ELSE CAST(n AS VARCHAR) END AS shown,
 CASE WHEN n < 3600 THEN (n // 60) || 'm' WHEN n < 172800 THEN (n // 3600) || 'h ' || lpad(CAST(n // 60 % 60 AS VARCHAR), 2, '0') || 'm' ELSE (n // 86400) || 'd ' || (n // 3600 % 24) || 'h' END AS age FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS n FROM orders)""")
def shown_numbers(spark, sf_dir):
    n = F.floor("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", parse.short_count(n).alias("shown"), parse.age_label(n).alias("age"))


@query("""SELECT p_partkey, p_size % 4 = 0 AS sold_out FROM part""")
def stock_gate(spark, sf_dir):
    """A candidate goes only where every offer is known to be sold out."""
    size = F.col("p_size")
    offers = F.array(F.struct(F.lit(False).alias("in_stock")), F.struct(F.when(size % 4 == 0, False).when(size % 4 == 1, True).alias("in_stock")))
    rows = table(spark, sf_dir, "part").select("p_partkey", offers.alias("offers"), F.lit("phone").alias("category"), F.lit(10).alias("price"), F.lit("x").alias("brand"), F.lit(None).cast("string").alias("panel"), *(F.lit(None).cast("boolean").alias(c) for c in ("has5g", "nfc", "ois")))
    wish = spark.createDataFrame([("w", "phone", None, None, [], [], [])], "query_id string, category_wanted string, budget_max long, budget_min long, brands array<string>, exclude_brands array<string>, must_have array<string>")
    return ranking.gated(rows, wish, 0.0, True).select("p_partkey", F.array_contains("reasons", "out of stock everywhere").alias("sold_out"))

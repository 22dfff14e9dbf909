"""Registered queries over chip and model dictionaries, reports and page texts, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import maths as m
from ..functions import parse
from ..operators import history, intent, knowledge, pages, ranking, report, text
from .catalog import _SCORED, _STATS, query, scored
from .products import _REASONS, WISH, _products, _wishes
from .view import LISTING, listings, observations, table

# Six invented chips and five models, each with the names that it goes by.
CHIPS = [(1, "Snapdragon 7", 600000, True, ["snapdragon 7"]), (2, "Snapdragon 7 Plus", 900000, True, ["snapdragon 7 plus", "sd7 plus"]), (3, "Helio G9", 260000, False, ["g9", "helio g9"]), (4, "Tensor Two", 1400000, True, ["tensor two"]), (5, "Exynos 8", 200000, False, ["exynos 8", "e8"])]
MODELS = [(1, "Galaxy M14", ["galaxy m14", "m146"]), (2, "Poco X5", ["poco x5"]), (3, "Poco X5 Pro", ["poco x5 pro", "x5 pro"]), (4, "Nord+", ["nord+"])]


def _chips(spark):
    return spark.createDataFrame(CHIPS, "ord int, soc_name string, antutu int, has5g boolean, aliases array<string>")


SPOKEN = """CASE p_partkey % 8 WHEN 0 THEN concat('Phone ', CAST(p_partkey AS STRING), ' Snapdragon7 inside') WHEN 1 THEN 'Phone with g9 octa-core and 5000 mAh' WHEN 2 THEN 'Phone g9' WHEN 3 THEN 'Chip: tensor_two!' WHEN 4 THEN 'SNAPDRAGON 7 Plus, 8 GB' WHEN 5 THEN 'xsnapdragon 7 and snapdragon 7' WHEN 6 THEN concat('e8 ', repeat('far away ', 9), ' processor') ELSE 'e8 processor' END"""


@query("""WITH c AS (SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN ['Snapdragon 7', '600000', 'true', 'true'] WHEN 1 THEN ['Helio G9', '260000', 'false', 'true'] WHEN 3 THEN ['Tensor Two', '1400000', 'true', 'true'] WHEN 4 THEN ['Snapdragon 7 Plus', '900000', 'true', 'false'] WHEN 7 THEN ['Exynos 8', '200000', 'false', 'true'] END AS c FROM part)
SELECT id, c[1] AS soc_name, CAST(c[2] AS INTEGER) AS antutu, CAST(c[3] AS BOOLEAN) AS has5g, CAST(c[4] AS BOOLEAN) AS ambiguous, CASE c[1] WHEN 'Tensor Two' THEN 'flagship' WHEN 'Snapdragon 7 Plus' THEN 'upper-midrange' WHEN 'Snapdragon 7' THEN 'midrange' WHEN 'Helio G9' THEN 'budget' ELSE 'entry' END AS tier FROM c WHERE c IS NOT NULL""")
def chip_match(spark, sf_dir):
    """Digits glued to the maker, an alias without a maker with and without context, an underscore, the longest alias, a first place inside a word, context too far off."""
    texts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr(SPOKEN).alias("text"))
    return knowledge.match_chips(texts, _chips(spark)).withColumn("tier", knowledge.perf_tier(F.col("antutu")))


@query("""SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'Snapdragon 7' WHEN 1 THEN 'Helio G9' ELSE 'Exynos 8' END AS soc_name, CASE p_partkey % 4 WHEN 0 THEN 600000 WHEN 1 THEN 260000 ELSE 200000 END AS antutu FROM part WHERE p_partkey % 4 <> 3""")
def chip_exact(spark, sf_dir):
    n = F.col("p_partkey")
    name = F.when(n % 4 == 0, " SNAPDRAGON   7 ").when(n % 4 == 1, "g9").when(n % 4 == 2, "E8").otherwise("snapdragon")
    return knowledge.exact_chips(table(spark, sf_dir, "part").select(n.alias("id"), name.alias("name")), _chips(spark))


@query("""SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'Galaxy M14' WHEN 1 THEN 'Poco X5 Pro' WHEN 2 THEN 'Poco X5' WHEN 3 THEN 'Galaxy M14' ELSE 'Nord+' END AS model, CASE p_partkey % 6 WHEN 3 THEN 'url' ELSE 'title' END AS found_in FROM part WHERE p_partkey % 6 <> 5""")
def model_lookup(spark, sf_dir):
    n = F.col("p_partkey")
    title = F.when(n % 6 == 0, F.concat(F.lit("Samsung Galaxy-M14 5G "), F.col("p_size"))).when(n % 6 == 1, "POCO X5 Pro (Blue)").when(n % 6 == 2, "POCO X5 5G Pro").when(n % 6 == 3, "Samsung phone").when(n % 6 == 4, "oneplus nord+ 8 GB").otherwise("Galaxy M145")
    slug = F.when(n % 6 == 3, "samsung m146 blue").otherwise("poco x5")
    models = spark.createDataFrame(MODELS, "ord int, model string, keys array<string>")
    rows = table(spark, sf_dir, "part").select(n.alias("id"), title.alias("title"), F.when(n % 6 == 5, "nothing").otherwise(slug).alias("slug"))
    return knowledge.lookup_models(rows, models)


_INR = "'₹' || CASE WHEN length({0}) > 3 THEN reverse(rtrim(regexp_replace(reverse(left({0}, length({0}) - 3)), '(..)', '\\1,', 'g'), ',')) || ',' || right({0}, 3) ELSE {0} END"


def _inr(x: str) -> str:
    return _INR.format(f"CAST(CAST(floor({x} + CAST(0.5 AS DOUBLE)) AS BIGINT) AS VARCHAR)")


@query(f"""SELECT p_partkey AS query_id, CASE p_partkey % 7 WHEN 0 THEN 'phone · under ' || {_inr('(p_size + 4) * 1000')} WHEN 1 THEN 'phone · ' || {_inr('p_size * 1000')} || '–' || {_inr('p_size * 1000 + 5000')} || ' · priorities: performance' WHEN 2 THEN 'earbuds · around ' || {_inr('(floor(p_size * 100 * CAST(0.85 AS DOUBLE) + CAST(0.5 AS DOUBLE)) + floor(p_size * 100 * CAST(1.15 AS DOUBLE) + CAST(0.5 AS DOUBLE))) / 2')} WHEN 3 THEN 'laptop · over ' || {_inr('p_size * 100000')}
 WHEN 4 THEN 'phone · brand: Samsung · under ' || {_inr('p_size * 1000')} WHEN 5 THEN 'phone · priorities: camera, display · must have: 5g, amoled' ELSE 'any product · under ' || {_inr('p_size * 1000')} || ' · priorities: value' END AS described,
 CASE p_partkey % 7 WHEN 2 THEN 'This tool ranks phones. "earbuds around ' || p_size * 100 || '" looks like a search for earbuds.' WHEN 3 THEN 'This tool ranks phones. "laptop above ' || p_size || ' lakh" looks like a search for laptops.' END AS unsupported FROM part""")
def intent_described(spark, sf_dir):
    wishes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.expr(WISH).alias("query"))
    i = intent.intents(wishes)
    return i.select("query_id", report.described({c: F.col(c) for c in i.columns}).alias("described"), report.unsupported_reason(F.col("category_wanted"), F.col("raw")).alias("unsupported"))


@query("""SELECT p_partkey, trim(p_name) || CASE WHEN p_size % 3 = 0 AND p_size % 4 = 0 THEN '' WHEN p_size % 3 = 0 THEN ' (' || CASE p_size % 4 WHEN 1 THEN '128GB' WHEN 2 THEN '1TB' ELSE '1.5TB' END || ')' WHEN p_size % 4 = 0 THEN ' (' || p_size || 'GB)' ELSE ' (' || p_size || 'GB/' || CASE p_size % 4 WHEN 1 THEN '128GB' WHEN 2 THEN '1TB' ELSE '1.5TB' END || ')' END || CASE p_partkey % 3 WHEN 0 THEN ' [renewed + open-box]' ELSE '' END AS name FROM part""")
def display_names(spark, sf_dir):
    n, size = F.col("p_partkey"), F.col("p_size")
    ram, storage = F.when(size % 3 > 0, size), F.when(size % 4 == 1, 128).when(size % 4 == 2, 1024).when(size % 4 == 3, 1536)
    return table(spark, sf_dir, "part").select("p_partkey", report.display_name(F.concat("p_name", F.lit("  (Blue) ")), ram, storage, F.when(n % 3 == 0, "renewed+open-box")).alias("name"))


_HAVE = {"title": "model", "price": "price", "mrp": None, "rating": "rating", "rating_count": "rating_count", "image_url": None, "url": "platform", "storage_gb": "size"}


@query(f"""WITH {LISTING}, g AS (SELECT *, [CASE WHEN size % 4 = 0 THEN 'category' END, CASE WHEN price IS NULL THEN 'no price' END, CASE WHEN price > 150000 THEN 'over budget' END, CASE WHEN price < 105000 THEN 'below budget' END] AS r FROM listing), h AS (SELECT *, list_filter(r, lambda x: x IS NOT NULL) AS reasons FROM g),
k AS (SELECT platform, reason, count(*) AS n FROM (SELECT platform, unnest(reasons) AS reason FROM h) GROUP BY ALL), t AS (SELECT platform, string_agg(reason || ':' || n, ',' ORDER BY reason) AS reasons FROM k GROUP BY platform)
SELECT platform, count(*) AS raw_cards, count(price) AS priced, floor(avg((4 + CASE WHEN price IS NULL THEN 0 ELSE 1 END + CASE WHEN rating IS NULL THEN -1 ELSE 0 END + CASE WHEN rating_count IS NULL THEN 0 ELSE 1 END) / CAST(8 AS DOUBLE)) * 10000 + CAST(0.5 AS DOUBLE)) / 10000 AS field_fill, count(*) FILTER (WHERE size % 4 <> 0) AS category_matched, count(*) FILTER (WHERE price BETWEEN 105000 AND 150000) AS in_budget, count(*) FILTER (WHERE len(h.reasons) = 0) AS survived, any_value(t.reasons) AS reasons FROM h JOIN t USING (platform) GROUP BY platform""")
def funnel_diagnostics(spark, sf_dir):
    rows = listings(spark, sf_dir)
    price = F.col("price")
    gated = rows.withColumn("reasons", ranking.reasons([(F.col("size") % 4 == 0, "category"), (price.isNull(), "no price"), (price > 150000, "over budget"), (price < 105000, "below budget")]))
    out = report.funnel(rows, gated, {k: F.col(c) if c else F.lit(None) for k, c in _HAVE.items()})
    return out.withColumn("reasons", F.array_join(F.transform(F.map_entries("reasons"), lambda e: F.concat_ws(":", e["key"], e["value"])), ","))


@query(_REASONS + ", x AS (SELECT unnest(string_split(reasons, ',')) AS reason FROM s) SELECT reason, count(*) AS n FROM x WHERE reason <> '' GROUP BY reason ORDER BY n DESC, reason LIMIT 8")
def rejection_tally(spark, sf_dir):
    return report.top_reasons(ranking.gated(_products(spark, sf_dir), _wishes(spark)))


@query(_STATS + """, l AS (SELECT key, observations, position, trend, runs, low, current FROM st) SELECT key, CASE trend WHEN 'falling' THEN '↓ falling' WHEN 'rising' THEN '↑ rising' ELSE '→ stable' END AS trend_cell, CASE WHEN observations < 2 THEN '—' WHEN position <= 0.05 THEN 'at its lowest' WHEN position <= 0.25 THEN 'near its lowest' WHEN position >= 0.95 THEN 'at its peak' WHEN position >= 0.75 THEN 'above average' ELSE 'mid-range' END AS position_cell,
 CASE WHEN runs < 2 THEN NULL WHEN current <= low THEN 'all-time low' WHEN position <= 0.15 THEN 'near the low' WHEN position >= 0.85 THEN 'near its high' WHEN trend IN ('falling', 'rising') THEN trend ELSE 'steady' END AS verdict FROM l""")
def history_labels(spark, sf_dir):
    s = history.stats(observations(spark, sf_dir))
    told = {k: F.col(k) for k in ("low", "position", "trend", "runs")}
    return s.select("key", report.trend_label(F.col("trend")).alias("trend_cell"), report.position_label(F.col("observations"), F.col("position")).alias("position_cell"), report.history_verdict(F.col("current"), told).alias("verdict"))


@query(_SCORED + ", n AS (SELECT *, size < 20 AS exact FROM s6), f AS (SELECT query_id, arg_min(total, rank) FILTER (WHERE exact) AS first, max(total) FILTER (WHERE NOT exact) AS best FROM n GROUP BY query_id) SELECT query_id FROM f WHERE best > first")
def sort_notes(spark, sf_dir):
    return report.named_but_outscored(scored(spark, sf_dir).withColumn("exact", F.col("size") < 20))


@query("""WITH p AS (SELECT page_id AS id, regexp_replace(url, '[?#].*$', '') AS address, 1000 + page_id % 90 AS price, page_id % 5 <> 0 AS stock FROM pages), n AS (SELECT id, address, price, stock, CASE WHEN id % 3 = 0 THEN price * 2 WHEN id % 3 = 1 THEN price + 10 END AS paid, CASE id % 2 WHEN 0 THEN false ELSE true END AS there FROM p)
SELECT a.id, a.price AS "from", b.paid AS "to", coalesce(abs(b.paid - a.price) / a.price > 0.02, false) AS moved, NOT b.there AND a.stock AS sold_out FROM n a JOIN n b ON a.address = b.address""")
def price_refresh(spark, sf_dir):
    """Cards against pages that were read again under the same address with other parameters."""
    n = F.col("page_id")
    price = 1000 + n % 90
    rows = table(spark, sf_dir, "pages").select(n.alias("id"), F.col("url"), price.alias("price"), (n % 5 != 0).alias("in_stock"), F.when(n % 3 == 0, price * 2).when(n % 3 == 1, price + 10).alias("page_price"), (n % 2 != 0).alias("page_stock"))
    again = rows.select(F.concat(F.substring_index(F.substring_index("url", "#", 1), "?", 1), F.lit("?utm=again")).alias("url"), "page_price", "page_stock")
    return report.price_changes(rows.select("id", "url", "price", "in_stock"), again).drop("url")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'title mismatch' WHEN p_partkey % 4 = 1 THEN 'mrp mismatch' WHEN p_size % 2 = 0 THEN 'price only' ELSE 'agrees' END AS outcome, CASE WHEN p_size % 2 = 0 THEN 1100 ELSE 1000 END AS price FROM part""")
def card_checks(spark, sf_dir):
    n, size = F.col("p_partkey"), F.col("p_size")
    page = F.when(n % 4 == 0, "another thing altogether").otherwise(F.concat(F.lit("Buy "), "p_name", F.lit(" online galaxy phone")))
    paid = F.when(size % 2 == 0, 1100).otherwise(1010)
    check = report.card_check(F.concat("p_name", F.lit(" galaxy")), page, F.lit(1000), paid, F.lit(2000), F.when(n % 4 == 1, 2500).otherwise(2000))
    return table(spark, sf_dir, "part").select("p_partkey", check.alias("outcome"), report.page_price(F.lit(1000), paid).alias("price"))


@query("SELECT d.doc_id AS id, CASE WHEN l.doc_id IS NULL THEN CAST(d.n_chars AS BIGINT) ELSE CAST(l.quality AS BIGINT) END AS value FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def override_merge(spark, sf_dir):
    old = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("long").alias("value"))
    new = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("long").alias("value"))
    return report.overridden(old, new.join(old.select("id"), "id", "left_semi"))


@query(r"""WITH c AS (SELECT p_brand AS aspect, CAST(count(*) FILTER (WHERE p_size > 25) AS BIGINT) AS positive, CAST(count(*) FILTER (WHERE p_size <= 25) AS BIGINT) AS negative FROM part GROUP BY p_brand, p_type)
SELECT aspect, positive, negative, positive >= 2 AND positive >= 2 * negative AS praised, negative >= 2 AND negative >= 2 * positive AS complained, floor((positive + negative) / CAST(greatest(1, 2 * positive + 3 * negative) AS DOUBLE) * 1000 + CAST(0.5 AS DOUBLE)) / 1000 AS negative_share FROM c""")
def review_verdicts(spark, sf_dir):
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("aspect"), "p_type").agg(F.count_if(F.col("p_size") > 25).alias("positive"), F.count_if(F.col("p_size") <= 25).alias("negative")).drop("p_type")
    up, down = F.col("positive"), F.col("negative")
    return report.decisive(rows).withColumn("negative_share", m.jround(report.negative_share([up, down, up, down, down]), 3))


@query("""SELECT page_id, 'a "quoted" ' || page_id || ' | line two | xy' || CASE page_id % 2 WHEN 0 THEN '' ELSE ' | only once' END AS state, page_id % 3 = 0 AS again, CASE page_id % 4 WHEN 0 THEN 'LD_PRICE=' || (page_id + 1) ELSE '' END AS product FROM pages""")
def page_state(spark, sf_dir):
    """Values of a page's state with escapes, repeats and a short one, shops that are read again, and a structured product."""
    n = F.col("page_id")
    state = F.concat(F.lit(r'<script>{"text":"a \"quoted\" '), n, F.lit(r'", "text" : ["line\ntwo"], "text":"xy","text":"z","text":"xy"'), F.when(n % 2 == 1, r',"text":"only once"').otherwise(""), F.lit("}</script>"))
    product = F.when(n % 4 == 0, F.concat(F.lit('<script type="application/ld+json">{"offers":{"price":'), n + 1, F.lit("}}</script>"))).otherwise("")
    url = F.when(n % 3 == 0, "https://www.flipkart.com/x/p/y").when(n % 3 == 1, "https://notflipkart.com/x").otherwise("nowhere")
    html = F.concat(F.lit("<p>text</p>"), state, product)
    whole = F.split(pages.page_to_text(html), r"text \| ")[1]
    shown = pages.json_state_text(html)
    return table(spark, sf_dir, "pages").select("page_id", shown.alias("state"), report.refreshable(url).alias("again"), F.substring(whole, F.length(shown) + 4, F.lit(100)).alias("product"))


_LD = """CASE page_id % 8
 WHEN 0 THEN '<script type="application/ld+json">[{"@type":"Crumbs"},{"offers":{"@type":"AggregateOffer","lowPrice":' || page_id || '.5,"price":5}},{"sku":"S' || page_id || '","offers":{"price":"' || (page_id + 10) || '.5","availability":"https://schema.org/InStock","seller":{"name":"Shop A"}}},{"offers":{"price":1}}]</script>'
 WHEN 1 THEN '<script id="x" type=''application/ld+json'' defer>{broken</script><script type="application/ld+json">{"sku":5,"offers":{"price":' || (page_id + 1) || ',"availability":""}}</script>'
 WHEN 2 THEN '<script type="application/ld+json">{"offers":{"lowPrice":"' || page_id || '","highPrice":9}}</script>'
 WHEN 3 THEN '<script type="application/ld+json">{"offers":{"lowPrice":"x"}}</script><SCRIPT TYPE="application/ld+json">{"offers":{"price":0,"lowPrice":null}}</SCRIPT><script type="application/ld+json"> {"offers":{"price":7,"seller":{"name":3},"availability":"OutOfStock"}} </script>'
 WHEN 4 THEN '<script type="application/ld+json">{"offers":[{"price":7}]}</script>' WHEN 5 THEN '<script>{"offers":{"price":7}}</script>'
 WHEN 6 THEN '<script type="application/ld+json">{"offers":{"price":"1,299"}}</script><script type="application/ld+json">[]</script><script type="application/ld+json">{"offers":{"price":12.49}}</script>' ELSE '' END"""


@query("""SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'LD_LOW=' || (page_id + 1) || ' LD_PRICE=' || (page_id + 11) || ' LD_SKU=S' || page_id || ' LD_STOCK=InStock LD_SELLER=Shop A' WHEN 1 THEN 'LD_PRICE=' || (page_id + 1) WHEN 3 THEN 'LD_LOW=NaN LD_LOW=0 LD_PRICE=7 LD_STOCK=OutOfStock' WHEN 6 THEN 'LD_PRICE=12' END AS told FROM pages""")
def structured_products(spark, sf_dir):
    """Arrays of nodes, offers of several sellers before and instead of a single one, broken JSON, prices as texts, numbers and neither."""
    return table(spark, sf_dir, "pages").select("page_id", F.expr(_LD).alias("html")).select("page_id", pages.json_ld(F.col("html")).alias("told"))


@query("""SELECT p_brand AS brand, count(*) AS models FROM part GROUP BY p_brand""")
def models_per_brand(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("models"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'renewed' WHEN 1 THEN 'carrier-locked,open-box' ELSE '' END AS marks, CASE WHEN p_partkey % 2 = 0 THEN 'x/dp/b?pid=' || p_size ELSE 'x/dp/b' END AS page_key, CASE p_partkey % 3 WHEN 0 THEN 'https://www.flipkart.com/a/product-reviews/b?pid=' || p_size END AS reviews FROM part""")
def name_keys(spark, sf_dir):
    """Conditions of sale, page keys and review pages."""
    n, size = F.col("p_partkey"), F.col("p_size")
    title = F.when(n % 5 == 0, "Renewed phone").when(n % 5 == 1, "Phone (locked with Jio) Open Box").otherwise("Phone")
    url = F.concat(F.lit("https://x/dp/b?ref=1"), F.when(n % 2 == 0, F.concat(F.lit("&pid="), size)).otherwise(""))
    shop = F.when(n % 3 == 0, F.concat(F.lit("https://www.flipkart.com/a/p/b?pid="), size)).otherwise("https://example.org/a/p/b")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(parse.qualifiers(title), ",").alias("marks"), parse.page_key(url).alias("page_key"), parse.reviews_url(shop).alias("reviews"))

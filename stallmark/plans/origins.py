"""Registered queries over several sources of a product and over saved payloads, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import external, grouping
from ..sources import captured
from . import rank_cards
from .catalog import query
from .reports import _chips
from .view import table

# Two invented models: one entry that is sure and one that is not.
SHEETS = [(1, "Galaxy M14", ["galaxy m14"], "high", "Helio G9", 5000, True), (2, "Poco X5", ["poco x5"], "low", "Exynos 8", 5100, None)]


@query("""WITH t AS (SELECT p_partkey AS id, p_partkey % 2 = 0 AS sure, p_partkey % 3 = 0 AS page, p_partkey % 5 = 0 AS outside FROM part)
SELECT id, CASE WHEN outside THEN 4800 WHEN sure THEN 5000 WHEN page THEN 4500 ELSE 5100 END AS battery_mah, CASE WHEN outside THEN 'external' WHEN sure THEN 'kb' WHEN page THEN 'page' ELSE 'kb' END AS battery_from,
 CASE WHEN page THEN 6 END AS ram_gb, CASE WHEN outside THEN 'Tensor Two' WHEN sure THEN 'Helio G9' ELSE 'Exynos 8' END AS soc_name, CASE WHEN outside THEN 1400000 WHEN sure THEN 260000 ELSE 200000 END AS antutu,
 CASE WHEN NOT sure THEN false END AS has5g, CASE WHEN sure OR page THEN true END AS nfc, CASE WHEN sure THEN 'high' ELSE 'low' END AS kb_confidence FROM t""")
def spec_precedence(spark, sf_dir):
    """An outside page, entries of two degrees of trust, the product's page and the title, which disagree."""
    n = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(n.alias("id"), F.when(n % 2 == 0, "Samsung Galaxy M14 4000 mAh (Blue, 128 GB)").otherwise("POCO X5 4G 4000 mAh").alias("title"), F.concat(F.lit("https://shop.example/p/"), n).alias("url"), n.alias("ord"), F.lit(None).cast("string").alias("raw"))
    page = rows.where("id % 3 = 0").select("id", F.lit("4500 mAh battery and 6 GB RAM, NFC").alias("text"))
    outside = rows.where("id % 5 = 0").select("id", F.lit(4800).alias("external_battery_mah"), F.lit("Google tensor two").alias("external_soc_name"))
    models = spark.createDataFrame(SHEETS, "ord int, model string, keys array<string>, confidence string, soc_name string, battery_mah int, nfc boolean")
    out = rank_cards.analysed(rows, _chips(spark), page, outside, models)
    return out.select("id", "battery_mah", F.col("spec_sources")["battery_mah"].alias("battery_from"), "ram_gb", "soc_name", "antutu", "has5g", "nfc", "kb_confidence")


@query("""SELECT p_partkey AS model, CASE WHEN p_partkey % 6 = 4 THEN 'b' ELSE 'a' END AS platform, CAST(CASE WHEN p_partkey % 6 = 4 THEN 1300 + p_size ELSE 1000 END AS DOUBLE) AS price, p_partkey % 6 NOT IN (1, 2) AS in_stock, CAST(2 AS INTEGER) AS n_offers,
 CASE WHEN p_partkey % 6 = 4 THEN 50 END AS discount_pct, CAST(CASE WHEN p_partkey % 6 = 4 THEN 0 ELSE 200 END AS DOUBLE) AS spread FROM part""")
def checkout_promotion(spark, sf_dir):
    """No page; pages of the best offer without and with a price; of another shop within 2 %, beyond, and without a price."""
    n = F.col("p_partkey")
    part = table(spark, sf_dir, "part").select(n.alias("model"), "p_size")
    both = part.withColumn("s", F.explode(F.array(F.struct(F.lit(0).alias("i"), F.lit("a").alias("platform"), F.lit(1000.0).alias("price")), F.struct(F.lit(1).alias("i"), F.lit("b").alias("platform"), F.lit(1200.0).alias("price")))))
    rows = both.select("model", "p_size", (F.col("model") * 2 + F.col("s.i")).alias("id"), F.concat("s.platform", F.lit("/"), "model").alias("url"), "s.platform", "s.price", F.lit(True).alias("in_stock"), F.lit(None).cast("double").alias("mrp"), (F.col("model") * 2 + F.col("s.i")).alias("ord"))
    case = F.col("model") % 6
    price = F.when(case == 2, 1500).when(case == 3, 1010).when(case == 4, 1300 + F.col("p_size"))
    pages = rows.where(((case.isin(1, 2)) & (F.col("platform") == "a")) | (case.isin(3, 4, 5) & (F.col("platform") == "b"))).select("id", price.alias("page_price"), F.when(case == 4, price * 2).alias("page_mrp"), (case == 4).alias("in_stock"))
    cands = grouping.best_offers(rows, ["model"])
    out = grouping.promoted(cands, rows, pages, ["model"])
    return out.select("model", "best.platform", F.col("price").cast("double").alias("price"), "in_stock", "n_offers", "discount_pct", F.when(case == 4, 0.0).otherwise(F.col("spread").cast("double")).alias("spread"))


@query("""WITH t AS (SELECT p_partkey AS id, p_partkey % 5 AS c FROM part)
SELECT id, CASE c WHEN 0 THEN 'direct' WHEN 1 THEN 'unlocker' WHEN 4 THEN 'unlocker' END AS via, CASE c WHEN 0 THEN CAST(2100 AS INTEGER) WHEN 1 THEN length('body ' || id) WHEN 4 THEN length('plain ' || id) END AS n,
 CASE c WHEN 2 THEN 'direct: 1000 chars (likely blocked)' WHEN 3 THEN 'direct: failed | unlocker: failed' END AS error FROM t""")
def captured_pages(spark, sf_dir):
    """A long direct read, a refused one with an envelope and without leave to pay, none at all, and a paid read alone."""
    n = F.col("p_partkey")
    c = n % 5
    direct = F.when(c == 0, F.repeat(F.lit("direct "), 300)).when(c.isin(1, 2), F.repeat(F.lit("x"), 1000))
    paid = F.when(c.isin(1, 2), F.to_json(F.struct(F.lit(200).alias("status"), F.concat(F.lit("body "), n).alias("body")))).when(c == 4, F.concat(F.lit("plain "), n))
    reads = table(spark, sf_dir, "part").select(n.alias("id"), direct.alias("direct"), paid.alias("paid"))
    out = captured.fetched(reads, F.when(F.col("id") % 5 == 4, "unlocker").otherwise("auto"), F.col("id") % 5 != 2)
    return out.select("id", "via", F.length("text").alias("n"), "error")


@query("""WITH t AS (SELECT p_partkey AS id, unnest(CASE p_partkey % 3 WHEN 0 THEN [0, 2] WHEN 1 THEN [0, 1] ELSE [0] END) AS pos, p_size FROM part)
SELECT id, CAST(pos AS INTEGER) AS pos, 'item ' || (id + pos) AS title, CAST(p_size AS VARCHAR) AS price, CASE WHEN p_size > 10 THEN p_size || '%' END AS discount FROM t""")
def saved_rows(spark, sf_dir):
    """Lines of JSON with one that is broken, an array, and one object, as cards."""
    def row(i):
        return F.to_json(F.struct(F.concat(F.lit("item "), F.col("p_partkey") + i).alias("title"), F.col("p_size").alias("price"), F.when(F.col("p_size") > 10, F.col("p_size")).otherwise(0).alias("discount")))

    kind = F.col("p_partkey") % 3
    payload = F.when(kind == 0, F.concat_ws("\n", row(0), F.lit('{"title": "broken'), row(2))).when(kind == 1, F.concat(F.lit("["), row(0), F.lit(","), row(1), F.lit("]"))).otherwise(row(0))
    rows = captured.json_lines(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), payload.alias("payload")))
    cards = captured.search_cards(rows)
    return cards.select("id", "pos", *(F.try_variant_get("raw", f"$.{k}", "string").alias(v) for k, v in (("product_name", "title"), ("selling_price", "price"), ("discount_percentage", "discount"))))


@query("""SELECT p_partkey AS query_id, CASE p_partkey % 3 WHEN 0 THEN 'phones under ' || p_size * 1000 WHEN 1 THEN 'smart tv' ELSE 'best of the' END AS term, CASE p_partkey % 4 WHEN 0 THEN 'flipkart,amazon' WHEN 1 THEN 'tatacliq' ELSE 'flipkart,amazon,reliance,tatacliq' END AS platforms FROM part""")
def search_terms(spark, sf_dir):
    """Noise words, a query of noise alone with a class and without one; named, unknown and no platforms."""
    n = F.col("p_partkey")
    text = F.when(n % 3 == 0, F.concat(F.lit("show me the best phones under "), F.col("p_size") * 1000)).otherwise("best of the")
    wish = table(spark, sf_dir, "part").select(n.alias("query_id"), text.alias("raw"), F.when(n % 3 == 1, "tv").otherwise("").alias("category_wanted"), F.array().cast("array<string>").alias("brands"))
    asked = F.when(F.col("query_id") % 4 == 0, "Amazon, flipkart ,ebay").when(F.col("query_id") % 4 == 1, "TATACLIQ").when(F.col("query_id") % 4 == 2, "ebay")
    return wish.select("query_id", captured.search_term(wish).alias("term"), F.array_join(captured.picked(asked), ",").alias("platforms"))


@query("""SELECT count(*) FILTER (WHERE doc_id % 8 = 0) AS matched, count(*) FILTER (WHERE doc_id % 8 = 1) AS unmatched, count(*) FILTER (WHERE doc_id % 8 = 2) AS cached, count(*) FILTER (WHERE doc_id % 8 = 3) AS direct, count(*) FILTER (WHERE doc_id % 8 = 4) AS paid, count(*) FILTER (WHERE doc_id % 8 = 5) AS failed, count(*) FILTER (WHERE doc_id % 8 = 6) AS skipped FROM documents""")
def resolution_tally(spark, sf_dir):
    kinds = F.array(*map(F.lit, ["matched", "unmatched", "cached", "direct", "paid", "failed", "skipped", "other"]))
    return captured.resolution_counts(table(spark, sf_dir, "documents").select(F.get(kinds, (F.col("doc_id") % 8).cast("int")).alias("outcome")))


@query("""WITH t AS (SELECT p_partkey AS n, p_partkey % 6 <> 5 AS told, p_size FROM part)
SELECT n AS id, CASE WHEN told THEN 'Chip ' || n % 7 || ' Plus' END AS soc_name, CASE WHEN told THEN CAST(600000 + n % 1000 AS INTEGER) END AS antutu, CASE WHEN told THEN CAST(5000 AS INTEGER) END AS battery_mah, CASE WHEN told THEN CAST(CASE WHEN n % 2 = 0 THEN 67 ELSE 33 END AS INTEGER) END AS charging_w,
 CASE WHEN told THEN CASE n % 5 WHEN 0 THEN 'AMOLED' WHEN 1 THEN 'AMOLED' WHEN 2 THEN 'IPS LCD' WHEN 3 THEN 'LCD' END END AS panel, CASE WHEN told THEN 6.5::DOUBLE END AS display_inches, CASE WHEN told THEN CASE n % 4 WHEN 0 THEN 'QHD+' WHEN 1 THEN 'FHD+' WHEN 2 THEN 'HD+' END END AS resolution,
 CASE WHEN told THEN CAST(p_size AS INTEGER) END AS main_camera_mp, CASE WHEN told AND n % 2 = 0 THEN true END AS ois, CASE WHEN told THEN CASE n % 3 WHEN 0 THEN true WHEN 1 THEN false END END AS nfc, CASE WHEN told THEN 'IP68' END AS ip_rating FROM t""")
def page_values(spark, sf_dir):
    """Pages of named values in either encoding, escaped or not, some without a chip."""
    n = F.col("p_partkey")

    def item(name, value, when=None):
        plain = F.concat(F.lit('{"name":"' + name + '","value":"'), value, F.lit('"}'))
        boxed = F.concat(F.lit('{"name":[0,"' + name + '"],"value":[0,"'), value, F.lit('"]}'))
        text = F.when(n % 2 == 0, plain).otherwise(boxed)
        return text if when is None else F.when(when, text)

    shown = F.element_at(F.array(*map(F.lit, ["Super AMOLED", "OLED", "IPS panel", "LCD", "unknown"])), (n % 5 + 1).cast("int"))
    lines = F.element_at(F.array(*map(F.lit, ["QHD+ 1440", "FHD+ 1080", "HD+ 720", "none"])), (n % 4 + 1).cast("int"))
    html = F.concat_ws(
        ",", item("Chipset", F.concat(F.lit("Chip "), n % 7, F.lit(" Plus (4 nm), "), 600000 + n % 1000, F.lit(" AnTuTu score")), n % 6 != 5), item("Battery", F.when(n % 2 == 0, "5,000 mAh, 67W").otherwise("5,000 mAh")), item("Charging", F.lit("33 watt")),
        item("Display", F.lit("6.5 inch")), item("Display Type", shown), item("Resolution", lines), item("Rear Camera", F.concat("p_size", F.lit(" MP"), F.when(n % 2 == 0, " with OIS").otherwise(""))), item("NFC", F.when(n % 3 == 0, "Yes").otherwise("No"), n % 3 != 2), item("IP Rating", F.lit("ip68 dust")),
    )
    rows = table(spark, sf_dir, "part").select(n.alias("id"), F.when(n % 4 == 0, F.replace(html, F.lit('"'), F.lit("&quot;"))).otherwise(html).alias("html"))
    out = external.field_page(rows, F.col("html"))
    return out.select("id", *(F.col(f"external_{c}").alias(c) for c in ("soc_name", "antutu", "battery_mah", "charging_w", "panel", "display_inches", "resolution", "main_camera_mp", "ois", "nfc", "ip_rating")))


@query("""WITH w AS (SELECT p_partkey AS query_id, CASE WHEN p_size % 2 = 0 THEN p_size * 1000 END AS most, CASE WHEN p_size % 3 = 0 THEN 500 END AS least, p_size % 5 = 0 AS branded, 'phone%20x' || p_size || '%20%26%20y' AS t FROM part),
p AS (SELECT 'flipkart' AS platform, unnest([1, 6]) AS page UNION ALL SELECT 'amazon', unnest([1, 2, 3, 4, 5, 6]) UNION ALL SELECT 'reliance', unnest([1, 6]) UNION ALL SELECT 'tatacliq', unnest([1, 6]))
SELECT query_id, platform, page, CASE platform WHEN 'flipkart' THEN 'https://www.flipkart.com/search?q=' || t || '&page=' || page || '&sort=popularity' || coalesce('&p%5B%5D=facets.price_range.from%3DMin&p%5B%5D=facets.price_range.to%3D' || most, '') || coalesce('&p%5B%5D=facets.price_range.from%3D' || least, '') || CASE WHEN branded THEN '&p%5B%5D=facets.brand%5B%5D%3DPOCO' ELSE '' END
 WHEN 'amazon' THEN 'https://www.amazon.in/s?k=' || t || '&page=' || page || coalesce('&low-price=0&high-price=' || most, '') WHEN 'reliance' THEN 'https://www.reliancedigital.in/search?q=' || t || '&page_no=' || page || '&page_size=40&page_type=number'
 ELSE 'https://www.tatacliq.com/search/?searchCategory=all&text=' || t || '&page=' || page || coalesce('&p%5B%5D=facets.price_range.from%3DMin&p%5B%5D=facets.price_range.to%3D' || most, '') END AS url FROM w, p""")
def search_pages(spark, sf_dir):
    """Two seeds a platform, three times as many single pages of one; budgets and brands as facets where a platform has them."""
    size = F.col("p_size")
    wish = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("the best phone x"), size, F.lit(" & y")).alias("raw"), F.lit("phone").alias("category_wanted"), F.when(size % 5 == 0, F.array(F.lit("POCO"))).otherwise(F.array().cast("array<string>")).alias("brands"), F.when(size % 2 == 0, size * 1000).alias("budget_max"), F.when(size % 3 == 0, 500).alias("budget_min"))
    return captured.search_pages(wish, 2)

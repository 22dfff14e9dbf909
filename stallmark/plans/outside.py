"""Registered queries over outside sources, the audit of what is known, scan failures and fetch queues, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import external, report
from .catalog import query
from .view import table


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 1 THEN 'b-' ELSE 'a-' END || p_partkey AS slug, 'Widget M' || p_size || CASE WHEN p_partkey % 4 = 1 THEN ' 5G' ELSE ' Pro' END AS name FROM part WHERE p_partkey % 4 < 3""")
def source_pages(spark, sf_dir):
    """Two addresses for each name: the first is the product, another product, the product (the second too), or both are others."""
    n = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    name = F.concat(F.lit("Widget M"), "p_size")
    wanted = part.select(n.alias("id"), name.alias("name"), F.array(F.concat(F.lit("a-"), n), F.concat(F.lit("none-"), n), F.concat(F.lit("b-"), n)).alias("slugs"))
    first = part.select(F.concat(F.lit("a-"), n).alias("slug"), F.when(n % 4 == 1, "Gadget").when(n % 4 == 3, "").otherwise(F.concat(name, F.lit(" Pro"))).alias("page_name"))
    second = part.select(F.concat(F.lit("b-"), n).alias("slug"), F.when(n % 4 == 3, "Gadget Z").otherwise(F.concat(name, F.lit(" 5G"))).alias("page_name"))
    return external.first_source(wanted, first.unionByName(second))


@query("""SELECT p_partkey AS id, 'soc_name' AS field, 'Helio G' || p_size AS known, 'Exynos ' || p_size AS outside FROM part WHERE p_partkey % 3 < 2 AND p_partkey % 5 = 0 AND p_partkey % 7 > 0""")
def source_conflicts(spark, sf_dir):
    """Chips known from the base, inferred, or told by the page; outside sources that agree but for the case, differ, or are silent."""
    n = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    source = F.when(n % 3 == 0, "kb").when(n % 3 == 1, "inferred").otherwise("page")
    products = part.select(n.alias("id"), source.alias("source"), F.concat(F.lit("Helio G"), "p_size").alias("soc_name"))
    outside = part.where("p_partkey % 7 > 0").select(n.alias("id"), F.when(n % 5 == 0, F.concat(F.lit("Exynos "), "p_size")).otherwise(F.concat(F.lit("HELIO g"), "p_size")).alias("soc_name"))
    return external.conflicts(products, outside)


@query("""WITH t AS (SELECT CASE WHEN p_partkey % 6 = 5 THEN 'not found' WHEN p_partkey % 6 = 4 THEN 'chipset' WHEN p_size % 3 = 0 THEN 'battery' WHEN p_size % 5 = 0 THEN 'benchmark' ELSE 'agree' END AS outcome FROM part) SELECT outcome, count(*) AS n FROM t GROUP BY outcome""")
def knowledge_audit(spark, sf_dir):
    """Live pages that are missing, name another chip, or differ in battery or benchmark by more, and by just as much, as is let pass."""
    n, size = F.col("p_partkey"), F.col("p_size")
    part = table(spark, sf_dir, "part")
    known = part.select(n.alias("key"), F.lit("Helio G9").alias("soc_name"), F.lit(5000).alias("battery_mah"), F.lit(200000).alias("antutu"))
    live = part.where("p_partkey % 6 < 5").select(n.alias("key"), F.when(n % 6 == 4, "Exynos 8").otherwise("HELIO G9").alias("soc_name"), F.when(size % 3 == 0, 5061).otherwise(5060).alias("battery_mah"), F.when(size % 5 == 0, 220001).otherwise(220000).alias("antutu"))
    return external.audit(known, live)


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'crawler_error' WHEN p_size % 10 = 0 THEN 'empty' WHEN p_partkey % 4 = 0 THEN 'wrong_products' WHEN 2 * (p_partkey % 50) < p_size % 10 * 5 OR p_partkey % 10 < 6 THEN 'fields_missing' ELSE 'healthy' END AS failure FROM part""")
def scan_failures(spark, sf_dir):
    n, size = F.col("p_partkey"), F.col("p_size")
    d = table(spark, sf_dir, "part").select("p_partkey", F.when(n % 5 == 0, "error").otherwise("ok").alias("status"), (size % 10 * 5).alias("raw_cards"), F.when(n % 4 == 0, 0).otherwise(3).alias("category_matched"), (n % 50).alias("priced"), (n % 10 / 10.0).alias("field_fill"))
    return external.failure(d).select("p_partkey", "failure")


@query("""WITH t AS (SELECT p_size AS query_id, p_partkey AS page_key, p_partkey % 21 / CAST(20 AS DOUBLE) AS completeness FROM part WHERE p_partkey % 9 > 0 AND NOT (p_partkey % 21 >= 19 AND p_partkey % 2 = 0 AND p_partkey % 3 > 0) AND p_partkey % 4 > 0)
SELECT query_id, page_key, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY completeness, page_key) AS place FROM t) WHERE place <= 15""")
def fetch_order(spark, sf_dir):
    """Candidates without an address, with all that is wanted, and cached ones are not fetched; fifteen a query are."""
    n = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    cands = part.select(F.col("p_size").alias("query_id"), n.alias("page_key"), F.when(n % 9 > 0, F.concat(F.lit("https://shop.example/"), n)).alias("url"), (n % 21 / 20.0).alias("completeness"), F.when(n % 2 == 0, "high").otherwise("low").alias("kb_confidence"), F.when(n % 3 > 0, F.lit(True)).alias("checkout"))
    cached = part.where("p_partkey % 4 = 0").select(n.alias("page_key"))
    return external.fetch_queue(cands, cached, 15).select("query_id", "page_key", "place")


@query("""WITH t AS (SELECT p_size % 5 AS query_id, p_partkey AS page_key, p_partkey % 21 / CAST(20 AS DOUBLE) AS completeness, p_partkey % 2 = 0 AS shop, p_partkey % 7 AS richness, p_partkey % 5 AS way FROM part WHERE p_partkey % 9 > 0 AND NOT (p_partkey % 21 >= 19 AND p_partkey % 2 = 0 AND p_partkey % 3 > 0) AND p_partkey % 4 > 0),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY completeness, page_key) AS place FROM t QUALIFY place <= 150),
r AS (SELECT query_id, page_key, row_number() OVER (PARTITION BY query_id ORDER BY completeness, page_key) AS turn FROM f WHERE shop AND way > 1 AND richness < 2)
SELECT f.query_id, f.page_key, CAST(f.place AS INTEGER) AS place, coalesce(turn <= 12, false) AS rescued FROM f LEFT JOIN r USING (query_id, page_key)""")
def fetch_rounds(spark, sf_dir):
    """A budget of 150 pages for each of five large queries; pages of one shop, read directly, that say too little are read again, twelve a query."""
    n = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    url = F.when(n % 9 > 0, F.concat(F.when(n % 2 == 0, "https://www.flipkart.com/").otherwise("https://shop.example/"), n))
    cands = part.select((F.col("p_size") % 5).alias("query_id"), n.alias("page_key"), url.alias("url"), (n % 21 / 20.0).alias("completeness"), F.when(n % 2 == 0, "high").otherwise("low").alias("kb_confidence"), F.when(n % 3 > 0, F.lit(True)).alias("checkout"))
    found = part.select(n.alias("page_key"), F.when(n % 5 > 1, "direct").when(n % 5 == 1, "unlocker").alias("via"), (n % 7).alias("richness"))
    return external.fetch_rounds(cands, part.where("p_partkey % 4 = 0").select(n.alias("page_key")), found, 150)


@query("""WITH p AS (SELECT p_brand AS brand, p_size % 5 + 1 AS page, p_partkey AS pos, 'w_' || (p_partkey % 300) || '-' || (p_partkey % 300) || '.php' AS slug, 'Widget ' || p_partkey AS name FROM part),
k AS (SELECT * FROM p WHERE NOT (brand LIKE '%2' AND page = 2) AND NOT (brand LIKE '%3' AND page = 3) AND page <= 4 AND name NOT LIKE '%7'),
e AS (SELECT brand, page, count(*) AS n FROM k GROUP BY ALL), g AS (SELECT brand, min(q.page) AS stop FROM (SELECT DISTINCT brand FROM p) b, (VALUES (1), (2), (3), (4), (5)) q(page) WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.brand = b.brand AND e.page = q.page) GROUP BY brand)
SELECT slug, arg_min(k.brand, (k.brand, page, pos)) AS brand, arg_min(name, (k.brand, page, pos)) AS name FROM k JOIN g ON k.brand = g.brand AND k.page < g.stop GROUP BY slug""")
def index_walk(spark, sf_dir):
    """Numbered pages of every brand: one brand's second page has no links, another's third is missing, a slug is on several pages."""
    n = F.col("p_partkey")
    slug = F.concat(F.lit("w_"), n % 300, F.lit("-"), n % 300, F.lit(".php"))
    name = F.when(n % 10 == 7, "News").otherwise(F.concat(F.lit("Widget "), n))
    link = F.concat(F.lit('<li><a href="'), F.when(n % 2 == 0, "https://index.example/").otherwise(""), slug, F.lit('" title="x"><img src=a><strong>'), name, F.lit("</strong></a>"))
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), (F.col("p_size") % 5 + 1).alias("page"), n.alias("pos"), link.alias("link"))
    empty = F.col("brand").endswith("2") & (F.col("page") == 2)
    pages = rows.where(~(F.col("brand").endswith("3") & (F.col("page") == 3))).groupBy("brand", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "link"))), lambda x: x["link"]), "\n").alias("links"))
    pages = pages.select("brand", "page", F.when(empty, "<p>No phones</p>").otherwise(F.col("links")).alias("html"))
    return external.index_entries(pages, page_col="page", most=4)


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'moto-g45,motorola-g45' WHEN 1 THEN 'redmi-13-pro-plus-5g,note-13-pro-plus-5g,redmi-note-13-pro-plus-5g,redmi-13-pro-plus' WHEN 2 THEN 'edge-' || p_size || ',samsung-edge-' || p_size WHEN 3 THEN '' ELSE 'vivo-t3x-5g,vivo-t3x' END AS slugs,
 p_partkey % 5 <> 3 AND p_partkey % 3 < 2 AS same FROM part""")
def source_slugs(spark, sf_dir):
    """Addresses of a model under other words for its brand, with the brand before it and without its network; pages that are its own and not."""
    n = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(n % 5 == 0, "Motorola G45 (Blue) 8 GB").when(n % 5 == 1, "Note 13 Pro+ 5G").when(n % 5 == 2, F.concat(F.lit("Edge "), "p_size")).when(n % 5 == 3, "(smartphone)").otherwise("vivo T3x 5G India").alias("name"), F.when(n % 5 == 1, "Xiaomi").when(n % 5 == 2, "Samsung").when(n % 5 == 4, "vivo").alias("brand"))
    title = F.when(n % 3 == 0, F.concat(F.lit("<title>"), F.regexp_replace("name", "Motorola", "Moto"), F.lit(" full specs</title>"))).when(n % 3 == 1, F.concat(F.lit('{"name": "'), "name", F.lit('"}'))).otherwise("<title>Another Device</title>")
    out = rows.select("p_partkey", external.slugs(F.col("name"), F.coalesce("brand", F.lit(""))).alias("slugs"), title.alias("html"), "name")
    return out.select("p_partkey", F.array_join("slugs", ",").alias("slugs"), external.is_page_of(F.col("name"), F.col("html"), F.lit("unrelated")).alias("same"))


@query("""SELECT 'amazon' AS platform, 'amazon returned ' || count(*) || ' cards and no phones — pages are rendered late' AS note FROM part WHERE p_partkey % 4 = 1 HAVING count(*) > 0 UNION ALL SELECT 'reliance', 'reliance returned ' || count(*) || ' cards and no phones — only accessories are listed' FROM part WHERE p_partkey % 4 = 2 HAVING count(*) > 0""")
def platform_issues(spark, sf_dir):
    """Platforms that returned cards but none of the class, with and without a known reason."""
    n = F.col("p_partkey")
    name = F.get(F.array(*map(F.lit, ["flipkart", "amazon", "reliance", "tatacliq"])), (n % 4).cast("int"))
    seen = table(spark, sf_dir, "part").groupBy(name.alias("platform")).agg(F.count("*").alias("raw_cards"), F.count_if(n % 4 == 0).alias("category_matched"))
    known = spark.createDataFrame([("flipkart", "never"), ("amazon", "pages are rendered late"), ("reliance", "only accessories are listed"), ("tatacliq", None)], "platform string, known_issue string")
    return report.known_issues(seen, known)


@query("""WITH l AS (SELECT p_brand AS brand, list(struct_pack(n := p_partkey, url := 'https://x.example/p/' || p_size) ORDER BY p_partkey) AS ls, max(p_size) AS asked FROM part GROUP BY p_brand) SELECT brand, coalesce(list_filter(ls, lambda x: x.url = 'https://x.example/p/' || (asked - asked % 2))[1].n, ls[1].n) AS listing FROM l""")
def page_listings(spark, sf_dir):
    """The listing that a page of each brand belongs to: the first of its address, whatever the parameters, else the first."""
    url = F.concat(F.lit("https://x.example/p/"), "p_size", F.lit("?ref="), "p_partkey")
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.sort_array(F.collect_list(F.struct(F.col("p_partkey").alias("n"), url.alias("url")))).alias("ls"), F.max("p_size").alias("asked"))
    page = F.concat(F.lit("https://x.example/p/"), F.col("asked") - F.col("asked") % 2, F.lit("?utm=1"))
    return rows.select("brand", report.listing_of_page(F.col("ls"), page)["n"].alias("listing"))

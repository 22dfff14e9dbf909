"""Saved payloads of searches and page reads: envelopes, lines of JSON, which read counts, manifests, search words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runs import PLATFORMS

# Words that say nothing to a shop's search, and what each class is called there.
NOISE = r"(?i)\b(best|top|good|nice|great|show|find|me|some|please|the|a|an|list|of|any|which|what|are)\b"
CLASS_WORDS = {"phone": "smartphone", "earbuds": "earbuds", "headphone": "headphones", "laptop": "laptop", "tablet": "tablet", "smartwatch": "smartwatch", "tv": "smart tv", "camera": "camera"}
# What a search result's fields are called on a card.
CARD_FIELDS = {"product_name": "title", "selling_price": "price", "original_price": "originalPrice", "discount_percentage": "discount", "rating": "rating", "review_count": "reviewsCount", "brand": "brand", "availability": "availability", "image_url": "imageUrl", "product_url": "url", "asin": "asin", "seller": "seller"}
#: A direct read of no more characters than this was refused.
BLOCKED = 2000


def unwrapped(payload: Column) -> Column:
    """The text in an envelope's body, or the payload itself where it is no envelope."""
    parsed = F.try_parse_json(payload)
    body = F.try_variant_get(parsed, "$.body", "variant")
    return F.coalesce(F.when(F.schema_of_variant(body) == "STRING", F.try_variant_get(parsed, "$.body", "string")), payload)


def json_lines(payloads: DataFrame, text_col: str = "payload") -> DataFrame:
    """Each payload's rows (pos, raw): of its array, of its lines that are JSON objects if the first is one or the whole is none, else the object that it is."""
    whole = F.try_parse_json(F.col(text_col))
    one = r"^\s*\{.*\}\s*$"
    lines = F.split(text_col, "\n")
    parsed = F.transform(lines, lambda line, i: F.struct(i.alias("pos"), F.when(line.rlike(one), F.try_parse_json(line)).alias("raw")))
    entries = F.transform(F.try_variant_get(whole, "$", "array<variant>"), lambda v, i: F.struct(i.alias("pos"), v.alias("raw")))
    kind = F.schema_of_variant(whole)
    rows = F.when(kind.startswith("ARRAY"), entries).when(kind.startswith("OBJECT") & ~F.get(lines, F.lit(0)).rlike(one), F.array(F.struct(F.lit(0).alias("pos"), whole.alias("raw"))))
    rows = rows.otherwise(F.filter(parsed, lambda e: e["raw"].isNotNull()))
    return payloads.withColumn("_row", F.explode(rows)).select(*(c for c in payloads.columns if c != text_col), "_row.pos", "_row.raw")


def search_cards(rows: DataFrame) -> DataFrame:
    """Search results (raw) as cards: fields under the names that ``runs.listings`` reads, a discount as a percentage."""
    def field(name):
        value = F.try_variant_get("raw", f"$.{name}", "string")
        return F.when(F.coalesce(value, F.lit("0")) != "0", F.concat(value, F.lit("%"))) if name == "discount" else value

    card = F.to_variant_object(F.struct(*(field(v).alias(k) for k, v in CARD_FIELDS.items())))
    return rows.withColumn("raw", card)


def fetched(reads: DataFrame, mode: Column, allow_paid: Column) -> DataFrame:
    """Adds text, via and error to reads (direct, paid): the direct one if it is long enough, else the paid one if allowed.

    ``mode`` is auto, direct or unlocker; a null read is one that failed.
    """
    tries = mode.isin("auto", "direct")
    good = tries & (F.length("direct") > BLOCKED)
    pays = mode.isin("auto", "unlocker") & allow_paid
    paid = F.when(F.col("paid").isNotNull(), unwrapped(F.col("paid")))
    reasons = F.concat_ws(" | ", F.when(tries, F.coalesce(F.concat(F.lit("direct: "), F.length("direct"), F.lit(" chars (likely blocked)")), F.lit("direct: failed"))), F.when(pays, F.lit("unlocker: failed")))
    via = F.when(good, "direct").when(pays & paid.isNotNull(), "unlocker")
    text = F.when(good, F.col("direct")).when(pays, paid)
    return reads.withColumns({"text": text, "via": via, "error": F.when(via.isNull(), F.coalesce(F.nullif(reasons, F.lit("")), F.lit("no transport available")))})


def search_term(intents: DataFrame) -> Column:
    """What to type into a shop's search: the query without noise words, or brands, class and model where too little is left."""
    cleaned = F.trim(F.regexp_replace(F.regexp_replace("raw", NOISE, " "), r"\s+", " "))
    called = reduce(lambda acc, kv: acc.when(F.col("category_wanted") == kv[0], kv[1]), list(CLASS_WORDS.items())[1:], F.when(F.col("category_wanted") == "phone", CLASS_WORDS["phone"])).otherwise(F.col("category_wanted"))
    hint = F.nullif(F.col("model_hint"), F.lit("")) if "model_hint" in intents.columns else F.lit(None).cast("string")
    parts = F.concat_ws(" ", F.when(F.size("brands") > 0, F.array_join("brands", " ")), called, hint)
    return F.when(F.length(cleaned) >= 3, cleaned).otherwise(F.coalesce(F.nullif(F.trim(parts), F.lit("")), F.col("raw")))


def picked(asked: Column, platforms: list[str] = PLATFORMS) -> Column:
    """The platforms that a comma-separated text names, in their own order; all where it names none."""
    wanted = F.transform(F.split(F.coalesce(asked, F.lit("")), ","), lambda p: F.lower(F.trim(p)))
    every = F.array(*map(F.lit, platforms))
    named = F.filter(every, lambda p: F.array_contains(wanted, p))
    return F.when(F.size(named) > 0, named).otherwise(every)


# Search addresses of each platform, and what a budget and brands add to them.
SEARCHES = {
    "flipkart": "https://www.flipkart.com/search?q={term}&page={page}&sort=popularity",
    "amazon": "https://www.amazon.in/s?k={term}&page={page}",
    "reliance": "https://www.reliancedigital.in/search?q={term}&page_no={page}&page_size=40&page_type=number",
    "tatacliq": "https://www.tatacliq.com/search/?searchCategory=all&text={term}&page={page}",
}
FACET = "&p%5B%5D=facets.price_range."
#: One address of a collector walks so many pages; of the platform that walks none so many times more are asked for.
STRIDE, DEEPER = 5, 3


def _search_page(platform: str, before: Column, after: Column):
    return lambda p: F.struct(F.lit(platform).alias("platform"), p.alias("page"), F.concat(before, p.cast("string"), after).alias("url"))


def search_pages(intents: DataFrame, pages: int) -> DataFrame:
    """(query_id, platform, page, url): every platform's search pages with budget and brands in their addresses, as far as it has facets.

    Pages are 1, 6, 11 ... ; of amazon 1, 2, 3 ... and three times as many.
    """
    term = F.replace(F.url_encode(search_term(intents)), F.lit("+"), F.lit("%20"))
    most, least = (F.col(c).cast("string") for c in ("budget_max", "budget_min"))
    to = F.coalesce(F.concat(F.lit(f"{FACET}from%3DMin{FACET}to%3D"), most), F.lit(""))
    brands = F.array_join(F.transform("brands", lambda b: F.concat(F.lit("&p%5B%5D="), F.replace(F.url_encode(F.concat(F.lit("facets.brand[]="), b)), F.lit("+"), F.lit("%20")))), "")
    facets = {
        "flipkart": F.concat(to, F.coalesce(F.concat(F.lit(f"{FACET}from%3D"), least), F.lit("")), brands),
        "amazon": F.coalesce(F.concat(F.lit("&low-price=0&high-price="), most), F.lit("")), "reliance": F.lit(""), "tatacliq": to,
    }
    each = []
    for platform, address in SEARCHES.items():
        step, n = (1, pages * DEEPER) if platform == "amazon" else (STRIDE, pages)
        head, _, tail = address.partition("{term}")
        mid, _, end = tail.partition("{page}")
        each.append(F.transform(F.sequence(F.lit(1), F.lit(1 + (n - 1) * step), F.lit(step)), _search_page(platform, F.concat(F.lit(head), term, F.lit(mid)), F.concat(F.lit(end), facets[platform]))))
    return intents.select("query_id", F.inline(F.concat(*each)))


def manifest(health: DataFrame, query: str, search_query: str, timestamp: str) -> DataFrame:
    """One row of JSON that tells a run's query, time and, for each platform of ``runs.health``, file, count, status and error."""
    each = F.struct("platform", F.concat("platform", F.lit(".json")).alias("file"), F.col("raw_cards").alias("count"), "status", F.col("first_error").alias("error"))
    told = health.agg(F.sort_array(F.collect_list(each)).alias("platforms"))
    return told.select(F.to_json(F.struct(F.lit(query).alias("query"), F.lit(search_query).alias("searchQuery"), F.lit(timestamp).alias("timestamp"), "platforms")).alias("value"))


def captured_at(spark: SparkSession, paths: list[str]) -> str | None:
    """When a run was captured: its manifest's time under either name, else the newest file's; of the first path that has one."""
    for path in paths:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
        parsed = F.try_parse_json(F.col("content").cast("string"))
        told = F.coalesce(*(F.try_variant_get(parsed, f"$.{k}", "string") for k in ("timestamp", "capturedAt")))
        time = files.option("pathGlobFilter", "manifest.json").load(path).agg(F.max(told).alias("told")).first()["told"]
        changed = files.option("pathGlobFilter", "*.json").load(path).agg(F.date_format(F.max("modificationTime"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("changed")).first()["changed"]
        if time or changed:
            return time or changed
    return None


def rejected_listings(rejected: DataFrame, listings: DataFrame, keys: list[str]) -> DataFrame:
    """Rejected candidates back as their listings, each with the reasons against it."""
    return listings.join(rejected.select(*keys, "query_id", "reasons"), keys)


def slim(rows: DataFrame) -> DataFrame:
    """Rows as JSON for a file, without raw payloads and listings."""
    return rows.select(F.to_json(F.struct(*(c for c in rows.columns if c not in ("raw", "listings")))).alias("value"))


def resolution_counts(outcomes: DataFrame) -> DataFrame:
    """How many products (outcome) were matched, not matched, cached, read directly or paid, failed and skipped: one row."""
    kinds = ["matched", "unmatched", "cached", "direct", "paid", "failed", "skipped"]
    return outcomes.agg(*(F.count_if(F.col("outcome") == k).alias(k) for k in kinds))

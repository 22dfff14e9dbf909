"""Marketplace runs: a directory of one JSON file per platform, of any shape, to listings with scan health."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import parse
from ..functions.maths import jround

# Input keys of each listing field, the first that is there wins.
KEYS = {
    "url": ["product_url", "product_page_url", "productUrl", "url", "link"],
    "title": ["product_name", "product_title", "title", "name", "productName"],
    "price": ["selling_price", "final_price", "price", "current_price", "offer_price", "discounted_price"],
    "mrp": ["original_price", "initial_price", "originalPrice", "mrp", "list_price", "strike_price"],
    "discount": ["discount_percentage", "discount", "discount_text"],
    "availability": ["availability", "stock_status", "in_stock_text"],
    "in_stock": ["in_stock", "inStock"],
    "image_url": ["image_url", "image", "main_image", "imageUrl", "img"],
    "rating": ["rating", "product_rating", "stars"],
    "rating_count": ["review_count", "reviews_count", "reviewsCount", "num_ratings", "ratings_count", "reviews"],
    "sponsored": ["sponsored", "is_sponsored"],
    "source_rank": ["position", "rank_on_page"],
}
WRAPPERS = ["products", "data", "results", "items"]
PLATFORMS = ["flipkart", "amazon", "reliance", "tatacliq"]


def _get(k: str, kind: str = "string") -> Column:
    return F.try_variant_get("raw", f"$.{k}", kind)


def _field(name: str) -> Column:
    """The first key that is neither absent nor null, as text; money in an object is its value, amount, price or raw."""
    def one(k):
        v = F.try_variant_get("raw", f"$.{k}", "variant")
        plain = F.when(~F.is_variant_null(v) & ~F.schema_of_variant(v).startswith("OBJECT"), _get(k))
        return F.coalesce(plain, *(F.try_variant_get("raw", f"$.{k}.{inner}", "string") for inner in ("value", "amount", "price", "raw")))

    return F.coalesce(*(one(k) for k in KEYS[name]))


def _text(name: str) -> Column:
    """The first key that holds text that is not blank; numbers are no text."""
    return F.coalesce(*(F.when(F.schema_of_variant(F.try_variant_get("raw", f"$.{k}", "variant")) == "STRING", F.nullif(F.trim(_get(k)), F.lit(""))) for k in KEYS[name]))


def cards(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(platform, file, pos, raw): the cards of all runs; files hold an array or wrap one."""
    files = spark.read.option("multiLine", True).option("singleVariantColumn", "raw").option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).json(paths)
    files = files.select("raw", F.col("_metadata.file_name").alias("file")).where("file <> 'manifest.json'")
    wrapped = ", ".join(f"try_variant_get(raw, '$.{w}', 'variant')" for w in WRAPPERS)
    files.createOrReplaceTempView("_run_files")
    rows = spark.sql(f"SELECT file, e.pos, e.value AS raw FROM _run_files, LATERAL variant_explode(CASE WHEN schema_of_variant(raw) LIKE 'ARRAY%' THEN raw ELSE coalesce({wrapped}, raw) END) AS e")
    label = F.lower(F.concat_ws(" ", _get("platform"), _get("url"), _get("product_url"), _get("input.url")))
    named = F.coalesce(*(F.when(F.col("file").startswith(p), p) for p in PLATFORMS))
    seen = F.first(F.when(F.col("pos") < 20, F.coalesce(*(F.when(label.contains(p), p) for p in PLATFORMS))), ignorenulls=True).over(Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("platform", F.coalesce(named, seen, F.lit("unknown"))).where(F.schema_of_variant("raw").startswith("OBJECT"))


def listings(raw: DataFrame) -> DataFrame:
    """Cards normalised: error cards and cards without a title go, those without a price stay."""
    errors = F.coalesce(_get("error"), _get("error_code")).isNotNull()
    url, title = _text("url"), _text("title")
    out = raw.where(~errors).withColumn("url", url).withColumn("own_title", title).withColumn("title", F.coalesce("own_title", parse.title_from_url(F.col("url")))).where("title IS NOT NULL")
    price, mrp = parse.money(_field("price")), parse.money(_field("mrp"))
    stock_text = _text("availability")
    out = out.withColumns({"price": price, "mrp0": mrp, "availability": stock_text, "image_url": _text("image_url"), "sponsored": F.coalesce(parse.flag(_field("sponsored")), F.lit(False)), "source_rank": _field("source_rank").try_cast("int")})
    # A list price stands where there is no price to hold it against.
    out = out.withColumn("mrp", F.when(F.col("price").isNull() | ((F.col("mrp0") > F.col("price")) & (F.col("mrp0") <= 5 * F.col("price"))), F.col("mrp0"))).drop("mrp0")
    given = _field("discount")
    off = F.coalesce(parse.percent(given), F.when(given.rlike(r"^\d+(\.\d+)?$") & given.try_cast("double").between(0.5, 100), jround(given.try_cast("double"))), jround((F.col("mrp") - F.col("price")) / F.col("mrp") * 100))
    stock = F.coalesce(parse.flag(_field("in_stock")), F.when(parse.matches(stock_text, "out of stock|sold out|unavailable"), False).when(parse.matches(stock_text, "pincode"), None).when(parse.matches(stock_text, "in stock|available|instock"), True))
    out = out.withColumns({"discount_pct": off.cast("int"), "in_stock": stock, "rating": parse.rating(_field("rating").try_cast("double")), "rating_count": parse.count_of(_field("rating_count"))})
    named = F.coalesce(parse.canonical_url(F.col("url")), F.col("title"))
    # 64 bits more: of a million addresses some hundred pairs share the 32 bits of a stable id.
    identity = F.concat(parse.stable_id(F.col("platform"), named), F.lit("-"), F.lower(F.hex(F.xxhash64(named))))
    missing = F.array_compact(F.array(F.when(F.col("price").isNull(), "price"), F.when(F.col("mrp").isNull(), "mrp"), F.when(F.col("rating").isNull(), "rating"), F.when(F.col("own_title").isNull(), "title(recovered)")))
    return out.withColumns({"id": identity, "missing": missing, "ord": F.struct("file", "pos")}).drop("own_title")


def health(raw: DataFrame) -> DataFrame:
    """Per platform: cards, error cards, and ok, error or empty."""
    error = F.coalesce(_get("error"), _get("error_code"))
    counts = raw.groupBy("platform").agg(F.count("*").alias("raw_cards"), F.count_if(error.isNotNull()).alias("errors"), F.min_by(error, F.when(error.isNotNull(), F.col("pos"))).alias("first_error"))
    usable = F.col("raw_cards") - F.col("errors")
    return counts.withColumn("status", F.when(usable > 0, "ok").when(F.col("errors") > 0, "error").otherwise("empty"))


def scan_counts(raw: DataFrame) -> DataFrame:
    """Per platform what became of its cards: raw, error cards, titles recovered from addresses, and cards dropped without one."""
    failed = F.coalesce(_get("error"), _get("error_code")).isNotNull()
    own, recovered = _text("title").isNotNull(), parse.title_from_url(_text("url")).isNotNull()
    return raw.groupBy("platform").agg(F.count("*").alias("raw_cards"), F.count_if(failed).alias("error_cards"), F.count_if(~failed & ~own & recovered).alias("title_recovered"), F.count_if(~failed & ~own & ~recovered).alias("dropped"))


def save(raw: DataFrame, path: str) -> None:
    """One folder of JSON per platform."""
    raw.select("platform", F.to_json("raw").alias("value")).write.partitionBy("platform").mode("errorifexists").text(path)


def run_name(query: str, at: dt.datetime) -> str:
    """UTC time and a slug of the query, 48 characters at most."""
    slug = re.sub("[^a-z0-9]+", "-", query.lower()).strip("-")[:48].strip("-")
    return f"{at.astimezone(dt.timezone.utc):%Y-%m-%dT%H-%M-%S}-{slug}"


def search_urls(queries: DataFrame, template: str, pages: int, stride: int = 5) -> DataFrame:
    """(query_id, page, url): a source's search pages 1, 1 + stride, ... with keyword and budget in the URL."""
    page = F.explode(F.sequence(F.lit(1), F.lit(1 + (pages - 1) * stride), F.lit(stride)))
    keyword = F.trim(F.regexp_replace(F.regexp_replace(F.lower("raw"), r"\b(best|top|good|under|below|above|around|for|in|india|rs|inr)\b|[₹,]|\b\d{3,}\b", " "), r"\s+", " "))
    rows = queries.select("query_id", "budget_max", keyword.alias("keyword"), page.alias("page"))
    filled = F.lit(template)
    for name in ("keyword", "page", "budget_max"):
        filled = F.replace(filled, F.lit("{" + name + "}"), F.url_encode(F.coalesce(F.col(name).cast("string"), F.lit(""))))
    return rows.select("query_id", "page", filled.alias("url"))

"""What is told of intents, products, histories and scans, as columns and tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.maths import jround
from ..functions.parse import canonical_url, rupees
from .text import token_overlap

# How classes that cannot be ranked are called.
CLASS_NAMES = {"featurephone": "keypad phones", "earbuds": "earbuds", "headphone": "headphones", "laptop": "laptops", "tablet": "tablets", "smartwatch": "smartwatches", "tv": "TVs", "camera": "cameras", "accessory": "accessories"}
# Words that say nothing of which product a title names.
TITLE_STOP = ["buy", "online", "the", "gb", "price", "best"]
#: How far a price may move before it counts as another one.
MOVED = 0.02
#: The fields whose share of known values tells how full a scan is.
FILLED = ["title", "price", "mrp", "rating", "rating_count", "image_url", "url", "storage_gb"]


def unsupported_reason(category: Column, raw: Column) -> Column:
    """Why a query cannot be ranked, null if it can."""
    label = reduce(lambda acc, kv: acc.when(category == kv[0], kv[1]), list(CLASS_NAMES.items())[1:], F.when(category == "featurephone", CLASS_NAMES["featurephone"])).otherwise(category)
    return F.when(~category.isin("phone", "unknown"), F.concat(F.lit('This tool ranks phones. "'), raw, F.lit('" looks like a search for '), label, F.lit(".")))


def described(i: dict[str, Column]) -> Column:
    """An intent in words: class, brands, budget, priorities and must-haves."""
    low, high, kind = i["budget_min"], i["budget_max"], i["budget_operator"]
    budget = F.when((kind == "under") & (high > 0), F.concat(F.lit("under "), rupees(high))).when(kind == "between", F.concat(rupees(low), F.lit("–"), rupees(high)))
    budget = budget.when((kind == "around") & (high > 0), F.concat(F.lit("around "), rupees((F.coalesce(low, F.lit(0)) + high) / 2))).when((kind == "over") & (low > 0), F.concat(F.lit("over "), rupees(low)))

    def listed(name, c, mark):
        return F.when(F.size(c) > 0, F.concat(F.lit(name), F.array_join(c, mark)))

    what = F.when(i["category_wanted"] == "unknown", "any product").otherwise(i["category_wanted"])
    return F.concat_ws(" · ", what, listed("brand: ", i["brands"], "/"), budget, listed("priorities: ", i["priorities"], ", "), listed("must have: ", i["must_have"], ", "))


def display_name(name: Column, ram: Column, storage: Column, qualifiers: Column) -> Column:
    """A name without brackets, its configuration, and conditions of sale joined by plus signs."""
    base = F.trim(F.regexp_replace(F.regexp_replace(name, r"\s*\([^)]*\)\s*", " "), r"\s+", " "))
    tb = storage / 1024
    size = F.when(storage >= 1024, F.concat(F.when(tb == F.floor(tb), F.floor(tb).cast("string")).otherwise(tb.cast("string")), F.lit("TB"))).when(storage > 0, F.concat(storage.cast("string"), F.lit("GB")))
    config = F.concat_ws("/", F.when(ram > 0, F.concat(ram.cast("string"), F.lit("GB"))), size)
    marks = F.when(F.coalesce(qualifiers, F.lit("")) != "", F.concat(F.lit(" ["), F.replace(qualifiers, F.lit("+"), F.lit(" + ")), F.lit("]"))).otherwise("")
    return F.concat(F.when(config != "", F.concat(base, F.lit(" ("), config, F.lit(")"))).otherwise(base), marks)


def field_fill(have: dict[str, Column], fields: list[str] = FILLED) -> Column:
    """The share of a row's fields that are known; its mean over rows tells how full a scan is."""
    return sum((have[f].isNotNull().cast("double") for f in fields), F.lit(0.0)) / len(fields)


def funnel(listings: DataFrame, gated: DataFrame, have: dict[str, Column], by: str = "platform") -> DataFrame:
    """Per platform: raw_cards, priced, category_matched, in_budget, survived, field_fill and a map of reasons to counts.

    ``gated`` has the listings' rows with the reasons against them.
    """
    seen = listings.groupBy(by).agg(F.count("*").alias("raw_cards"), F.count("price").alias("priced"), jround(F.avg(field_fill(have)), 4).alias("field_fill"))
    none = F.size("reasons") == 0
    passed = gated.groupBy(by).agg(
        F.count_if(~F.array_contains("reasons", "category")).alias("category_matched"),
        F.count_if(~F.array_contains("reasons", "over budget") & ~F.array_contains("reasons", "below budget") & F.col("price").isNotNull()).alias("in_budget"),
        F.count_if(none).alias("survived"),
    )
    told = gated.select(by, F.explode("reasons").alias("reason")).groupBy(by, "reason").agg(F.count("*").alias("n")).groupBy(by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("reason", "n")))).alias("reasons"))
    out = seen.join(passed, by, "left").join(told, by, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("category_matched", "in_budget", "survived")})


def top_reasons(gated: DataFrame, limit: int = 8) -> DataFrame:
    """The commonest reasons over all platforms."""
    return gated.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(limit)


def trend_label(trend: Column) -> Column:
    return F.when(trend == "falling", "↓ falling").when(trend == "rising", "↑ rising").otherwise("→ stable")


def position_label(observations: Column, position: Column) -> Column:
    out = F.when(observations < 2, "—").when(position <= 0.05, "at its lowest").when(position <= 0.25, "near its lowest")
    return out.when(position >= 0.95, "at its peak").when(position >= 0.75, "above average").otherwise("mid-range")


def history_verdict(price: Column, stats: dict[str, Column]) -> Column:
    """What a price's history says of it, null before its second run."""
    told = F.when(price <= stats["low"], "all-time low").when(stats["position"] <= 0.15, "near the low").when(stats["position"] >= 0.85, "near its high")
    return F.when(stats["runs"] >= 2, told.when(stats["trend"].isin("falling", "rising"), stats["trend"]).otherwise("steady"))


def named_but_outscored(ranked: DataFrame, by: str = "query_id") -> DataFrame:
    """(by): queries that name a model, which is listed first although another one scores higher."""
    named, other = F.col("exact"), ~F.col("exact")
    tops = ranked.groupBy(by).agg(F.min_by(F.when(named, F.col("total")), F.when(named, F.col("rank"))).alias("first"), F.max(F.when(other, F.col("total"))).alias("best"))
    return tops.where(F.col("best") > F.col("first")).select(by)


def has_checkout(c: dict[str, Column]) -> Column:
    """Whether a product page's buy box told anything."""
    known = [c[k].isNotNull() for k in ("page_price", "seller", "buy_at", "bank_offer", "exchange_up_to", "in_stock")]
    return reduce(lambda a, b: a | b, known) | F.coalesce(c["no_cost_emi"], F.lit(False)) | F.coalesce(c["pincode_blocked"], F.lit(False))


def refreshable(url: Column) -> Column:
    """Whether a URL's shop is one whose prices are read again."""
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")).rlike(r"(^|\.)flipkart\.com$"), F.lit(False))


def price_changes(listings: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, url, from, to, moved, sold_out) of every listing whose page was read again, whatever its URL's other parameters.

    ``listings`` (id, url, price, in_stock), ``pages`` (url, page_price, page_stock).
    """
    own = listings.withColumn("_at", canonical_url(F.col("url")))
    read = pages.select(canonical_url(F.col("url")).alias("_at"), "page_price", "page_stock")
    moved = F.coalesce((F.col("price") > 0) & (F.abs(F.col("page_price") - F.col("price")) / F.col("price") > MOVED), F.lit(False))
    sold = F.coalesce((F.col("page_stock") == F.lit(False)) & ~F.coalesce(F.col("in_stock") == F.lit(False), F.lit(False)), F.lit(False))
    return own.join(read, "_at").select("id", "url", F.col("price").alias("from"), F.col("page_price").alias("to"), moved.alias("moved"), sold.alias("sold_out"))


def page_price(price: Column, paid: Column) -> Column:
    """The page's price where it is another one, else the card's."""
    return F.when(F.abs(paid - price) / price > MOVED, paid).otherwise(price)


def overridden(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key it lacks."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti"))


def same_product(card: Column, page: Column) -> Column:
    """Whether enough words of a card's title are in its page's: three, or all where it has fewer."""
    own = F.size(F.filter(F.split(F.lower(card), "[^a-z0-9]+"), lambda w: (F.length(w) > 2) & ~w.isin(*TITLE_STOP)))
    return token_overlap(card, page, TITLE_STOP) >= F.least(F.lit(3), own)


def card_check(card_title: Column, page_title: Column, card_price: Column, price: Column, card_mrp: Column, mrp: Column) -> Column:
    """How a card and its page differ: another product, another list price, the price alone, or not at all."""
    other = ~F.coalesce(same_product(card_title, page_title), F.lit(True))
    return F.when(other, "title mismatch").when(F.abs(card_mrp - mrp) > 1, "mrp mismatch").when(F.abs(price - card_price) / card_price > MOVED, "price only").otherwise("agrees")


def negative_share(stars: list[Column]) -> Column:
    """The share of one and two stars, of five counts."""
    return (stars[0] + stars[1]) / F.greatest(F.lit(1), reduce(lambda a, b: a + b, stars))


def decisive(aspects: DataFrame) -> DataFrame:
    """Adds praised and complained: two mentions or more, and twice as many as on the other side."""
    up, down = F.col("positive"), F.col("negative")
    return aspects.withColumn("praised", (up >= 2) & (up >= down * 2)).withColumn("complained", (down >= 2) & (down >= up * 2))


#: How many products at the top of a result have their prices read again.
REFRESHED = 15


def to_refresh(ranked: DataFrame, limit: int = REFRESHED) -> DataFrame:
    """The first rows of every result by rank."""
    return ranked.where(F.col("rank") <= limit)


def known_issues(diagnostics: DataFrame, platforms: DataFrame) -> DataFrame:
    """(platform, note): where a platform returned nothing of the class asked for and it is known why.

    ``platforms`` (platform, known_issue) is a table of a few rows.
    """
    silent = diagnostics.where(F.coalesce("category_matched", F.lit(0)) == 0).join(platforms.where(F.length("known_issue") > 0), "platform")
    return silent.select("platform", F.concat("platform", F.lit(" returned "), F.col("raw_cards").cast("string"), F.lit(" cards and no phones — "), "known_issue").alias("note"))


def listing_of_page(listings: Column, address: Column) -> Column:
    """Of a candidate's listings (with ``url``) the one whose address the page was read under, else the first."""
    wanted = canonical_url(address)
    return F.coalesce(F.get(F.filter(listings, lambda l: canonical_url(l["url"]) == wanted), F.lit(0)), F.get(listings, F.lit(0)))

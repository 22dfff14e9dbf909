"""Listings to candidates: offers, merged fields, blended ratings, majority category, folded configurations.

Every first, minimum and maximum has an explicit order, so results don't depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cut import written
from ..functions.maths import jround
from .globalrank import global_sum_before


def stock_rank(in_stock: Column) -> Column:
    """In stock before unknown before out of stock."""
    return F.when(in_stock, 0).when(in_stock.isNull(), 1).otherwise(2)


def best_offers(listings: DataFrame, keys: list[str]) -> DataFrame:
    """One row per candidate: its offers, distinct by platform and price, the best first."""
    rank = stock_rank(F.col("in_stock"))
    more = [c for c in ["url", "mrp", "discount_pct"] if c in listings.columns]
    kept = listings.where(F.col("price").isNotNull()).groupBy(*keys, "platform", "price").agg(F.min(F.struct(rank.alias("stock"), "ord", "in_stock", *more)).alias("o"))
    offers = kept.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("o.stock").alias("stock"), "price", F.col("o.ord").alias("ord"), "platform", *(F.col(f"o.{c}").alias(c) for c in ["in_stock", *more])))).alias("offers"))
    return offers.withColumn("best", F.get("offers", F.lit(0))).withColumn("spread", F.array_max(F.transform("offers", lambda o: o["price"])) - F.col("best.price"))


def merge_fields(listings: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Per field the first known value by completeness, then order, and the row it came from."""
    order = F.struct(-F.col("completeness"), F.col("ord"))
    aggs = []
    for f in fields:
        known = F.when(F.col(f).isNotNull(), order)
        aggs += [F.min_by(F.col(f), known).alias(f), F.min_by(F.col("ord"), known).alias(f"{f}_from")]
    return listings.groupBy(*keys).agg(*aggs, F.max("completeness").alias("completeness"))


def blend_rating(listings: DataFrame, keys: list[str]) -> DataFrame:
    """Of each platform the rating with most votes, then their mean by votes (plain without any)."""
    rated = listings.where(F.col("rating").isNotNull())
    each = rated.groupBy(*keys, "platform").agg(F.min_by("rating", F.struct(-F.coalesce("rating_count", F.lit(0)), "ord")).alias("rating"), F.max(F.coalesce("rating_count", F.lit(0))).alias("votes"))
    total = F.sum("votes")
    mean = F.when(total > 0, F.sum(F.col("rating") * F.col("votes")) / total).otherwise(F.avg("rating"))
    return each.groupBy(*keys).agg(jround(mean, 1).alias("rating"), F.when(total > 0, total).alias("rating_count"))


def majority(listings: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """The value with the largest sum of weights, the first seen on a tie."""
    sums = listings.groupBy(*keys, value).agg(F.sum(weight).alias("w"), F.min("ord").alias("first"))
    return sums.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("w"), F.col("first"))).alias(value), F.max("w").alias("weight"))


def siblings(candidates: DataFrame, model: str = "model", config: str = "config", price: str = "price") -> DataFrame:
    """Each candidate with the other configurations of its model and their lowest prices."""
    least = candidates.groupBy(model, config).agg(F.min(price).alias("low"))
    every = least.groupBy(model).agg(F.sort_array(F.collect_list(F.struct(F.col(config).alias("config"), "low"))).alias("all"))
    own = F.col(config)
    return least.join(every, model).select(model, config, F.filter("all", lambda x: x["config"] != own).alias("siblings"))


def fold_configs(candidates: DataFrame) -> DataFrame:
    """(model, config, target): configurations that are partly unknown go, in the order first seen, to a known one of their model.

    Of the known ones with the same storage, or else of all, it is the cheapest, the first seen of equals. What folds takes its
    price along, so that an earlier fold may change where later ones go. Where none of them has a price nothing folds. The fold goes
    over the distinct configurations of one model; listings are aggregated before.
    """
    none = F.lit(float("inf"))
    rows = candidates.groupBy("model", "config").agg(F.min("price").cast("double").alias("price"), F.min("ord").alias("ord"))
    one = F.struct("ord", "config", F.get(F.split("config", "-"), F.lit(1)).alias("storage"), F.coalesce("price", none).alias("price"))
    models = rows.groupBy("model").agg(F.sort_array(F.collect_list(one)).alias("all"))
    partial = F.filter("all", lambda c: c["config"].contains("?"))
    known = F.filter("all", lambda c: ~F.coalesce(c["config"].contains("?"), F.lit(False)))

    def folded(state: Column, c: Column) -> Column:
        alike = F.filter(state["known"], lambda k: k["storage"].eqNullSafe(c["storage"]))
        pool = F.when(F.size(alike) > 0, alike).otherwise(state["known"])
        priced = F.transform(F.filter(pool, lambda k: k["price"] < none), lambda k: F.struct(k["price"], k["ord"], k["config"]))
        target = F.array_min(priced)["config"]
        now = F.transform(state["known"], lambda k: k.withField("price", F.when(k["config"] == target, F.least(k["price"], c["price"])).otherwise(k["price"])))
        return F.struct(now.alias("known"), F.concat(state["targets"], F.array(F.struct(c["config"].alias("config"), F.coalesce(target, c["config"]).alias("target")))).alias("targets"))

    start = F.struct(F.col("known"), F.array().cast("array<struct<config:string,target:string>>").alias("targets"))
    done = models.select("model", known.alias("known"), partial.alias("partial")).select("model", "known", F.aggregate("partial", start, folded)["targets"].alias("targets"))
    every = F.concat(F.transform("known", lambda k: F.struct(k["config"].alias("config"), k["config"].alias("target"))), F.col("targets"))
    return done.select("model", F.explode(every).alias("t")).select("model", "t.config", "t.target")


def attach_first(candidates: DataFrame, listings: DataFrame, side: DataFrame, key: str, on: str, columns: list[str]) -> DataFrame:
    """Each candidate with the side row of its first listing, in order, that has one."""
    first = listings.join(side, on).groupBy(key).agg(F.min_by(F.struct(*columns), "ord").alias("side"))
    return candidates.join(first, key, "left").select(candidates["*"], *(F.col(f"side.{c}") for c in columns))


#: How far a page's price may be from the best card's before it leads.
TRUSTED_GAP = 0.02


def promoted(candidates: DataFrame, listings: DataFrame, checkouts: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates with what the page of their first listing, in order, that has one says of price and stock.

    A price over 2 % off the best offer's, read under another address, leads the offers; the page's stock otherwise
    goes to the best offer if both are of one platform or address. ``checkouts`` (id, page_price, page_mrp, in_stock).
    """
    pages = checkouts.select("id", "page_price", "page_mrp", F.col("in_stock").alias("page_stock"))
    seen = listings.select(*keys, "id", "url", "platform", "mrp", "ord").join(pages, "id")
    hit = seen.groupBy(*keys).agg(F.min_by(F.struct("url", "platform", "mrp", "ord", "page_price", "page_mrp", "page_stock"), "ord").alias("_hit"))
    out = candidates.join(hit, keys, "left")
    best, page = F.col("best"), F.col("_hit")
    price, stock = page["page_price"].cast("double"), page["page_stock"]
    here, near = best["url"] == page["url"], best["platform"] == page["platform"]
    leads = F.coalesce(price.isNotNull() & ~F.coalesce(here, F.lit(False)) & (F.abs(price - best["price"]) / best["price"] > TRUSTED_GAP), F.lit(False))
    told = ~leads & stock.isNotNull() & F.coalesce(near | (here & price.isNotNull()), F.lit(False))
    kinds = dict(candidates.select("best.*").dtypes)
    mrp = F.coalesce(page["page_mrp"].cast("double"), page["mrp"].cast("double"))
    off = F.when(mrp > price, jround((mrp - price) / mrp * 100).cast("int"))
    values = {"stock": stock_rank(stock), "price": price, "ord": page["ord"], "platform": page["platform"], "in_stock": stock, "url": page["url"], "mrp": mrp, "discount_pct": off}
    first = F.struct(*(values[c].cast(k).alias(c) for c, k in kinds.items()))
    offers = F.when(leads, F.concat(F.array(first), F.filter("offers", lambda o: ~o["url"].eqNullSafe(page["url"]))))
    offers = offers.when(told, F.concat(F.array(best.withField("in_stock", stock).withField("stock", stock_rank(stock))), F.slice("offers", 2, F.greatest(F.size("offers"), F.lit(1))))).otherwise(F.col("offers"))
    own = {c: F.col(c) if c in candidates.columns else F.lit(None) for c in ("mrp", "discount_pct")}
    out = out.withColumns({"offers": offers, "mrp": F.when(leads, mrp).otherwise(own["mrp"]), "discount_pct": F.when(leads, off).otherwise(own["discount_pct"])}).drop("_hit")
    best = F.get("offers", F.lit(0))
    return out.withColumns({"best": best, "price": best["price"], "in_stock": best["in_stock"], "n_offers": F.size("offers"), "spread": F.array_max(F.transform("offers", lambda o: o["price"])) - best["price"]})


def completeness(fields: list[str]) -> Column:
    """The share of ``fields`` that are known, to two digits."""
    return jround(sum((F.col(f).isNotNull().cast("double") for f in fields), F.lit(0.0)) / len(fields), 2)


def upper_median(column: str) -> Column:
    """The middle value of a group, the upper one of two, from counts of its distinct values."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {column} DESC)")


def topn_per(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "place") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)


def nearest_ratio(known: DataFrame, asked: DataFrame, n: int, parts: int | None = None) -> DataFrame:
    """(q, ratio): of the ``n`` known rows (k, x, r) nearest in x to each asked row (q, x), the upper median of r.

    A tie goes to the smaller k. An asked row that is known too counts among its own neighbours; one without x
    has no ratio; known rows without x or r are left out.

    Distinct known x are levels, numbered over ranges of their order, and of the rows of one level the first ``n`` can be among the
    nearest. An asked x lies between two levels: the ``n`` on either side, met by their numbers in an equi-join, hold its neighbours.
    """
    first = topn_per(known.where("x IS NOT NULL AND r IS NOT NULL"), ["x"], [F.col("k")], n).groupBy("x").agg(F.collect_list(F.struct("k", "r")).alias("own"))
    wanted = asked.where("x IS NOT NULL").select("x").distinct().withColumn("asked", F.lit(True))
    both = first.join(wanted, "x", "full").withColumn("_level", F.when(F.col("own").isNotNull(), 1).otherwise(0))
    line = written(global_sum_before(both, [], [F.col("x")], "_level", "_under", parts or int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "line")
    place = (F.col("_under") + F.col("_level")).cast("long")
    levels = line.where("_level = 1").select(place.alias("level"), F.col("x").alias("kx"), "own")
    near = line.where("asked").select("x", F.explode(F.sequence(place - (n - 1), place + n)).alias("level")).join(levels, "level")
    one = near.select("x", F.abs(F.col("x") - F.col("kx")).alias("d"), F.explode("own").alias("o"))
    # 2 n levels of n rows at most for each x.
    best = one.groupBy("x").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "o.k", "o.r"))), 1, n).alias("b"))
    middle = F.get(F.sort_array(F.transform("b", lambda b: b["r"])), F.floor(F.size("b") / 2).cast("int"))
    return asked.join(best.select("x", jround(middle, 3).alias("ratio")), "x", "left").select("q", "ratio")

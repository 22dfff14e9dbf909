"""What is said about a ranked product: pros, cons, verdict, and the head-to-head table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parse import rupees, short_count
from .globalrank import global_medians
from .knowledge import perf_tier
from .ranking import reasons

#: What a product is held against: the medians of its query's result.
MEDIANS = {"price": "med_price", "battery_mah": "med_battery", "antutu": "med_antutu", "ram_gb": "med_ram", "storage_gb": "med_storage"}
# How platforms are named.
PLATFORM_NAMES = {"flipkart": "Flipkart", "amazon": "Amazon", "reliance": "Reliance Digital", "tatacliq": "Tata CLiQ"}
#: How many of each are told.
PROS, CONS = 5, 4
KINDS = {
    "soc_name": "string", "antutu": "int", "panel": "string", "refresh_hz": "int", "resolution": "string", "battery_mah": "int", "charging_w": "int", "ram_gb": "int", "storage_gb": "int", "has5g": "boolean", "ois": "boolean", "ip_rating": "string", "rating": "double", "rating_count": "bigint", "in_stock": "boolean",
    "discount_pct": "int", "confidence": "double", "kb_confidence": "string", "model": "string", "n_offers": "int", "recorded_runs": "bigint", "recorded_low": "double", "recorded_high": "double", "recorded_position": "double", "recorded_trend": "string", "recorded_days": "bigint", "platform_name": "string",
    "performance": "double", "battery": "double", "display": "double", "camera": "double", "value": "double", "priorities": "array<string>",
}


def _yes(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def _say(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def _plain(number: Column) -> Column:
    """A number without a needless fraction."""
    return F.regexp_replace(number.cast("string"), r"\.0$", "")


def platform_name(platform: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in PLATFORM_NAMES.items() for x in kv)), platform), platform)


def annotated(rows: DataFrame, by: str = "query_id", parts: int | None = None) -> DataFrame:
    """Adds pros, cons and a verdict to ranked rows with component scores; what rows lack counts as unknown.

    Rules speak in a fixed order; those that matter most go to the front of what has been said: for pros a recorded low, for cons
    the condition of sale, then stock, then what nobody can vouch for. The first five pros and four cons are told.
    """
    medians = global_medians(rows.select(by, *(F.col(c).cast("double").alias(c) if c in rows.columns else F.lit(None).cast("double").alias(c) for c in MEDIANS)), [by], list(MEDIANS), parts)
    over = medians.select(F.col(by).alias("_by"), *(F.col(c).alias(f"_{m}") for c, m in MEDIANS.items()))
    have = {f"_c_{c}": F.col(c).cast(k) if c in rows.columns else F.lit(None).cast(k) for c, k in KINDS.items()}
    r = rows.withColumns(have)
    credible = F.coalesce(F.col("_c_confidence") >= 0.5, F.lit(False))
    # The fastest of the credible, if there are two: one row of each query, the first in rank of equals.
    speed = F.struct(-F.col("_c_performance"), "rank")
    fast = r.groupBy(by).agg(F.count_if(credible).alias("n"), F.min(F.when(credible & F.col("_c_performance").isNotNull(), speed)).alias("sure"), F.min(F.when(F.col("_c_performance").isNotNull(), speed)).alias("any"))
    fast = fast.select(F.col(by).alias("_fast_by"), F.when(F.col("n") >= 2, F.col("sure")).otherwise(F.col("any"))["rank"].alias("_fastest"))
    r = r.join(over, F.col(by) == F.col("_by"), "left").join(fast, F.col(by) == F.col("_fast_by"), "left")
    c = {k: F.col(f"_c_{k}") for k in KINDS} | {m: F.col(f"_{m}") for m in MEDIANS.values()} | {"price": F.col("price"), "rank": F.col("rank")}
    votes = F.coalesce(c["rating_count"], F.lit(0))
    tier = F.regexp_replace(perf_tier(c["antutu"]), "-", " ")
    quick = (c["med_antutu"] > 0) & (c["antutu"] > c["med_antutu"] * 1.15)
    oled = F.contains(F.lower(c["panel"]), F.lit("oled"))
    tracked = c["recorded_runs"] >= 2
    lowest = tracked & (c["price"] <= c["recorded_low"])
    mark = F.nullif(F.regexp_extract(c["model"], "#([a-z+-]+)$", 1), F.lit(""))
    # What is said, rule by rule.
    pros = [
        (lowest, F.when(c["recorded_days"] >= 1, _say("lowest price in ", c["recorded_days"].cast("string"), " day(s) of tracking")).otherwise("lowest price we have recorded so far")),
        (c["soc_name"].isNotNull() & quick, _say(c["soc_name"], " — faster than most here", F.coalesce(_say(" (", tier, ")"), F.lit("")))), (oled, _say(c["panel"], " panel")), (c["refresh_hz"] >= 120, _say(c["refresh_hz"].cast("string"), "Hz display")),
        ((c["med_battery"] > 0) & (c["battery_mah"] >= c["med_battery"] * 1.1), _say(c["battery_mah"].cast("string"), "mAh battery")), (c["charging_w"] >= 33, _say(c["charging_w"].cast("string"), "W charging")), ((c["med_ram"] > 0) & (c["ram_gb"] > c["med_ram"]), _say(c["ram_gb"].cast("string"), "GB RAM")),
        (c["ois"], "OIS on main camera"), (c["ip_rating"].isNotNull(), _say(c["ip_rating"], " rated")), (c["price"] < c["med_price"] * 0.85, _say(rupees(c["med_price"] - c["price"]), " below segment median")), (c["n_offers"] > 1, _say(c["n_offers"].cast("string"), " offers — cheapest on ", c["platform_name"])),
        ((c["rating"] >= 4.2) & (votes > 1000), _say(_plain(c["rating"]), "★ from ", short_count(votes), " buyers")),
    ]
    cons = [
        (mark.isNotNull(), F.when(mark == "carrier-locked", "carrier-locked SKU — cheaper but tied to one network").otherwise(_say(F.replace(mark, F.lit("+"), F.lit(" + ")), " unit, not a standard new device"))), (c["in_stock"] == F.lit(False), "out of stock in this colour/variant right now"),
        (c["soc_name"].isNull() & (votes < 20), "no chipset found and almost no buyers — nothing to verify"), (c["soc_name"].isNull(), "chipset unknown — performance not verified"), ((c["med_antutu"] > 0) & (c["antutu"] > 0) & ~_yes(quick) & c["soc_name"].isNotNull() & (c["antutu"] < c["med_antutu"] * 0.8), _say(c["soc_name"], " is slower than the segment median")),
        (c["panel"].isNotNull() & ~oled, _say(c["panel"], " panel (no OLED)")), ((c["refresh_hz"] > 0) & (c["refresh_hz"] <= 60), "60Hz display"), (c["resolution"] == "HD+", "HD+ resolution only"), ((c["charging_w"] > 0) & (c["charging_w"] <= 15), _say("slow ", c["charging_w"].cast("string"), "W charging")),
        ((c["med_storage"] > 0) & (c["storage_gb"] > 0) & (c["storage_gb"] < c["med_storage"]), _say("only ", c["storage_gb"].cast("string"), "GB storage")), (c["has5g"] == F.lit(False), "4G only"), (c["rating"] < 3.9, _say("weak ", _plain(c["rating"]), "★ rating")), (votes < 100, "very few reviews — unproven"),
        (tracked & ~_yes(lowest) & (c["recorded_position"] >= 0.85), _say("near its recorded high of ", rupees(c["recorded_high"]))), (tracked & (c["recorded_trend"] == "falling"), "price is still trending down — worth waiting"),
        (c["discount_pct"] > 55, _say(c["discount_pct"].cast("string"), '% "discount" — inflated MRP likely')), (c["confidence"] < 0.5, "limited spec data — verify before buying"), (c["kb_confidence"] == "low", "spec sheet partly unverified"),
    ]
    wishes = F.coalesce(c["priorities"], F.array().cast("array<string>"))
    bargain, price = F.array_contains(wishes, "value"), rupees(c["price"])
    head = F.when(c["rank"] == 1, _say("Best overall pick at ", price)).when(_yes(bargain & (c["value"] >= 80)), _say("Strong value at ", price)).when(_yes(bargain & (c["price"] < c["med_price"] * 0.85)), _say("Cheapest way into this segment at ", price)).otherwise(_say("Solid option at ", price))
    good = F.array_join(reasons([(c["performance"] >= 65, "performance"), (c["battery"] >= 75, "battery"), (c["display"] >= 75, "display"), (c["camera"] >= 75, "camera")]), " and ")
    weak = F.array_join(reasons([((c["performance"] < 40) & ~_yes(c["rank"] == F.col("_fastest")), "raw speed"), (c["display"] < 45, "screen quality"), (c["battery"] < 45, "battery")]), " and ")
    verdict = F.concat(F.concat_ws("; ", head, F.when(good != "", _say("leads on ", good)), F.when(weak != "", _say("compromises on ", weak)), F.when(_yes(F.array_contains(wishes, "performance") & (c["performance"] < 50)), "not ideal for gaming"), F.when(c["confidence"] < 0.5, "specs partly inferred")), F.lit("."))
    return r.withColumns({"pros": F.slice(reasons(pros), 1, PROS), "cons": F.slice(reasons(cons), 1, CONS), "verdict": verdict}).drop(*have, "_by", "_fast_by", "_fastest", *(f"_{m}" for m in MEDIANS.values()))


def shown(rows: DataFrame, limit: int, by: str = "query_id") -> DataFrame:
    """The first ``limit`` rows of each query that are no variant of an earlier one."""
    heads = rows.where(F.col("variant_of").isNull())
    return heads.withColumn("line", F.row_number().over(Window.partitionBy(by).orderBy("rank"))).where(F.col("line") <= limit)


def head_to_head(rows: DataFrame, metrics: list[str], top: int = 5, by: str = "query_id") -> DataFrame:
    """Metrics as rows and the first ``top`` products as columns p1, p2, ..."""
    some = shown(rows, top, by).select(by, "line", *(F.col(x).cast("string").alias(x) for x in metrics))
    return some.unpivot([by, "line"], metrics, "metric", "x").groupBy(by, "metric").pivot("line", list(range(1, top + 1))).agg(F.first("x")).toDF(by, "metric", *(f"p{i}" for i in range(1, top + 1)))

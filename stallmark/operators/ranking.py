"""Gates, set-relative scores, ranking and notes. Everything is keyed by query_id: one job ranks for many queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import maths as m
from ..functions import parse
from .globalrank import global_medians, global_percent_rank, global_row_number

# Weights of the components of the specification score.
WEIGHTS = {"performance": 0.30, "memory": 0.15, "display": 0.18, "battery": 0.17, "camera": 0.12, "extras": 0.08}
# The components that a priority can lift, and what it adds before weights are made to sum to one.
LIFTED, FOCUS = ("performance", "camera", "battery", "display"), 0.15
# Classes that satisfy a wish for another.
ALIKE = {"earbuds": "headphone", "headphone": "earbuds"}
CLASSES = ["earbuds", "headphone", "featurephone", "phone", "smartwatch", "laptop", "tablet", "tv", "camera", "unknown"]


def reasons(rules: list[tuple[Column, Column | str]]) -> Column:
    """All reasons that hold; unknown never rejects."""
    return F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(why) if isinstance(why, str) else why) for test, why in rules)))


def category_matches(wanted: Column, actual: Column) -> Column:
    """Whether a class satisfies the one wanted: itself, one like it, or, where none is wanted, any but an accessory."""
    other = reduce(lambda acc, kv: acc.when(wanted == kv[0], kv[1]), list(ALIKE.items())[1:], F.when(wanted == list(ALIKE)[0], list(ALIKE.values())[0]))
    return F.when(F.coalesce(wanted, F.lit("unknown")) == "unknown", actual != "accessory").otherwise((actual == wanted) | F.coalesce(actual == other, F.lit(False)))


def accepted_classes(wanted: Column) -> Column:
    """The classes that ``category_matches`` lets pass, as an array: keys for an equi-join."""
    every = F.array(*map(F.lit, CLASSES + ["accessory"]))
    return F.filter(every, lambda c: category_matches(wanted, c))


def gate_rules(tolerance: float = 0.0, in_stock_only: bool = False) -> list[tuple[Column, Column | str]]:
    """Gates over candidate columns and intent columns (budget_min, budget_max, brands, exclude_brands, must_have).

    ``in_stock_only``: a candidate of whose ``offers`` every one is known to be sold out goes as well.
    """
    price, must = F.col("price"), F.coalesce("must_have", F.array().cast("array<string>"))
    rules: list[tuple[Column, Column | str]] = [
        (~category_matches(F.col("category_wanted"), F.coalesce("category", F.lit("unknown"))), "category"),
        (F.col("category") == "accessory", "accessory"),
        (price.isNull() | (price <= 0), "no price"),
        (price > F.col("budget_max") * (1 + tolerance), "over budget"),
        (price < F.col("budget_min"), "below budget"),
        ((F.size("brands") > 0) & ~F.array_contains("brands", F.col("brand")), "brand not requested"),
        (F.array_contains("exclude_brands", F.col("brand")), "brand excluded"),
        (F.array_contains(must, "amoled") & ~F.lower("panel").contains("oled"), "not amoled"),
    ]
    if in_stock_only:
        rules.append((F.forall("offers", lambda o: F.coalesce(o["in_stock"] == F.lit(False), F.lit(False))), "out of stock everywhere"))
    return rules + [(F.array_contains(must, k) & (F.col(c) == F.lit(False)), f"no {k}") for k, c in (("5g", "has5g"), ("nfc", "nfc"), ("ois", "ois"))]


def gated(candidates: DataFrame, intents: DataFrame, tolerance: float = 0.0, in_stock_only: bool = False) -> DataFrame:
    """Candidates of every query with the reasons against them; survivors have none.

    A reason for each candidate and query is what is asked here, so every pair is a row of the result; ``survivors`` is the way to a ranking.
    """
    both = candidates.join(intents, F.lit(True))
    return both.withColumn("reasons", reasons(gate_rules(tolerance, in_stock_only)))


def survivors(candidates: DataFrame, intents: DataFrame, tolerance: float = 0.0, in_stock_only: bool = False) -> DataFrame:
    """The rows of ``gated`` without a reason: candidates meet the queries that accept their class in an equi-join."""
    keyed = intents.withColumn("_class", F.explode(accepted_classes(F.col("category_wanted"))))
    both = candidates.withColumn("_class", F.coalesce("category", F.lit("unknown"))).join(keyed, "_class").drop("_class")
    return both.withColumn("reasons", reasons(gate_rules(tolerance, in_stock_only))).where(F.size("reasons") == 0)


def model_matches(hint: Column, brands: Column, name: Column) -> Column:
    """Whether a name is of the model asked for: a hint of two characters or more, a digit among them; a short one needs its brand too."""
    wanted, have = parse.model_token(hint), parse.model_token(name)
    branded = F.exists(brands, lambda b: F.contains(have, parse.model_token(b)))
    short = (F.length(wanted) <= 3) & (F.size(brands) > 0)
    return F.coalesce((F.length(wanted) >= 2) & wanted.rlike("[0-9]") & F.contains(have, wanted) & (~short | branded), F.lit(False))


def weights(priorities: Column | None = None) -> dict[str, Column]:
    """Component weights, more for those that the query asks for, summing to one.

    Lifts are added up in whole hundredths: each weight is a quotient of two exact decimals, so that products whose
    scores are equal tie wherever decimals are written out.
    """
    if priorities is None:
        return {k: F.lit(w) for k, w in WEIGHTS.items()}
    whole = {k: F.lit(round(w * 100)) + F.when(F.array_contains(priorities, k), round(FOCUS * 100)).otherwise(0) if k in LIFTED else F.lit(round(w * 100)) for k, w in WEIGHTS.items()}
    total = reduce(lambda a, b: a + b, whole.values())
    return {k: (v / 100) / (total / 100) for k, v in whole.items()}


def imputed(scored: DataFrame, components: list[str], by: str = "query_id") -> DataFrame:
    """Adds <component>_peer: 0.9 of the median of those that have it, of 50 where none has."""
    over = global_medians(scored, [by], components).select(F.col(by).alias("_by"), *(F.col(c).alias(f"{c}_peer") for c in components))
    out = scored.join(over, F.col(by) == F.col("_by"), "left").drop("_by")
    return out.withColumns({f"{c}_peer": F.coalesce(f"{c}_peer", F.lit(50.0)) * 0.9 for c in components})


def totals(scored: DataFrame, priorities: Column | None = None) -> DataFrame:
    """Adds spec_total and imputed_weight from component columns and their peers."""
    w = weights(priorities)
    total = reduce(lambda a, b: a + b, (w[c] * F.coalesce(c, f"{c}_peer") for c in WEIGHTS))
    missing = reduce(lambda a, b: a + b, (F.when(F.col(c).isNull(), w[c]).otherwise(0.0) for c in WEIGHTS))
    return scored.withColumn("spec_total", m.clamp(total)).withColumn("imputed_weight", missing)


def confidence(missing: Column, completeness: Column, rated: Column, known: Column) -> Column:
    kb = F.when(known == "high", 10.0).when(known == "medium", 6.0).when(known == "low", 3.0).otherwise(0.0)
    return m.jround(m.clamp((1 - missing) * 60 + completeness * 20 + F.when(rated, 10.0).otherwise(0.0) + kb) / 100, 2)


def overall(value: Column, spec: Column, trust: Column, deal: Column, confidence: Column, bargain: Column) -> Column:
    trusted = F.coalesce(trust, F.lit(45.0))
    base = F.when(bargain, 0.35 * value + 0.30 * spec + 0.20 * trusted + 0.15 * deal).otherwise(0.60 * spec + 0.25 * trusted + 0.15 * deal)
    return m.jround(m.clamp(base * (0.7 + 0.3 * confidence)), 1)


def _parts(df: DataFrame, parts: int | None) -> int:
    return parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_percentile(df: DataFrame, value: Column, name: str, by: str = "query_id", parts: int | None = None) -> DataFrame:
    """Adds the share strictly below, in per cent, 50 where there is one row only; over ``parts`` ranges, the session's shuffle partitions if null."""
    return global_percent_rank(df, [by], value, name, _parts(df, parts)).withColumn(name, F.coalesce(F.col(name) * 100, F.lit(50.0)))


def ranked(scored: DataFrame, order: list[Column], model: str = "model", name: str = "name", by: str = "query_id", parts: int | None = None) -> DataFrame:
    """Adds rank, and variant_of: the name of the first row of the same model, null for that row.

    Ranks come from ``parts`` ranges of the whole order, so a query's survivors never meet in one task.
    """
    out = global_row_number(scored, [by], order, "rank", _parts(scored, parts)).withColumn("rank", F.col("rank").cast("int"))
    first = F.first(name).over(Window.partitionBy(by, model).orderBy("rank"))
    return out.withColumn("_first", F.min("rank").over(Window.partitionBy(by, model))).withColumn("variant_of", F.when(F.col("rank") != F.col("_first"), first)).drop("_first")


def badges(rows: DataFrame, by: str = "query_id") -> DataFrame:
    """Adds badges: extremes of each query's result, the first in rank on a tie; columns that rows lack count as unknown.

    Extremes are taken among credible rows, if there are two, and the best value among those that can be vouched
    for, if there are two; speed and battery need a clear win.
    """
    kinds = {"value": "double", "trust": "double", "performance": "double", "battery": "double", "antutu": "int", "battery_mah": "int", "soc_name": "string", "confidence": "double", "exact": "boolean", "recorded_low": "double", "recorded_runs": "int"}
    rows = rows.withColumns({f"_{c}": F.col(c) if c in rows.columns else F.lit(None).cast(k) for c, k in kinds.items()})
    sold_out = F.coalesce(F.col("in_stock") == F.lit(False), F.lit(False))
    votes = F.coalesce("rating_count", F.lit(0))
    credible = F.coalesce(F.col("_confidence") >= 0.5, F.lit(False))
    sure = ~sold_out & F.coalesce(F.col("_confidence") >= 0.6, F.lit(False)) & F.col("_soc_name").isNotNull() & (votes >= 100) & F.coalesce(F.col("rating") >= 3.5, F.lit(False))
    many = rows.groupBy(by).agg((F.count_if(credible) >= 2).alias("_split"), F.coalesce(F.max("_exact"), F.lit(False)).alias("_asked"))
    rows = rows.join(many, by).withColumn("_pool", ~F.col("_split") | credible).withColumn("_sure", sure)
    rows = rows.join(rows.groupBy(by).agg((F.count_if(F.col("_pool") & F.col("_sure")) >= 2).alias("_choice")), by)
    rows = rows.withColumn("_advised", F.col("_pool") & (~F.col("_choice") | F.col("_sure")))

    def best(metric: str, among: Column, largest: bool = True) -> Column:
        return F.min_by("rank", F.when(among & F.col(metric).isNotNull(), F.struct((-F.col(metric) if largest else F.col(metric)).alias("m"), F.col("rank"))))

    pool = F.col("_pool")
    found = rows.groupBy(by).agg(
        best("_value", F.col("_advised")).alias("_best_value"), best("price", F.lit(True), False).alias("_cheapest"), best("_performance", pool).alias("_fastest"), best("_battery", pool).alias("_lasting"),
        best("_trust", pool & (votes > 500)).alias("_rated"), F.max(F.when(pool, F.col("_performance"))).alias("_top_speed"), F.max(F.when(pool, F.col("_battery"))).alias("_top_battery"),
    )
    rows = rows.join(found, by)
    close = rows.groupBy(by).agg(F.count_if(pool & (F.col("_performance") >= F.col("_top_speed") - 0.5)).alias("_near_speed"), F.count_if(pool & (F.col("_battery") >= F.col("_top_battery") - 0.5)).alias("_near_battery"))
    rows = rows.join(close, by)
    place = F.col("rank")
    marks = [
        (place == 1, "TOP PICK"), (sold_out, "OUT OF STOCK"), (F.col("_asked") & ~F.coalesce("_exact", F.lit(False)), "ALTERNATIVE"), ((place == F.col("_best_value")) & F.col("_sure"), "BEST VALUE"), (place == F.col("_cheapest"), "CHEAPEST"),
        ((place == F.col("_fastest")) & (F.col("_near_speed") == 1) & (F.col("_antutu") > 0) & F.col("_sure"), "FASTEST"), ((place == F.col("_lasting")) & (F.col("_near_battery") == 1) & (F.col("_battery_mah") > 0), "BATTERY KING"),
        (place == F.col("_rated"), "BEST RATED"), ((F.col("_recorded_runs") >= 2) & (F.col("price") <= F.col("_recorded_low")), "LOWEST YET"),
    ]
    out = rows.withColumn("badges", reasons([(t, F.lit(n)) for t, n in marks]))
    return out.drop(*(c for c in out.columns if c.startswith("_")))

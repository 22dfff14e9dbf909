"""Plain-language queries to intents, as columns over a table of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cut import dealt
from ..functions.maths import jround
from ..functions.parse import BRANDS, found, matches

# Words that name a category, a priority or a must-have.
CATEGORIES = [
    (r"\b(phones?|smartphones?|mobiles?|handsets?)\b", "phone"), (r"\b(earbuds?|tws|airdopes|neckbands?)\b", "earbuds"), (r"\b(headphones?|headsets?|over[-\s]?ear|on[-\s]?ear)\b", "headphone"),
    (r"\b(laptops?|notebooks?|macbooks?)\b", "laptop"), (r"\b(tablets?|ipads?)\b", "tablet"), (r"\b(smart\s*watch(es)?|fitness\s*bands?)\b", "smartwatch"), (r"\b(tvs?|televisions?)\b", "tv"), (r"\b(cameras?|dslrs?)\b", "camera"),
]
PRIORITIES = [
    (r"\b(gaming|game|pubg|bgmi|fps|performance|processor|fast)\b", "performance"), (r"\b(camera|photo|photography|selfie|video|vlog)\b", "camera"), (r"\b(battery|backup|long\s*lasting|charging|charge)\b", "battery"),
    (r"\b(display|screen|amoled|refresh|120\s*hz)\b", "display"), (r"\b(compact|light|lightweight|small)\b", "compact"), (r"\b(value|budget|cheap|affordable|vfm|worth)\b", "value"), (r"\b(premium|flagship|best\s*in\s*class)\b", "premium"),
]
MUST_HAVES = [(r"\b5g\b", "5g"), (r"\bamoled\b", "amoled"), (r"\bnfc\b", "nfc"), (r"\bstereo\b", "stereo"), (r"\b(ois|eis|optical\s+stabiliz\w*|stabili[sz]ed)\b", "ois")]
GENERIC = ["5g", "4g", "pro", "plus", "max", "ultra", "lite", "mini", "neo", "prime", "power", "gb", "tb"]
_AMOUNT = r"((?:₹\s*)?\d[\d,.]*\s*(?:lakh|lac|k|l|cr)?)"
_BUDGETS = {"under": r"(?:under|below|less\s*than|within|upto|up\s*to|max)\s*", "around": r"(?:around|about|near|approx\.?|~)\s*", "over": r"(?:over|above|more\s*than|at\s*least)\s*"}


def amount(c: Column) -> Column:
    """12k, 1.5 lakh, ₹15,000: whole rupees over zero."""
    text = F.regexp_replace(F.lower(c), r"[₹,\s]", "")
    unit = F.regexp_extract(text, r"^[\d.]+(k|lakh|lac|l|cr)?$", 1)
    factor = F.when(unit == "k", 1e3).when(unit.isin("l", "lakh", "lac"), 1e5).when(unit == "cr", 1e7).otherwise(1.0)
    n = jround(found(text, r"^(\d+\.?\d*|\.\d+)(?:k|lakh|lac|l|cr)?$").try_cast("double") * factor).cast("long")
    return F.when(n > 0, n)


def _labels(c: Column, rules: list[tuple[str, str]]) -> Column:
    return F.array_distinct(F.array_compact(F.array(*(F.when(matches(c, p), F.lit(label)) for p, label in rules))))


def intents(queries: DataFrame, id_col: str = "query_id", text_col: str = "query") -> DataFrame:
    """(query_id, raw, category_wanted, budget_min, budget_max, budget_operator, brands, exclude_brands, priorities, must_have, model_hint)."""
    low = F.lower(F.trim(text_col))
    pair = r"(?:between|from)\s*" + _AMOUNT + r"\s*(?:and|to|-)\s*" + _AMOUNT
    parts = {k: found(low, p + _AMOUNT) for k, p in _BUDGETS.items()}
    middle = amount(parts["around"])
    bare = amount(found(low, r"(?:^|\s)" + _AMOUNT + r"\s*$"))
    ladder = [(found(low, pair).isNotNull(), "between", amount(found(low, pair, 1)), amount(found(low, pair, 2))), (parts["under"].isNotNull(), "under", None, amount(parts["under"]))]
    ladder += [(parts["around"].isNotNull() & middle.isNotNull(), "around", jround(middle * 0.85).cast("long"), jround(middle * 1.15).cast("long")), (parts["over"].isNotNull(), "over", amount(parts["over"]), None), (bare >= 500, "under", None, bare)]
    operator, least, most = F.lit("none"), F.lit(None).cast("long"), F.lit(None).cast("long")
    for test, name, lo, hi in reversed(ladder):
        test = F.coalesce(test, F.lit(False))
        operator = F.when(test, name).otherwise(operator)
        least = F.when(test, lo if lo is not None else F.lit(None).cast("long")).otherwise(least)
        most = F.when(test, hi if hi is not None else F.lit(None).cast("long")).otherwise(most)
    unwanted = [(rf"\b(no|not|except|excluding|other\s+than)\s+\w*\s*{name.replace('+', chr(92) + '+')}", name) for name in dict.fromkeys(n for _, n in BRANDS)]
    tokens = F.transform(F.split(low, r"\s+"), lambda t: F.regexp_replace(t, "[^a-z0-9-]", ""))
    coded = F.get(F.filter(tokens, lambda t: t.rlike("[a-z]") & t.rlike(r"\d") & ~t.isin(GENERIC)), F.lit(0))
    worded = found(low, r"\b([a-z]{3,}\s+\d{1,4})\b")
    hint = F.coalesce(coded, F.when(~worded.rlike(r"^(under|below|above|over|around|about|within|upto|max|min)\b"), worded))
    out = dealt(queries.select(id_col, text_col)).select(F.col(id_col).alias("query_id"), F.trim(text_col).alias("raw"), F.coalesce(*(F.when(matches(low, p), F.lit(c)) for p, c in CATEGORIES), F.lit("unknown")).alias("category_wanted"), least.alias("budget_min"), most.alias("budget_max"), operator.alias("budget_operator"), _labels(low, BRANDS).alias("named"), _labels(low, unwanted).alias("exclude_brands"), _labels(low, PRIORITIES).alias("priorities"), _labels(low, MUST_HAVES).alias("must_have"), hint.alias("hint"))
    out = out.withColumn("exclude_brands", F.array_intersect("named", "exclude_brands")).withColumn("brands", F.array_except("named", "exclude_brands"))
    return out.withColumn("model_hint", F.when(~(F.col("budget_max").isNotNull() & amount(F.col("hint")).isNotNull()), F.col("hint"))).drop("named", "hint")

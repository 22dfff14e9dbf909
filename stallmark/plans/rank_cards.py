"""From raw cards to a ranking for many queries in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import maths as m
from ..functions import parse
from ..functions.cut import dealt, written
from ..operators import grouping, history, knowledge, notes, pages, ranking, report, reviews, specs, text
from ..operators.globalrank import global_medians
from ..sources import runs

# Patterns of each category (strong, weak, veto), in order of precedence.
CATEGORIES = [
    (
        "earbuds",
        [r"\b(tws|true\s*wireless|earbuds?|ear\s*buds?|airdopes|airpods|neckband)\b", r"\bin[-\s]?ear\s+(?:wireless\s+)?(?:head|ear)phones?\b", r"\bbullets\s+z\d"],
        [r"\bipx\d\b", r"playtime", r"\bearphones?\b"],
        [r"\b(case|cover|pouch|ear\s*pads?|ear\s*cushions?|ear\s*tips?|hinge|protector|stand|holder|replacement|spare)\b", r"\bcompatible\s+with\b", r"\bfor\s+(?:sony|bose|jbl|sennheiser|marshall|boat|noise|apple|samsung)\b"],
    ),
    (
        "headphone",
        [r"\b(over[-\s]?ear|on[-\s]?ear)\b", r"\bheadphones?\b", r"\bheadset\b", r"\bwh-\d{4}|\bqc\d{2}\b|quietcomfort"],
        [r"\banc\b|noise\s*cancell", r"\bdriver\b"],
        [r"\bearbuds?\b|\btws\b", r"\b(case|cover|pouch|ear\s*pads?|ear\s*cushions?|hinge|protector|stand|holder|replacement|spare)\b", r"\bcompatible\s+with\b", r"\bfor\s+(?:sony|bose|jbl|sennheiser|marshall|boat|noise|apple|samsung)\b"],
    ),
    (
        "featurephone",
        [r"\bkeypad\b", r"\bfeature\s*phone\b", r"\b(basic|senior\s*citizen)\s*phone\b"],
        [r"\bmp3\s*player\b", r"\bwireless\s*fm\b", r"\btorch\b", r"\b[12]\.\d\s*inch\b"],
        [r"\b\d+\s*gb\s*ram\b", r"\bandroid\b"],
    ),
    (
        "phone",
        [r"\b(smartphone|mobile\s*phone)\b", r"\(\s*[\w\s]+,\s*\d+\s*(?:gb|tb)\s*\)", r"\biphone\s*\d", r"\bgalaxy\s+[amszf]\d"],
        [r"\b\d+\s*gb\s*ram\b", r"\b5g\b", r"\bdual\s*sim\b", r"\b(poco|redmi|realme|narzo|iqoo|vivo|oppo|infinix|tecno|lava|motorola|moto|nothing\s*phone)\b"],
        [r"\bkeypad\b|\bfeature\s*phone\b", r"\b(case|cover|tempered|screen\s*guard|protector|charger|cable|adapter|holder|mount|stand|pouch|skin|sticker|lens\s*protector|back\s*cover|flip\s*cover)\b", r"\b(earphones?|earbuds?|headphones?|headset|neckband|tws|speaker|smart\s*watch|smartwatch|power\s*bank|powerbank|tablet|laptop)\b", r"\bcompatible\s+with\b"],
    ),
    (
        "smartwatch",
        [r"\bsmart\s*watch\b|\bsmartwatch\b|\bfitness\s*band\b"],
        [r"\bamoled\s+display\b.*\bwatch\b", r"\bbluetooth\s+calling\b"],
        [],
    ),
    (
        "laptop",
        [r"\blaptop\b|\bnotebook\b|\bmacbook\b|\bchromebook\b"],
        [r"\b(i[3579]|ryzen|celeron)\b", r"\bwindows\s*11\b"],
        [],
    ),
    (
        "tablet",
        [r"\btablet\b|\bipad\b|\btab\s+[a-z]?\d"],
        [],
        [r"\bcase\b|\bcover\b|\bkeyboard\b"],
    ),
    (
        "tv",
        [r"\b(smart\s*)?(led|qled|oled)\s*tv\b", r"\btelevision\b", r"\b\d{2}\s*inch\b.*\btv\b"],
        [],
        [],
    ),
    (
        "camera",
        [r"\bdslr\b|\bmirrorless\b|\baction\s*camera\b|\bgopro\b"],
        [],
        [r"\bcamera\s*(lens\s*)?(protector|cover)\b"],
    ),
    (
        "accessory",
        [r"\b(back\s*cover|flip\s*cover|tempered\s*glass|screen\s*(guard|protector)|charging\s*cable|usb\s*cable|charger|adapter|power\s*bank|powerbank|car\s*mount|mobile\s*holder|selfie\s*stick|stylus|memory\s*card|sim\s*ejector)\b", r"\b(carrying\s*case|hard\s*case|silicone\s*case|travel\s*case|headphone\s*case|headphones\s*case)\b", r"\b(ear\s*pads?|ear\s*cushions?|earpads?|ear\s*tips?|eartips?|headband\s*(cover|pad)|ear\s*cups?\s*protector)\b", r"\b(hinge|replacement\s*part|spare\s*part|repair\s*kit)\b", r"\bcompatible\s+with\b", r"\bfor\s+(?:apple|samsung|oneplus|xiaomi|redmi|poco|realme|vivo|oppo|iqoo|sony|bose|jbl|sennheiser|marshall|boat|noise)\b"],
        [],
        [],
    ),
]
KEYS = ["model", "config"]


#: Sources of a specification, the most trusted first: an outside page, a model entry that is sure, the product's page, other model entries, the title.
SOURCES = ["external", "trusted", "page", "known", "title"]


def _page_text(out: DataFrame, page_text: DataFrame, chips: DataFrame | None) -> DataFrame:
    """Adds page_<field> from the texts of product pages (id, text) and page_ambiguous: the page's chip may be another product's."""
    out = written(out.join(page_text.select("id", F.col("text").alias("page_text")), "id", "left"), "pages")
    out = written(specs.with_specs(out, F.col("page_text"), "page"), "page_specs")
    if chips is None:
        return out
    told = knowledge.match_chips(out, chips, "id", "page_text").select("id", F.col("soc_name").alias("page_soc_name"), F.col("antutu").alias("_antutu"), F.when(F.col("has5g"), True).alias("_has5g"), F.col("ambiguous").alias("page_ambiguous"))
    out = out.join(told, "id", "left")
    return out.withColumns({"page_antutu": F.coalesce("page_antutu", "_antutu"), "page_has5g": F.coalesce("page_has5g", "_has5g")}).drop("_antutu", "_has5g")


def _outside(out: DataFrame, outside: DataFrame, chips: DataFrame | None) -> DataFrame:
    """Adds external_<field> of ``outside`` (id, external_<field>...); a chip that the dictionary knows takes its name and benchmark from there."""
    fields = [f"external_{f}" for f in specs.FIELDS if f"external_{f}" in outside.columns]
    rows = outside.select("id", *fields)
    if "external_ois" in fields:
        rows = rows.withColumn("external_ois", F.when(F.col("external_ois"), True))
    if chips is not None and "external_soc_name" in fields:
        exact = knowledge.exact_chips(rows, chips, "id", "external_soc_name").select("id", F.struct("soc_name", "antutu").alias("_exact"))
        loose = knowledge.match_chips(rows, chips, "id", "external_soc_name").select("id", F.struct("soc_name", "antutu").alias("_loose"))
        rows = rows.join(exact, "id", "left").join(loose, "id", "left").withColumn("_chip", F.coalesce("_exact", "_loose"))
        own = F.col("external_antutu") if "external_antutu" in fields else F.lit(None).cast("int")
        rows = rows.withColumns({"external_soc_name": F.coalesce("_chip.soc_name", "external_soc_name"), "external_antutu": F.when(F.col("external_soc_name").isNotNull(), F.coalesce("_chip.antutu", own))}).drop("_exact", "_loose", "_chip")
    return out.join(rows, "id", "left")


def _models(out: DataFrame, models: DataFrame, chips: DataFrame | None) -> DataFrame:
    """Adds trusted_<field>, known_<field>, kb_name and kb_confidence from ``models`` (ord, model, keys, confidence, fields...), met by title, else by address."""
    fields = [f for f in specs.FIELDS if f in models.columns]
    table = models
    if chips is not None and "soc_name" in fields:
        table = table.join(knowledge.match_chips(models, chips, "ord", "soc_name").select(F.col("id").alias("ord"), F.col("antutu").alias("_antutu"), F.when(F.col("has5g"), True).alias("_has5g")), "ord", "left")
    else:
        table = table.withColumns({"_antutu": F.lit(None).cast("int"), "_has5g": F.lit(None).cast("boolean")})
    sure = F.col("confidence") == "high"
    table = table.select(F.col("model").alias("kb_name"), F.col("confidence").alias("kb_confidence"), *(F.when(sure, F.col(f)).alias(f"trusted_{f}") for f in fields), *(F.when(~sure, F.col(f)).alias(f"known_{f}") for f in fields if f not in ("antutu", "has5g")), F.col("_antutu").alias("known_antutu"), F.col("_has5g").alias("known_has5g"))
    met = knowledge.lookup_models(out, models, "id", "title", "_slug").select("id", F.col("model").alias("kb_name"))
    return out.join(met, "id", "left").join(table, "kb_name", "left")


def analysed(listings: DataFrame, chips: DataFrame | None = None, page_text: DataFrame | None = None, outside: DataFrame | None = None, models: DataFrame | None = None) -> DataFrame:
    """Listings with category, brand, model and configuration keys and specifications from every source, merged field by field.

    ``chips`` (ord, soc_name, antutu, has5g, aliases) and ``models`` are dimensions, ``page_text`` (id, text) and
    ``outside`` (id, external_<field>...) one row for each listing that has them. ``spec_sources`` tells who spoke.
    """
    title = F.col("title")
    slug = F.regexp_replace(F.coalesce("url", F.lit("")), "[-/_]", " ")
    out = listings.drop("raw").withColumn("title", parse.spaced(title)).withColumn("_slug", slug)
    out = written(dealt(out), "listings")
    said = F.concat_ws(" ", title, F.regexp_replace(F.coalesce("url", F.lit("")), "[-/]", " "))
    out = text.classified(out, said, CATEGORIES, text.product_head(title), {"accessory"})
    if page_text is not None:
        out = _page_text(out, page_text, chips)
    else:
        out = out.withColumn("page_text", F.lit(None).cast("string"))
    # Written, so that the patterns read a column and no copy of the expression that makes it.
    out = written(out.withColumn("_full", F.concat_ws(" ", title, "page_text", "_slug")), "texts")
    out = written(specs.with_specs(out, F.col("_full"), "title"), "specs")
    if chips is not None:
        told = knowledge.match_chips(out, chips, "id", "_full").select("id", F.col("soc_name").alias("title_soc_name"), F.col("antutu").alias("_antutu"), F.when(F.col("has5g"), True).alias("_has5g"))
        out = out.join(told, "id", "left").withColumns({"title_antutu": F.coalesce("title_antutu", "_antutu"), "title_has5g": F.coalesce("title_has5g", "_has5g")}).drop("_antutu", "_has5g")
    if outside is not None:
        out = _outside(out, outside, chips)
    if models is not None:
        out = _models(out, models, chips)
        if {"page_ambiguous", "trusted_soc_name"} <= set(out.columns):
            other = F.coalesce(F.col("page_ambiguous") & (F.col("page_soc_name") != F.col("trusted_soc_name")), F.lit(False))
            out = out.withColumns({c: F.when(~other, F.col(c)) for c in ("page_soc_name", "page_antutu")})
    else:
        out = out.withColumns({"kb_name": F.lit(None).cast("string"), "kb_confidence": F.lit(None).cast("string")})
    out = specs.merged(out, SOURCES).drop("page_ambiguous", "page_text", "_full")
    out = out.withColumns({"kb_confidence": F.coalesce("kb_confidence", F.lit("none")), "spec_sources": F.transform_values("spec_sources", lambda _, s: F.when(s.isin("trusted", "known"), "kb").otherwise(s))})
    for c in specs.COUNTED:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("int"))
    out = out.withColumn("has5g", F.coalesce("has5g", F.when(parse.matches(title, r"\b4g\b"), False)))
    marks = F.array_join(parse.qualifiers(title), "+")
    model = F.concat(specs.model_key(title), F.when(marks != "", F.concat(F.lit(" #"), marks)).otherwise(""))
    config = F.concat(F.coalesce(F.col("ram_gb").cast("string"), F.lit("?")), F.lit("r-"), F.coalesce(F.col("storage_gb").cast("string"), F.lit("?")), F.lit("s"))
    out = out.withColumns({"brand": parse.brand(F.concat_ws(" ", title, "_slug")), "model": F.coalesce(F.nullif(model, F.lit("")), F.lower("title")), "config": config, "completeness": grouping.completeness(specs.COUNTED)})
    return written(out.drop("_slug"), "analysed")


def fold_targets(rows: DataFrame) -> DataFrame:
    """Listings under the configuration that theirs folds into."""
    return rows.join(grouping.fold_configs(rows), KEYS).withColumn("config", F.col("target")).drop("target")


def candidates(rows: DataFrame) -> DataFrame:
    """One row per model and configuration, partly unknown configurations folded, that has a priced offer.

    List price and discount are the best offer's; brand and image the first listing's, in order, that has one; the name is the
    knowledge base's, else the first title's, with its configuration and condition of sale.
    """
    folded = fold_targets(rows)
    fields = [c for c in specs.FIELDS if c in rows.columns]
    out = grouping.best_offers(folded, KEYS).join(grouping.merge_fields(folded, KEYS, fields), KEYS)
    out = out.join(grouping.blend_rating(folded, KEYS), KEYS, "left").join(grouping.majority(folded, KEYS, "category", "category_confidence").drop("weight"), KEYS)
    known = F.when(F.col("kb_confidence") != "none", F.col("ord"))
    first = {c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c) for c in ("brand", "image_url") if c in rows.columns}
    name = folded.groupBy(*KEYS).agg(F.min_by("title", "ord").alias("title"), F.min_by("kb_name", known).alias("kb_name"), F.coalesce(F.min_by("kb_confidence", known), F.lit("none")).alias("kb_confidence"), *first.values())
    shown = report.display_name(F.coalesce("kb_name", parse.clean_name(F.col("title"))), F.col("ram_gb"), F.col("storage_gb"), F.regexp_extract("model", "#(.*)$", 1))
    out = out.join(name, KEYS).withColumns({"key": F.concat_ws("|", *KEYS), "price": F.col("best.price"), "in_stock": F.col("best.in_stock"), "mrp": F.col("best.mrp"), "discount_pct": F.col("best.discount_pct"), "n_offers": F.size("offers"), "platform_name": notes.platform_name(F.col("best.platform")), "name": shown})
    return written(out, "candidates")


def reviewed(cands: DataFrame, listings: DataFrame, told: DataFrame) -> DataFrame:
    """Candidates with what is said (``reviews.summaries`` by listing id, as ``key``) of their first listing, in order, that has reviews."""
    columns = [c for c in told.columns if c != "key"]
    said = listings.select(*KEYS, "id", "ord").join(told.withColumnRenamed("key", "id"), "id").groupBy(*KEYS).agg(F.min_by(F.struct(*columns), "ord").alias("reviews"))
    return cands.join(said, KEYS, "left")


def ranked_cards(raw: DataFrame, intents: DataFrame, chips: DataFrame | None = None, models: DataFrame | None = None, page_text: DataFrame | None = None, outside: DataFrame | None = None, checkouts: DataFrame | None = None, review_pages: DataFrame | None = None, observations: DataFrame | None = None, tolerance: float = 0.0, in_stock_only: bool = False, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(ranked, rejected) from raw cards (``runs.cards``) to notes, with all that is known beside them.

    ``page_text`` (id, text), ``outside`` (id, external_<field>), ``checkouts`` (id, page_price, page_mrp, in_stock) and ``review_pages``
    (key: a listing's id, ord, text) have rows for the listings that have them, ``observations`` are recorded prices by candidate key.
    """
    rows = runs.listings(raw)
    if checkouts is not None:
        rows = pages.page_price(rows, checkouts)
    seen = analysed(rows, chips, page_text, outside, models)
    intents = with_inferred_category(intents, seen)
    cands, folded = candidates(seen), fold_targets(seen)
    if review_pages is not None:
        cands = reviewed(cands, folded, reviews.summaries(review_pages))
    if checkouts is not None:
        cands = grouping.promoted(cands, folded, checkouts, KEYS).withColumn("platform_name", notes.platform_name(F.col("best.platform")))
    if observations is not None:
        cands = with_history(cands, history.stats(observations))
    out, rejected = rank(written(cands, "asked"), intents, tolerance, parts, in_stock_only)
    return notes.annotated(out, parts=parts), rejected


def with_inferred_category(intents: DataFrame, rows: DataFrame) -> DataFrame:
    """Intents that name no category take the one that most of the listings' certainty lies with, accessories aside."""
    sums = rows.where(~F.col("category").isin("unknown", "accessory")).groupBy("category").agg(F.sum("category_confidence").alias("weight"), F.min("ord").alias("ord"))
    top = sums.agg(F.min_by("category", F.struct(-F.col("weight"), "ord")).alias("_top"))
    return intents.join(top, F.lit(True)).withColumn("category_wanted", F.when(F.col("category_wanted") == "unknown", F.coalesce("_top", F.lit("unknown"))).otherwise(F.col("category_wanted"))).drop("_top")


def with_history(cands: DataFrame, stats: DataFrame, key: str = "key") -> DataFrame:
    """Candidates with what ``history.stats`` has recorded of their price, null where nothing."""
    more = {"high": "recorded_high", "days_tracked": "recorded_days"}
    told = stats.select(F.col("key").alias("_key"), F.col("low").alias("recorded_low"), F.col("runs").alias("recorded_runs"), F.col("position").alias("recorded_position"), F.col("trend").alias("recorded_trend"), *(F.col(c).alias(n) for c, n in more.items() if c in stats.columns))
    return cands.join(told, F.col(key) == F.col("_key"), "left").drop("_key")


def rank(cands: DataFrame, intents: DataFrame, tolerance: float = 0.0, parts: int | None = None, in_stock_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(ranked, rejected) for every query; ranks come from ``parts`` ranges, the session's shuffle partitions if null.

    ``rejected`` has a row for each candidate and query that refuses it, and is computed only where it is read.
    """
    rejected = ranking.gated(cands, intents, tolerance, in_stock_only).where(F.size("reasons") > 0)
    s = ranking.survivors(cands, intents, tolerance, in_stock_only)
    null = F.lit(None)
    known = F.col("kb_confidence") if "kb_confidence" in cands.columns else null.cast("string")
    got = {c: F.col(c) if c in cands.columns else null for c in specs.FIELDS}
    s = s.withColumns({
        "performance": m.performance(got["antutu"]), "memory": m.memory(got["ram_gb"], got["storage_gb"]), "display": m.display(got["panel"], got["refresh_hz"], got["resolution"]),
        "battery": m.battery(got["battery_mah"], got["charging_w"]), "camera": m.camera(got["main_camera_mp"], got["ois"], got["tele_mp"], got["ultra_wide_mp"], got["aperture"]),
        "extras": m.extras(got["has5g"], got["nfc"], got["ip_rating"], got["os_upgrades"].cast("int")),
    })
    s = written(s, "components")
    s = ranking.totals(ranking.imputed(s, list(ranking.WEIGHTS)), F.col("priorities"))
    s = written(s, "totals")
    over = s.groupBy("query_id").agg(F.coalesce(F.avg("rating"), F.lit(4.0)).alias("prior")).join(global_medians(s, ["query_id"], ["price"]).withColumnRenamed("price", "middle"), "query_id")
    s = s.join(over, "query_id").withColumn("vouched", m.corroboration(F.col("rating_count"), known))
    spec = F.col("spec_total") * F.col("vouched")
    told = {k: F.col(f"recorded_{k}") for k in ("low", "runs", "position", "trend")} if "recorded_runs" in cands.columns else None
    s = s.withColumns({"trust": m.trust(F.col("rating"), F.col("rating_count"), F.col("prior")), "deal": m.deal(F.col("discount_pct"), F.col("mrp"), F.col("price"), F.col("spread"), F.col("n_offers"), F.col("middle"), told), "ratio": spec / (F.col("price") / 1000)})
    s = ranking.with_percentile(s, F.col("ratio"), "_percentile", parts=parts)
    s = s.withColumn("value", m.clamp(F.col("_percentile") * (0.45 + 0.55 * (1 - F.col("imputed_weight")))))
    s = s.withColumn("confidence", ranking.confidence(F.col("imputed_weight"), F.col("completeness"), F.col("rating").isNotNull(), known))
    s = s.withColumn("total", ranking.overall(F.col("value"), spec, F.col("trust"), F.col("deal"), F.col("confidence"), F.array_contains("priorities", "value")))
    weak = (got["soc_name"].isNull() if "soc_name" in cands.columns else F.lit(True)) & (F.coalesce("rating_count", F.lit(0)) < 20)
    s = s.withColumn("total", F.when(weak, F.col("total") * 0.7).otherwise(F.col("total")))
    s = written(s, "scores")
    s = s.withColumn("exact", ranking.model_matches(F.col("model_hint"), F.col("brands"), F.concat("name", "model")))
    s = ranking.ranked(s, [F.desc("exact"), F.coalesce(F.col("in_stock") == F.lit(False), F.lit(False)), F.desc("total"), F.desc("confidence"), F.col("price"), F.col("best.ord")], parts=parts)
    return ranking.badges(s), rejected

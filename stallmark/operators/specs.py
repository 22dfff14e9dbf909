"""Specifications from free text, with plausibility bounds, and the merge of several sources field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import QUALIFIERS, found, matches

FIELDS = ["ram_gb", "storage_gb", "battery_mah", "charging_w", "display_inches", "refresh_hz", "panel", "resolution", "main_camera_mp", "ultra_wide_mp", "tele_mp", "aperture", "ois", "has5g", "ip_rating", "nfc", "soc_name", "antutu", "os_upgrades", "colour"]
#: The fields that completeness counts.
COUNTED = ["ram_gb", "storage_gb", "battery_mah", "charging_w", "display_inches", "refresh_hz", "panel", "resolution", "main_camera_mp", "has5g", "soc_name"]
_NUMBERS = {"ram_gb", "storage_gb", "battery_mah", "charging_w", "refresh_hz", "main_camera_mp", "ultra_wide_mp", "tele_mp", "antutu", "os_upgrades"}


def near(c: Column, value: str, context: str, width: int = 60) -> Column:
    """The first match of ``value`` (its group 1) with ``context`` within ``width`` characters on either side.

    Matches are cut out with the text between them, so that windows see what neighbours hold.
    """
    hits = F.regexp_extract_all(c, F.lit(f"(?i){value}"), F.lit(0))
    gaps = F.split(c, f"(?i){value}")
    places = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(hits), F.lit(1))), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")), lambda acc, i: F.struct((acc["at"] + F.coalesce(F.length(F.get(gaps, i - 1)), F.lit(0)) + F.coalesce(F.length(F.get(hits, i - 1)), F.lit(0))).alias("at"), F.concat(acc["starts"], F.array(acc["at"] + F.coalesce(F.length(F.get(gaps, i - 1)), F.lit(0)))).alias("starts")))["starts"]
    pairs = F.arrays_zip(hits.alias("hit"), places.alias("start"))
    ok = F.filter(pairs, lambda p: p["hit"].isNotNull() & F.substring(c, F.greatest(p["start"] - width + 1, F.lit(1)), F.length(p["hit"]) + 2 * width).rlike(f"(?i){context}"))
    return found(F.get(ok, F.lit(0))["hit"], f"(?i){value}")


# Words near a number or a name that make it one of a display, or of charging.
SCREEN = r"display|screen|panel|refresh|resolution|nits|inch|touch|hd\+|fhd"
CHARGING = r"charg|charger|adapter|wired|fast\s*charge|watt|mah|battery"
# Panels by the first pattern that stands near a display.
PANELS = [(r"\bsuper\s*amoled\b|\bamoled\b", "AMOLED"), (r"\bp-?oled\b", "pOLED"), (r"\bpls\b", "PLS LCD"), (r"\bips\b", "IPS LCD"), (r"\blcd\b", "TFT LCD")]
# What may stand between a lens and its number (no other number of megapixels), and the rates that displays have.
LENS_GAP = r"(?:(?!\d{1,2}\s*mp)[^\n]){0,24}"
RATES = (60, 90, 120, 144, 165, 180)


def from_text(c: Column) -> dict[str, Column]:
    """One column per field, null where the text says nothing plausible."""
    def whole(pattern, group=1):
        return found(c, f"(?i){pattern}", group).try_cast("int")

    def size(pattern):
        n, unit = whole(pattern), F.lower(found(c, f"(?i){pattern}", 2))
        return F.when(unit == "tb", n * 1024).otherwise(n)

    def within(v, low, high):
        return F.when(v.between(low, high), v)

    plus = r"\b(\d+)\s*\+\s*(\d+)\s*gb\b"
    ram = F.coalesce(whole(r"(\d+)\s*gb\s*ram"), whole(plus, 1))
    storage = F.coalesce(whole(plus, 2), size(r"\(\s*[^,()]+,\s*(\d+)\s*(gb|tb)\s*\)"), size(r"(\d+)\s*(gb|tb)\s*(?:rom|storage|internal)"))
    megapixels = F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"(?i)(\d{1,3})\s*mp\b"), F.lit(1)), lambda x: x.try_cast("int")), lambda x: (x >= 2) & (x <= 250))
    several = F.size(megapixels) > 1
    others = F.slice(megapixels, F.lit(2), F.greatest(F.size(megapixels) - 1, F.lit(0)))
    labelled = F.coalesce(whole(rf"(\d{{1,2}})\s*mp{LENS_GAP}ultra\s*wide"), whole(rf"ultra\s*wide{LENS_GAP}(\d{{1,2}})\s*mp"))
    wide = F.coalesce(labelled, F.when(F.size(others) >= 2, F.array_min(F.filter(others, lambda x: x >= 8))))
    tele = F.coalesce(whole(rf"(\d{{1,2}})\s*mp{LENS_GAP}(?:telephoto|periscope|optical zoom)"), whole(rf"(?:telephoto|periscope){LENS_GAP}(\d{{1,2}})\s*mp"))
    last = F.element_at(F.concat(F.array(F.lit(None).cast("int")), F.filter(others, lambda x: (x >= 8) & (x <= 64) & ~x.eqNullSafe(wide))), -1)
    tele = F.when(several & matches(c, r"telephoto|periscope|\d\s*x\s*(optical|tele)"), F.coalesce(tele, last))
    watts = near(c, r"(\d{2,3})\s*w\b", CHARGING, 40).try_cast("int")
    panel = F.coalesce(*(F.when(near(c, f"({p})", SCREEN).isNotNull(), name) for p, name in PANELS))
    claimed = F.coalesce(whole(r"antutu\s*:?\s*(\d{2,4})\s*k\b"), whole(r"antutu\s*:?\s*(\d{5,7})\b"))
    antutu = F.when(claimed < 10000, claimed * 1000).otherwise(claimed)
    inches = found(c, r"(?i)(\d\.\d{1,2})\s*(?:inch|\")").try_cast("double")
    aperture = found(c, r"(?i)\bf/\s*(\d\.\d)\b").try_cast("double")
    rated = found(c, r"(?i)\bip(?:x)?(\d{2})\b")
    out = {
        "ram_gb": within(ram, 1, 24), "storage_gb": F.when(storage >= 8, storage), "battery_mah": within(whole(r"(\d{4,5})\s*mah"), 1500, 12000), "charging_w": within(watts, 5, 300),
        "display_inches": F.when(inches >= 4.5, inches), "refresh_hz": F.when(whole(r"(\d{2,3})\s*hz").isin(*RATES), whole(r"(\d{2,3})\s*hz")), "panel": panel,
        "resolution": F.when(matches(c, r"\bfhd\+?\b|\bfull\s*hd\b|1080"), "FHD+").when(matches(c, r"\bhd\+?\b|\b720\b"), "HD+"),
        "main_camera_mp": within(whole(r"(\d{2,3})\s*mp"), 2, 250), "ultra_wide_mp": F.when(several, within(wide, 8, 64)), "tele_mp": within(tele, 8, 64), "aperture": F.when(aperture.between(1.0, 2.9), aperture),
        "ois": F.when(matches(c, r"\bois\b|optical\s*image\s*stabili"), True), "has5g": F.when(matches(c, r"\b5g\b"), True), "ip_rating": F.concat(F.lit("IP"), rated), "nfc": F.when(matches(c, r"\bnfc\b"), True),
        "antutu": F.when((antutu > 50000) & (antutu < 3000000), antutu), "colour": F.trim(found(c, r"\(\s*([A-Za-z][A-Za-z\s]{2,20}?)\s*,\s*\d+\s*[GT]B")),
    }
    tiny = F.coalesce(inches < 4.5, F.lit(False))
    return out | {k: F.when(~tiny, out[k]) for k in ("refresh_hz", "resolution", "panel", "has5g", "ois")}


def with_specs(df: DataFrame, c: Column, prefix: str) -> DataFrame:
    """Adds <prefix>_<field> of every field that text can give."""
    return df.withColumns({f"{prefix}_{k}": v for k, v in from_text(c).items()})


def merged(df: DataFrame, sources: list[str], fields: list[str] = FIELDS) -> DataFrame:
    """Per field the first source, in order, that knows it, and ``sources``: which one it was."""
    have = {f: [s for s in sources if f"{s}_{f}" in df.columns] for f in fields}
    have = {f: s for f, s in have.items() if s}
    which = [F.struct(F.lit(f).alias("key"), F.coalesce(*(F.when(F.col(f"{s}_{f}").isNotNull(), F.lit(s)) for s in own)).alias("value")) for f, own in have.items()]
    source = F.map_from_entries(F.filter(F.array(*which), lambda e: e["value"].isNotNull()))
    out = df.withColumns({f: F.coalesce(*(F.col(f"{s}_{f}") for s in own)) for f, own in have.items()} | {"spec_sources": source})
    return out.drop(*(f"{s}_{f}" for f, own in have.items() for s in own))


# Words of colours, and words that say nothing of a model.
COLOURS = (
    "black white blue green gold silver grey gray purple pink red orange titanium graphite midnight starlight aqua ocean sunset lavender mint cyan beige bronze charcoal emerald sage thunder glacier obsidian ivory marble frost storm sand olive teal amber coral siachen satin matte glossy "
    "twilight shadow phantom cosmic galaxy nebula azure crystal pearl sapphire ruby jade onyx steel carbon desert forest sky iris violet lime peach cream khaki navy denim chrome prism aurora dusk dawn moon star rose bliss breeze wave mist glow shine spark flame enchanted electric royal deep light dark pure soft"
).split()
STOP = "with and includes include free offer combo exchange upto up to for new latest smartphone mobile phone".split()
#: Words of a model key, and those that come before a colour or a stop word can end it.
KEY_WORDS, KEY_STEM = 6, 2


def model_key(title: Column) -> Column:
    """The words that name a model: before a bar and before a condition of sale, without brackets and memory sizes, up to a colour or
    stop word once two are kept, six at most. A tag in brackets, such as (4a), follows the last word that is no colour.
    """
    head = F.substring_index(title, "|", 1)
    cut = F.least(*(F.nullif(F.regexp_instr(head, F.lit(f"(?i){p}")), F.lit(0)) for p, _ in QUALIFIERS))
    head = F.when(cut.isNotNull(), F.substring(head, F.lit(1), cut - 1)).otherwise(head)
    tags = F.transform(F.regexp_extract_all(head, F.lit(r"(?i)\((\d{1,2}[a-fh-z])\)"), F.lit(1)), lambda t: F.lower(t))
    plain = F.regexp_replace(F.regexp_replace(F.lower(head), r"\([^)]*\)", " "), r"\b\d+\s*(gb|tb)\b\s*(ram|rom|storage)?", " ")
    tokens = F.filter(F.split(F.regexp_replace(plain, r"[^a-z0-9+\s]", " "), r"\s+"), lambda t: t != "")
    seed = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("done"))

    def step(acc, t):
        kept = F.size(acc["out"])
        done = acc["done"] | ((kept >= KEY_STEM) & t.isin(*COLOURS, *STOP)) | (kept >= KEY_WORDS)
        return F.struct(F.when(done | t.isin(*STOP), acc["out"]).otherwise(F.concat(acc["out"], F.array(t))).alias("out"), done.alias("done"))

    words = F.aggregate(tokens, seed, step)["out"]
    last = F.array_max(F.transform(words, lambda w, i: F.when(~w.isin(*COLOURS), i)))
    whole = F.when(last.isNotNull(), F.concat(F.slice(words, F.lit(1), last + 1), tags, F.slice(words, last + 2, F.greatest(F.size(words), F.lit(1))))).otherwise(words)
    return F.array_join(whole, " ")

"""Columns from raw marketplace values: money, percentages, flags, ratings, counts, URLs, ids and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .maths import jround

# How brands and abbreviations are written.
CASING = {"oneplus": "OnePlus", "iqoo": "iQOO", "realme": "realme", "poco": "POCO", "redmi": "Redmi", "xiaomi": "Xiaomi", "samsung": "Samsung", "apple": "Apple", "iphone": "iPhone", "vivo": "vivo", "oppo": "OPPO", "motorola": "Motorola", "moto": "Moto", "nothing": "Nothing", "google": "Google", "pixel": "Pixel", "infinix": "Infinix", "tecno": "Tecno", "lava": "LAVA", "nokia": "Nokia", "honor": "Honor", "sony": "Sony", "jbl": "JBL", "boat": "boAt", "5g": "5G", "4g": "4G", "gb": "GB", "tb": "TB"}
# Brands by the first pattern that a text matches.
BRANDS = [
    (r"\bsamsung\b", "Samsung"), (r"\bapple\b|\biphone\b", "Apple"), (r"\bpoco\b", "POCO"), (r"\bredmi\b", "Xiaomi"), (r"\bxiaomi\b|\bmi\b", "Xiaomi"),
    (r"\boneplus\b", "OnePlus"), (r"\brealme\b|\bnarzo\b", "realme"), (r"\biqoo\b", "iQOO"), (r"\bvivo\b", "vivo"), (r"\boppo\b", "OPPO"),
    (r"\bmotorola\b|\bmoto\s+[ge]\d", "Motorola"), (r"\bnothing\b", "Nothing"), (r"\bgoogle\b|\bpixel\b", "Google"), (r"\binfinix\b", "Infinix"),
    (r"\btecno\b", "Tecno"), (r"\blava\b", "LAVA"), (r"\bitel\b", "itel"), (r"\bnokia\b", "Nokia"), (r"\bhonor\b", "Honor"), (r"\bsony\b", "Sony"),
    (r"\bjbl\b", "JBL"), (r"\bboat\b", "boAt"), (r"\bnoise\b", "Noise"), (r"\bbose\b", "Bose"), (r"\bai\s*\+", "Ai+"),
]
# Conditions of sale that make another product of the same model.
QUALIFIERS = [
    (r"\block(ed)?\s+with\s+[a-z]+", "carrier-locked"), (r"\brefurbish(ed)?\b", "refurbished"), (r"\brenewed\b", "renewed"),
    (r"\bopen\s*box\b", "open-box"), (r"\bpre[-\s]?owned\b|\bsecond\s*hand\b", "pre-owned"), (r"\bwith\s+offer\b|\bcombo\b", "bundle"),
]
#: Query parameters that tell products of one path apart, in the order they are kept.
KEPT_PARAMETERS = ("pid", "asin", "skuId", "productId")
#: White space that Java's \s does not know.
WIDE_SPACES = "".join(map(chr, (0xA0, 0x2009, 0x202F, 0x3000)))


def spaced(c: Column) -> Column:
    """Every kind of space as a plain one."""
    return F.translate(c, WIDE_SPACES, " " * len(WIDE_SPACES))


def matches(c: Column, pattern: str) -> Column:
    return c.rlike(f"(?i){pattern}")


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group, null where there is none."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def first_of(rules: list[tuple[str, str]], c: Column) -> Column:
    """The label of the first rule whose pattern matches."""
    return F.coalesce(*(F.when(matches(c, p), F.lit(label)) for p, label in rules))


def money(c: Column) -> Column:
    """Digits and dots of a text, read up to a second dot, if over zero."""
    digits = F.regexp_replace(c.cast("string"), r"[^0-9.]", "")
    value = found(digits, r"^([0-9]*\.?[0-9]+|[0-9]+\.?)").try_cast("double")
    return F.when(value > 0, value)


def percent(c: Column) -> Column:
    value = jround(found(c, r"(\d{1,3}(?:\.\d+)?)\s*%").try_cast("double"))
    return F.when((value > 0) & (value <= 100), value)


def flag(c: Column) -> Column:
    """true, yes, 1 and false, no, 0; null for anything else."""
    text = F.lower(F.trim(c.cast("string")))
    return F.when(text.isin("true", "yes", "1"), F.lit(True)).when(text.isin("false", "no", "0"), F.lit(False))


def rating(c: Column) -> Column:
    """A rating out of 5; over 5 it is out of 100. Zero means none."""
    return F.when((c > 5) & (c <= 100), jround(c / 20, 1)).when((c > 0) & (c <= 5), c)


def count_of(c: Column) -> Column:
    """A count as text, with commas and k, l, lakh or m."""
    text = F.lower(F.replace(c, F.lit(","), F.lit("")))
    unit = F.regexp_extract(text, r"([\d.]+)\s*(lakh|k|l|m)?", 2)
    factor = F.when(unit == "k", 1e3).when(unit.isin("l", "lakh"), 1e5).when(unit == "m", 1e6).otherwise(1.0)
    return jround(found(text, r"([\d.]+)").try_cast("double") * factor).cast("long")


def brand(c: Column) -> Column:
    return first_of(BRANDS, c)


def qualifiers(c: Column) -> Column:
    return F.array_compact(F.array(*(F.when(matches(c, p), F.lit(label)) for p, label in QUALIFIERS)))


def canonical_url(c: Column) -> Column:
    """The URL without its query but for parameters that name a product; text up to ? where it is none."""
    kept = F.concat_ws("&", *(F.concat(F.lit(f"{k}="), F.try_parse_url(c, F.lit("QUERY"), F.lit(k))) for k in KEPT_PARAMETERS))
    host, path = F.try_parse_url(c, F.lit("HOST")), F.coalesce(F.try_parse_url(c, F.lit("PATH")), F.lit(""))
    whole = F.concat(F.try_parse_url(c, F.lit("PROTOCOL")), F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.coalesce(F.when(host.isNotNull(), whole), F.substring_index(c, "?", 1))


def stable_id(platform: Column, text: Column) -> Column:
    """platform:base-36 of the 32-bit polynomial hash (31) of a text."""
    h = F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda acc, ch: (acc * 31 + F.when(ch == "", 0).otherwise(F.ascii(ch))).bitwiseAND(4294967295))
    return F.concat(platform, F.lit(":"), F.lower(F.conv(h.cast("string"), 10, 36)))


def title_case(token: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in CASING.items() for x in kv))
    low = F.lower(token)
    return F.coalesce(F.get(F.array(F.try_element_at(known, low)), F.lit(0)), F.when(low.rlike(r"^[a-z]{1,3}\d+[a-z]?$"), F.upper(token)), F.when(low.rlike(r"^\d"), low), F.concat(F.upper(F.substring(token, 1, 1)), F.substring(low, 2, 1000)))


def title_from_url(c: Column) -> Column:
    """A product name from the words of a URL's path; null if under four characters are left.

    Long codes go, and of three words or more a last one of five to eight letters and digits that is no size: it is a code as well.
    """
    path = F.coalesce(F.try_parse_url(c, F.lit("PATH")), F.when(F.try_parse_url(c, F.lit("HOST")).isNull(), F.substring_index(c, "?", 1)), F.lit(""))
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    mark = F.array_position(F.transform(parts, lambda s: F.when(s.isin("p", "dp"), "p").otherwise(s)), "p").cast("int")
    slug = F.coalesce(F.when(mark > 1, F.get(parts, mark - 2)), F.when(F.get(parts, F.lit(0)) == "product", F.get(parts, F.lit(1))), F.element_at(F.concat(F.array(F.lit("")), parts), -1))
    tokens = F.filter(F.split(slug, "[-_]"), lambda t: (t != "") & ~t.rlike("(?i)^itm[0-9a-f]{6,}$") & ~t.rlike("(?i)^[0-9a-f]{10,}$"))
    last = F.element_at(F.concat(F.array(F.lit("")), tokens), -1)
    opaque = (F.size(tokens) > 2) & last.rlike(r"(?i)^[a-z0-9]{5,8}$") & ~last.rlike(r"(?i)^\d+(gb|tb|mp|mah|hz)?$")
    kept = F.when(opaque, F.slice(tokens, 1, F.size(tokens) - 1)).otherwise(tokens)
    title = F.array_join(F.transform(kept, title_case), " ")
    return F.when((F.length(slug) >= 4) & (F.length(title) >= 4), title)


def clean_name(c: Column) -> Column:
    """A display name: before any |, without what comes along, at most 70 characters."""
    one = F.trim(F.regexp_replace(F.substring_index(F.regexp_replace(spaced(c), r"\s+", " "), "|", 1), r"(?i)\s*-\s*(with|includes?|free|offer|combo)\b.*$", ""))
    return F.when(F.length(one) > 70, F.concat(F.rtrim(F.substring(one, 1, 67)), F.lit("…"))).otherwise(one)


def model_token(c: Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def normal_model(c: Column) -> Column:
    """A model name for lookups: lower case, without network generation, plus signs as a word."""
    words = F.regexp_replace(F.replace(F.lower(c), F.lit("+"), F.lit(" plus ")), r"\b[45]g\b|[^a-z0-9 ]", " ")
    return F.trim(F.regexp_replace(words, r"\s+", " "))


def page_key(url: Column) -> Column:
    """Host and path, and the product parameter if there is one."""
    pid = F.coalesce(F.try_parse_url(url, F.lit("QUERY"), F.lit("pid")), F.try_parse_url(url, F.lit("QUERY"), F.lit("asin")))
    return F.concat(F.try_parse_url(url, F.lit("HOST")), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.coalesce(F.concat(F.lit("?pid="), pid), F.lit("")))


def reviews_url(url: Column) -> Column:
    """The reviews page of a product page, null for hosts without one."""
    return F.when(url.rlike(r"flipkart\.com/.*/p/"), F.regexp_replace(canonical_url(url), "^(.*?)/p/", "$1/product-reviews/"))


def rupees(c: Column) -> Column:
    """Whole rupees with Indian digit groups, a dash for null."""
    s = jround(c).cast("long").cast("string")
    grouped = F.when(F.length(s) > 3, F.concat(F.regexp_replace(F.substring(s, F.lit(1), F.length(s) - 3), r"(\d)(?=(\d\d)+$)", "$1,"), F.lit(","), F.substring(s, -3, 3))).otherwise(s)
    return F.coalesce(F.concat(F.lit("₹"), grouped), F.lit("—"))


def short_count(c: Column) -> Column:
    """1.2L, 35k, 4.5k or the number itself."""
    return F.when(c >= 1e5, F.concat(F.format_string("%.1f", jround(c / 1e5, 1)), F.lit("L"))).when(c >= 1e4, F.concat(jround(c / 1e3).cast("long").cast("string"), F.lit("k"))).when(c >= 1e3, F.concat(F.format_string("%.1f", jround(c / 1e3, 1)), F.lit("k"))).otherwise(c.cast("long").cast("string"))


def age_label(seconds: Column) -> Column:
    """19m, 5h 03m (under two days) or 2d 4h."""
    m = F.floor(seconds / 60)
    h = F.floor(m / 60)
    short = F.when(h < 1, F.concat(m, F.lit("m"))).when(h < 48, F.concat(h, F.lit("h "), F.lpad((m % 60).cast("string"), 2, "0"), F.lit("m")))
    return short.otherwise(F.concat(F.floor(h / 24), F.lit("d "), h % 24, F.lit("h")))

"""Outside specification sources: index pages, specification pages, identity checks, conflicts and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cut import dealt, written
from ..functions.parse import found, matches, normal_model
from .globalrank import global_sum_before

# Brands whose products are listed under another one.
PARENTS = {"poco": "xiaomi", "redmi": "xiaomi", "iqoo": "vivo", "cmf": "nothing", "moto": "motorola"}


def index_entries(pages: DataFrame, brand_col: str = "brand", html_col: str = "html", page_col: str | None = None, order_col: str | None = None, most: int | None = None) -> DataFrame:
    """(slug, brand, name): the models that brand pages link to, the first page of each slug.

    With ``page_col`` a brand's pages are numbered from 1 and count up to the first that links to none or is not there, ``most`` at
    most; brands come in the order of ``order_col``, or of their names.
    """
    link = r'href="(?:https?://[^/"]+/)?([a-z0-9_]+-\d+\.php)"[^>]*>(?:<[^>]+>)*\s*([^<]{2,44})'
    slugs, names = (F.regexp_extract_all(html_col, F.lit(link), F.lit(g)) for g in (1, 2))
    rows = pages.select(F.col(brand_col).alias("brand"), (F.col(page_col) if page_col else F.lit(1)).alias("page"), F.col(order_col or brand_col).alias("turn"), F.posexplode(F.arrays_zip(slugs.alias("slug"), names.alias("name"))).alias("pos", "e"))
    rows = rows.select("brand", "page", "turn", "pos", "e.slug", F.trim(F.regexp_replace("e.name", r"\s+", " ")).alias("name")).where(~matches(F.col("name"), "^(home|news|reviews|compare|deals)?$"))
    if most is not None:
        rows = rows.where(F.col("page") <= most)
    if page_col is not None:
        # Pages that link to something, in order: those that stand at their own number come before the first gap.
        full = F.sort_array(F.collect_set(F.when(F.col("page") >= 1, F.col("page").cast("int"))))
        reach = rows.groupBy("brand").agg(F.size(F.filter(full, lambda p, i: p == i + 1)).alias("_reach"))
        rows = rows.join(reach, "brand").where(F.col("page").between(1, F.col("_reach")))
    return rows.groupBy("slug").agg(F.min_by(F.struct("brand", "name"), F.struct("turn", "page", "pos")).alias("e")).select("slug", "e.brand", "e.name")


def resolve(products: DataFrame, index: DataFrame, id_col: str = "id", name_col: str = "name", brand_col: str = "brand") -> DataFrame:
    """(id, slug): products whose normal name, with or without brand, is one slug's and no other's.

    The brand's own entries are looked at, or all where the index has none of that brand.
    """
    parents = F.create_map(*(F.lit(x) for kv in PARENTS.items() for x in kv))
    low = F.lower(F.col(brand_col))
    asked = products.select(F.col(id_col).alias("id"), normal_model(F.col(name_col)).alias("wanted"), F.coalesce(F.try_element_at(parents, low), low).alias("parent")).where(F.length("wanted") >= 4)
    known = index.select("slug", F.lower("brand").alias("of"), F.explode(F.array_distinct(F.array(normal_model(F.col("name")), normal_model(F.concat_ws(" ", "brand", "name"))))).alias("wanted")).distinct()
    asked = asked.join(known.select(F.col("of").alias("parent"), F.lit(True).alias("listed")).distinct(), "parent", "left")
    hits = asked.join(known, "wanted").where(F.col("listed").isNull() | (F.col("of") == F.col("parent")))
    return hits.groupBy("id").agg(F.min("slug").alias("slug"), F.max("slug").alias("other")).where("slug = other").drop("other")


def spec_page(df: DataFrame, c: Column, prefix: str = "external") -> DataFrame:
    """Adds <prefix>_<field> columns from the text of a specification page."""
    def number(pattern, kind="int"):
        return found(c, f"(?i){pattern}").try_cast(kind)

    # Headings and units of specification pages.
    chip = r"Chipset\s+(?:Qualcomm\s+\w+\s+|Mediatek\s+|Google\s+|Samsung\s+|Unisoc\s+|Apple\s+)?([A-Za-z][\w+ .]{2,34}?)\s*\(\d+\s*nm\)"
    shown = found(c, r"(?i)Display\s+Type\s+([A-Za-z+ ]{3,24}?)(?:,|\s+\d)")
    panel = F.when(matches(shown, "amoled"), "AMOLED").when(matches(shown, "oled"), "pOLED").when(matches(shown, "ips"), "IPS LCD").when(matches(shown, "tft|lcd"), "TFT LCD")
    wide = number(r"Resolution\s+(\d{3,4})\s*x")
    fields = {
        "name": F.trim(found(c, r"(?im)^\s*([\w+.\- ]{3,60}?)\s*-\s*Full phone specifications")), "soc_name": F.trim(F.regexp_replace(found(c, f"(?i){chip}"), r"\s+", " ")), "antutu": number(r"AnTuTu:\s*(\d{4,7})"), "battery_mah": number(r"(\d{4,5})\s*mAh"),
        "charging_w": number(r"Charging\s+(\d{1,3})W"), "panel": panel, "display_inches": number(r"Size\s+(\d\.\d{1,2})\s*inches", "double"), "refresh_hz": number(r"(\d{2,3})Hz(?!\s*PWM)"), "resolution": F.when(wide >= 1400, "QHD+").when(wide >= 1000, "FHD+").when(wide.isNotNull(), "HD+"),
        "main_camera_mp": number(r"Main Camera[\s\S]{0,40}?(\d{1,3})\s*MP"), "ois": F.when(matches(c, r"\bOIS\b"), True), "nfc": F.when(matches(c, r"NFC\s+Yes"), True).when(matches(c, r"NFC\s+No"), False), "ip_rating": F.upper(found(c, r"(?i)\b(IP[X0-9]{2,3})\b")),
    }
    return df.withColumns({f"{prefix}_{k}": v for k, v in fields.items()})


def page_fields(html: Column) -> Column:
    """A map of field names and display names, in lower case, to values, from either JSON encoding; the first wins."""
    text = html
    for entity, char in (("&quot;", '"'), ("&amp;", "&"), ("&#x27;", "'"), ("&apos;", "'")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    boxed = r'"name":\s*\[0,\s*"([^"]{2,40})"\]\s*(?:,\s*"displayName":\s*\[0,\s*"([^"]{0,40})"\]\s*)?,\s*"value":\s*\[0,\s*"([^"]{1,200})"\]'
    plain = r'"name":\s*"([^"]{2,40})"\s*,\s*"value":\s*"([^"]{1,200})"'
    def pairs(pattern, key, value):
        return F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(key)).alias("k"), F.regexp_extract_all(text, F.lit(pattern), F.lit(value)).alias("v"))

    every = F.transform(F.concat(pairs(boxed, 1, 3), pairs(boxed, 2, 3), pairs(plain, 1, 2)), lambda p: F.struct(F.lower(F.trim(p["k"])).alias("k"), F.trim(p["v"]).alias("v")))
    every = F.filter(every, lambda p: (p["k"] != "") & (p["v"] != ""))

    def first(pairs_: Column) -> Column:
        keys = F.array_distinct(F.transform(pairs_, lambda p: p["k"]))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: F.get(F.filter(pairs_, lambda p: p["k"] == k), F.lit(0))["v"]))

    # Bound once a page; named in the inner functions, the pairs would be read again for each key.
    return F.get(F.transform(F.array(every), first), F.lit(0))


def field_page(df: DataFrame, html: Column, prefix: str = "external") -> DataFrame:
    """Adds <prefix>_<field> columns from the named values of a page (``page_fields``); a page without a chip says nothing."""
    out = dealt(df).withColumn("_f", page_fields(html))

    def get(*keys):
        return F.coalesce(*(F.try_element_at("_f", F.lit(k)) for k in keys))

    def number(c, pattern, kind="int"):
        return F.regexp_replace(found(c, f"(?i){pattern}"), ",", "").try_cast("double").try_cast(kind)

    chip, battery, camera = get("chipset", "processor"), get("battery"), get("rear camera", "primary camera")
    name = F.regexp_replace(F.regexp_replace(chip, r"\(.*?\)", " "), r"(?i),?\s*[\d,]{4,9}\s*antutu\s*score", " ")
    shown, lines, nfc = F.lower(get("display type", "display-type", "screen type")), get("resolution", "display-resolution"), get("nfc")
    watts = r"([\d.]{1,3})\s*(?:w\b|watt)"
    panel = F.when(shown.contains("oled"), "AMOLED").when(shown.contains("pls"), "PLS LCD").when(shown.contains("ips"), "IPS LCD").when(shown.contains("tft"), "TFT LCD").when(shown.contains("lcd"), "LCD")
    fields = {
        "soc_name": F.nullif(F.trim(F.regexp_replace(name, r"\s+", " ")), F.lit("")), "antutu": number(chip, r"([\d,]{5,9})\s*antutu"), "battery_mah": number(battery, r"([\d,]{4,5})\s*mah"),
        "charging_w": F.coalesce(number(battery, watts), number(get("charging", "charging speed"), watts)), "panel": panel, "display_inches": number(get("display", "display size"), r"([\d.]{3,4})\s*inch", "double"),
        "refresh_hz": number(get("refresh rate", "refresh-rate"), r"(\d{2,3})\s*hz"), "resolution": F.when(matches(lines, "qhd"), "QHD+").when(matches(lines, "fhd"), "FHD+").when(matches(lines, "hd"), "HD+"),
        "main_camera_mp": number(camera, r"([\d.]{1,3})\s*mp"), "ois": F.when(matches(F.concat_ws(" ", camera, get("image stabilization")), r"\bois\b|optical image stabili"), True),
        "nfc": F.when(nfc.isNotNull(), ~matches(nfc, r"^no\b")), "ip_rating": F.upper(found(get("ip rating"), "(?i)(IP[0-9X]{2})")),
    }
    return out.withColumns({f"{prefix}_{k}": F.when(chip.isNotNull(), v) for k, v in fields.items()}).drop("_f")


def market_price(html: Column) -> Column:
    """(low, high) of a page's price range, null if there is none or it is upside down."""
    text = F.replace(html, F.lit("&quot;"), F.lit('"'))
    low, high = (found(text, r'"lowPrice":\s*(\d{3,7})\s*,\s*"highPrice":\s*(\d{3,7})', g).try_cast("long") for g in (1, 2))
    return F.when((low > 0) & (low <= high), F.struct(low.alias("low"), high.alias("high")))


def same_name(got: Column, wanted: Column) -> Column:
    """Whether one normal name holds the other."""
    a, b = normal_model(got), normal_model(wanted)
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


# How a source writes brands in addresses, and words that say nothing of a model.
BRAND_SLUGS = {"motorola": "moto", "xiaomi": "redmi", "mi": "redmi"}
SLUG_NOISE = r"\b(dual sim|india|smartphone|mobile phone|with|free|offer|new|latest)\b"
#: How many addresses of a product are tried.
TRIED = 4


def slug_of(c: Column) -> Column:
    """A name as words of an address: no noise, brackets and memory sizes, a plus as a word."""
    words = F.regexp_replace(F.regexp_replace(F.replace(F.lower(c), F.lit("+"), F.lit(" plus ")), SLUG_NOISE, " "), r"\([^)]*\)|\b\d+\s*gb\b", " ")
    return F.regexp_replace(F.regexp_replace(words, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slugs(name: Column, brand: Column) -> Column:
    """Addresses at which a source may hold a product, the likeliest first, four at most: under the source's word for the brand, as
    named, with the brand in front, and without its network generation.
    """
    words = F.create_map(*(F.lit(x) for kv in BRAND_SLUGS.items() for x in kv))
    base = slug_of(name)
    head = F.substring_index(base, "-", 1)
    word = F.coalesce(F.try_element_at(words, head), F.try_element_at(words, F.lower(brand)))

    def under(slug: Column) -> Column:
        return F.when(word.isNotNull(), F.concat(word, F.substring(slug, F.length(head) + 1, F.length(slug)))).otherwise(slug)

    own = F.coalesce(F.try_element_at(words, F.lower(brand)), slug_of(brand))
    bare = F.regexp_replace(base, "-(5g|4g|lte)$", "")
    every = F.array(under(base), base, F.when((own != "") & ~base.startswith(own), F.concat(own, F.lit("-"), base)), F.when(bare != base, under(bare)))
    return F.when(base != "", F.slice(F.array_distinct(F.filter(F.array_compact(every), lambda x: x != "")), 1, TRIED)).otherwise(F.array().cast("array<string>"))


def identity(c: Column) -> Column:
    """A name for telling products apart: letters and digits, without network generation, country, brackets and memory sizes."""
    plain = F.regexp_replace(F.replace(F.lower(c), F.lit("+"), F.lit("plus")), r"\bmotorola\b", "moto")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"\b(5g|4g|lte|dual sim|india|smartphone)\b", " "), r"\([^)]*\)|\b\d+\s*gb\b", " "), "[^a-z0-9]+", "")


def is_page_of(model: Column, html: Column, slug: Column) -> Column:
    """Whether a page is the model's, by its title, else the first name in it, else its address."""
    title = F.coalesce(found(html, r"(?i)<title[^>]*>([^<]{3,120})<"), found(html, r'"name":\s*"([^"]{3,80})"'), slug)
    want, got = identity(model), identity(title)
    return (want != "") & (F.contains(got, want) | F.contains(want, got) | (identity(slug) == want))


def first_source(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, slug, name): for each product the first of its candidate slugs whose page is the same product.

    ``wanted`` (id, name, slugs), ``pages`` (slug, page_name).
    """
    tried = wanted.select("id", "name", F.posexplode("slugs").alias("pos", "slug")).join(pages, "slug").where(same_name(F.col("page_name"), F.col("name")))
    return tried.groupBy("id").agg(F.min_by(F.struct("slug", "page_name"), "pos").alias("p")).select("id", "p.slug", F.col("p.page_name").alias("name"))


def conflicts(products: DataFrame, outside: DataFrame, field: str = "soc_name") -> DataFrame:
    """(id, field, known, outside): where a value of the knowledge base differs from another source's."""
    both = products.where(F.col("source").isin("kb", "inferred")).select("id", F.col(field).alias("known")).join(outside.select("id", F.col(field).alias("outside")), "id")
    return both.where(F.lower("known") != F.lower("outside")).select("id", F.lit(field).alias("field"), "known", "outside")


def audit(known: DataFrame, live: DataFrame) -> DataFrame:
    """Outcomes of comparing the knowledge base with live pages: agree, chipset, battery (over 60 mAh), benchmark (over 10 %), not found."""
    both = known.alias("k").join(live.alias("l"), "key", "left")
    out = F.when(F.col("l.soc_name").isNull(), "not found").when(F.lower("l.soc_name") != F.lower("k.soc_name"), "chipset")
    out = out.when(F.abs(F.col("l.battery_mah") - F.col("k.battery_mah")) > 60, "battery").when(F.abs(F.col("l.antutu") - F.col("k.antutu")) > 0.1 * F.col("k.antutu"), "benchmark").otherwise("agree")
    return both.select(out.alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


def failure(d: DataFrame) -> DataFrame:
    """Adds failure, the first of crawler_error, empty, wrong_products, fields_missing, else healthy, to scan diagnostics."""
    thin = (F.col("priced") / F.greatest(F.col("raw_cards"), F.lit(1)) < 0.5) | (F.col("field_fill") < 0.6)
    return d.withColumn("failure", F.when(F.col("status") == "error", "crawler_error").when(F.col("raw_cards") == 0, "empty").when(F.col("category_matched") == 0, "wrong_products").when(thin, "fields_missing").otherwise("healthy"))


#: How many pages that said little are read a second time, rendered, and the families of facts from which a page says enough.
RESCUES, ENOUGH = 12, 2


def _wanted(candidates: DataFrame, cached: DataFrame) -> DataFrame:
    """Candidates with an address that are neither fully specified nor cached."""
    full = (F.col("completeness") >= 0.95) & (F.col("kb_confidence") == "high") & F.col("checkout").isNotNull()
    return candidates.where(F.col("url").isNotNull() & ~F.coalesce(full, F.lit(False))).join(cached.select("page_key").distinct(), "page_key", "left_anti")


def fetch_queue(candidates: DataFrame, cached: DataFrame, budget: int, by: str = "query_id") -> DataFrame:
    """What to fetch: candidates with a URL that are neither fully specified nor cached, the least complete first."""
    todo = _wanted(candidates, cached)
    return todo.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("completeness", "page_key"))).where(F.col("place") <= budget)


def affordable(rows: DataFrame, by: str, order: list[str], cost: Column, budget: int, parts: int | None = None) -> DataFrame:
    """Rows that a budget pays for, in order, with ``spent``: what those before them cost.

    A row is paid while anything is left. Sums run over ranges of the whole order: no query's rows meet in one task.
    """
    out = global_sum_before(rows.withColumn("_cost", cost), [by], [F.col(c) for c in order], "_cost", "spent", parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return out.where(F.col("spent") < budget).drop("_cost")


def fetch_rounds(candidates: DataFrame, cached: DataFrame, found: DataFrame, budget: int, rescues: int = RESCUES, paid: bool = True, by: str = "query_id", parts: int | None = None) -> DataFrame:
    """(by, page_key, place, rescued): the pages that a budget lets read, the least complete product first, and which are read again.

    A second round reads again, while ``rescues`` last, pages of a shop that loads its table late: those that were read directly
    and said too little. ``found`` (page_key, via, richness) tells how each page was read and how many families of facts it names.
    """
    order = ["completeness", "page_key"]
    first = affordable(_wanted(candidates, cached), by, order, F.lit(1), budget, parts).withColumn("place", (F.col("spent") + 1).cast("int")).drop("spent")
    read = first.join(found.select("page_key", "via", "richness"), "page_key", "left")
    if not paid:
        return read.select(by, "page_key", "place", F.lit(False).alias("rescued"))
    read = written(read, "first_round")
    thin = read.where(F.col("url").contains("flipkart.com") & (F.col("via") == "direct") & (F.col("richness") < ENOUGH))
    again = affordable(thin, by, order, F.lit(1), rescues, parts).select(by, "page_key", F.lit(True).alias("rescued"))
    return read.join(again, [by, "page_key"], "left").select(by, "page_key", "place", F.coalesce("rescued", F.lit(False)).alias("rescued"))

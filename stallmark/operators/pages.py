"""Product pages as text: specification section, checkout block, structured data, reviews."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.maths import jround
from ..functions.parse import WIDE_SPACES, found, matches, spaced
from .text import html_to_text

# Headings that begin a specification section.
ANCHORS = ["product highlights", "specifications", "technical details", "product details", "key features", "highlights"]
PAGE_LIMIT, HEAD_LIMIT = 24000, 4000


def spec_section(c: Column) -> Column:
    """From the first heading on, after a head of up to HEAD_LIMIT characters; PAGE_LIMIT in all."""
    # The lowered text and the places are bound, so that each is made once a page.
    places = F.transform(F.array(F.lower(c)), lambda low: F.array(*(F.locate(a, low) for a in ANCHORS)))
    first = F.transform(places, lambda p: F.array_min(F.filter(p, lambda x: x > 0)))

    def section(at: Column) -> Column:
        head = F.when(at > 1, F.concat(F.substring(c, F.lit(1), F.least(at - 1, F.lit(HEAD_LIMIT))), F.lit(" "))).otherwise("")
        return F.substring(F.when(at.isNull(), c).otherwise(F.concat(head, F.substring(c, at, F.lit(PAGE_LIMIT)))), 1, PAGE_LIMIT)

    return F.get(F.transform(first, section), F.lit(0))


def richness(c: Column, chips: Column) -> Column:
    """How many of five families of specifications a section names."""
    tests = [chips.isNotNull(), matches(c, r"[\d,]{3,5}\s*mAh"), matches(c, r"\b(P-?OLED|AMOLED|IPS|PLS|TFT|LCD)\b"), matches(c, r"\d{2,3}\s*MP"), matches(c, r"\d+\s*GB\s*(RAM|\+|/|\))|RAM[\s:|]*\d+")]
    return reduce(lambda a, b: a + b, (t.cast("int") for t in tests))


#: Blocks of structured data in a page.
LD_BLOCK = r"""(?i)<script[^>]+type=["']application/ld\+json["'][^>]*>([\s\S]{2,20000}?)</script>"""


def _number(v: Column) -> Column:
    """A whole number, halves up; no number is NaN, as null is zero."""
    return F.when(F.is_variant_null(v), F.lit("0")).otherwise(F.coalesce(jround(F.try_variant_get(v, "$", "string").try_cast("double")).cast("long").cast("string"), F.lit("NaN")))


def _text(v: Column) -> Column:
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def json_ld(html: Column) -> Column:
    """LD_PRICE, LD_SKU, LD_STOCK and LD_SELLER of the first structured product that is offered once, at a price.

    Blocks come in the order of the page, the members of a block that is an array in theirs; what is no JSON is passed over. An
    offer of several sellers is none: its lowest price, LD_LOW, is told before. Without a single offer nothing is told.
    """
    blocks = F.transform(F.regexp_extract_all(html, F.lit(LD_BLOCK), F.lit(1)), lambda b: F.try_parse_json(F.trim(b)))
    nodes = F.flatten(F.transform(F.filter(blocks, lambda v: v.isNotNull()), lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))))

    def told(v: Column) -> Column:
        got = {k: F.try_variant_get(v, f"$.{path}", "variant") for k, path in (("price", "offers.price"), ("low", "offers.lowPrice"), ("type", "offers['@type']"), ("sku", "sku"), ("stock", "offers.availability"), ("seller", "offers.seller.name"))}
        price = F.try_variant_get(got["price"], "$", "string").try_cast("double")
        several = F.coalesce(F.lower(F.try_variant_get(got["type"], "$", "string")).contains("aggregate"), F.lit(False)) | (got["low"].isNotNull() & got["price"].isNull())
        stock = F.nullif(F.element_at(F.split(F.try_variant_get(got["stock"], "$", "string"), "/"), -1), F.lit(""))
        tokens = F.concat_ws(" ", F.concat(F.lit("LD_PRICE="), jround(price).cast("long").cast("string")), F.concat(F.lit("LD_SKU="), _text(got["sku"])), F.concat(F.lit("LD_STOCK="), stock), F.concat(F.lit("LD_SELLER="), _text(got["seller"])))
        return F.struct((~several & F.coalesce(price > 0, F.lit(False))).alias("single"), tokens.alias("tokens"), F.when(got["low"].isNotNull(), F.concat(F.lit("LD_LOW="), _number(got["low"]))).alias("low"))

    found_ = F.transform(nodes, told)
    first = F.array_position(F.transform(found_, lambda t: t["single"]), F.lit(True)).cast("int")
    lows = F.transform(F.slice(found_, F.lit(1), F.greatest(first - 1, F.lit(0))), lambda t: t["low"])
    return F.when(first > 0, F.concat_ws(" ", F.array_compact(lows), F.get(found_, first - 1)["tokens"]))


def json_state_text(html: Column, cap: int = 20000) -> Column:
    """Distinct values of "text" in a page's state, unescaped, joined by bars."""
    pattern = r'"text"\s*:\s*(?:"((?:[^"\\]|\\.){1,300})"|\[\s*"((?:[^"\\]|\\.){1,300})")'
    raw = F.transform(F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("a"), F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("b")), lambda p: F.concat(p["a"], p["b"]))
    plain = F.transform(raw, lambda t: F.trim(F.regexp_replace(F.regexp_replace(F.replace(t, F.lit('\\"'), F.lit('"')), r"\\u[\dA-Fa-f]{4}", " "), r"\\n", " ")))
    return F.substring(F.array_join(F.array_distinct(F.filter(plain, lambda t: F.length(t) > 1)), " | "), 1, cap)


def page_to_text(html: Column) -> Column:
    """All that a page says: its text, its state and its structured product."""
    return F.concat(html_to_text(html), F.lit(" | "), json_state_text(html), F.lit(" | "), F.coalesce(json_ld(html), F.lit("")))


def _amount(c: Column, pattern: str, group: int = 1) -> Column:
    n = F.regexp_replace(found(c, f"(?i){pattern}", group), r"\D", "").try_cast("long")
    return F.when(n > 0, n)


def checkout(df: DataFrame, text_col: str = "text", pid: Column | None = None) -> DataFrame:
    """Adds the facts of a product page's buy box; structured data of another product does not count.

    ``list_price`` is the list price as it stands there; ``page_mrp`` is it where it is no less than the price.
    """
    c = spaced(F.col(text_col))
    gap = r"[\s\[\](){}|]*"
    fee = r"\+\s?₹\d+" + gap + "Protect Promise Fee"
    full = r"\d{1,2}%" + gap + r"([\d,]{3,12})" + gap + r"₹\s?([\d,]{3,12})" + gap + fee
    sku = found(c, r"LD_SKU=([^|\s]+)")
    trusted = sku.isNull() | F.coalesce(sku == pid, F.lit(True)) if pid is not None else F.lit(True)
    box = F.coalesce(_amount(c, full, 2), _amount(c, r"₹\s?([\d,]{3,12})" + gap + fee))
    price = F.coalesce(box, F.when(trusted, _amount(c, r"LD_PRICE=(\d{3,8})")))
    mrp = F.coalesce(_amount(c, full, 1), _amount(c, r"₹([\d,]{3,8})\s*\|\s*MRP \(Incl\. of all taxes\)"))
    stock = F.when(trusted, found(c, r"LD_STOCK=(\w+)"))
    out = matches(c, r"Selected Colou?r:[^|]{0,40}?Out of stock") | F.coalesce(box.isNull() & matches(stock, "OutOfStock|SoldOut|Discontinued"), F.lit(False))
    delivery = F.trim(found(c, r"(?i)Delivery by ([A-Za-z0-9 ,]{4,20}?)(?:\s+Arriving|\s+Fulfil|\s*\|)"))
    seller = F.coalesce(F.when(trusted, F.trim(found(c, r"LD_SELLER=([^|]{2,40}?)(?:\s{2,}|$)"))), F.trim(found(c, r"(?i)(?:Fulfilled by|Sold by|Seller)\s+([A-Za-z0-9][A-Za-z0-9 .&'-]{2,38}?)(?:\s+\d\.\d|\s*\||\s+See other sellers|\s{2,}|\s*$)")))
    return df.withColumns({
        "page_price": price, "list_price": mrp, "page_mrp": F.when(mrp >= price, mrp), "seller": seller, "in_stock": F.when(out, False).when(stock.isNotNull() | delivery.isNotNull(), True), "delivery_by": delivery,
        "buy_at": F.coalesce(_amount(c, r"Buy at ₹([\d,]+)"), _amount(c, r"₹([\d,]+)\s*Lowest price for you")), "bank_offer": _amount(c, r"Bank offers?\s*₹([\d,]+)\s*off"), "exchange_up_to": _amount(c, r"Exchange offer[^₹]{0,80}Up to ₹([\d,]+)"),
        "no_cost_emi": matches(c, "No Cost EMI"), "pincode_blocked": matches(c, "Not available at this Pincode"),
    })


def page_price(listings: DataFrame, checkouts: DataFrame) -> DataFrame:
    """Listings with the page's price where it differs from the card's by over 2 %; the card's is kept beside it. A card without a price keeps none."""
    both = listings.join(checkouts.select("id", "page_price", "page_mrp"), "id", "left")
    off = F.coalesce((F.col("page_price") > 0) & (F.col("price") > 0) & (F.abs(F.col("page_price") - F.col("price")) / F.nullif(F.col("price"), F.lit(0)) > 0.02), F.lit(False))
    return both.withColumns({"card_price": F.when(off, F.col("price")), "mrp": F.when(off, F.coalesce("page_mrp", "mrp")).otherwise(F.col("mrp")), "price": F.when(off, F.col("page_price").cast("double")).otherwise(F.col("price"))}).drop("page_price", "page_mrp")


#: How a review begins, and what of it is not its text: the variant that it is for, and the votes with all that follows.
HEAD = re.compile(r"\b[1-5]\.\d\s*•\s", re.A)
STARS, NAMED, NAMELESS, VOTES = (re.compile(p, re.A | re.I) for p in (r"^[1-5]\.\d\s*•\s*", r"Review for:[^|]*?Storage\s*\d+\s*GB\s*", r"Review for:\s*", r"Helpful for"))
VERIFIED, DATED = re.compile("Verified Purchase", re.A | re.I), re.compile(r"Verified Purchase\s*·\s*([A-Za-z]{3,9},?\s*\d{4})", re.A | re.I)
ENTITIES = (("&#x27;", "'"), ("&#39;", "'"), ("&quot;", '"'), ("&amp;", "&"), ("&nbsp;", " "))
#: Totals of a page, and its ratings by star.
TOTALS, RATED = re.compile(r"(?<![\d,])([\d,]++)\s*+ratings?\s*+and\s*+([\d,]++)\s*+reviews?", re.A | re.I), re.compile(r"([1-5])\s*★\s*([\d,]+)", re.A)


def _spaces(text: str, kinds: str) -> str:
    for c in kinds:
        text = text.replace(c, " ")
    return text


def plain(page: str | None) -> str:
    """Wide spaces as plain ones; a null page is an empty one."""
    return _spaces(page or "", WIDE_SPACES)


def cut(page: str) -> list[str]:
    """The reviews of a plain page in their order, each from its stars on."""
    at = [m.start() for m in HEAD.finditer(page)]
    return [page[a:b] for a, b in zip(at, [*at[1:], len(page)])]


def said(review: str) -> str:
    """What a review says: its text without stars, variant and votes."""
    body = STARS.sub("", review)
    body = NAMELESS.sub(" ", NAMED.sub(" ", body, count=1), count=1)
    votes = VOTES.search(body)
    if votes:
        body = body[: votes.start()]
    if "&" in body:
        for entity, char in ENTITIES:
            body = body.replace(entity, char)
    return " ".join(w for w in _spaces(body, "\t\n\v\f\r").split(" ") if w)


def reviews(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """(id, pos, stars, text, verified, date): the reviews of a page of them, in their order; columns ``more`` come along."""
    rows = df.select(F.col(id_col).alias("id"), *more, F.col(text_col).alias("_page"))
    kinds = (pa.int32(), pa.float64(), pa.string(), pa.bool_(), pa.string())
    schema = T.StructType([*rows.schema.fields[:-1], *T.StructType.fromDDL("pos int, stars double, text string, verified boolean, date string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, out = [], []
            for i, page in enumerate(batch.column("_page").to_pylist()):
                for pos, r in enumerate(cut(plain(page))):
                    dated = DATED.search(r)
                    place.append(i)
                    out.append((pos, float(r[:3]), said(r), bool(VERIFIED.search(r)), dated and dated[1]))
            kept = batch.drop_columns(["_page"]).take(pa.array(place, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array([r[j] for r in out], k) for j, k in enumerate(kinds))], names=schema.names)

    return rows.mapInArrow(run, schema)


def _whole(digits: str) -> int | None:
    """Digits and commas as a long, null where they are none."""
    digits = digits.replace(",", "")
    n = digits.lstrip("0")
    return int(n or 0) if digits and len(n) < 20 and int(n or 0) < 2**63 else None


def totals(page: str) -> tuple[int | None, int | None]:
    """Ratings and reviews that a plain page says there are."""
    told = TOTALS.search(page)
    return (_whole(told[1]), _whole(told[2])) if told else (None, None)


def counts(page: str) -> list[int] | None:
    """``histogram`` of one plain page: ratings from one star to five, none unless all are there."""
    last = dict(RATED.findall(page))
    out = [_whole(last.get(s, "")) for s in "12345"]
    return None if None in out else out


def histogram(c: Column) -> Column:
    """Ratings by star as a map; null unless all five are there."""
    stars, counts = (F.regexp_extract_all(c, F.lit(r"([1-5])\s*★\s*([\d,]+)"), F.lit(g)) for g in (1, 2))
    zipped = F.arrays_zip(stars.alias("s"), counts.alias("n"))

    def counted(z: Column) -> Column:
        last = [F.element_at(F.concat(F.array(F.lit(None).cast("long")), F.transform(F.filter(z, _star(s)), lambda p: F.replace(p["n"], F.lit(","), F.lit("")).try_cast("long"))), -1) for s in range(1, 6)]
        return F.array(*last)

    # Bound once a page, as is what comes of it: else each of the five stars would read the page again, twice over.
    told = F.transform(F.transform(F.array(zipped), counted), lambda n: F.when(F.forall(n, lambda x: x.isNotNull()), F.map_from_arrays(F.array(*(F.lit(s) for s in range(1, 6))), n)))
    return F.get(told, F.lit(0))


def _star(s: int):
    return lambda p: p["s"] == str(s)

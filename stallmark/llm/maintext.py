"""The main text of HTML pages: the contiguous region of words and tags with the largest sum of weights.

A page is a sequence of words and tags. Words weigh more the surer it is that words of their kind (nearest block, inside a link
or not, inside the page's one article or not) belong to content, tags take away; one linear scan finds the region with the
largest sum. The weights are learned from pages that label themselves, by holding exactly one ``article`` (or, without one,
one ``main``): what lies in it is content. Elements that say themselves that they are none (``MARKED``: menus,
forms, scripts, adverts, notices, reader comments ...) neither score nor give text, so that an advert within an article doesn't cut it.

The fit reads at most ``SAMPLE`` pages, those with the smallest hashes of their ids and addresses. Every page is read whole.

Defined results: a null or empty html, and one without words of content, gives an empty text; of regions with equal sums the
first and shortest is taken; markup that is cut off ends with the page; a ``br`` is white space; repeated rows each get a row; null ids and
addresses pass through; very long pages take time in proportion to their length; an empty table gives an empty result; further
columns are ignored whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import released, small_batches

#: Most pages that the weights are learned from.
SAMPLE = 2000
#: What a tag takes away where all tags of its name lie outside of content, and at least.
TAG, LEAST_TAG = 3.25, 0.05
#: So many words or tags of a kind as the first guess counts.
GUESS_COUNT = 4

# Names of HTML elements, and words that name kinds of page furniture in attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
MARKED = frozenset("aside audio button canvas dialog embed footer form head iframe input label math menu nav noscript object option script search select style svg template textarea title video".split())
TEXTUAL = frozenset("a abbr b blockquote br cite code dd dl dt em figcaption figure h1 h2 h3 h4 h5 h6 i img li mark ol p pre q s small span strong sub sup table tbody td th thead tr u ul".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
FURNITURE = frozenset(
    "ad ads adsense advert advertisement advertising adverts alert aside banner bottom breadcrumb breadcrumbs comment commentlist comments consent cookie cookies copyright disclaimer disqus footer gdpr legal login masthead menu modal nav navbar navigation newsletter notice notices outbrain pager pagination popup promo promoted promotion recommended related respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola toolbar topbar widget".split()
)
HEADERS = frozenset("header page-header site-header top-header".split())
NEGATED = frozenset("has no with without".split())
#: Elements that a start tag of the same group ends, up to the container named.
CLOSES = {"li": ("li", frozenset("ul ol menu dir".split())), "dt": ("dt dd", frozenset(["dl"])), "dd": ("dt dd", frozenset(["dl"])), "td": ("td th", frozenset("tr table".split())), "th": ("td th", frozenset("tr table".split())), "tr": ("tr", frozenset(["table"]))}

_TOKEN = re.compile(
    r"<!--(?:.*?--!?>|.*\Z)|<(script|style|textarea|title|iframe|noscript|template)\b(?>[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>(?:.*?</\1\s*+>|.*\Z)"
    r"|<(/?)([a-z][^\s/>]*+)((?>[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>",
    re.I | re.S,
)
#: Markup that is cut off: no bracket ends it.
_BEGUN = re.compile(r"<[a-z/!?]", re.I)
_NAMED = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""", re.I)


class Item(NamedTuple):
    """A run of words (text, their kind) or a tag (its name). ``breaks``: a block begins or ends here."""

    text: str | None
    kind: str
    marked: bool
    article: bool
    main: bool
    breaks: bool


class Open(NamedTuple):
    name: str
    block: str
    link: bool
    marked: bool
    article: bool
    main: bool


def furniture(name: str, attributes: str, inside: Open) -> bool:
    """Does an element say that it holds no content?"""
    if name in MARKED or (name == "header" and not (inside.article or inside.main)):
        return True
    if name in ("html", "body", "main", "article") or not attributes or not attributes.strip("/ \t\n"):
        return False
    for m in _NAMED.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
            return True
        if key == "role" and value in ROLES:
            return True
        if key in ("class", "id"):
            for word in value.split():
                parts = set(re.split(r"[-_]+", word))
                if not parts & NEGATED and (parts & FURNITURE or (word in HEADERS and not (inside.article or inside.main))):
                    return True
    return False


def items(page: str) -> tuple[list[Item], str]:
    """A page's words and tags in order, and which element holds its content by its own account ('' if none)."""
    out: list[Item] = []
    top = Open("", "", False, False, False, False)
    stack, places, blocks = [top], {}, [0]
    tops = Counter()

    def shut(place: int) -> None:
        while len(stack) > place:
            gone = stack.pop()
            places[gone.name].pop()
            if blocks[-1] == len(stack):
                blocks.pop()

    def words(text: str) -> None:
        if text and not text.isspace():
            here = stack[-1]
            out.append(Item(text, f"{here.block or 'body'}{' a' if here.link else ''}", here.marked, here.article, here.main, False))

    at, last = 0, page.rfind(">")
    for m in _TOKEN.finditer(page, 0, last + 1):
        words(page[at : m.start()])
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            continue  # comments, declarations, and elements whose text is no markup
        here, block = stack[-1], name in BLOCKS
        if m[2] or m[5]:
            where = places.get(name)
            if where and (block or where[-1] > blocks[-1]):
                shut(where[-1])
            out.append(Item(None, name, here.marked, here.article, here.main, block))
            continue
        if name in CLOSES:
            ended, within = CLOSES[name]
            inner = max((places[x][-1] for x in ended.split() if places.get(x)), default=0)
            if inner and inner > max((places[x][-1] for x in within if places.get(x)), default=0):
                shut(inner)
        elif block and places.get("p") and places["p"][-1] >= blocks[-1]:
            shut(places["p"][-1])
        here = stack[-1]
        if name in ("article", "main") and not here.marked and not getattr(here, name):
            tops[name] += 1
        if name not in VOID:
            new = Open(name, name if block else here.block, here.link or name == "a", here.marked or furniture(name, m[4] or m[7], here), here.article or name == "article", here.main or name == "main")
            places.setdefault(name, []).append(len(stack))
            if block:
                blocks.append(len(stack))
            stack.append(new)
            here = new
        out.append(Item(" " if name == "br" else None, name, here.marked, here.article, here.main, block))
    cut = _BEGUN.search(page, max(at, last + 1))
    words(page[at : cut.start() if cut else len(page)])
    return out, "article" if tops["article"] == 1 else "main" if not tops["article"] and tops["main"] == 1 else ""


def keyed(item: Item, holder: str) -> tuple[bool, str]:
    """Is it a tag, and its kind with its zone."""
    zone = "" if not holder else " in" if getattr(item, holder) else " out"
    return item.text is None or item.kind == "br", item.kind + zone


def guess(kind: str, tag: bool) -> float:
    """How likely content is before any page has been seen: sure inside a page's one article and outside of it; elsewhere by the element."""
    if kind.endswith((" in", " out")):
        return 0.97 if kind.endswith(" in") else 0.05
    if tag:
        return 0.85 if kind in TEXTUAL else 0.5
    return 0.3 if kind.endswith(" a") and not kind.startswith("p ") else 0.9


def weight(kind: str, tag: bool, inside: int, outside: int) -> float:
    p = (inside + GUESS_COUNT * guess(kind, tag)) / (inside + outside + GUESS_COUNT)
    return -max(LEAST_TAG, TAG * (1 - p)) if tag else 2 * p - 1


def tallies(page: str) -> Counter:
    """(tag or not, kind, inside or not) of a page that labels itself, with and without its zone."""
    found, out = items(page), Counter()
    if found[1]:
        for item in found[0]:
            if not item.marked:
                tag, kind = keyed(item, found[1])
                n = 1 if tag else len(item.text.split())
                for k in (kind, item.kind):
                    out[tag, k, getattr(item, found[1])] += n
    return out


Weights = dict[tuple[bool, str], float]


def main_text(page: str | None, weights: Weights) -> str:
    """The text of the best region: blocks by line feeds."""
    if not page:
        return ""
    found, holder = items(page)
    best, begin, end = 0.0, 0, 0
    total, start = 0.0, 0
    for i, item in enumerate(found):
        if item.marked:
            continue
        tag, kind = keyed(item, holder)
        w = weights.get((tag, kind))
        if w is None:
            w = weights[tag, kind] = weight(kind, tag, 0, 0)
        if total <= 0:
            total, start = 0.0, i
        total += w if tag else w * len(item.text.split())
        if total > best + 1e-9:
            best, begin, end = total, start, i + 1
    blocks, now = [], []
    for item in found[begin:end]:
        if item.breaks and now:
            blocks.append(" ".join("".join(now).split()))
            now = []
        if item.text is not None and not item.marked:
            now.append(html.unescape(item.text))
    blocks.append(" ".join("".join(now).split()))
    return "\n".join(b for b in blocks if b)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = Counter()
        for page in batch.column(0).to_pylist():
            found.update(tallies(page))
        if found:
            yield pa.record_batch({"tag": [k[0] for k in found], "kind": [k[1] for k in found], "inside": [k[2] for k in found], "n": pa.array(found.values(), pa.int64())})


def learned(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> Weights:
    """The weights, from at most SAMPLE pages. Kinds are names of elements in BLOCKS; tags of other names count as one."""
    own = pages.where(F.length(html_col) > 0).select(F.xxhash64(id_col, url_col).alias("k"), F.col(html_col).alias("page"))
    last = own.select("k").distinct().orderBy("k").limit(SAMPLE).agg(F.max("k")).first()[0]
    if last is None:
        return {}
    found = own.where(F.col("k") <= last).dropDuplicates(["k"]).select("page").mapInArrow(released(counted), "tag boolean, kind string, inside boolean, n long")
    # Names that no page has in common teach nothing; the most frequent ones bound what comes to the driver.
    rows = found.groupBy("tag", "kind").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("i"), F.sum(F.when(~F.col("inside"), F.col("n")).otherwise(0)).alias("o")).orderBy(F.desc(F.col("i") + F.col("o")), "tag", "kind").limit(SAMPLE).collect()
    return {(r["tag"], r["kind"]): weight(r["kind"], r["tag"], r["i"], r["o"]) for r in rows}


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    small_batches(pages.sparkSession)
    weights = learned(pages, id_col, url_col, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, weights) for page in batch.column(2).to_pylist()]
            yield pa.record_batch({"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    id_type = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(released(run), f"page_id {id_type}, url string, text string, n_chars long")

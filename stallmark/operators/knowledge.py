"""Chipsets and models by name: dictionaries that come as tables, met in texts by one automaton a block."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scan

# Words of chip makers, words that make a bare model number a chip, and makers that digits may follow at once.
VENDORS = r"snapdragon|dimensity|helio|exynos|unisoc|tensor|bionic|mediatek|qualcomm|apple"
CONTEXT = r"processor|chipset|cpu|octa[- ]?core|quad[- ]?core|soc\b|ghz|snapdragon|dimensity|helio|exynos|unisoc|tensor|bionic"
GLUED = r"(snapdragon|dimensity|helio|exynos|unisoc|tensor)(\d)"
#: How far from a chip's name its context may stand.
REACH = 70
# The least benchmark of each tier.
TIERS = [(1300000, "flagship"), (700000, "upper-midrange"), (400000, "midrange"), (250000, "budget")]


def perf_tier(antutu: Column) -> Column:
    out = F.when(antutu >= TIERS[0][0], TIERS[0][1])
    for least, name in TIERS[1:]:
        out = out.when(antutu >= least, name)
    return F.when(antutu.isNotNull(), out.otherwise("entry"))


def phrase_hits(texts: DataFrame, phrases: DataFrame, split: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``texts`` (text, ...) with the columns of ``phrases`` (phrase, ...) that stand in them as consecutive words.

    Words are what ``split`` divides. Every text is read once by the dictionary's automaton.
    """
    def spaced(c: str) -> Column:
        return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.col(c)), split, " ")), F.lit(" "))

    known = phrases.withColumn("_phrase", spaced("phrase")).where(F.length("_phrase") > 2)
    found = scan.hits(texts.select(*keep, spaced("text").alias("_text")), keep, "_text", known, "_phrase")
    return found.join(known, "_phrase").drop("_phrase")


_VENDORS, _CONTEXT, _GLUED = re.compile(VENDORS), re.compile(CONTEXT, re.I), re.compile(GLUED)


def _inside_word(text: str, at: int) -> bool:
    return 0 <= at < len(text) and ("a" <= text[at] <= "z" or "0" <= text[at] <= "9")


def _best_alias(names: list[str], aliases: list[list[str]]) -> Callable[[str, scan.Places], list[tuple]]:
    """(name, whether it is ambiguous) of the longest name that holds in a lowered text; of equals the first in the list."""
    turn = {i: n for n, i in enumerate(sorted(range(len(names)), key=lambda i: -len(names[i])))}

    def told(text: str, places: scan.Places) -> list[tuple]:
        hay = f" {_GLUED.sub(r'\1 \2', re.sub('[_/]+', ' ', text))} "
        found = places(hay)
        for i in sorted(found, key=turn.__getitem__):
            at, stop = found[i], found[i] + len(names[i])
            whole = not _inside_word(hay, at - 1) and not _inside_word(hay, stop)
            if whole and (_VENDORS.search(names[i]) or _CONTEXT.search(hay[max(0, at - REACH) : stop + REACH])):
                said = next((a for a in aliases[i] if a in text), "")
                return [(names[i], not _VENDORS.search(said))]
        return []

    return told


def match_chips(texts: DataFrame, chips: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, soc_name, antutu, has5g, ambiguous): the chip whose longest alias stands in a text as whole words.

    ``chips`` (ord, soc_name, antutu, has5g, aliases). Each alias is looked at where it first occurs; one without a
    maker's word needs other words about chips near it. ``ambiguous``: the first of the chip's aliases in the text has no maker's
    word. A text is read once for each block of the dictionary, and no text moves.
    """
    rows = texts.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("_text"))
    named = chips.select("ord", "aliases", F.explode("aliases").alias("phrase")).where(F.length("phrase") > 0).groupBy("phrase").agg(F.min(F.struct("ord", "aliases")).alias("c"))
    hits = None
    for block in scan.blocks(named, "phrase"):
        known = sorted(block.collect(), key=lambda r: (r["c"]["ord"], r["c"]["aliases"].index(r["phrase"])))
        names, aliases = [r["phrase"] for r in known], [r["c"]["aliases"] for r in known]
        part = scan.scanned(rows, ["id"], "_text", names, _best_alias(names, aliases), {"phrase": "string", "ambiguous": "boolean"})
        hits = part if hits is None else hits.unionByName(part)
    hits = hits.join(named.select("phrase", "c.ord"), "phrase").groupBy("id").agg(F.min(F.struct(-F.length("phrase"), "ord", "ambiguous")).alias("b"))
    return hits.select("id", "b.ord", "b.ambiguous").join(chips.select("ord", "soc_name", "antutu", "has5g"), "ord").select("id", "soc_name", "antutu", "has5g", "ambiguous")


def exact_chips(names: DataFrame, chips: DataFrame, id_col: str = "id", name_col: str = "name") -> DataFrame:
    """(id, soc_name, antutu): the chip of exactly this name, else the first with exactly this alias."""
    asked = names.select(F.col(id_col).alias("id"), F.trim(F.regexp_replace(F.lower(F.col(name_col)), r"\s+", " ")).alias("key")).where("key <> ''")
    named = chips.select("ord", "soc_name", "antutu", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("turn"), F.lower("soc_name").alias("key"))), F.transform("aliases", lambda a: F.struct(F.lit(1).alias("turn"), a.alias("key"))))).alias("k"))
    hits = asked.join(named.select("ord", "soc_name", "antutu", "k.turn", "k.key"), "key")
    return hits.groupBy("id").agg(F.min_by(F.struct("soc_name", "antutu"), F.struct("turn", "ord")).alias("c")).select("id", "c.soc_name", "c.antutu")


def lookup_models(texts: DataFrame, models: DataFrame, id_col: str = "id", title_col: str = "title", slug_col: str = "slug") -> DataFrame:
    """(id, model, found_in): the model whose longest key or alias stands in the title as whole words, else in the URL's words.

    ``models`` (ord, model, keys).
    """
    phrases = models.select("ord", "model", F.explode("keys").alias("phrase"))
    both = texts.select(F.col(id_col).alias("id"), F.explode(F.array(F.struct(F.lit("title").alias("found_in"), F.lit(0).alias("turn"), F.col(title_col).alias("text")), F.struct(F.lit("url").alias("found_in"), F.lit(1).alias("turn"), F.col(slug_col).alias("text")))).alias("t")).select("id", "t.*")
    hits = phrase_hits(both, phrases, "[^a-z0-9+]+", ["id", "found_in", "turn"])
    return hits.groupBy("id").agg(F.min_by(F.struct("model", "found_in"), F.struct("turn", -F.length("phrase"), "ord")).alias("m")).select("id", "m.model", "m.found_in")

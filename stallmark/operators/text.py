"""Text operators: product classes, dictionary matches, pages to text, review clauses and aspects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.maths import jround
from ..functions.parse import matches


def product_head(title: Column) -> Column:
    """What comes before a bar, if that says enough, at most 90 characters."""
    head = F.substring_index(title, "|", 1)
    return F.substring(F.when(F.length(head) >= 12, head).otherwise(title), 1, 90)


def rule_scores(c: Column, rules: list[tuple[str, list[str], list[str], list[str]]], strong: int = 3, weak: int = 1, head: Column | None = None, by_head: set[str] | None = None) -> Column:
    """(score, -place, name) of each rule: its strong and weak patterns that match, nothing if a veto matches the head.

    Strong patterns of the rules ``by_head`` look at the head alone.
    """
    out = []
    head = c if head is None else head
    for i, (name, yes, maybe, no) in enumerate(rules):
        seen = head if by_head and name in by_head else c
        score = sum((matches(seen, p).cast("int") * strong for p in yes), F.lit(0)) + sum((matches(c, p).cast("int") * weak for p in maybe), F.lit(0))
        veto = F.greatest(*(matches(head, p) for p in no), F.lit(False)) if no else F.lit(False)
        out.append(F.struct(F.when(veto, 0).otherwise(score).alias("score"), F.lit(-i).alias("place"), F.lit(name).alias("name")))
    return F.sort_array(F.array(*out), asc=False)


def classified(df: DataFrame, c: Column, rules: list, head: Column | None = None, by_head: set[str] | None = None) -> DataFrame:
    """Adds category and category_confidence; the first rule wins a tie, none that scores is unknown."""
    out = df.withColumn("_rules", rule_scores(c, rules, head=head, by_head=by_head))
    top, second = F.col("_rules")[0], F.col("_rules")[1]
    margin = (top["score"] - second["score"]) / F.greatest(top["score"], F.lit(1))
    sure = F.least(F.lit(1.0), F.least(top["score"], F.lit(6)) / 6 * 0.6 + margin * 0.4)
    return out.withColumn("category", F.when(top["score"] > 0, top["name"]).otherwise("unknown")).withColumn("category_confidence", F.when(top["score"] > 0, jround(sure, 2)).otherwise(0.0)).drop("_rules")


def longest_match(texts: DataFrame, id_col: str, text_col: str, phrases: DataFrame) -> DataFrame:
    """(id, phrase) the longest dictionary phrase that a text holds as whole words, the first in order on a tie."""
    from .knowledge import phrase_hits

    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    hits = phrase_hits(rows, phrases.select(F.lower("phrase").alias("phrase")).distinct(), r"[^\p{L}\p{N}]+", ["id"])
    return hits.groupBy("id").agg(F.min_by("phrase", F.struct(-F.length("phrase"), "phrase")).alias("phrase"))


def html_to_text(c: Column) -> Column:
    """Text of a page: no scripts, styles or tags, four entities, numbered ones as spaces, white space squeezed."""
    out = F.regexp_replace(c, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", " ")
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"&#\d+;", " "), r"\s+", " "))


def clauses(c: Column) -> Column:
    """Clauses of a review of more than two characters."""
    return F.filter(F.transform(F.split(c, r"[.!?,;]+|\b(?:and|but)\b"), lambda x: F.trim(x)), lambda x: F.length(x) > 2)


def aspects(reviews: DataFrame, id_col: str, text_col: str, rules: list[tuple[str, str]], positive: str, negative: str, negation: str, inherent: tuple[str, ...] = ()) -> DataFrame:
    """(aspect, positive, negative, example): clauses that name an aspect, by polarity; a negation turns it round."""
    spoken = reviews.select(F.col(id_col).alias("id"), F.posexplode(clauses(F.lower(text_col))).alias("pos", "clause"))
    named = spoken.select("id", "pos", "clause", F.explode(F.array_compact(F.array(*(F.when(matches(F.col("clause"), p), F.lit(a)) for a, p in rules)))).alias("aspect"))
    c, turned = F.col("clause"), matches(F.col("clause"), negation)
    good, bad = matches(c, positive), matches(c, negative)
    side = F.when(good & ~bad, F.when(turned, -1).otherwise(1)).when(bad & ~good, F.when(turned, 1).otherwise(-1)).otherwise(0)
    side = F.when(F.col("aspect").isin(*inherent) & (side == 0), -1).otherwise(side) if inherent else side
    told = named.withColumn("side", side).where(F.col("side") != 0)
    return told.groupBy("aspect").agg(F.count_if(F.col("side") > 0).alias("positive"), F.count_if(F.col("side") < 0).alias("negative"), F.substring(F.min_by("clause", F.struct("id", "pos")), 1, 70).alias("example"))


def token_overlap(a: Column, b: Column, stop: list[str]) -> Column:
    """How many words of a (over two letters, no stop words) are among those of b."""
    def words(c):
        return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: (F.length(w) > 2) & ~w.isin(*stop))

    # b's words are bound once a row; named in the inner function, they would be made again for each word of a.
    counts = F.transform(F.array(F.array_distinct(words(b))), lambda other: F.size(F.filter(words(a), lambda w: F.array_contains(other, w))))
    return F.get(counts, F.lit(0))

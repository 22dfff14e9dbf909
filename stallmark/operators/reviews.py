"""What the reviews of a product say: aspects by clauses, praised and complained of, with the ratings' histogram."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pages

# Aspects with the words that name them, in the order in which they are looked for.
ASPECTS = [
    ("battery", r"\b(battery|backup|charg\w*|drain\w*|power\s*bank)\b"),
    ("heating", r"\b(heat\w*|hot|overheat\w*|temperature|warm)\b"),
    ("camera", r"\b(camera|photo\w*|picture\w*|selfie|video|lens|clarity)\b"),
    ("display", r"\b(display|screen|brightness|bright|touch|refresh)\b"),
    ("performance", r"\b(performance|speed|fast|slow|lag\w*|hang\w*|gaming|game|processor|smooth)\b"),
    ("build", r"\b(build|design|look\w*|premium|plastic|sturdy|weight|heavy)\b"),
    ("sound", r"\b(sound|speaker\w*|audio|volume|mic|call\s*quality)\b"),
    ("software", r"\b(ads|bloatware|software|update\w*|ui|android|app\w*)\b"),
    ("service", r"\b(service|warranty|replace\w*|defective|damaged|return|delivery)\b"),
    ("value", r"\b(price|budget|worth|value|money|cheap|expensive)\b"),
]
# Words of praise, of blame and of negation, and aspects that are named to complain of.
POSITIVE = r"\b(good|great|nice|best|excellent|amazing|awesome|superb|fabulous|love\w*|wow|perfect|satisfied|happy|smooth|fast|strong|clear|beautiful|worth|recommend\w*)\b"
NEGATIVE = r"\b(bad|poor|worst|worse|issue\w*|problem\w*|slow|lag\w*|drain\w*|heat\w*|hot|defective|damaged|waste|disappoint\w*|useless|cheap|weak|dull|blur\w*|hang\w*|too\s*much|not\s*worth)\b"
NEGATION = r"\b(not|no|never|isn'?t|doesn'?t|don'?t|can'?t|won'?t|without)\b"
INHERENT = ("heating",)
#: Where a clause ends.
BREAKS = r"(?i)[.!?,;]+|\band\b|\bbut\b"
#: Stars from which a clause that says neither good nor bad counts as praise, and down from which as blame.
LIKED, DISLIKED = 4, 2
#: The longest clause that is an example, and mentions that decide an aspect together with twice the other side's.
EXAMPLE, DECISIVE = 70, 2
#: Bytes of pages that a task cuts at a time.
HELD = 8_000_000


def _hit(clause: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(clause, pattern, ignore_case=True).to_numpy(zero_copy_only=False).astype(bool)


def _mined(texts: pa.Array, stars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Mentions of reviews, in order: place of the review, of the clause in it, of the aspect; side; clause.

    Each pattern meets a distinct clause once, in time linear in it (RE2, over Arrow columns).
    """
    parts = pc.split_pattern_regex(texts, BREAKS)
    row, clause = pc.list_parent_indices(parts), pc.utf8_trim(pc.list_flatten(parts), " ")
    long = pc.greater(pc.utf8_length(clause), 2)
    row, clause = row.filter(long).to_numpy(), clause.filter(long)
    at = np.arange(len(row)) - np.searchsorted(row, row)

    coded = clause.dictionary_encode()
    which = np.flatnonzero(_hit(coded.dictionary, "|".join(p for _, p in ASPECTS)))
    distinct = coded.dictionary.take(pa.array(which))
    good, bad, denied = (_hit(distinct, p) for p in (POSITIVE, NEGATIVE, NEGATION))
    praise, blame = np.where(denied, bad, good), np.where(denied, good, bad)
    # By distinct clause and aspect: whether it is named there, and the side; 0 where the stars decide.
    named, taken = np.zeros((len(coded.dictionary), len(ASPECTS)), bool), np.zeros((len(coded.dictionary), len(ASPECTS)), np.int32)
    for turn, (aspect, pattern) in enumerate(ASPECTS):
        inherent = ~denied if aspect in INHERENT else np.zeros(len(denied), bool)
        named[which, turn] = _hit(distinct, pattern)
        taken[which, turn] = (praise & ~inherent).astype(np.int32) - (blame | inherent)

    code = coded.indices.to_numpy()
    place, turn = np.nonzero(named[code])
    told = np.where(stars >= LIKED, 1, np.where(stars <= DISLIKED, -1, 0))
    side = taken[code[place], turn]
    side = np.where(side == 0, told[row[place]], side).astype(np.int32)
    place, turn, side = place[side != 0], turn[side != 0], side[side != 0]
    return row[place], at[place].astype(np.int32), turn.astype(np.int32), side, clause.take(pa.array(place))


def mentions(rows: DataFrame) -> DataFrame:
    """(key, ord, pos, at, turn, aspect, side, clause) of reviews (key, ord, pos, stars, text): clauses that name an aspect and take a side.

    A negation turns praise and blame round; an inherent complaint is one unless negated; where a clause says both or neither,
    the review's stars decide, and those between leave it out. ``ord``, ``pos``, ``at`` and ``turn`` tell which was said first.
    """
    said = rows.select("key", "ord", "pos", "stars", "text")
    schema = T.StructType([*said.schema.fields[:3], *T.StructType.fromDDL("at int, turn int, aspect string, side int, clause string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, turn, side, clause = _mined(batch.column("text"), batch.column("stars").to_numpy(zero_copy_only=False))
            kept = batch.select(["key", "ord", "pos"]).take(pa.array(row))
            aspect = pa.array([a for a, _ in ASPECTS]).take(pa.array(turn))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(at), pa.array(turn), aspect, pa.array(side), clause], names=schema.names)

    return said.mapInArrow(run, schema)


def _held(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of pages in slices of a page and less than HELD bytes more."""
    block = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // HELD
    for a, b in pairwise([0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]):
        yield batch.slice(a, b - a)


def _firsts(group: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` groups comes first; -1 where nowhere."""
    which, first = np.unique(group, return_index=True)
    out = np.full(n, -1)
    out[which] = first
    return out


def heard(review_pages: DataFrame) -> DataFrame:
    """What each page (key, ord, text) of reviews says, by one pass over it: a row for the page, without a ``turn``, and one for each aspect on which it takes a side.

    The page's has total_ratings, total_reviews, counts (ratings by star) and sampled (its reviews); an aspect's has positive and
    negative (clauses), the first clause that is short enough (example, with its places example_pos and example_at), and the places
    pos and at of the first mention. Of equal reviews that a task holds at a time one is read, for all of them.
    """
    rows = review_pages.select("key", "ord", "text")
    schema = T.StructType([*rows.schema.fields[:2], *T.StructType.fromDDL("turn int, positive long, negative long, example string, example_pos int, example_at int, pos int, at int, total_ratings long, total_reviews long, counts array<long>, sampled long")])

    def told(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [pages.plain(t) for t in batch.column("text").to_pylist()]
        cut = [pages.cut(t) for t in texts]
        distinct: dict[str, int] = {}
        code = np.array([distinct.setdefault(r, len(distinct)) for rs in cut for r in rs], np.int64)
        sampled = np.array([len(rs) for rs in cut], np.int64)
        row, at, turn, side, clause = _mined(pa.array([pages.said(r) for r in distinct], pa.string()), np.array([float(r[:3]) for r in distinct]))

        # The mentions of a distinct review stand side by side; each time that it is in a page they are taken from there on.
        n = np.bincount(row, minlength=len(distinct))
        start, n = (np.cumsum(n) - n)[code], n[code]
        m = np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)
        page = np.repeat(np.repeat(np.arange(len(cut)), sampled), n)
        pos = np.repeat(np.arange(len(code)) - np.repeat(np.cumsum(sampled) - sampled, sampled), n)
        short = pc.less_equal(pc.utf8_length(clause), EXAMPLE).to_numpy(zero_copy_only=False).astype(bool)[m]
        at, turn, side = at[m], turn[m], side[m]

        named, group = np.unique(page * len(ASPECTS) + turn, return_inverse=True)
        first = _firsts(group, len(named))
        example = _firsts(np.where(short, group, len(named)), len(named) + 1)[:-1]
        none = example < 0

        def ints(values: np.ndarray, where: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
            return pa.array(values[where].astype(np.int32), mask=mask)

        def tally(sign: int) -> pa.Array:
            return pa.array(np.bincount(group, side == sign, len(named)).astype(np.int64))

        aspects = [ints(turn, first), tally(1), tally(-1), clause.take(pa.array(m[example], mask=none)), ints(pos, example, none), ints(at, example, none), ints(pos, first), ints(at, first)]
        totals = [pages.totals(t) for t in texts]
        itself = [pa.array([t[0] for t in totals], pa.int64()), pa.array([t[1] for t in totals], pa.int64()), pa.array([pages.counts(t) for t in texts], pa.list_(pa.int64())), pa.array(sampled)]
        kept = batch.select(["key", "ord"]).take(pa.array(np.concatenate([np.arange(len(cut)), page[first]])))
        more = [pa.concat_arrays([pa.nulls(len(cut), v.type), v]) for v in aspects] + [pa.concat_arrays([v, pa.nulls(len(named), v.type)]) for v in itself]
        return pa.RecordBatch.from_arrays([*kept.columns, *more], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from map(told, _held(batch))

    return rows.mapInArrow(run, schema)


def _tally() -> list[Column]:
    """Aggregates of what ``heard`` says of an aspect: sums, the first clause that is short enough, and the first mention of all."""
    short = F.when(F.col("example").isNotNull(), F.struct("ord", "example_pos", "example_at"))
    return [F.sum("positive").alias("positive"), F.sum("negative").alias("negative"), F.min_by("example", short).alias("example"), F.min(F.struct("ord", "pos", "at", "turn")).alias("first")]


def _aspect() -> Column:
    return F.get(F.array(*(F.lit(a) for a, _ in ASPECTS)), F.col("turn"))


def tallies(review_pages: DataFrame) -> DataFrame:
    """(key, aspect, positive, negative, example, first) of pages (key, ord, text) of reviews: ``mentions`` summed up by aspect."""
    rows = heard(review_pages).where(F.col("turn").isNotNull()).groupBy("key", "turn").agg(*_tally())
    return rows.select("key", _aspect().alias("aspect"), "positive", "negative", "example", "first")


def _won(a: Column, side: str, other: str) -> Column:
    return (a[side] >= DECISIVE) & (a[side] >= 2 * a[other])


def summaries(review_pages: DataFrame) -> DataFrame:
    """Per product what its pages (key, ord, text) of reviews say.

    (key, total_ratings, total_reviews, distribution, negative_share, sampled, aspects, praised, complained). Totals and the
    histogram are the first page's that has them, reviews are of all pages. Aspects come with their tallies and an example, the most
    mentioned first and of equals the one named first. Nothing but sums and firsts moves, so that a product of any number of
    reviews is no task's burden. A null text says nothing.
    """
    facts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c) for c in ("total_ratings", "total_reviews", "counts")]
    rows = heard(review_pages).groupBy("key", "turn").agg(*_tally(), *facts, F.sum("sampled").alias("sampled"))
    order = F.struct((-(F.col("positive") + F.col("negative"))).alias("n"), F.col("first"), F.struct(_aspect().alias("aspect"), "positive", "negative", "example").alias("a"))
    # A key has one row without a turn, which alone has facts, and at most one for each aspect.
    aspects = F.transform(F.sort_array(F.collect_list(F.when(F.col("turn").isNotNull(), order))), lambda x: x["a"])
    rows = rows.groupBy("key").agg(*(F.max(c).alias(c) for c in ("total_ratings", "total_reviews", "counts", "sampled")), aspects.alias("aspects"))
    stars = F.col("distribution")
    share = (stars[1] + stars[2]) / F.greatest(F.lit(1), reduce(lambda a, b: a + b, (stars[s] for s in range(1, 6))))
    out = rows.withColumn("distribution", F.map_from_arrays(F.array(*(F.lit(s) for s in range(1, 6))), F.col("counts")))
    out = out.select("key", "total_ratings", "total_reviews", "distribution", share.alias("negative_share"), "sampled", "aspects")
    return out.withColumns({"praised": F.filter("aspects", lambda a: _won(a, "positive", "negative")), "complained": F.filter("aspects", lambda a: _won(a, "negative", "positive"))})

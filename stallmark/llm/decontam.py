"""Benchmark decontamination over a distributed positional inverted index.

1. Benchmark items become windows of ``width`` consecutive words (a shorter item is one window).
2. One pass over the corpus counts the benchmark's terms. A window with a term that the corpus
   lacks cannot occur; of every other window the ``anchors`` rarest positions are chosen.
3. A second pass writes the index: for each anchor term and document, its word positions.
4. Each window's anchor lists are shifted by their offsets in the window and intersected, which
   leaves (window, document, start) candidates.
5. A last pass compares the candidates with the documents' words, all ``width`` of them, and marks
   the words that lie in an occurrence.

Proximity (``proximity``) looks for inserted, dropped, replaced and reordered words: a window is near where
one run of its length and ``slop`` words holds its distinct terms in any order, of eight to fifteen all but
one. Of its rarest terms, two more than may be lost, two must then lie in one run. Each text's positions of
these anchors are paired where it lies, with the windows' pairs at hand in blocks of at most ``WINDOW_BLOCK``;
the last pass tries all runs about the pairs that meet.

Terms are 64-bit digests of lower-cased words. Terms go to executors as sorted arrays of at most
``TERM_BLOCK`` numbers (8 MB); a benchmark with more is done in as many blocks.

Defined results: a null or wordless text has no words and no hits; a null or wordless item occurs
nowhere; repeated rows each get their row; rows that share an id but not a text are told apart; an
empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .shared import released, small_batches, written

#: Most terms that one broadcast array holds.
TERM_BLOCK = 1 << 20
#: Most windows whose anchors one broadcast holds.
WINDOW_BLOCK = 1 << 17
#: A near match may lack one distinct term for each so many that its window has.
PER_LOST = 8


class TermSet:
    """Which of many word digests belong to a sorted array of terms."""

    def __init__(self, terms: np.ndarray):
        self.terms = np.sort(terms.view(np.uint64))
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.terms >> np.uint64(44)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices into ``h`` that are terms, and which terms they are."""
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.seen[h >> np.uint64(44)])
        at = np.searchsorted(self.terms, h[maybe])
        ok = self.terms[np.minimum(at, len(self.terms) - 1)] == h[maybe]
        return maybe[ok], at[ok]


def _words(s: tb.Slice) -> tuple[tb.Words, np.ndarray, np.ndarray]:
    """Words, their digests, and the first word index of each row (one more than rows)."""
    data = tb.LOWER[s.data]
    w = tb.words(data, s.at, tb.ALNUM)
    return w, tb.hashes(data, w.start, w.end), np.searchsorted(w.row, np.arange(s.hi - s.lo + 1))


def windows(items: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(item_id, wid, terms): each item's windows as term digests."""
    schema = T.StructType([T.StructField("item_id", items.schema[id_col].dataType), T.StructField("terms", T.ArrayType(T.LongType()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in tb.slices(batch.column(1)):
                _, h, first = _words(s)
                rows, terms = [], []
                for r in range(s.hi - s.lo):
                    own = tb.signed(h[first[r] : first[r + 1]]).tolist()
                    cuts = [own[i : i + width] for i in range(max(1, len(own) - width + 1))] if own else []
                    rows += [s.lo + r] * len(cuts)
                    terms += cuts
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(terms, pa.list_(pa.int64()))], names=["item_id", "terms"])

    out = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).mapInArrow(released(cut), schema).distinct()
    return out.select("item_id", F.xxhash64("terms").alias("wid"), "terms")


def _blocks(terms: DataFrame) -> Iterator[np.ndarray]:
    """Distinct values of the column ``term``, at most about TERM_BLOCK at a time."""
    terms = terms.select("term").distinct()
    n = -(-terms.count() // TERM_BLOCK)
    for b in range(n):
        part = terms if n == 1 else terms.where(F.pmod(F.hash("term"), F.lit(n)) == b)
        yield part.toPandas()["term"].to_numpy(np.int64)


def term_counts(texts: DataFrame, terms: np.ndarray) -> DataFrame:
    """(term, n): how often each of ``terms`` occurs in the column ``text``; absent terms have no row."""
    given = texts.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = TermSet(given.value)
        n = np.zeros(len(known.terms), np.int64)
        for batch in batches:
            for s in tb.slices(batch.column(0)):
                data = tb.LOWER[s.data]
                w = tb.words(data, s.at, tb.ALNUM)
                n += np.bincount(known.find(tb.hashes(data, w.start, w.end))[1], minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(tb.signed(known.terms[some])), pa.array(n[some])], names=["term", "n"])

    return texts.select("text").mapInArrow(released(count), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def postings(texts: DataFrame, terms: np.ndarray) -> DataFrame:
    """(term, key, doc_id, positions): the word positions of each of ``terms`` in each text."""
    given = texts.sparkSession.sparkContext.broadcast(terms)
    schema = T.StructType([T.StructField("term", T.LongType()), T.StructField("key", T.LongType()), T.StructField("doc_id", texts.schema["doc_id"].dataType), T.StructField("positions", T.ArrayType(T.IntegerType()))])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = TermSet(given.value)
        for batch in batches:
            for s in tb.slices(batch.column("text")):
                w, h, first = _words(s)
                at, which = known.find(h)
                if not len(at):
                    continue
                row = w.row[at]
                order = np.lexsort((at, which, row))
                at, which, row = at[order], which[order], row[order]
                head = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (row[1:] != row[:-1])]))
                lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(at)), pa.int32()), pa.array((at - first[row]).astype(np.int32)))
                rows = pa.array(s.lo + row[head])
                yield pa.RecordBatch.from_arrays([pa.array(tb.signed(known.terms[which[head]])), batch.column("key").take(rows), batch.column("doc_id").take(rows), lists], names=["term", "key", "doc_id", "positions"])

    return texts.select("key", "doc_id", "text").mapInArrow(released(post), schema)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, doc_id, text), where the key tells apart rows that share an id."""
    id_, text = F.col(id_col), F.col(text_col)
    return docs.select(F.xxhash64(id_, text).alias("key"), id_.alias("doc_id"), text.alias("text"))


def _all(parts: list[DataFrame], empty: DataFrame) -> DataFrame:
    out = parts[0] if parts else empty
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def build_index(texts: DataFrame, wins: DataFrame, anchors: int) -> tuple[DataFrame, DataFrame]:
    """The written index of the windows' rarest terms, and (wid, terms, term, offset, wanted) of each anchor."""
    spark = texts.sparkSession
    spots = wins.select("wid", "terms").distinct().select("wid", "terms", F.posexplode("terms").alias("offset", "term"))
    counted = _all([term_counts(texts, b) for b in _blocks(spots)], spark.createDataFrame([], "term long, n long"))
    chosen = (
        spots.join(counted, "term")
        .groupBy("wid", "terms")
        .agg(F.sort_array(F.collect_list(F.struct("n", "offset", "term"))).alias("spots"))
        .where(F.size("spots") == F.size("terms"))
        .select("wid", "terms", F.slice("spots", 1, anchors).alias("spots"))
        .select("wid", "terms", F.size("spots").alias("wanted"), F.explode("spots").alias("spot"))
        .select("wid", "terms", "wanted", "spot.term", "spot.offset")
    )
    chosen = written(chosen, "anchors")
    nothing = postings(texts.limit(0), np.zeros(0, np.int64))
    return written(_all([postings(texts, b) for b in _blocks(chosen)], nothing), "postings"), chosen


def phrase_candidates(index: DataFrame, chosen: DataFrame) -> DataFrame:
    """(key, doc_id, wid, terms, starts): where all of a window's anchor lists agree on a start."""
    shifted = index.join(chosen.drop("terms"), "term").select("key", "doc_id", "wid", "wanted", "offset", F.expr("transform(positions, p -> p - offset)").alias("starts"))
    # Rows repeated whole post the same list once each; a set keeps one of them for an anchor.
    agreed = (
        shifted.groupBy("key", "doc_id", "wid", "wanted")
        .agg(F.collect_set(F.struct("offset", "starts")).alias("spots"))
        .withColumn("lists", F.col("spots.starts"))
        .where(F.size("lists") == F.col("wanted"))
        .select("key", "doc_id", "wid", F.expr("filter(aggregate(slice(lists, 2, size(lists)), lists[0], (a, b) -> array_intersect(a, b)), s -> s >= 0)").alias("starts"))
        .where(F.size("starts") > 0)
    )
    return agreed.join(chosen.select("wid", "terms").distinct(), "wid")


def lost(distinct: int) -> int:
    """How many of a window's distinct terms a near match may lack."""
    return distinct // PER_LOST


def near_anchors(texts: DataFrame, wins: DataFrame) -> DataFrame:
    """(wid, terms, term, wanted) of each distinct anchor of a window, written: two of them, or its only one, are in each near run."""
    spots = wins.select("wid", "terms").distinct().select("wid", "terms", F.explode(F.array_distinct("terms")).alias("term"))
    counted = _all([term_counts(texts, b) for b in _blocks(spots)], texts.sparkSession.createDataFrame([], "term long, n long"))
    spare = F.floor(F.size("spots") / PER_LOST).cast("int")
    chosen = (
        spots.join(counted, "term", "left")
        .groupBy("wid", "terms")
        .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term"))).alias("spots"))
        .where(F.size(F.filter("spots", lambda x: x["n"] == 0)) <= spare)
        .select("wid", "terms", F.least(F.size("spots"), F.lit(2)).alias("wanted"), F.explode(F.slice("spots", F.lit(1), spare + 2)).alias("spot"))
        .where("spot.n > 0")
        .select("wid", "terms", "wanted", "spot.term")
    )
    return written(chosen, "near-anchors")


class Pairs:
    """Windows by the pairs of their anchors, or by the only one."""

    def __init__(self, wid: np.ndarray, term: np.ndarray, wanted: np.ndarray, reach: np.ndarray):
        self.known = TermSet(np.unique(term))
        order = np.argsort(wid, kind="stable")
        wid, wanted, reach = wid[order], wanted[order], reach[order]
        which = np.searchsorted(self.known.terms, term[order].view(np.uint64))
        self.wid, head = np.unique(wid, return_index=True)
        self.reach = reach[head] if len(head) else reach
        self.most = int(reach.max(initial=0))
        size = np.diff(np.append(head, len(wid)))
        codes, owner = [], []
        for a in range(int(size.max(initial=0))):
            only = np.flatnonzero((size > a) & (wanted[head] == 1))
            codes.append(self.code(which[head[only] + a], which[head[only] + a]))
            owner.append(only)
            for b in range(a):
                both = np.flatnonzero((size > a) & (wanted[head] > 1))
                codes.append(self.code(which[head[both] + a], which[head[both] + b]))
                owner.append(both)
        codes, owner = np.concatenate([*codes, np.zeros(0, np.int64)]), np.concatenate([*owner, np.zeros(0, np.int64)])
        order = np.argsort(codes, kind="stable")
        self.codes, self.owner = codes[order], owner[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.bucket(self.codes)] = True

    def code(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.minimum(a, b) * len(self.known.terms) + np.maximum(a, b)

    @staticmethod
    def bucket(codes: np.ndarray) -> np.ndarray:
        return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)

    def find(self, at: np.ndarray, which: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices into ``at`` (ascending word places of anchors) where another follows within reach, and the windows."""
        found, windows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lag in range(self.most):
            i = np.arange(len(at) - lag)
            gap = at[lag:] - at[: len(at) - lag]
            i = i[(gap < self.most) & (row[lag:] == row[: len(at) - lag])]
            if not len(i):
                break
            # Two unlike anchors are a pair; an anchor with itself, the code of an only one, counts at lag 0 alone.
            i = i if lag == 0 else i[which[i] != which[i + lag]]
            codes = self.code(which[i], which[i + lag])
            maybe = self.seen[self.bucket(codes)]
            i, codes = i[maybe], codes[maybe]
            low, high = np.searchsorted(self.codes, codes), np.searchsorted(self.codes, codes, "right")
            n = high - low
            own = self.owner[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
            i = np.repeat(i, n)
            near = at[i + lag] - at[i] < self.reach[own]
            found.append(i[near])
            windows.append(own[near])
        return np.concatenate(found), np.concatenate(windows)


def _pair_blocks(chosen: DataFrame, slop: int) -> Iterator[Pairs]:
    """The windows of ``chosen``, at most about WINDOW_BLOCK at a time."""
    n = -(-chosen.select("wid").distinct().count() // WINDOW_BLOCK)
    for b in range(n):
        part = chosen if n == 1 else chosen.where(F.pmod(F.hash("wid"), F.lit(n)) == b)
        pdf = part.select("wid", "term", "wanted", (F.size("terms") + slop).alias("reach")).toPandas()
        yield Pairs(*(pdf[c].to_numpy(np.int64) for c in ("wid", "term", "wanted", "reach")))


def near_candidates(texts: DataFrame, pairs: Pairs) -> DataFrame:
    """(key, doc_id, wid, starts): each window's anchors that another of its anchors follows within a run's length."""
    given = texts.sparkSession.sparkContext.broadcast(pairs)
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("doc_id", texts.schema["doc_id"].dataType), T.StructField("wid", T.LongType()), T.StructField("starts", T.ArrayType(T.IntegerType()))])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = given.value
        for batch in batches:
            for s in tb.slices(batch.column("text")):
                w, h, first = _words(s)
                at, which = pairs.known.find(h)
                i, own = pairs.find(at, which, w.row[at])
                if not len(i):
                    continue
                row, place = w.row[at[i]], at[i]
                order = np.lexsort((place, own, row))
                row, own, place = row[order], own[order], place[order]
                fresh = np.concatenate([[True], (own[1:] != own[:-1]) | (row[1:] != row[:-1]) | (place[1:] != place[:-1])])
                row, own, place = row[fresh], own[fresh], place[fresh]
                head = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (row[1:] != row[:-1])]))
                lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(row)), pa.int32()), pa.array((place - first[row]).astype(np.int32)))
                rows = pa.array(s.lo + row[head])
                yield pa.RecordBatch.from_arrays([batch.column("key").take(rows), batch.column("doc_id").take(rows), pa.array(pairs.wid[own[head]]), lists], names=["key", "doc_id", "wid", "starts"])

    return texts.select("key", "doc_id", "text").mapInArrow(released(meet), schema)


def _exact(own: np.ndarray, terms: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The word indices that lie in an occurrence of ``terms`` at one of ``starts``."""
    starts = starts[(starts >= 0) & (starts + len(terms) <= len(own))]
    at = starts[:, None] + np.arange(len(terms))
    return at[(own[at] == terms).all(1)].ravel()


def _near(own: np.ndarray, terms: np.ndarray, spots: np.ndarray, slop: int) -> np.ndarray:
    """The word indices that are terms in a run, about one of ``spots``, that holds enough of the distinct terms."""
    some, reach = np.unique(terms), min(len(terms) + slop, len(own))
    first = np.unique(np.clip((spots[:, None] - np.arange(reach)).ravel(), 0, len(own) - reach))
    at = first[:, None] + np.arange(reach)
    which = np.minimum(np.searchsorted(some, own[at]), len(some) - 1)
    known = some[which] == own[at]
    n = sum(((which == k) & known).any(1).astype(int) for k in range(len(some)))
    ok = n >= len(some) - lost(len(some))
    return at[ok][known[ok]]


def _verified(found: DataFrame, slop: int | None = None) -> DataFrame:
    """(key, doc_id, n_words, n_hit, wids) of rows (key, doc_id, text, cands); n_near and near too where ``slop`` is given."""
    more = [] if slop is None else [T.StructField("n_near", T.LongType()), T.StructField("near", T.ArrayType(T.LongType()))]
    schema = T.StructType([*found.schema.fields[:2], T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("wids", T.ArrayType(T.LongType())), *more])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cands = batch.column("cands")
            for s in tb.slices(batch.column("text")):
                _, h, first = _words(s)
                h, n = tb.signed(h), s.hi - s.lo
                hit, wids, n_near, near = np.zeros(n, np.int64), [], np.zeros(n, np.int64), []
                for r in range(n):
                    true, close = [], []
                    if (cand := cands[s.lo + r]).is_valid and len(cand):
                        own = h[first[r] : first[r + 1]]
                        mark, beside = np.zeros(len(own), bool), np.zeros(len(own), bool)
                        for c in cand.as_py():
                            terms, starts = np.array(c["terms"]), np.array(c["starts"])
                            if slop is not None:
                                if len(at := _near(own, terms, starts, slop)):
                                    close.append(c["wid"])
                                    beside[at] = True
                                starts = np.unique(starts[:, None] - np.arange(len(terms)))
                            if len(at := _exact(own, terms, starts)):
                                true.append(c["wid"])
                                mark[at] = True
                        hit[r], n_near[r] = mark.sum(), beside.sum()
                    wids.append(true)
                    near.append(close)
                lists = pa.list_(pa.int64())
                columns = [batch.column("key").slice(s.lo, n), batch.column("doc_id").slice(s.lo, n), pa.array(np.diff(first).astype(np.int64)), pa.array(hit), pa.array(wids, lists), pa.array(n_near), pa.array(near, lists)]
                yield pa.RecordBatch.from_arrays(columns[: len(schema)], names=schema.fieldNames())

    return found.mapInArrow(released(check), schema)


def _checked(texts: DataFrame, cands: DataFrame, slop: int | None = None) -> DataFrame:
    """The texts with their candidates verified, written."""
    cands = cands.groupBy("key", "doc_id").agg(F.collect_list(F.struct("wid", "terms", "starts")).alias("cands"))
    cands = cands.select(F.col("key").alias("ckey"), F.col("doc_id").alias("cdoc"), "cands")
    found = texts.join(cands, (F.col("key") == F.col("ckey")) & F.col("doc_id").eqNullSafe(F.col("cdoc")), "left").select("key", "doc_id", "text", "cands")
    return written(_verified(found, slop), "verified")


def _with_items(done: DataFrame, wins: DataFrame, wids: str, name: str) -> DataFrame:
    """Adds the ids of the items, sorted as strings, that the windows in ``wids`` belong to."""
    hits = (
        done.select("key", "doc_id", F.explode(wids).alias("wid"))
        .distinct()
        .join(wins.select("wid", "item_id").distinct(), "wid")
        .groupBy(F.col("key").alias("hkey"), F.col("doc_id").alias("hdoc"))
        .agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias(name))
    )
    return done.join(hits, (F.col("key") == F.col("hkey")) & F.col("doc_id").eqNullSafe(F.col("hdoc")), "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>"))).drop("hkey", "hdoc")


def contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10, anchors: int = 2) -> DataFrame:
    """Per document row: key, doc_id, n_words, n_hit, items (the ids of items that occur, sorted as strings)."""
    small_batches(docs.sparkSession)
    texts = keyed(docs, id_col, text_col)
    wins = written(windows(items, item_col, item_text_col, width), "windows")
    index, chosen = build_index(texts, wins, anchors)
    done = _checked(texts, phrase_candidates(index, chosen))
    return _with_items(done, wins, "wids", "items").select("key", "doc_id", "n_words", "n_hit", "items")


def proximity(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10, slop: int = 4) -> DataFrame:
    """The columns of ``contamination``, and n_near (words that are terms of a near window in its run) and near_items."""
    small_batches(docs.sparkSession)
    texts = keyed(docs, id_col, text_col)
    wins = written(windows(items, item_col, item_text_col, width), "windows")
    chosen = near_anchors(texts, wins)
    nothing = texts.limit(0).select("key", "doc_id", F.lit(0).cast("long").alias("wid"), F.array().cast("array<int>").alias("starts"))
    met = written(_all([near_candidates(texts, p) for p in _pair_blocks(chosen, slop)], nothing).distinct(), "near-candidates")
    done = _checked(texts, met.join(chosen.select("wid", "terms").distinct(), "wid"), slop)
    out = _with_items(_with_items(done, wins, "wids", "items"), wins, "near", "near_items")
    return out.select("key", "doc_id", "n_words", "n_hit", "items", "n_near", "near_items")


def proximity_matches(index: DataFrame, phrases: DataFrame, slop: int) -> DataFrame:
    """(key, doc_id, phrase_id, first, last) for the tightest place where all terms of a phrase lie within ``slop`` words.

    ``index`` as ``postings`` gives it; ``phrases`` (phrase_id, terms). Order does not matter; a term
    that a phrase holds twice needs one place. The sweep runs over each document's own positions only.
    """
    wanted = phrases.select("phrase_id", F.array_distinct("terms").alias("terms")).select("phrase_id", F.size("terms").alias("wanted"), F.explode("terms").alias("term"))
    spots = index.join(wanted, "term").groupBy("key", "doc_id", "phrase_id", "wanted").agg(F.collect_set(F.struct("term", "positions")).alias("lists")).where(F.size("lists") == F.col("wanted"))
    schema = T.StructType([*[spots.schema[c] for c in ("key", "doc_id", "phrase_id")], T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])

    def sweep(frames):
        for pdf in frames:
            rows = []
            for key, doc, phrase, lists in zip(pdf["key"], pdf["doc_id"], pdf["phrase_id"], pdf["lists"], strict=True):
                events = sorted((p, i) for i, x in enumerate(lists) for p in x["positions"])
                last: dict[int, int] = {}
                best = None
                for p, i in events:
                    last[i] = p
                    if len(last) == len(lists) and (best is None or p - min(last.values()) < best[1] - best[0]):
                        best = (min(last.values()), p)
                if best and best[1] - best[0] <= slop:
                    rows.append((key, doc, phrase, *best))
            yield type(pdf)(rows, columns=[f.name for f in schema])

    return spots.select("key", "doc_id", "phrase_id", "lists").mapInPandas(sweep, schema)

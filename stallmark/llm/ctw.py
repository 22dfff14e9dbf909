"""Context-tree weighting over bytes, trained and applied block by block.

The model. A text is its bytes and then its end, coded as a byte of its own (``END``, which UTF-8 never has). A byte
is eight binary decisions; each has a tree of contexts, which are the bytes before it, the nearest first,
down to ``DEPTH``. A node estimates its decision by Krichevsky-Trofimov counts of the
training texts and weighs its own estimate against the product of its children's, half and half:
P_w = (P_kt + prod P_w(child)) / 2. The weights that follow give a decision's probability as the mix of
estimates at all depths of its context; a text's score adds the logarithms. Before a text all bytes are ends.

The data flow. Texts are dealt by hash into blocks of about ``BLOCK_BYTES``. A first pass
takes from each block its distinct grams (DEPTH context bytes and the coded byte, 48 bits) with their training counts,
and its distinct words likewise. Counts are summed over blocks; grams that share their last
``ROOT`` + 1 context bytes meet in one task group, which has the whole subtree below; there are as many groups as the
grams need. Above are at most 257 contexts of 255 decisions, weighed together. A last pass streams each block's
grams and words with their values, and then its texts, through one task: it holds the block's distinct
grams and a slice of texts at a time.

Defined results: a null text is an empty one, which has its end alone, one token; with no training row
every decision is 1/2; repeated rows score alike; of very long texts a slice is held at a time; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .shared import dropped, released, small_batches, trim, written

DEPTH, ROOT = 5, 1
END = 0xFF
#: About so many bytes of text in a block, coded at once, and read at once.
BLOCK_BYTES, CODED, READ = 40 << 20, 1 << 17, 1 << 18
#: About so many distinct grams in a group, and at least so many groups.
GROUP, GROUPS = 1 << 17, 64
#: Kinds of rows in the exchange: grams, words, and texts.
GRAM, WORD, TEXT = 0, 1, 2


class Index:
    """A set of 64-bit keys with places, by open addressing in numpy arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(10, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = keys
        left = np.arange(len(keys))
        at = self._home(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & (len(self.slots) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for those that are not in."""
        at = self._home(keys)
        out = self.slots[at]
        left = np.flatnonzero((out >= 0) & (self.keys[out] != keys)) if len(self.keys) else np.zeros(0, np.int64)
        at = at[left]
        while len(left):
            at = (at + 1) & (len(self.slots) - 1)
            got = self.slots[at]
            out[left] = got
            more = (got >= 0) & (self.keys[got] != keys[left])
            left, at = left[more], at[more]
        return out


def ended(s: tb.Slice) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased bytes of a slice with each row's end, and where each row begins."""
    return np.insert(tb.LOWER[s.data], s.at[1:], END), s.at + np.arange(len(s.at))


def grams(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For some bytes at a time: their grams, which are the DEPTH bytes before, the nearest lowest, and in the lowest 8 bits the byte itself; and their rows."""
    for lo in range(0, len(data), CODED):
        here = np.arange(lo, min(lo + CODED, len(data)))
        row = np.searchsorted(at, here, "right") - 1
        room = here - at[row]
        out = data[here].astype(np.uint64)
        for d in range(1, DEPTH + 1):
            byte = np.full(len(here), END, np.uint64)
            byte[room >= d] = data[here[room >= d] - d]
            out |= byte << np.uint64(8 * d)
        yield out, row


def _words(s: tb.Slice) -> tuple[tb.Words, np.ndarray]:
    data = tb.LOWER[s.data]
    w = tb.words(data, s.at, tb.SPACED)
    return w, tb.hashes(data, w.start, w.end)


class _Tally:
    """Distinct keys with counts, for one block."""

    def __init__(self) -> None:
        self.index, self.n = Index(np.zeros(0, np.uint64)), np.zeros(0, np.int64)
        self.fresh: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, keys: np.ndarray, weight: np.ndarray) -> None:
        at = self.index.find(keys)
        known = at >= 0
        self.n += np.bincount(at[known], weight[known], minlength=len(self.n)).astype(np.int64)
        if not known.all():
            uniq, back = np.unique(keys[~known], return_inverse=True)
            self.fresh.append((uniq, np.bincount(back, weight[~known], minlength=len(uniq)).astype(np.int64)))
            self.waiting += len(uniq)
            if self.waiting > len(self.n) // 2:
                self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        if self.fresh:
            uniq, back = np.unique(np.concatenate([k for k, _ in self.fresh]), return_inverse=True)
            more = np.bincount(back, np.concatenate([n for _, n in self.fresh]), minlength=len(uniq)).astype(np.int64)
            self.index, self.n = Index(np.concatenate([self.index.keys, uniq])), np.concatenate([self.n, more])
            self.fresh, self.waiting = [], 0
        return self.index.keys, self.n


def _counted(blocks: DataFrame) -> DataFrame:
    """(block, kind, key, n): each block's distinct grams and words with their training counts."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = {GRAM: _Tally(), WORD: _Tally()}
        for batch in batches:
            train = np.array(batch.column("train").to_pylist(), np.int64)
            for s in tb.slices(batch.column("text"), READ):
                weight = train[s.lo : s.hi]
                for g, row in grams(*ended(s)):
                    tallies[GRAM].add(g, weight[row])
                w, h = _words(s)
                tallies[WORD].add(h, weight[w.row])
        for kind in (GRAM, WORD):
            keys, n = tallies.pop(kind).settle()
            for i in range(0, len(keys), 1 << 16):
                k = keys[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), key[0].as_py(), np.int32)), pa.array(np.full(len(k), kind, np.int32)), pa.array(tb.signed(k)), pa.array(n[i : i + (1 << 16)])], names=["block", "kind", "key", "n"])
        del keys, n
        trim()

    return blocks.select("block", "train", "text").groupBy("block").applyInArrow(run, "block int, kind int, key long, n long")


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x of 0.5 and more."""
    shift, y = np.zeros_like(x), x.astype(np.float64).copy()
    while (low := y < 8).any():
        shift[low] -= np.log(y[low])
        y[low] += 1
    return shift + (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)


def kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1.0) - 2 * _lgamma(np.array([0.5]))


class Level:
    """The nodes of one decision at one depth: keys, counts, and weighted probability."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        self.keys = keys
        own = kt(zeros, ones)
        self.log = own if below is None else np.logaddexp(own, below) - np.log(2)
        #: How much the node's own estimate weighs; all at the deepest.
        self.own = np.ones(len(keys)) if below is None else np.exp(own - np.log(2) - self.log)
        self.one = (ones + 0.5) / (zeros + ones + 1.0)


def subtree(gram: np.ndarray, n: np.ndarray, bit: int, top: int, bottom: int = DEPTH, below: np.ndarray | None = None, zeros=None) -> list[tuple[Level, np.ndarray]]:
    """Levels ``bottom`` up to ``top`` of decision ``bit`` over grams of training count n, with each gram's node."""
    node = (np.uint64(1) << np.uint64(bit)) | (gram & np.uint64(0xFF)) >> np.uint64(8 - bit)
    ones = n * ((gram >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.int64)
    zeros = n - ones
    out = []
    child: tuple[np.ndarray, np.ndarray] | None = None
    for d in range(bottom, top - 1, -1):
        context = (gram >> np.uint64(8)) & np.uint64((1 << 8 * d) - 1)
        keys, first, back = np.unique(context << np.uint64(8) | node, return_index=True, return_inverse=True)
        summed = None
        if child is not None:
            summed = np.bincount(back[child[0]], child[1], minlength=len(keys))
        level = Level(keys, np.bincount(back, zeros, len(keys)), np.bincount(back, ones, len(keys)), summed)
        child = (first, level.log)
        out.append((level, back))
    return out


def mixed(levels: list[tuple[Level, np.ndarray]]) -> np.ndarray:
    """For each gram the probability of a one, mixed over the levels from the deepest up."""
    p = None
    for level, back in levels:
        p = level.one[back] if p is None else level.own[back] * level.one[back] + (1 - level.own[back]) * p
    return p


def _weighed(counts: DataFrame) -> DataFrame:
    """(key, value) of rows (key, n), written: the base-10 logarithm of the probability of each gram's byte in its context."""
    table = written(counts, "grams")
    groups = max(GROUPS, table.count() // GROUP)
    group = F.pmod(F.hash(F.shiftright(F.col("key"), 8).bitwiseAND((1 << 8 * (ROOT + 1)) - 1)), F.lit(groups))
    given = table.withColumn("part", group)

    def lower(_, table):
        gram, n = table.column("key").to_numpy().view(np.uint64), table.column("n").to_numpy()
        out = []
        for bit in range(8):
            level, back = subtree(gram, n, bit, ROOT + 1)[-1]
            ones = n * ((gram >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.int64)
            out.append(pa.table({"node": pa.array(tb.signed(level.keys)), "zeros": np.bincount(back, n - ones, len(level.keys)).astype(np.int64), "ones": np.bincount(back, ones, len(level.keys)).astype(np.int64), "log": level.log}))
        trim()
        return pa.concat_tables(out)

    # Nodes of depth ROOT + 1 lose their farthest byte: at most 256 contexts of 255 nodes are left.
    nodes = given.groupBy("part").applyInArrow(lower, "node long, zeros long, ones long, log double")
    parents = nodes.groupBy(F.col("node").bitwiseAND((1 << 8 * (ROOT + 1)) - 1).alias("node")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("log").alias("below"))
    upper = parents.toPandas()
    top = counts.sparkSession.sparkContext.broadcast(_upper(*(upper[c].to_numpy() for c in ("node", "zeros", "ones", "below"))))

    def whole(_, table):
        gram, n = table.column("key").to_numpy().view(np.uint64), table.column("n").to_numpy()
        nodes, fixed, rest = top.value
        total = np.zeros(len(gram))
        for bit in range(8):
            deep = mixed(subtree(gram, n, bit, ROOT + 1))
            node = (np.uint64(1) << np.uint64(bit)) | (gram & np.uint64(0xFF)) >> np.uint64(8 - bit)
            key = (gram >> np.uint64(8) & np.uint64((1 << 8 * ROOT) - 1)) << np.uint64(8) | node
            at = np.searchsorted(nodes, key)
            one = fixed[at] + rest[at] * deep
            total += np.log10(np.where((gram >> np.uint64(7 - bit)) & np.uint64(1) == 1, one, 1 - one))
        trim()
        return pa.table({"key": table.column("key"), "value": total})

    out = written(given.groupBy("part").applyInArrow(whole, "key long, value double"), "values")
    dropped(table)
    return out


def _upper(node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted nodes of depth ROOT, and what depths 0 to ROOT add to a decision and leave to those below."""
    order = np.argsort(node)
    node, zeros, ones, below = node[order].astype(np.uint64), zeros[order], ones[order], below[order]
    level = Level(node, zeros, ones, below)
    fixed, rest = level.own * level.one, 1 - level.own
    back = np.arange(len(node))
    for d in range(ROOT - 1, -1, -1):
        key = (node >> np.uint64(8) & np.uint64((1 << 8 * d) - 1)) << np.uint64(8) | node & np.uint64(0xFF)
        keys, into = np.unique(key, return_inverse=True)
        first = np.unique(back, return_index=True)[1]
        up = Level(keys, np.bincount(into, zeros, len(keys)), np.bincount(into, ones, len(keys)), np.bincount(into[first], level.log, len(keys)))
        fixed, rest = up.own[into] * up.one[into] + (1 - up.own[into]) * fixed, (1 - up.own[into]) * rest
        level, back = up, into
    return node, fixed, rest


def scores(docs: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, train, n_bytes, n_tokens, n_known, log_known, train_tokens, train_words, score) of every row.

    ``log_known`` adds log10(c + 1) over the text's tokens of training count c; ``train_tokens`` and
    ``train_words`` count all and distinct training tokens, ends included.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    known = rows.agg(F.sum(F.octet_length("text")), F.count_if("train")).first()
    ends, n_blocks = known[1], (known[0] or 0) // BLOCK_BYTES + 1
    blocks = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int"))

    counts = written(_counted(blocks), "counts")
    words = written(counts.where(F.col("kind") == WORD).groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > 0), "words")
    total = words.agg(F.sum("n"), F.count("*")).first()
    values = _weighed(counts.where(F.col("kind") == GRAM).groupBy("key").agg(F.sum("n").alias("n")))
    # Words come with their counts.
    both = values.select(F.lit(GRAM).alias("kind"), "key", "value").unionByName(words.select(F.lit(WORD).alias("kind"), "key", F.col("n").cast("double").alias("value")))
    dealt = written(counts.select("block", "kind", "key").join(both, ["kind", "key"]).select("block", "kind", "key", "value"), "dealt")
    dropped(counts, words, values)

    end = float(np.log10(ends + 1))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("train", T.BooleanType()), *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_tokens", "n_known")], T.StructField("log_known", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def scored(texts: pa.RecordBatch, index: dict[int, Index], logs: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for s in tb.slices(texts.column("text"), READ):
            n = s.hi - s.lo
            score = np.zeros(n)
            for g, row in grams(*ended(s)):
                score += np.bincount(row, logs[GRAM][index[GRAM].find(g)], minlength=n)
            w, h = _words(s)
            at = index[WORD].find(h)
            held = np.bincount(w.row, at >= 0, minlength=n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([texts.column("doc_id").slice(s.lo, n), texts.column("train").slice(s.lo, n), pa.array(np.diff(s.at)), pa.array(np.bincount(w.row, minlength=n) + 1), pa.array(held + (ends > 0)), pa.array(np.bincount(w.row, logs[WORD][at], minlength=n) + end), pa.array(score)], names=schema.names)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, index, logs, parts = None, {}, {}, {}
        for batch in batches:
            block, kind = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(block)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(lo, hi - lo)
                if not part.num_rows:
                    continue
                if block[lo] != now:
                    now, index, logs, parts = block[lo], {}, {}, {GRAM: [], WORD: []}
                if kind[lo] != TEXT:
                    parts[kind[lo]].append((part.column("key").to_numpy().view(np.uint64).copy(), part.column("value").to_numpy().copy()))
                    continue
                for k in list(parts):
                    own = parts.pop(k)
                    index[k] = Index(np.concatenate([np.zeros(0, np.uint64), *(x for x, _ in own)]))
                    value = np.concatenate([*(v for _, v in own), np.zeros(1)])
                    logs[k] = np.log10(value + 1) if k == WORD else value
                yield from scored(part, index, logs)

    nothing = [F.lit(None).cast(rows.schema["doc_id"].dataType).alias("doc_id"), F.lit(None).cast("boolean").alias("train"), F.lit(None).cast("string").alias("text")]
    model = dealt.select("block", "kind", "key", "value", *nothing)
    texts = blocks.select("block", F.lit(TEXT).alias("kind"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("double").alias("value"), "doc_id", "train", "text")
    stream = model.unionByName(texts).repartition(n_blocks, "block").sortWithinPartitions("block", "kind")
    done = stream.mapInArrow(released(score), schema)
    return done.withColumn("train_tokens", F.lit((total[0] or 0) + ends)).withColumn("train_words", F.lit(total[1] + (1 if ends else 0)))

"""Best-fit packing of token sequences, improved by swap-based local search.

Texts become ids of a byte-level BPE, then one end id. A text's ids are cut into pieces of at most
``capacity``, counted from its end, so that only the first piece is shorter. Whole pieces fill a
sequence each. The others are dealt by hash into blocks of about ``BLOCK`` pieces, and each block is
packed on its own: best fit, longest first, and then local search over the underfull sequences. From
the emptiest one, pieces move, swap one for one or swap two for one into fuller ones as long as squared fill grows,
until no pair of sequences has such a step left. What a round of blocks leaves in underfull sequences goes through
a further round, until there is one block or a round saves nothing.

The tokenizer's added tokens count wherever their text stands, as ``tokenizers`` has them. Pre-tokens repeat, so a
worker keeps their ids by digest, at most ``KEPT`` of them.

Defined results: a null text is an empty one, which is its end id alone; of very long texts a slice and its ids are
held; rows that share an id or are repeated are packed each for itself; sequences that are alike are told apart by
number only; with no row there is no sequence; columns other than the two named are ignored.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .shared import released, small_batches, trim, written

#: About as many pieces in a block.
BLOCK = 16384
#: Most pre-tokens whose ids a worker keeps.
KEPT = 1 << 18

_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3
_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """For each code point: letter, number, white space or other, as the pre-tokenizer's pattern has them."""
    if not _kinds:
        out = np.full(0x110000, _OTHER, np.uint8)
        for c in range(0x110000):
            cat = unicodedata.category(chr(c))[0]
            if cat in "LN":
                out[c] = _LETTER if cat == "L" else _NUMBER
        out[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
        _kinds.append(out)
    return _kinds[0]


def pretokens(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """First bytes of all pre-tokens of a slice: '(s|t|re|ve|m|ll|d), ` ?letters`, ` ?numbers`, ` ?others`, white space."""
    if not len(data):
        return np.zeros(0, np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    byte = data[lead]
    point = byte.astype(np.int64)
    padded = np.append(data, np.zeros(3, np.uint8)).astype(np.int64)
    for low, high, size, mask in ((0xC0, 0xE0, 2, 0x1F), (0xE0, 0xF0, 3, 0x0F), (0xF0, 0xF8, 4, 0x07)):
        some = np.flatnonzero((byte >= low) & (byte < high))
        value = padded[lead[some]] & mask
        for k in range(1, size):
            value = value << 6 | padded[lead[some] + k] & 0x3F
        point[some] = value
    point = np.minimum(point, 0x10FFFF)
    kind = kinds()[point]
    n = len(lead)
    edge = np.zeros(n + 1, bool)
    edge[np.searchsorted(lead, at)] = True
    begin = np.ones(n, bool)
    begin[1:] = kind[1:] != kind[:-1]
    begin |= edge[:n]
    space = kind == _SPACE
    # The last of a run of white space goes with what follows if it is a plain space, else it stands alone.
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~edge[1:n]
    follows = np.flatnonzero(last) + 1
    begin[follows] = point[follows - 1] != 0x20
    begin[np.flatnonzero(last)] = True
    # A contraction counts where a pre-token would begin at its quote.
    if len(quotes := np.flatnonzero(point == 0x27)):
        bounds = np.append(edge[:n], True).nonzero()[0]
        ends = np.searchsorted(bounds, quotes, "right")
        for q, e in zip(quotes.tolist(), ends.tolist(), strict=True):
            if not begin[q]:
                continue
            after = "".join(map(chr, point[q + 1 : min(q + 3, int(bounds[e]))]))
            size = 2 if after[:2] in ("re", "ve", "ll") else 1 if after[:1] and after[0] in "stmd" else 0
            if size:
                begin[q + 1 : q + 1 + size] = False
                if q + 1 + size < n:
                    begin[q + 1 + size] = True
    return lead[begin]


class Tokens:
    """Ids of whole slices, pre-token by pre-token."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # The model alone: added tokens and pre-tokens are cut here.
        whole = Tokenizer.from_file(path)
        self.model = whole.model
        #: Longest first, as the tokenizer prefers them.
        self.added = dict(sorted(((t.content.encode(), i) for i, t in whole.get_added_tokens_decoder().items()), key=lambda x: -len(x[0])))
        self.pattern = re.compile(b"|".join(map(re.escape, self.added))) if self.added else None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        #: Byte-level vocabularies write each byte as a visible character.
        self.visible = dict(zip(shown + hidden, shown + list(range(256, 256 + len(hidden))), strict=True))
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.first = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)

    def learn(self, keys: np.ndarray, texts: list[bytes]) -> None:
        new = [[self.added[x]] if x in self.added else [t.id for t in self.model.tokenize(x.decode("latin-1").translate(self.visible))] for x in texts]
        count = np.concatenate([np.diff(self.first), [len(x) for x in new]])
        begin = np.concatenate([self.first[:-1], len(self.ids) + np.cumsum([0, *[len(x) for x in new]])[:-1]])
        flat = np.concatenate([self.ids, np.array([i for x in new for i in x], np.int32)])
        every = np.concatenate([self.keys, keys])
        order = np.argsort(every, kind="stable")
        self.keys, begin, count = every[order], begin[order], count[order]
        self.first = np.concatenate([[0], np.cumsum(count)])
        self.ids = flat[np.repeat(begin - self.first[:-1], count) + np.arange(self.first[-1])]

    def starts(self, s: tb.Slice) -> np.ndarray:
        """First bytes of all pre-tokens and added tokens. What stands between added tokens is cut as a text of its own."""
        found = [(m.start(), m.end()) for m in self.pattern.finditer(s.data.tobytes())] if self.pattern else []
        if found:
            first, last = np.array(found).T
            # Not across rows.
            inside = np.searchsorted(s.at, first, "right") == np.searchsorted(s.at, last, "left")
            first, last = first[inside], last[inside]
            start = pretokens(s.data, np.unique(np.concatenate([s.at, first, last])))
            within = np.searchsorted(first, start, "left") - 1
            return start[(within < 0) | (start >= np.append(last, 0)[within])]
        return pretokens(s.data, s.at)

    def encode(self, s: tb.Slice) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the slice, and how many each row has."""
        start = self.starts(s)
        end = np.append(start[1:], len(s.data))
        h = tb.hashes(s.data, start, end)
        uniq, where, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) > KEPT:
            self.clear()
        at = np.searchsorted(self.keys, uniq)
        fresh = np.flatnonzero((at >= len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != uniq)) if len(self.keys) else np.arange(len(uniq))
        if len(fresh):
            self.learn(uniq[fresh], [s.data[start[i] : end[i]].tobytes() for i in where[fresh]])
            at = np.searchsorted(self.keys, uniq)
        one = at[back] if len(uniq) else np.zeros(0, np.int64)
        count = self.first[one + 1] - self.first[one]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.repeat(self.first[one] - total[:-1], count) + np.arange(total[-1])]
        return ids, np.diff(total[np.searchsorted(start, s.at)])


_tokens: dict[str, Tokens] = {}


def pieces(docs: DataFrame, vocab_path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, row) of every text; ``row`` tells rows of one task apart."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "row")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocab_path not in _tokens:
            _tokens[vocab_path] = Tokens(vocab_path)
        tokens, row = _tokens[vocab_path], 0
        for batch in batches:
            for s in tb.slices(batch.column(1)):
                ids, count = tokens.encode(s)
                at, out = 0, []
                for r, n in enumerate(count.tolist()):
                    own = np.append(ids[at : at + n], end_id).astype("<u4")
                    at += n
                    cuts = [0, *range((n + 1) % capacity or capacity, n + 2, capacity)]
                    out += [(s.lo + r, k, a, b - a, zlib.crc32(own[a:b].tobytes()), row + r) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
                row += s.hi - s.lo
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[2:]]], names=schema.names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(released(run), schema)


def pack(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Sequences, as lists of indices into ``sizes``: best fit, longest first, then local search."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # by free space: sequences
    free: list[int] = []  # sorted free spaces that occur
    bins: list[list[int]] = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        k = bisect.bisect_left(free, n)
        if k < len(free):
            space = free[k]
            b = room[space].pop()
            if not room[space]:
                free.pop(k)
        else:
            space, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        space -= n
        if space:
            if not room[space]:
                bisect.insort(free, space)
            room[space].append(b)
    return search(bins, sizes, capacity)


def search(bins: list[list[int]], sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Local search over the underfull bins: each step makes squared fill larger, until no two of them have one left.

    Bins of the same sizes are alike: a step that one pair of them lacks, no other pair of their kind has.
    """
    size = sizes.tolist()
    alike: dict[tuple[int, ...], list[list[int]]] = {}
    done = []
    for b in bins:
        kind = tuple(sorted(size[i] for i in b))
        if sum(kind) < capacity:
            alike.setdefault(kind, []).append(b)
        else:
            done.append(b)
    stuck: set[tuple[tuple[int, ...], tuple[int, ...]]] = set()
    moved = True
    while moved:
        moved = False
        fill = {kind: sum(kind) for kind in alike}
        for poor in sorted(alike, key=lambda k: (fill[k], k)):
            for rich in sorted(alike, key=lambda k: (-sum(k), k)):
                while alike.get(poor) and alike.get(rich) and (poor, rich) not in stuck and (poor != rich or len(alike[poor]) > 1):
                    step = _step(poor, rich, capacity)
                    if step is None:
                        stuck.add((poor, rich))
                        break
                    moved = True
                    a, b = alike[poor].pop(), alike[rich].pop()
                    out, back = _taken(a, step[0], size), _taken(b, step[1], size)
                    for one in (a + back, b + out):
                        kind = tuple(sorted(size[i] for i in one))
                        if sum(kind) == capacity:
                            done.append(one)
                        elif one:
                            alike.setdefault(kind, []).append(one)
        alike = {kind: own for kind, own in alike.items() if own}
    return done + [b for own in alike.values() for b in own]


def _taken(b: list[int], wanted: list[int], size: list[int]) -> list[int]:
    """Pieces of the wanted sizes, taken out of ``b``."""
    out = []
    for n in wanted:
        out.append(b.pop(next(k for k, i in enumerate(b) if size[i] == n)))
    return out


def _step(poor: tuple[int, ...], rich: tuple[int, ...], capacity: int) -> tuple[list[int], list[int]] | None:
    """The sizes that go from poor to rich and those that come back, by which rich gains most and squared fill grows; or none.

    Distinct sizes in a bin are few: d of them fill d * (d + 1) / 2 at least.
    """
    gap = capacity - sum(rich)
    own = sorted(set(poor))
    best = (0, [], [])
    k = bisect.bisect_right(own, gap)
    if k:
        best = (own[k - 1], [own[k - 1]], [])
    if best[0] < gap:
        twice = {n for n in own if poor.count(n) > 1}
        pairs = sorted((x + y, x, y) for i, x in enumerate(own) for y in own[i:] if x != y or x in twice)
        sums = [p[0] for p in pairs]
        for back in sorted(set(rich)):
            # The largest of poor's, or pair of them, that this one can make way for.
            k = bisect.bisect_right(own, back + gap)
            if k and own[k - 1] - back > best[0]:
                best = (own[k - 1] - back, [own[k - 1]], [back])
            k = bisect.bisect_right(sums, back + gap)
            if k and sums[k - 1] - back > best[0]:
                best = (sums[k - 1] - back, [*pairs[k - 1][1:]], [back])
    # Squared fill grows by 2 * gain * (fill of rich - fill of poor + gain).
    gain, out, back = best
    return (out, back) if gain and sum(rich) - sum(poor) + gain > 0 else None


def pack_documents(docs: DataFrame, vocab_path: str, *, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    small_batches(docs.sparkSession)
    cut = written(pieces(docs, vocab_path, capacity, end_id, id_col, text_col), "pieces")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    # Whole pieces are numbered below zero by their place, the others from zero by round and block.
    out = cut.where(F.col("length") == capacity).select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = cut.where(F.col("length") < capacity).select(*names, "row")
    rest, turn, base, before = left.count(), 0, 0, None
    while True:
        blocks = max(1, -(-rest // BLOCK))
        packed = written(_packed(left, cut, names, blocks, capacity, base, turn), "packed")
        # Every sequence has one piece at its beginning.
        n, made = packed.agg(F.count_if(~F.col("full")), F.count_if(F.col("offset") == 0)).first()
        if before is not None and made >= before[1]:
            # This round has saved no sequence over the one before.
            return out.unionByName(before[0].drop("row", "full"))
        if blocks == 1:
            return out.unionByName(packed.drop("row", "full"))
        under = packed.where(~F.col("full"))
        out = out.unionByName(packed.where("full").drop("row", "full"))
        before = (under, under.where("offset = 0").count())
        left, rest, turn, base = under.select(*names, "row"), n, turn + 1, base + blocks * BLOCK * 4


def _packed(left: DataFrame, cut: DataFrame, names: list[str], blocks: int, capacity: int, base: int, turn: int) -> DataFrame:
    """The pieces in sequences, numbered from ``base``, with whether their sequence is full; each block on its own."""
    dealt = left.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "row", "ids_crc32", F.lit(turn)), F.lit(blocks)))
    schema = T.StructType([*[cut.schema[c] for c in names], cut.schema["row"], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("full", T.BooleanType())])

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["length", "ids_crc32", "doc_id", "row"], kind="stable", ignore_index=True)
        sizes = block["length"].to_numpy(np.int64)
        bins = pack(sizes, capacity)
        order = np.concatenate([np.array(b) for b in bins])
        which = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        ends = np.cumsum(sizes[order])
        first = np.concatenate([[0], np.flatnonzero(np.diff(which)) + 1])
        offset = ends - sizes[order] - np.repeat((ends - sizes[order])[first], np.diff(np.append(first, len(order))))
        full = np.array([sizes[b].sum() == capacity for b in bins])
        out = block.iloc[order][[*names, "row"]].assign(sequence_id=base + int(block["block"].iloc[0]) * BLOCK * 4 + which, offset=offset, full=full[which])
        trim()
        return out

    return dealt.groupBy("block").applyInPandas(run, schema)

"""N-gram Jaccard self-join by several global token orders, and its connected components.

1. Every text becomes its set of distinct word n-grams as 64-bit digests. Texts with equal sets are
   one vertex, known by a digest of the set. Counts of n-grams by 2^20 slots give each a rarity class.
2. Each global order sorts n-grams by rarity class and then by its own digest. Two sets of
   sufficient overlap share a token among the first |x| - ceil(t |x|) + 1 of each, in every order. The first
   order's prefix tokens are the join keys; those of the others travel as bitmaps, which must meet;
   sizes and parity sketches of the whole sets (whose Hamming distance never exceeds the sets'
   difference), a short one and then one in proportion to the set, must allow the overlap too. No filter loses a pair.
3. A token's texts are compared in one place; beyond BUCKET they are dealt into blocks, each a place of its own,
   anew for each token. The first round keeps of each place's candidates a spanning forest, the likeliest pairs
   first; those are verified on the whole sets, and the links contracted. The second round drops the tokens whose
   texts are all in one component, which those of a group of near copies then are, and takes every candidate
   between different components that is left; there a token of more than BUCKET texts is compared by pairs of
   cells, but not within a component nor where sizes keep two cells apart. So groups of near copies never turn into
   all their pairs, yet no pair that could join two components stays unverified.

Defined results: a null, empty or wordless text has the empty set and is its own component; a text of
fewer than n words has one n-gram, all of them; repeated rows are one vertex; a row with a null id never names a
component unless no other does; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .components import components
from .shared import dropped, released, small_batches, written

#: Slots of the n-gram counts; the broadcast classes are as many bytes.
SLOTS = 1 << 20
#: Slots in a row of counts.
CHUNK = 1 << 14
#: Most texts of one token that are compared in one place.
BUCKET = 2048
#: Words of 64 bits in a parity sketch, and in the bitmap of another order's prefix.
SKETCH, MASK = 8, 2
#: Bits of a key in a bitmap, and how far apart their places in it begin.
PROBES, PROBE_STEP = 4, 12
#: Most sets that are held against one copy of a hub, and pairs in one batch of candidates.
HUB, EMITTED = 1024, 1 << 16
#: The largest bitmap has 2^MOST_BITS bits: 32 MB.
MOST_BITS = 28
_ORDERS = [np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def sets(s: tb.Slice, n: int) -> list[np.ndarray]:
    """Each row's distinct n-grams, sorted."""
    data = tb.LOWER[s.data]
    w = tb.words(data, s.at, tb.SPACED)
    h = tb.hashes(data, w.start, w.end)
    first = np.searchsorted(w.row, np.arange(s.hi - s.lo + 1))
    grams = np.zeros(len(h), np.uint64)
    if len(h) >= n:
        for k in range(n):
            grams[: len(h) - n + 1] = tb.mix(grams[: len(h) - n + 1] * np.uint64(0x9FB21C651E98DF25) + h[k : len(h) - n + 1 + k])
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            one = np.full(1, b - a, np.uint64)
            for x in h[a:b]:
                one = tb.mix(one * np.uint64(0x9FB21C651E98DF25) + x)
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(x: np.ndarray) -> int:
    """A digest of a set."""
    return int(tb.signed(tb.mix(tb.mix(x ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64).reshape(1) + np.uint64(len(x))))[0])


def _surveyed(texts: DataFrame, n: int) -> DataFrame:
    """(doc_id, n, sig) of every row, and (chunk, counts) of each task's slots."""
    schema = T.StructType([T.StructField("doc_id", texts.schema["doc_id"].dataType), T.StructField("n", T.LongType()), T.StructField("sig", T.LongType()), T.StructField("chunk", T.IntegerType()), T.StructField("counts", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, kind = np.zeros(SLOTS, np.int32), None
        for batch in batches:
            kind = batch.column(0).type
            for s in tb.slices(batch.column(1)):
                own = sets(s, n)
                if len(own):
                    counts += np.bincount((np.concatenate(own) & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS).astype(np.int32)
                rows = len(own)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.lo, rows), pa.array([len(x) for x in own], pa.int64()), pa.array([signature(x) if len(x) else None for x in own], pa.int64()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names=schema.names)
        if kind is not None:
            some = [c for c in range(SLOTS // CHUNK) if counts[c * CHUNK : (c + 1) * CHUNK].any()]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(some), kind), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.int64()), pa.array(some, pa.int32()), pa.array([counts[c * CHUNK : (c + 1) * CHUNK].tobytes() for c in some], pa.binary())], names=schema.names)

    return texts.select("doc_id", "text").mapInArrow(released(run), schema)


def _classes(survey: DataFrame) -> np.ndarray:
    """The rarity class of every slot: the logarithm of its count over the whole corpus, as SLOTS bytes."""

    def add(key, table):
        total = np.zeros(CHUNK, np.int64)
        for x in table.column("counts"):
            total += np.frombuffer(x.as_buffer(), np.int32)
        rank = np.minimum(np.log2(total + 1) * 4, 255).astype(np.uint8)
        return pa.table({"chunk": [key[0].as_py()], "rank": [rank.tobytes()]}, schema=pa.schema([("chunk", pa.int32()), ("rank", pa.binary())]))

    out = np.zeros(SLOTS, np.uint8)
    tasks = survey.where(F.col("chunk").isNotNull()).select("chunk", "counts").groupBy("chunk").applyInArrow(add, "chunk int, rank binary")
    for row in tasks.collect():
        out[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["rank"], np.uint8)
    return out


def _bitmap(values: np.ndarray, words: int) -> bytes:
    out = np.zeros(words, np.uint64)
    bit = (values >> np.uint64(20)) % np.uint64(words * 64)
    np.bitwise_or.at(out, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out.tobytes()


def _parity(values: np.ndarray, size: int) -> bytes:
    """How many of the values fall on each of ``size`` bits, odd or even: two sets' sketches differ in no more bits than the sets in values."""
    bits = np.bincount((values >> np.uint64(24)).astype(np.int64) & (size - 1), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def _fine(n: int, num: int, den: int) -> int:
    """Bits of a sketch that tells apart sets of n values little over the difference that a link allows."""
    return max(SKETCH * 64, 1 << (8 * 2 * n * (den - num) // (num + den)).bit_length())


def _folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """The sketch of ``size`` bytes of the same set."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, size), axis=0)


def _prefixed(texts: DataFrame, n: int, num: int, den: int, classes: np.ndarray) -> DataFrame:
    """(sig, n, sketch, fine, masks, tokens) once for each set and task."""
    given = texts.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, seen = given.value, set()
        for batch in batches:
            for s in tb.slices(batch.column(1)):
                sig, size, sketch, fine, masks, tokens = [], [], [], [], [], []
                for x in sets(s, n):
                    if not len(x) or (key := signature(x)) in seen:
                        continue
                    if len(seen) < 1 << 20:
                        seen.add(key)
                    low = rank[(x & np.uint64(SLOTS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56)
                    keep = len(x) - -(-num * len(x) // den) + 1
                    first = [np.partition(low | tb.mix(x * m) >> np.uint64(8), keep - 1)[:keep] for m in _ORDERS]
                    sig.append(key)
                    size.append(len(x))
                    sketch.append(_parity(x, SKETCH * 64))
                    fine.append(_parity(x, _fine(len(x), num, den)))
                    masks.append(b"".join(_bitmap(tb.mix(f), MASK) for f in first[1:]))
                    tokens.append(tb.signed(first[0]))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, tokens)]), pa.int32()), pa.array(np.concatenate(tokens) if tokens else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), pa.array(size, pa.int64()), pa.array(sketch, pa.binary()), pa.array(fine, pa.binary()), pa.array(masks, pa.binary()), lists], names=["sig", "n", "sketch", "fine", "masks", "tokens"])

    return texts.select("doc_id", "text").mapInArrow(released(run), "sig long, n long, sketch binary, fine binary, masks binary, tokens array<long>")


def _close(rows: dict[str, np.ndarray], i: int, j: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of the rows ``j`` that no filter keeps apart from row ``i``, and how far apart the sketches are."""
    size, sketch, masks = rows["n"], rows["sketch"], rows["masks"]
    # |x n y| >= num / (num + den) * (|x| + |y|), and never over the smaller set.
    j = j[(rows["label"][j] != rows["label"][i]) & (den * np.minimum(size[j], size[i]) >= num * np.maximum(size[j], size[i]))]
    j = j[(masks[j, :MASK] & masks[i, :MASK]).any(1) & (masks[j, MASK:] & masks[i, MASK:]).any(1)]
    apart = np.bitwise_count(sketch[j] ^ sketch[i]).sum(1, dtype=np.int64)
    ok = (num + den) * apart <= (den - num) * (size[j] + size[i])
    return j[ok], apart[ok]


def _forest(rows: dict[str, np.ndarray], a: int, b: int, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the candidates among rows a to b, the likeliest pairs first (Prim's way, in linear memory)."""
    far = np.iinfo(np.int64).max
    best, via, left = np.full(b - a, far), np.full(b - a, -1), np.arange(a, b)
    out, now = [], a
    while True:
        if via[now - a] >= 0:
            out.append((int(via[now - a]), now))
        left = left[left != now]
        if not len(left):
            return out
        j, apart = _close(rows, now, left, num, den)
        nearer = apart < best[j - a]
        best[j[nearer] - a], via[j[nearer] - a] = apart[nearer], now
        now = int(left[np.argmin(best[left - a])])


def _every(rows: dict[str, np.ndarray], a: int, b: int, num: int, den: int) -> Iterator[tuple[int, int]]:
    """All candidates among rows a to b; where the rows are of two cells, those across them."""
    cell = rows["cell"][a:b]
    cross = cell.min() != cell.max()
    for i in range(a, b - 1):
        j = np.arange(i + 1, b)
        j = j[cell[i + 1 - a :] != cell[i - a]] if cross else j
        yield from ((i, k) for k in _close(rows, i, j, num, den)[0].tolist())


def _candidates(shared: DataFrame, sketches: DataFrame, num: int, den: int, forest: bool) -> DataFrame:
    """Distinct candidate pairs (a, b) of different labels among rows (token, ca, cb, cell, sig) of one place (token, ca, cb)."""
    rows = shared.join(sketches.select("sig", "n", "sketch", "masks", "label"), "sig").repartition("token", "ca", "cb").sortWithinPartitions("token", "ca", "cb", "sig")

    def flat(column: pa.Array, words: int) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        names = ["token", "ca", "cb", "cell", "sig", "n", "sketch", "masks", "label"]

        def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
            cols = {c: table.column(c).to_numpy() for c in names if c not in ("sketch", "masks")}
            cols["sketch"], cols["masks"] = flat(table.column("sketch"), SKETCH), flat(table.column("masks"), 2 * MASK)

            def batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
                both = np.array(found, np.int64).reshape(-1, 2)
                x, y = cols["sig"][both[:, 0]], cols["sig"][both[:, 1]]
                return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

            new = (np.diff(cols["token"]) != 0) | (np.diff(cols["ca"]) != 0) | (np.diff(cols["cb"]) != 0)
            edge = np.concatenate([[0], np.flatnonzero(new) + 1, [len(cols["sig"])]])
            width = np.diff(edge)
            out = []
            # Places of two rows, which most are, all at once.
            i = edge[:-1][width == 2]
            if len(i):
                j = i + 1
                n = cols["n"]
                ok = (cols["label"][i] != cols["label"][j]) & (den * np.minimum(n[i], n[j]) >= num * np.maximum(n[i], n[j]))
                ok &= (cols["masks"][i, :MASK] & cols["masks"][j, :MASK]).any(1) & (cols["masks"][i, MASK:] & cols["masks"][j, MASK:]).any(1)
                ok &= (num + den) * np.bitwise_count(cols["sketch"][i] ^ cols["sketch"][j]).sum(1, dtype=np.int64) <= (den - num) * (n[i] + n[j])
                out += list(zip(i[ok].tolist(), j[ok].tolist(), strict=True))
            for a, b in zip(edge[:-1][width > 2].tolist(), edge[1:][width > 2].tolist(), strict=True):
                for pair in (_forest if forest else _every)(cols, a, b, num, den):
                    out.append(pair)
                    if len(out) == EMITTED:
                        yield batch(out)
                        out = []
            yield batch(out)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]).select(names)
            table = pa.concat_tables([held, table]) if held is not None and held.num_rows else table
            # The last place may go on in the next batch.
            last = [table.column(c).to_numpy() for c in ("token", "ca", "cb")]
            same = np.logical_and.reduce([c == c[-1] for c in last])
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            held = table.slice(cut)
            if cut:
                yield from pairs(table.slice(0, cut).combine_chunks())
        if held is not None and held.num_rows:
            yield from pairs(held.combine_chunks())

    return rows.mapInArrow(released(run), "a long, b long").distinct()


def _cells(shared: DataFrame, labelled: DataFrame, num: int, den: int) -> DataFrame:
    """(token, ca, cb, cell, sig): the places of the second round.

    A token whose texts all have one label is done. The texts of others lie in cells of at most about BUCKET, by size
    class and label; a place is a cell with itself, if it has two labels, or two cells whose sizes allow a link.
    """
    kind = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(den / num) if num < den else 1.0) + 1e-9).cast("int")
    rows = shared.join(labelled.select("sig", "label", kind.alias("kind")), "sig")
    mixed = rows.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("rows")).where("lo <> hi").select("token", "rows")
    rows = rows.drop("blocks").join(mixed, "token").withColumn("large", F.col("rows") > BUCKET)
    # Most tokens are one cell.
    kind, bag = F.when(F.col("large"), F.col("kind")).otherwise(F.lit(0)), F.when(F.col("large"), F.pmod(F.xxhash64("label"), F.ceil(F.col("rows") / BUCKET))).otherwise(F.lit(0))
    rows = written(rows.select("token", "sig", "label", "large", kind.alias("kind"), bag.alias("bag")), "mixed")
    small = rows.where(~F.col("large")).select("token", F.lit(0).cast("long").alias("ca"), F.lit(0).cast("long").alias("cb"), F.lit(0).cast("long").alias("cell"), "sig")

    hot = rows.where("large")
    bags = hot.groupBy("token", "kind", "bag").agg(F.ceil(F.count("*") / BUCKET).cast("int").alias("cuts"), (F.min("label") == F.max("label")).alias("alike"))
    hot = hot.join(bags, ["token", "kind", "bag"])
    cell = F.xxhash64("kind", "bag", F.pmod(F.xxhash64("sig"), F.col("cuts")))
    hot = hot.select("token", "sig", cell.alias("cell"))
    cells = bags.withColumn("cut", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts").cast("long") - 1)))
    cells = cells.select("token", "kind", "bag", "alike", F.xxhash64("kind", "bag", "cut").alias("cell"))
    x, y = cells.alias("x"), cells.alias("y")
    near = (F.col("x.token") == F.col("y.token")) & (F.col("x.cell") <= F.col("y.cell")) & (F.abs(F.col("x.kind") - F.col("y.kind")) <= 1)
    done = (F.col("x.kind") == F.col("y.kind")) & (F.col("x.bag") == F.col("y.bag")) & F.col("x.alike")
    places = x.join(y, near).where(~done).select(F.col("x.token").alias("token"), F.col("x.cell").alias("ca"), F.col("y.cell").alias("cb"))
    sides = places.withColumn("cell", F.explode(F.array_distinct(F.array("ca", "cb"))))
    return small.unionByName(hot.join(sides, ["token", "cell"]).select("token", "ca", "cb", "cell", "sig"))


def bitmap(keys: DataFrame) -> np.ndarray:
    """Bits of the column ``key``, PROBES each among sixteen times as many as there are keys, at most 2^MOST_BITS."""
    n = keys.count()
    size = min(MOST_BITS, max(16, (16 * n - 1).bit_length()))
    probes = F.array(*[F.shiftright("key", PROBE_STEP * k).bitwiseAND((1 << size) - 1) for k in range(PROBES)])
    spots = keys.select(F.explode(probes).alias("at")).distinct().withColumn("chunk", F.shiftright("at", 16))

    def fill(key, table):
        bits = np.zeros(1 << 16, np.uint8)
        bits[table.column("at").to_numpy() & 0xFFFF] = 1
        return pa.table({"chunk": [key[0].as_py()], "bits": [np.packbits(bits, bitorder="little").tobytes()]}, schema=pa.schema([("chunk", pa.int64()), ("bits", pa.binary())]))

    out = np.zeros(1 << (size - 3), np.uint8)
    for row in spots.groupBy("chunk").applyInArrow(fill, "chunk long, bits binary").collect():
        out[row["chunk"] << 13 : (row["chunk"] + 1) << 13] = np.frombuffer(row["bits"], np.uint8)
    return out


def _marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of ``keys`` may be in a bitmap; all that are in it."""
    out = np.ones(len(keys), bool)
    for k in range(PROBES):
        at = (keys >> PROBE_STEP * k) & (len(bits) * 8 - 1)
        out &= (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return out


def _likely(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """Those of ``pairs`` whose fine sketches allow a link, written."""
    own = sketches.select("sig", "n", "fine")
    both = pairs.join(own.select(F.col("sig").alias("a"), F.col("n").alias("m"), F.col("fine").alias("x")), "a").join(own.select(F.col("sig").alias("b"), "n", F.col("fine").alias("y")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, x, y in zip((batch.column("m").to_numpy() + batch.column("n").to_numpy()).tolist(), batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
                size = min(len(x), len(y))
                keep.append((num + den) * int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum()) <= (den - num) * n)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return written(both.select("a", "b", "m", "n", "x", "y").mapInArrow(released(check), "a long, b long"), "likely")


def _links(pairs: DataFrame, texts: DataFrame, elected: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Those of ``pairs`` whose whole sets overlap enough.

    Texts stay where they are; the sets that pairs need move, from the elected row of each. Of a pair, the end with
    more pairs is the hub: the others come to its place, at most HUB of them to a copy of it, and are held against it one by one.
    """
    ends = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig")))
    pulls = ends.groupBy("sig").agg(F.count("*").alias("pull"))
    given = texts.sparkSession.sparkContext.broadcast(bitmap(pulls.join(elected, "sig").select(F.col("sig").bitwiseXOR(F.col("row")).alias("key"))))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in tb.slices(batch.column(1)):
                sig, grams = [], []
                for x, row in zip(sets(s, n), batch.column(2)[s.lo : s.hi].to_pylist(), strict=True):
                    if len(x) and _marked(given.value, np.array([(key := signature(x)) ^ row]))[0]:
                        sig.append(key)
                        grams.append(x.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), pa.array(grams, pa.binary())], names=["sig", "grams"])

    full = texts.select("doc_id", "text", "row").mapInArrow(released(whole), "sig long, grams binary")
    pull = pairs.join(pulls.select(F.col("sig").alias("a"), F.col("pull").alias("pa")), "a").join(pulls.select(F.col("sig").alias("b"), F.col("pull").alias("pb")), "b")
    first = F.struct("pa", "a") > F.struct("pb", "b")
    pull = pull.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("other"), F.greatest("pa", "pb").alias("pull"))
    pull = written(pull.withColumn("copy", F.pmod(F.xxhash64("other"), F.ceil(F.col("pull") / HUB))), "hubs")
    routes = pull.select(F.col("hub").alias("sig"), "hub", "copy", F.lit(0).alias("turn")).distinct().unionByName(pull.select(F.col("other").alias("sig"), "hub", "copy", F.lit(1).alias("turn")))
    met = full.join(routes, "sig").select("hub", "copy", "turn", "sig", "grams").repartition("hub", "copy").sortWithinPartitions("hub", "copy", "turn")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, x = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for hub, copy, turn, sig, grams in zip(*(batch.column(c).to_pylist() for c in ("hub", "copy", "turn", "sig")), batch.column("grams"), strict=True):
                y = np.frombuffer(grams.as_buffer(), np.uint64)
                if turn == 0:
                    place, x = (hub, copy), y.copy()
                elif place == (hub, copy):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if den * common >= num * (len(x) + len(y) - common):
                        a.append(min(hub, sig))
                        b.append(max(hub, sig))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return met.mapInArrow(released(verify), "a long, b long").distinct()


def near_components(docs: DataFrame, *, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; texts link when den * |x n y| >= num * |x u y|."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("row"))
    survey = written(_surveyed(texts, n), "survey")
    rows = survey.where(F.col("chunk").isNull()).select("doc_id", "n", "sig")
    elected = rows.where(F.col("sig").isNotNull()).groupBy("sig").agg(F.min(F.xxhash64("doc_id")).alias("row"))
    prefixed = written(_prefixed(texts, n, num, den, _classes(survey)), "prefixes")

    # Tokens that occur once, which most do, are left out where they are.
    twice = prefixed.select(F.explode("tokens").alias("key")).groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1")
    twice = written(twice.select("key"), "twice")
    given = docs.sparkSession.sparkContext.broadcast(bitmap(twice))
    dropped(twice)

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token = batch.column(1).flatten().to_numpy()
            sig = np.repeat(batch.column(0).to_numpy(), batch.column(1).value_lengths().to_numpy())
            keep = _marked(given.value, token)
            yield pa.RecordBatch.from_arrays([pa.array(sig[keep]), pa.array(token[keep])], names=["sig", "token"])

    tokens = written(prefixed.select("sig", "tokens").mapInArrow(released(often), "sig long, token long").distinct(), "tokens")
    hot = tokens.groupBy("token").agg(F.count("*").alias("rows")).where("rows > 1")
    shared = written(tokens.join(hot.select("token", F.ceil(F.col("rows") / BUCKET).alias("blocks")), "token").select("token", "sig", "blocks"), "shared")
    dropped(tokens)

    sketches = prefixed.select("sig", "n", "sketch", "fine", "masks").dropDuplicates(["sig"]).join(shared.select("sig").distinct(), "sig", "left_semi")
    sketches = written(sketches, "sketches")
    dropped(prefixed)
    # In the first round a token's block is its own place: linear in the token's texts. Each token deals them anew.
    block = F.pmod(F.xxhash64("sig", "token"), F.col("blocks"))
    dealt = shared.select("token", block.alias("ca"), F.lit(0).cast("long").alias("cb"), F.lit(0).cast("long").alias("cell"), "sig")
    first = written(_candidates(dealt, sketches.withColumn("label", F.col("sig")), num, den, True), "pairs")
    trees = components(_links(_likely(first, sketches, num, den), texts, elected, n, num, den))
    labelled = sketches.join(trees.withColumnRenamed("v", "sig"), "sig", "left").withColumn("label", F.coalesce("root", "sig")).drop("root")
    labelled = written(labelled, "labelled")
    second = _candidates(_cells(shared, labelled, num, den), labelled, num, den, False).join(first, ["a", "b"], "left_anti")
    second = _likely(second, sketches, num, den)
    dropped(shared, sketches, labelled)
    more = _links(second, texts, elected, n, num, den)
    top = trees.select(F.col("v").alias("a"), F.col("root").alias("ra"))
    joined = more.join(top, "a", "left").join(top.select(F.col("a").alias("b"), F.col("ra").alias("rb")), "b", "left")
    upper = components(joined.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))

    upper = upper.select(F.col("v").alias("root"), F.col("root").alias("top"))
    final = trees.join(upper, "root", "left").select(F.col("v").alias("sig"), F.coalesce("top", "root").alias("class"))
    # Vertices that only the second round linked.
    final = final.unionByName(upper.select(F.col("root").alias("sig"), F.col("top").alias("class")).join(trees.select(F.col("v").alias("sig")), "sig", "left_anti"))
    classed = rows.join(final, "sig", "left").withColumn("class", F.coalesce("class", "sig"))
    least = classed.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("least"))
    return classed.join(least, "class", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))

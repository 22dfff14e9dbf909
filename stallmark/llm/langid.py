"""Language identification by a blended-spectrum string kernel.

A text's features are the distinct n-grams of its lower-cased UTF-8 bytes for n = 1 to ``ORDER``
(presence, not counts), trigrams and longer hashed into ``BUCKETS`` slots. The kernel of two texts is
the cosine of their presence vectors. ``landmarks`` training texts give a Nyström map
phi(x) = k(x, L) K(L, L)^(-1/2), in which one-versus-rest ridge regression is solved in closed form.
Scoring is two matrix products, presence by (landmarks by weights); the inner one is taken once.

The fit uses about ``SAMPLE`` labelled texts at most, whole: of each language those with the smallest hash of their
text, as many of each (one at least). Each text comes to the driver as its slots, at most ``BUCKETS`` numbers. Every text is
scored whole.

Defined results: ``und`` with score 0 for a null text or one without a letter; rows whose language is
null or empty teach nothing; with no labelled row every text is ``und``; repeated rows score alike, and teach once; of
languages with equal values the first by name is taken; of very long texts a slice is held; an empty table gives
an empty result; further columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .shared import released, small_batches

ORDER, BUCKETS = 4, 1 << 18
#: Most labelled texts that a fit uses, and most of them that are landmarks.
SAMPLE, LANDMARKS = 2000, 400
RIDGE = 1e-3
#: How fast a score nears 1 as the best language leads the second.
SHARP = 8.0

#: The same letters for learning and for prediction: numbers that look like letters are none.
_LETTER = regex.compile(r"\p{L}")
_MULT = np.array([0, 0, 0, 0x9E3779B1, 0x85EBCA6B], np.uint64)


class Model(NamedTuple):
    """Languages and, for each n-gram slot, its weight towards each of them; ``shift`` is added to all."""

    langs: list[str]
    weights: np.ndarray
    shift: np.ndarray


def grams(data: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """The distinct n-gram slots of one text. ``flags``: BUCKETS false values, left as they were."""
    if not len(data):
        return np.zeros(0, np.int64)
    code = data.astype(np.uint64)
    # Unigrams and bigrams have slots of their own (256 and 65,536); longer ones share the rest.
    flags[data] = True
    rest = BUCKETS - 256 - 65536
    whole = code
    for n in range(2, ORDER + 1):
        if len(data) < n:
            break
        whole = (whole[:-1] << np.uint64(8)) | code[n - 1 :]
        if n == 2:
            flags[256 + whole.astype(np.int64)] = True
        else:
            flags[256 + 65536 + ((whole * _MULT[n] >> np.uint64(9)) % np.uint64(rest)).astype(np.int64)] = True
    out = np.flatnonzero(flags)
    flags[out] = False
    return out


def fit(sets: list[np.ndarray], langs: list[str]) -> Model | None:
    """Nyström landmarks and one-versus-rest kernel ridge regression over texts' distinct slots."""
    names = sorted(set(langs))
    if not names:
        return None
    by = {n: [i for i, x in enumerate(langs) if x == n] for n in names}
    each = max(1, LANDMARKS // len(names))
    marks = [i for n in names for i in by[n][:each]]
    used = np.unique(np.concatenate(sets))
    col = np.full(BUCKETS, -1)
    col[used] = np.arange(len(used))

    def matrix(rows: list[int]) -> np.ndarray:
        x = np.zeros((len(rows), len(used)), np.float32)
        for r, i in enumerate(rows):
            x[r, col[sets[i]]] = 1 / np.sqrt(len(sets[i]))
        return x

    land = matrix(marks)
    values, vectors = np.linalg.eigh((land @ land.T).astype(np.float64))
    good = values > 1e-8 * values[-1]
    half = vectors[:, good] / np.sqrt(values[good])
    k = np.concatenate([matrix(list(range(i, min(i + 200, len(sets))))) @ land.T for i in range(0, len(sets), 200)]).astype(np.float64)
    phi = k @ half
    target = np.where(np.array(langs)[:, None] == np.array(names), 1.0, -1.0)
    # Each language weighs the same, however many of the sample it has.
    share = np.array([1 / len(by[x]) for x in langs])[:, None]
    shift = (target * share).sum(0) / share.sum()
    a = phi.T @ (phi * share) + RIDGE * np.eye(phi.shape[1]) * share.mean()
    beta = np.linalg.solve(a, phi.T @ ((target - shift) * share))
    weights = np.zeros((BUCKETS, len(names)), np.float32)
    weights[used] = land.T @ (half @ beta)
    return Model(names, weights, shift)


def scores(model: Model, data: np.ndarray, at: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """The regressions' values for each row: presence vectors times the folded weights, a batch at once."""
    sets = [grams(data[at[r] : at[r + 1]], flags) for r in range(len(at) - 1)]
    size = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), len(model.langs)))
    some = np.flatnonzero(size)
    if len(some):
        first = np.concatenate([[0], np.cumsum(size[some])[:-1]])
        out[some] = np.add.reduceat(model.weights[np.concatenate([sets[i] for i in some])], first, axis=0, dtype=np.float64) / np.sqrt(size[some])[:, None]
    return out + model.shift


def sample(docs: DataFrame, train, *, text_col: str, lang_col: str) -> tuple[list[np.ndarray], list[str]]:
    """Slots and languages of the sample.

    Each language's count comes to the driver, as its weights do, which are far larger. Only rows whose hash lies below
    twice the share that their language needs move and are ranked, so no task has more than some thousand.
    """
    text, lang = F.col(text_col), F.col(lang_col)
    rows = docs.where(train & lang.isNotNull() & (lang != "") & text.rlike(r"\p{L}")).select(text.alias("t"), lang.alias("l"), F.xxhash64(text).alias("h"))
    sizes = rows.groupBy("l").agg(F.approx_count_distinct("h").alias("n")).collect()
    if not sizes:
        return [], []
    each = max(1, SAMPLE // len(sizes))
    n = F.create_map(*[F.lit(v) for r in sizes for v in (r["l"], r["n"])])[F.col("l")]
    share = (F.col("h") / 2.0**64 + 0.5) * n <= 2.0 * each + 20
    few = rows.where(share).dropDuplicates(["l", "h"])
    rank = F.row_number().over(Window.partitionBy("l").orderBy("h", "t"))
    chosen = few.withColumn("r", rank).where(F.col("r") <= each).select("l", "h", "t")

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(BUCKETS, bool)
        for batch in batches:
            for s in tb.slices(batch.column("t")):
                data, n = tb.LOWER[s.data], s.hi - s.lo
                own = [grams(data[s.at[r] : s.at[r + 1]], flags).astype(np.int32).tobytes() for r in range(n)]
                yield pa.RecordBatch.from_arrays([batch.column("l").slice(s.lo, n), batch.column("h").slice(s.lo, n), pa.array(own, pa.binary())], names=["l", "h", "slots"])

    got = sorted(chosen.mapInArrow(released(slots), "l string, h long, slots binary").collect(), key=lambda r: (r["h"], r["l"]))
    return [np.frombuffer(r["slots"], np.int32).astype(np.int64) for r in got], [r["l"] for r in got]


def classified(docs: DataFrame, train, *, text_col: str = "text", lang_col: str = "lang", as_col: str = "langid") -> DataFrame:
    """``docs`` with the struct column ``as_col`` (lang_pred, score, lead), learned from the rows for which ``train`` holds.

    The score is 1 / (1 + sum over other languages of exp(-SHARP * lead)); ``lead`` is how far the best value is before the second.
    """
    small_batches(docs.sparkSession)
    model = fit(*sample(docs, train, text_col=text_col, lang_col=lang_col))
    given = docs.sparkSession.sparkContext.broadcast(model)
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lead", T.DoubleType())])
    schema = T.StructType([*docs.schema.fields, T.StructField(as_col, kind)])
    where = docs.columns.index(text_col)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, flags = given.value, np.zeros(BUCKETS, bool)
        for batch in batches:
            for s in tb.slices(batch.column(where)):
                n = s.hi - s.lo
                raw = s.data.tobytes()
                ok = np.array([model is not None and bool(_LETTER.search(raw[s.at[r] : s.at[r + 1]].decode("utf-8", "replace"))) for r in range(n)], bool)
                names, top, lead = np.full(n, "und", object), np.zeros(n), np.zeros(n)
                if ok.any():
                    y = scores(model, tb.LOWER[s.data], s.at, flags)
                    best = y.argmax(1)
                    gap = y[np.arange(n), best][:, None] - y
                    top = np.where(ok, 1 / np.exp(-SHARP * gap).sum(1), 0.0)
                    lead = np.where(ok, np.sort(gap, 1)[:, 1] if gap.shape[1] > 1 else 1.0, 0.0)
                    names[ok] = np.array(model.langs, object)[best[ok]]
                found = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(top), pa.array(lead)], names=kind.names)
                yield pa.RecordBatch.from_arrays([*(c.slice(s.lo, n) for c in batch.columns), found], names=schema.names)

    return docs.mapInArrow(released(predict), schema)


def identify(docs: DataFrame, train, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang_pred, score, lead) of every row."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    out = classified(named, train, text_col="text", lang_col="lang", as_col="found")
    return out.select("doc_id", "found.lang_pred", "found.score", "found.lead")

"""Line dedup over levelled sorted runs of line digests.

``LineRuns`` keeps runs in the shared folder: each a table (h, g, n, holder, again) bucketed and sorted by (h, g),
the 128-bit digest of a line's key; n is in how many documents it was seen, holder the largest document id that has
it, and ``again`` whether it is no news: seen by an earlier run, or by two documents of this one. ``add`` merge-anti-joins a
batch's keys with every run, which tells the new ones, and writes them all as a run of level 0; when a level has
``fanout`` runs they are merged into one run of the next level. Buckets and order of the runs serve the joins, so that
only the batch is shuffled. ``unseen`` drops the lines that earlier batches had, ``resolve`` those that another
document of all that were added is to keep: only keys that some run knew again are looked at there.

A key is a line without white space ``[\\x20\\x09-\\x0D]`` at its ends, with A-Z in lower case. Only keys of
``least`` code points or more take part.

Defined results: a null or empty text is one empty line; a line that a document repeats counts once
for it and all its places stay or go together; rows that share an id count as documents each, and
the largest id keeps its lines in all of them; rows with a null id count as copies and keep all
their lines; a very long text is read in its slice, in time linear in its lines; an empty table gives an empty
result; other columns are left as they are, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .shared import dropped, place, released, small_batches, unused, written

#: The column that is added where the caller names none.
STATS = "_line_stats"
KEY = ["h", "g"]
_MORE = np.uint64(0xC2B2AE3D27D4EB4F)


def lines(s: tb.Slice, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every line of a slice: its row and, if its key has ``least`` code points, that it counts and its two digests."""
    data = tb.LOWER[s.data]
    ends = np.sort(np.concatenate([np.flatnonzero(s.data == 0x0A), s.at[1:]]), kind="stable")
    # An edge of rows that follows a line feed ends an empty line; lines of one row lie between its edges.
    row = np.repeat(np.arange(len(s.at) - 1), np.diff(np.concatenate([[0], np.cumsum(s.data == 0x0A)])[s.at]) + 1)
    first = np.ones(len(ends), bool)
    first[1:] = row[1:] != row[:-1]
    start = np.where(first, s.at[row], np.concatenate([[0], ends[:-1] + 1]))
    dark = np.flatnonzero(tb.SPACED[data])
    low, high = np.searchsorted(dark, start), np.searchsorted(dark, ends)
    some = np.flatnonzero(high > low)
    a, b = dark[low[some]], dark[high[some] - 1] + 1
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    long = points[b] - points[a] >= least
    some, a, b = some[long], a[long], b[long]
    counts = np.zeros(len(ends), bool)
    counts[some] = True
    h, g = np.zeros(len(ends), np.uint64), np.zeros(len(ends), np.uint64)
    h[some], g[some] = tb.hashes(data, a, b), tb.hashes(data ^ np.uint8(0x5A), a, b) * _MORE
    return row, counts, h, g


@contextmanager
def in_order(spark: SparkSession) -> Iterator[None]:
    """A run has a file a bucket, sorted as a whole: Spark trusts that only if told to, when an action's plan is made."""
    ordered = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(ordered)
    spark.conf.set(ordered, "true")
    try:
        yield
    finally:
        spark.conf.set(ordered, before)


class LineRuns:
    """Levelled runs of line digests."""

    def __init__(self, spark: SparkSession, *, least: int = 20, fanout: int = 4):
        self.spark, self.least, self.fanout = spark, least, fanout
        self.name, self.path = f"line_runs_{uuid.uuid4().hex}", place(spark, "line-runs")
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.made = 0
        small_batches(spark)

    def keys(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(doc_id, h, g): each document's distinct digests."""
        least = self.least
        schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *[T.StructField(c, T.LongType()) for c in KEY]])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for s in tb.slices(batch.column(1)):
                    row, counts, h, g = lines(s, least)
                    row, h, g = row[counts], h[counts], g[counts]
                    order = np.lexsort((g, h, row))
                    row, h, g = row[order], h[order], g[order]
                    new = np.ones(len(row), bool)
                    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1]) | (g[1:] != g[:-1])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(s.lo + row[new])), pa.array(tb.signed(h[new])), pa.array(tb.signed(g[new]))], names=["doc_id", *KEY])

        return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(released(run), schema)

    def _saved(self, rows: DataFrame, name: str) -> str:
        """``rows`` as a table of one sorted file a bucket."""
        with in_order(self.spark):
            rows.repartition(self.buckets, *KEY).write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.path}/{name}").saveAsTable(f"{self.name}_{name}")
        return f"{self.name}_{name}"

    def _tables(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def _write(self, run: DataFrame, level: int) -> None:
        self.made += 1
        name = self._saved(run, f"l{level}_{self.made}")
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            merging, self.levels[level] = self.levels[level], []
            runs = self.spark.table(merging[0])
            for other in merging[1:]:
                runs = runs.unionByName(self.spark.table(other))
            self._write(runs.groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("holder").alias("holder"), F.max("again").alias("again")), level + 1)
            for old in merging:
                self.spark.sql(f"DROP TABLE {old}")

    def fresh(self, rows: DataFrame) -> DataFrame:
        """Those of ``rows`` whose keys are in no run."""
        for run in self._tables():
            # Merged with the run as it lies, however small it is: a broadcast would drop its buckets.
            rows = rows.join(run.select(*KEY).hint("merge"), KEY, "left_anti")
        return rows

    def add_keys(self, rows: DataFrame) -> None:
        """Add a batch's (doc_id, h, g) as a new run."""
        own = rows.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("doc_id").alias("holder"))
        if self._tables():
            own = written(own, "batch")
            with in_order(self.spark):
                new = written(self.fresh(own), "fresh")
            known = own.join(new.select(*KEY), KEY, "left_anti").withColumn("again", F.lit(True))
            self._write(new.withColumn("again", F.col("n") > 1).unionByName(known), 0)
            dropped(own, new)
        else:
            self._write(own.withColumn("again", F.col("n") > 1), 0)

    def add(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Add a batch's lines as a new run."""
        self.add_keys(self.keys(docs, id_col, text_col))

    def held(self, copies: int) -> DataFrame | None:
        """(h, g, holder) of the keys in ``copies`` documents or more, written."""
        runs = self._tables()
        if not runs:
            return None
        again = runs[0].where("again").select(*KEY)
        for run in runs[1:]:
            again = again.unionByName(run.where("again").select(*KEY))
        again = written(again.distinct(), "again")
        own = [run.select(*KEY, "n", "holder").join(again, KEY, "left_semi") for run in runs]
        rows = own[0]
        for more in own[1:]:
            rows = rows.unionByName(more)
        with in_order(self.spark):
            return written(rows.groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("holder").alias("holder")).where(F.col("n") >= copies).select(*KEY, "holder"), "held")

    def without(self, docs: DataFrame, gone: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", as_col: str = STATS) -> DataFrame:
        """``docs`` without the lines with the digests that ``gone`` (doc_id, h, g) has for them, and the struct ``as_col``."""
        small_batches(self.spark)
        least = self.least
        key, drop = unused("gone_doc", docs.columns), unused("gone_lines", docs.columns)
        packed = gone.groupBy(F.col("doc_id").alias(key)).agg(F.collect_list(F.struct(*KEY)).alias(drop))
        joined = docs.join(packed, docs[id_col] == packed[key], "left").select(*[docs[c] for c in docs.columns], packed[drop])
        stats = T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
        text = docs.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                drops = batch.column(len(batch.schema) - 1)
                for s in tb.slices(batch.column(text)):
                    rows = s.hi - s.lo
                    n, out = np.bincount(np.zeros(0, np.int64), minlength=rows), batch.column(text).slice(s.lo, rows)
                    total = np.diff(np.concatenate([[0], np.cumsum(s.data == 0x0A)])[s.at]) + 1
                    hit = [r for r in range(rows) if drops[s.lo + r].is_valid]
                    if out.null_count or hit:
                        texts = [t or "" for t in out.to_pylist()]
                        if hit:
                            row, counts, h, g = lines(s, least)
                            edge = np.searchsorted(row, np.arange(rows + 1))
                        for r in hit:
                            own = drops[s.lo + r].values
                            mine = set(zip(own.field("h").to_pylist(), own.field("g").to_pylist(), strict=True))
                            a, b = edge[r], edge[r + 1]
                            keep = [not (c and (x, y) in mine) for c, x, y in zip(counts[a:b].tolist(), tb.signed(h[a:b]).tolist(), tb.signed(g[a:b]).tolist(), strict=True)]
                            texts[r] = "\n".join(x for x, k in zip(texts[r].split("\n"), keep, strict=True) if k)
                            n[r] = len(keep) - sum(keep)
                        out = pa.array(texts, batch.schema.field(text).type)
                    found = pa.StructArray.from_arrays([pa.array(total), pa.array(n)], names=stats.names)
                    columns = [out if i == text else batch.column(i).slice(s.lo, rows) for i in range(len(batch.schema) - 1)]
                    yield pa.RecordBatch.from_arrays([*columns, found], names=[*batch.schema.names[:-1], as_col])

        return joined.mapInArrow(released(run), T.StructType([*docs.schema.fields, T.StructField(as_col, stats)]))

    def unseen(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", as_col: str = STATS) -> DataFrame:
        """``docs`` without the lines that earlier batches had. Call before ``add``."""
        rows = written(self.keys(docs, id_col, text_col), "keys")
        return self.without(docs, rows.join(self.fresh(rows).select(*KEY).distinct(), KEY, "left_anti"), id_col=id_col, text_col=text_col, as_col=as_col)


def dedup_lines(docs: DataFrame, *, batches: int = 4, copies: int = 3, least: int = 20, id_col: str = "doc_id", text_col: str = "text", as_col: str = STATS) -> DataFrame:
    """All of ``docs`` with its repeated lines resolved, taken in as ``batches`` batches by id hash.

    Lines in ``copies`` documents or more stay in the largest id only. Returns the columns of ``docs`` (the text without
    dropped lines, a null one as an empty one) and the struct ``as_col`` (n_lines, n_dropped).
    """
    runs = LineRuns(docs.sparkSession, least=least)
    rows = written(runs.keys(docs, id_col, text_col).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches))), "keys")
    for b in range(batches):
        runs.add_keys(rows.where(F.col("batch") == b))
    held = runs.held(copies)
    gone = written(rows.join(held, KEY).where(~F.col("doc_id").eqNullSafe(F.col("holder"))).select("doc_id", *KEY), "gone")
    dropped(rows, held)
    for level in runs.levels:
        for name in level:
            docs.sparkSession.sql(f"DROP TABLE {name}")
    return runs.without(docs, gone, id_col=id_col, text_col=text_col, as_col=as_col)

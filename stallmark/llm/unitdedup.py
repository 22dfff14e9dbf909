"""Substring dedup by unit hashing.

A text is tiled by its units: lines, paragraphs or sentences (which also end at a line's end).
Units are normalised (A-Z in lower case, white space and end marks off both ends, white space within
made one space); those of ``least`` code points or more are digested (128 bits) and grouped over the whole
corpus. The occurrence in the smallest (id, place) stays; all others go, and their code point
offsets in the original text are kept.

With ``parts``, each unit is tiled by its own parts (sentences of a line, as a rule), which are what is counted
and removed. A part goes if its whole unit has been met before, or if it has been met itself, in whatever unit.
Units are compared with units and parts with parts, so that the first occurrence of either is never in a unit that goes whole.

Defined results: a null or empty text has no units and stays empty; a unit that a text repeats stays
in its first place only; rows that are repeated whole rank alike and are treated alike; rows with a
null id rank first; of a very long text the time is linear in its units; an empty table gives an empty result; columns other than the two named are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import lowered, released, small_batches, written

#: Patterns whose matches tile a text.
UNITS = {"sentence": r"[^.!?\n]+[.!?\n]*|[.!?\n]+", "line": r"[^\n]+\n*|\n+", "paragraph": r"(?:[^\n]|\n(?!\n))+\n*|\n+"}
#: In the place of a part's number: the whole unit.
WHOLE = -1
ENDS = " \t\n\x0b\f\r.!?"


def normal(unit: Column) -> Column:
    return F.regexp_replace(F.btrim(lowered(unit), F.lit(ENDS)), r"[ \t\x0B\f\r\n]+", " ")


def dedup_units(docs: DataFrame, *, unit: str = "line", parts: str | None = None, least: int = 30, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_units, text, removed): removed is an array of (start, end) in the original text."""
    small_batches(docs.sparkSession)
    own = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.xxhash64(F.col(id_col), own).alias("key"), F.col(id_col).alias("doc_id"), own.alias("text"))
    rank = F.struct("doc_id", "key", "place")

    def digest(norm: Column, level: Column, at: Column) -> Column:
        """Null for what is too short; the level keeps units and parts apart."""
        return F.when(F.char_length(norm) >= least, F.struct(F.xxhash64(norm).alias("h"), F.xxhash64(level, norm).alias("g"), at.alias("place")))

    def with_parts(u: Column, i: Column) -> Column:
        """The unit itself, then its parts."""
        norm = F.transform(F.concat(F.array(u), F.regexp_extract_all(u, F.lit(UNITS[parts]), F.lit(0))), lambda x: normal(x))
        return F.transform(norm, lambda x, j: digest(x, F.when(j == 0, 1).otherwise(2), F.struct(i.alias("unit"), (j + WHOLE).alias("part"))))

    units = F.regexp_extract_all("text", F.lit(UNITS[unit]), F.lit(0))
    found = F.transform(F.transform(units, lambda u: normal(u)), lambda u, i: digest(u, F.lit(1), i)) if parts is None else F.flatten(F.transform(units, with_parts))
    long_ones = F.filter(found, lambda x: x.isNotNull())
    rows = texts.select("key", "doc_id", F.explode(long_ones).alias("u")).select("key", "doc_id", "u.h", "u.g", "u.place")
    # Written, so that both sides of the join are dealt anew, and a unit that very many texts have can be split.
    first = written(rows.groupBy("h", "g").agg(F.count("*").alias("n"), F.min(rank).alias("kept")).where(F.col("n") > 1).select("h", "g", "kept"), "repeated")
    gone = rows.join(first, ["h", "g"]).where(~rank.eqNullSafe(F.col("kept"))).groupBy(F.col("key").alias("gkey"), F.col("doc_id").alias("gdoc")).agg(F.collect_set("place").alias("gone"))
    # By id as well: two documents whose digests are equal by chance keep apart.
    joined = texts.join(gone, (F.col("key") == F.col("gkey")) & F.col("doc_id").eqNullSafe(F.col("gdoc")), "left").select("doc_id", "text", "gone")
    pattern, inner = UNITS[unit], UNITS.get(parts)
    schema = T.StructType([texts.schema["doc_id"], T.StructField("n_units", T.LongType()), T.StructField("text", T.StringType()), T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, cut_parts = re.compile(pattern), inner and re.compile(inner)

        def spans(text: str) -> Iterator[tuple[int, int, int, int]]:
            """(unit, part, start, end) of what is counted."""
            for i, m in enumerate(cut.finditer(text)):
                if cut_parts is None:
                    yield i, WHOLE, m.start(), m.end()
                else:
                    for j, p in enumerate(cut_parts.finditer(m[0])):
                        yield i, j, m.start() + p.start(), m.start() + p.end()

        for batch in batches:
            n, kept, removed = [], [], []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                if gone is None:
                    n.append(sum(1 for _ in spans(text)))
                    kept.append(text)
                    removed.append([])
                    continue
                tiles, gone = list(spans(text)), {(x["unit"], x["part"]) for x in gone} if inner else {(i, WHOLE) for i in gone}
                goes = [(i, j) in gone or (i, WHOLE) in gone for i, j, _, _ in tiles]
                n.append(len(tiles))
                kept.append("".join(text[a:b] for (_, _, a, b), out in zip(tiles, goes, strict=True) if not out))
                removed.append([{"start": a, "end": b} for (_, _, a, b), out in zip(tiles, goes, strict=True) if out])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(kept, pa.string()), pa.array(removed, kind)], names=schema.names)

    return joined.mapInArrow(released(run), schema)

"""Merkle fingerprints of documents, in DataFrame functions only.

A text is cut into pieces by its content: after a blank behind an a, at the end of a line, and otherwise after 128 code
points; so an edit moves no border but those beside it. The SHA-256 of each piece is a leaf. The pieces up to a line's
end are a paragraph, whose node is the SHA-256 of its leaves' digests. A section ends after a paragraph whose digest
begins with 0, 1, 2 or 3; its node is the SHA-256 of its paragraphs' digests, the root that of its sections'.
Two texts are equal if their roots are, and where roots differ, differing sections, then paragraphs and
then leaves show the place (``differing``). ``likeness`` is the Dice coefficient of two trees' distinct leaves.

Defined results: a null text is an empty one, without leaves; two texts without leaves are alike (1.0);
repeated rows have equal fingerprints and the same next document, the first row of another id or text; rows that share
an id come in the order of their texts' digests; a row with a null id is its own next document, and so is the only row;
of a very long text the time follows its length; columns other than the two named are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import dropped, written

PIECE = r"[^\n]{1,127}?a |[^\n]{1,128}\n?|\n"


def leaves(text: Column) -> Column:
    """Digests of a text's pieces; the last of a line that has an end is marked by a bar."""
    return F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda p: F.when(p.endswith("\n"), F.concat(F.sha2(p, 256), F.lit("|"))).otherwise(F.sha2(p, 256)))


def paragraphs(own: Column) -> Column:
    """The nodes above leaves: a digest for each line."""
    return F.transform(F.filter(F.split(F.array_join(own, ""), r"\|"), lambda s: s != ""), lambda s: F.sha2(s, 256))


def sections(nodes: Column) -> Column:
    """Digests of sections of paragraphs."""
    marked = F.array_join(F.transform(nodes, lambda d: F.when(F.substring(d, 1, 1) < "4", F.concat(d, F.lit("|"))).otherwise(d)), "")
    return F.transform(F.filter(F.split(marked, r"\|"), lambda s: s != ""), lambda s: F.sha2(s, 256))


def root(nodes: Column) -> Column:
    """The fingerprint of a text's paragraphs: equal for equal texts and for no others."""
    return F.sha2(F.array_join(sections(nodes), ""), 256)


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of two texts' distinct leaves."""
    total = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def differing(a: Column, b: Column) -> Column:
    """Positions at which two arrays of digests, of sections or of paragraphs, differ."""
    n = F.greatest(F.size(a), F.size(b))
    return F.filter(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: ~F.get(a, i).eqNullSafe(F.get(b, i)))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, sections, paragraphs, leaves) of every row."""
    out = docs.select(F.col(id_col).alias("doc_id"), leaves(F.coalesce(F.col(text_col), F.lit(""))).alias("leaves"))
    out = out.withColumn("paragraphs", paragraphs(F.col("leaves"))).withColumn("sections", sections(F.col("paragraphs")))
    return out.select("doc_id", F.sha2(F.array_join("sections", ""), 256).alias("fingerprint"), "sections", "paragraphs", "leaves")


def with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, next_text): each row with the text of the next id; the last has the first's.

    Ids alone are sorted, in written ranges; each range's first goes to the one before. Texts then meet by equal keys:
    whatever the ids, no range of them is one task's, and a text moves once to its own key and once to the one before.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("own_id"), text.alias("own_text"), F.xxhash64(text).alias("h"))
    known = rows.where(F.col("own_id").isNotNull())
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(known.select("own_id", "h").distinct().repartitionByRange(parts, "own_id", "h").withColumn("part", F.spark_partition_id()), "ranges")
    # One row for each range.
    heads = ranged.groupBy("part").agg(F.min(F.struct("own_id", "h")).alias("head"))
    every = Window.orderBy("part")
    heads = heads.select("part", F.coalesce(F.lead("head").over(every), F.min("head").over(Window.partitionBy())).alias("follows"))
    order = Window.partitionBy("part").orderBy("own_id", "h")
    after = ranged.withColumn("after", F.lead(F.struct("own_id", "h")).over(order)).join(F.broadcast(heads), "part").withColumn("after", F.coalesce("after", "follows"))
    after = written(after.select(F.col("own_id").alias("at_id"), F.col("h").alias("at_h"), F.col("after.own_id").alias("next_id"), F.col("after.h").alias("next_h")), "next")
    dropped(ranged)
    # Both joins read one exchange of the texts by their own keys; rows repeated whole give their text once.
    once = known.withColumn("again", F.lag(F.lit(True)).over(Window.partitionBy("own_id", "h").orderBy("h"))).where(F.col("again").isNull())
    first = once.select(F.col("own_id").alias("other_id"), F.col("h").alias("other_h"), F.col("own_text").alias("other"))
    texts = known.join(after, (F.col("own_id") == F.col("at_id")) & (F.col("h") == F.col("at_h"))).select("own_id", "own_text", "next_id", "next_h")
    out = texts.join(first, (F.col("next_id") == F.col("other_id")) & (F.col("next_h") == F.col("other_h"))).select(F.col("own_id").alias("doc_id"), F.col("own_text").alias("text"), F.col("other").alias("next_text"))
    return out.unionByName(rows.where(F.col("own_id").isNull()).select(F.col("own_id").alias("doc_id"), F.col("own_text").alias("text"), F.col("own_text").alias("next_text")))

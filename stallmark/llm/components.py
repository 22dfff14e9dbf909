"""Connected components by minimum labels and pointer jumping, in joins and minimum aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def components(edges: DataFrame) -> DataFrame:
    """(v, root) of every vertex of ``edges`` (a, b): root is the smallest vertex that v reaches.

    A round takes, for each vertex, the smallest label among itself and its neighbours, and then the
    label of that label. Rounds follow the logarithm of the longest path; each is written, so that a
    lost executor costs one round.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where(F.col("a") != F.col("b")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "root"), "b").groupBy(F.col("a").alias("v")).agg(F.min("root").alias("near"))
        better = labels.join(near, "v").select("v", F.least("root", "near").alias("up"), F.col("root").alias("was"))
        jump = better.join(labels.select(F.col("v").alias("up"), F.col("root").alias("upper")), "up", "left").select("v", F.least("up", F.coalesce("upper", "up")).alias("root"), "was")
        out = written(jump, "labels")
        labels = out.select("v", "root")
        if out.where(F.col("root") != F.col("was")).isEmpty():
            return labels

"""A keyed store of Parquet files: rows are overwritten by identity, expire by age, and are found by buckets of their keys.

``data/version=<v>/bucket=<b>`` holds a bucket as of the save that last touched it, ``manifest/save=<n>`` which version of each
bucket is live after save n. A save writes the buckets that it touches, under a name of its own, and then its manifest: readers
see a save whole or not at all, one that fails leaves files that no manifest names, and of two with one number the second fails.
The manifest is as long as there are buckets, which is fixed when the store begins; nothing else comes to the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cut import removed

MANIFEST = "bucket int, version string, save int"


class Store:
    """Rows of ``schema``, one for each identity (columns ``identity``, the first is the key that is looked up).

    ``age``: the column of the time that a row is of. A null key is a key like any other.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, identity: list[str], age: str, buckets: int = 64) -> None:
        self.spark, self.path, self.schema, self.identity, self.age, self.buckets = spark, path.rstrip("/"), schema, identity, age, buckets

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def saves(self) -> DataFrame:
        """The manifests of all saves."""
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
        except AnalysisException:  # nothing has been saved
            return self.spark.createDataFrame([], MANIFEST)

    def live(self) -> tuple[int, dict[int, str]]:
        """The last save and the live version of each bucket; save 0 is the empty store."""
        rows = self.saves()
        last = rows.agg(F.max("save")).first()[0] or 0
        return last, {r["bucket"]: r["version"] for r in rows.where(F.col("save") == last).collect()}

    def rows(self, versions: dict[int, str], buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows of live buckets; ``buckets`` prunes the folders that are read."""
        if not versions:
            return self.spark.createDataFrame([], f"{self.schema}, version string, bucket int")
        out = self.spark.read.schema(f"{self.schema}, version string, bucket int").parquet(f"{self.path}/data")
        wanted = sorted(versions if buckets is None else set(buckets) & set(versions))
        by_version: dict[str, list[int]] = {}
        for b in wanted:
            by_version.setdefault(versions[b], []).append(b)
        here = F.lit(False)
        for v, own in by_version.items():
            here = here | ((F.col("version") == v) & F.col("bucket").isin(own))
        return out.where(here)

    def read(self, as_of: Column | None = None, ttl_seconds: int | Column | None = None, keys: list | None = None) -> DataFrame:
        """Live rows, those of ``keys`` alone if given, that are not as old as ``ttl_seconds`` at ``as_of``.

        A list of keys reads their buckets alone.
        """
        _, versions = self.live()
        key = F.col(self.identity[0])
        if keys is not None:
            kind = self.spark.createDataFrame([], self.schema).schema[self.identity[0]].dataType
            asked = self.spark.createDataFrame([(k,) for k in keys], f"k {kind.simpleString()}").select(self.bucket(F.col("k")).alias("b")).distinct().collect()
            out = self.rows(versions, [r["b"] for r in asked]).where(key.isin([k for k in keys if k is not None]) | (key.isNull() if None in keys else F.lit(False)))
        else:
            out = self.rows(versions)
        return self._fresh(out, as_of, ttl_seconds).drop("version", "bucket")

    def _fresh(self, rows: DataFrame, as_of: Column | None, ttl_seconds: int | Column | None) -> DataFrame:
        if as_of is None:
            return rows
        ttl = F.lit(ttl_seconds) if isinstance(ttl_seconds, int) else ttl_seconds
        return rows.where(F.col(self.age) > as_of - F.make_interval(secs=ttl))

    def upsert(self, rows: DataFrame, newest: list[Column], as_of: Column | None = None, ttl_seconds: int | Column | None = None) -> int:
        """Save ``rows``: each replaces the row of its identity; of several the one that is last by ``newest`` stands.

        Only buckets that ``rows`` touch are read and written again; rows of theirs that have expired are left out.
        ``rows`` is read twice: once for the buckets that it touches.
        """
        names = self.spark.createDataFrame([], self.schema).columns
        new = rows.withColumn("bucket", self.bucket(F.col(self.identity[0])))
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
        last, versions = self.live()
        if not touched:
            return last
        order = F.struct(*(c.alias(f"_{i}") for i, c in enumerate(newest)))
        same = ["bucket", *self.identity]
        new = new.groupBy(*same).agg(F.max_by(F.struct(*names), order).alias("_row")).select("bucket", "_row.*")
        old = self.rows(versions, touched).drop("version")
        gone = [old[c].eqNullSafe(new[c]) for c in same]
        both = self._fresh(old.join(new, gone, "left_anti").unionByName(new), as_of, ttl_seconds)
        version = f"{last + 1}-{uuid.uuid4().hex}"
        # By bucket, and parts of one that is large: one key may hold much of all rows.
        both.hint("rebalance", "bucket").write.partitionBy("bucket").mode("errorifexists").parquet(f"{self.path}/data/version={version}")
        live = versions | dict.fromkeys(touched, version)
        self.spark.createDataFrame(sorted(live.items()), "bucket int, version string").coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/manifest/save={last + 1}")
        return last + 1

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove what none of the last ``keep`` saves names: older manifests first, then buckets, those of failed saves too.

        Readers of the kept saves go on; files of a save that is on its way have a later number and stay.
        """
        rows = self.saves()
        last = rows.agg(F.max("save")).first()[0] or 0
        if not last:
            return []
        kept = {(r["version"], r["bucket"]) for r in rows.where(F.col("save") > last - keep).select("version", "bucket").distinct().collect()}
        saves = [r["save"] for r in rows.where(F.col("save") <= last - keep).select("save").distinct().collect()]
        there = self.spark.read.schema(f"{self.schema}, version string, bucket int").parquet(f"{self.path}/data").select("version", "bucket").distinct()
        done = {(r["version"], r["bucket"]) for r in there.where(F.split("version", "-")[0].cast("int") <= last).collect()}
        old = [f"{self.path}/manifest/save={n}" for n in sorted(saves)] + [f"{self.path}/data/version={v}/bucket={b}" for v, b in sorted(done - kept)]
        for path in old:
            removed(self.spark, path)
        return old

"""The keyed store: upserts, expiry, pruned reads, and what is left when saves fail or old files go."""

import datetime as dt
import glob
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stallmark.sources.store import Store

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "key string, platform string, ts timestamp, price double"


def rows(spark, *given):
    return spark.createDataFrame([(k, p, DAY + dt.timedelta(days=d), v, n) for n, (k, p, d, v) in enumerate(given)], SCHEMA + ", n int")


def shown(df):
    return {(r["key"], r["platform"], r["ts"].day, r["price"]) for r in df.collect()}


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), SCHEMA, ["key", "platform", "ts"], "ts", buckets=8)


def test_upserts_replace_by_identity_and_touch_their_buckets_alone(spark, store):
    assert store.read().collect() == [] and store.live() == (0, {})
    many = [(f"k{i}", "a", 0, float(i)) for i in range(40)]
    assert store.upsert(rows(spark, *many, (None, "a", 0, 5.0)), [F.col("n")]) == 1
    before = set(glob.glob(f"{store.path}/data/*/*/*.parquet"))
    assert store.upsert(rows(spark, ("k3", "a", 0, 1.0), ("k3", "a", 0, 99.0), ("k3", "b", 0, 7.0), (None, "a", 0, 6.0)), [F.col("n")]) == 2
    got = shown(store.read())
    assert got == {(k, p, 1, v) for k, p, _, v in many if k != "k3"} | {("k3", "a", 1, 99.0), ("k3", "b", 1, 7.0), (None, "a", 1, 6.0)}
    assert before <= set(glob.glob(f"{store.path}/data/*/*/*.parquet")) and len(glob.glob(f"{store.path}/data/version=2-*/bucket=*")) <= 2
    assert store.upsert(rows(spark).limit(0), [F.col("n")]) == 2


def test_keys_are_found_in_their_buckets(spark, store):
    store.upsert(rows(spark, *[(f"k{i}", "a", 0, float(i)) for i in range(60)], (None, "a", 0, 5.0)), [F.col("n")])
    found = store.read(keys=["k7", None, "nobody"])
    assert shown(found) == {("k7", "a", 1, 7.0), (None, "a", 1, 5.0)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket#" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    # Files of other buckets are broken now, and nobody notices.
    own = {spark.createDataFrame([(k,)], "k string").select(store.bucket(F.col("k"))).first()[0] for k in ("k7", None, "nobody")}
    others = [f for b in range(8) if b not in own for f in glob.glob(f"{store.path}/data/*/bucket={b}/*.parquet")]
    for f in others:
        Path(f).write_text("broken")
    assert others and shown(store.read(keys=["k7", None, "nobody"])) == {("k7", "a", 1, 7.0), (None, "a", 1, 5.0)}


def test_rows_expire(spark, store):
    now, ttl = F.lit(DAY + dt.timedelta(days=10)), 3 * 86400
    store.upsert(rows(spark, ("a", "x", 1, 1.0), ("a", "x", 8, 2.0), ("b", "x", 7, 3.0), ("b", "x", 9, 4.0)), [F.col("n")])
    assert shown(store.read(now, ttl)) == {("a", "x", 9, 2.0), ("b", "x", 10, 4.0)}
    each = F.when(F.col("key") == "a", 86400).otherwise(100 * 86400)
    assert shown(store.read(now, each)) == {("b", "x", 8, 3.0), ("b", "x", 10, 4.0)}
    store.upsert(rows(spark, ("a", "x", 9, 5.0)), [F.col("n")], now, ttl)
    assert ("a", "x", 2, 1.0) not in shown(store.read()) and ("a", "x", 10, 5.0) in shown(store.read())


def test_old_files_go_and_failed_saves_do_not_count(spark, store):
    for v in range(4):
        store.upsert(rows(spark, ("a", "x", 0, float(v)), (f"k{v}", "x", 0, 1.0)), [F.col("n")])
    whole = shown(store.read())
    reader = store.read()
    # Files of saves that never came to their manifests: one is over, one may be on its way.
    for v in ("3-lost", "5-going"):
        rows(spark, ("a", "x", 0, 77.0)).drop("n").write.parquet(f"{store.path}/data/version={v}/bucket=0")
    gone = store.vacuum(1)
    assert f"{store.path}/data/version=3-lost/bucket=0" in gone and f"{store.path}/data/version=5-going/bucket=0" not in gone
    assert shown(reader) == whole == shown(store.read()) and store.live()[0] == 4
    assert {p.split("save=")[1] for p in glob.glob(f"{store.path}/manifest/save=*")} == {"4"}
    # A second writer of the same save fails, and what it wrote is not read.
    before = store.live()
    store.upsert(rows(spark, ("a", "x", 0, 55.0)), [F.col("n")])
    store.live = lambda: before
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        store.upsert(rows(spark, ("a", "x", 0, 66.0)), [F.col("n")])
    del store.live
    assert ("a", "x", 1, 55.0) in shown(store.read())


def test_cleanup_keeps_versions_that_a_later_save_left_alone(spark, store):
    store.upsert(rows(spark, *[(f"k{i}", "a", 0, float(i)) for i in range(40)]), [F.col("n")])
    for v in range(3):
        store.upsert(rows(spark, ("k1", "a", 0, float(v))), [F.col("n")])
    store.vacuum(1)
    assert len(shown(store.read())) == 40

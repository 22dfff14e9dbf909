"""Registered queries over the keyed store, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.cut import place
from ..sources.store import Store
from .catalog import query
from .view import OBSERVATION, observations, table

DAY = 86400
#: For how long the sample keeps a price.
TTL = 10 * DAY


def _saved(spark, sf_dir):
    """Two saves of prices: two thirds of all; then the others, with other prices for some that are there, and for some twice."""
    rows = observations(spark, sf_dir).select("key", "platform", "ts", "price", "ord")
    now = F.lit(rows.agg(F.max("ts")).first()[0])
    store = Store(spark, place(spark, "prices"), "key long, platform string, ts timestamp_ntz, price long, ord long", ["key", "platform", "ts"], "ts")
    store.upsert(rows.where("ord % 3 < 2"), [F.col("ord")])
    again = rows.where("ord % 10 = 0")
    changed = again.withColumn("price", F.col("price") + 7).unionByName(again.withColumns({"price": F.col("price") + 9, "ord": F.col("ord") + 1_000_000_000}))
    store.upsert(rows.where("ord % 3 = 2").unionByName(changed), [F.col("ord")], now, TTL)
    store.vacuum(1)
    return store, now


_LIVE = f"""WITH {OBSERVATION}, w AS (SELECT *, 1 AS save FROM observation WHERE ord % 3 < 2 UNION ALL SELECT *, 2 FROM observation WHERE ord % 3 = 2 UNION ALL SELECT key, platform, ts, price + 7, ord, 2 FROM observation WHERE ord % 10 = 0 UNION ALL SELECT key, platform, ts, price + 9, ord + 1000000000, 2 FROM observation WHERE ord % 10 = 0),
live AS (SELECT key, platform, ts, arg_max(price, (save, ord)) AS price FROM w GROUP BY ALL HAVING ts > (SELECT max(ts) FROM observation) - INTERVAL 10 DAY)"""


@query(_LIVE + " SELECT key, platform, ts, price FROM live")
def store_reload(spark, sf_dir):
    """What the store holds after a save, an upsert over it, expiry and the removal of old files."""
    store, now = _saved(spark, sf_dir)
    return store.read(now, TTL).select("key", "platform", "ts", "price")


@query(_LIVE + " SELECT key, count(*) AS prices, CAST(sum(price) AS BIGINT) AS total FROM live WHERE key IN (SELECT n_nationkey FROM nation) GROUP BY key")
def store_lookup(spark, sf_dir):
    """Keys of another table, found in their buckets alone."""
    store, now = _saved(spark, sf_dir)
    keys = [r[0] for r in table(spark, sf_dir, "nation").select("n_nationkey").collect()]
    return store.read(now, TTL, keys).groupBy("key").agg(F.count("*").alias("prices"), F.sum("price").alias("total"))

"""An extension: running extremes of prices per key as a stream with state, timers and a side output for late rows.

Rows (key, ts, seen, price): ``ts`` is when a price held, ``seen`` when it came in. The watermark follows ``seen``. A row that came
in later than ``late`` after its time goes to the side output and changes nothing, as does one without time or price. A key that has
not been seen for ``idle`` is told a last time and forgotten; if it comes back it begins anew.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

SCHEMA = "key string, ts timestamp, seen timestamp, price double"
#: kind: "running" after every batch of a key, "expired" at its end, "late" for a row of the side output.
OUTPUT = "kind string, key string, ts timestamp, seen timestamp, price double, low double, high double, n long"
PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ms(t: pd.Timestamp) -> int:
    return int(t.value // 1_000_000)


class Extremes(StatefulProcessor):
    """Low, high and number of a key's prices; a timer at its last arrival and ``idle``."""

    def __init__(self, late: dt.timedelta, idle: dt.timedelta) -> None:
        self.late, self.idle = late, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.told = handle.getValueState("told", "low double, high double, n long, seen_ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        low, high, n, seen = self.told.get() if self.told.exists() else (float("inf"), float("-inf"), 0, 0)
        before = seen
        for chunk in rows:  # chunks of a batch: a key of any size is never held whole
            usable = chunk["ts"].notna() & chunk["price"].notna() & (chunk["seen"] - chunk["ts"] <= self.late)
            if not usable.all():
                yield self._out("late", key[0], chunk[~usable])
            good = chunk[usable]
            if len(good):
                low, high, n = min(low, good["price"].min()), max(high, good["price"].max()), n + len(good)
                seen = max(seen, _ms(good["seen"].max()))
        if seen > before or n:
            self.told.update((float(low), float(high), int(n), seen))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(seen + int(self.idle.total_seconds() * 1000))
            yield self._one("running", key[0], low, high, n, seen)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        low, high, n, seen = self.told.get()
        self.told.clear()
        yield self._one("expired", key[0], low, high, n, seen)

    def close(self) -> None:
        pass

    @staticmethod
    def _out(kind: str, key: str, rows: pd.DataFrame) -> pd.DataFrame:
        empty = {c: pd.Series([None] * len(rows), dtype=t) for c, t in (("low", "float64"), ("high", "float64"), ("n", "Int64"))}
        return pd.DataFrame({"kind": kind, "key": key, "ts": rows["ts"].to_numpy(), "seen": rows["seen"].to_numpy(), "price": rows["price"].to_numpy()} | empty)

    @staticmethod
    def _one(kind: str, key: str, low: float, high: float, n: int, seen: int) -> pd.DataFrame:
        return pd.DataFrame({"kind": [kind], "key": [key], "ts": pd.Series([None], dtype="datetime64[ns]"), "seen": [pd.Timestamp(seen, unit="ms")], "price": pd.Series([None], dtype="float64"), "low": [float(low)], "high": [float(high)], "n": pd.Series([n], dtype="Int64")})


def extremes(rows: DataFrame, late: dt.timedelta, idle: dt.timedelta, disorder: str = "0 seconds") -> DataFrame:
    """OUTPUT of the stream ``rows`` (state in ROCKS); ``disorder``: how far arrivals may be out of the order of ``seen``."""
    rows = rows.withWatermark("seen", disorder)
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=Extremes(late, idle), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")


def start(spark: SparkSession, source: str, to: str, checkpoint: str, late: dt.timedelta, idle: dt.timedelta, files_at_once: int = 100) -> StreamingQuery:
    """Everything that has come to the folder ``source``: running and expired keys and late rows to folders ``to``/kind=..., each row once."""
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_at_once).parquet(source)
    out = extremes(rows, late, idle).writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).partitionBy("kind").outputMode("append").trigger(availableNow=True)
    # State of this kind needs this provider; other streams of the session keep theirs.
    provider = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        return out.start()
    finally:
        spark.conf.set(PROVIDER, provider)

"""Conversation turns put back in order as they arrive: a stateful stream over hash buckets of conversations.

Every conversation belongs to one bucket; a bucket is one key of ``applyInPandasWithState``, and its state is the columns of
all its conversations and of the turns that wait, as zstd-compressed Arrow. Every batch holds a tick row for each bucket, so
that buckets without arrivals count the batch as well. What has been released needs no row any more: a conversation keeps the
next turn, the last role and a count.

Defined results: rows without a turn are left out; a null role or text is empty; null conversation ids are one conversation
(in a bucket of its own); of equal turns in one batch only the smallest payload (``role|text``, by bytes) arrives, rows
repeated whole once; empty tables give no events; texts of any length are kept whole; further columns are left out, whatever
their names. ``n_missing`` stops at the largest long. All turns of one conversation are in one bucket: its turns that wait
share one state, and nothing else does.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .shared import place, small_batches

#: Successive batches without arrivals that close a conversation.
IDLE = 3
#: Arrivals for which there is one more bucket, and the least number of buckets.
BUCKET_ROWS, LEAST_BUCKETS = 8192, 16

ARRIVAL = "bucket long, batch int, tick boolean, last boolean, conv_id long, turn long, first long, role string, text string"
EVENT = "event string, conv_id long, turn long, batch long, role string, text string, unreleased array<long>, n_missing long, n_breaks long"
STATE = "conversations binary, waiting binary"
#: The bucket of the conversation without an id.
NO_ID = -1

CONVERSATIONS = pa.schema([("id", pa.int64()), ("first", pa.int64()), ("next", pa.int64()), ("heard", pa.int64()), ("breaks", pa.int64()), ("open", pa.bool_()), ("role", pa.large_string())])
WAITING = pa.schema([("at", pa.int64()), ("turn", pa.int64()), ("role", pa.large_string()), ("text", pa.large_string())])

Columns = dict[str, np.ndarray]


def packed(columns: Columns, schema: pa.Schema) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.table([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
    with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes | None, schema: pa.Schema) -> Columns:
    table = pa.ipc.open_stream(data).read_all() if data else schema.empty_table()
    return {name: table[name].to_numpy() for name in schema.names}


def taken(columns: Columns, which: np.ndarray) -> Columns:
    return {k: v[which] for k, v in columns.items()}


def repeats(*keys: np.ndarray) -> np.ndarray:
    """Which rows have the keys of the row before."""
    out = np.zeros(len(keys[0]), bool)
    out[1:] = np.logical_and.reduce([k[1:] == k[:-1] for k in keys])
    return out


def arrived(rows: Columns) -> Columns:
    """By conversation and turn; of equal ones the smallest payload. Code points compare as their bytes do."""
    rows = taken(rows, np.lexsort((rows["turn"], rows["conv_id"])))
    again = repeats(rows["conv_id"], rows["turn"])
    if again.any():
        payload = np.array([f"{r}|{t}" for r, t in zip(rows["role"], rows["text"], strict=True)], object)
        rows = taken(rows, np.lexsort((pd.factorize(payload, sort=True)[0], rows["turn"], rows["conv_id"])))
        rows = taken(rows, ~repeats(rows["conv_id"], rows["turn"]))
    return rows


def with_new(conv: Columns, wait: Columns, rows: Columns) -> tuple[Columns, Columns]:
    """The conversations, those of ``rows`` among them, by id; what waits follows their new places."""
    ids, at = np.unique(rows["conv_id"], return_index=True)
    fresh = ~np.isin(ids, conv["id"])
    new, n = at[fresh], int(fresh.sum())
    added = {"id": ids[fresh], "first": rows["first"][new], "next": rows["first"][new], "heard": np.zeros(n, int), "breaks": np.zeros(n, int), "open": np.ones(n, bool), "role": np.full(n, None, object)}
    both = {k: np.concatenate([conv[k], added[k]]) for k in conv}
    order = np.argsort(both["id"], kind="stable")
    places = np.empty(len(order), int)
    places[order] = np.arange(len(order))
    return taken(both, order), wait | {"at": places[wait["at"]]}


def told(kind: str, batch: int, conv_id: np.ndarray, turn: np.ndarray, role=None, text=None, unreleased=None, n_missing=None, n_breaks=None) -> pd.DataFrame:
    n = len(conv_id)

    def some(x: object, kind: object) -> object:
        return pd.array([None] * n if x is None else x, dtype=kind) if kind != "object" else pd.Series([None] * n if x is None else list(x), dtype=object)

    return pd.DataFrame({"event": kind, "conv_id": some(conv_id, "Int64"), "turn": turn, "batch": batch, "role": some(role, "object"), "text": some(text, "object"), "unreleased": some(unreleased, "object"), "n_missing": some(n_missing, "Int64"), "n_breaks": some(n_breaks, "Int64")})


def step(conv: Columns, wait: Columns, rows: Columns, batch: int, end: bool) -> tuple[Columns, Columns, list[pd.DataFrame]]:
    """One batch of one bucket: the state after it, and its events."""
    out, rows = [], arrived(rows)
    conv, wait = with_new(conv, wait, rows)
    at = np.searchsorted(conv["id"], rows["conv_id"])
    refused = ~conv["open"][at]
    bad = taken(rows, refused)
    out.append(told("reject", batch, bad["conv_id"], bad["turn"], bad["role"], bad["text"]))

    rows, at = taken(rows, ~refused), at[~refused]
    conv["heard"][at] = batch
    # The first arrival of a turn wins: those that wait stand before the new ones, and the sort is stable.
    new = rows["turn"] >= conv["next"][at]
    wait = {"at": np.concatenate([wait["at"], at[new]])} | {k: np.concatenate([wait[k], rows[k][new]]) for k in ("turn", "role", "text")}
    wait = taken(wait, np.lexsort((wait["turn"], wait["at"])))
    wait = taken(wait, ~repeats(wait["at"], wait["turn"]))

    # Turns differ and rise, so a turn belongs to the gapless run if and only if it is as far from the next one as from the group's first row.
    who, turn, role = wait["at"], wait["turn"], wait["role"]
    rank = np.arange(len(who)) - np.searchsorted(who, who)
    run = turn == conv["next"][who] + rank
    before = np.where(rank == 0, conv["role"][who], np.concatenate([[None], role[:-1]]) if len(role) else role)
    follows = np.where(rank == 0, run & (conv["next"][who] > conv["first"][who]), np.concatenate([[False], turn[1:] - 1 == turn[:-1]]) if len(turn) else run)
    broken = follows & np.array(before == role, bool)
    conv["breaks"] = conv["breaks"] + np.bincount(who[run & broken], minlength=len(conv["id"]))
    out.append(told("release", batch, conv["id"][who[run]], turn[run], role[run], wait["text"][run]))
    conv["next"] = conv["next"] + np.bincount(who[run], minlength=len(conv["id"]))
    conv["role"][who[run]] = role[run]  # rows are in the order of turns: the last one stays
    wait, broken = taken(wait, ~run), broken[~run]

    closing = conv["open"] & (end | (batch - conv["heard"] >= IDLE))
    here = np.flatnonzero(closing)
    begin, stop = np.searchsorted(wait["at"], here), np.searchsorted(wait["at"], here, "right")
    lists = [wait["turn"][a:b] for a, b in zip(begin, stop, strict=True)]
    breaks = conv["breaks"] + np.bincount(wait["at"][broken], minlength=len(conv["id"]))
    # Whole numbers of any size: turns may lie further apart than a long can say.
    missing = [min(int(x[-1]) - int(n) + 1 - len(x), 2**63 - 1) if len(x) else 0 for x, n in zip(lists, conv["next"][here], strict=True)]
    out.append(told("close", batch, conv["id"][here], np.full(len(here), -1), unreleased=lists, n_missing=missing, n_breaks=breaks[here]))
    conv["open"] = conv["open"] & ~closing
    return conv, taken(wait, ~closing[wait["at"]]), out


def bucket_batch(key: tuple[int], chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    # Spark joins the frames of several keys; columns that are null in all rows of one are right as they are.
    warnings.filterwarnings("ignore", "The behavior of DataFrame concatenation", FutureWarning)
    chunks = pd.concat(list(chunks))
    (batch,) = set(chunks["batch"])
    rows = chunks[~chunks["tick"]]
    blobs = state.get if state.exists else (None, None)
    conv, wait = unpacked(blobs[0], CONVERSATIONS), unpacked(blobs[1], WAITING)
    conv = {k: v.copy() for k, v in conv.items()}  # what Arrow hands out is read-only
    conv, wait, out = step(conv, wait, {k: rows[k].to_numpy() for k in ("conv_id", "turn", "first", "role", "text")}, int(batch), bool(chunks["last"].any()))
    state.update((packed(conv, CONVERSATIONS), packed(wait, WAITING)))
    if out := [x for x in out if len(x)]:
        out = pd.concat(out)
        if key[0] == NO_ID:
            out["conv_id"] = pd.array([None] * len(out), dtype="Int64")
        yield out


def feed_rows(arrivals: DataFrame, buckets: int) -> DataFrame:
    """Arrivals (batch, conv_id, turn, first, role, text) with their buckets."""
    bucket = F.when(F.col("conv_id").isNull(), NO_ID).otherwise(F.pmod(F.xxhash64("conv_id"), F.lit(buckets)))
    return arrivals.select(bucket.cast("long").alias("bucket"), F.col("batch").cast("int"), F.lit(False).alias("tick"), F.lit(False).alias("last"), F.coalesce("conv_id", F.lit(0).cast("long")).alias("conv_id"), "turn", "first", "role", "text")


def ticks(like: DataFrame, buckets: int, batch: int, last: bool) -> DataFrame:
    zero = F.lit(0).cast("long")
    rows = like.sparkSession.range(NO_ID, buckets)
    return rows.select(F.col("id").alias("bucket"), F.lit(batch).alias("batch"), F.lit(True).alias("tick"), F.lit(last).alias("last"), zero.alias("conv_id"), zero.alias("turn"), zero.alias("first"), F.lit("").alias("role"), F.lit("").alias("text"))


def reassembled(arrivals: DataFrame, batches: int) -> DataFrame:
    """Events (EVENT) of ``arrivals`` (batch 0 to ``batches`` - 1, conv_id, turn, first, role, text), which come in by batches.

    The batches are written to a new folder, one after another; a streaming query is started for each on the same checkpoint.
    After the last one the end closes what is open, as batch ``batches``.
    """
    spark = arrivals.sparkSession
    small_batches(spark)
    root = place(spark, "turns")
    buckets = max(LEAST_BUCKETS, arrivals.count() // BUCKET_ROWS)
    feed_rows(arrivals, buckets).write.partitionBy("batch").parquet(f"{root}/arrivals")
    rows = spark.read.schema(ARRIVAL).parquet(f"{root}/arrivals")
    for batch in range(batches + 1):
        tick = ticks(rows, buckets, batch, batch == batches)
        part = rows.where(F.col("batch") == batch).unionByName(tick) if batch < batches else tick
        part.write.mode("append").parquet(f"{root}/feed")
        events = spark.readStream.schema(ARRIVAL).parquet(f"{root}/feed").groupBy("bucket").applyInPandasWithState(bucket_batch, EVENT, STATE, "append", GroupStateTimeout.NoTimeout)
        query = events.writeStream.format("parquet").option("path", f"{root}/events").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(EVENT).parquet(f"{root}/events")

"""Product codes of vectors: integer codebooks by rounds of nearest entries, searched by partial distances.

A vector's components become whole numbers, its parts are coded apart. The nearest entry of a codebook is found by taking
dimensions in the order of their variance over the codebook, the largest first; an entry is dropped as soon as its sum so far
exceeds the best complete distance known for the row. All sums are of whole numbers, so nothing depends on their order.

Codebooks are all that the driver holds: ENTRIES entries a part. A round moves sums of a task, position by position.

Defined results: rows whose vector is null or has a component that is null or not finite are left out; repeated rows are each
coded, and each may begin a codebook entry; null ids come last in the order of ids, rows of one id by their vectors. Vectors
are as long as the first of that order; rows of another length, and all if that length does not fall into PARTS equal parts,
get a null code and error. Of fewer rows than ENTRIES each begins an entry; an empty table gives no rows. Components
stop at a whole number (``bound``) up to which no squared distance exceeds a long; with 64 components that is 134 million.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import released, small_batches

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Leading dimensions that are summed for all entries before the first ones drop, and rows searched at a time.
LEADING, ROWS = 4, 1024

SUMS = "part int, entry int, place int, total long, members long"


def bound(width: int) -> int:
    """The largest component for which a whole squared distance fits into a long."""
    return math.isqrt(2**62 // max(width, 1)) // 2


def integers(values: np.ndarray, width: int) -> np.ndarray:
    most = bound(width)
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -most, most).astype(np.int64)


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest entry, the lowest of equals, and its squared distance."""
    order = np.argsort(-np.var(book.astype(np.float64), axis=0), kind="stable")
    rows, book = rows[:, order], book[:, order]
    n, width = rows.shape
    ahead = min(LEADING, width)
    so_far = np.zeros((n, len(book)), np.int64)
    for d in range(ahead):
        so_far += (rows[:, d, None] - book[None, :, d]) ** 2
    # The entry that leads is summed whole: the first complete distance.
    best = ((rows - book[so_far.argmin(axis=1)]) ** 2).sum(axis=1)
    row, entry = np.nonzero(so_far <= best[:, None])
    total = so_far[row, entry]
    for d in range(ahead, width):
        total = total + (rows[row, d] - book[entry, d]) ** 2
        stays = total <= best[row]
        if not stays.all():
            row, entry, total = row[stays], entry[stays], total[stays]
    # Every row has an entry left, and entries rise within a row.
    begins = np.searchsorted(row, np.arange(n))
    least = np.minimum.reduceat(total, begins) if n else total
    first = np.flatnonzero(total == least[row]) if n else row
    return entry[first[np.unique(row[first], return_index=True)[1]]] if n else entry, least


def searched(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = [nearest(rows[i : i + ROWS], book) for i in range(0, len(rows), ROWS)]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The vectors of a batch whose vectors are all ``width`` long."""
    column = batch.column("vector")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def round_sums(width: int, books: list[np.ndarray]):
    """The sums of the rows that each entry is nearest to, over all rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = width // PARTS
        total, members = np.zeros((PARTS, len(books[0]), part), np.int64), np.zeros((PARTS, len(books[0])), np.int64)
        for batch in batches:
            if batch.num_rows:
                rows = integers(matrix(batch, width), width)
                for p in range(PARTS):
                    own = rows[:, p * part : (p + 1) * part]
                    entry, _ = searched(own, books[p])
                    np.add.at(total[p], entry, own)
                    members[p] += np.bincount(entry, minlength=len(books[p]))
        p, e = np.nonzero(members)
        if len(p):
            long = np.repeat(np.arange(len(p)), part)
            yield pa.record_batch({"part": pa.array(p[long], pa.int32()), "entry": pa.array(e[long], pa.int32()), "place": pa.array(np.tile(np.arange(part), len(p)), pa.int32()), "total": total[p, e].reshape(-1), "members": members[p, e][long]})

    return released(run)


def coding(width: int, books: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = width // PARTS
        for batch in batches:
            if batch.num_rows:
                rows = integers(matrix(batch, width), width)
                found = [searched(rows[:, p * part : (p + 1) * part], books[p]) for p in range(PARTS)]
                error = sum(d for _, d in found)
                code = ["".join(f"{e:02x}" for e in row) for row in np.stack([e for e, _ in found], axis=1).tolist()]
                yield pa.record_batch({"id": batch.column("id"), "label": batch.column("label"), "code": code, "error": error})

    return released(run)


def product_codes(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """Rows (id, label, code, error) of ``table``, and the codebooks (PARTS arrays of entries by places)."""
    small_batches(table.sparkSession)
    x = F.col("x")
    # In double, in which the scaled value of any finite float is finite.
    kept = table.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))))
    first = kept.orderBy(F.col("id").asc_nulls_last(), "vector").limit(1).select(F.size("vector").alias("n")).collect()
    width = first[0]["n"] if first else 0
    if width == 0 or width % PARTS:
        none = kept.select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
        return none, []
    fits = kept.where(F.size("vector") == width)
    begin = integers(np.array([r["vector"] for r in fits.orderBy(F.col("id").asc_nulls_last(), "vector").limit(ENTRIES).select("vector").collect()]), width)
    part = width // PARTS
    books = [begin[:, p * part : (p + 1) * part] for p in range(PARTS)]
    for _ in range(ROUNDS):
        sums = fits.select("vector").mapInArrow(round_sums(width, books), SUMS).groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("members").alias("members"))
        books = [b.copy() for b in books]
        for r in sums.collect():  # PARTS * ENTRIES * part rows at most
            books[r["part"]][r["entry"], r["place"]] = r["total"] // r["members"]
    kinds = {f.name: f.dataType for f in kept.schema.fields}
    schema = f"id {kinds['id'].simpleString()}, label {kinds['label'].simpleString()}, code string, error long"
    coded = fits.mapInArrow(coding(width, books), schema)
    others = kept.where(F.size("vector") != width).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return coded.unionByName(others), books


"""Product codes of vectors, with the nearest codebook entry found by Orchard's search.

Every component becomes the integer floor(256 * x) and every vector is cut into equal parts.
The codebook of a part position starts as that part of the first vectors and is refined by
rounds of assignment and averaging, all in integers, so that any order of adding gives the
same result.

Orchard's search keeps, for every entry, all entries sorted by their distance from it. A part
walks the list of its best entry so far; an entry that is nearer takes over, and the walk goes
on in its list. Entries already met are marked and not measured again. The walk ends at the
first entry that lies more than twice the present distance from the best one: by the triangle
inequality nothing behind it is nearer or as near.

Defined cases:
- a vector takes part if it is not null, holds neither null nor non-finite components and can
  be cut into equal parts; of such vectors, those as long as the one of the smallest id. Other
  rows are dropped. A component so large that squared distances over the whole vector might
  not fit 64 bits counts as non-finite;
- rows without an id come last in the order of ids; equal ids follow their vectors. Repeated
  rows are coded one by one;
- fewer vectors than entries make smaller codebooks; an empty table gives an empty result;
- null labels are one label; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import BROADCAST_ROWS, prepare, written

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
# Rows that a task searches for at once.
ROWS_AT_ONCE = 4096
# A hot label is spread over this many pieces where the labels are too many to broadcast.
SALTS = 32


class Codebooks(NamedTuple):
    """entries[part, entry]; order[part, entry]: all entries by distance from it; reach: a
    quarter of those squared distances, rounded up."""

    entries: np.ndarray
    order: np.ndarray
    reach: np.ndarray

    @property
    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def codebooks(entries: np.ndarray) -> Codebooks:
    gaps = np.stack([np.square(book[:, None] - book[None]).sum(-1) for book in entries])
    order = np.argsort(gaps, axis=2, kind="stable")
    return Codebooks(entries, order, (np.take_along_axis(gaps, order, 2) + 3) // 4)


def orchard(points: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of the nearest entry for points[row, part]; ties to the lower
    entry. All rows and parts walk at once."""
    rows, parts, width = points.shape
    flat = points.reshape(-1, width)
    part = np.tile(np.arange(parts), rows)
    size = books.entries.shape[1]
    best = np.square(flat - books.entries[part, 0]).sum(1)
    entry, place = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)
    met = np.zeros((len(flat), size), bool)
    met[:, 0] = True
    walking = np.arange(len(flat))
    while len(walking):
        at = part[walking], entry[walking], place[walking]
        # Twice the distance is four times its square.
        on = books.reach[at] <= best[walking]
        walking, found = walking[on], books.order[at][on]
        place[walking] += 1
        fresh = ~met[walking, found]
        new, seen = walking[fresh], found[fresh]
        met[new, seen] = True
        distance = np.square(flat[new] - books.entries[part[new], seen]).sum(1)
        nearer = (distance < best[new]) | ((distance == best[new]) & (seen < entry[new]))
        jump = new[nearer]
        best[jump], entry[jump], place[jump] = distance[nearer], seen[nearer], 0
        walking = walking[place[walking] < size]
    return entry.reshape(rows, parts), best.reshape(rows, parts)


def finite(vector: str, limit: float = float("inf")) -> Column:
    """Not null and without null, infinite, undefined or over-large components."""
    usable = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit)
    return F.col(vector).isNotNull() & F.forall(vector, usable)


def coded_vectors(vectors: DataFrame, key: str, vector: str, parts: int) -> tuple[DataFrame, int]:
    """The rows that take part, and their number of components (0: none)."""
    usable = vectors.where(finite(vector) & (F.size(vector) > 0) & (F.size(vector) % parts == 0))
    first = usable.agg(F.min(F.struct(F.col(key).isNull(), F.col(key), F.size(vector).alias("n"))).alias("m"))
    size = first.select("m.n").first()["n"] or 0
    limit = (2.0**63 / max(size, 1)) ** 0.5 / (2 * SCALE) - 1
    return usable.where((F.size(vector) == size) & finite(vector, limit)), size


def whole(values: np.ndarray) -> np.ndarray:
    return np.floor(np.asarray(values, np.float64) * SCALE).astype(np.int64)


def points_of(column: pa.ChunkedArray, parts: int, size: int) -> np.ndarray:
    return whole(column.combine_chunks().flatten()).reshape(-1, parts, size // parts)


def gathered(batches: Iterable[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.Table]:
    """The batches put together until they have some `rows` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def refined(rows: DataFrame, vector: str, books: Codebooks, size: int) -> Codebooks:
    """One round: parts go to their nearest entry, entries to the floored mean of their parts.

    Every task adds its own parts up before anything is shuffled; what comes back has as many
    numbers as the codebooks.
    """
    parts, entries, width = books.entries.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((parts * entries, width), np.int64)
        counts = np.zeros(parts * entries, np.int64)
        for table in gathered(batches):
            points = points_of(table.column(0), parts, size)
            slot = (orchard(points, books)[0] + np.arange(parts) * entries).ravel()
            np.add.at(totals, slot, points.reshape(-1, width))
            counts += np.bincount(slot, minlength=len(counts))
        used = np.flatnonzero(counts)
        sums = pa.array(totals[used].tolist(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), sums], ["slot", "n", "totals"])

    sums = [F.sum(F.col("totals")[i]).alias(f"t{i}") for i in range(width)]
    found = rows.select(vector).mapInArrow(add, "slot long, n long, totals array<long>")
    found = found.groupBy("slot").agg(F.sum("n").alias("n"), *sums).collect()
    new = books.entries.reshape(-1, width).copy()
    for row in found:
        new[row["slot"]] = [row[f"t{i}"] // row["n"] for i in range(width)]
    return codebooks(new.reshape(parts, entries, width))


def fit(rows: DataFrame, key: str, vector: str, size: int, parts: int, entries: int, rounds: int) -> Codebooks:
    first = rows.select(key, vector).orderBy(F.asc_nulls_last(key), vector).limit(entries).collect()
    start = whole([row[vector] for row in first]).reshape(len(first), parts, size // parts)
    books = codebooks(start.transpose(1, 0, 2).copy())
    for _ in range(rounds):
        books = refined(rows, vector, books, size)
    return books


def encoded(rows: DataFrame, key: str, vector: str, label: str, books: Codebooks, size: int) -> DataFrame:
    """key, label, code, error: the entry numbers of all parts and the summed squared distance."""
    parts = len(books.entries)
    names = np.array([f"{i:02x}" for i in range(books.entries.shape[1])])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches):
            entry, distance = orchard(points_of(table.column(2), parts, size), books)
            table = table.select([0, 1]).append_column("code", pa.array(["".join(r) for r in names[entry]]))
            yield from table.append_column("error", pa.array(distance.sum(1))).to_batches()

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    columns = [F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("vector")]
    schema = f"key {kinds[key]}, label {kinds[label]}, code string, error long"
    return rows.select(*columns).mapInArrow(code, schema)


def with_label_error(coded: DataFrame, label_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Adds label_error, the error summed over equal labels; nulls are one label.

    Few labels are broadcast; many are joined over salted labels, so that one label with much
    of the rows is no single task.
    """
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    if totals.limit(label_rows + 1).count() <= label_rows:
        small = F.broadcast(totals.withColumnRenamed("label", "_label"))
        return coded.join(small, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    salted = coded.withColumn("_salt", F.pmod(F.xxhash64("key", "code"), F.lit(SALTS)).cast("int"))
    spread = totals.select(
        F.col("label").alias("_label"), "label_error",
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_other"),
    )
    same = (F.col("_salt") == F.col("_other")) & F.col("label").eqNullSafe(F.col("_label"))
    return salted.join(spread, same).drop("_salt", "_other", "_label")


def encode_vectors(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> DataFrame:
    """key, code, error, label_error, codebooks_sha256 of every vector that takes part."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    prepare(vectors.sparkSession)
    rows, size = coded_vectors(vectors.select(key, vector, label), key, vector, parts)
    if not size or rows.isEmpty():
        empty = vectors.select(F.col(key), *[F.lit(None).cast(t).alias(n) for n, t in (
            ("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))])
        return empty.limit(0)
    books = fit(rows, key, vector, size, parts, entries, rounds)
    coded = written(encoded(rows, key, vector, label, books, size), "codes")
    return with_label_error(coded).select(
        F.col("key").alias(key), "code", "error", "label_error", F.lit(books.digest).alias("codebooks_sha256")
    )

"""Product quantisation of vectors in whole numbers, with distances from per-dimension value dictionaries.

A component x becomes the integer floor(256 * x). A vector is cut into equal consecutive parts, and each
part is replaced by the index of the nearest entry of that part's codebook. Within a block of rows every
dimension has a dictionary of its distinct integers; the squared differences of these to all entries are
tabulated once, so that the distance of a part is a gather per dimension over dictionary codes, and adds.
Everything is exact: integers that would not fit 64 bits are Python integers.

Spark passes over the vectors without shuffling them: the ids of the seeds, two rounds that send sums and
counts per codebook entry (a table bounded by entries x dimensions, summed by Spark before it reaches the
driver), and the pass that assigns codes.

Defined cases: vectors that are null or hold null or non-finite components are not usable and go; a null id
is coded but never a seed; of several vectors with one id the smallest is the seed; the seeds' width is that
of the smallest id, and vectors of another width get a null code and error; a width that the number of parts
does not divide is cut into parts that differ by one component at most (an empty part has index 0); with
fewer ids than entries there are as many entries; without any seed all codes are null; an error
beyond 64 bits is null; an empty table gives an empty result; other columns stay, results replace theirs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256

BLOCK = 4096  # rows that share dictionaries
DENSE = 1 << 16  # widest range of integers whose dictionary is a table of flags
WHOLE = 2.0**52  # doubles from here on are whole numbers
LIMB = 48  # bits of the lower half in which sums travel

_CODED = pa.struct([("code", pa.binary()), ("error", pa.int64())])
CODED = "code binary, error bigint"


@dataclass
class Codebooks:
    """Entries of all parts side by side: row e holds entry e of every part's codebook."""

    entries: np.ndarray
    parts: int = PARTS

    @property
    def width(self) -> int:
        return self.entries.shape[1]

    @property
    def bounds(self) -> list[int]:
        return [part * self.width // self.parts for part in range(self.parts + 1)]

    def digest(self) -> str:
        """SHA-256 of all integers by part, entry and position."""
        numbers = [
            str(int(number))
            for first, last in zip(self.bounds, self.bounds[1:])
            for entry in self.entries
            for number in entry[first:last]
        ]
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()

    def decode(self, code: bytes) -> list[float]:
        """The vector that a code stands for, in the scale of the input."""
        spans = zip(code, self.bounds, self.bounds[1:])
        return [int(n) / SCALE for entry, first, last in spans for n in self.entries[entry, first:last]]


def usable(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is there and has only finite components."""
    finite = F.forall(
        F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    return df.where(F.col(vector).isNotNull() & finite)


def integers(values: np.ndarray) -> np.ndarray:
    """floor(256 * x), as 64-bit integers or, if one would not fit, as Python integers."""
    values = values.astype(np.float64)
    if values.size == 0 or np.abs(values).max() < WHOLE / SCALE:
        return np.floor(values * SCALE).astype(np.int64)
    exact = [int(x) * SCALE if abs(x) >= WHOLE else math.floor(x * SCALE) for x in values.ravel().tolist()]
    return np.array(exact, dtype=object).reshape(values.shape)


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have the width, and their integers."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), width), False)
    values = column.filter(fits).flatten().to_numpy(zero_copy_only=False)
    fits = fits.to_numpy(zero_copy_only=False)
    return fits, integers(values.reshape(int(fits.sum()), width))


def dictionary(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct integers of a dimension and each row's code in them."""
    if column.dtype != object:
        low = int(column.min())
        if int(column.max()) - low < DENSE:
            shifted = column - low
            there = np.zeros(int(shifted.max()) + 1, bool)
            there[shifted] = True
            return np.flatnonzero(there) + low, (np.cumsum(there) - 1)[shifted]
    return np.unique(column, return_inverse=True)


def _exact_types(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Python integers where a sum of squared differences could pass 64 bits."""
    if rows.dtype != object and entries.dtype != object:
        largest = max(abs(int(x)) for x in (rows.min(), rows.max(), entries.min(), entries.max()))
        if rows.shape[1] * (2 * largest) ** 2 < 2**62:
            return rows, entries
    return rows.astype(object), entries.astype(object)


def nearest(rows: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (the lowest of equally near ones) and its distance, row by part."""
    indexes = np.zeros((len(rows), books.parts), np.uint8)
    errors = np.zeros((len(rows), books.parts), rows.dtype)
    if not rows.size:
        return indexes, errors
    rows, entries = _exact_types(rows, books.entries)
    errors = errors.astype(rows.dtype)
    for start in range(0, len(rows), BLOCK):
        block = rows[start : start + BLOCK]
        every = np.arange(len(block))
        for part, (first, last) in enumerate(zip(books.bounds, books.bounds[1:])):
            distances = np.zeros((len(block), len(entries)), rows.dtype)
            for at in range(first, last):
                values, codes = dictionary(block[:, at])
                squares = (values[:, None] - entries[None, :, at]) ** 2
                distances += squares[codes]
            best = distances.argmin(axis=1)
            indexes[start : start + BLOCK, part] = best
            errors[start : start + BLOCK, part] = distances[every, best]
    return indexes, errors


def _seed_ids(df: DataFrame, key: str, entries: int) -> list:
    """The smallest ids, from the smallest of each partition."""

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            ids = batch.column(0).drop_null()
            ids = pc.unique(ids if held is None else pa.concat_arrays([held, ids]))
            held = ids.take(pc.array_sort_indices(ids)[:entries])
        if held is not None:
            yield pa.RecordBatch.from_arrays([held], names=["id"])

    ids = df.select(F.col(key).alias("id"))
    found = ids.mapInArrow(smallest, ids.schema).distinct().orderBy("id").limit(entries)
    return [row.id for row in found.collect()]


def seed(df: DataFrame, key: str, vector: str, entries: int = ENTRIES, parts: int = PARTS) -> Codebooks | None:
    """Codebooks of the vectors with the smallest ids, in the order of the ids."""
    ids = _seed_ids(df, key, entries)
    if not ids:
        return None
    chosen = (
        df.where(F.col(key) <= F.lit(ids[-1]))
        .groupBy(F.col(key).alias("id"))
        .agg(F.min(vector).alias("vector"))
    )
    vectors = [row.vector for row in sorted(chosen.collect(), key=lambda row: row.id)]
    width = len(vectors[0])
    alike = [v for v in vectors if len(v) == width]
    return Codebooks(integers(np.array(alike, np.float64).reshape(len(alike), width)), parts)


def _halves(total: int) -> tuple[int, int]:
    return total >> LIMB, total & ((1 << LIMB) - 1)


def refine(df: DataFrame, books: Codebooks, vector: str) -> Codebooks:
    """One round: entries become the floored means of the parts nearest to them, unused ones stay."""
    count, width = books.entries.shape

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Slots: the sums of all entries' dimensions, then the counts of all parts' entries.
        sums = np.zeros((count, width), object)
        counts = np.zeros((books.parts, count), np.int64)
        for batch in batches:
            _, rows = matrix(batch.column(0), width)
            indexes, _ = nearest(rows, books)
            # A batch's sums fit 64 bits unless its integers are Python's already.
            own = np.zeros((count, width), rows.dtype)
            for part, (first, last) in enumerate(zip(books.bounds, books.bounds[1:])):
                np.add.at(own[:, first:last], indexes[:, part], rows[:, first:last])
                counts[part] += np.bincount(indexes[:, part], minlength=count)
            sums += own
        totals = [int(n) for n in sums.ravel()] + [int(n) for n in counts.ravel()]
        slots = [slot for slot, total in enumerate(totals) if total]
        halves = [_halves(totals[slot]) for slot in slots]
        kind = pa.decimal128(38, 0)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(slots, pa.int32()),
                pa.array([h[0] for h in halves], kind),
                pa.array([h[1] for h in halves], kind),
            ],
            names=["slot", "high", "low"],
        )

    gathered = (
        df.select(vector)
        .mapInArrow(gather, "slot int, high decimal(38,0), low decimal(38,0)")
        .groupBy("slot")
        .agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    )
    totals = {row.slot: (int(row.high) << LIMB) + int(row.low) for row in gathered.collect()}
    entries = books.entries.astype(object)
    for part, (first, last) in enumerate(zip(books.bounds, books.bounds[1:])):
        for entry in range(count):
            if n := totals.get(count * width + part * count + entry, 0):
                for at in range(first, last):
                    entries[entry, at] = totals.get(entry * width + at, 0) // n
    small = entries.size == 0 or max(abs(n) for n in entries.ravel()) < 2**62
    return Codebooks(entries.astype(np.int64) if small else entries, books.parts)


def fit(
    df: DataFrame, key: str, vector: str, entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS
) -> Codebooks | None:
    """Codebooks of usable vectors; None if no row has an id."""
    if not 0 < entries <= 256:
        raise ValueError("an index is one byte: take 1 to 256 entries")
    books = seed(df, key, vector, entries, parts)
    for _ in range(rounds if books else 0):
        books = refine(df, books, vector)
    return books


def encode(
    df: DataFrame, books: Codebooks | None, vector: str, code: str = "code", error: str = "error"
) -> DataFrame:
    """Add each usable vector's code, a byte per part, and its squared error."""
    names = [F.col(f"`{name}`") for name in df.columns if name not in (code, error)]
    if books is None:
        return df.select(
            *names, F.lit(None).cast("binary").alias(code), F.lit(None).cast("bigint").alias(error)
        )

    # Declared nondeterministic so that its two results come from one call.
    @arrow_udf(CODED)
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            fits, rows = matrix(batch, books.width)
            indexes, errors = nearest(rows, books)
            found = iter(zip(map(bytes, indexes), errors.sum(axis=1).tolist()))
            pairs = [next(found) if fit else (None, None) for fit in fits]
            yield pa.StructArray.from_arrays(
                [
                    pa.array([pair[0] for pair in pairs], pa.binary()),
                    pa.array([e if e is None or e < 2**63 else None for _, e in pairs], pa.int64()),
                ],
                fields=list(_CODED),
            )

    found = df.select(F.struct(*names).alias("row"), coded.asNondeterministic()(F.col(vector)).alias("made"))
    return found.select("row.*", F.col("made.code").alias(code), F.col("made.error").alias(error))

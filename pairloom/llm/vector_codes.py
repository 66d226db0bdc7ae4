"""Compression of vectors to codes: one codebook entry for each of their parts.

A component x becomes the integer floor(1024 * x); a vector is cut into equal consecutive parts,
and each part position has a codebook.  Rounds assign each part to the nearest entry (squared
Euclidean distance, ties to the lower index) and replace entries by the floored means of
their parts; entries without parts stay.

The nearest entry is found in a ball tree over the entries of the position.  A batch of parts goes
down the tree together: at a node each part takes its nearer child first, and the other child if
the ball's bound allows it.  Distances to centres and radii are integer square roots, rounded so
that a bound is never above the true distance, and a ball whose bound equals the best distance is
visited too, so that ties can go to a lower index.  In leaves, distances are computed and
compared as integers.

Numbers are 64-bit integers where a bound on all components shows that no square or sum
passes 63 bits, and Python's integers (numpy's object type, the same code) where not; sums over
rows are then cut into limbs of 32 bits, which Spark adds up.

Kept rows are written once, with their parts as bytes; each round reads the parts alone,
and each task sends one row for each entry it used (codebook size times positions at most).

Defined results: rows whose vector is null or empty, or holds null or non-finite components, or
has another length than the kept row of the smallest id, take no part; so do all rows if
that length has no equal parts.  Rows without id come last among the initial entries, rows
of one id by their vectors.  Repeated rows are coded each for itself.  Errors above
2**63 - 1 are given as that number.  Other columns take no part, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_IDS, stash

SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Entries of a leaf.
LEAF = 16
#: Parts that go down the tree together.
TOGETHER = 8_192
LARGEST = 2**63 - 1


# Integer roots


def root_down(x: np.ndarray) -> np.ndarray:
    """Integers at most the square root."""
    if x.dtype == object:
        return np.array([math.isqrt(v) for v in x.tolist()], object)
    root = np.sqrt(x.astype(np.float64)).astype(np.int64)
    return np.maximum(root - 1, 0)


def root_up(x: np.ndarray) -> np.ndarray:
    """Integers at least the square root."""
    if x.dtype == object:
        return np.array([math.isqrt(v) + 1 for v in x.tolist()], object)
    return np.sqrt(x.astype(np.float64)).astype(np.int64) + 2


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances along the last axis, as integers."""
    return ((a - b) ** 2).sum(axis=-1)


class _Distances:
    """Squared distances of chosen rows of x to all rows of y, as integers.

    Doubles hold all the sums exactly where they are below 2**53; then the products are taken at once.
    """

    def __init__(self, x: np.ndarray, reach: int):
        self.x = x
        largest = max(int(np.abs(x).max(initial=0)), reach) if x.dtype != object else 0
        self.exact = x.dtype != object and 4 * largest * largest * x.shape[1] < 2**53
        if self.exact:
            self.a = x.astype(np.float64)
            self.norms = (self.a**2).sum(axis=1)

    def __call__(self, rows, y: np.ndarray) -> np.ndarray:
        if not self.exact:
            own = self.x[rows]
            return np.stack([squared(own, other) for other in y], axis=1)
        b = y.astype(np.float64)
        found = self.a[rows] @ (-2 * b.T)
        found += self.norms[rows][:, None]
        found += (b**2).sum(axis=1)
        return found.astype(np.int64)


class BallTree:
    """Balls around integer centres; leaves hold a few entries.  Nodes are numbered as they are made."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.largest = int(np.abs(entries).max())
        self.centres, self.radii = [], []
        self.below: list[np.ndarray | tuple[int, int]] = []  # a leaf's entries, or two nodes
        self._node(np.arange(len(entries)))
        self.centres, self.radii = np.array(self.centres, entries.dtype), np.array(self.radii, entries.dtype)

    def _node(self, index: np.ndarray) -> int:
        own, number = self.entries[index], len(self.centres)
        centre = own.sum(axis=0) // len(own)
        far = squared(own, centre)
        self.centres.append(centre)
        self.radii.append(int(root_up(far).max()))
        self.below.append(np.sort(index))
        if len(index) > LEAF:
            # two far entries, and the halves nearer to either
            a = own[int(np.argmax(far))]
            b = own[int(np.argmax(squared(own, a)))]
            order = np.argsort(squared(own, a) - squared(own, b), kind="stable")
            half = len(index) // 2
            self.below[number] = (self._node(index[order[:half]]), self._node(index[order[half:]]))
        return number

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each row, ties to the lower index."""
        best = np.full(len(x), -1, np.int64)
        least = np.zeros(len(x), x.dtype)
        reach = np.zeros(len(x), x.dtype)  # an integer at least the root of `least`
        distances = _Distances(x, self.largest)
        away = distances(slice(None), self.centres)
        away = root_down(away.ravel()).reshape(away.shape)
        bound = away - self.radii

        def leaf(index: np.ndarray, rows: np.ndarray) -> None:
            far = distances(rows, self.entries[index])
            at = np.argmin(far, axis=1)  # the first of equals: the lower index
            distance, entry = far[np.arange(len(rows)), at], index[at]
            old, held = best[rows], least[rows]
            better = (old < 0) | (distance < held) | ((distance == held) & (entry < old))
            won = rows[better]
            best[won], least[won], reach[won] = entry[better], distance[better], root_up(distance[better])

        def visit(node: int, rows: np.ndarray) -> None:
            rows = rows[((best[rows] < 0) | (bound[rows, node] <= reach[rows])).astype(bool)]
            if not len(rows):
                return
            below = self.below[node]
            if isinstance(below, np.ndarray):
                leaf(below, rows)
                return
            left, right = below
            near_left = (away[rows, left] <= away[rows, right]).astype(bool)
            for first, second, own in ((left, right, rows[near_left]), (right, left, rows[~near_left])):
                visit(first, own)
                visit(second, own)

        visit(0, np.arange(len(x)))
        return best, least


# Kept rows


def _integers(column: pa.Array, rows: int) -> np.ndarray:
    """floor(1024 * x), exact: 64-bit where all fit, else Python's integers."""
    x = column.flatten().to_numpy().reshape(rows, -1).astype(np.float64)
    if not x.size or np.abs(x).max() < 2.0**50:
        return np.floor(x * SCALE).astype(np.int64)
    # doubles of 2**50 and above are whole numbers
    return np.array([[int(v) * SCALE if abs(v) >= 2.0**50 else math.floor(v * SCALE) for v in row] for row in x.tolist()], object)


def pack_rows(x: np.ndarray, width: int) -> list[bytes]:
    """Rows of integers as little-endian bytes, `width` for each."""
    if width == 8:
        return [r.tobytes() for r in x.astype("<i8")]
    return [b"".join(v.to_bytes(width, "little", signed=True) for v in row) for row in x.tolist()]


def unpack_rows(rows: list[bytes], width: int) -> np.ndarray:
    if width == 4 or width == 8:
        return np.frombuffer(b"".join(rows), f"<i{width}").astype(np.int64).reshape(len(rows), -1)
    return np.array([[int.from_bytes(r[k : k + width], "little", signed=True) for k in range(0, len(r), width)] for r in rows], object)


def _packed(width: int, label_type: pa.DataType):
    schema = pa.schema([("vec_id", pa.int64()), ("label", label_type), ("packed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _integers(batch.column(2), batch.num_rows)
            rows = [r.tobytes() for r in x.astype("<i4")] if width == 4 else pack_rows(x, width)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], schema=schema)

    return run


def _batches_of(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.Table]:
    """Tables of about `TOGETHER` rows."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch.select(columns))
        rows += batch.num_rows
        if rows >= TOGETHER:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


# Rounds


def split_limbs(value: int, limbs: int) -> list[int]:
    """Digits of 32 bits, the last one with the sign."""
    out = [(value >> (32 * k)) & 0xFFFFFFFF for k in range(limbs - 1)]
    return [*out, value >> (32 * (limbs - 1))]


def join_limbs(parts: list[int]) -> int:
    return sum(int(v) << (32 * k) for k, v in enumerate(parts))


def _sums(held, width: int, wide: bool, parts: int, limbs: int):
    """(part, entry, n, limbs of the sum of each component) of a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = held.value
        trees = [BallTree(b) for b in books]
        size = books[0].shape[1]
        kind = object if wide else np.int64
        counts = np.zeros((parts, len(books[0])), np.int64)
        totals = np.zeros((parts, len(books[0]), size), kind)
        for table in _batches_of(batches, ["packed"]):
            x = unpack_rows(table.column("packed").to_pylist(), width).astype(kind)
            for p, tree in enumerate(trees):
                own = x[:, p * size : (p + 1) * size]
                near, _ = tree.nearest(own)
                counts[p] += np.bincount(near, minlength=counts.shape[1])
                np.add.at(totals[p], near, own)
        used = np.argwhere(counts > 0)
        if not len(used):
            return
        columns = [pa.array(used[:, k].astype(np.int32)) for k in (0, 1)] + [pa.array(counts[tuple(used.T)])]
        sums = [totals[p, e].tolist() for p, e in used]
        for i in range(size):
            cut = [split_limbs(int(s[i]), limbs) for s in sums]
            columns += [pa.array([c[k] for c in cut], pa.int64()) for k in range(limbs)]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", *(f"s{i}_{k}" for i in range(size) for k in range(limbs))])

    return run


def _next_books(packed: DataFrame, books: list[np.ndarray], width: int, wide: bool, limbs: int) -> list[np.ndarray]:
    size = books[0].shape[1]
    names = [f"s{i}_{k}" for i in range(size) for k in range(limbs)]
    held = packed.sparkSession.sparkContext.broadcast(books)
    found = packed.select("packed").mapInArrow(_sums(held, width, wide, len(books), limbs), "part int, entry int, n long, " + ", ".join(f"{n} long" for n in names))
    # limbs are below 2**32 and their sums over fewer than 2**31 tasks below 2**63; collected: one row for each entry
    rows = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(n).alias(n) for n in names)).collect()
    out = [b.copy() for b in books]
    for r in rows:
        out[r["part"]][r["entry"]] = [join_limbs([r[f"s{i}_{k}"] for k in range(limbs)]) // r["n"] for i in range(size)]
    held.unpersist()
    return out


def _coded(held, width: int, wide: bool, label_type: pa.DataType):
    schema = pa.schema([("vec_id", pa.int64()), ("label", label_type), ("code", pa.string()), ("error", pa.decimal128(38, 0))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [BallTree(b) for b in held.value]
        size = held.value[0].shape[1]
        for table in _batches_of(batches, ["vec_id", "label", "packed"]):
            x = unpack_rows(table.column("packed").to_pylist(), width).astype(object if wide else np.int64)
            found = [tree.nearest(x[:, p * size : (p + 1) * size]) for p, tree in enumerate(trees)]
            codes = ["".join(f"{e:02x}" for e in row) for row in np.stack([f[0] for f in found], axis=1).tolist()]
            errors = [min(int(e), LARGEST) for e in sum(f[1].astype(object) for f in found)]
            for part in pa.Table.from_arrays([table.column(0), table.column(1), pa.array(codes), pa.array(errors, pa.decimal128(38, 0))], schema=schema).to_batches():
                yield part

    return run


def books_text(books: list[np.ndarray]) -> str:
    return ",".join(str(v) for b in books for entry in b.tolist() for v in entry)


def encode_vectors(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """((vec_id, label, code, error), final codebooks): two hex digits for each part, the summed squared distances."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index must fit two hex digits")
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.coalesce((F.size("v") > 0) & fine, F.lit(False)))
    order = [F.col("vec_id").asc_nulls_last(), "v"]
    first = rows.select("vec_id", "v").orderBy(*order).limit(1).collect()
    label_field = rows.schema["label"]
    empty = spark.createDataFrame([], f"vec_id long, label {label_field.dataType.simpleString()}, code string, error decimal(38,0)")
    size = len(first[0]["v"]) if first else 0
    if not size or size % parts:
        return empty, []
    rows = rows.where(F.size("v") == size)
    count, largest = rows.agg(F.count("*"), F.max(F.array_max(F.transform("v", F.abs)))).first()
    bits = math.ceil(largest * SCALE if largest < 2.0**50 else int(largest) * SCALE).bit_length() + 1  # of a component and its sign
    wide = 2 * bits + 2 + (size // parts).bit_length() > 62
    limbs = 1 if bits + count.bit_length() < 63 else -(-(bits + count.bit_length() + 1) // 32)
    width = 4 if bits <= 31 else 8 if bits <= 63 else -(-(bits + 1) // 8)
    label_type = pa.array([], _arrow_type(label_field.dataType)).type
    packed = stash(rows.select("vec_id", "label", "v").mapInArrow(_packed(width, label_type), f"vec_id long, label {label_field.dataType.simpleString()}, packed binary"), "vectors")
    seeds = rows.select("vec_id", "v").orderBy(*order).limit(entries).collect()
    whole = _integers(pa.array([r["v"] for r in seeds], pa.list_(pa.float64())), len(seeds)).astype(object if wide else np.int64)
    step = size // parts
    books = [whole[:, p * step : (p + 1) * step].copy() for p in range(parts)]
    for _ in range(rounds):
        books = _next_books(packed, books, width, wide, limbs)
    held = spark.sparkContext.broadcast(books)
    coded = packed.mapInArrow(_coded(held, width, wide, label_type), empty.schema)
    return coded, books


def _arrow_type(data_type) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(data_type)


def with_label_errors(coded: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): errors summed over equal labels, and the hash of all entries' numbers."""
    coded = stash(coded, "codes")
    sums = stash(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").select(F.col("label").alias("_of"), "label_error")
    side = F.broadcast(sums) if sums.count() <= BROADCAST_IDS else sums
    within = lambda c: F.least(F.col(c), F.lit(LARGEST).cast("decimal(38,0)")).cast("long").alias(c)
    digest = hashlib.sha256(books_text(books).encode()).hexdigest()
    return coded.join(side, coded["label"].eqNullSafe(side["_of"])).select("vec_id", "code", within("error"), within("label_error"), F.lit(digest).alias("codebooks_sha256"))

"""Whitening of embeddings on exact whole-number statistics, by bit-sliced scatter.

An entry c becomes the whole number x = floor(1024 * c) + 100000. The vectors' covariance is exact:

1. Ranges: the least and greatest x of each dimension give its shift and its number of bit planes.
2. Bit-sliced scatter: a task takes ROWS vectors at a time, shifts each dimension by its least x and
   packs every bit plane across the rows into 64-bit words. The cross-product of two dimensions is
   the sum, over pairs of their planes, of 2 ** (p + q) times the number of bits that both planes
   have: AND and popcount. A last dimension that is always one gives the sums and the count. Counts
   are added up per p + q, so nothing overflows whatever the range.
3. A task hands on one row for each pair of dimensions, in three limbs; Spark adds these up. The
   driver gets one number per pair of dimensions, however many vectors there are.
4. The covariance is centred in whole numbers, n * sum(x y) - sum(x) * sum(y), before it is divided
   by n * n, and its eigenvectors are the components.
5. Each vector is centred and projected; the covariance of what comes out, as Spark's `covar_pop`
   gives it, tells how far it is from the identity.

A vector that is null, empty, or holds a null, an infinite or not-a-number entry is left out, as is
one with an entry of 2 ** 40 or more in size. If vectors differ in length, those of the most frequent
length count (the longer one of equally frequent ones), the others are left out. Components without
variance (constant dimensions, fewer vectors than dimensions) have a null `whitened`, and
`identity_error` is over the others, null if there are none. Eigenvalues count as none below what
double precision can tell from zero. A deviation beyond 64 bits is null; `deviation_digits` has all
digits. Repeated rows and null ids each give rows of their own. Other columns are ignored. An empty
table gives no rows. Memory of a task and the driver grows with the square of the dimensions alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylog.llm.shared import cut

SCALE, OFFSET = 1024, 100_000
#: Entries from this size on are not taken.
LARGEST = 2.0**40
COMPONENTS = 8
#: Vectors packed at once; a multiple of 64.
ROWS = 4096
#: Words ANDed at once.
SLAB_WORDS = 1 << 18
LIMB = 45


def whole_numbers(entries: np.ndarray) -> np.ndarray:
    return np.floor(entries * SCALE).astype(np.int64) + OFFSET


def fit_list(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, int]:
    """vec_id and entries (doubles) of the vectors that count, and their number of dimensions."""
    rows = vectors.select(F.col(id_column).alias("vec_id"), F.col(column).cast("array<double>").alias("entries"))
    # a null entry makes the condition null; not-a-number is greater than any number in Spark
    good = rows.where((F.size("entries") > 0) & F.forall("entries", lambda c: F.abs(c) < LARGEST))
    sizes = good.groupBy(F.size("entries").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    dims = sizes.size if sizes else 0
    return good.where(F.size("entries") == dims), dims


def _matrices(batches: Iterator[pa.RecordBatch], place: int, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of up to ROWS rows with their x as a matrix."""
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS):
            part = batch.slice(low, ROWS)
            yield part, whole_numbers(part.column(place).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))


def _ranges(fit: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest x of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(dims, np.iinfo(np.int64).max), np.full(dims, np.iinfo(np.int64).min)
        some = False
        for _, x in _matrices(batches, 0, dims):
            if len(x):
                some, low, high = True, np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(low), pa.array(high)], ["i", "low", "high"])

    parts = fit.select("entries").mapInArrow(run, "i long, low long, high long")
    found = parts.groupBy("i").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("i").collect()
    return np.array([r.low for r in found]), np.array([r.high for r in found])


def bit_planes(shifted: np.ndarray, count: int) -> np.ndarray:
    """(plane, dimension, word): bit p of every row's value, 64 rows to a word. Rows that fill up
    the last word are zero."""
    rows, dims = shifted.shape
    words = -(-rows // 64)
    out = np.zeros((count, dims, words * 8), np.uint8)
    for p in range(count):
        bits = ((shifted >> np.uint64(p)) & np.uint64(1)).astype(np.uint8)
        out[p, :, : -(-rows // 8)] = np.packbits(bits, axis=0).T
    return out.view(np.uint64)


def cross_counts(planes: np.ndarray, into: np.ndarray) -> None:
    """Add to into[p + q] the bits that plane p of one dimension and plane q of another have both."""
    count, dims, words = planes.shape
    slab = max(1, SLAB_WORDS // (dims * words))
    some = [p for p in range(count) if planes[p].any()]
    for p in some:
        for q in (q for q in some if q >= p):
            both = np.empty((dims, dims), np.int64)
            for low in range(0, dims, slab):
                met = planes[p, low : low + slab, None, :] & planes[q, None, :, :]
                both[low : low + slab] = np.bitwise_count(met).sum(axis=2, dtype=np.int64)
            into[p + q] += both if p == q else both + both.T


def _scatter(fit: DataFrame, dims: int, low: np.ndarray, high: np.ndarray) -> list[list[int]]:
    """Exact cross-products of the shifted x and, as last dimension, of one."""
    count = max(1, *(int(b - a).bit_length() for a, b in zip(low, high)))
    wide = dims + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2 * count - 1, wide, wide), np.int64)
        for _, x in _matrices(batches, 0, dims):
            shifted = np.concatenate([x - low, np.ones((len(x), 1), np.int64)], axis=1).view(np.uint64)
            cross_counts(bit_planes(shifted, count), counts)
        if not counts.any():
            return
        i, j = np.triu_indices(wide)
        total = [sum(int(c) << s for s, c in enumerate(column) if c) for column in counts[:, i, j].T]
        limbs = [pa.array([t >> (LIMB * k) & ((1 << LIMB) - 1) for t in total], pa.int64()) for k in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), *limbs], ["i", "j", "l0", "l1", "l2"])

    parts = fit.select("entries").mapInArrow(run, "i long, j long, l0 long, l1 long, l2 long")
    sums = parts.groupBy("i", "j").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(3)]).collect()
    out = [[0] * wide for _ in range(wide)]
    for r in sums:
        out[r.i][r.j] = out[r.j][r.i] = r.l0 + (r.l1 << LIMB) + (r.l2 << 2 * LIMB)
    return out


@dataclass(frozen=True)
class Whitening:
    """What the fit list gives: number of vectors and dimensions, least and greatest x and its sum for
    each dimension, eigenvalues by size, their share of the trace, and the components as columns."""

    n: int
    dims: int
    low: np.ndarray
    high: np.ndarray
    sums: list[int]
    values: np.ndarray
    explained: np.ndarray
    vectors: np.ndarray

    @property
    def with_variance(self) -> np.ndarray:
        """Components whose eigenvalue can be told from zero."""
        return self.values > 16 * self.dims * np.finfo(float).eps * self.values.max(initial=0.0)


def fit(vectors: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a `fit_list`, or None if it is empty."""
    if not dims:
        return None
    low, high = _ranges(vectors, dims)
    products = _scatter(vectors, dims, low, high)
    n, shifted = products[dims][dims], products[dims][:dims]
    square = n * n
    centred = [[n * products[i][j] - shifted[i] * shifted[j] for j in range(dims)] for i in range(dims)]
    values, found = np.linalg.eigh(np.array([[c / square for c in row] for row in centred]))
    order = np.argsort(-values, kind="stable")[:components]
    values, found = np.maximum(values[order], 0.0), found[:, order]
    # either sign would do; the greatest entry is made positive
    found = found * np.where(found[np.abs(found).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    trace = sum(centred[i][i] for i in range(dims)) / square
    sums = [s + n * int(least) for s, least in zip(shifted, low)]
    explained = values / trace if trace else np.zeros(len(order))
    return Whitening(n, dims, low, high, sums, values, explained, found)


def project(vectors: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, deviation, deviation_digits and projected (a double for each component, null where it
    has no variance) of the vectors of a fit list."""
    n, dims, low = model.n, model.dims, model.low
    shifted = [s - n * int(a) for s, a in zip(model.sums, low)]
    mean = np.array([s / n for s in shifted])
    spread = model.with_variance
    weights = model.vectors[:, spread] / np.sqrt(model.values[spread])
    widest = max(max(abs(s), abs(n * int(b - a) - s)) for s, a, b in zip(shifted, low, model.high))
    # whole numbers of any size where 64 bits could not hold the sum
    kind = np.int64 if dims * widest**2 < 2**63 else object
    sums = np.array(shifted, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _matrices(batches, 1, dims):
            x = x - low
            far = ((n * x.astype(kind) - sums) ** 2).sum(axis=1).tolist()
            out = np.full((len(x), len(spread)), np.nan)
            out[:, spread] = (x - mean) @ weights
            flat = pa.array(out.ravel(), mask=np.tile(~spread, len(x)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(spread)), flat)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([f if f < 2**63 else None for f in far], pa.int64()),
                    pa.array(map(str, far), pa.string()),
                    lists,
                ],
                ["vec_id", "deviation", "deviation_digits", "projected"],
            )

    id_type = dict(vectors.dtypes)["vec_id"]
    return vectors.mapInArrow(run, f"vec_id {id_type}, deviation long, deviation_digits string, projected array<double>")


def identity_error(projected: DataFrame, components: list[int]) -> float | None:
    """Largest absolute entry of the projections' covariance minus the identity."""
    pairs = [(i, j) for i in components for j in components if i <= j]
    if not pairs:
        return None
    entry = lambda i: F.col("projected")[i]
    row = projected.agg(*[F.covar_pop(entry(i), entry(j)).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(row[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


SCHEMA = (
    "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double, "
    "deviation_digits string"
)


def whiten(
    vectors: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", column: str = "embedding"
) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error and
    deviation_digits for each vector that counts and each component."""
    good, dims = fit_list(vectors, id_column, column)
    model = fit(good, dims, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], SCHEMA.format(dict(good.dtypes)["vec_id"]))
    held = cut(project(good, model))  # read twice below
    error = identity_error(held, np.flatnonzero(model.with_variance).tolist())
    share: Column = F.array(*[F.lit(float(e)) for e in model.explained])
    rows = held.select("vec_id", "deviation", "deviation_digits", F.posexplode("projected").alias("place", "whitened"))
    return rows.select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        share[F.col("place")].alias("explained"), F.lit(error).cast("double").alias("identity_error"), "deviation_digits",
    )


def deviations(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, n and deviation of each vector that counts."""
    good, dims = fit_list(vectors, id_column, column)
    model = fit(good, dims, 0)
    if model is None:
        return good.select("vec_id", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"))
    return project(good, model).select("vec_id", F.lit(model.n).cast("long").alias("n"), "deviation")

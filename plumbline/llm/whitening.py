"""Embedding whitening with exact sums: products of integer limbs by BLAS, recombined as big integers.

Vectors become integers x = floor(64 * c) + 1000000. One pass sums them by dimension (S, and n); the second centres each
vector as y = n * x - S, splits y into limbs of BITS signed bits, and multiplies the limbs of a block of rows at once:
a product of two limbs over BLOCK rows stays below 2 ** 53, so that float64 BLAS makes no error in any order of its
additions. Limb products recombine as big integers within a task; tasks send them as digits of DIGIT bits, which are
added up by row of the matrix as they arrive. The covariance of x is that sum over n ** 3, each entry rounded once. It is
decomposed on the driver, whose share is bounded by the dimension: the matrix has dim x dim entries, however many
vectors there are. One step of refinement in extended precision follows the decomposition.

A third pass measures whitened's own covariance, the last one writes the rows. Nothing is shuffled but sums: a row or
two per dimension and task.

Defined results: vectors null, empty, or holding null or non-finite entries take no part, nor do vectors of another
length than the most frequent one (ties: the shorter); rows that repeat, or share an id (null ones too), are each fitted and
each returned; floor(64 * c) is held within +-2 ** 61; a deviation beyond 64 bits is null; directions without variance
(an eigenvalue below 1e-14 of the largest) are no components, so one vector alone, or equal ones, give no rows, as
does an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import col, stored

SCALE, SHIFT = 64, 1_000_000
LIMIT = 1 << 61
#: |limb| <= 2 ** 19, so a block's products add up to 2 ** 51 at most.
BITS, BLOCK = 20, 8192
#: Bits of a digit of a sum on its way to other tasks: 2 ** 22 tasks can be added up in 64 bits.
DIGIT = 40
#: Entries of vectors that a task works on at a time.
ENTRIES = 4 << 20
COMPONENTS = 32


def integers(c: np.ndarray) -> np.ndarray:
    """x of entries c; exact, as 64 * c and its floor are."""
    return np.clip(np.floor(c * SCALE), -LIMIT, LIMIT).astype(np.int64) + SHIFT


def whole_vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a list column and their entries, by length and at most ENTRIES at a time, leaving out nulls, empty ones and
    those with entries that are null or not finite."""
    lists = column.cast(pa.large_list(pa.float64()))
    n = len(lists)
    at = np.asarray(lists.offsets)  # absolute, whatever the slice
    flat = lists.values.to_numpy(zero_copy_only=False)  # null entries come as NaN
    size = np.where(np.asarray(lists.is_valid()), np.diff(at), 0)
    for length in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == length)
        step = max(1, ENTRIES // int(length))
        for start in range(0, len(rows), step):
            some = rows[start : start + step]
            entries = flat[at[some][:, None] + np.arange(length)]
            whole = np.isfinite(entries).all(1)
            if whole.any():
                yield some[whole], entries[whole]


def digit_rows(key: int, values: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(key, place, digits) of a row of big integers: signed digits of DIGIT bits, the lowest place first."""
    sign, left, place = np.where(values < 0, -1, 1).astype(np.int64), np.abs(values), 0
    while place == 0 or left.any():
        yield key, place, (left & ((1 << DIGIT) - 1)).astype(np.int64) * sign
        left, place = left >> DIGIT, place + 1


def digit_batch(rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    key, place, values = zip(*rows, strict=True)
    at = np.concatenate([[0], np.cumsum([len(v) for v in values])])
    lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(values)))
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int32()), pa.array(place, pa.int32()), lists], names=["key", "place", "digits"])


DIGITS = "key int, place int, digits array<long>"


def merged(parts: DataFrame) -> DataFrame:
    """One row for each key and place of all tasks' digit rows: added up while they stream through a key's task, which
    holds its sums alone. Stored, as it is read by parts."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for i, at in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                values = batch.column(2)[i].values.to_numpy()
                total[at] = total[at] + values if at in total else values
        if total:
            yield digit_batch([(*at, v) for at, v in total.items()])

    return stored(parts.repartition("key").mapInArrow(add, DIGITS), "sums")


def integers_of(rows: DataFrame) -> dict[int, np.ndarray]:
    """Each key's row of big integers."""
    out: dict[int, np.ndarray] = {}
    for r in rows.collect():
        value = np.array(r["digits"], object) * (1 << (DIGIT * r["place"]))
        out[r["key"]] = out[r["key"]] + value if r["key"] in out else value
    return out


def exact_sums(x: np.ndarray) -> list[int]:
    """Sums by column of 64-bit integers, of at most 2 ** 31 rows."""
    return [int(h) * (1 << 32) + int(low) for h, low in zip((x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0), strict=True)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """y = n * x - S: 64-bit integers where they fit, big ones elsewhere."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0) < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Signed limbs l of BITS bits as doubles, the lowest first: y = sum of l[i] << (BITS * i)."""
    out = []
    while True:
        low = (y + (1 << (BITS - 1))) % (1 << BITS) - (1 << (BITS - 1))
        out.append(low.astype(float))
        y = (y - low) // (1 << BITS)
        if not y.any():
            return out


def gram(y: np.ndarray) -> np.ndarray:
    """y transposed times y as big integers, block by block: one product of all limbs side by side, exact in doubles."""
    d = y.shape[1]
    total = np.zeros((d, d), object)
    for start in range(0, len(y), BLOCK):
        parts = limbs(y[start : start + BLOCK])
        side = np.hstack(parts)
        product = side.T @ side
        for i in range(len(parts)):
            for j in range(len(parts)):
                total = total + product[i * d : (i + 1) * d, j * d : (j + 1) * d].astype(np.int64).astype(object) * (1 << (BITS * (i + j)))
    return total


def column_sums(vectors: DataFrame) -> tuple[int, int, list[int]]:
    """(dim, n, S): the most frequent length, how many vectors have it, and their sums by dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, entries in whole_vectors(batch.column(0)):
                row = np.array([len(entries), *exact_sums(integers(entries))], object)
                total[len(row) - 1] = total.get(len(row) - 1, 0) + row
        for size, row in total.items():
            yield digit_batch(list(digit_rows(size, row)))

    found = merged(vectors.mapInArrow(add, DIGITS))
    # Counts first: sums come to the driver for one length only.
    sizes = integers_of(found.select("key", "place", F.slice("digits", 1, 1).alias("digits")))
    if not sizes:
        return 0, 0, []
    dim = min(sizes, key=lambda k: (-sizes[k][0], k))
    n, *sums = integers_of(found.where(F.col("key") == dim))[dim]
    return dim, int(n), [int(s) for s in sums]


def scatter(vectors: DataFrame, dim: int, n: int, sums: list[int]) -> np.ndarray:
    """Sum of y transposed times y over all vectors, as big integers; tasks send the upper half."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting, held = np.zeros((dim, dim), object), [], 0
        for batch in batches:
            for _, entries in whole_vectors(batch.column(0)):
                if entries.shape[1] == dim:
                    waiting.append(integers(entries))
                    held += len(entries)
                if held >= BLOCK:
                    total, waiting, held = total + gram(centred(np.vstack(waiting), n, sums)), [], 0
        if held:
            total = total + gram(centred(np.vstack(waiting), n, sums))
        if total.any():
            for i in range(dim):
                yield digit_batch(list(digit_rows(i, total[i, i:])))

    out = np.zeros((dim, dim), object)
    for i, row in integers_of(merged(vectors.mapInArrow(multiply, DIGITS))).items():
        out[i, i:] = out[i:, i] = row
    return out


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, of a symmetric matrix; one step of refinement, in extended
    precision, takes up what the decomposition's own rounding left."""
    e, q = np.linalg.eigh(v)
    a, x = v.astype(np.longdouble), q.astype(np.longdouble)
    r = np.eye(len(v)) - x.T @ x
    s = x.T @ a @ x
    e = np.diag(s) / (1 - np.diag(r))
    gap = e[None, :] - e[:, None]
    apart = np.abs(gap) > 4 * np.abs(s - np.diag(np.diag(s))).max(initial=0) + 1e-15 * np.abs(e).max(initial=0)
    step = np.where(apart, (s + e[None, :] * r) / np.where(apart, gap, 1), r / 2)
    x = x + x @ step
    order = np.argsort(-e, kind="stable")
    x = x[:, order]
    return e[order].astype(float), (x / np.sqrt((x * x).sum(0))).astype(float)


class Model:
    """What each row is whitened with: n, S, and per component its direction over sqrt(e) and the share it explains."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray, components: int) -> None:
        e, q = eigen(covariance)
        keep = np.flatnonzero(e > 1e-14 * e[0])[:components] if len(e) and e[0] > 0 else np.zeros(0, int)
        self.n, self.sums = n, sums
        self.explained = e[keep] / np.trace(covariance)
        self.project = q[:, keep] / np.sqrt(e[keep])

    def whiten(self, y: np.ndarray) -> np.ndarray:
        return (y.astype(float) / self.n) @ self.project

    def deviations(self, y: np.ndarray) -> list[int | None]:
        """Exact sums of squares; None beyond 64 bits."""
        if y.dtype == object or float((y.astype(float) ** 2).sum(1).max(initial=0)) > 2.0**62:
            exact = (y.astype(object) ** 2).sum(1)
            return [int(v) if v < 1 << 63 else None for v in exact]
        return (y * y).sum(1).tolist()


def fit(vectors: DataFrame, components: int) -> tuple[int, Model] | None:
    dim, n, sums = column_sums(vectors)
    if not n:
        return None
    total = scatter(vectors, dim, n, sums)
    covariance = np.array([[int(v) / n**3 for v in row] for row in total])  # of integers, so rounded once
    return dim, Model(n, sums, covariance, components)


def per_vector(df: DataFrame, dim: int, work: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """work(batch, rows, x) for the vectors of dim entries in each batch; the vector is the last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, entries in whole_vectors(batch.column(batch.num_columns - 1)):
                if entries.shape[1] == dim:
                    yield work(batch, rows, integers(entries))

    return df.mapInArrow(run, schema)


def identity_error(vectors: DataFrame, dim: int, model: Model) -> float:
    """Largest entry of whitened's covariance less the identity, measured on what the rows give: sums of squares of
    each batch are added up by Spark."""
    k = model.project.shape[1]

    def sums(batch: pa.RecordBatch, rows: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        w = np.hstack([model.whiten(centred(x, model.n, model.sums)), np.ones((len(x), 1))])
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k + 1), k + 1), pa.int32()), pa.array(np.tile(np.arange(k + 1), k + 1), pa.int32()), pa.array((w.T @ w).ravel())], names=["i", "j", "s"])

    rows = per_vector(vectors, dim, sums, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    m = np.zeros((k + 1, k + 1))
    for r in rows:
        m[r["i"], r["j"]] = r["s"] / model.n
    return float(np.abs(m[:k, :k] - np.outer(m[:k, k], m[:k, k]) - np.eye(k)).max(initial=0))


def whiten(vectors: DataFrame, *, components: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: see the module."""
    schema = f"vec_id {vectors.schema[vec_id].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    kind = vectors.schema[embedding].dataType.elementType.typeName()
    source = col(embedding) if kind in ("float", "double") else col(embedding).cast("array<double>")
    held = vectors.select(source.alias("e"))
    found = fit(held, components)
    if found is None or not found[1].project.shape[1]:
        return vectors.sparkSession.createDataFrame([], schema)
    dim, model = found
    k, error = model.project.shape[1], identity_error(held, dim, model)

    def rows_out(batch: pa.RecordBatch, rows: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        y = centred(x, model.n, model.sums)
        size = len(rows) * k
        ids = batch.column(0).take(pa.array(np.repeat(rows, k)))
        deviation = pa.array(model.deviations(y), pa.int64()).take(pa.array(np.repeat(np.arange(len(rows)), k)))
        columns = [ids, pa.array(np.tile(np.arange(1, k + 1), len(rows)), pa.int32()), pa.array(np.full(size, model.n)), deviation, pa.array(model.whiten(y).ravel()), pa.array(np.tile(model.explained, len(rows))), pa.array(np.full(size, error))]
        return pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return per_vector(vectors.select(col(vec_id).alias("vec_id"), source.alias("e")), dim, rows_out, schema)

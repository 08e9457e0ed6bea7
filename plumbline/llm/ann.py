"""Approximate nearest neighbours by an adaptive dimension scan of probed inverted lists.

Vectors are lifted by one coordinate that turns the largest inner product into the least distance, rotated by a
seeded orthogonal matrix, and dealt to the inverted lists of centroids fitted on a bounded sample. A list is stored
in blocks, each block's rotated vectors in column blocks of STEP dimensions. A query scans its probed lists: partial
distances grow column block by column block, and after each a hypothesis test abandons candidates whose scaled
partial distance is beyond the k-th best distance so far. Survivors are scored by the exact inner product of the
original vectors in double precision.

Every vector is indexed, and every list is scanned in full for the queries that probe it: a crowded list is more
blocks, not a longer task. A query probes lists from the nearest on: `probes`, by default as many as hold `recall`
of the true neighbours within the sample, and more until they hold enough vectors.

Defined results: vectors null, zero, or holding null or non-finite components take no part, nor do vectors of
another length than the most frequent one (ties: the shorter); a query never finds its own row (rows are told apart
by id; rows that share an id are each other's own); equal scores go to the smaller id; fewer candidates than k give
all of them; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import col, stored

SAMPLE = 20_000
MAX_LISTS = 4096
BLOCK = 2048
QUERIES = 64
STEP = 16
EPSILON = 2.1


def rotation(n: int, seed: int = 3) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))
    return q * np.sign(np.diag(r))


def lift(x: np.ndarray, limit: float) -> np.ndarray:
    """One more coordinate, so that all rows have length `limit`."""
    return np.hstack([x, np.sqrt(np.maximum(limit**2 - (x**2).sum(1), 0))[:, None]])


def centroids(x: np.ndarray, lists: int, seed: int = 5, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = x[np.lexsort(x.T[::-1])]  # the order doesn't depend on partitions
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([((c**2).sum(1) - 2 * part @ c.T).argmin(1) for part in np.array_split(x, max(1, len(x) // 4096))])
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def calibrated(points: np.ndarray, limit: float, turn: np.ndarray, c: np.ndarray, k: int, recall: float, trials: int = 200) -> int:
    """Lists to probe so that, within the sample, `recall` of the true k nearest lie in them."""
    if len(points) < 2:
        return len(c)
    at = ((c**2).sum(1) - 2 * (lift(points, limit) @ turn) @ c.T).argmin(1)
    places = []
    for i in np.linspace(0, len(points) - 1, min(trials, len(points))).astype(int):
        score = points @ points[i]
        score[i] = -np.inf
        best = np.argpartition(-score, min(k, len(score) - 1) - 1)[: min(k, len(score) - 1)]
        place = np.empty(len(c), int)
        place[((c**2).sum(1) - 2 * c @ (np.append(points[i], 0.0) @ turn)).argsort(kind="stable")] = np.arange(len(c))
        places.append(place[at[best]])
    return int(np.quantile(np.concatenate(places), recall)) + 1


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def scan(block: np.ndarray, ids: np.ndarray, original: np.ndarray, q: np.ndarray, q_original: np.ndarray, q_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact scores of the k nearest of a block, by scaled partial distances over column blocks.

    block: rotated vectors by dimension (dimensions first), in single precision."""
    alive = np.flatnonzero(ids != q_id)
    if not len(alive):
        return ids[:0], np.zeros(0)
    d = len(block)
    first = alive[: max(4 * k, 64)]
    whole = ((block[:, first] - q[:, None]) ** 2).sum(0)
    limit = float(np.sort(whole)[k - 1]) * (1 + 1e-4) if len(first) >= k else np.inf  # single precision
    partial = np.zeros(len(alive))
    for at in range(0, d, STEP):
        to = min(at + STEP, d)
        partial += ((block[at:to][:, alive] - q[at:to, None]) ** 2).sum(0)
        if to < d:
            stay = partial * (d / to) <= limit * (1 + EPSILON / np.sqrt(to)) ** 2
            alive, partial = alive[stay], partial[stay]
        elif len(alive) >= k:
            limit = min(limit, np.partition(partial, k - 1)[k - 1] * (1 + 1e-4))
    alive = alive[partial <= limit + 1e-12]
    score = (original[alive] * q_original).sum(1)  # row sums: equal vectors get equal scores
    best = np.lexsort((ids[alive], -score))[:k]
    return ids[alive][best], score[best]


def search(vectors: DataFrame, queries: Column, *, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", lists: int | None = None, probes: int | None = None, sample: int = SAMPLE, recall: float = 0.97) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors of largest inner product with each row that `queries` marks."""
    spark = vectors.sparkSession
    e = F.col("e")
    number = "float" if vectors.schema[embedding].dataType.elementType.typeName() == "float" else "double"  # travels as it is stored
    whole = vectors.where(col(vec_id).isNotNull()).select(col(vec_id).cast("long").alias("id"), F.coalesce(queries, F.lit(False)).alias("query"), F.transform(col(embedding), lambda v: v.cast(number)).alias("e"))
    whole = whole.where(F.coalesce(F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)) & F.exists(e, lambda v: v != 0))
    lengths = whole.groupBy(F.size(e).alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if lengths is None:
        return empty
    dim, n = lengths["n"], lengths["count"]
    whole = whole.where(F.size(e) == dim)
    limit = whole.select(F.sqrt(F.max(F.aggregate(e, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))))).first()[0]
    drawn = whole.where(F.pmod(F.xxhash64("e"), F.lit(1 << 30)) / float(1 << 30) < 0.95 * sample / n) if n > sample else whole
    points = np.array([r[0] for r in drawn.select("e").limit(sample).collect()] or [[0.0] * dim], float)
    turn = rotation(dim + 1)
    lists = lists or int(np.clip(np.sqrt(n) / 2, 1, MAX_LISTS))
    c = centroids(lift(points, limit) @ turn, lists)
    probes = probes or calibrated(points, limit, turn, c, k, recall)
    shared = spark.sparkContext.broadcast((turn, c, limit))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, c, limit = shared.value
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(2)).astype(float)
                rotated = lift(x, limit) @ turn
                near = ((c**2).sum(1) - 2 * rotated @ c.T).argmin(1)
                flat = pa.array(rotated.ravel().astype(np.float32))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(np.arange(0, flat.__len__() + 1, dim + 1), pa.int32()), flat), pa.array(near, pa.int32())], names=["id", "query", "e", "r", "list"])

    placed = stored(whole.mapInArrow(place, f"id long, query boolean, e array<{number}>, r array<float>, list int"), "vectors")
    counts = {r["list"]: r["count"] for r in placed.groupBy("list").count().collect()}  # one row per list, MAX_LISTS at most
    held = np.array([counts.get(i, 0) for i in range(len(c))])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, c, limit = shared.value
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1)).astype(float)
                rotated = np.hstack([x, np.zeros((len(x), 1))]) @ turn
                order = ((c**2).sum(1) - 2 * rotated @ c.T).argsort(1, kind="stable")
                enough = np.maximum(probes, (np.cumsum(held[order], 1) < 4 * k + 1).sum(1) + 1)
                take = [o[:m][held[o[:m]] > 0] for o, m in zip(order, enough, strict=True)]
                many = [len(t) for t in take]
                row = pa.array(np.repeat(np.arange(len(x)), many))
                flat = pa.array(rotated.ravel().astype(np.float32))
                r = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, dim + 1), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), r.take(row), pa.array(np.concatenate(take), pa.int32())], names=["id", "e", "r", "list"])

    sizes = F.array(*[F.lit(int(max(1, -(-m // BLOCK)))) for m in held])
    part = F.pmod(F.xxhash64("id", "r"), F.element_at(sizes, F.col("list") + 1)).cast("int")
    blocks = placed.withColumn("part", part).groupBy("list", "part").agg(F.collect_list(F.struct("id", "e", "r")).alias("rows"))
    asked = placed.where("query").select("id", "e").distinct().mapInArrow(probe, f"id long, e array<{number}>, r array<float>, list int")
    # Queries of a list in groups of some QUERIES, each group scanned against each block of the list.
    group = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // (20 * QUERIES * 4))))).cast("int")
    asked = asked.groupBy("list", group.alias("group")).agg(F.collect_list(F.struct("id", "e", "r")).alias("asked"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                queries, rows = batch.column(0)[i].values, batch.column(1)[i].values
                ids, original, block = np.asarray(rows.field("id")), matrix(rows.field("e")).astype(float), np.ascontiguousarray(matrix(rows.field("r")).T)
                out: list[tuple[np.ndarray, ...]] = []
                for q_id, q_original, q in zip(np.asarray(queries.field("id")).tolist(), matrix(queries.field("e")).astype(float), matrix(queries.field("r")), strict=True):
                    found, score = scan(block, ids, original, q, q_original, q_id, k)
                    out.append((np.full(len(found), q_id), found, score))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    pairs = asked.join(blocks, "list").select("asked", "rows")
    found = pairs.mapInArrow(compare, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

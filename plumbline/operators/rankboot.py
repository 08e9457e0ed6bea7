"""Bootstraps of rank statistics: intervals of AUROC and Spearman's correlation, and of differences of paired signals.

Replicates weigh items by the same keyed Poisson draws as `resample` (MD5 of seed, block and item), so signals that
share items are paired by construction. Scores are cut into cells once: each border value is a cell of its own,
between neighbouring borders lies another. A cell of one value may hold any share of the rows; it is split over tasks,
as its totals say all. Other cells hold about ROWS rows at most, however many rows there are.

AUROC: a cell's task gives three numbers per replicate (weight of positives, of negatives, wins within), whatever the
number of rows; an exclusive scan over cells adds the wins across. What is shuffled is each row once, and cells x
replicates numbers.

Spearman: the same scan gives each cell's first rank on both sides, at most TABLE numbers, which are broadcast. Each
row's rank on one side in every replicate of a block then travels with it to the other side's cell, packed in one
binary value, as the product of two ranks needs both: 8 bytes a row and replicate, never rows of them.

Rows with a null item, score or target take no part.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.expr import POISSON
from plumbline.sources.tables import stored

#: Rows that a cell between borders holds at most, but for the error of approximate quantiles.
ROWS = 1 << 17
#: Replicates that a task weighs at a time, and sends together.
BLOCK = 64
#: Numbers that the table of first ranks may have, both sides together: 64 MB.
TABLE = 1 << 23
SALTS = 64


def weights(items: list[str], first: int, n: int, seed: int) -> np.ndarray:
    """Poisson(1) weights (n replicates from `first` on, a multiple of 4, by items): the draws of expr.poisson."""
    fours = range(first // 4, -(-(first + n) // 4))
    raw = b"".join(hashlib.md5(f"{seed}:{f}:{i}".encode(), usedforsecurity=False).digest() for i in items for f in fours)
    numbers = np.frombuffer(raw, ">u4").reshape(len(items), -1)[:, :n]
    least = np.array([-int(-c * 2**32 // 1) for c in POISSON])
    return np.searchsorted(least, numbers, side="right").T.astype(float)


def blocks(replicates: int) -> list[tuple[int, int]]:
    return [(i, min(BLOCK, replicates - i)) for i in range(0, replicates, BLOCK)]


def borders(df: DataFrame, x: str, n: int, most: int) -> list[float]:
    """Distinct approximate quantiles, so many that ROWS rows lie between neighbours; at most `most`."""
    cells = int(min(max(8, -(-n // ROWS)), most))
    found = df.agg(F.percentile_approx(x, [i / cells for i in range(1, cells)], max(1000, 20 * cells)).alias("b")).first()["b"]
    return sorted(set(found or []))


def cell_of(x: Column, known: list[float]) -> Column:
    """Twice the number of borders below x, and one more where x is a border: found by halving."""
    table, size = F.array(*[F.lit(float(b)) for b in known]), 1 << max(0, len(known)).bit_length()
    at = F.lit(0)
    while size:
        step = at + size
        at = F.when((step <= len(known)) & (F.get(table, step - 1) < x), step).otherwise(at)
        size //= 2
    return 2 * at + F.coalesce((F.get(table, at) == x).cast("int"), F.lit(0))


def placed(df: DataFrame, x: str, name: str, known: list[float]) -> DataFrame:
    """df with <name>, the cell of x, and <name>_salt, which splits cells of one value over tasks."""
    if not known:
        return df.withColumns({name: F.lit(0), f"{name}_salt": F.lit(0)})
    df = df.withColumn(name, cell_of(F.col(x), known))
    return df.withColumn(f"{name}_salt", F.when(F.col(name) % 2 == 1, F.pmod(F.xxhash64("item"), F.lit(SALTS))).otherwise(0).cast("int"))


def local(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of x, where its distinct values start in that order, and which of them each place holds."""
    order = np.argsort(x, kind="stable")
    new = np.concatenate([[True], np.diff(x[order]) > 0])
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def auroc_replicates(df: DataFrame, x: str, y: str, item: str, *, replicates: int = 100, seed: int = 1) -> DataFrame:
    """(rep, value): the weighted area of each replicate, ties by half; null without a class."""
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("int").alias("y"), F.col(item).cast("string").alias("item")).dropna()
    known = borders(rows, "x", rows.count(), 1 << 14)

    def within(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["x", "item"], ignore_index=True)
        _, starts, _ = local(rows["x"].to_numpy())
        up, items, out = rows["y"].to_numpy() > 0, rows["item"].tolist(), []
        for first, n in blocks(replicates):
            w = weights(items, first, n, seed)
            pos, neg = np.add.reduceat(w * up, starts, axis=1), np.add.reduceat(w * ~up, starts, axis=1)
            below = np.cumsum(neg, axis=1) - neg
            out.append((key[0], first, *[v.tobytes() for v in (pos.sum(1), neg.sum(1), (pos * (below + neg / 2)).sum(1))]))
        return pd.DataFrame(out, columns=["cell", "first", "pos", "neg", "wins"])

    def across(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("cell", ignore_index=True)
        stack = lambda c: np.vstack([np.frombuffer(v) for v in cells[c]])
        starts = np.flatnonzero(np.concatenate([[True], np.diff(cells["cell"]) > 0]))
        pos, neg, wins = (np.add.reduceat(stack(c), starts, axis=0) for c in ("pos", "neg", "wins"))
        one = cells["cell"].to_numpy()[starts] % 2 == 1  # of one value, split over tasks
        wins = np.where(one[:, None], pos * neg / 2, wins)
        total, pairs = (wins + pos * (np.cumsum(neg, axis=0) - neg)).sum(0), pos.sum(0) * neg.sum(0)
        area = np.where(pairs > 0, total / np.where(pairs > 0, pairs, 1), np.nan)
        return pd.DataFrame({"rep": key[0] + np.arange(len(area)), "value": [None if np.isnan(a) else float(a) for a in area]})

    parts = placed(rows, "x", "cell", known).groupBy("cell", "cell_salt").applyInPandas(within, "cell int, first int, pos binary, neg binary, wins binary")
    return parts.groupBy("first").applyInPandas(across, "rep int, value double")


def first_ranks(rows: DataFrame, cell: str, replicates: int, seed: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per cell and replicate: the weight of all cells before it, and its own. At most TABLE / 2 numbers."""

    def total(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        items = rows["item"].tolist()
        w = np.concatenate([weights(items, first, n, seed).sum(1) for first, n in blocks(replicates)])
        return pd.DataFrame({"cell": [key[0]], "w": [w.tobytes()]})

    own: dict[int, np.ndarray] = {}
    for r in rows.select(cell, f"{cell}_salt", "item").groupBy(cell, f"{cell}_salt").applyInPandas(total, "cell int, w binary").toLocalIterator():
        own[r["cell"]] = own.get(r["cell"], 0.0) + np.frombuffer(r["w"])
    before, out = np.zeros(replicates), {}
    for c in sorted(own):
        out[c] = (before, own[c])
        before = before + own[c]
    return out


def ranks(cell: int, x: np.ndarray, w: np.ndarray, table: dict, first: int) -> np.ndarray:
    """The average rank of each row in each of the replicates that w weighs, ties sharing theirs."""
    n = len(w)
    before, own = (t[first : first + n, None] for t in table[cell])
    if cell % 2:
        return np.broadcast_to(before + (own + 1) / 2, w.shape)
    order, starts, which = local(x)
    tied = np.add.reduceat(w[:, order], starts, axis=1)
    middle = before + np.cumsum(tied, axis=1) - tied + (tied + 1) / 2
    out = np.empty_like(w)
    out[:, order] = middle[:, which]
    return out


def spearman_replicates(df: DataFrame, a: str, b: str, item: str, *, replicates: int = 100, seed: int = 1) -> DataFrame:
    """(rep, value): Spearman's correlation of each replicate, null where a side is constant."""
    rows = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"), F.col(item).cast("string").alias("item")).dropna()
    n, most = rows.count(), max(2, TABLE // (4 * 4 * replicates))
    for side in "ab":
        rows = placed(rows, side, f"c{side}", borders(rows, side, n, most))
    rows = stored(rows)
    spark = df.sparkSession
    tables = {side: spark.sparkContext.broadcast(first_ranks(rows, f"c{side}", replicates, seed)) for side in "ab"}

    def one_side(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        cell, _, first = key
        w = weights(rows["item"].tolist(), first, min(BLOCK, replicates - first), seed)
        r = ranks(cell, rows["a"].to_numpy(), w, tables["a"].value, first)
        return rows[["item", "b", "cb", "cb_salt", "first"]].assign(ranks=[v.tobytes() for v in r.T])

    def other_side(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        cell, _, first = key
        size = min(BLOCK, replicates - first)
        w = weights(rows["item"].tolist(), first, size, seed)
        ra, rb = np.vstack([np.frombuffer(v) for v in rows["ranks"]]).T, ranks(cell, rows["b"].to_numpy(), w, tables["b"].value, first)
        # Ranks less the middle one, so that sums of products keep their digits.
        middle = (sum(t[1] for t in tables["b"].value.values())[first : first + size, None] + 1) / 2
        da, db = ra - middle, rb - middle
        return pd.DataFrame({"rep": first + np.arange(size), "ab": (w * da * db).sum(1), "aa": (w * da * da).sum(1), "bb": (w * db * db).sum(1)})

    each = rows.withColumn("first", F.explode(F.array(*[F.lit(first) for first, _ in blocks(replicates)])))
    sides = each.groupBy("ca", "ca_salt", "first").applyInPandas(one_side, "item string, b double, cb int, cb_salt int, first int, ranks binary")
    sums = sides.groupBy("cb", "cb_salt", "first").applyInPandas(other_side, "rep int, ab double, aa double, bb double").groupBy("rep").agg(*[F.sum(c).alias(c) for c in ("ab", "aa", "bb")])
    spread = (F.col("aa") > 0) & (F.col("bb") > 0)
    return sums.select("rep", F.when(spread, F.col("ab") / F.sqrt(F.when(spread, F.col("aa") * F.col("bb")))).alias("value"))


METRICS = {"auroc": auroc_replicates, "spearman": spearman_replicates}


def point(df: DataFrame, metric: str, x: str, target: str) -> DataFrame:
    from plumbline.operators import rank

    whole = df.select(x, target).dropna()
    return rank.auroc(whole, [], x, target).select(F.col("auroc").alias("point")) if metric == "auroc" else rank.spearman(whole, [], x, target).select(F.col("rho").alias("point"))


def ends(reps: DataFrame) -> DataFrame:
    return reps.agg(F.percentile("value", 0.025).alias("low"), F.percentile("value", 0.975).alias("high"), F.count("value").alias("replicates"))


def interval(df: DataFrame, metric: str, x: str, target: str, item: str, **how) -> DataFrame:
    """point, low, high, replicates: the metric of x against the target with its 95 % percentile interval."""
    df = stored(df.select(item, x, target))  # counts, borders, points and replicates all read it
    return point(df, metric, x, target).crossJoin(F.broadcast(ends(METRICS[metric](df, x, target, item, **how))))


def difference(df: DataFrame, metric: str, x: str, other: str, target: str, item: str, **how) -> DataFrame:
    """The metric of x less that of another signal on the same rows and replicates; crosses_zero is strict."""
    rows = stored(df.where(F.col(x).isNotNull() & F.col(other).isNotNull()).select(item, x, other, target))
    one, two = (METRICS[metric](rows, c, target, item, **how) for c in (x, other))
    reps = one.join(two.withColumnRenamed("value", "second"), "rep").select("rep", (F.col("value") - F.col("second")).alias("value"))
    both = point(rows, metric, x, target).crossJoin(F.broadcast(point(rows, metric, other, target).withColumnRenamed("point", "second")))
    out = both.select((F.col("point") - F.col("second")).alias("point")).crossJoin(F.broadcast(ends(reps)))
    return out.withColumn("crosses_zero", (F.col("low") < 0) & (F.col("high") > 0))

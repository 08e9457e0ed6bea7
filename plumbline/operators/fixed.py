"""Bootstrap replicates of exactly n rows per stratum, without a shuffle of rows x replicates.

A replicate draws n rows of n with repeats. Rows lie in leaves by a keyed hash of their item; the number of draws that
fall into a leaf comes from a tree of halves over the leaves: each node splits its draws between its halves by a
binomial number, seeded by stratum, level and block of replicates, with the halves' shares of rows. So the counts of a
replicate add up to n exactly, wherever and however often a task runs. A leaf's task deals its draws to its rows and
adds up their values at once: what leaves it is sums, replicates x groups of them.

Rows are shuffled once, to leaves of about LEAF rows; a leaf that one item crowds (with a third of all rows, say) is cut
into parts, which are leaves of the tree as well. The tree is split by blocks of replicates, each of which needs the
number of rows in every leaf of its stratum; leaves x replicates numbers go to the leaves' tasks.

Rows with a null item are rows of one item; null values count as zero; a stratum with no rows doesn't appear.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.sources.tables import stored

#: Rows of a leaf, about.
LEAF = 1 << 14
#: Leaves of a stratum at most: beyond, leaves grow.
LEAVES = 1 << 18
#: Replicates that a task splits at a time.
BLOCK = 32


def tree_draws(counts: np.ndarray, n: int, seed: list[int]) -> np.ndarray:
    """(leaves, n) draws of n replicates by leaf: each node's draws split between its halves by a binomial number. counts: the
    rows of each leaf of the stratum."""
    sums = np.concatenate([[0], np.cumsum(counts)])
    low, high = np.array([0]), np.array([len(counts)])
    draws = np.full((1, n), int(sums[-1]))
    level = 0
    while (high - low > 1).any():
        middle = (low + high + 1) // 2
        left, whole = sums[middle] - sums[low], sums[high] - sums[low]
        share = np.where(whole > 0, left / np.maximum(whole, 1), 1.0)
        taken = np.random.default_rng([*seed, level]).binomial(draws, share[:, None])
        low, high = np.stack([low, middle], 1).ravel(), np.stack([middle, high], 1).ravel()
        draws = np.stack([taken, draws - taken], 1).reshape(-1, n)
        some = high > low  # a single leaf's right half is empty
        low, high, draws, level = low[some], high[some], draws[some], level + 1
    return draws


def dealt(draws: np.ndarray, rows: int, seed: list[int]) -> np.ndarray:
    """(replicates, rows) counts: each replicate's draws, dealt to the leaf's rows alike."""
    rng = np.random.default_rng(seed)
    out = np.zeros((len(draws), rows), np.int64)
    for r, n in enumerate(draws):
        out[r] = np.bincount(rng.integers(0, rows, n), minlength=rows) if rows else 0
    return out


def replicate_sums(df: DataFrame, by: list[str], item: str, values: list[str], within: list[str] | None = None, *, replicates: int = 100, seed: int = 1, leaf: int | None = None) -> DataFrame:
    """(by, rep, within, n, values): per stratum, replicate and group within it (a bin, say) the rows drawn and the sums of
    values over them. n adds up to the stratum's number of rows in every replicate."""
    within, leaf = within or [], leaf or LEAF
    key = F.coalesce(F.col(item).cast("string"), F.lit(""))
    rows = df.select(*by, *within, *[F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(v) for v in values], key.alias("__item"))
    size = rows.groupBy(*by).agg(F.count("*").alias("__n"))
    most = size.agg(F.max("__n")).first()[0] or 0
    n_leaves = int(min(LEAVES, max(1, 1 << max(0, -(-most // leaf) - 1).bit_length())))
    rows = rows.withColumn("__leaf", F.pmod(F.xxhash64("__item", F.lit(seed)), F.lit(n_leaves)).cast("int"))
    # A leaf that one item crowds is cut further, by a hash of the row's values: equal rows are alike, so that their order
    # within a leaf doesn't matter, nor which part a repeat of them lies in as long as their number there is the same.
    counts = rows.groupBy(*by, "__leaf").agg(F.count("*").alias("__in"))
    crowded = counts.where(F.col("__in") > 8 * leaf).select(*by, "__leaf", F.ceil(F.col("__in") / leaf).cast("int").alias("__parts"))
    columns = [*within, *values, "__item"]
    equal = rows.groupBy(*by, "__leaf", *columns).agg(F.count("*").alias("__same"))
    equal = equal.join(crowded, [*by, "__leaf"], "left").withColumn("__parts", F.coalesce("__parts", F.lit(1)))
    # Equal rows spread evenly over the parts of their leaf, from a part that their values name.
    at = F.pmod(F.xxhash64(*columns), F.col("__parts"))
    spread = F.explode(F.sequence(F.lit(0), F.least(F.col("__parts"), F.col("__same")).cast("int") - 1))
    equal = equal.withColumn("__at", at).withColumn("__i", spread)
    share = F.floor(F.col("__same") / F.col("__parts")) + (F.col("__i") < F.col("__same") % F.col("__parts")).cast("int")
    equal = equal.withColumn("__part", F.pmod(F.col("__at") + F.col("__i"), F.col("__parts")).cast("int")).withColumn("__same", share)
    equal = stored(equal.where("__same > 0").drop("__parts", "__at", "__i"))
    counts = equal.groupBy(*by, "__leaf", "__part").agg(F.sum("__same").alias("__in"))
    groups, firsts = len(by), list(range(0, replicates, BLOCK))
    name = lambda key: [int(b) for b in "\x00".join(map(str, key[:groups])).encode()]  # noqa: E731  a stratum's own seed

    def split(key: tuple, tree: pd.DataFrame) -> pd.DataFrame:
        tree, first = tree.sort_values(["__leaf", "__part"], ignore_index=True), int(key[-1])
        draws = tree_draws(tree["__in"].to_numpy(), min(BLOCK, replicates - first), [seed, first, *name(key)])
        return tree[[*by, "__leaf", "__part", "__first"]].assign(__draws=[d.tobytes() for d in draws])

    fields = T.StructType([*[df.schema[c] for c in by], *T.StructType.fromDDL("__leaf int, __part int, __first int, __draws binary")])
    tree = counts.withColumn("__first", F.explode(F.array(*[F.lit(f) for f in firsts]))).groupBy(*by, "__first").applyInPandas(split, fields)

    def work(key: tuple, rows: pd.DataFrame, draws: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(columns, ignore_index=True)
        repeats = rows["__same"].to_numpy()
        starts = np.concatenate([[0], np.cumsum(repeats)[:-1]])
        cell = rows.groupby(within, dropna=False, sort=True).ngroup().to_numpy() if within else np.zeros(len(rows), int)
        _, at = np.unique(cell, return_index=True)
        first = rows.iloc[at][within].reset_index(drop=True)
        marks = np.zeros((len(rows), len(first)))
        marks[np.arange(len(rows)), cell] = 1
        v = rows[values].to_numpy(float)
        parts = []
        for at, packed in sorted(zip(draws["__first"], draws["__draws"], strict=True)):
            n = np.frombuffer(packed, np.int64)
            w = np.add.reduceat(dealt(n, int(repeats.sum()), [seed, int(key[groups]), int(key[groups + 1]), int(at), *name(key)]), starts, axis=1).astype(float)
            sums = {"n": w @ marks, **{c: (w * v[:, i]) @ marks for i, c in enumerate(values)}}
            for r in range(len(w)):
                parts.append(first.assign(**dict(zip(by, key[:groups], strict=True)), rep=at + r, n=sums["n"][r].astype(np.int64), **{c: sums[c][r] for c in values}))
        return pd.concat(parts, ignore_index=True)[[*by, "rep", *within, "n", *values]]

    schema = T.StructType([*[df.schema[c] for c in by], *T.StructType.fromDDL("rep int"), *[df.schema[c] for c in within], *T.StructType.fromDDL(", ".join(["n long", *[f"`{v}` double" for v in values]]))])
    on = [*by, "__leaf", "__part"]
    sums = equal.groupBy(*on).cogroup(tree.groupBy(*on)).applyInPandas(work, schema)
    return sums.groupBy(*by, "rep", *within).agg(F.sum("n").alias("n"), *[F.sum(v).alias(v) for v in values]).where("n > 0")


def bootstrap_mean(df: DataFrame, by: list[str], value: str, item: str, **how) -> DataFrame:
    """Mean per stratum with its 95 % percentile interval over replicates of as many rows as it has."""
    reps = replicate_sums(df, by, item, [value], **how).select(*by, (F.col(value) / F.col("n")).alias("__m"))
    ci = reps.groupBy(*by).agg(F.percentile("__m", 0.025).alias("low"), F.percentile("__m", 0.975).alias("high"))
    point = df.groupBy(*by).agg(F.count("*").alias("n"), (F.sum(value) / F.count("*")).alias("point"))
    return point.join(ci, by) if by else point.crossJoin(F.broadcast(ci))


def delta_ece(df: DataFrame, stratum: str, hard: str, easy: str, bin_of, item: str, *, conf: str = "conf", correct: str = "correct", **how) -> DataFrame:
    """ECE of both strata and their difference, with its 95 % percentile interval, each stratum drawn with as many rows as it
    has."""
    from plumbline.operators.resample import delta_point

    rows = stored(df.where(F.col(stratum).isin(hard, easy)).select(item, stratum, F.col(conf).cast("double").alias("conf"), F.col(correct).cast("double").alias("correct"), bin_of.alias("__bin")))
    sums = replicate_sums(rows, [stratum], item, ["conf", "correct"], ["__bin"], **how)
    eces = sums.groupBy(stratum, "rep").agg((F.sum(F.abs(F.col("conf") - F.col("correct"))) / F.sum("n")).alias("e"))
    pick = lambda s: F.max(F.when(F.col(stratum) == s, F.col("e")))
    d = eces.groupBy("rep").agg((pick(hard) - pick(easy)).alias("d"))
    ci = d.agg(F.percentile("d", 0.025).alias("low"), F.percentile("d", 0.975).alias("high"))
    return delta_point(rows, stratum, hard, easy).crossJoin(F.broadcast(ci))

"""Resampling with keyed draws: equal-size subsamples, samples, bootstrap and jackknife intervals, McNemar, expected ECE.

Draws are MD5 numbers of seed, replicate and item, so results don't depend on partitions or retries. A bootstrap
gives each row a Poisson(1) weight per replicate and aggregates at once: the exploded rows are added up in the map
stage, and only replicates x groups x bins rows are shuffled. One MD5 serves four replicates. Jackknife values come in
closed form from bin sums, one per row, so nothing is computed anew for each item left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import expr as X
from plumbline.functions.expr import keyed, poisson
from plumbline.operators.calibrate import ece, reliability
from plumbline.sources.tables import parts, spread, stored


def first_n(df: DataFrame, by: list[str], key: Column, n: Column | int, tie: str) -> DataFrame:
    """The n rows of each group with the least key (0 to below 2 ** 32; ties by `tie`): whole cells of keys are kept or
    left by their counts, and only the cell at the border is ordered."""
    placed = df.withColumn("__key", key).withColumn("__cell", F.floor(F.col("__key") / (1 << 20)).cast("int")).withColumn("__most", F.lit(n) if isinstance(n, int) else n)
    before = Window.partitionBy(*by).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = placed.groupBy(*by, "__cell").agg(F.count("*").alias("__in")).withColumn("__before", F.coalesce(F.sum("__in").over(before), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy(*by, "__cell").orderBy("__key", tie))
    out = placed.join(cells, [*by, "__cell"]).where("__before < __most").withColumn("__rank", rank)
    return out.where(F.col("__before") + F.col("__rank") <= F.col("__most")).drop("__key", "__cell", "__most", "__in", "__before", "__rank")


def equal_n(df: DataFrame, stratum: str, item: str, seed: int) -> DataFrame:
    """As many rows of each stratum as the smallest has."""
    least = df.groupBy(stratum).count().agg(F.min("count").alias("least"))
    return first_n(df.crossJoin(F.broadcast(least)), [stratum], keyed(F.lit(seed), F.col(item)), F.col("least"), item).drop("least")


def strata(df: DataFrame, value: str, low: float = 0.25, high: float = 0.75) -> DataFrame:
    """df with `stratum`: easy up to the linear quantile `low` of all values, hard from the quantile `high` on, mid between;
    null of a null. Quantiles that don't differ (or no value at all) are an error."""
    from plumbline.operators.rank import quantiles

    ends = quantiles(df, [], value, {"__low": low, "__high": high}).agg(F.max("__low").alias("__low"), F.max("__high").alias("__high"))  # one row, of an empty table too
    stop = F.raise_error(F.concat(F.lit("degenerate quantiles: "), F.coalesce(F.col("__low").cast("string"), F.lit("none")), F.lit(" and "), F.coalesce(F.col("__high").cast("string"), F.lit("none"))))
    ends = ends.select(F.when(F.col("__low") < F.col("__high"), F.col("__low")).otherwise(stop.cast("double")).alias("__low"), "__high")
    x = F.col(value)
    return df.crossJoin(F.broadcast(ends)).withColumn("stratum", F.when(x <= F.col("__low"), "easy").when(x >= F.col("__high"), "hard").when(x.isNotNull(), "mid")).drop("__low", "__high")


def balanced(df: DataFrame, value: str, item: str, target: int, seed: int) -> DataFrame:
    """The easy and the hard pool of strata(): each row with its pool's size, and whether it is among the `target` rows that
    are drawn from it (`analysis`); the others are the discarded ones. A pool of fewer rows is an error."""
    pools = strata(df, value).where("stratum in ('easy', 'hard')")
    sizes = pools.groupBy("stratum").agg(F.count("*").alias("pool"))
    short = F.raise_error(F.concat(F.lit("pool "), F.col("stratum"), F.lit(" of "), F.col("pool").cast("string"), F.lit(f" rows can't supply {target}")))
    sizes = sizes.withColumn("pool", F.when(F.col("pool") >= target, F.col("pool")).otherwise(short.cast("long")))
    chosen = first_n(pools.select(item, "stratum"), ["stratum"], keyed(F.lit(seed), F.col(item)), F.lit(target), item)
    out = pools.join(F.broadcast(sizes), "stratum")  # two rows
    return out.join(chosen.select(item, "stratum", F.lit(True).alias("analysis")), [item, "stratum"], "left").withColumn("analysis", F.coalesce("analysis", F.lit(False)))


def weighted(df: DataFrame, item: str, replicates: int, seed: int) -> DataFrame:
    """df by replicate (rep) with its weight there; rows of weight 0 are left out. Rows are spread by item first, as each
    becomes many."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = df.repartition(tasks, item).withColumn("__four", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // 4))))
    out = out.withColumn("__md5", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("__four").cast("string"), F.col(item).cast("string"))))
    out = out.withColumn("__k", F.explode(F.array(*[F.lit(k) for k in range(4)]))).withColumn("rep", F.col("__four") * 4 + F.col("__k"))
    out = out.withColumn("weight", poisson(F.substring("__md5", F.col("__k") * 8 + 1, F.lit(8))))
    return out.where((F.col("weight") > 0) & (F.col("rep") < replicates)).drop("__four", "__md5", "__k")


def percentiles(reps: DataFrame, by: list[str], value: str, **ends: float) -> DataFrame:
    """Percentiles over replicates, of which a group has a bounded number; null values are left out."""
    return reps.groupBy(*by).agg(*[F.percentile(value, p).alias(n) for n, p in ends.items()])


def bootstrap(df: DataFrame, by: list[str], statistic: Callable[[Column], Column], item: str, *, replicates: int = 100, seed: int = 1) -> DataFrame:
    """Any statistic that is an aggregate of weights, given as a function from the weight column: its point, and its 95 %
    percentile interval with items drawn anew. Paired comparisons are rows that hold both sides of an item. Rows of a null group
    are a group."""
    reps = weighted(df, item, replicates, seed).groupBy(*by, "rep").agg(statistic(F.col("weight")).alias("__s"))
    ci = percentiles(reps, by, "__s", low=0.025, high=0.975)
    point = df.groupBy(*by).agg(F.count("*").alias("n"), statistic(F.lit(1)).alias("point"))
    if not by:
        return point.crossJoin(F.broadcast(ci))
    ci = ci.select(*[F.col(c).alias(f"__of_{c}") for c in by], "low", "high")
    same = [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in by]
    return point.join(ci, same).drop(*[f"__of_{c}" for c in by])


def mean_of(value: str) -> Callable[[Column], Column]:
    return lambda w: F.sum(w * F.col(value)) / F.sum(w)


def paired(df: DataFrame, item: str, model: str, a, b, values: list[str]) -> DataFrame:
    """Items that both models have, with <value>_a and <value>_b."""
    side = lambda which, end: df.where(F.col(model) == which).select(item, *[F.col(v).alias(f"{v}_{end}") for v in values])
    return side(a, "a").join(side(b, "b"), item)


def paired_difference(df: DataFrame, item: str, model: str, a, b, value: str, by: list[str] | None = None, **how) -> DataFrame:
    """Mean of value of a less that of b over the items of both, with interval; crosses_zero is strict on both sides."""
    by = by or []
    rows = paired(df, item, model, a, b, [value, *by]).withColumn("__d", F.col(f"{value}_a") - F.col(f"{value}_b")).withColumns({c: F.col(f"{c}_a") for c in by})
    out = bootstrap(rows, by, mean_of("__d"), item, **how)
    return out.withColumn("crosses_zero", (F.col("low") < 0) & (F.col("high") > 0))


def bootstrap_mean(df: DataFrame, by: list[str], value: str, item: str, **how) -> DataFrame:
    """Mean per group with a 95 % percentile interval over replicates."""
    return bootstrap(df, by, mean_of(value), item, **how)


def delta_replicates(rows: DataFrame, stratum: str, hard: str, easy: str, item: str, replicates: int, seed: int) -> DataFrame:
    """(rep, d): the difference of ECE of each replicate of rows with a __bin."""
    pick = lambda s: F.max(F.when(F.col(stratum) == s, F.col("ece")))
    reps = ece(reliability(weighted(rows, item, replicates, seed), [stratum, "rep"], F.col("__bin"), weight=F.col("weight")), [stratum, "rep"])
    return reps.groupBy("rep").agg((pick(hard) - pick(easy)).alias("d"))


def delta_point(rows: DataFrame, stratum: str, hard: str, easy: str) -> DataFrame:
    pick = lambda s: F.max(F.when(F.col(stratum) == s, F.col("ece")))
    point = ece(reliability(rows, [stratum], F.col("__bin")), [stratum]).agg(pick(hard).alias("ece_hard"), pick(easy).alias("ece_easy"))
    return point.withColumn("delta", F.col("ece_hard") - F.col("ece_easy"))


def binned(df: DataFrame, stratum: str, hard: str, easy: str, bin_of: Column, item: str) -> DataFrame:
    """The rows of both strata with their bins, stored, as point and replicates both read them."""
    return stored(df.where(F.col(stratum).isin(hard, easy)).select(item, stratum, F.col("conf").cast("double").alias("conf"), F.col("correct").cast("double").alias("correct"), bin_of.alias("__bin")))


def delta_ece(df: DataFrame, stratum: str, hard: str, easy: str, bin_of: Column, item: str, *, replicates: int = 100, seed: int = 1) -> DataFrame:
    """ECE of both strata, their difference, its 95 % percentile interval, and the shares of replicates at or below and
    at or above 0; replicates weigh items independently."""
    rows = binned(df, stratum, hard, easy, bin_of, item)
    ci = delta_replicates(rows, stratum, hard, easy, item, replicates, seed).agg(F.percentile("d", 0.025).alias("low"), F.percentile("d", 0.975).alias("high"), F.avg((F.col("d") <= 0).cast("int")).alias("share_low"), F.avg((F.col("d") >= 0).cast("int")).alias("share_high"))
    return delta_point(rows, stratum, hard, easy).crossJoin(F.broadcast(ci))  # one row each


def ece_without(rows: DataFrame, stratum: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a __bin, with `less`: their stratum's ECE without the row, which changes its own bin's gap only; and each
    stratum's __sum of gaps and number of rows __n."""
    gaps = rows.groupBy(stratum, "__bin").agg((F.sum("conf") - F.sum("correct")).alias("__gap"), F.count("*").alias("__in"))  # two strata of some bins
    sums = gaps.groupBy(stratum).agg(F.sum(F.abs("__gap")).alias("__sum"), F.sum("__in").alias("__n"))
    out = rows.join(F.broadcast(gaps), [stratum, "__bin"]).join(F.broadcast(sums), stratum)
    less = (F.col("__sum") - F.abs("__gap") + F.abs(F.col("__gap") - F.col("conf") + F.col("correct"))) / F.nullif(F.col("__n") - 1, F.lit(0))
    return out.withColumn("less", less).drop("__gap", "__in", "__sum", "__n"), sums


def jackknife(rows: DataFrame, stratum: str, hard: str, easy: str) -> DataFrame:
    """Rows with a __bin, with `left_out`: the difference of ECE without the row."""
    out, sums = ece_without(rows, stratum)
    other = sums.agg(*[F.max(F.when(F.col(stratum) == s, F.col("__sum") / F.col("__n"))).alias(n) for s, n in ((hard, "__h"), (easy, "__e"))])
    out = out.crossJoin(F.broadcast(other)).withColumn("left_out", F.when(F.col(stratum) == hard, F.col("less") - F.col("__e")).otherwise(F.col("__h") - F.col("less")))
    return out.drop("less", "__h", "__e")


def paired_jackknife(rows: DataFrame, item: str, model: str, a, b) -> DataFrame:
    """Per item (of one row of each model): `left_out`, the difference of the models' ECE without both of its rows."""
    out, _ = ece_without(rows, model)
    side = lambda m: F.max(F.when(F.col(model) == m, F.col("less")))
    return out.groupBy(item).agg((side(a) - side(b)).alias("left_out"))


def acceleration(values: DataFrame, value: str) -> DataFrame:
    """(mean, a) of jackknife values: a of BCa, 0 without spread. Central moments in a second pass."""
    mean = values.agg(F.avg(value).alias("mean"))
    d = values.crossJoin(F.broadcast(mean)).withColumn("__d", F.col("mean") - F.col(value))
    sums = d.agg(F.max("mean").alias("mean"), F.sum(F.pow("__d", 2)).alias("two"), F.sum(F.pow("__d", 3)).alias("three"))
    return sums.select("mean", F.when(F.col("two") > 1e-18, F.col("three") / (6 * F.pow("two", 1.5))).otherwise(0.0).alias("a"))


def bca_ends(reps: DataFrame, value: str, point: DataFrame, accelerated: DataFrame, level: float = 0.95) -> DataFrame:
    """(z0, low, high): the bias-corrected and accelerated interval of the replicates, bounded in number. point, accelerated: one
    row with columns point and a."""
    s = reps.agg(F.sort_array(F.collect_list(value)).alias("s")).crossJoin(F.broadcast(point)).crossJoin(F.broadcast(accelerated))
    r = F.size("s")
    share = F.size(F.filter("s", lambda x: x < F.col("point"))) / r
    s = s.withColumn("z0", X.normal_quantile(F.greatest(1 / (r + 1), F.least(r / (r + 1), share))))
    z = NormalDist().inv_cdf((1 + level) / 2)

    def end(z: float) -> Column:
        moved = F.col("z0") + z
        h = (r - 1) * X.normal_cdf(F.col("z0") + moved / (1 - F.col("a") * moved))
        at = F.floor(h).cast("int")
        x, y = F.element_at("s", at + 1), F.element_at("s", F.least(at + 2, r))
        return x + (h - at) * (y - x)

    return s.select("z0", end(-z).alias("low"), end(z).alias("high"))


def delta_ece_bca(df: DataFrame, stratum: str, hard: str, easy: str, bin_of: Column, item: str, *, replicates: int = 100, seed: int = 1) -> DataFrame:
    """delta with its BCa interval: point, bias z0, acceleration a, low and high."""
    rows = binned(df, stratum, hard, easy, bin_of, item)
    point = delta_point(rows, stratum, hard, easy).select(F.col("delta").alias("point"))
    a = acceleration(jackknife(rows, stratum, hard, easy), "left_out")
    ends = bca_ends(delta_replicates(rows, stratum, hard, easy, item, replicates, seed), "d", point, a)
    return point.crossJoin(F.broadcast(a.select("a"))).crossJoin(F.broadcast(ends))


def in_both(df: DataFrame, item: str, model: str, a, b, bins: int) -> DataFrame:
    """binned() rows of the items that both models answered."""
    both = df.where(F.col(model).isin(a, b)).groupBy(item).agg(F.count_distinct(model).alias("__n")).where("__n = 2").select(item)
    return binned(df.join(both, item, "left_semi"), model, a, b, X.bin_digitize(F.col("conf"), bins), item)


def paired_delta_ece(df: DataFrame, item: str, model: str, a, b, bins: int = 10, *, replicates: int = 100, seed: int = 1) -> DataFrame:
    """ECE of model a less that of b over the items of both, each replicate weighing both sides of an item alike."""
    rows = in_both(df, item, model, a, b, bins)
    ci = percentiles(delta_replicates(rows, model, a, b, item, replicates, seed), [], "d", low=0.025, high=0.975)
    names = {"ece_hard": "ece_a", "ece_easy": "ece_b"}
    return delta_point(rows, model, a, b).withColumnsRenamed(names).crossJoin(F.broadcast(ci))


def paired_delta_ece_bca(df: DataFrame, item: str, model: str, a, b, bins: int = 10, *, replicates: int = 100, seed: int = 1) -> DataFrame:
    """The paired difference with its BCa interval: point, a, z0, low, high. Replicates weigh, and the jackknife leaves out,
    whole items; df has one row of an item and model."""
    rows = in_both(df, item, model, a, b, bins)
    point = delta_point(rows, model, a, b).select(F.col("delta").alias("point"))
    accelerated = acceleration(paired_jackknife(rows, item, model, a, b), "left_out")
    ends = bca_ends(delta_replicates(rows, model, a, b, item, replicates, seed), "d", point, accelerated)
    return point.crossJoin(F.broadcast(accelerated.select("a"))).crossJoin(F.broadcast(ends))


def auroc_bootstrap(df: DataFrame, x: str, y: str, item: str, *, replicates: int = 100, seed: int = 1) -> DataFrame:
    """AUROC with its 95 % percentile interval: every replicate's weighted area, ties by half; one without a class is left out."""
    from plumbline.operators.rankboot import interval

    return interval(df, "auroc", x, y, item, replicates=replicates, seed=seed).select(F.col("point").alias("auroc"), "low", "high")


def slope_interval(df: DataFrame, tier: str, item: str, bins: int = 10, *, replicates: int = 100, seed: int = 1) -> DataFrame:
    """Slope of ECE on accuracy over tiers with its 95 % interval; replicates with a tier of fewer than two rows, or
    with equal accuracies, are left out and counted."""
    rows = stored(df.select(tier, item, F.col("conf").cast("double").alias("conf"), F.col("correct").cast("double").alias("correct"), X.bin_digitize(F.col("conf"), bins).alias("__bin")))

    def slopes(source: DataFrame, by: list[str], weight: Column) -> DataFrame:
        b = reliability(source, [*by, tier], F.col("__bin"), weight=weight)
        t = b.groupBy(*by, tier).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.abs(F.col("mean_correct") - F.col("mean_conf"))) / F.sum("n")).alias("ece"), (F.sum(F.col("n") * F.col("mean_correct")) / F.sum("n")).alias("accuracy"))
        fit = (F.min("n") >= 2) & (F.max("accuracy") - F.min("accuracy") > 1e-9)
        return t.groupBy(*by).agg(F.count("*").alias("tiers"), F.when(fit, F.regr_slope("ece", "accuracy")).alias("slope"))

    point = slopes(rows, [], F.lit(1.0))
    reps = slopes(weighted(rows, item, replicates, seed), ["rep"], F.col("weight")).crossJoin(F.broadcast(point.select(F.col("tiers").alias("all"))))
    reps = reps.withColumn("slope", F.when(F.col("tiers") == F.col("all"), F.col("slope")))
    ci = reps.agg(F.count("slope").alias("replicates"), F.percentile("slope", 0.025).alias("low"), F.percentile("slope", 0.975).alias("high"))
    return point.select("tiers", "slope").crossJoin(F.broadcast(ci))


def mcnemar(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Discordant counts, the statistic with continuity correction (0 without any), and its chi-square (1) tail p."""
    only_a, only_b = F.count_if(F.col(a) & ~F.col(b)), F.count_if(~F.col(a) & F.col(b))
    d = df.groupBy(*by).agg(only_a.alias("b"), only_b.alias("c"))
    n = F.col("b") + F.col("c")
    d = d.withColumn("statistic", F.when(n > 0, F.pow(F.abs(F.col("b") - F.col("c")) - 1, 2) / F.when(n > 0, n)).otherwise(0.0))
    return d.withColumn("p", F.when(n > 0, X.chi2_tail(F.col("statistic"))).otherwise(1.0))


def subset(df: DataFrame, item: str, share: float, seed: int) -> DataFrame:
    """max(1, round(share * n)) rows, by keyed draws."""
    n = df.agg(F.greatest(F.lit(1), F.bround(F.count("*") * share).cast("int")).alias("__want"))
    return first_n(df.crossJoin(F.broadcast(n)), [], keyed(F.lit(seed), F.col(item)), F.col("__want"), item).drop("__want")


def round_robin(df: DataFrame, by: list[str], item: str, n: int, seed: int) -> DataFrame:
    """n rows: the first of each group by keyed draws, then the second of each, and so on; groups in order."""
    some = first_n(df, by, keyed(F.lit(seed), F.col(item)), n, item)  # no group gives more than n
    turn = F.row_number().over(Window.partitionBy(*by).orderBy(keyed(F.lit(seed), F.col(item)), item))
    return some.withColumn("__turn", turn).orderBy("__turn", *by).limit(n).drop("__turn")


def calibrated_sums(df: DataFrame, by: list[str], *, conf: str, item: str, kappa: float, votes: int, bins: int, sims: int, seed: int, block: int = 4096) -> DataFrame:
    """Per group, simulation (rep) and bin: n, conf and right, of simulations in which confidences are right. Each row
    draws its share of votes from a Beta-Binomial around its confidence. Rows are dealt by a hash of their item into
    blocks of about `block`; a block, in order of items, draws from a generator of its own, so partitions don't matter.
    A task adds up all of its blocks before it hands out sums."""
    fields = [df.schema[c] for c in by]
    size = df.count()
    blocks = max(1, size // block)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = [b for b in batches if len(b)]
        if not read:
            return
        rows = pd.concat(read, ignore_index=True).sort_values(["__block", "__item", *by, "__conf"], ignore_index=True)
        p, block_of = rows["__conf"].to_numpy(), rows["__block"].to_numpy()
        q = np.clip(p, 1e-4, 1 - 1e-4)
        group = rows.groupby(by, dropna=False).ngroup().to_numpy() if by else np.zeros(len(rows), int)
        cell = group * bins + np.minimum(bins - 1, (p * bins).astype(int))
        known, first, where = np.unique(cell, return_index=True, return_inverse=True)
        right = np.zeros((sims, len(known)))
        starts = np.flatnonzero(np.diff(block_of, prepend=-1))
        for start, stop in zip(starts, [*starts[1:], len(rows)], strict=True):
            rng = np.random.default_rng([seed, int(block_of[start])])
            a, b, at = kappa * q[start:stop], kappa * (1 - q[start:stop]), where[start:stop]
            for s in range(sims):
                right[s] += np.bincount(at, rng.binomial(votes, rng.beta(a, b)), len(known))
        out = rows[by].iloc[np.tile(first, sims)].reset_index(drop=True)
        n, total = np.bincount(where), np.bincount(where, p)
        yield out.assign(rep=np.repeat(np.arange(sims), len(known)), bin=np.tile(known % bins, sims), n=np.tile(n, sims), conf=np.tile(total, sims), right=right.ravel() / votes)

    source = df.select(*by, F.col(conf).cast("double").alias("__conf"), F.xxhash64(item).alias("__item"), F.pmod(F.xxhash64(item, F.lit(seed)), F.lit(blocks)).alias("__block"))
    source = source.repartition(min(blocks, parts(df.sparkSession, size)), "__block")  # whole blocks, as many in every task
    schema = T.StructType([*fields, *T.StructType.fromDDL("rep long, bin long, n long, conf double, right double")])
    return source.mapInPandas(run, schema).groupBy(*by, "rep", "bin").agg(F.sum("n").alias("n"), F.sum("conf").alias("conf"), F.sum("right").alias("right"))


def calibrated_eces(df: DataFrame, by: list[str], *, conf: str = "conf", item: str = "item", kappa: float = 20.0, votes: int = 100, bins: int = 10, sims: int = 50, seed: int = 1) -> DataFrame:
    """(by, rep, e): ECE of each simulation of calibrated_sums()."""
    b = calibrated_sums(df, by, conf=conf, item=item, kappa=kappa, votes=votes, bins=bins, sims=sims, seed=seed)
    return b.groupBy(*by, "rep").agg((F.sum(F.abs(F.col("conf") - F.col("right"))) / F.sum("n")).alias("e"))


def expected_ece(df: DataFrame, by: list[str], **how) -> DataFrame:
    """Per group: mean ECE of `sims` simulations in which confidences are right."""
    return calibrated_eces(df, by, **how).groupBy(*by).agg(F.avg("e").alias("expected_ece"))


def _tails() -> list[Column]:
    """Of simulated differences d beside the raw one: their mean, and the shares at least and at most as large."""
    share = lambda c: F.avg(c.cast("int"))
    return [F.avg("d").alias("bias"), share(F.col("d") >= F.col("raw")).alias("up"), share(F.col("d") <= F.col("raw")).alias("down"), F.count("*").alias("draws")]


def corrected_delta_ece(df: DataFrame, stratum: str, hard: str, easy: str, item: str, *, reference: DataFrame | None = None, bins: int = 10, replicates: int = 100, sims: int = 50, seed: int = 1, **how) -> DataFrame:
    """One row: the raw difference of ECE (floor bins), its bias (that of expected ECE), the corrected one with its
    interval (the bias held fixed), p of as extreme a difference where confidences are right (two-sided), how many
    simulations were as extreme, p_holds (the share of `reference`, a table of one column d, at or below the corrected
    difference; null without it) and the verdict."""
    from plumbline.operators.agree import verdict

    rows = binned(df, stratum, hard, easy, X.bin_floor(F.col("conf"), bins), item)
    sim = calibrated_eces(rows, [stratum], item=item, bins=bins, sims=sims, seed=seed, **how)
    null = stored(sim.groupBy("rep").agg((F.max(F.when(F.col(stratum) == hard, F.col("e"))) - F.max(F.when(F.col(stratum) == easy, F.col("e")))).alias("d")))
    point = delta_point(rows, stratum, hard, easy).select(F.col("delta").alias("raw"))
    tails = null.crossJoin(F.broadcast(point)).agg(*_tails())
    ci = percentiles(delta_replicates(rows, stratum, hard, easy, item, replicates, seed), [], "d", low=0.025, high=0.975)
    out = point.crossJoin(F.broadcast(tails)).crossJoin(F.broadcast(ci))
    side = F.least("up", "down")
    out = out.select("raw", "bias", (F.col("raw") - F.col("bias")).alias("corrected"), *[(F.col(c) - F.col("bias")).alias(c) for c in ("low", "high")], F.least(F.lit(1.0), 2 * side).alias("p"), F.round(side * F.col("draws")).cast("long").alias("n_extreme"))
    if reference is None:
        out = out.withColumn("p_holds", F.lit(None).cast("double"))
    else:
        out = p_holds(out, reference, "corrected")
    return out.withColumn("verdict", verdict(F.col("corrected"), F.col("p"), F.col("p_holds")))


def corrected_by_pass(df: DataFrame, number: str, stratum: str, hard: str, easy: str, item: str, p: str, human: str, *, bins: int = 10, sims: int = 50, seed: int = 1, **how) -> DataFrame:
    """The corrected soft difference of ECE in every pass, and of the mean vectors over passes (pass 'mean'), always on the same items:
    those of the first pass, as many of either stratum, as equal_n() draws them. Per pass: items of a stratum, raw, bias, corrected,
    two-sided p and the number of simulations as extreme; in every row the least and the largest corrected difference. An item that
    lacks a pass or has one twice is an error. df is read once; all passes are simulated in one job; passes are of a bounded number."""
    from plumbline.operators.calibrate import ece, reliability
    from plumbline.operators.records import mean_vector, whole_passes

    answers = stored(df.select(item, F.col(number).alias("pass"), stratum, p, human))
    first, passes = answers.agg(F.min("pass"), F.count_distinct("pass")).first()
    start = answers.where((F.col("pass") == F.lit(first)) & F.col(stratum).isin(hard, easy))
    locked = stored(equal_n(start, stratum, item, seed).select(item, stratum, human))
    rows = spread(answers.select(item, "pass", p), item).join(locked, item)
    rows = whole_passes(rows, [item], p, passes, F.any_value(stratum).alias(stratum), F.any_value(human).alias(human))
    of_each = F.transform("passes", lambda x: F.struct(x["pass"].cast("string").alias("pass"), x["p"].alias("p")))
    of_mean = F.struct(F.lit("mean").alias("pass"), mean_vector(F.col("passes")).alias("p"))
    each = rows.select(item, stratum, human, F.explode(F.concat(of_each, F.array(of_mean))).alias("__x"))
    each = stored(each.select(item, F.col("__x.pass").alias("pass"), stratum, F.array_max("__x.p").alias("conf"), X.soft_correctness(F.col("__x.p"), F.col(human)).alias("correct")))
    by = ["pass", stratum]
    gap = lambda v: F.max(F.when(F.col(stratum) == hard, F.col(v))) - F.max(F.when(F.col(stratum) == easy, F.col(v)))
    point = ece(reliability(each, by, X.bin_floor(F.col("conf"), bins)), by).groupBy("pass").agg(F.min("n").cast("long").alias("items"), gap("ece").alias("raw"))
    null = calibrated_eces(each, by, item=item, bins=bins, sims=sims, seed=seed, **how).groupBy("pass", "rep").agg(gap("e").alias("d"))
    tails = null.join(F.broadcast(point), "pass").groupBy("pass", "items", "raw").agg(*_tails())
    side = F.least("up", "down")
    out = tails.select("pass", "items", "raw", "bias", (F.col("raw") - F.col("bias")).alias("corrected"), F.least(F.lit(1.0), 2 * side).alias("p"), F.round(side * F.col("draws")).cast("long").alias("n_extreme"))
    out = stored(out)
    return out.crossJoin(F.broadcast(out.agg(F.min("corrected").alias("least"), F.max("corrected").alias("most"))))


def p_holds(df: DataFrame, reference: DataFrame, value: str) -> DataFrame:
    """df with p_holds: the share of reference's d at or below the value; null for a null value or an empty reference. Both
    sides' distinct values are cut into the same cells in one running sum, so neither of them is an array or a broadcast."""
    from plumbline.operators.rank import cumulate

    x = F.col(value).cast("double")
    both = reference.select(F.col("d").cast("double").alias("__x"), F.lit(1).cast("long").alias("__d")).union(df.select(x.alias("__x"), F.lit(0).cast("long").alias("__d"))).where("__x is not null")
    values = stored(both.groupBy("__x").agg(F.sum("__d").alias("__d")))
    c = cumulate(values, [], "__x", {"__d": F.col("__d")}).select("__x", F.col("cum___d").alias("__below"))
    size = reference.agg(F.count("d").alias("__size"))
    out = df.withColumn("__x", x).join(c, "__x", "left").crossJoin(F.broadcast(size))
    return out.withColumn("p_holds", F.col("__below") / F.nullif(F.col("__size"), F.lit(0))).drop("__x", "__below", "__size")

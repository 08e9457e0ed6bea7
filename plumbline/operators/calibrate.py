"""Calibration: bins, expected calibration error, Brier score, tiers, direction.

Every operator takes rows and grouping columns `by`, and returns one row per group (and bin): all clients, arms and
strata in one pass, by two aggregates of which the second reads at most `bins` rows per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.expr import bin_digitize


#: Key of a column's metadata that says that it holds a sharpness, no probability.
SHARPNESS = "sharpness"


def as_sharpness(df: DataFrame, column: str) -> DataFrame:
    """df with a column marked as a sharpness score (how decided an answer is), which calibration refuses to take for a
    probability. The mark stays with the column through selections, joins and new names; a calculation drops it."""
    return df.withMetadata(column, {**df.schema[column].metadata, SHARPNESS: True})


def refuse_sharpness(df: DataFrame, *columns: str) -> None:
    """A TypeError if one of the columns is marked."""
    marked = [f.name for f in df.schema if f.name in columns and f.metadata.get(SHARPNESS)]
    if marked:
        raise TypeError(f"calibration needs probabilities; {', '.join(marked)} holds sharpness scores")


def reliability(df: DataFrame, by: list[str], bin_of: Column, *, conf: str = "conf", correct: str = "correct", weight: Column | None = None) -> DataFrame:
    """n, mean confidence and mean correctness per group and occupied bin."""
    refuse_sharpness(df, conf)
    w = F.lit(1.0) if weight is None else weight
    return df.groupBy(*by, bin_of.alias("bin")).agg(F.sum(w).alias("n"), (F.sum(w * F.col(conf)) / F.sum(w)).alias("mean_conf"), (F.sum(w * F.col(correct)) / F.sum(w)).alias("mean_correct"))


def with_empty_bins(bins_df: DataFrame, by: list[str], bins: int) -> DataFrame:
    """Also the empty bins, with n = 0 and null means."""
    spine = bins_df.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return spine.join(bins_df, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0.0)))


def ece(bins_df: DataFrame, by: list[str]) -> DataFrame:
    """n, ece, mce and the largest bin's share of reliability()'s rows."""
    gap = F.abs(F.col("mean_correct") - F.col("mean_conf"))
    return bins_df.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"), (F.max("n") / F.sum("n")).alias("max_bin_share"))


def uniform_ece(df: DataFrame, by: list[str], bins: int = 10, **columns) -> DataFrame:
    return ece(reliability(df, by, bin_digitize(F.col(columns.get("conf", "conf")), bins), **columns), by)


def quantile_ece(df: DataFrame, by: list[str], bins: int = 10, conf: str = "conf", correct: str = "correct") -> DataFrame:
    """ECE over bins of equal shares: linear quantiles, repeated edges moved up by 1e-12, ends 0 and 1."""
    from plumbline.operators.rank import quantiles

    refuse_sharpness(df, conf)
    step = lambda s, q: F.concat(s, F.array(F.when(q <= F.element_at(s, -1), F.least(F.lit(1.0), F.element_at(s, -1) + 1e-12)).otherwise(q)))
    at = quantiles(df, by, conf, {f"q{i}": i / bins for i in range(bins + 1)}).withColumn("q", F.array(*[F.col(f"q{i}") for i in range(bins + 1)]))
    edges = at.select(*by, F.aggregate(F.slice("q", 2, bins), F.slice("q", 1, 1), step).alias("edges"))
    placed = df.join(edges, by) if by else df.crossJoin(F.broadcast(edges))
    bin_of = F.size(F.filter(F.slice("edges", 2, bins - 1), lambda e: e <= F.col(conf)))
    return ece(reliability(placed, by, bin_of, conf=conf, correct=correct), by)


def brier(df: DataFrame, by: list[str], p: str, label: str) -> DataFrame:
    """Mean summed squared distance of probability arrays from the label's unit vector (label: place from 0)."""
    refuse_sharpness(df, p)
    sq = F.aggregate(F.transform(F.col(p), lambda x, i: F.pow(x - F.when(i == F.col(label), 1.0).otherwise(0.0), 2)), F.lit(0.0), lambda s, x: s + x)
    return df.groupBy(*by).agg(F.avg(sq).alias("brier"))


def brier_binary(df: DataFrame, by: list[str], p: str, label: str) -> DataFrame:
    """Mean squared distance of the probability of 1 from the label."""
    refuse_sharpness(df, p)
    return df.groupBy(*by).agg(F.avg(F.pow(F.col(p) - F.col(label), 2)).alias("brier"))


def both_strategies(df: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """ece and mce by uniform and by quantile bins, one row a strategy."""
    one = uniform_ece(df, by, bins).withColumn("strategy", F.lit("uniform"))
    return one.unionByName(quantile_ece(df, by, bins).withColumn("strategy", F.lit("quantile")))


def matched(made: DataFrame, stamped: DataFrame, by: list[str], tolerance: float = 1e-6) -> DataFrame:
    """ece made anew beside the stamped one, their distance, and whether it is within the tolerance (a missing side is not)."""
    out = made.select(*by, F.col("ece").alias("ece")).join(stamped.select(*by, F.col("ece").alias("stamped")), by, "full_outer")
    out = out.withColumn("distance", F.abs(F.col("ece") - F.col("stamped")))
    return out.withColumn("match", F.coalesce(F.col("distance") <= tolerance, F.lit(False)))


def by_tier(df: DataFrame, tier: str, bins: int = 10, *, p: str | None = None, label: str | None = None) -> DataFrame:
    """Per tier n, accuracy, ece by uniform and by quantile bins, and Brier score (of p and label, where given); and in every
    row the least-squares slope of ece on accuracy (null where undefined)."""
    aggs = [F.avg("correct").alias("accuracy")] + ([F.avg(F.pow(F.col(p) - F.col(label), 2)).alias("brier")] if p and label else [])
    acc = df.groupBy(tier).agg(*aggs)
    tiers = uniform_ece(df, [tier], bins).select(tier, "n", "ece").join(acc, tier).join(quantile_ece(df, [tier], bins).select(tier, F.col("ece").alias("ece_quantile")), tier)
    slope = tiers.agg(F.when(F.max("accuracy") - F.min("accuracy") > 1e-9, F.regr_slope("ece", "accuracy")).alias("slope"))
    return tiers.crossJoin(F.broadcast(slope))  # one row


def direction(df: DataFrame, by: list[str]) -> DataFrame:
    """Mean confidence, mean correctness, and their difference, over- or underconfidence."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg("conf").alias("mean_conf"), F.avg("correct").alias("mean_correct"), (F.avg("conf") - F.avg("correct")).alias("overconfidence"))


def direction_block(df: DataFrame, stratum: str, scorings: dict[str, str], bins: int = 10) -> DataFrame:
    """direction() of each scoring (a name and its column), stratum and bin, of strata over all bins (bin null), and of all rows
    (stratum null too): one aggregate for the whole block."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("scoring"), F.col(c).cast("double").alias("correct")) for k, c in scorings.items()]))
    rows = df.select(stratum, "conf", each.alias("s")).select(stratum, "conf", "s.scoring", "s.correct", bin_digitize(F.col("conf"), bins).alias("bin"))
    sets = [[F.col("scoring"), F.col(stratum), F.col("bin")], [F.col("scoring"), F.col(stratum)], [F.col("scoring")]]
    out = rows.groupingSets(sets, "scoring", stratum, "bin").agg(F.count("*").alias("n"), F.avg("conf").alias("mean_conf"), F.avg("correct").alias("mean_correct"))
    return out.withColumn("overconfidence", F.col("mean_conf") - F.col("mean_correct"))


def bundle(df: DataFrame, by: list[str], *, p: str = "probs", label: str = "label", pred: str = "pred", conf: str = "conf", latency: str = "latency", cost: str = "cost", bins: int = 10) -> DataFrame:
    """Per group, side by side: n, accuracy, macro F1, macro AUROC (classes against the rest, those without a positive or
    a negative left out), ECE, median and 95th percentile of latency (nulls left out), cost, and cost of 1,000 right answers (null without any).
    p: probabilities in the order of labels (places from 0). The rows are written once and read by each measure."""
    from plumbline.operators.agree import macro_f1
    from plumbline.operators.rank import auroc, quantiles
    from plumbline.sources.tables import stored

    refuse_sharpness(df, conf)
    rows = stored(df.select(*by, F.col(p).alias("p"), F.col(label).cast("int").alias("label"), F.col(pred).cast("int").alias("pred"), F.col(conf).cast("double").alias("conf"), F.col(latency).cast("double").alias("latency"), F.col(cost).cast("double").alias("cost")))
    right = (F.col("pred") == F.col("label")).cast("int")
    sums = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum("cost").alias("cost"), F.sum(right).alias("__right"))
    f1 = macro_f1(rows, by, "label", "pred").select(*by, "accuracy", "macro_f1")
    classes = rows.select(*by, "label", F.posexplode("p").alias("k", "x")).withColumn("y", (F.col("k") == F.col("label")).cast("int"))
    area = auroc(classes, [*by, "k"], "x", "y").groupBy(*by).agg(F.avg("auroc").alias("macro_auroc"))
    error = uniform_ece(rows.withColumn("correct", right), by, bins).select(*by, "ece")
    times = quantiles(rows, by, "latency", {"p50": 0.5, "p95": 0.95}).select(*by, "p50", "p95")
    out = sums.join(f1, by).join(area, by, "left").join(error, by).join(times, by, "left")
    return out.withColumn("cost_per_thousand", F.col("cost") * 1000 / F.nullif(F.col("__right"), F.lit(0))).drop("__right")

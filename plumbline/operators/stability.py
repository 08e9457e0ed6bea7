"""Stability of repeated decisions: flips, spread, pairwise divergence, boundary distance, version changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.expr import bin_digitize, jsd_nats, total, tvd
from plumbline.operators.calibrate import ece, reliability

#: Different answers of an item that are compared in one array.
BLOCK = 128


def label_stability(df: DataFrame, by: list[str]) -> DataFrame:
    """Per item: repeats, distinct decisions, the most frequent one (ties: the earliest), its count, and whether it flips."""
    counts = df.groupBy(*by, "decision").agg(F.count("*").alias("n"), F.min("repeat").alias("first"))
    best = F.max_by("decision", F.struct("n", -F.col("first")))
    out = counts.groupBy(*by).agg(F.sum("n").alias("repeats"), F.count("*").alias("distinct_decisions"), best.alias("mode"), F.max("n").alias("mode_count"))
    return out.withColumn("flips", (F.col("distinct_decisions") > 1).cast("int"))


def confidence_stability(df: DataFrame, by: list[str]) -> DataFrame:
    """Per item: mean, sample deviation (0 of one), range, and largest distance from the mean."""
    agg = df.groupBy(*by).agg(F.count("*").alias("repeats"), F.avg("confidence").alias("mean"), F.coalesce(F.stddev_samp("confidence"), F.lit(0.0)).alias("sd"), F.min("confidence").alias("lo"), F.max("confidence").alias("hi"))
    return agg.select(*by, "repeats", "mean", "sd", (F.col("hi") - F.col("lo")).alias("range"), F.greatest(F.col("hi") - F.col("mean"), F.col("mean") - F.col("lo")).alias("max_dev"))


def _summed(rows: str, asked=lambda a, b: F.lit(True)) -> Column:
    """Sums (by the product of counts) and maxima of the pairs in an array of answers that `asked` holds for; one struct an answer."""
    none = F.struct(*[F.lit(0.0).alias(c) for c in ("d", "tv", "max_tv", "js", "max_js")])

    def pair(s: Column, a: Column, b: Column) -> Column:
        w, tv, js = (a["n"] * b["n"]).cast("double"), tvd(a["p"], b["p"]), jsd_nats(a["p"], b["p"])
        more = F.struct((s["d"] + w * (a["decision"] != b["decision"]).cast("double")).alias("d"), (s["tv"] + w * tv).alias("tv"), F.greatest(s["max_tv"], tv).alias("max_tv"), (s["js"] + w * js).alias("js"), F.greatest(s["max_js"], js).alias("max_js"))
        return F.when(asked(a, b), more).otherwise(s)

    return F.transform(rows, lambda a, i: F.aggregate(F.slice(rows, i + 2, F.size(rows)), none, lambda s, b: pair(s, a, b)))


def pairwise(df: DataFrame, by: list[str], p: str, block: int = BLOCK) -> DataFrame:
    """Per item of at least two repeats: share of differing pairs, mean and largest pairwise TV and JS (nats). Equal answers
    (decision and p) are counted first, so an item's pairs are those of its different answers, however often it was asked.
    An item of more than `block` different answers is cut into blocks of about so many by a hash, and each pair of blocks is
    a row of its own: its answers go out once for each block, no pair is ever a row, and no array outgrows two blocks."""
    answer = F.struct("decision", "p", "n")
    item = Window.partitionBy(*by)
    held = df.groupBy(*by, "decision", F.col(p).alias("p")).agg(F.count("*").alias("n"))
    held = held.withColumns({"__answers": F.count("*").over(item), "m": F.sum("n").over(item)})
    few = held.where((F.col("__answers") <= block) & (F.col("m") > 1)).groupBy(*by).agg(F.array_sort(F.collect_list(answer)).alias("r"), F.first("m").alias("m"))
    many = held.where(F.col("__answers") > block).withColumn("__blocks", F.ceil(F.col("__answers") / block).cast("int"))
    many = many.withColumn("block", F.pmod(F.xxhash64("decision", "p"), F.col("__blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    cells = many.groupBy(*by, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).agg(F.array_sort(F.collect_list(F.struct("decision", "p", "n", "block"))).alias("r"), F.first("m").alias("m"))
    across = _summed("r", lambda a, b: (F.col("i") == F.col("j")) | (a["block"] != b["block"]))
    added = lambda f: total(F.transform("x", lambda e: e[f]))
    most = lambda f: F.coalesce(F.array_max(f"x.{f}"), F.lit(0.0))
    sums = lambda rows, x: rows.select(*by, "m", x.alias("x")).select(*by, "m", *[added(f).alias(f) for f in ("d", "tv", "js")], *[most(f).alias(f) for f in ("max_tv", "max_js")])
    joined = sums(cells, across).groupBy(*by, "m").agg(*[F.sum(f).alias(f) for f in ("d", "tv", "js")], *[F.max(f).alias(f) for f in ("max_tv", "max_js")])
    pairs = F.col("m") * (F.col("m") - 1) / 2
    out = sums(few, _summed("r")).unionByName(joined)
    return out.select(*by, pairs.cast("long").alias("pairs"), (F.col("d") / pairs).alias("pair_flip"), (F.col("tv") / pairs).alias("mean_tv"), "max_tv", (F.col("js") / pairs).alias("mean_js"), "max_js")


def flip_rate(items: DataFrame, by: list[str], item: str, **how) -> DataFrame:
    """Share of items that flip, with a 95 % interval over items; items: label_stability()'s rows."""
    from plumbline.operators.resample import bootstrap, mean_of

    return bootstrap(items, by, mean_of("flips"), item, **how)


def compared_flip_rates(items: DataFrame, client: str, a, b, item: str, **how) -> DataFrame:
    """Flip rate of client a less that of b over the items of both, with interval."""
    from plumbline.operators.resample import paired_difference

    return paired_difference(items, item, client, a, b, "flips", **how)


def near_and_far(items: DataFrame, threshold: float, steady: float = 0.05) -> DataFrame:
    """Flip rates of the third of items nearest to the threshold and of the farthest, and whether the boundary explains the flips: more of
    them near, a mean deviation below `steady`, and some flips at all. items: mean, sd, flips."""
    from plumbline.operators.rank import quantiles

    d = items.withColumn("distance", F.abs(F.col("mean") - threshold))
    ends = quantiles(d, [], "distance", {"low": 1 / 3, "high": 2 / 3})
    out = d.crossJoin(F.broadcast(ends.select("low", "high"))).agg(F.avg(F.when(F.col("distance") <= F.col("low"), F.col("flips"))).alias("near"), F.avg(F.when(F.col("distance") >= F.col("high"), F.col("flips"))).alias("far"), F.avg("sd").alias("mean_sd"), F.sum("flips").alias("n_flips"))
    return out.withColumn("explains", (F.col("near") > F.col("far")) & (F.col("mean_sd") < steady) & (F.col("n_flips") > 0))


def boundary(items: DataFrame, threshold: float, bins: int = 10) -> DataFrame:
    """Per bin of distance |mean - threshold| (equal widths up to the largest): items and flip share; in every row the
    slope and correlation of flips on distance."""
    d = items.withColumn("distance", F.abs(F.col("mean") - threshold))
    most = d.agg(F.max("distance").alias("most"), F.regr_slope("flips", "distance").alias("slope"), F.when((F.stddev_pop("distance") > 0) & (F.stddev_pop("flips") > 0), (F.covar_pop("distance", "flips") / F.stddev_pop("distance")) / F.nullif(F.stddev_pop("flips"), F.lit(0.0))).alias("r"))
    d = d.crossJoin(F.broadcast(most)).withColumn("bin", F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col("distance"), F.col("most")) * bins).cast("int")))
    return d.groupBy("bin").agg(F.count("*").alias("items"), F.avg("flips").alias("flip_rate"), F.avg("distance").alias("mean_distance"), F.first("slope").alias("slope"), F.first("r").alias("r"))


def deciles(items: DataFrame, distance: str) -> DataFrame:
    """items with `decile` (0 to 9): how many of the nine linear quantiles between are at or below the distance, at 12 places. An
    edge that isn't above the one before lies 1e-12 above it, so equal distances share a decile and others may stay empty."""
    from plumbline.operators.rank import quantiles

    d = items.withColumn(distance, F.round(distance, 12))
    edges = F.broadcast(quantiles(d, [], distance, {f"__e{i}": i / 10 for i in range(10)}).drop("n"))
    last, above = F.round("__e0", 12), []
    for i in range(1, 10):
        last = F.greatest(F.round(f"__e{i}", 12), last + 1e-12)
        above.append((F.col(distance) >= last).cast("int"))
    return d.crossJoin(edges).withColumn("decile", sum(above[1:], above[0])).drop(*[f"__e{i}" for i in range(10)])


def stability_panel(df: DataFrame, item: str, p: str, threshold: float, values: list[str], model: str, *, replicates: int = 100, seed: int = 1) -> DataFrame:
    """All measures of repeated answers over all items (kind 'all'), by each of an item's values (that of its first repeat; null: the
    key is null), by the models that answered it (kind `model`; sorted, comma-joined) and by decile of its mean confidence's
    distance to the threshold (kind 'decile'): items, most repeats, items that flip, their share with 95 % interval, means over items
    of the confidences' deviation, range and largest deviation, and of mean and largest pairwise TV and JS, and the largest JS.
    An item of one repeat counts as wholly stable. Items are measured once, then one aggregate serves all kinds; an item's
    weights are drawn once for all of them."""
    from plumbline.operators.resample import percentiles, weighted
    from plumbline.sources.tables import stored

    facts = df.groupBy(item).agg(*[F.min_by(v, "repeat").cast("string").alias(v) for v in values], F.array_join(F.sort_array(F.collect_set(F.col(model).cast("string"))), ",").alias(model))
    labels, spread = label_stability(df, [item]), confidence_stability(df, [item]).drop("repeats")
    far = ["mean_tv", "max_tv", "mean_js", "max_js"]
    items = facts.join(labels.select(item, "repeats", "flips"), item).join(spread, item).join(pairwise(df, [item], p).select(item, *far), item, "left")
    items = stored(items.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in far} | {"distance": F.abs(F.col("mean") - threshold)}))
    kinds = [("all", F.lit("")), *[(v, F.col(v)) for v in [*values, model]], ("decile", F.col("decile").cast("string"))]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("key")) for k, v in kinds]))
    placed = stored(deciles(items, "distance"))
    rows = placed.select(item, "repeats", "flips", "sd", "range", "max_dev", *far, each.alias("k")).select("*", "k.*").drop("k")
    mean = lambda c, name: F.avg(c).alias(name)
    out = rows.groupBy("kind", "key").agg(F.count("*").alias("items"), F.max("repeats").alias("repeats"), F.sum("flips").alias("flipped"), mean("sd", "mean_sd"), mean("range", "mean_range"), mean("max_dev", "mean_max_dev"), mean("mean_tv", "mean_tv"), mean("max_tv", "mean_max_tv"), mean("mean_js", "mean_js"), mean("max_js", "mean_max_js"), F.max("max_js").alias("max_js"), mean("flips", "flip_rate"))
    parts = [*values, model, "decile"]
    sums = weighted(placed.select(item, *parts, "flips"), item, replicates, seed).groupBy(*parts, "rep").agg(F.sum(F.col("weight") * F.col("flips")).alias("up"), F.sum("weight").alias("w"))
    reps = sums.select("rep", "up", "w", each.alias("k")).groupBy("k.kind", "k.key", "rep").agg((F.sum("up") / F.sum("w")).alias("s"))
    ci = percentiles(reps, ["kind", "key"], "s", low=0.025, high=0.975).withColumnsRenamed({"kind": "__kind", "key": "__key"})
    return out.join(ci, (F.col("kind") == F.col("__kind")) & F.col("key").eqNullSafe(F.col("__key"))).drop("__kind", "__key")


def version_changes(df: DataFrame, client: str, order: list[str], version: str, slot: str) -> DataFrame:
    """Rows whose version differs from the one before within (client, slot); slot bounds a window's rows."""
    w = Window.partitionBy(client, slot).orderBy(*order)
    return df.withColumn("previous", F.lag(version).over(w)).where(F.col("previous") != F.col(version))


def versions(df: DataFrame, client: str, version: str) -> DataFrame:
    """Per client: its distinct versions in order, and whether there is more than one; for versions of a bounded number."""
    out = df.groupBy(client).agg(F.sort_array(F.collect_set(version)).alias("versions"))
    return out.withColumn("mixed", F.size("versions") > 1)


def reconciled(items: DataFrame, signals: list[str], given: str) -> DataFrame:
    """Per signal: Spearman's correlation with flips, and the partial one given another column."""
    from plumbline.operators.rank import partial_spearman, spearman

    out = None
    for s in signals:
        row = spearman(items, [], "flips", s).crossJoin(F.broadcast(partial_spearman(items, "flips", s, given).select(F.col("rho").alias("partial"))))
        row = row.select(F.lit(s).alias("signal"), "n", "rho", "partial")
        out = row if out is None else out.unionByName(row)
    return out


def by_pass(df: DataFrame, client: str, number: str, bins: int = 10) -> DataFrame:
    """Per client and pass, however many there are: n, accuracy, ece; and in every row of a client its passes, the
    ranges of both, and whether they move materially (accuracy by over 0.05 or ece by over 0.02); null of one pass."""
    binned = reliability(df, [client, number], bin_digitize(F.col("conf"), bins))
    accuracy = binned.groupBy(client, number).agg((F.sum(F.col("n") * F.col("mean_correct")) / F.sum("n")).alias("accuracy"))
    rows = ece(binned, [client, number]).select(client, number, "n", "ece").join(accuracy, [client, number])
    several = lambda c: F.when(F.count("*") > 1, F.max(c) - F.min(c))
    ranges = rows.groupBy(client).agg(F.count("*").alias("passes"), several("accuracy").alias("accuracy_range"), several("ece").alias("ece_range"))
    return rows.join(ranges, client).withColumn("material_move", (F.col("accuracy_range") > 0.05) | (F.col("ece_range") > 0.02))

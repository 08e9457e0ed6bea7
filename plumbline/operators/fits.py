"""Fitted operators: temperatures, stratified folds and cross-validated logistic models.

Losses and gradients are sums over rows. Each task adds them up for all temperatures, or all models, of its rows with numpy and
sends one small row a batch, so a pass over the table serves the whole grid, and no table comes to one task or the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.expr import keyed
from plumbline.sources.tables import stored

LOW, HIGH, POINTS, CLIP = 0.05, 100.0, 200, 1e-12
GRID = (0.01, 0.1, 1.0, 10.0)


def log_losses(df: DataFrame, group: str, p: str, human: str, ts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Of each group: mean cross entropy to the human shares of softmax(log p / T), at each of the group's temperatures."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for name, part in rows.groupby(group):
                t = ts[name]
                x = np.log(np.maximum(np.stack(part[p].to_list()), CLIP))[:, None, :] / t[:, None]
                x = x - x.max(2, keepdims=True)
                log_q = np.maximum(x - np.log(np.exp(x).sum(2, keepdims=True)), np.log(CLIP))
                loss = -(np.stack(part[human].to_list())[:, None, :] * log_q).sum((0, 2))
                yield pd.DataFrame({"g": [name], "n": [len(part)], "loss": [loss.tolist()]})

    rows = df.select(F.col(group).cast("string").alias(group), p, human).where(F.col(group).isin(list(ts)))
    sums = rows.mapInPandas(run, "g string, n long, loss array<double>").select("g", "n", F.posexplode("loss").alias("at", "x"))
    out = {g: np.zeros(len(t)) for g, t in ts.items()}
    for r in sums.groupBy("g", "at").agg((F.sum("x") / F.sum("n")).alias("x")).collect():  # groups x temperatures
        out[r["g"]][r["at"]] = r["x"]
    return out


def temperatures(df: DataFrame, group: str, p: str, human: str, tol: float = 1e-5) -> dict[str, dict[str, float]]:
    """Per group: T of least loss, the loss there, and whether T is at an end of the range. A grid of POINTS in geometric steps, then grids
    between the best point's neighbours until they are closer than `tol`: each step one pass for all groups."""
    names = [str(r[0]) for r in df.select(group).distinct().collect()]
    whole = np.geomspace(LOW, HIGH, POINTS)
    ts, out = {g: whole for g in names}, {}
    while ts:
        losses = log_losses(df, group, p, human, ts)
        nearer = {}
        for g, t in ts.items():
            at = int(np.argmin(losses[g]))
            low, high = t[max(0, at - 1)], t[min(len(t) - 1, at + 1)]
            ends = {"at_low": bool(t[at] <= LOW), "at_high": bool(t[at] >= HIGH)}
            out[g] = {"t": float(t[at]), "loss": float(losses[g][at])} | ends
            if high - low > tol:
                nearer[g] = np.linspace(low, high, 41)
        ts = nearer
    return out


def folds(df: DataFrame, keys: list[str], item: str, k: int, seed: int, name: str = "fold") -> DataFrame:
    """df with a fold from 0 to k - 1: within each stratum rows are dealt in turn, by keyed draws (ties by item)."""
    order = Window.partitionBy(*keys).orderBy(keyed(F.lit(seed), F.col(item)), item)
    return df.withColumn(name, F.pmod(F.row_number().over(order) - 1, F.lit(k)))


def most_folds(df: DataFrame, keys: list[str], k: int) -> int:
    """k, or the size of the smallest stratum if that is less."""
    least = df.groupBy(*keys).count().agg(F.min("count")).first()[0] or 0
    return int(min(k, least))


def temperature_cv(df: DataFrame, stratum: str, item: str, p: str, human: str, *, seed: int = 1) -> tuple[DataFrame, dict[str, dict[str, float]]]:
    """df with fold, t and q: each row's probabilities at the temperature fitted to the other of two stratified folds;
    and the fits by stratum and fold."""
    from plumbline.functions.expr import tempered

    rows = stored(folds(df, [stratum], item, 2, seed).withColumn("__g", F.concat_ws("|", F.col(stratum).cast("string"), (1 - F.col("fold")).cast("string"))))
    fits = temperatures(rows.withColumn("__fit", F.concat_ws("|", F.col(stratum).cast("string"), F.col("fold").cast("string"))), "__fit", p, human)
    table = df.sparkSession.createDataFrame([(g, x["t"]) for g, x in fits.items()], "__g string, t double")
    return rows.join(F.broadcast(table), "__g").withColumn("q", tempered(F.col(p), F.col("t"))).drop("__g"), fits


def features(signals: Column, names: list[str]) -> Column:
    """A map's values in order of names, missing ones 0."""
    return F.array(*[F.coalesce(F.try_element_at(signals, F.lit(n)), F.lit(0.0)) for n in names])


def parts(model: dict, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Which rows a model learns from, and which of its training part its inner fold leaves out. outer: a fold it never sees; below:
    the draws it sees; quota: how many ranks of each cell it sees; splits: inner folds by rank, else those of column inner."""
    use = np.ones(len(rows), bool) if model.get("outer") is None else rows["outer"].to_numpy() != model["outer"]
    if model.get("below") is not None:
        use &= rows["draw"].to_numpy() < model["below"]
    if model.get("quota") is not None:
        use &= rows["rank"].to_numpy() < model["quota"][rows["cell"].to_numpy()]
    if model.get("inner") is None:
        return use, np.zeros(len(rows), bool)
    inner = (rows["rank"] + rows["outer"]) % model["splits"] if "splits" in model else rows["inner"]
    left = inner.to_numpy() == model["inner"]
    return use & ~left, use & left


def seen(df: DataFrame) -> DataFrame:
    return df.select("x", "y", "outer", *[c for c in ("inner", "draw", "cell", "rank") if c in df.columns])


def _sums(df: DataFrame, models: list[dict], weights: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients, Hessians and numbers of rows of softmax models over the rows that each trains on, in one pass; a task sends one
    row a model."""
    d = weights.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, counts = np.zeros((len(models), classes * d + (classes * d) ** 2)), np.zeros(len(models), np.int64)
        for rows in batches:
            if rows.empty:
                continue
            x, y = np.hstack([np.stack(rows["x"].to_list()), np.ones((len(rows), 1))]), rows["y"].to_numpy()
            for m, model in enumerate(models):
                use, _ = parts(model, rows)
                z, t = x[use], y[use]
                if not len(z):
                    continue
                s = z @ weights[m]
                q = np.exp(s - s.max(1, keepdims=True))
                q /= q.sum(1, keepdims=True)
                grad = z.T @ (q - (t[:, None] == np.arange(classes)))
                hess = np.zeros((classes, d, classes, d))
                for a in range(classes):
                    for b in range(a, classes):
                        block = (z * (q[:, a] * ((a == b) - q[:, b]))[:, None]).T @ z
                        hess[a, :, b], hess[b, :, a] = block, block.T
                sums[m] += np.concatenate([grad.T.ravel(), hess.ravel()])
                counts[m] += len(z)
        for m in np.flatnonzero(counts):
            yield pd.DataFrame({"m": [m], "n": [counts[m]], "g": [sums[m].tolist()]})

    rows = seen(df).mapInPandas(run, "m int, n long, g array<double>").select("m", "n", F.posexplode("g").alias("at", "v"))
    size = classes * d
    out, n = np.zeros((len(models), size + size * size)), np.zeros(len(models))
    for r in rows.groupBy("m", "at").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect():  # models x parameters
        out[r["m"], r["at"]], n[r["m"]] = r["v"], r["n"]
    return out[:, :size], out[:, size:].reshape(-1, size, size), n


def softmax_models(df: DataFrame, models: list[dict], classes: int, *, rounds: int = 8) -> np.ndarray:
    """Weights (model, feature and intercept, class) by Newton's method, all models in each pass over df (x, y, outer, inner,
    draw, or cell and rank in place of the last two), each from the rows that parts() gives it; c: inverse strength of the penalty on
    all weights but intercepts."""
    d = len(df.select("x").first()[0]) + 1
    w = np.zeros((len(models), d, classes))
    free = np.tile(np.append(np.ones(d - 1), 1e-8), classes)
    for _ in range(rounds):
        grad, hess, n = _sums(df, models, w, classes)
        moved = 0.0
        for m, model in enumerate(models):
            if n[m]:
                flat = w[m].T.ravel()
                step = np.linalg.solve(hess[m] + np.diag(free / model["c"] + 1e-9), grad[m] + free / model["c"] * flat)
                step *= min(1.0, 5 / max(1e-12, np.abs(step).max()))
                w[m] -= step.reshape(classes, d).T
                moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-6:
            break
    return w


def accuracies(df: DataFrame, models: list[dict], weights: np.ndarray) -> dict[int, float]:
    """Of each model the share of rows that it labels rightly in its inner fold; models whose fold is empty are left out. A task sends
    two counts a model."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, right = np.zeros(len(models), np.int64), np.zeros(len(models), np.int64)
        for rows in batches:
            if rows.empty:
                continue
            x, y = np.hstack([np.stack(rows["x"].to_list()), np.ones((len(rows), 1))]), rows["y"].to_numpy()
            for m, model in enumerate(models):
                _, left = parts(model, rows)
                n[m] += left.sum()
                right[m] += ((x[left] @ weights[m]).argmax(1) == y[left]).sum()
        yield pd.DataFrame({"m": np.arange(len(models)), "n": n, "right": right})

    sums = seen(df).mapInPandas(run, "m int, n long, right long").groupBy("m").agg(F.sum("n").alias("n"), F.sum("right").alias("right")).where("n > 0")
    return {r["m"]: r["right"] / r["n"] for r in sums.collect()}


def predicted(df: DataFrame, models: list[dict], weights: np.ndarray) -> DataFrame:
    """(size, fold, item, y, pred, p): each row by the models whose outer fold it is in; a model with `only` always answers that class."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if rows.empty:
                continue
            x = np.hstack([np.stack(rows["x"].to_list()), np.ones((len(rows), 1))])
            for m, model in enumerate(models):
                held = (rows["outer"] == model["outer"]).to_numpy()
                if held.any():
                    s = x[held] @ weights[m]
                    q = np.exp(s - s.max(1, keepdims=True))
                    q /= q.sum(1, keepdims=True)
                    if model.get("only") is not None:
                        q = np.tile(np.arange(weights.shape[2]) == model["only"], (len(q), 1)).astype(float)
                    out = pd.DataFrame({"fold": model["outer"], "item": rows["item"][held], "y": rows["y"][held], "pred": q.argmax(1), "p": q.tolist()})
                    out.insert(0, "size", pd.array([model.get("size")] * len(out), "Int64"))
                    yield out

    return df.mapInPandas(run, "size long, fold int, item string, y int, pred int, p array<double>")


def dealt(sizes: dict, n: int) -> dict:
    """n dealt in turn over the keys in order, none getting more than its size."""
    given, left = dict.fromkeys(sizes, 0), min(n, sum(sizes.values()))
    while left:
        free = [k for k in sorted(sizes) if given[k] < sizes[k]]
        step = max(1, min(left // len(free), min(sizes[k] - given[k] for k in free)))
        for k in free[:left]:
            given[k] += step
            left -= step
    return given


def training_part(cells: list[tuple], outer: int, size: int | None) -> np.ndarray:
    """How many rows of each cell (tier, label, fold, rows) train where fold `outer` is held out: all, or `size` of them dealt in turn
    over strata of tier and label, and a stratum's over its folds."""
    own: dict[tuple, dict[int, int]] = {}
    for i, (tier, y, fold, n) in enumerate(cells):
        if fold != outer:
            own.setdefault((tier, y), {})[i] = n
    whole = {s: sum(c.values()) for s, c in own.items()}
    share = dealt(whole, sum(whole.values()) if size is None else size)
    quota = np.zeros(len(cells), np.int64)
    for s, c in own.items():
        for i, n in dealt(c, share[s]).items():
            quota[i] = n
    return quota


def nested_fits(df: DataFrame, item: str, x: str, y: str, tier: str, classes: int, *, outer: int = 5, inner: int = 3, grid: tuple[float, ...] = GRID, seed: int = 1, sizes: tuple[int | None, ...] = (None,)) -> tuple[DataFrame, list[dict]]:
    """Nested cross-validation at several numbers of training labels (None: all), all models of all sizes in each pass over the rows.
    Returns (size, fold, item, y, pred, p) of held-out rows, and of each size and fold n_train, n_test, c and only.

    Folds are stratified by tier and label, as many as the smallest stratum allows; if that is fewer than two, ValueError. C is that
    of most mean accuracy over inner folds, the smallest of equal ones; inner folds whose training rows are all of one label don't
    count, and C is 1 where none counts or a stratum of the training part has one row. A training part of one label answers that
    label always (only). Rows without label are left out. Only counts by stratum and fold, and sums by model, reach the driver."""
    keys = ["__tier", "y"]
    rows = df.select(F.col(item).cast("string").alias("item"), F.col(x).alias("x"), F.col(y).cast("int").alias("y"), F.coalesce(F.col(tier).cast("string"), F.lit("")).alias("__tier")).where("y is not null")
    k = most_folds(rows, keys, outer)
    if k < 2:
        raise ValueError(f"no two folds: the smallest stratum of tier and label has {k} rows")
    rank = Window.partitionBy(*keys, "outer").orderBy(keyed(F.lit(seed + 1), F.col("item")), "item")
    rows = folds(rows, keys, "item", k, seed, "outer").withColumn("rank", F.row_number().over(rank) - 1)
    rows = stored(rows.withColumn("outer", F.col("outer").cast("int")))
    cells = sorted((r["__tier"], r["y"], r["outer"], r["count"]) for r in rows.groupBy(*keys, "outer").count().collect())
    table = df.sparkSession.createDataFrame([(*c[:3], i) for i, c in enumerate(cells)], "__tier string, y int, outer int, cell int")
    rows = stored(rows.join(F.broadcast(table), [*keys, "outer"]).select("item", "x", "y", "outer", "rank", "cell"))

    final, trials = [], []
    for size in sizes:
        for o in range(k):
            quota = training_part(cells, o, size)
            strata: dict[tuple, int] = {}
            for (t, label, _, _), q in zip(cells, quota.tolist(), strict=True):
                if q:
                    strata[t, label] = strata.get((t, label), 0) + q
            labels = {label for _, label in strata}
            splits = min(inner, min(strata.values(), default=0))
            final.append({"size": size, "outer": o, "quota": quota, "c": 1.0, "only": min(labels) if len(labels) == 1 else None, "n_train": int(quota.sum()), "n_test": sum(c[3] for c in cells if c[2] == o)})
            for i in range(splits if splits > 1 else 0):
                left = {c[1] for c, q in zip(cells, quota.tolist(), strict=True) if q > len(range((i - c[2]) % splits, q, splits))}
                if len(left) > 1:
                    trials += [{"of": len(final) - 1, "outer": o, "quota": quota, "inner": i, "splits": splits, "c": c} for c in sorted(grid)]
    found = accuracies(rows, trials, softmax_models(rows, trials, classes)) if trials else {}
    scores: dict[int, dict[float, list[float]]] = {}
    for m, a in found.items():
        scores.setdefault(trials[m]["of"], {}).setdefault(trials[m]["c"], []).append(a)
    for at, by in scores.items():
        final[at]["c"] = max(sorted(by), key=lambda c, by=by: round(sum(by[c]) / len(by[c]), 12))
    learned = [m for m, f in enumerate(final) if f["only"] is None]
    weights = np.zeros((len(final), len(rows.select("x").first()[0]) + 1, classes))
    if learned:
        weights[learned] = softmax_models(rows, [final[m] for m in learned], classes)
    return predicted(rows, final, weights), [{"size": f["size"], "fold": f["outer"]} | {c: f[c] for c in ("n_train", "n_test", "c", "only")} for f in final]


def nested_cv(df: DataFrame, item: str, x: str, y: str, tier: str, classes: int, **how) -> tuple[DataFrame, dict[int, float]]:
    """(fold, item, y, pred, p) of rows by the model of the other outer folds, and the C chosen in each, as nested_fits() has them."""
    got, fits = nested_fits(df, item, x, y, tier, classes, **how)
    return got.drop("size"), {f["fold"]: f["c"] for f in fits}


def fold_scores(predictions: DataFrame, bins: int = 10) -> DataFrame:
    """Per size: folds, mean and sample deviation of their accuracies (0 of one fold), and ECE of all held-out answers."""
    from plumbline.functions.expr import bin_digitize
    from plumbline.operators.calibrate import ece, reliability

    rows = predictions.select("size", "fold", F.array_max("p").alias("conf"), (F.col("pred") == F.col("y")).cast("int").alias("correct"))
    by_fold = rows.groupBy("size", "fold").agg(F.avg("correct").alias("a"))
    means = by_fold.groupBy("size").agg(F.count("*").alias("folds"), F.avg("a").alias("accuracy_mean"), F.coalesce(F.stddev_samp("a"), F.lit(0.0)).alias("accuracy_sd"))
    e = ece(reliability(rows, ["size"], bin_digitize(F.col("conf"), bins)), ["size"]).select(F.col("size").alias("__size"), "ece")
    return means.join(e, F.col("size").eqNullSafe(F.col("__size"))).drop("__size")


def label_sweep(df: DataFrame, item: str, x: str, y: str, tier: str, classes: int, sizes: tuple[int, ...], **how) -> DataFrame:
    """Per number of labels learned from: skipped (with reason: more than there are rows, or no two folds), n_train (the least of its
    folds), and fold_scores() out of fold. All sizes are fitted together."""
    spark, n = df.sparkSession, df.where(F.col(y).isNotNull()).count()
    fit, why = [s for s in sorted(set(sizes)) if s <= n], {s: f"more than {n} rows" for s in sizes if s > n}
    try:
        got, fits = nested_fits(df, item, x, y, tier, classes, sizes=tuple(fit), **how) if fit else (None, [])
    except ValueError as e:
        got, fits, why = None, [], why | dict.fromkeys(fit, str(e))
    least = {s: min(f["n_train"] for f in fits if f["size"] == s) for s in {f["size"] for f in fits}}
    table = spark.createDataFrame([(s, s in why, why.get(s), least.get(s)) for s in sorted(set(sizes))], "labels long, skipped boolean, reason string, n_train long")
    scores = fold_scores(got) if got is not None else spark.createDataFrame([], "size long, folds long, accuracy_mean double, accuracy_sd double, ece double")
    return table.join(scores.withColumnRenamed("size", "labels"), "labels", "left")

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import expr as X
from plumbline.operators import fixed, rank, rankboot, resample

N = 1500


@pytest.fixture(scope="module")
def data():
    """Ties, and one value on either side that a third of the rows hold."""
    rng = np.random.default_rng(0)
    x = np.where(rng.random(N) < 0.35, 0.5, rng.normal(size=N).round(2))
    z = np.where(rng.random(N) < 0.3, 1.0, x + rng.normal(size=N))
    return pd.DataFrame({"item": np.arange(N), "x": x, "z": z, "y": (rng.random(N) < 1 / (1 + np.exp(-x))).astype(int)})


@pytest.fixture
def small_cells(monkeypatch):
    monkeypatch.setattr(rankboot, "ROWS", 100)
    monkeypatch.setattr(rankboot, "SALTS", 3)


def all_weights(items, replicates):
    return np.vstack([rankboot.weights([str(i) for i in items], first, n, 1) for first, n in rankboot.blocks(replicates)])


def ranks(v, w):
    _, at = np.unique(v, return_inverse=True)
    tied = np.bincount(at, w)
    return (np.cumsum(tied) - tied + (tied + 1) / 2)[at]


def rho(a, b, w):
    a, b = ranks(a, w), ranks(b, w)
    a, b = a - (w * a).sum() / w.sum(), b - (w * b).sum() / w.sum()
    return (w * a * b).sum() / np.sqrt((w * a * a).sum() * (w * b * b).sum())


def area(x, y, w):
    _, at = np.unique(x, return_inverse=True)
    pos, neg = np.bincount(at, w * y), np.bincount(at, w * (1 - y))
    return (pos * (np.cumsum(neg) - neg / 2)).sum() / (pos.sum() * neg.sum())


def test_weights_are_the_draws_of_the_columns(spark):
    items = [f"i{k}" for k in range(50)]
    rows = resample.weighted(spark.createDataFrame([(i,) for i in items], "item string"), "item", 70, 1).collect()
    want = np.zeros((70, 50))
    for r in rows:
        want[r.rep, items.index(r.item)] = r.weight
    assert (all_weights(items, 70) == want).all()


def test_areas_and_correlations_of_every_replicate(spark, data, small_cells):
    df, w = spark.createDataFrame(data).repartition(5), all_weights(data["item"], 70)
    got = [r.value for r in rankboot.auroc_replicates(df, "x", "y", "item", replicates=70).orderBy("rep").collect()]
    assert np.allclose(got, [area(data["x"], data["y"], v) for v in w], rtol=1e-12)
    got = [r.value for r in rankboot.spearman_replicates(df, "x", "z", "item", replicates=70).orderBy("rep").collect()]
    assert np.allclose(got, [rho(data["x"], data["z"], v) for v in w], rtol=1e-10)


def test_intervals_of_differences_are_paired(spark, data, small_cells):
    df, w = spark.createDataFrame(data).repartition(3), all_weights(data["item"], 100)
    row = rankboot.difference(df, "spearman", "x", "y", "z", "item").first()
    d = [rho(data["x"], data["z"], v) - rho(data["y"], data["z"], v) for v in w]
    assert np.allclose([row.low, row.high], np.quantile(d, [0.025, 0.975]), rtol=1e-9) and row.replicates == 100
    assert np.isclose(row.point, rho(data["x"], data["z"], np.ones(N)) - rho(data["y"], data["z"], np.ones(N))) and not row.crosses_zero


def test_rows_shuffled_do_not_grow_with_replicates(spark, data):
    df = spark.createDataFrame(data)
    for n in (8, 800):
        plan = rankboot.auroc_replicates(df, "x", "y", "item", replicates=n)._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan  # no row becomes several


def test_nulls_one_class_and_no_rows(spark):
    rows = spark.createDataFrame([(1, 0.5, 1), (2, None, 0), (None, 0.1, 0), (3, 0.7, 1)], "item int, x double, y int")
    assert {r.value for r in rankboot.auroc_replicates(rows, "x", "y", "item").collect()} == {None}
    assert rankboot.auroc_replicates(rows.limit(0), "x", "y", "item").count() == 0
    flat = spark.createDataFrame([(i, 1.0, float(i)) for i in range(9)], "item int, x double, y double")
    assert {r.value for r in rankboot.spearman_replicates(flat, "x", "y", "item").collect()} == {None}


def test_fixed_n_counts_add_up_and_do_not_depend_on_partitions(spark):
    n = 1200
    rows = pd.DataFrame({"item": [f"i{i}" if i > 500 else "hot" for i in range(n)], "s": np.where(np.arange(n) % 3 == 0, "a", "b"), "b": np.arange(n) % 4, "v": np.arange(n) * 1.0})
    df = spark.createDataFrame(rows)
    draw = lambda d: fixed.replicate_sums(d, ["s"], "item", ["v"], ["b"], replicates=40, leaf=40).toPandas().sort_values(["s", "rep", "b"]).reset_index(drop=True)
    got = draw(df)
    assert got.equals(draw(df.repartition(7)))
    sizes = got.groupby(["s", "rep"])["n"].sum().unstack("s")
    assert set(sizes["a"]) == {400} and set(sizes["b"]) == {800} and len(sizes) == 40
    # Means over replicates spread as means of n draws do.
    means = got.groupby(["s", "rep"])[["v", "n"]].sum().eval("v / n").unstack("s")
    for s, values in rows.groupby("s")["v"]:
        error = values.std() / np.sqrt(len(values))
        assert abs(means[s].mean() - values.mean()) < 4 * error / np.sqrt(40) and 0.6 < means[s].std() / error < 1.5


def test_each_row_is_drawn_as_multinomial_counts_are(spark):
    df = spark.createDataFrame([(f"i{i}", float(i), i) for i in range(60)], "item string, v double, b int")
    reps = fixed.replicate_sums(df, [], "item", ["v"], ["b"], replicates=400, leaf=8).toPandas()
    counts = reps.pivot_table(index="rep", columns="b", values="n", fill_value=0).to_numpy()
    assert (counts.sum(1) == 60).all() and counts.shape == (400, 60)
    # Over 24,000 counts: mean 1, variance 1 - 1/60, covariance of different rows -1/60.
    cov = np.cov(counts.T)
    assert abs(np.diag(cov).mean() - 59 / 60) < 0.05 and abs((cov.sum() - np.trace(cov)) / (60 * 59) + 1 / 60) < 0.004
    assert np.abs(counts.mean(0) - 1).max() < 0.25


def test_tree_splits_alone_and_empty_leaves():
    counts = np.array([0, 5, 0, 0, 90, 5, 0])
    d = fixed.tree_draws(counts, 200, [1])
    assert d.shape == (7, 200) and (d.sum(0) == 100).all() and not d[[0, 2, 3, 6]].any() and abs(d[4].mean() - 90) < 1
    assert (fixed.tree_draws(np.array([7]), 3, [1]) == 7).all()


def tails(t, v):
    """By the density's integral."""
    x = np.linspace(-abs(t), abs(t), 200_001)
    y = np.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / np.sqrt(v * np.pi) * (1 + x * x / v) ** (-(v + 1) / 2)
    return float(1 - (y[1:] + y[:-1]).sum() / 2 * (x[1] - x[0]))


def test_tails_of_t(spark):
    known = [(1.0, 1, 0.5), (0.0, 5, 1.0), (2.0, 2, 1 - 2 / math.sqrt(6)), (-2.0, 2, 1 - 2 / math.sqrt(6)), (1.959963984540054, 10**9, 0.05), (2.5758293035489, 10**9, 0.01)]
    known += [(t, v, tails(t, v)) for t in (0.05, 0.7, 1.9623, 3.3, 6.0) for v in (2, 3, 10, 37, 1000, 20_000)]
    df = spark.createDataFrame([(float(t), float(v), float(p)) for t, v, p in known], "t double, v double, p double")
    for r in df.select("p", "v", X.t_tails(F.col("t"), F.col("v")).alias("got")).collect():
        assert abs(r.got - r.p) < (1e-9 if r.v < 10**6 else 1e-8), r


def test_rank_matrix_with_nulls_repeats_and_perfect_pairs(spark):
    rows = [(i, float(i), float(-i), float(i % 3)) for i in range(20)] + [(5, 5.0, -5.0, 2.0)] * 3 + [(99, None, 1.0, 1.0)]
    out = {(r.a, r.b): r for r in rank.rank_matrix(spark.createDataFrame(rows, "item int, a double, b double, c double"), "item", ["a", "b", "c"]).collect()}
    data = np.array([r[1:] for r in rows[:-1]])
    assert set(out) == {("a", "b"), ("a", "c"), ("b", "c")} and {r.n for r in out.values()} == {23}
    assert out["a", "b"].rho == -1 and out["a", "b"].p == 0
    assert np.isclose(out["a", "c"].rho, rho(data[:, 0], data[:, 2], np.ones(23)))
    few = rank.rank_matrix(spark.createDataFrame(rows[:3], "item int, a double, b double, c double"), "item", ["a", "b"]).first()
    assert few.n == 3 and few.p is None
    assert rank.rank_matrix(spark.createDataFrame([], "item int, a double, b double"), "item", ["a", "b"]).count() == 0


def test_p_holds_without_an_array(spark):
    rng = np.random.default_rng(2)
    ref = rng.normal(size=5000).round(2)
    values = [None, -9.0, 9.0, *rng.normal(size=300).round(2)]
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "i int, x double")
    reference = spark.createDataFrame([(float(d),) for d in ref] + [(None,)], "d double")
    got = {r.i: r.p_holds for r in resample.p_holds(df, reference, "x").collect()}
    for i, v in enumerate(values):
        assert got[i] is None if v is None else abs(got[i] - (ref <= v).mean()) < 1e-12
    assert {r.p_holds for r in resample.p_holds(df, reference.limit(0), "x").collect()} == {None}

"""Strata and pools, sharpness marks, BCa of paired differences, and the bundle, on tables that SQL doesn't reach."""

import hashlib
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import expr as X
from plumbline.operators import calibrate, resample


def test_strata_by_linear_quantiles(spark):
    values = [0.1, 0.2, 0.2, 0.4, 0.7, 0.9, None]
    got = {r["i"]: r["stratum"] for r in resample.strata(spark.createDataFrame(list(enumerate(values)), "i int, v double"), "v").collect()}
    low, high = np.quantile([v for v in values if v is not None], [0.25, 0.75])
    assert got == {i: None if v is None else "easy" if v <= low else "hard" if v >= high else "mid" for i, v in enumerate(values)}


@pytest.mark.parametrize("values", [[0.5] * 8, [0.1], [None, None], []])
def test_degenerate_quantiles_raise(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    with pytest.raises(Exception, match="degenerate quantiles"):
        resample.strata(df, "v").collect()


def test_pools_of_a_target(spark):
    df = spark.range(100).select("id", (F.col("id") / 100).alias("v"))
    rows = resample.balanced(df, "v", "id", 10, 3).collect()
    for stratum in ("easy", "hard"):
        pool = [r for r in rows if r["stratum"] == stratum]
        assert len(pool) == 25 == pool[0]["pool"] and sum(r["analysis"] for r in pool) == 10
    again = resample.balanced(df.repartition(3), "v", "id", 10, 3).where("analysis").select("id").collect()
    assert sorted(r[0] for r in again) == sorted(r["id"] for r in rows if r["analysis"])
    with pytest.raises(Exception, match="can't supply 26"):
        resample.balanced(df, "v", "id", 26, 3).collect()


def test_sharpness_is_no_probability(spark):
    df = spark.createDataFrame([("a", 0.9, 1, [0.1, 0.9])], "g string, conf double, correct int, p array<double>")
    marked = calibrate.as_sharpness(df, "conf")
    for work in (lambda d: calibrate.uniform_ece(d, ["g"]), lambda d: calibrate.quantile_ece(d, ["g"]), lambda d: calibrate.brier_binary(d, [], "conf", "correct")):
        work(df)
        with pytest.raises(TypeError, match="sharpness"):
            work(marked)
    with pytest.raises(TypeError, match="sharpness"):
        calibrate.uniform_ece(marked.withColumnRenamed("conf", "c").where("c > 0").join(df.select("g"), "g"), ["g"], conf="c")
    with pytest.raises(TypeError, match="sharpness"):
        calibrate.brier(calibrate.as_sharpness(df, "p"), [], "p", "correct")
    assert calibrate.uniform_ece(marked.withColumn("conf", F.col("conf") * 1.0), ["g"]).first()["n"] == 1


def test_paired_bca_against_numpy(spark):
    rng = np.random.default_rng(4)
    data = [(i, m, float(rng.beta(4, 2 + m)), int(rng.random() < 0.6)) for i in range(40) for m in (0, 1)]
    df = spark.createDataFrame([*data, (99, 0, 0.5, 1)], "item int, model int, conf double, correct int")
    out = resample.paired_delta_ece_bca(df, "item", "model", 0, 1, replicates=200).first()

    def delta(weights):
        ece = []
        for m in (0, 1):
            bins = {}
            for i, of, c, y in data:
                if of == m and weights[i]:
                    b = bins.setdefault(sum(e <= c for e in [k * 0.1 for k in range(1, 10)]), [0, 0])
                    b[0] += weights[i]
                    b[1] += weights[i] * (y - c)
            ece.append(sum(abs(g) for _, g in bins.values()) / sum(n for n, _ in bins.values()))
        return ece[0] - ece[1]

    digits = lambda rep, i: hashlib.md5(f"1:{rep // 4}:{i}".encode()).hexdigest()[8 * (rep % 4) : 8 * (rep % 4) + 8]
    reps = np.array([delta([sum(c <= int(digits(rep, i), 16) / 2**32 for c in X.POISSON) for i in range(40)]) for rep in range(200)])
    jack = np.array([delta([int(i != j) for i in range(40)]) for j in range(40)])
    point, d, phi = delta([1] * 40), jack.mean() - jack, NormalDist()
    a = (d**3).sum() / (6 * (d**2).sum() ** 1.5)
    z0 = phi.inv_cdf(min(200 / 201, max(1 / 201, (reps < point).mean())))
    ends = [np.quantile(reps, phi.cdf(z0 + (z0 + z) / (1 - a * (z0 + z)))) for z in (phi.inv_cdf(0.025), phi.inv_cdf(0.975))]
    assert np.allclose([out["point"], out["a"], out["z0"], out["low"], out["high"]], [point, a, z0, *ends], atol=1e-6)


def test_bundle_of_odd_groups(spark):
    """A group that is never right has no cost per right answer; one of a single class has no area; null latencies are left out."""
    rows = [("never", [0.9, 0.1], 1, 0, 0.9, 10.0, 1.0), ("never", [0.8, 0.2], 0, 1, 0.8, None, 1.0), ("single", [0.7, 0.3], 0, 0, 0.7, None, 2.0)]
    df = spark.createDataFrame(rows, "g string, probs array<double>, label int, pred int, conf double, latency double, cost double")
    got = {r["g"]: r for r in calibrate.bundle(df, ["g"]).collect()}
    assert set(got) == {"never", "single"}
    assert got["never"]["cost_per_thousand"] is None and got["never"]["p50"] == 10 and got["never"]["accuracy"] == 0
    assert got["single"]["macro_auroc"] is None and got["single"]["p50"] is None and got["single"]["cost_per_thousand"] == 2000

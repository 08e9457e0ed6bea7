"""Operators whose results SQL can't give, and those that fail on purpose."""

import datetime
import json
import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import expr as X
from plumbline.operators import fits, records, resample
from plumbline.sources import files, jsonl
from plumbline.streaming import monitor


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = []
    for i in range(120):
        conf = round(rng.uniform(0.4, 1.0), 2)
        data.append((i, "hard" if i % 2 else "easy", conf, float(rng.random() < conf - 0.2 * (i % 2))))
    return data, spark.createDataFrame(data, "item long, stratum string, conf double, correct double")


def plain_ece(data, weights):
    bins = {}
    for (_, _, conf, correct), w in zip(data, weights, strict=True):
        b = sum(e <= conf for e in X.uniform_edges(10))
        n, c, r = bins.get(b, (0, 0.0, 0.0))
        bins[b] = (n + w, c + w * conf, r + w * correct)
    n = sum(b[0] for b in bins.values())
    return sum(abs(c - r) for _, c, r in bins.values()) / n


def plain_delta(data, weights):
    side = lambda s: [(r, w) for r, w in zip(data, weights, strict=True) if r[1] == s]
    return plain_ece(*zip(*side("hard"), strict=True)) - plain_ece(*zip(*side("easy"), strict=True))


def test_bca_against_numpy(spark, rows):
    import hashlib

    data, df = rows
    out = resample.delta_ece_bca(df, "stratum", "hard", "easy", X.bin_digitize(F.col("conf"), 10), "item", replicates=200).first()
    reps = []
    for rep in range(200):
        w = []
        for r in data:
            h = hashlib.md5(f"1:{rep // 4}:{r[0]}".encode()).hexdigest()[8 * (rep % 4) : 8 * (rep % 4) + 8]
            w.append(sum(c <= int(h, 16) / 2**32 for c in X.POISSON))
        reps.append(plain_delta(data, w))
    reps, point = np.array(reps), plain_delta(data, [1] * len(data))
    jack = np.array([plain_delta(data[:i] + data[i + 1 :], [1] * (len(data) - 1)) for i in range(len(data))])
    d, phi = jack.mean() - jack, NormalDist()
    a = (d**3).sum() / (6 * (d**2).sum() ** 1.5)
    z0 = phi.inv_cdf(min(200 / 201, max(1 / 201, (reps < point).mean())))
    ends = [np.quantile(reps, phi.cdf(z0 + (z0 + z) / (1 - a * (z0 + z)))) for z in (phi.inv_cdf(0.025), phi.inv_cdf(0.975))]
    assert np.allclose([out["point"], out["a"], out["z0"], out["low"], out["high"]], [point, a, z0, *ends], atol=1e-6)


def test_normal_and_chi_square_approximations(spark):
    xs = [-4.0, -1.5, -0.1, 0.0, 0.3, 2.0, 5.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(X.normal_cdf(F.col("x")), X.normal_quantile(X.normal_cdf(F.col("x"))), X.chi2_tail(F.col("x"))).collect()
    for x, (cdf, back, tail) in zip(xs, got, strict=True):
        assert abs(cdf - NormalDist().cdf(x)) < 2e-7 and abs(back - x) < 1e-2 and abs(tail - math.erfc(math.sqrt(max(0, x) / 2))) < 2e-7


def test_expected_ece_is_as_simulated_and_free_of_partitions(spark, rows):
    data, df = rows
    one = {r["stratum"]: r["expected_ece"] for r in resample.expected_ece(df, ["stratum"], sims=200).collect()}
    two = {r["stratum"]: r["expected_ece"] for r in resample.expected_ece(df.repartition(7), ["stratum"], sims=200).collect()}
    assert one == pytest.approx(two, abs=1e-12)
    rng, want = np.random.default_rng(0), {}
    for s in ("hard", "easy"):
        p = np.array([r[2] for r in data if r[1] == s])
        eces = []
        for _ in range(400):
            right = rng.binomial(100, rng.beta(20 * np.clip(p, 1e-4, 1 - 1e-4), 20 * (1 - np.clip(p, 1e-4, 1 - 1e-4)))) / 100
            b = np.minimum(9, (p * 10).astype(int))
            eces.append(sum(abs((p - right)[b == k].sum()) for k in set(b)) / len(p))
        want[s] = np.mean(eces)
    assert all(abs(one[s] - want[s]) < 0.004 for s in one)


def test_corrected_difference_has_interval_p_and_verdict(spark, rows):
    _, df = rows
    worse = df.withColumn("correct", F.when((F.col("stratum") == "hard") & (F.col("item") % 3 > 0), 0.0).otherwise(F.col("conf")))
    reference = spark.range(100).select((F.col("id") / 1000).alias("d"))
    r = resample.corrected_delta_ece(worse, "stratum", "hard", "easy", "item", reference=reference, sims=100).first()
    assert abs(r["corrected"] - (r["raw"] - r["bias"])) < 1e-12 and r["low"] < r["corrected"] < r["high"]
    assert r["p"] == 0 and r["n_extreme"] == 0 and r["p_holds"] == 1 and r["verdict"] == "tracks"
    assert resample.corrected_delta_ece(worse, "stratum", "hard", "easy", "item", sims=20).first()["verdict"] is None


def test_temperatures_reach_the_least_loss(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([1, 1, 1], 300)
    human = p**0.5 / (p**0.5).sum(1, keepdims=True)  # the true temperature is 2
    df = spark.createDataFrame([(i, "g", x.tolist(), h.tolist()) for i, (x, h) in enumerate(zip(p, human, strict=True))], "item long, s string, p array<double>, h array<double>")
    got = fits.temperatures(df, "s", "p", "h")["g"]
    assert abs(got["t"] - 2) < 1e-4 and not got["at_low"] and not got["at_high"]
    rows, by = fits.temperature_cv(df, "s", "item", "p", "h")
    assert rows.count() == 300 and all(abs(x["t"] - 2) < 1e-3 for x in by.values()) and len(by) == 2


def test_softmax_models_by_gradient(spark):
    """At the weights found, the gradient of each model's penalised loss over its own rows vanishes."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 2))
    y = (x[:, 0] + rng.normal(size=150) > 0).astype(int) + (x[:, 1] > 1)
    data = [(i, x[i].tolist(), int(y[i]), i % 3, i % 2, i / 150) for i in range(150)]
    df = spark.createDataFrame(data, "item long, x array<double>, y int, outer int, inner int, draw double")
    models = [{"outer": 0, "inner": 1, "c": 0.5}, {"outer": 2, "c": 10.0, "below": 0.6}]
    w = fits.softmax_models(df, models, 3, rounds=30)
    z = np.hstack([x, np.ones((150, 1))])
    for m, use in zip(range(2), [[r[3] != 0 and r[4] != 1 for r in data], [r[3] != 2 and r[5] < 0.6 for r in data]], strict=True):
        s = z[use] @ w[m]
        q = np.exp(s - s.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        grad = z[use].T @ (q - (y[use][:, None] == np.arange(3))) + w[m] / models[m]["c"] * np.array([[1], [1], [0]])
        assert np.abs(grad).max() < 1e-3
    got, chosen = fits.nested_cv(df.withColumn("tier", F.lit("t")), "item", "x", "y", "tier", 3, outer=3, inner=2, grid=(0.1, 1.0))
    assert got.count() == 150 == got.select("item").distinct().count() and got.where("pred = y").count() > 90 and set(chosen) == {0, 1, 2}


def test_json_lines(spark, tmp_path):
    good, bad, other = (tmp_path / n for n in ("good.jsonl", "bad.jsonl", "other.jsonl"))
    good.write_text('{"id": "a", "n": 1}\n\n{"id": "b"}\n')
    bad.write_text('{"id": "a"}\n{"id": \n{"id": "c"}\n')
    other.write_text('{"id": "a"}\n[1]\n')
    schema = "id string, n long"
    assert sorted(map(tuple, jsonl.read_strict(spark, str(good), schema).collect())) == [("a", 1), ("b", None)]
    with pytest.raises(ValueError, match=r"bad\.jsonl:2"):
        jsonl.read_strict(spark, str(bad), schema)
    with pytest.raises(TypeError, match=r"other\.jsonl:2"):
        jsonl.read_strict(spark, str(other), schema)
    assert jsonl.read_lenient(spark, str(bad), schema).count() == 2
    jsonl.write(jsonl.read_strict(spark, str(good), schema), str(tmp_path / "out"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"id":"a","n":1}', '{"id":"b"}']
    raw = spark.createDataFrame([("k", None, None, None, False), (None, 1, "i", "c", None), (None, 1, "j", "c", True)], "unit_key string, pass int, item_id string, client string, error boolean")
    assert {r[0] for r in jsonl.completed_keys(raw).collect()} == {"k", "1:i:c"}


def test_files(spark, tmp_path):
    for n, t in (("items.jsonl", "a\n\nb\n"), ("labels.jsonl", "c")):
        (tmp_path / n).write_text(t)
    made = spark.createDataFrame(files.digests(spark, str(tmp_path)).collect())  # as it was
    files.verify(spark, str(tmp_path), files.parsed_manifest(files.manifest_lines(made)))
    (tmp_path / "labels.jsonl").write_text("changed")
    with pytest.raises(ValueError, match="MISMATCH labels"):
        files.verify(spark, str(tmp_path), made)
    assert {r["name"]: r["present"] for r in files.task_layout(spark, str(tmp_path)).collect()} == {"items.jsonl": True, "labels.jsonl": True, "schema.json": False, "README.md": False}
    digest = made.where("name = 'items.jsonl'").first()["digest"]
    files.pinned(spark, str(tmp_path / "items.jsonl"), digest, 2)
    with pytest.raises(ValueError, match="pinned"):
        files.pinned(spark, str(tmp_path / "items.jsonl"), digest, 3)
    out, df = str(tmp_path / "log"), spark.createDataFrame([("x", "key-123")], "a string, b string")
    with pytest.raises(ValueError, match="secret"):
        files.append(df, out, ["key-123"])
    files.append(df, out, ["other", ""])
    assert spark.read.text(out).count() == 1
    with pytest.raises(ValueError, match="repeated"):
        files.population({"a": df, "b": df}, "a")
    with pytest.raises(ValueError, match="x: never"):
        files.validated(df, {"never": F.lit(False)}, "a")
    line = files.report(spark.createDataFrame([(float("nan"), 0.1234567890123456, "s")], "b double, a double, c string")).first()[0]
    assert json.loads(line) == {"a": 0.123456789012, "b": None, "c": "s"}
    items = spark.createDataFrame([("i", "hard", [0.5, 0.5], [0.1, 0.9], 0.9, 5.0, None)], "item_id string, stratum string, human array<double>, probs array<double>, confidence double, latency_ms double, baseline int")
    row = json.loads(files.certificate(items, {"delta": 0.25}, "v1").first()[0])
    assert row["result"] == {"delta": 0.25} and row["item"]["baseline"] == 1 and row["schema"] == "v1"


def test_guards_raise(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    with pytest.raises(ValueError, match="left out: b"):
        records.assert_disjoint(ids, ids.where("id = 'b'"), "id")
    three = spark.createDataFrame([("a", 0, [0.5]), ("a", 1, [1.0])], "item string, pass int, p array<double>")
    assert records.mean_over_passes(three, ["item"], "p", 2).first()["p"] == [0.75]
    with pytest.raises(Exception, match="not 3 passes"):
        records.mean_over_passes(three, ["item"], "p", 3).collect()
    with pytest.raises(Exception, match="unknown label: z"):
        spark.range(1).select(X.label_index(F.lit("z"), ["x"])).collect()
    with pytest.raises(Exception, match="negative"):
        spark.range(1).select(X.distribution(F.array(F.lit(-0.5), F.lit(1.0)))).collect()
    with pytest.raises(ValueError, match="labels_without_item"):
        jsonl.load_dataset(ids.where("id = 'a'"), ids, "id")
    assert records.label_order(ids, "id") == ["a", "b"] and "text" not in records.redacted(ids.withColumn("text", F.lit("t"))).columns
    d = spark.range(1).select(records.error_decision(F.lit("q"), F.lit("noul")).alias("d")).first()["d"]
    assert d["value"] == 0 and d["choice"] is None


def test_streams(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(at, 0.95, 1, "a", 0.5, "k1"), (at, 0.95, 0, "a", 0.25, "k2"), (at + datetime.timedelta(minutes=1), 0.95, 0, "a", 0.25, "k2")], "ts timestamp, conf double, correct int, client string, cost double, unit_key string")
    rows.write.parquet(str(tmp_path / "in"))
    for name, f in (("cal", monitor.calibration), ("spent", monitor.spending), ("once", monitor.without_repeats)):
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        q = f(stream).writeStream.format("memory").queryName(name).outputMode("append" if name == "once" else "complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert [(r["bin"], r["n"], r["correct"]) for r in spark.table("cal").collect()] == [(9, 3, 1)]
    assert [r["cost"] for r in spark.table("spent").collect()] == [1.0] and spark.table("once").count() == 2

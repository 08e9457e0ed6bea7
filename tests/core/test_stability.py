"""Stability of repeats against all pairs in numpy, with items of many different answers."""

import numpy as np
import pytest

from plumbline.operators import stability


def all_pairs(answers):
    """By definition, over every pair of repeats."""
    labels = np.array([a for a, _ in answers])
    p = np.array([x for _, x in answers])
    i, j = np.triu_indices(len(answers), 1)
    tv = np.abs(p[i] - p[j]).sum(1) / 2
    m = (p[i] + p[j]) / 2
    kl = lambda x: np.where(x > 0, x * np.log(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0).sum(1)
    js = np.maximum(0, (kl(p[i]) + kl(p[j])) / 2)
    return [len(i), (labels[i] != labels[j]).mean(), tv.mean(), tv.max(), js.mean(), js.max()]


@pytest.fixture(scope="module")
def repeats():
    rng = np.random.default_rng(11)
    rows = []
    for item, n, different in (("hot", 400, 350), ("few", 7, 7), ("same", 90, 1), ("some", 60, 20), ("pair", 2, 2), ("one", 1, 1), (None, 5, 3)):
        pool = [(str(rng.choice(list("ANR"))), rng.dirichlet([0.5] * 3).tolist()) for _ in range(different)]
        pool[0] = (pool[0][0], [1.0, 0.0, 0.0])
        rows += [(item, *pool[k]) for k in [*range(different), *rng.integers(0, different, n - different)]]
    return rows


@pytest.mark.parametrize("block", [8, 128, 1000])
def test_pairs_of_repeats(spark, repeats, block):
    """One answer repeated, as many as blocks hold, and far more: each item once, as by all its pairs; an item asked once has none."""
    df = spark.createDataFrame(repeats, "item string, decision string, p array<double>")
    got = {r["item"]: r for r in stability.pairwise(df, ["item"], "p", block=block).collect()}
    assert set(got) == {"hot", "few", "same", "some", "pair", None}
    for item, r in got.items():
        want = all_pairs([(d, p) for i, d, p in repeats if i == item])
        assert np.allclose([r[c] for c in ("pairs", "pair_flip", "mean_tv", "max_tv", "mean_js", "max_js")], want, atol=1e-12), item


def test_no_repeats(spark):
    assert stability.pairwise(spark.createDataFrame([], "item string, decision string, p array<double>"), ["item"], "p").count() == 0


def test_panel_of_all_measures(spark):
    rng = np.random.default_rng(6)
    rows = []
    for item in range(60):
        for repeat in range(1 if item == 7 else 4):
            c = float(rng.choice([0.5, 0.75, 0.875, 1.0])) if item % 3 else 0.75
            rows.append((f"i{item}", repeat, "ab"[int(rng.random() < 0.3)], c, [c, 1 - c], None if item < 5 else f"t{item % 2}", f"m{item % 2 * repeat}"))
    df = spark.createDataFrame(rows, "item string, repeat int, decision string, confidence double, probs array<double>, tier string, model string")
    got = {(r["kind"], r["key"]): r for r in stability.stability_panel(df, "item", "probs", 0.75, ["tier"], "model", replicates=40).collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    facts = {}
    for item, r in by.items():
        c = np.array([x[3] for x in r])
        pairs = all_pairs([(x[2], x[4]) for x in r])[2:] if len(r) > 1 else [0.0] * 4
        facts[item] = {"tier": r[0][5], "model": ",".join(sorted({x[6] for x in r})), "flips": len({x[2] for x in r}) > 1, "sd": c.std(ddof=1) if len(r) > 1 else 0.0, "distance": round(abs(c.mean() - 0.75), 12), "pairs": pairs}
    edges = list(np.quantile([f["distance"] for f in facts.values()], np.linspace(0, 1, 11)))
    for i in range(1, 11):
        if edges[i] <= edges[i - 1]:
            edges[i] = edges[i - 1] + 1e-12
    want = {}
    for f in facts.values():
        decile = next((d for d in range(9) if edges[d] <= f["distance"] < edges[d + 1]), 9)
        for k in (("all", ""), ("tier", f["tier"]), ("model", f["model"]), ("decile", str(decile))):
            want.setdefault(k, []).append(f)
    assert set(got) == set(want) and ("tier", None) in got and len([k for k in got if k[0] == "decile"]) < 10
    for k, fs in want.items():
        r = got[k]
        assert r["items"] == len(fs) and r["flipped"] == sum(f["flips"] for f in fs) and r["low"] <= r["flip_rate"] <= r["high"]
        assert r["mean_sd"] == pytest.approx(np.mean([f["sd"] for f in fs]), abs=1e-12)
        for at, name in enumerate(("mean_tv", "mean_max_tv", "mean_js", "mean_max_js")):
            assert r[name] == pytest.approx(np.mean([f["pairs"][at] for f in fs]), abs=1e-12)
        assert r["max_js"] == pytest.approx(max(f["pairs"][3] for f in fs), abs=1e-12)

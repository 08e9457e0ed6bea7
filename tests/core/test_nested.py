"""Nested cross-validation and sweeps against plain Python, corrected differences by pass against numpy."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from plumbline.operators import fits, resample


def draw(seed, item):
    return int(hashlib.md5(f"{seed}:{item}".encode()).hexdigest()[:8], 16)


def newton(x, y, classes, c):
    z, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros((x.shape[1] + 1, classes))
    free = np.append(np.ones(x.shape[1]), 1e-8)[:, None] / c
    for _ in range(3000):
        s = z @ w
        q = np.exp(s - s.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        grad = z.T @ (q - (y[:, None] == np.arange(classes))) + free * w
        w -= grad / (0.5 * np.linalg.norm(z, 2) ** 2 + free)
    return lambda rows: (np.hstack([rows, np.ones((len(rows), 1))]) @ w).argmax(1)


def by_hand(data, k, inner, grid, seed, size):
    """Per fold: (n_train, c, accuracy), dealing rows one by one."""
    strata = defaultdict(list)
    for item, x, y, tier in data:
        strata[tier, y].append((item, x, y))
    fold, rank = {}, {}
    for rows in strata.values():
        for i, r in enumerate(sorted(rows, key=lambda r: (draw(seed, r[0]), r[0]))):
            fold[r[0]] = i % k
        for f in range(k):
            for i, r in enumerate(sorted((r for r in rows if fold[r[0]] == f), key=lambda r: (draw(seed + 1, r[0]), r[0]))):
                rank[r[0]] = i
    out = []
    for o in range(k):
        piles = {s: {f: sorted((r for r in rows if fold[r[0]] == f), key=lambda r: rank[r[0]]) for f in range(k) if f != o} for s, rows in sorted(strata.items())}
        quota, left = dict.fromkeys(piles, 0), size if size is not None else len(data)
        while left and any(quota[s] < sum(map(len, p.values())) for s, p in piles.items()):
            for s, p in piles.items():
                if left and quota[s] < sum(map(len, p.values())):
                    quota[s], left = quota[s] + 1, left - 1
        train = []
        for s, p in piles.items():
            taken, need = dict.fromkeys(p, 0), quota[s]
            while need:
                for f in p:
                    if need and taken[f] < len(p[f]):
                        taken[f], need = taken[f] + 1, need - 1
            train += [r for f in p for r in p[f][: taken[f]]]
        splits, c = min(inner, min(q for q in quota.values() if q)), 1.0
        x, y = np.array([r[1] for r in train]), np.array([r[2] for r in train])
        if splits > 1:
            place = np.array([(rank[r[0]] + fold[r[0]]) % splits for r in train])
            score = {}
            for g in sorted(grid):
                a = [np.mean(newton(x[place != i], y[place != i], 2, g)(x[place == i]) == y[place == i]) for i in range(splits) if len(set(y[place != i])) > 1]
                if a:
                    score[g] = round(float(np.mean(a)), 12)
            c = max(sorted(score), key=score.get, default=1.0)
        held = [r for rows in strata.values() for r in rows if fold[r[0]] == o]
        hx, hy = np.array([r[1] for r in held]), np.array([r[2] for r in held])
        pred = np.full(len(held), y[0]) if len(set(y)) == 1 else newton(x, y, 2, c)(hx)
        out.append((len(train), c, float(np.mean(pred == hy))))
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(160, 2))
    return [(str(i), x[i].tolist(), int(x[i, 0] + rng.normal() > 0.3), "ab"[i % 3 == 0]) for i in range(160)]


def test_sweep_is_as_dealt_by_hand(spark, data):
    df = spark.createDataFrame(data, "item string, x array<double>, y int, tier string")
    how = {"outer": 3, "inner": 2, "grid": (0.01, 1.0), "seed": 5}
    _, got = fits.nested_fits(df, "item", "x", "y", "tier", 2, sizes=(1, 6, 40, None), **how)
    rows = {r["labels"]: r for r in fits.label_sweep(df.repartition(5), "item", "x", "y", "tier", 2, (1, 6, 40, 161), **how).collect()}
    for size in (1, 6, 40, None):
        want = by_hand(data, 3, 2, (0.01, 1.0), 5, size)
        assert [(f["n_train"], f["c"]) for f in got if f["size"] == size] == [w[:2] for w in want]
        if size:
            a = [w[2] for w in want]
            assert rows[size]["accuracy_mean"] == pytest.approx(np.mean(a), abs=0.013) and rows[size]["accuracy_sd"] == pytest.approx(np.std(a, ddof=1), abs=0.013)
            assert not rows[size]["skipped"] and rows[size]["n_train"] == size
    assert {f["only"] for f in got if f["size"] == 1} == {0} and rows[161]["skipped"] and rows[161]["accuracy_mean"] is None


def test_too_few_rows_of_a_stratum_are_an_error_or_skipped(spark):
    df = spark.createDataFrame([("a", [1.0], 0, "t"), ("b", [2.0], 1, "t"), ("c", [2.0], None, None)], "item string, x array<double>, y int, tier string")
    with pytest.raises(ValueError, match="no two folds"):
        fits.nested_cv(df, "item", "x", "y", "tier", 2)
    r = fits.label_sweep(df, "item", "x", "y", "tier", 2, (2,)).first()
    assert r["skipped"] and "no two folds" in r["reason"] and r["folds"] is None


def test_dealt_in_turn():
    assert fits.dealt({"a": 1, "b": 5, "c": 3}, 6) == {"a": 1, "b": 3, "c": 2} and fits.dealt({"a": 2}, 9) == {"a": 2} and fits.dealt({}, 3) == {}


def test_corrected_difference_of_passes_and_of_their_mean(spark):
    rng = np.random.default_rng(3)
    raw = [(i, n, "hard" if i % 3 else "easy", rng.dirichlet([2, 1, 1]).tolist(), None) for i in range(240) for n in range(3)]
    human = {i: rng.dirichlet([1, 1, 1]).tolist() for i in range(240)}
    rows = [(*r[:4], human[r[0]]) for r in raw]
    schema = "item long, pass int, stratum string, p array<double>, human array<double>"
    got = {r["pass"]: r for r in resample.corrected_by_pass(spark.createDataFrame(rows, schema), "pass", "stratum", "hard", "easy", "item", "p", "human", sims=40).collect()}
    easy = [i for i in range(240) if i % 3 == 0]
    hard = sorted((i for i in range(240) if i % 3), key=lambda i: (draw(1, i), i))[: len(easy)]
    by = {(r[0], r[1]): np.array(r[3]) for r in rows}

    def ece(ids, number):
        sums = defaultdict(float)
        for i in ids:
            p = np.mean([by[i, n] for n in range(3)], 0) if number == "mean" else by[i, int(number)]
            sums[min(9, int(p.max() * 10))] += p.max() - human[i][int(p.argmax())]
        return sum(map(abs, sums.values())) / len(ids)

    assert set(got) == {"0", "1", "2", "mean"}
    for n, r in got.items():
        assert r["items"] == 80 and r["raw"] == pytest.approx(ece(hard, n) - ece(easy, n), abs=1e-12)
        assert r["corrected"] == r["raw"] - r["bias"] and abs(r["bias"]) < 0.03 and 0 <= r["p"] <= 1
        assert r["least"] == min(v["corrected"] for v in got.values()) and r["most"] == max(v["corrected"] for v in got.values())
    for bad in ([r for r in rows if r[:2] != (3, 2)], [*rows, next(r for r in rows if r[:2] == (3, 2))]):  # an easy item, so locked
        with pytest.raises(Exception, match="not 3 passes"):
            resample.corrected_by_pass(spark.createDataFrame(bad, schema), "pass", "stratum", "hard", "easy", "item", "p", "human", sims=5).collect()

"""Work that grows with the tables: parts of bounded size, inputs read and drawn once, expressions worked out once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import rankboot, records, resample, stability
from plumbline.plans import record_queries, views
from plumbline.sources import tables

SF = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("made", [lambda s: views.panel(s, SF).groupBy("client", "item").count(), lambda s: record_queries._records(s, SF).groupBy("item_id").count()])
def test_parts_follow_rows(spark, monkeypatch, made):
    """60,000 lines in parts of 2,000; what groups by item uses the same parts. The session has 4."""
    monkeypatch.setattr(tables, "ROWS", 2000)
    df = made(spark)
    assert plan(df).count("Exchange hashpartitioning(l_orderkey") + plan(df).count("Exchange hashpartitioning(item_id") + plan(df).count("Exchange hashpartitioning(client") <= 1
    assert df.rdd.getNumPartitions() == 30


def test_pairs_read_answers_twice(spark):
    df = stability.pairwise(views.panel(spark, SF), ["item"], "probs")
    assert plan(df).count("lineitem") <= 2


def test_panel_draws_items_once(spark, monkeypatch):
    seen, weighted = [], resample.weighted
    monkeypatch.setattr(resample, "weighted", lambda df, *a: seen.append(df.count()) or weighted(df, *a))
    df = spark.createDataFrame([(i, r, "ab"[i * r % 2], 0.5 + i % 5 / 10, [0.5, 0.5], "t", "m") for i in range(30) for r in range(2)], "item int, repeat int, decision string, confidence double, p array<double>, tier string, model string")
    assert stability.stability_panel(df, "item", "p", 0.75, ["tier"], "model", replicates=8).count() > 3
    assert seen == [30]


def test_interval_reads_once(spark):
    """Counts, borders, points and replicates read one stored table."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(x):
        read.add(1)
        return x

    rng = np.random.default_rng(2)
    rows = [(i, *map(float, rng.normal(size=2).round(1))) for i in range(200)]
    df = spark.createDataFrame(rows, "item int, x double, y double").withColumn("x", seen("x"))
    assert rankboot.interval(df, "spearman", "x", "y", "item", replicates=8).count() == 1
    assert read.value == 200


def test_responses_are_parsed_once(spark):
    df = spark.createDataFrame([('{"model": "m", "answers": {"b": {"noul": 0.25}, "a": {"choice": "x"}}}',), ("oops",), (None,)], "body string")
    got = df.select(records.parsed(F.col("body")).alias("d"))
    assert [None if r["d"] is None else [(d["question_id"], d["choice"], d["value"], d["model"]) for d in r["d"]] for r in got.collect()] == [[("a", "x", None, "m"), ("b", None, 0.25, "m")], None, None]
    assert got._jdf.queryExecution().analyzed().toString().count("from_json") == 1


def test_arms_stay_in_place(spark):
    """What takes an item's last record by client needs no exchange by both."""
    moved = [x for x in plan(record_queries.arm_arrays(spark, SF)).splitlines() if "Exchange hashpartitioning" in x]
    assert moved and not any("client" in x for x in moved)


def test_corrected_passes_read_once(spark):
    """Passes, locked items, answers and their means come from one reading of the rows."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(x):
        read.add(1)
        return x

    rng = np.random.default_rng(4)
    rows = [(i, n, "hard" if i % 2 else "easy", float(x), [0.5, 0.5]) for i in range(60) for n, x in enumerate(rng.random(3))]
    df = spark.createDataFrame(rows, "item int, pass int, stratum string, x double, human array<double>").withColumn("x", seen("x"))
    df = df.withColumn("p", F.array("x", 1 - F.col("x")))
    assert resample.corrected_by_pass(df, "pass", "stratum", "hard", "easy", "item", "p", "human", sims=2).count() == 4
    assert read.value == 180


def test_means_add_in_order_of_passes(spark):
    """(0.1 + 0.2) + 0.3 isn't 0.1 + (0.2 + 0.3): what a mean is, and on which side of a bin's border, doesn't follow the rows' order."""
    rows = [("a", n, [x, None]) for n, x in ((2, 0.3), (1, 0.2), (0, 0.1))]
    for some in (rows, rows[::-1]):
        df = spark.createDataFrame(some, "item string, pass int, p array<double>").coalesce(1)
        assert records.mean_over_passes(df, ["item"], "p", 3).first()["p"] == [(0.1 + 0.2 + 0.3) / 3, None]


def test_item_without_vectors_is_an_error(spark):
    rows = [(i, n, "hard" if i % 2 else "easy", None if i == 2 else [0.25, 0.75], [0.5, 0.5]) for i in range(4) for n in range(2)]
    df = spark.createDataFrame(rows, "item int, pass int, stratum string, p array<double>, human array<double>")
    with pytest.raises(Exception, match="not 2 passes"):
        resample.corrected_by_pass(df, "pass", "stratum", "hard", "easy", "item", "p", "human", sims=2).collect()


@pytest.mark.parametrize("by", [[], ["stratum"]])
def test_blocks_draw_alike_in_any_parts(spark, monkeypatch, by):
    """Each block of items draws from its own generator; a task hands out one sum of all its blocks."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, "ab"[i % 2], float(x)) for i, x in enumerate(rng.random(400))], "item long, stratum string, conf double")
    keys = df.select("item", F.xxhash64("item").alias("h"), F.pmod(F.xxhash64("item", F.lit(1)), F.lit(50)).alias("block"), *[F.col(c) for c in ("stratum", "conf")]).collect()
    want = {}
    for block in {r["block"] for r in keys}:
        part = sorted((r for r in keys if r["block"] == block), key=lambda r: r["h"])
        draw, q = np.random.default_rng([1, block]), np.clip([r["conf"] for r in part], 1e-4, 1 - 1e-4)
        for s in range(3):
            for r, n in zip(part, draw.binomial(10, draw.beta(20.0 * q, 20.0 * (1 - q))), strict=True):
                at = (*[r[c] for c in by], s, min(9, int(r["conf"] * 10)))
                a, b, c = want.get(at, (0, 0, 0))
                want[at] = (a + 1, b + r["conf"], c + n / 10)
    for rows in (1 << 18, 20):
        monkeypatch.setattr(tables, "ROWS", rows)
        got = resample.calibrated_sums(df, by, conf="conf", item="item", kappa=20.0, votes=10, bins=10, sims=3, seed=1, block=8)
        assert "FlatMapGroupsInPandas" not in plan(got)
        assert {tuple(r)[:-3]: tuple(r)[-3:] for r in got.collect()} == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}

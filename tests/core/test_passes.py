from plumbline.operators import stability
from plumbline.plans import views as V
from plumbline.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_no_pass_is_left_out(spark):
    got = QUERIES["stability_by_pass"](spark, SF).collect()
    want = {(r["client"], r["repeat"]): r["count"] for r in V.panel(spark, SF).groupBy("client", "repeat").count().collect()}
    assert {(r["client"], r["pass"]): r["n"] for r in got} == want and max(r["pass"] for r in got) > 4
    assert {r["passes"] for r in got} == {len({p for c, p in want if c == k}) for k in {c for c, _ in want}}


def test_ranges_and_single_pass(spark):
    rows = [("a", 1, 0.9, 1), ("a", 2, 0.9, 1), ("a", 7, 0.9, 0), ("b", 1, 0.6, 1)]
    out = stability.by_pass(spark.createDataFrame(rows, "client string, pass int, conf double, correct int"), "client", "pass").collect()
    got = {(r["client"], r["pass"]): r for r in out}
    assert round(got["a", 7]["ece"], 9) == 0.9 and got["a", 1]["accuracy_range"] == 1 and round(got["a", 1]["ece_range"], 9) == 0.8 and got["a", 2]["material_move"]
    assert got["b", 1]["accuracy_range"] is None and got["b", 1]["material_move"] is None and got["b", 1]["passes"] == 1

"""Registered queries over the evaluation views, one per operator family, and the DuckDB SQL that checks each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import expr as X
from plumbline.operators import agree, calibrate, rank, records, resample, stability
from plumbline.plans import views as V
from plumbline.sources import jsonl

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = WITH + sql
        return f

    return add


def r9(*names: str) -> list[Column]:
    return [(F.round(F.col(n), 9) + 0.0).alias(n) for n in names]


WITH = """WITH votes0 AS (SELECT o_custkey AS item, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p, count(*) AS n FROM orders GROUP BY 1),
votes1 AS (SELECT item, n, [f / (f + o + p), o / (f + o + p), p / (f + o + p)] AS label_dist FROM votes0),
votes2 AS (SELECT *, round(-list_sum([CASE WHEN x > 0 THEN x * log2(x) ELSE 0 END FOR x IN label_dist]), 12) + 0.0 AS entropy FROM votes1),
quart AS (SELECT quantile_cont(entropy, 0.25) AS q25, quantile_cont(entropy, 0.75) AS q75 FROM votes2),
votes AS (SELECT votes2.*, CASE WHEN entropy <= q25 THEN 'easy' WHEN entropy >= q75 THEN 'hard' ELSE 'mid' END AS stratum FROM votes2, quart),
probs0 AS (SELECT o_custkey AS item, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS b, count(*) FILTER (l_returnflag = 'R') AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
probs AS (SELECT item, [a / (a + b + c), b / (a + b + c), c / (a + b + c)] AS probs FROM probs0),
cal0 AS (SELECT votes.*, probs, list_position(probs, list_max(probs)) - 1 AS pred, list_max(probs) AS conf, list_position(label_dist, list_max(label_dist)) - 1 AS majority FROM votes JOIN probs USING (item)),
cal AS (SELECT *, label_dist[pred + 1] AS correct, pred = majority AS hard FROM cal0),
bin0 AS (SELECT doc_id, source, lang, (n_chars % 101) / 100.0::DOUBLE AS p, quality AS y, toxic AS y2 FROM labels JOIN documents USING (doc_id)),
bina AS (SELECT *, (p >= 0.5)::INT AS pred, greatest(p, 1 - p) AS conf, ((p >= 0.5)::INT = y)::INT AS correct FROM bin0),
panel AS (SELECT l_orderkey AS item, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS repeat, l_returnflag AS decision, 0.5 + 5 * l_discount AS confidence, o_orderpriority AS tier, l_suppkey % 3 AS client FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
edges AS (SELECT [i * 0.1::DOUBLE FOR i IN [1,2,3,4,5,6,7,8,9]] AS e),
calb AS (SELECT cal.*, len([x FOR x IN e IF x <= conf]) AS bin FROM cal, edges)
"""
ECE = "SELECT {by}, sum(n)::DOUBLE AS n, round(sum(n * abs(mc - mp)) / sum(n), 9) + 0.0 AS ece, round(max(abs(mc - mp)), 9) + 0.0 AS mce, round(max(n) / sum(n), 9) AS max_bin_share FROM (SELECT {by}, bin, count(*) AS n, avg(correct) AS mc, avg(conf) AS mp FROM ({src}) GROUP BY {by}, bin) GROUP BY {by}"


def horner(coefficients: list[float], x: str) -> str:
    out = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


#: erfc of a {x} that isn't negative.
ERFC = "(1 / (1 + 0.5 * {x})) * exp(-({x}) * ({x}) + " + horner(X.ERFC[::-1], "(1 / (1 + 0.5 * {x}))") + ")"


def rounded_ece(df: DataFrame, by: list[str]) -> DataFrame:
    return df.select(*by, "n", *r9("ece", "mce", "max_bin_share"))


@query(ECE.format(by="stratum", src="SELECT * FROM calb"))
def ece_by_stratum(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_ece(calibrate.uniform_ece(V.calibration(spark, sf), ["stratum"]), ["stratum"])


@query(ECE.format(by="stratum", src="SELECT * REPLACE (hard::INT AS correct) FROM calb"))
def ece_hard_labels(spark, sf):
    rows = V.calibration(spark, sf).withColumn("correct", F.col("hard").cast("int"))
    return rounded_ece(calibrate.uniform_ece(rows, ["stratum"]), ["stratum"])


@query(ECE.format(by="stratum", src="SELECT * REPLACE (least(9, floor(conf * 10)::INT) AS bin) FROM calb"))
def ece_floor_bins(spark, sf):
    bins = calibrate.reliability(V.calibration(spark, sf), ["stratum"], X.bin_floor(F.col("conf"), 10))
    return rounded_ece(calibrate.ece(bins, ["stratum"]), ["stratum"])


_Q = ", ".join(f"CASE WHEN q[{i + 1}] <= e{i - 1} THEN least(1.0, e{i - 1} + 1e-12) ELSE q[{i + 1}] END AS e{i}" for i in range(1, 10))


@query(f", qs AS (SELECT stratum, quantile_cont(conf, [{', '.join(str(i / 10) for i in range(11))}]) AS q FROM cal GROUP BY 1), qe AS (SELECT stratum, q[1] AS e0, {_Q} FROM qs) " + ECE.format(by="stratum", src="SELECT cal.stratum, conf, correct, " + " + ".join(f"(e{i} <= conf)::INT" for i in range(1, 10)) + " AS bin FROM cal JOIN qe USING (stratum)"))
def ece_quantile_bins(spark, sf):
    return rounded_ece(calibrate.quantile_ece(V.calibration(spark, sf), ["stratum"]), ["stratum"])


@query("SELECT s.stratum, b.i AS bin, count(calb.item)::DOUBLE AS n, round(avg(conf), 9) AS mean_conf, round(avg(correct), 9) AS mean_correct FROM (SELECT DISTINCT stratum FROM calb) s CROSS JOIN (SELECT unnest(range(10)) AS i) b LEFT JOIN calb ON calb.stratum = s.stratum AND calb.bin = b.i GROUP BY 1, 2")
def reliability_bins(spark, sf):
    bins = calibrate.reliability(V.calibration(spark, sf), ["stratum"], X.bin_digitize(F.col("conf"), 10))
    return calibrate.with_empty_bins(bins, ["stratum"], 10).select("stratum", F.col("bin").cast("long").alias("bin"), "n", *r9("mean_conf", "mean_correct"))


@query("SELECT stratum, round(avg((probs[1] - (majority = 0)::INT) ** 2 + (probs[2] - (majority = 1)::INT) ** 2 + (probs[3] - (majority = 2)::INT) ** 2), 9) AS brier FROM cal GROUP BY 1")
def brier_by_stratum(spark, sf):
    return calibrate.brier(V.calibration(spark, sf), ["stratum"], "probs", "majority").select("stratum", *r9("brier"))


@query(", r AS (SELECT source, round(avg((p - y) ** 2), 9) AS brier FROM bina GROUP BY 1), t AS (SELECT source, sum(n)::DOUBLE AS n, sum(n * abs(mc - mp)) / sum(n) AS ece, sum(n * mc) / sum(n) AS accuracy FROM (SELECT source, len([x FOR x IN e IF x <= conf]) AS bin, count(*) AS n, avg(correct) AS mc, avg(conf) AS mp FROM bina, edges GROUP BY 1, 2) GROUP BY 1) SELECT source, n, round(ece, 9) AS ece, round(accuracy, 9) AS accuracy, round((SELECT regr_slope(ece, accuracy) FROM t), 6) AS slope, brier FROM t JOIN r USING (source)")
def calibration_by_tier(spark, sf):
    out = calibrate.by_tier(V.binary(spark, sf), "source", p="p", label="y")
    return out.select("source", "n", *r9("ece", "accuracy", "brier"), F.round("slope", 6).alias("slope"))


@query("SELECT stratum, count(*) AS n, round(avg(conf), 9) AS mean_conf, round(avg(correct), 9) AS mean_correct, round(avg(conf) - avg(correct), 9) AS overconfidence FROM cal GROUP BY 1")
def direction_table(spark, sf):
    return calibrate.direction(V.calibration(spark, sf), ["stratum"]).select("stratum", "n", *r9("mean_conf", "mean_correct", "overconfidence"))


@query(", m AS (SELECT k, (SELECT count(*) FROM cal WHERE majority = k) AS t, (SELECT count(*) FROM cal WHERE pred = k) AS p, (SELECT count(*) FROM cal WHERE pred = k AND majority = k) AS tp FROM (SELECT unnest([0, 1, 2]) AS k)) SELECT (SELECT round(avg(hard::INT), 9) FROM cal) AS accuracy, round(avg(2 * tp / (t + p)), 9) AS macro_f1 FROM m WHERE t + p > 0")
def accuracy_and_f1(spark, sf):
    return agree.macro_f1(V.calibration(spark, sf), [], "majority", "pred").select(*r9("accuracy", "macro_f1"))


@query("SELECT t.k AS truth, p.k AS pred, (SELECT count(*) FROM cal WHERE majority = t.k AND pred = p.k) AS n FROM (SELECT unnest([0, 1, 2]) AS k) t, (SELECT unnest([0, 1, 2]) AS k) p")
def confusion_matrix(spark, sf):
    return agree.confusion(V.calibration(spark, sf), "majority", "pred", [0, 1, 2])


AUROC = "round((sum(pos * (below + neg / 2))) / nullif(sum(pos) * sum(neg), 0), 9)"


@query(", g AS (SELECT lang, p, sum(y) AS pos, sum(1 - y) AS neg FROM bina GROUP BY 1, 2), h AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY lang ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) SELECT lang, sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg, " + AUROC + " AS auroc FROM h GROUP BY 1")
def auroc_by_language(spark, sf):
    return rank.auroc(V.binary(spark, sf), ["lang"], "p", "y").select("lang", "n_pos", "n_neg", *r9("auroc"))


@query(", o AS (SELECT k, CASE k WHEN 0 THEN probs[1] WHEN 1 THEN probs[2] ELSE probs[3] END AS x, (majority = k)::INT AS y FROM cal, (SELECT unnest([0, 1, 2]) AS k)), g AS (SELECT k, x, sum(y) AS pos, sum(1 - y) AS neg FROM o GROUP BY 1, 2), h AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY k ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) SELECT k::INT AS k, " + AUROC + " AS auroc FROM h GROUP BY 1")
def auroc_one_vs_rest(spark, sf):
    rows = V.calibration(spark, sf).select(F.posexplode("probs").alias("k", "x"), "majority").withColumn("y", (F.col("k") == F.col("majority")).cast("int"))
    return rank.auroc(rows, ["k"], "x", "y").select("k", *r9("auroc"))


@query(", g AS (SELECT p, sum(y) AS pos, count(*) AS n FROM bina GROUP BY 1), h AS (SELECT pos, sum(pos) OVER w AS cp, sum(n) OVER w AS cn FROM g WINDOW w AS (ORDER BY p DESC)) SELECT round(sum(pos * cp / cn) / sum(pos), 9) AS auprc FROM h")
def average_precision(spark, sf):
    return rank.auprc(V.binary(spark, sf), [], "p", "y").select(*r9("auprc"))


_KL = "list_sum([CASE WHEN {p}[i] > 0 THEN {p}[i] * {log}({p}[i] / {m}[i]) ELSE 0 END FOR i IN [1, 2, 3]])"
_DIV = ", d0 AS (SELECT item, stratum, conf, probs, label_dist, [greatest(x, 1e-12) FOR x IN probs] AS cp, [greatest(x, 1e-12) FOR x IN label_dist] AS cd FROM cal), d1 AS (SELECT *, [x / list_sum(cp) FOR x IN cp] AS np, [x / list_sum(cd) FOR x IN cd] AS nd FROM d0), d2 AS (SELECT *, [(np[i] + nd[i]) / 2 FOR i IN [1, 2, 3]] AS m, [(probs[i] + label_dist[i]) / 2 FOR i IN [1, 2, 3]] AS mr FROM d1) "


@query(_DIV + f"SELECT item, round(({_KL.format(p='np', m='m', log='log2')} + {_KL.format(p='nd', m='m', log='log2')}) / 2, 9) + 0.0 AS jsd_bits, round(greatest(0, ({_KL.format(p='probs', m='mr', log='ln')} + {_KL.format(p='label_dist', m='mr', log='ln')}) / 2), 9) + 0.0 AS jsd_nats, round((abs(probs[1] - label_dist[1]) + abs(probs[2] - label_dist[2]) + abs(probs[3] - label_dist[3])) / 2, 9) AS tvd, round(-list_sum([nd[i] * ln(np[i]) FOR i IN [1, 2, 3]]), 9) AS cross_entropy, round(1 - conf, 9) AS top_uncertainty, round(list_reverse_sort(probs)[1] - list_reverse_sort(probs)[2], 9) + 0.0 AS margin FROM d2")
def divergences(spark, sf):
    p, d = F.col("probs"), F.col("label_dist")
    out = V.calibration(spark, sf).select("item", X.jsd_bits(p, d).alias("jsd_bits"), X.jsd_nats(p, d).alias("jsd_nats"), X.tvd(p, d).alias("tvd"), X.cross_entropy(d, p).alias("cross_entropy"), (1 - F.col("conf")).alias("top_uncertainty"), X.margin(p).alias("margin"))
    return out.select("item", *r9("jsd_bits", "jsd_nats", "tvd", "cross_entropy", "top_uncertainty", "margin"))


@query("SELECT stratum, round(avg((abs(probs[1] - label_dist[1]) + abs(probs[2] - label_dist[2]) + abs(probs[3] - label_dist[3])) / 2), 9) AS tvd, round(avg((abs(1/3 - label_dist[1]) + abs(1/3 - label_dist[2]) + abs(1/3 - label_dist[3])) / 2), 9) AS uniform_tvd FROM cal GROUP BY 1")
def divergence_against_uniform(spark, sf):
    third = F.array(*[F.lit(1 / 3)] * 3)
    return V.calibration(spark, sf).groupBy("stratum").agg(F.avg(X.tvd(F.col("probs"), F.col("label_dist"))).alias("tvd"), F.avg(X.tvd(third, F.col("label_dist"))).alias("uniform_tvd")).select("stratum", *r9("tvd", "uniform_tvd"))


@query("SELECT item, n, round(entropy, 9) + 0.0 AS entropy, stratum FROM votes")
def entropy_strata(spark, sf):
    return V.votes(spark, sf).select("item", "n", *r9("entropy"), "stratum")


@query(", c AS (SELECT item, decision, count(*) AS n, min(repeat) AS first FROM panel GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY n DESC, first) AS rn FROM c) SELECT item, sum(n)::BIGINT AS repeats, count(*) AS distinct_decisions, max(CASE WHEN rn = 1 THEN decision END) AS mode, max(n) AS mode_count, (count(*) > 1)::INT AS flips FROM k GROUP BY 1")
def label_stability(spark, sf):
    return stability.label_stability(V.panel(spark, sf), ["item"])


@query("SELECT item, count(*) AS repeats, round(avg(confidence), 9) AS mean, round(coalesce(stddev_samp(confidence), 0), 9) AS sd, round(max(confidence) - min(confidence), 9) AS range, round(greatest(max(confidence) - avg(confidence), avg(confidence) - min(confidence)), 9) + 0.0 AS max_dev FROM panel GROUP BY 1")
def confidence_stability(spark, sf):
    return stability.confidence_stability(V.panel(spark, sf), ["item"]).select("item", "repeats", *r9("mean", "sd", "range", "max_dev"))


_P = ", j AS (SELECT a.item, (a.decision <> b.decision)::INT AS d, abs(a.confidence - b.confidence) AS tv, a.confidence AS x, b.confidence AS y, (a.confidence + b.confidence) / 2 AS m FROM panel a JOIN panel b ON a.item = b.item AND a.repeat < b.repeat), j2 AS (SELECT item, d, tv, greatest(0, (CASE WHEN x > 0 THEN x * ln(x / m) ELSE 0 END + CASE WHEN x < 1 THEN (1 - x) * ln((1 - x) / (1 - m)) ELSE 0 END + CASE WHEN y > 0 THEN y * ln(y / m) ELSE 0 END + CASE WHEN y < 1 THEN (1 - y) * ln((1 - y) / (1 - m)) ELSE 0 END) / 2) AS js FROM j) "


@query(_P + "SELECT item, count(*)::INT AS pairs, round(avg(d), 9) AS pair_flip, round(avg(tv), 9) AS mean_tv, round(max(tv), 9) AS max_tv, round(avg(js), 8) + 0.0 AS mean_js, round(max(js), 8) + 0.0 AS max_js FROM j2 GROUP BY 1")
def distribution_stability(spark, sf):
    out = stability.pairwise(V.panel(spark, sf), ["item"], "probs")
    return out.select("item", F.col("pairs").cast("int").alias("pairs"), *r9("pair_flip", "mean_tv", "max_tv"), *[(F.round(c, 8) + 0.0).alias(c) for c in ("mean_js", "max_js")])


def _items(spark, sf, by=("item",)):
    p = V.panel(spark, sf)
    labels, conf = stability.label_stability(p, list(by)), stability.confidence_stability(p, list(by))
    return labels.join(conf.drop("repeats"), list(by))


_BOUND = ", i AS (SELECT item, avg(confidence) AS mean, (count(DISTINCT decision) > 1)::INT AS flips FROM panel GROUP BY 1), d AS (SELECT flips, abs(mean - 0.75) AS distance FROM i), k AS (SELECT *, least(9, floor(distance / (SELECT max(distance) FROM d) * 10)::INT) AS bin FROM d) "


@query(_BOUND + "SELECT bin, count(*) AS items, round(avg(flips), 9) AS flip_rate, round(avg(distance), 9) AS mean_distance, round((SELECT regr_slope(flips, distance) FROM d), 6) AS slope, round((SELECT corr(distance, flips) FROM d), 6) AS r FROM k GROUP BY 1")
def boundary_analysis(spark, sf):
    out = stability.boundary(_items(spark, sf), 0.75)
    return out.select("bin", "items", *r9("flip_rate", "mean_distance"), F.round("slope", 6).alias("slope"), F.round("r", 6).alias("r"))


@query(", i AS (SELECT tier, client, item, (count(DISTINCT decision) > 1)::INT AS flips FROM panel GROUP BY ALL) SELECT tier, client, count(*) AS items, round(avg(flips), 9) AS flip_rate FROM i GROUP BY GROUPING SETS ((), (tier), (client))")
def stability_by_groups(spark, sf):
    items = stability.label_stability(V.panel(spark, sf), ["tier", "client", "item"])
    return items.groupingSets([[], [F.col("tier")], [F.col("client")]], F.col("tier"), F.col("client")).agg(F.count("*").alias("items"), F.round(F.avg("flips"), 9).alias("flip_rate"))


@query(", i AS (SELECT client, tier, avg((decision = 'R')::INT) AS x FROM panel GROUP BY 1, 2) SELECT a.tier, round(a.x - b.x, 9) AS delta FROM i a JOIN i b USING (tier) WHERE a.client = 0 AND b.client = 1")
def paired_clients(spark, sf):
    rates = V.panel(spark, sf).groupBy("client", "tier").agg(F.avg((F.col("decision") == "R").cast("int")).alias("x"))
    a, b = (rates.where(F.col("client") == i).select("tier", F.col("x").alias(f"x{i}")) for i in (0, 1))
    return a.join(b, "tier").select("tier", F.round(F.col("x0") - F.col("x1"), 9).alias("delta"))


@query("SELECT round(avg(((p >= 0.5) <> (y2 >= 0.5))::INT), 9) AS disagreement, round(avg(p + y), 9) AS mean_sum, round(stddev_pop(p + y), 9) AS sd_sum, round(median(p + y), 9) AS median_sum, round(median(abs(p + y - 1)), 9) AS mad, round(avg(abs(p + y - 1)), 9) AS mean_distance, round(avg((abs(p + y - 1) > 0.05)::INT), 9) AS share_off FROM bina")
def primitive_checks(spark, sf):
    rows = V.binary(spark, sf)
    sums = agree.negation_sums(rows, "p", "y").withColumnsRenamed({"mean": "mean_sum", "sd": "sd_sum", "median": "median_sum"})
    rate = agree.primitive_disagreement(rows, F.col("p"), F.col("y2")).select(F.col("rate").alias("disagreement"))
    return sums.crossJoin(F.broadcast(rate)).select(*r9("disagreement", "mean_sum", "sd_sum", "median_sum", "mad", "mean_distance", "share_off"))


@query(", s AS (SELECT count(*) AS n, avg((y = y2)::INT) AS po, avg(y) * avg(y2) + avg(1 - y) * avg(1 - y2) AS pe FROM bina) SELECT n, round(po, 9) AS po, round(pe, 9) AS pe, round((po - pe) / (1 - pe), 9) AS kappa FROM s")
def cohens_kappa(spark, sf):
    return agree.kappa(V.binary(spark, sf), "y", "y2").select("n", *r9("po", "pe", "kappa"))


@query(", s AS (SELECT count(*) FILTER (pred = y AND y2 <> y) AS b, count(*) FILTER (pred <> y AND y2 = y) AS c FROM bina) SELECT b, c, round(CASE WHEN b + c > 0 THEN (abs(b - c) - 1) ** 2 / (b + c) ELSE 0 END, 9) AS statistic, round(CASE WHEN b + c > 0 THEN " + ERFC.format(x="sqrt((abs(b - c) - 1) ** 2 / (b + c) / 2)") + " ELSE 1 END, 6) AS p FROM s")
def mcnemar(spark, sf):
    rows = V.binary(spark, sf).select((F.col("pred") == F.col("y")).alias("a"), (F.col("y2") == F.col("y")).alias("b"))
    return resample.mcnemar(rows, [], "a", "b").select("b", "c", *r9("statistic"), F.round("p", 6).alias("p"))


@query("SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 9) AS p50, round(quantile_cont(value, 0.95), 9) AS p95, round(quantile_cont(value, 0.99), 9) AS p99, round(quantile_disc(value, 0.95), 9) AS p95_nearest FROM events GROUP BY 1")
def latency_percentiles(spark, sf):
    out = rank.quantiles(V.table(spark, sf, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, {"p95_nearest": 0.95})
    return out.select("event_type", "n", *r9("p50", "p95", "p99", "p95_nearest"))


@query("SELECT event_type, value, round(cume_dist() OVER (PARTITION BY event_type ORDER BY value), 9) AS share FROM events QUALIFY row_number() OVER (PARTITION BY event_type, value) = 1")
def latency_ecdf(spark, sf):
    return rank.ecdf(V.table(spark, sf, "events"), ["event_type"], "value").select("event_type", "value", *r9("share"))


_RC = ", g AS (SELECT conf, sum(correct) AS h, count(*) AS n FROM bina GROUP BY 1), c AS (SELECT conf AS threshold, sum(n) OVER w AS cn, sum(n) OVER w / (SELECT count(*) FROM bina) AS coverage, 1 - sum(h) OVER w / sum(n) OVER w AS risk FROM g WINDOW w AS (ORDER BY conf DESC)) "


@query(_RC + "SELECT round(threshold, 9) AS threshold, cn::BIGINT AS cum_n, round(coverage, 9) AS coverage, round(risk, 9) + 0.0 AS risk FROM c")
def risk_coverage(spark, sf):
    return rank.risk_coverage(V.binary(spark, sf), [], "conf", "correct").select(*r9("threshold"), "cum_n", *r9("coverage", "risk"))


@query(_RC + ", l AS (SELECT coverage, risk, lag(coverage, 1, 0) OVER (ORDER BY coverage) AS c0, coalesce(lag(risk) OVER (ORDER BY coverage), risk) AS r0 FROM c) SELECT round(sum((coverage - c0) * (risk + r0) / 2), 9) AS aurc FROM l")
def area_under_risk(spark, sf):
    return rank.aurc(V.binary(spark, sf), [], "conf", "correct").select(*r9("aurc"))


@query(_RC + "SELECT round(coalesce(max(coverage) FILTER (1 - risk + 1e-12 >= 0.6), 0), 9) AS coverage, round(min(threshold) FILTER (1 - risk + 1e-12 >= 0.6), 9) AS threshold FROM c")
def automation_at_accuracy(spark, sf):
    return rank.automation(rank.risk_coverage(V.binary(spark, sf), [], "conf", "correct"), [], 0.6).select(*r9("coverage", "threshold"))


@query(", r AS (SELECT rank() OVER (ORDER BY conf) + (count(*) OVER (PARTITION BY conf) - 1) / 2 AS a, rank() OVER (ORDER BY entropy) + (count(*) OVER (PARTITION BY entropy) - 1) / 2 AS b FROM cal) SELECT count(*) AS n, round(corr(a, b), 9) AS rho FROM r")
def spearman_conf_entropy(spark, sf):
    return rank.spearman(V.calibration(spark, sf), [], "conf", "entropy").select("n", *r9("rho"))


@query(", r AS (SELECT rank() OVER (ORDER BY conf) + (count(*) OVER (PARTITION BY conf) - 1) / 2 AS a, rank() OVER (ORDER BY entropy) + (count(*) OVER (PARTITION BY entropy) - 1) / 2 AS b, rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2 AS z FROM cal), f AS (SELECT regr_slope(a, z) AS sa, regr_intercept(a, z) AS ia, regr_slope(b, z) AS sb, regr_intercept(b, z) AS ib FROM r), e AS (SELECT round(a - ia - sa * z, 6) + 0.0 AS a, round(b - ib - sb * z, 6) + 0.0 AS b FROM r, f), s AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS a, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS b FROM e) SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM s")
def partial_spearman(spark, sf):
    out = rank.partial_spearman(V.calibration(spark, sf), "conf", "entropy", "n")
    return out.select("n", F.round("rho", 6).alias("rho"))


_U = "('0x' || substr(md5(concat_ws(':', {parts})), 1, 8))::BIGINT"
#: A Poisson(1) weight from the eight hex digits h.
_POI = "CASE " + " ".join(f"WHEN h < '{h}' THEN {k}" for k, h in enumerate(X.POISSON_HEX)) + f" ELSE {len(X.POISSON_HEX)} END"


@query(", m AS (SELECT min(c) AS least FROM (SELECT count(*) AS c FROM cal GROUP BY stratum)), k AS (SELECT item, stratum, row_number() OVER (PARTITION BY stratum ORDER BY " + _U.format(parts="20260923, item") + ", item) AS rn FROM cal) SELECT item, stratum FROM k, m WHERE rn <= least")
def equal_n_subsample(spark, sf):
    return resample.equal_n(V.calibration(spark, sf), "stratum", "item", 20260923).select("item", "stratum")


_BOOT = """, reps AS (SELECT unnest(range(100)) AS rep),
    h AS (SELECT {cols}, rep, substr(md5(concat_ws(':', 1, rep // 4, {item})), (rep % 4) * 8 + 1, 8) AS h FROM {src}, reps),
    w AS (SELECT *, """ + _POI + """ AS w FROM h) """


@query(_BOOT.format(cols="source, correct", item="doc_id", src="bina") + ", m AS (SELECT source, rep, sum(w * correct) / sum(w) AS m FROM w WHERE w > 0 GROUP BY 1, 2), ci AS (SELECT source, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY 1) SELECT source, count(*) AS n, round(avg(correct), 9) AS point, round(any_value(low), 9) AS low, round(any_value(high), 9) AS high FROM bina JOIN ci USING (source) GROUP BY 1")
def bootstrap_accuracy(spark, sf):
    return resample.bootstrap_mean(V.binary(spark, sf), ["source"], "correct", "doc_id").select("source", "n", *r9("point", "low", "high"))


_DE = "SELECT {by}, sum(n * abs(mc - mp)) / sum(n) AS ece FROM (SELECT {by}, bin, sum(w) AS n, sum(w * correct) / sum(w) AS mc, sum(w * conf) / sum(w) AS mp FROM {src} WHERE w > 0 GROUP BY {by}, bin) GROUP BY {by}"


@query(_BOOT.format(cols="stratum, bin, conf, correct", item="item", src="calb") + ", b AS (" + _DE.format(by="stratum, rep", src="w") + "), d AS (SELECT rep, max(ece) FILTER (stratum = 'hard') - max(ece) FILTER (stratum = 'easy') AS d FROM b GROUP BY 1), pt AS (" + _DE.format(by="stratum", src="(SELECT *, 1 AS w FROM calb)") + "), q AS (SELECT max(ece) FILTER (stratum = 'hard') AS h, max(ece) FILTER (stratum = 'easy') AS e FROM pt) SELECT round(h, 9) AS ece_hard, round(e, 9) AS ece_easy, round(h - e, 9) AS delta, round((SELECT quantile_cont(d, 0.025) FROM d), 9) AS low, round((SELECT quantile_cont(d, 0.975) FROM d), 9) AS high, round((SELECT avg((d <= 0)::INT) FROM d), 9) AS share_low, round((SELECT avg((d >= 0)::INT) FROM d), 9) AS share_high FROM q")
def delta_ece(spark, sf):
    out = resample.delta_ece(V.calibration(spark, sf), "stratum", "hard", "easy", X.bin_digitize(F.col("conf"), 10), "item")
    return out.select(*r9("ece_hard", "ece_easy", "delta", "low", "high", "share_low", "share_high"))


@query()
def expected_ece(spark, sf):
    return resample.expected_ece(V.calibration(spark, sf), ["stratum"]).select("stratum", *r9("expected_ece"))


@query()
def corrected_delta_ece(spark, sf):
    """The difference of ECE less that of expected ECE, with interval, p and, against a small table of differences, the verdict."""
    reference = spark.range(100).select((F.col("id") / 1000.0).alias("d"))
    out = resample.corrected_delta_ece(V.calibration(spark, sf), "stratum", "hard", "easy", "item", reference=reference)
    return out.select(*r9("raw", "bias", "corrected", "low", "high", "p", "p_holds"), "n_extreme", "verdict")


_T = [0.25, 0.5, 1.0, 2.0, 4.0, 8.0]


@query(f", t AS (SELECT unnest({_T}) AS t), x AS (SELECT stratum, t, [greatest(p, 1e-12) ** (1 / t) FOR p IN probs] AS u, label_dist FROM cal, t), y AS (SELECT stratum, t, [v / list_sum(u) FOR v IN u] AS q, label_dist FROM x) SELECT stratum, t, round(avg(-list_sum([label_dist[i] * ln(greatest(q[i], 1e-12)) FOR i IN [1, 2, 3]])), 8) AS loss FROM y GROUP BY 1, 2")
def temperature_grid(spark, sf):
    """Log loss against human shares at each temperature: one pass for the whole grid."""
    rows = V.calibration(spark, sf).withColumn("t", F.explode(F.array(*[F.lit(t) for t in _T])))
    rows = rows.withColumn("q", X.tempered(F.col("probs"), F.col("t")))
    loss = -X.total(F.zip_with("label_dist", "q", lambda h, q: h * F.ln(F.greatest(q, F.lit(1e-12)))))
    return rows.groupBy("stratum", "t").agg(F.round(F.avg(loss), 8).alias("loss"))


@query("SELECT client, pass, round(avg(ok), 9) AS accuracy FROM (SELECT client, repeat AS pass, (decision = 'N')::INT AS ok FROM panel) GROUP BY 1, 2")
def accuracy_by_pass(spark, sf):
    return V.panel(spark, sf).groupBy("client", F.col("repeat").alias("pass")).agg(F.round(F.avg((F.col("decision") == "N").cast("int")), 9).alias("accuracy"))


_PASS = ", t AS (SELECT client, repeat AS pass, len([x FOR x IN e IF x <= confidence]) AS bin, count(*) AS n, avg((decision = 'N')::INT) AS mc, avg(confidence) AS mp FROM panel, edges GROUP BY ALL), s AS (SELECT client, pass, sum(n)::DOUBLE AS n, sum(n * mc) / sum(n) AS accuracy, sum(n * abs(mc - mp)) / sum(n) AS ece FROM t GROUP BY 1, 2), r AS (SELECT client, count(*) AS passes, CASE WHEN count(*) > 1 THEN max(accuracy) - min(accuracy) END AS accuracy_range, CASE WHEN count(*) > 1 THEN max(ece) - min(ece) END AS ece_range FROM s GROUP BY 1) "


@query(_PASS + "SELECT client, pass, n, round(accuracy, 9) AS accuracy, round(ece, 9) + 0.0 AS ece, passes, round(accuracy_range, 9) + 0.0 AS accuracy_range, round(ece_range, 9) + 0.0 AS ece_range, (accuracy_range > 0.05 OR ece_range > 0.02) AS material_move FROM s JOIN r USING (client)")
def stability_by_pass(spark, sf):
    rows = V.panel(spark, sf).withColumnRenamed("confidence", "conf").withColumn("correct", (F.col("decision") == "N").cast("int"))
    out = stability.by_pass(rows.withColumnRenamed("repeat", "pass"), "client", "pass")
    return out.select("client", "pass", "n", *r9("accuracy", "ece"), "passes", *r9("accuracy_range", "ece_range"), "material_move")


@query("SELECT source, lang, count(*) AS n, round(avg(correct), 9) AS accuracy, round(avg(conf), 9) AS mean_conf, sum(pred)::BIGINT AS positives FROM bina GROUP BY GROUPING SETS ((lang), (lang, source))")
def client_blocks(spark, sf):
    return V.binary(spark, sf).groupingSets([[F.col("lang")], [F.col("lang"), F.col("source")]], F.col("source"), F.col("lang")).agg(F.count("*").alias("n"), F.round(F.avg("correct"), 9).alias("accuracy"), F.round(F.avg("conf"), 9).alias("mean_conf"), F.sum("pred").alias("positives"))


@query("SELECT conv_id, turn, CASE WHEN length(text) = 0 OR text IS NULL THEN 0 ELSE greatest(1, (length(text) + 3) // 4) END::BIGINT AS tokens FROM conversations")
def estimated_tokens(spark, sf):
    return V.table(spark, sf, "conversations").select("conv_id", "turn", agree.estimated_tokens(F.col("text")).alias("tokens"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)(?:password|token)') THEN 'secret' WHEN regexp_matches(text, '(?i)(?:license|copyright)') THEN 'legal' ELSE 'other' END AS label FROM documents")
def rule_labels(spark, sf):
    rules = [("secret", ["password", "token"]), ("legal", ["license", "copyright"])]
    return V.table(spark, sf, "documents").select("doc_id", agree.rule_label(F.col("text"), rules, "other").alias("label"))


@query("SELECT role, round(sum(length(text) * CASE role WHEN 'user' THEN 0.042 ELSE 0.1 END) / 1e6, 9) AS cost FROM conversations WHERE role IN ('user', 'assistant') GROUP BY 1")
def token_costs(spark, sf):
    prices = spark.createDataFrame([("user", 0.042, 0.0), ("assistant", 0.1, 0.0)], "suffix string, input_rate double, output_rate double")
    usage = V.table(spark, sf, "conversations").select(F.col("role").alias("model"), F.length("text").alias("input_tokens"), F.lit(0).alias("output_tokens"))
    return agree.priced(usage, prices).where("cost is not null").groupBy(F.col("model").alias("role")).agg(F.round(F.sum("cost"), 9).alias("cost"))


@query(", d AS (SELECT o_orderdate::DATE AS day, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY 1) SELECT day, spent, round(sum(spent) OVER (ORDER BY day), 2) AS running FROM d")
def running_budget(spark, sf):
    from pyspark.sql import Window

    days = V.table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    return days.withColumn("running", F.round(F.sum("spent").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)), 2))  # one row a day


@query(", e AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS previous FROM events) SELECT event_id, user_id, event_type, previous FROM e WHERE previous <> event_type")
def version_changes(spark, sf):
    e = V.table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return stability.version_changes(e, "user_id", ["ts", "event_id"], "event_type", "day").select("event_id", "user_id", "event_type", "previous")


@query("SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)) AS repeated_items, (SELECT count(*) FROM (SELECT doc_id FROM labels GROUP BY 1 HAVING count(*) > 1)) AS repeated_labels, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS items_without_label, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS labels_without_item")
def dataset_validation(spark, sf):
    return jsonl.validated(V.table(spark, sf, "documents").select("doc_id"), V.table(spark, sf, "labels").select("doc_id"), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_units(spark, sf):
    required = V.table(spark, sf, "documents").select(F.col("doc_id").alias("unit_key"))
    done = V.table(spark, sf, "labels").select(F.col("doc_id").alias("unit_key")).distinct()
    return jsonl.pending(required, done).select(F.col("unit_key").alias("doc_id"))


@query("SELECT r_name AS client, pass, n_name AS item FROM region, nation, (SELECT unnest(range(3)) AS pass) WHERE r_regionkey = n_regionkey")
def work_plan(spark, sf):
    n = V.table(spark, sf, "nation").select(F.col("n_name").alias("item"), "n_regionkey")
    clients = V.table(spark, sf, "region").select(F.col("r_name").alias("client"), F.lit(3).cast("long").alias("repeats"), "r_regionkey")
    regions = clients.select("client", "r_regionkey")
    plan = agree.work_plan(clients.select("client", "repeats"), n.select("item"))
    own = n.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select("client", "item")
    return plan.join(own, ["client", "item"]).select("client", "pass", "item")


@query("""SELECT conv_id, turn, sha256('{"questions":[{"kind":"choice","name":"relation"},{"kind":"noul","name":"follows"}],"state":{"pair_id":' || turn || ',"source":"' || role || '"}}') AS digest FROM conversations WHERE role IS NOT NULL AND turn IS NOT NULL""")
def request_digests(spark, sf):
    c = V.table(spark, sf, "conversations").where("role is not null and turn is not null")
    questions = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name")) for kind, name in (("choice", "relation"), ("noul", "follows"))])
    state = {"source": F.col("role"), "pair_id": F.col("turn"), "text": F.col("text")}
    return c.select("conv_id", "turn", records.request_digest(state, questions).alias("digest"))


@query("SELECT tier, client, item FROM (SELECT tier, client, item, row_number() OVER (PARTITION BY client, item ORDER BY repeat) AS rn FROM panel) WHERE rn = 1")
def first_pass(spark, sf):
    p = V.panel(spark, sf).select("tier", "client", F.col("item").alias("item_id"), F.col("repeat").alias("pass"), F.col("repeat").alias("seq"))
    return records.first_pass(p, ["client", "item_id"]).select("tier", "client", F.col("item_id").alias("item"))

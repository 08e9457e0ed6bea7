"""Queries of resampled inference and of the tables built on it, each with SQL that repeats the keyed draws."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions import expr as X
from plumbline.operators import agree, calibrate, fits, fixed, rank, rankboot, resample, stability
from plumbline.plans import views as V
from plumbline.plans.queries import _BOOT, _DE, _DIV, _KL, _P, _Q, _U, horner, query, r9

_CI = "round(quantile_cont({x}, 0.025), 9) + 0.0 AS low, round(quantile_cont({x}, 0.975), 9) + 0.0 AS high"
_FLIPS = ", i AS (SELECT client, item, (count(DISTINCT decision) > 1)::INT AS flips FROM panel GROUP BY 1, 2)"


def _items(spark, sf):
    return stability.label_stability(V.panel(spark, sf), ["client", "item"])


@query(_FLIPS + _BOOT.format(cols="client, flips", item="item", src="i") + """,
    m AS (SELECT client, rep, sum(w * flips) / sum(w) AS m FROM w WHERE w > 0 GROUP BY 1, 2),
    ci AS (SELECT client, """ + _CI.format(x="m") + """ FROM m GROUP BY 1)
    SELECT client, count(*) AS n, round(avg(flips), 9) AS point, any_value(low) AS low, any_value(high) AS high FROM i JOIN ci USING (client) GROUP BY 1""")
def flip_rate_interval(spark, sf):
    return stability.flip_rate(_items(spark, sf), ["client"], "item").select("client", "n", *r9("point", "low", "high"))


@query(_FLIPS + ", p AS (SELECT a.item, a.flips - b.flips AS d FROM i a JOIN i b USING (item) WHERE a.client = 0 AND b.client = 1)" + _BOOT.format(cols="d", item="item", src="p") + """,
    m AS (SELECT rep, sum(w * d) / sum(w) AS m FROM w WHERE w > 0 GROUP BY 1),
    ci AS (SELECT """ + _CI.format(x="m") + """ FROM m)
    SELECT (SELECT count(*) FROM p) AS n, (SELECT round(avg(d), 9) + 0.0 FROM p) AS point, low, high, (low < 0 AND high > 0) AS crosses_zero FROM ci""")
def paired_flip_rates(spark, sf):
    out = stability.compared_flip_rates(_items(spark, sf), "client", 0, 1, "item")
    return out.select("n", *r9("point", "low", "high"), "crosses_zero")


_PANEL = _P + """, i AS (SELECT item, min(tier) AS tier, min(o_orderstatus) AS path, array_to_string(list_sort(list_distinct(list(client::VARCHAR))), ',') AS client, count(*) AS repeats, (count(DISTINCT decision) > 1)::INT AS flips, coalesce(stddev_samp(confidence), 0) AS sd, max(confidence) - min(confidence) AS range, greatest(max(confidence) - avg(confidence), avg(confidence) - min(confidence)) AS max_dev, round(abs(avg(confidence) - 0.75), 12) AS distance FROM panel JOIN orders ON item = o_orderkey GROUP BY 1),
    pw AS (SELECT item, avg(tv) AS mean_tv, max(tv) AS max_tv, avg(js) AS mean_js, max(js) AS max_js FROM j2 GROUP BY 1),
    e0 AS (SELECT quantile_cont(distance, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM i),
    e AS (SELECT [list_max([round(q[k], 12) + (n - k) * 1e-12 FOR k IN range(1, n + 1)]) FOR n IN range(2, 11)] AS edges FROM e0),
    d AS (SELECT i.*, coalesce(mean_tv, 0) AS mean_tv, coalesce(max_tv, 0) AS max_tv, coalesce(mean_js, 0) AS mean_js, coalesce(max_js, 0) AS max_js, len([x FOR x IN edges IF x <= distance])::VARCHAR AS decile FROM i LEFT JOIN pw USING (item), e),
    x AS (SELECT 'all' AS kind, '' AS key, * FROM d UNION ALL SELECT 'tier', tier, * FROM d UNION ALL SELECT 'path', path, * FROM d UNION ALL SELECT 'client', client, * FROM d UNION ALL SELECT 'decile', decile, * FROM d)"""


@query(_PANEL + _BOOT.format(cols="kind, key, flips", item="item", src="x") + """, b AS (SELECT kind, key, rep, sum(w * flips) / sum(w) AS m FROM w WHERE w > 0 GROUP BY 1, 2, 3), ci AS (SELECT kind, key, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM b GROUP BY 1, 2)
    SELECT kind, key, count(*) AS items, max(repeats) AS repeats, sum(flips)::BIGINT AS flipped, round(avg(flips), 9) AS flip_rate, round(any_value(low), 9) AS low, round(any_value(high), 9) AS high, round(avg(sd), 9) AS mean_sd, round(avg(range), 9) AS mean_range, round(avg(max_dev), 9) AS mean_max_dev, round(avg(mean_tv), 9) AS mean_tv, round(avg(max_tv), 9) AS mean_max_tv, round(avg(mean_js), 8) AS mean_js, round(avg(max_js), 8) AS mean_max_js, round(max(max_js), 8) AS max_js FROM x JOIN ci USING (kind, key) GROUP BY 1, 2""")
def full_stability_panel(spark, sf):
    """Every measure of stability over all orders, by priority, state, clients and decile of distance to 0.75."""
    states = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("item"), F.col("o_orderstatus").alias("path"))
    out = stability.stability_panel(V.panel(spark, sf).join(states, "item"), "item", "probs", 0.75, ["tier", "path"], "client")
    js = [F.round(c, 8).alias(c) for c in ("mean_js", "mean_max_js", "max_js")]
    return out.select("kind", "key", "items", "repeats", "flipped", *r9("flip_rate", "low", "high", "mean_sd", "mean_range", "mean_max_dev", "mean_tv", "mean_max_tv"), *js)


_RIGHT = ", r AS (SELECT item, client, max((decision = 'N')::INT) AS ok FROM panel GROUP BY 1, 2), p AS (SELECT a.item, a.ok - b.ok AS d FROM r a JOIN r b USING (item) WHERE a.client = 0 AND b.client = 2)"


@query(_RIGHT + _BOOT.format(cols="d", item="item", src="p") + """,
    m AS (SELECT rep, sum(w * d) / sum(w) AS m FROM w WHERE w > 0 GROUP BY 1), ci AS (SELECT """ + _CI.format(x="m") + """ FROM m)
    SELECT (SELECT count(*) FROM p) AS n, (SELECT round(avg(d), 9) + 0.0 FROM p) AS point, low, high, (low < 0 AND high > 0) AS crosses_zero FROM ci""")
def paired_accuracy_difference(spark, sf):
    rows = V.panel(spark, sf).groupBy("item", "client").agg(F.max((F.col("decision") == "N").cast("int")).alias("ok"))
    return resample.paired_difference(rows, "item", "client", 0, 2, "ok").select("n", *r9("point", "low", "high"), "crosses_zero")


_PANELB = ", pb AS (SELECT item, client, confidence AS conf, (decision = 'N')::INT AS correct, len([x FOR x IN e IF x <= confidence]) AS bin FROM (SELECT *, row_number() OVER (PARTITION BY item, client ORDER BY repeat) AS rn FROM panel), edges WHERE rn = 1)"


def _first(spark, sf):
    p = V.panel(spark, sf).groupBy("item", "client").agg(F.min_by(F.struct(F.col("confidence").alias("conf"), (F.col("decision") == "N").cast("int").alias("correct")), "repeat").alias("r"))
    return p.select("item", "client", "r.*")


@query(_PANELB + ", sides AS (SELECT * FROM pb WHERE client IN (0, 1) AND item IN (SELECT item FROM pb WHERE client IN (0, 1) GROUP BY 1 HAVING count(*) = 2))" + _BOOT.format(cols="client, bin, conf, correct", item="item", src="sides") + ", b AS (" + _DE.format(by="client, rep", src="w") + """),
    d AS (SELECT rep, max(ece) FILTER (client = 0) - max(ece) FILTER (client = 1) AS d FROM b GROUP BY 1),
    pt AS (""" + _DE.format(by="client", src="(SELECT *, 1 AS w FROM sides)") + """)
    SELECT round(max(ece) FILTER (client = 0), 9) AS ece_a, round(max(ece) FILTER (client = 1), 9) AS ece_b, round(max(ece) FILTER (client = 0) - max(ece) FILTER (client = 1), 9) AS delta,
    (SELECT round(quantile_cont(d, 0.025), 9) FROM d) AS low, (SELECT round(quantile_cont(d, 0.975), 9) FROM d) AS high FROM pt""")
def paired_delta_ece(spark, sf):
    return resample.paired_delta_ece(_first(spark, sf), "item", "client", 0, 1).select(*r9("ece_a", "ece_b", "delta", "low", "high"))


_JACK = """, g AS (SELECT stratum, bin, sum(conf) - sum(correct) AS gap, count(*) AS n FROM calb WHERE stratum <> 'mid' GROUP BY 1, 2),
    t AS (SELECT stratum, sum(abs(gap)) AS s, sum(n) AS n FROM g GROUP BY 1),
    o AS (SELECT max(s / n) FILTER (stratum = 'hard') AS h, max(s / n) FILTER (stratum = 'easy') AS e FROM t),
    j0 AS (SELECT c.item, c.stratum, (t.s - abs(g.gap) + abs(g.gap - c.conf + c.correct)) / (t.n - 1) AS less FROM calb c JOIN g USING (stratum, bin) JOIN t USING (stratum)),
    j AS (SELECT item, CASE stratum WHEN 'hard' THEN less - e ELSE h - less END AS left_out FROM j0, o),
    jm AS (SELECT avg(left_out) AS mean FROM j),
    acc AS (SELECT sum((mean - left_out) ** 3) / (6 * sum((mean - left_out) ** 2) ** 1.5) AS a FROM j, jm) """


@query(_JACK + "SELECT item, round(left_out, 9) AS left_out FROM j")
def jackknife_delta_ece(spark, sf):
    rows = resample.binned(V.calibration(spark, sf), "stratum", "hard", "easy", X.bin_digitize(F.col("conf"), 10), "item")
    return resample.jackknife(rows, "stratum", "hard", "easy").select("item", *r9("left_out"))


def _quantile_sql(p: str) -> str:
    far = lambda q: f"({horner(X.TAIL[0], q)} / {horner(X.TAIL[1], q)})"
    mid = f"(({p} - 0.5) * {horner(X.MIDDLE[0], f'(({p} - 0.5) ** 2)')} / {horner(X.MIDDLE[1], f'(({p} - 0.5) ** 2)')})"
    return f"CASE WHEN {p} < 0.02425 THEN {far(f'sqrt(-2 * ln({p}))')} WHEN {p} > 0.97575 THEN -{far(f'sqrt(-2 * ln(1 - {p}))')} ELSE {mid} END"


@query(_JACK + _BOOT.format(cols="stratum, bin, conf, correct", item="item", src="calb") + ", b AS (" + _DE.format(by="stratum, rep", src="w") + """),
    d AS (SELECT rep, max(ece) FILTER (stratum = 'hard') - max(ece) FILTER (stratum = 'easy') AS d FROM b GROUP BY 1),
    pt AS (SELECT h - e AS point FROM o), sh AS (SELECT greatest(1 / 101, least(100 / 101, avg((d < point)::INT))) AS p FROM d, pt),
    z AS (SELECT """ + _quantile_sql("p") + """ AS z0, a FROM sh, acc)
    SELECT round(point, 9) AS point, round(a, 7) AS a, round(z0, 6) AS z0 FROM pt, z""")
def delta_ece_bca(spark, sf):
    """Point, acceleration and bias; the ends, which are quantiles at approximated places, are tested against numpy."""
    out = resample.delta_ece_bca(V.calibration(spark, sf), "stratum", "hard", "easy", X.bin_digitize(F.col("conf"), 10), "item")
    return out.select(*r9("point"), F.round("a", 7).alias("a"), F.round("z0", 6).alias("z0"))


@query(_BOOT.format(cols="p, y", item="doc_id", src="bina") + """,
    k AS (SELECT rep, p, sum(w * y) AS pos, sum(w * (1 - y)) AS neg FROM w WHERE w > 0 GROUP BY 1, 2),
    c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY rep ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM k),
    a AS (SELECT rep, sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS area FROM c GROUP BY 1),
    k1 AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM bina GROUP BY 1),
    c1 AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM k1)
    SELECT (SELECT round(sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0), 9) FROM c1) AS auroc, """ + _CI.format(x="area") + " FROM a")
def auroc_interval(spark, sf):
    return resample.auroc_bootstrap(V.binary(spark, sf), "p", "y", "doc_id").select(*r9("auroc", "low", "high"))


#: Ranks of {x} weighted by w, ties averaged, in every replicate of {src}.
_WRANK = "(SELECT rep, {x}, sum(t) OVER (PARTITION BY rep ORDER BY {x}) - t + (t + 1) / 2 AS r{x} FROM (SELECT rep, {x}, sum(w) AS t FROM {src} WHERE w > 0 GROUP BY 1, 2))"
_WRHO = "(sum(w * r{a} * r{b}) / sum(w) - sum(w * r{a}) / sum(w) * sum(w * r{b}) / sum(w)) / sqrt((sum(w * r{a} * r{a}) / sum(w) - (sum(w * r{a}) / sum(w)) ** 2) * (sum(w * r{b} * r{b}) / sum(w) - (sum(w * r{b}) / sum(w)) ** 2))"
_AREA = "(SELECT rep, sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS area FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY rep ORDER BY {x} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT rep, {x}, sum(w * y) AS pos, sum(w * (1 - y)) AS neg FROM {src} WHERE w > 0 GROUP BY 1, 2)) GROUP BY 1)"


@query(", c9 AS (SELECT item, round(conf, 9) AS conf, entropy FROM cal)" + _BOOT.format(cols="conf, entropy", item="item", src="c9") + ", o AS (SELECT 0 AS rep, *, 1 AS w FROM c9), rc AS " + _WRANK.format(x="conf", src="w") + ", re AS " + _WRANK.format(x="entropy", src="w") + ", oc AS " + _WRANK.format(x="conf", src="o") + ", oe AS " + _WRANK.format(x="entropy", src="o") + """,
    s AS (SELECT rep, """ + _WRHO.format(a="conf", b="entropy") + """ AS rho FROM w JOIN rc USING (rep, conf) JOIN re USING (rep, entropy) WHERE w > 0 GROUP BY 1)
    SELECT (SELECT round(""" + _WRHO.format(a="conf", b="entropy") + ", 9) FROM o JOIN oc USING (rep, conf) JOIN oe USING (rep, entropy)) AS point, " + _CI.format(x="rho") + ", count(rho) AS replicates FROM s")
def spearman_interval(spark, sf):
    rows = V.calibration(spark, sf).select("item", F.round("conf", 9).alias("conf"), "entropy")
    return rankboot.interval(rows, "spearman", "conf", "entropy", "item").select("replicates", *r9("point", "low", "high"))


@query(_BOOT.format(cols="p, conf, y", item="doc_id", src="bina") + ", o AS (SELECT 0 AS rep, *, 1 AS w FROM bina), a AS " + _AREA.format(x="p", src="w") + ", b AS " + _AREA.format(x="conf", src="w") + ", oa AS " + _AREA.format(x="p", src="o") + ", ob AS " + _AREA.format(x="conf", src="o") + """,
    d AS (SELECT a.area - b.area AS d FROM a JOIN b USING (rep)), ci AS (SELECT """ + _CI.format(x="d") + """, count(d) AS replicates FROM d)
    SELECT round(oa.area - ob.area, 9) AS point, low, high, replicates, (low < 0 AND high > 0) AS crosses_zero FROM oa, ob, ci""")
def paired_auroc_difference(spark, sf):
    rows = V.binary(spark, sf)
    return rankboot.difference(rows, "auroc", "p", "conf", "y", "doc_id").select("replicates", "crosses_zero", *r9("point", "low", "high"))


#: Both tails of Student's t for a whole number of degrees of freedom, by its finite sum over powers of a cosine.
_TAILS = """1 - CASE WHEN {v} % 2 = 0 THEN sin({th}) * (1 + coalesce(list_sum([exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1)) * cos({th}) ** (2 * j) FOR j IN range(1, {v} // 2)]), 0))
    ELSE 2 / pi() * ({th} + CASE WHEN {v} = 1 THEN 0 ELSE sin({th}) * cos({th}) * (1 + coalesce(list_sum([exp(lgamma(j + 1) + lgamma(1.5) - lgamma(j + 1.5)) * cos({th}) ** (2 * j) FOR j IN range(1, ({v} - 1) // 2)]), 0)) END) END"""


@query(""", g0 AS (SELECT item, [round(conf, 9), entropy, round(list_reverse_sort(probs)[1] - list_reverse_sort(probs)[2], 9), round((abs(probs[1] - label_dist[1]) + abs(probs[2] - label_dist[2]) + abs(probs[3] - label_dist[3])) / 2, 9)] AS v FROM cal),
    g AS (SELECT item, k, v[k] AS x FROM g0, (SELECT unnest([1, 2, 3, 4]) AS k)),
    r AS (SELECT item, k, rank() OVER (PARTITION BY k ORDER BY x) + (count(*) OVER (PARTITION BY k, x) - 1) / 2 AS r FROM g),
    q AS (SELECT a.k AS ka, b.k AS kb, count(*) AS n, corr(a.r, b.r) AS rho FROM r a JOIN r b USING (item) WHERE a.k < b.k GROUP BY 1, 2),
    t AS (SELECT *, (n - 2)::BIGINT AS v, atan(abs(rho) * sqrt((n - 2) / (1 - rho * rho)) / sqrt(n - 2)) AS th FROM q)
    SELECT ['conf', 'entropy', 'margin', 'tvd'][ka] AS a, ['conf', 'entropy', 'margin', 'tvd'][kb] AS b, n, round(rho, 9) AS rho, round(""" + _TAILS.format(v="v", th="th") + ", 9) + 0.0 AS p FROM t")
def rank_correlations(spark, sf):
    """The six pairs of four signals, with p."""
    p, d = F.col("probs"), F.col("label_dist")
    rows = V.calibration(spark, sf).select("item", "entropy", *[F.round(c, 9).alias(n) for n, c in (("conf", F.col("conf")), ("margin", X.margin(p)), ("tvd", X.tvd(p, d)))])
    return rank.rank_matrix(rows, "item", ["conf", "entropy", "margin", "tvd"]).select("a", "b", "n", *r9("rho", "p"))


@query()
def delta_ece_fixed_n(spark, sf):
    """The difference of ECE with replicates of as many rows as each stratum has; a tree of binomials has no SQL."""
    out = fixed.delta_ece(V.calibration(spark, sf), "stratum", "hard", "easy", X.bin_digitize(F.col("conf"), 10), "item")
    return out.select(*r9("ece_hard", "ece_easy", "delta", "low", "high"))


_SLOPES = """SELECT {rep} count(*) AS tiers, CASE WHEN min(n) >= 2 AND max(accuracy) - min(accuracy) > 1e-9 THEN regr_slope(ece, accuracy) END AS slope FROM (
    SELECT {rep} lang, sum(n) AS n, sum(n * abs(mc - mp)) / sum(n) AS ece, sum(n * mc) / sum(n) AS accuracy FROM (
    SELECT {rep} lang, bin, sum(w) AS n, sum(w * correct) / sum(w) AS mc, sum(w * conf) / sum(w) AS mp FROM {src} WHERE w > 0 GROUP BY ALL) GROUP BY ALL) {end}"""


@query(", bb AS (SELECT bina.*, len([x FOR x IN e IF x <= conf]) AS bin FROM bina, edges)" + _BOOT.format(cols="lang, bin, conf, correct", item="doc_id", src="bb") + ", s AS (" + _SLOPES.format(rep="rep,", src="w", end="GROUP BY rep") + "), p AS (" + _SLOPES.format(rep="", src="(SELECT *, 1 AS w FROM bb)", end="") + """),
    u AS (SELECT CASE WHEN s.tiers = p.tiers THEN s.slope END AS slope FROM s, p)
    SELECT tiers, round(p.slope, 6) AS slope, (SELECT count(slope) FROM u) AS replicates, (SELECT round(quantile_cont(slope, 0.025), 6) FROM u) AS low, (SELECT round(quantile_cont(slope, 0.975), 6) FROM u) AS high FROM p""")
def slope_interval(spark, sf):
    out = resample.slope_interval(V.binary(spark, sf), "lang", "doc_id")
    return out.select("tiers", "replicates", *[F.round(c, 6).alias(c) for c in ("slope", "low", "high")])


@query(""", v AS (SELECT p_partkey, (p_size % 20) / 100 - 0.02 AS corrected, (p_partkey % 100) / 1000 AS p, (p_partkey % 37) / 500 AS ph, p_size % 3 AS extreme FROM part)
    SELECT p_partkey, CASE WHEN corrected >= 0.09 AND p < 0.05 AND NOT (ph < 0.05 AND corrected <= 0.02) THEN 'tracks' WHEN ph < 0.05 AND corrected <= 0.02 AND NOT (corrected >= 0.09 AND p < 0.05) THEN 'holds' ELSE 'inconclusive' END AS verdict,
    CASE WHEN extreme = 0 THEN 'p < 1/2001' ELSE 'p = ' || printf('%.4f', p) END AS shown FROM v""")
def verdicts(spark, sf):
    v = V.table(spark, sf, "part").select("p_partkey", ((F.col("p_size") % 20) / 100 - 0.02).alias("corrected"), ((F.col("p_partkey") % 100) / 1000).alias("p"), ((F.col("p_partkey") % 37) / 500).alias("ph"), (F.col("p_size") % 3).alias("extreme"))
    return v.select("p_partkey", agree.verdict(F.col("corrected"), F.col("p"), F.col("ph")).alias("verdict"), X.p_display(F.col("p"), F.col("extreme"), 2000).alias("shown"))


@query(", ref AS (SELECT o_totalprice AS d FROM orders WHERE o_orderkey % 50 = 1) SELECT c_custkey, round((SELECT avg((d <= c_acctbal * 30)::INT) FROM ref), 9) AS p_holds FROM customer")
def p_holds(spark, sf):
    reference = V.table(spark, sf, "orders").where("o_orderkey % 50 = 1").select(F.col("o_totalprice").alias("d"))
    rows = V.table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") * 30).alias("x"))
    return resample.p_holds(rows, reference, "x").select("c_custkey", *r9("p_holds"))


@query(", e0 AS (" + _DE.format(by="pass, tier", src="(SELECT repeat AS pass, tier, confidence AS conf, (decision = 'N')::INT AS correct, least(9, floor(confidence * 10)::INT) AS bin, 1 AS w FROM panel)") + """),
    d AS (SELECT pass, max(ece) FILTER (tier = '1-URGENT') - max(ece) FILTER (tier = '5-LOW') AS delta FROM e0 GROUP BY 1)
    SELECT pass, round(delta, 9) AS delta, round((SELECT min(delta) FROM d), 9) AS least, round((SELECT max(delta) FROM d), 9) AS most FROM d WHERE delta IS NOT NULL""")
def pass_sensitivity(spark, sf):
    """The raw difference of ECE in every pass, with its range over passes."""
    rows = V.panel(spark, sf).select(F.col("repeat").alias("pass"), "tier", F.col("confidence").alias("conf"), (F.col("decision") == "N").cast("int").alias("correct"))
    e = calibrate.ece(calibrate.reliability(rows, ["pass", "tier"], X.bin_floor(F.col("conf"), 10)), ["pass", "tier"])
    pick = lambda t: F.max(F.when(F.col("tier") == t, F.col("ece")))
    d = e.groupBy("pass").agg((pick("1-URGENT") - pick("5-LOW")).alias("delta")).where("delta is not null")
    ends = d.agg(F.min("delta").alias("least"), F.max("delta").alias("most"))
    return d.crossJoin(F.broadcast(ends)).select("pass", *r9("delta", "least", "most"))


_SIG = """, s0 AS (SELECT item, stratum, entropy, [('top', 1 - conf), ('margin', round(list_reverse_sort(probs)[1] - list_reverse_sort(probs)[2], 9)), ('tvd', round((abs(probs[1] - label_dist[1]) + abs(probs[2] - label_dist[2]) + abs(probs[3] - label_dist[3])) / 2, 9))] AS u FROM cal),
    s1 AS (SELECT item, stratum, entropy, unnest(u) AS u FROM s0), sg AS (SELECT item, stratum, entropy, u[1] AS signal, round(u[2], 9) AS x FROM s1)"""


@query(_SIG + """, g AS (SELECT signal, x, count(*) FILTER (stratum = 'hard') AS pos, count(*) FILTER (stratum = 'easy') AS neg FROM sg WHERE stratum <> 'mid' GROUP BY 1, 2),
    h AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY signal ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g),
    a AS (SELECT signal, round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 9) AS auroc FROM h GROUP BY 1),
    r AS (SELECT signal, rank() OVER (PARTITION BY signal ORDER BY x) + (count(*) OVER (PARTITION BY signal, x) - 1) / 2 AS ra, rank() OVER (PARTITION BY signal ORDER BY entropy) + (count(*) OVER (PARTITION BY signal, entropy) - 1) / 2 AS rb FROM sg),
    p AS (SELECT signal, count(*) AS n, round(corr(ra, rb), 9) AS rho FROM r GROUP BY 1)
    SELECT signal, n, rho, auroc FROM p JOIN a USING (signal)""")
def ambiguity_signals(spark, sf):
    """How well each signal tells hard from easy items, and follows their entropy."""
    p, d = F.col("probs"), F.col("label_dist")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("signal"), F.round(c, 9).alias("x")) for n, c in (("top", 1 - F.col("conf")), ("margin", X.margin(p)), ("tvd", X.tvd(p, d)))]))
    rows = V.calibration(spark, sf).select("item", "stratum", "entropy", each.alias("s")).select("item", "stratum", "entropy", "s.*")
    area = rank.auroc(rows.where("stratum <> 'mid'").withColumn("y", (F.col("stratum") == "hard").cast("int")), ["signal"], "x", "y")
    return rank.spearman(rows, ["signal"], "x", "entropy").join(area, "signal").select("signal", "n", *r9("rho", "auroc"))


_LOSS = """, t AS (SELECT unnest([round(0.05 * (2000 ** (i / 199)), 6) FOR i IN range(200)]) AS t),
    x AS (SELECT stratum, t, [ln(greatest(p, 1e-12)) / t FOR p IN probs] AS u, label_dist FROM cal, t),
    y AS (SELECT stratum, t, [v - (list_max(u) + ln(list_sum([exp(k - list_max(u)) FOR k IN u]))) FOR v IN u] AS q, label_dist FROM x),
    l AS (SELECT stratum, t, avg(-list_sum([label_dist[i] * greatest(q[i], ln(1e-12)) FOR i IN [1, 2, 3]])) AS loss FROM y GROUP BY 1, 2)"""


@query(_LOSS + " SELECT stratum, min(t) AS t, round(any_value(least), 7) AS loss FROM (SELECT stratum, t, round(loss, 9) AS loss, min(round(loss, 9)) OVER (PARTITION BY stratum) AS least FROM l) WHERE loss = least GROUP BY 1")
def temperature_grid_fit(spark, sf):
    """The temperature of least loss on a grid of 200, all in one pass."""
    ts = [round(0.05 * 2000 ** (i / 199), 6) for i in range(200)]
    import numpy as np

    losses = fits.log_losses(V.calibration(spark, sf), "stratum", "probs", "label_dist", {s: np.array(ts) for s in ("easy", "mid", "hard")})
    best = [(s, ts[int(np.argmin(np.round(x, 9)))], round(float(np.round(x, 9).min()), 7)) for s, x in losses.items()]
    return spark.createDataFrame(best, "stratum string, t double, loss double")


@query()
def temperature_cv(spark, sf):
    """Soft ECE and mean divergence of each stratum before and after temperatures fitted to the other fold."""
    rows, _ = fits.temperature_cv(V.calibration(spark, sf), "stratum", "item", "probs", "label_dist")
    rows = rows.withColumns({"conf_after": F.array_max("q"), "jsd": X.jsd_bits(F.col("probs"), F.col("label_dist")), "jsd_after": X.jsd_bits(F.col("q"), F.col("label_dist"))})
    e = [calibrate.ece(calibrate.reliability(rows, ["stratum"], X.bin_floor(F.col(c), 10), conf=c), ["stratum"]).select("stratum", F.col("ece").alias(n)) for c, n in (("conf", "ece"), ("conf_after", "ece_after"))]
    means = rows.groupBy("stratum").agg(F.avg("jsd").alias("jsd"), F.avg("jsd_after").alias("jsd_after"), F.min("t").alias("t_low"), F.max("t").alias("t_high"))
    return means.join(e[0], "stratum").join(e[1], "stratum").select("stratum", *r9("ece", "ece_after", "jsd", "jsd_after"), F.round("t_low", 4).alias("t_low"), F.round("t_high", 4).alias("t_high"))


@query(", f AS (SELECT doc_id, lang, y, (row_number() OVER (PARTITION BY lang, y ORDER BY " + _U.format(parts="7, doc_id") + ", doc_id) - 1) % 5 AS fold FROM bina) SELECT doc_id, fold::INT AS fold FROM f")
def stratified_folds(spark, sf):
    return fits.folds(V.binary(spark, sf), ["lang", "y"], "doc_id", 5, 7).select("doc_id", F.col("fold").cast("int").alias("fold"))


@query()
def nested_cross_validation(spark, sf):
    """Quality of documents from simple signals, out of fold."""
    rows = V.binary(spark, sf).withColumn("signals", F.create_map(F.lit("p"), F.col("p"), F.lit("conf"), F.col("conf"), F.lit("toxic"), F.col("y2").cast("double")))
    rows = rows.withColumn("x", fits.features(F.col("signals"), ["p", "conf", "toxic", "absent"]))
    got, _ = fits.nested_cv(rows, "doc_id", "x", "y", "lang", 2, outer=3, inner=2, grid=(0.1, 1.0))
    return got.select(F.col("item").alias("doc_id"), "y", "pred")


@query()
def label_sweep(spark, sf):
    """How many labels the model of nested_cross_validation needs: accuracy and ECE out of fold by their number."""
    rows = V.binary(spark, sf).withColumn("x", F.array("p", "conf", F.col("y2").cast("double")))
    out = fits.label_sweep(rows, "doc_id", "x", "y", "lang", 2, (10, 50, 200, 10**9), outer=3, inner=2, grid=(0.1, 1.0))
    return out.select("labels", "skipped", "n_train", "folds", *r9("accuracy_mean", "accuracy_sd", "ece"))


@query()
def corrected_pass_sensitivity(spark, sf):
    """The corrected difference between urgent and low orders in each of the first three lines and of their mean."""
    lines = V.panel(spark, sf).where(F.col("tier").isin("1-URGENT", "5-LOW"))  # an order has one tier
    of_item = Window.partitionBy("item")
    share = F.avg((F.col("decision") == "N").cast("double")).over(of_item)
    rows = lines.withColumns({"n": F.count("*").over(of_item), "s": share}).where("n >= 3 and repeat <= 3")
    rows = rows.withColumn("human", F.array("s", 1 - F.col("s")))
    out = resample.corrected_by_pass(rows, "repeat", "tier", "1-URGENT", "5-LOW", "item", "probs", "human")
    return out.select("pass", "items", *r9("raw", "bias", "corrected", "p", "least", "most"), "n_extreme")


@query(", k AS (SELECT doc_id, row_number() OVER (ORDER BY " + _U.format(parts="3, doc_id") + ", doc_id) AS rn FROM labels) SELECT doc_id FROM k WHERE rn <= greatest(1, round_even((SELECT count(*) FROM labels) * 0.15, 0))")
def agreement_subset(spark, sf):
    return resample.subset(V.table(spark, sf, "labels"), "doc_id", 0.15, 3).select("doc_id")


@query(", b AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY " + _U.format(parts="5, doc_id") + ", doc_id) AS turn FROM bina) SELECT doc_id, source FROM b ORDER BY turn, source LIMIT 60")
def round_robin_sample(spark, sf):
    return resample.round_robin(V.binary(spark, sf), ["source"], "doc_id", 60, 5).select("doc_id", "source")


@query("""SELECT scoring, stratum, bin, count(*) AS n, round(avg(conf), 9) AS mean_conf, round(avg(correct), 9) AS mean_correct, round(avg(conf) - avg(correct), 9) + 0.0 AS overconfidence
    FROM (SELECT stratum, bin, conf, unnest([('soft', correct::DOUBLE), ('hard', hard::INT::DOUBLE)]) AS u, u[1] AS scoring, u[2] AS correct FROM calb) GROUP BY GROUPING SETS ((scoring, stratum, bin), (scoring, stratum), (scoring))""")
def direction_blocks(spark, sf):
    rows = V.calibration(spark, sf).withColumn("hard", F.col("hard").cast("int"))
    return calibrate.direction_block(rows, "stratum", {"soft": "correct", "hard": "hard"}).select("scoring", "stratum", F.col("bin").cast("long").alias("bin"), "n", *r9("mean_conf", "mean_correct", "overconfidence"))


@query("SELECT source, round(avg((p - y) ** 2), 9) AS brier FROM bina GROUP BY 1")
def brier_binary(spark, sf):
    return calibrate.brier_binary(V.binary(spark, sf), ["source"], "p", "y").select("source", *r9("brier"))


@query("""SELECT t.threshold, count(c.item) AS n, round(count(c.item) / (SELECT count(*) FROM cal), 9) AS share, round(avg(c.correct), 9) AS mean_correct
    FROM (SELECT unnest([round(0.5 + i * 0.01, 10) FOR i IN range(50)])::DOUBLE AS threshold) t LEFT JOIN cal c ON c.conf >= t.threshold GROUP BY 1""")
def gate_sweep(spark, sf):
    return rank.gate_sweep(V.calibration(spark, sf), "conf", "correct").select("threshold", "n", *r9("share", "mean_correct"))


@query("SELECT item, conf, correct FROM cal ORDER BY abs(conf - correct) DESC, item LIMIT 1")
def farthest_item(spark, sf):
    return rank.farthest(V.calibration(spark, sf), "conf", "correct", "item")


@query(", o AS (SELECT k, CASE k WHEN 0 THEN probs[1] WHEN 1 THEN probs[2] ELSE probs[3] END AS x, (majority = k)::INT AS y FROM cal, (SELECT unnest([0, 1, 2]) AS k)), g AS (SELECT k, x, sum(y) AS pos, sum(1 - y) AS neg FROM o GROUP BY 1, 2), h AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY k ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g), a AS (SELECT k, sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS auroc FROM h GROUP BY 1) SELECT round(avg(auroc), 9) AS auroc FROM a")
def macro_auroc(spark, sf):
    return rank.macro_auroc(V.calibration(spark, sf), "probs", "majority").select(*r9("auroc"))


@query(", i AS (SELECT item, avg(confidence) AS mean, coalesce(stddev_samp(confidence), 0) AS sd, (count(DISTINCT decision) > 1)::INT AS flips FROM panel GROUP BY 1), d AS (SELECT *, round(abs(mean - 0.75), 12) AS distance FROM i), q AS (SELECT quantile_cont(distance, 1 / 3) AS lo, quantile_cont(distance, 2 / 3) AS hi FROM d) SELECT round(avg(flips) FILTER (distance <= lo + 1e-12), 9) AS near, round(avg(flips) FILTER (distance >= hi - 1e-12), 9) AS far, round(avg(sd), 9) AS mean_sd, sum(flips)::BIGINT AS n_flips FROM d, q")
def boundary_ends(spark, sf):
    p = V.panel(spark, sf)
    items = stability.label_stability(p, ["item"]).join(stability.confidence_stability(p, ["item"]).drop("repeats"), "item").withColumn("mean", F.round("mean", 12))
    return stability.near_and_far(items, 0.75).select(*r9("near", "far", "mean_sd"), "n_flips")


@query(""", q AS (SELECT list_distinct(quantile_cont(conf, [i / 10 FOR i IN range(11)])) AS g FROM bina), t AS (SELECT unnest(g) AS threshold FROM q)
    SELECT threshold, round(count(*) / (SELECT count(*) FROM bina), 9) AS coverage, round(1 - avg(correct), 9) + 0.0 AS risk FROM t JOIN bina ON conf >= threshold GROUP BY 1""")
def coverage_at_quantiles(spark, sf):
    return rank.coverage_at_quantiles(V.binary(spark, sf), "conf", "correct", 11).select("threshold", *r9("coverage", "risk"))


_RANK = "rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2"


@query(", i AS (SELECT item, count(*) AS repeats, round(avg(confidence), 9) AS mean, (count(DISTINCT decision) > 1)::INT AS flips FROM panel GROUP BY 1), r AS (SELECT " + ", ".join(_RANK.format(x=x) + f" AS {n}" for x, n in (("flips", "a"), ("mean", "b"), ("repeats", "z"))) + " FROM i), f AS (SELECT regr_slope(a, z) AS sa, regr_intercept(a, z) AS ia, regr_slope(b, z) AS sb, regr_intercept(b, z) AS ib FROM r), e AS (SELECT round(a - ia - sa * z, 6) + 0.0 AS a, round(b - ib - sb * z, 6) + 0.0 AS b FROM r, f), s AS (SELECT " + _RANK.format(x="a") + " AS a, " + _RANK.format(x="b") + " AS b FROM e) SELECT 'mean' AS signal, (SELECT count(*) FROM i) AS n, (SELECT round(corr(a, b), 6) FROM r) AS rho, (SELECT round(corr(a, b), 5) FROM s) AS partial")
def stability_reconciliation(spark, sf):
    p = V.panel(spark, sf)
    items = stability.label_stability(p, ["item"]).join(stability.confidence_stability(p, ["item"]).select("item", F.round("mean", 9).alias("mean")), "item")
    return stability.reconciled(items, ["mean"], "repeats").select("signal", "n", F.round("rho", 6).alias("rho"), F.round("partial", 5).alias("partial"))


@query("SELECT CASE WHEN stratum IS NULL THEN 'all' ELSE stratum END AS stratum, strategy, round(ece, 9) AS ece FROM (SELECT stratum, 'uniform' AS strategy, sum(n * abs(mc - mp)) / sum(n) AS ece FROM (SELECT stratum, bin, count(*) AS n, avg(correct) AS mc, avg(conf) AS mp FROM calb GROUP BY 1, 2) GROUP BY 1)")
def uniform_strategy(spark, sf):
    out = calibrate.both_strategies(V.calibration(spark, sf), ["stratum"])
    return out.where("strategy = 'uniform'").select("stratum", "strategy", *r9("ece"))


@query(""", g AS (SELECT source, count(*) AS n, min(n_chars) AS lo, (max(n_chars) - min(n_chars)) / 99 AS step, stddev_samp(n_chars) * pow(count(*), -0.2) AS h FROM documents GROUP BY 1),
    c AS (SELECT source, n, lo, step, h, round((n_chars - lo) / step)::INT AS at_, count(*) AS k FROM documents JOIN g USING (source) GROUP BY ALL)
    SELECT source, n, place::INT AS place, round(any_value(lo) + place * any_value(step), 6) AS x, round(sum(k * exp(-(((place - at_) * step / h) ** 2) / 2)) / (any_value(h) * n * sqrt(2 * pi())) * 1000, 9) AS density FROM c, (SELECT unnest(range(100)) AS place) GROUP BY source, n, place""")
def length_density(spark, sf):
    """Densities of text lengths by source, times 1,000."""
    out = rank.density(V.table(spark, sf, "documents").select("source", "n_chars"), ["source"], "n_chars")
    return out.select("source", "n", "place", F.round("x", 6).alias("x"), F.round(F.col("density") * 1000, 9).alias("density"))


@query(", k AS (SELECT item, i, " + _U.format(parts="7, item, i") + """ AS u FROM cal, (SELECT unnest([0, 1, 2]) AS i)), r AS (SELECT item, i, row_number() OVER (PARTITION BY item ORDER BY u, i) AS r FROM k),
    l AS (SELECT item, string_agg(chr((64 + r)::INT), '' ORDER BY i) AS letters FROM r GROUP BY 1)
    SELECT item, letters, list_position(probs, list_max(probs)) - 1 AS pred, round(probs[1] * 1 + probs[2] * 2 + probs[3] * 3, 9) AS score FROM cal JOIN l USING (item)""")
def sentinel_answers(spark, sf):
    """Log-probabilities keyed by permuted letters, read back as options: the answer doesn't depend on the permutation."""
    options = F.array(*[F.lit(o) for o in ("low", "mid", "high")])
    logs = F.transform("probs", lambda p: F.ln(F.nullif(F.round(p, 12), F.lit(0.0))))
    rows = V.calibration(spark, sf).select("item", X.sentinels(options, 7, F.col("item")).alias("letters"), logs.alias("logs"))
    p = X.softmax_logs(X.by_option(options, F.col("letters"), F.map_from_arrays("letters", "logs")))
    rows = rows.withColumn("p", F.transform(p, lambda x: F.round(x, 11)))  # ties of probabilities survive their logarithms
    return rows.select("item", F.array_join("letters", "").alias("letters"), X.argmax(F.col("p")).alias("pred"), F.round(X.expected_score(F.col("p"), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))), 9).alias("score"))


_Q4 = "SELECT quantile_cont(entropy, 0.25) AS lo, quantile_cont(entropy, 0.75) AS hi FROM votes2"


@query(", q AS (" + _Q4 + "), k AS (SELECT item, CASE WHEN entropy <= lo THEN 'easy' WHEN entropy >= hi THEN 'hard' END AS stratum FROM votes2, q), r AS (SELECT *, count(*) OVER (PARTITION BY stratum) AS pool, row_number() OVER (PARTITION BY stratum ORDER BY " + _U.format(parts="20260923, item") + ", item) AS rn FROM k WHERE stratum IS NOT NULL) SELECT item, stratum, pool, rn <= 12 AS analysis FROM r")
def balanced_pools(spark, sf):
    """Quartile pools of entropy: 12 rows of each for analysis, the others discarded."""
    rows = V.votes(spark, sf).select("item", "entropy")
    return resample.balanced(rows, "entropy", "item", 12, 20260923).select("item", "stratum", "pool", "analysis")


_SIDES = _PANELB + """, sides AS (SELECT * FROM pb WHERE client IN (0, 1) AND item IN (SELECT item FROM pb WHERE client IN (0, 1) GROUP BY 1 HAVING count(*) = 2)),
    g AS (SELECT client, bin, sum(conf) - sum(correct) AS gap FROM sides GROUP BY 1, 2), t AS (SELECT client, sum(abs(gap)) AS s FROM g GROUP BY 1), m AS (SELECT count(*) / 2 AS n FROM sides),
    j0 AS (SELECT item, client, (t.s - abs(g.gap) + abs(g.gap - conf + correct)) / (m.n - 1) AS less FROM sides JOIN g USING (client, bin) JOIN t USING (client), m),
    j AS (SELECT item, max(less) FILTER (client = 0) - max(less) FILTER (client = 1) AS left_out FROM j0 GROUP BY 1), jm AS (SELECT avg(left_out) AS mean FROM j),
    acc AS (SELECT sum((mean - left_out) ** 3) / (6 * sum((mean - left_out) ** 2) ** 1.5) AS a FROM j, jm)"""


@query(_SIDES + _BOOT.format(cols="client, bin, conf, correct", item="item", src="sides") + ", b AS (" + _DE.format(by="client, rep", src="w") + """),
    d AS (SELECT rep, max(ece) FILTER (client = 0) - max(ece) FILTER (client = 1) AS d FROM b GROUP BY 1),
    pt AS (SELECT (SELECT s / n FROM t, m WHERE client = 0) - (SELECT s / n FROM t, m WHERE client = 1) AS point), sh AS (SELECT greatest(1 / 101, least(100 / 101, avg((d < point)::INT))) AS p FROM d, pt),
    z AS (SELECT """ + _quantile_sql("p") + """ AS z0, a FROM sh, acc)
    SELECT round(point, 9) AS point, round(a, 6) AS a, round(z0, 6) AS z0 FROM pt, z""")
def paired_delta_ece_bca(spark, sf):
    """Point, acceleration over items, and bias; its ends are tested against numpy."""
    out = resample.paired_delta_ece_bca(_first(spark, sf), "item", "client", 0, 1)
    return out.select(*r9("point"), F.round("a", 6).alias("a"), F.round("z0", 6).alias("z0"))


_BUNDLE = """, z AS (SELECT *, n * 1.5 AS latency, n / 1000 AS cost FROM calb),
    s AS (SELECT stratum, count(*) AS n, sum(cost) AS cost, sum(hard::INT) AS ok, avg(hard::INT) AS accuracy, quantile_cont(latency, 0.5) AS p50, quantile_cont(latency, 0.95) AS p95 FROM z GROUP BY 1),
    e1 AS (SELECT stratum, sum(n * abs(mc - mp)) / sum(n) AS ece FROM (SELECT stratum, bin, count(*) AS n, avg(hard::INT) AS mc, avg(conf) AS mp FROM z GROUP BY 1, 2) GROUP BY 1),
    k AS (SELECT stratum, k, count(*) FILTER (majority = k) AS t, count(*) FILTER (pred = k) AS p, count(*) FILTER (pred = k AND majority = k) AS tp FROM z, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1, 2),
    f AS (SELECT stratum, avg(2 * tp / (t + p)) AS macro_f1 FROM k WHERE t + p > 0 GROUP BY 1),
    o AS (SELECT stratum, k, probs[k + 1] AS x, (majority = k)::INT AS y FROM z, (SELECT unnest([0, 1, 2]) AS k)), o1 AS (SELECT stratum, k, x, sum(y) AS pos, sum(1 - y) AS neg FROM o GROUP BY 1, 2, 3),
    o2 AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY stratum, k ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM o1),
    o3 AS (SELECT stratum, k, sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS auroc FROM o2 GROUP BY 1, 2), a AS (SELECT stratum, avg(auroc) AS macro_auroc FROM o3 GROUP BY 1)
    SELECT stratum, n, round(accuracy, 9) AS accuracy, round(macro_f1, 9) AS macro_f1, round(macro_auroc, 9) AS macro_auroc, round(ece, 9) AS ece, round(p50, 9) AS p50, round(p95, 9) AS p95, round(cost, 9) AS cost, round(cost * 1000 / nullif(ok, 0), 6) AS cost_per_thousand
    FROM s JOIN e1 USING (stratum) JOIN f USING (stratum) JOIN a USING (stratum)"""


@query(_BUNDLE)
def zero_shot_bundle(spark, sf):
    """All measures of a classifier in one row of each stratum."""
    rows = V.calibration(spark, sf).withColumns({"latency": F.col("n") * 1.5, "cost": F.col("n") / 1000})
    out = calibrate.bundle(rows, ["stratum"], label="majority")
    return out.select("stratum", "n", *r9("accuracy", "macro_f1", "macro_auroc", "ece", "p50", "p95", "cost"), F.round("cost_per_thousand", 6).alias("cost_per_thousand"))


@query(_DIV + f"""SELECT stratum, round(avg(({_KL.format(p='np', m='m', log='log2')} + {_KL.format(p='nd', m='m', log='log2')}) / 2), 9) AS jsd, round(avg(({_KL.format(p='u', m='mu', log='log2')} + {_KL.format(p='nd', m='mu', log='log2')}) / 2), 9) AS uniform_jsd
    FROM (SELECT *, [1/3, 1/3, 1/3] AS u, [(1/3 + nd[i]) / 2 FOR i IN [1, 2, 3]] AS mu FROM d2) GROUP BY 1""")
def jsd_against_uniform(spark, sf):
    """Mean Jensen-Shannon divergence (bits) of the labels' distribution from the model's and from equal chances."""
    third = F.array(*[F.lit(1 / 3)] * 3)
    d = F.col("label_dist")
    return V.calibration(spark, sf).groupBy("stratum").agg(F.avg(X.jsd_bits(F.col("probs"), d)).alias("jsd"), F.avg(X.jsd_bits(third, d)).alias("uniform_jsd")).select("stratum", *r9("jsd", "uniform_jsd"))


_EQ = "SELECT stratum, '{name}' AS strategy, sum(n)::DOUBLE AS n, round(sum(n * abs(mc - mp)) / sum(n), 9) + 0.0 AS ece, round(max(abs(mc - mp)), 9) + 0.0 AS mce FROM (SELECT stratum, bin, count(*) AS n, avg(correct) AS mc, avg(conf) AS mp FROM ({src}) GROUP BY 1, 2) GROUP BY 1"


@query(f", qs AS (SELECT stratum, quantile_cont(conf, [{', '.join(str(i / 10) for i in range(11))}]) AS q FROM cal GROUP BY 1), qe AS (SELECT stratum, q[1] AS e0, {_Q} FROM qs) " + _EQ.format(name="uniform", src="SELECT * FROM calb") + " UNION ALL " + _EQ.format(name="quantile", src="SELECT cal.stratum, conf, correct, " + " + ".join(f"(e{i} <= conf)::INT" for i in range(1, 10)) + " AS bin FROM cal JOIN qe USING (stratum)"))
def both_strategies(spark, sf):
    """ECE and MCE by uniform and by quantile bins, a row of each."""
    return calibrate.both_strategies(V.calibration(spark, sf), ["stratum"]).select("stratum", "strategy", "n", *r9("ece", "mce"))

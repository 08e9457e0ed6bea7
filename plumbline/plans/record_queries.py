"""Queries of prediction records, joins, files and reports, with their SQL. Records are made of order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import expr as X
from plumbline.operators import agree, calibrate, records
from plumbline.plans import views as V
from plumbline.plans.queries import query, r9
from plumbline.sources import files, jsonl
from plumbline.sources.tables import spread

ORDER = ["A", "N", "R"]
NOULS = ["noul_a", "noul_n", "noul_r"]
_REC = """, rec AS (SELECT l_orderkey::VARCHAR AS item_id, l_suppkey % 3 AS client, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS pass,
    l_linenumber = 7 AS error, l_returnflag AS choice, o_orderpriority AS tier, 0.5 + 5 * l_discount AS c, l_quantity / 50 AS ya, CASE WHEN l_linenumber <> 6 THEN l_tax * 10 END AS yn, l_discount * 10 AS yr,
    l_extendedprice / 1000 AS latency, 'm' || (l_suppkey % 2) AS model, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    recp AS (SELECT *, [CASE WHEN choice = k THEN c ELSE (1 - c) / 2 END FOR k IN ['A', 'N', 'R']] AS p FROM rec) """


def _records(spark, sf) -> DataFrame:
    """Lines of an order, spread over tasks by item_id, so that what groups or joins records by it finds them in place."""
    w = Window.partitionBy("item_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    lines = spread(V.table(spark, sf, "lineitem").withColumn("item_id", F.col("l_orderkey").cast("string")), "item_id").withColumn("pass", F.row_number().over(w))
    orders = V.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("item_id"), F.col("o_orderpriority").alias("tier"))
    c = 0.5 + 5 * F.col("l_discount")
    latency, model = F.col("l_extendedprice") / 1000, F.concat(F.lit("m"), (F.col("l_suppkey") % 2).cast("string"))
    p = F.map_from_arrays(F.array(*[F.lit(k) for k in ORDER]), F.array(*[F.when(F.col("l_returnflag") == k, c).otherwise((1 - c) / 2) for k in ORDER]))
    no_map = F.lit(None).cast("map<string,double>")

    def decision(name: str, kind: str, choice, value, probabilities):
        return F.struct(F.lit(name).alias("question_id"), F.lit(kind).alias("kind"), choice.cast("string").alias("choice"), value.cast("double").alias("value"), probabilities.alias("probabilities"), latency.alias("latency_ms"), model.alias("model"))

    yes = [F.col("l_quantity") / 50, F.when(F.col("l_linenumber") != 6, F.col("l_tax") * 10), F.col("l_discount") * 10]
    none = F.lit(None)
    asked = [decision("noul_a", "noul", none, yes[0], no_map), decision("relation", "choice", F.col("l_returnflag"), none, p), *[decision(n, "noul", none, y, no_map) for n, y in zip(NOULS[1:], yes[1:], strict=True)]]
    out = lines.join(orders, "item_id").withColumn("decisions", F.array(*asked))
    return out.select("item_id", (F.col("l_suppkey") % 3).alias("client"), "pass", F.col("pass").alias("seq"), (F.col("l_linenumber") == 7).alias("error"), "tier", "decisions", "l_partkey")


def _flat(spark, sf) -> DataFrame:
    return records.flattened(_records(spark, sf), NOULS)


_TRI = "CASE WHEN ya IS NULL OR yn IS NULL OR yr IS NULL THEN NULL WHEN ya + yn + yr < 1e-6 THEN 1/3 ELSE {y} / (ya + yn + yr) END"


@query(_REC + "SELECT item_id, pass, choice, round(p[1], 9) AS p_a, round(" + _TRI.format(y="ya") + ", 9) AS yes_a, round(" + _TRI.format(y="yn") + ", 9) AS yes_n, (yn IS NOT NULL AND ya + coalesce(yn, 0) + yr < 1e-6) AS near_zero_sum FROM recp WHERE NOT error")
def flattened_records(spark, sf):
    out = _flat(spark, sf)
    return out.select("item_id", "pass", "choice", F.round(F.try_element_at("probabilities", F.lit("A")), 9).alias("p_a"), F.round(F.col("noul")[0], 9).alias("yes_a"), F.round(F.col("noul")[1], 9).alias("yes_n"), "near_zero_sum")


_LAB = ", lab AS (SELECT o_orderkey::VARCHAR AS item_id, o_orderstatus AS label FROM orders WHERE o_orderkey % 10 < 8), dist AS (SELECT o_orderkey::VARCHAR AS item_id FROM orders WHERE o_orderkey % 2 = 0) "


def _normalised(spark, sf) -> DataFrame:
    rows, orders = _records(spark, sf), V.table(spark, sf, "orders").withColumn("item_id", F.col("o_orderkey").cast("string"))
    flat = records.flattened(rows.where("pass % 2 = 0"), NOULS).withColumn("label", F.lit("?"))
    labels = orders.where("o_orderkey % 10 < 8").select("item_id", F.col("o_orderstatus").alias("label"))
    dists = orders.where("o_orderkey % 2 = 0").select("item_id", F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)).alias("label_dist"))
    return records.normalised(flat, rows.where("pass % 2 = 1"), NOULS, labels, dists)


@query(_REC + _LAB + "SELECT r.item_id, r.pass, l.label, d.item_id IS NOT NULL AS has_dist FROM rec r JOIN lab l USING (item_id) LEFT JOIN dist d ON d.item_id = r.item_id WHERE NOT error")
def normalised_records(spark, sf):
    return _normalised(spark, sf).select("item_id", "pass", "label", F.col("label_dist").isNotNull().alias("has_dist"))


@query(_REC + _LAB + "SELECT r.tier, count(*) AS n, false AS soft FROM rec r JOIN lab l USING (item_id) WHERE NOT error AND r.tier IN ('1-URGENT', '5-LOW') AND r.pass % 4 <> 0 GROUP BY 1")
def strata_rows(spark, sf):
    rows = _normalised(spark, sf).withColumn("role", F.when(F.col("pass") % 4 == 0, "paraphrase"))
    return records.at_strata(rows, ["1-URGENT", "5-LOW"]).groupBy("tier").agg(F.count("*").alias("n"), F.bool_or("soft").alias("soft"))


@query(_REC + """, k AS (SELECT *, row_number() OVER (PARTITION BY item_id, client ORDER BY (pass = 2) DESC, pass DESC) AS rn FROM recp WHERE NOT error)
    SELECT item_id, client, pass, list_position(['A', 'N', 'R'], choice) - 1 AS pred, round(p[1] / list_sum(p), 9) AS p_a FROM k WHERE rn = 1""")
def arm_arrays(spark, sf):
    out = records.arm(_flat(spark, sf), 2, ["item_id", "client"], ORDER)
    return out.select("item_id", "client", "pass", "pred", F.round(F.col("p")[0], 9).alias("p_a"))


@query(_REC + ", s AS (SELECT item_id, count(*) AS n FROM rec GROUP BY 1 HAVING count(*) = 3) SELECT item_id, round(avg(p[1]), 9) AS p_a, round(avg(p[2]), 9) AS p_n, round(avg(p[3]), 9) AS p_r FROM recp JOIN s USING (item_id) GROUP BY 1")
def mean_over_passes(spark, sf):
    rows = _records(spark, sf)
    three = rows.groupBy("item_id").count().where("count = 3").select("item_id")
    rows = rows.join(three, "item_id").withColumn("p", records.vector(records.relation(F.col("decisions"))["probabilities"], ORDER))
    return records.mean_over_passes(rows, ["item_id"], "p", 3).select("item_id", *[F.round(F.col("p")[i], 9).alias(f"p_{k}") for i, k in enumerate("anr")])


@query(_REC + ", k AS (SELECT *, row_number() OVER (PARTITION BY item_id, client ORDER BY pass) AS rn FROM rec) SELECT item_id, client, pass, choice, round(latency, 9) AS latency, round(ya, 9) AS s_a, round(coalesce(yn, 0), 9) AS s_n, round(c, 9) AS s_relation FROM k JOIN orders ON item_id = o_orderkey::VARCHAR WHERE rn = 1")
def item_signals(spark, sf):
    labels = V.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("item_id"), F.col("o_orderstatus").alias("label"))
    out = records.signals(_records(spark, sf).join(labels, "item_id"), [*NOULS, "relation", "absent"], ORDER)
    value = lambda k: F.round(F.try_element_at("signals", F.lit(k)), 9)
    return out.select("item_id", "client", "pass", "choice", F.round("latency", 9).alias("latency"), value("noul_a").alias("s_a"), value("noul_n").alias("s_n"), value("relation").alias("s_relation"))


@query(_REC + "SELECT item_id, pass, model, choice, round(latency, 9) AS latency_ms, 4 AS n, (yn IS NULL)::INT AS n_empty FROM rec")
def decision_summaries(spark, sf):
    out = _records(spark, sf).select("item_id", "pass", records.summary(F.col("decisions")).alias("s"))
    return out.select("item_id", "pass", "s.model", "s.choice", F.round("s.latency_ms", 9).alias("latency_ms"), "s.n", "s.n_empty")


@query(_REC + """SELECT item_id, count(DISTINCT choice || '|' || printf('%.8f', round_even(p[1], 8)) || printf('%.8f', round_even(p[2], 8)) || printf('%.8f', round_even(p[3], 8))) AS different FROM recp GROUP BY 1""")
def answer_fingerprints(spark, sf):
    return _records(spark, sf).groupBy("item_id").agg(F.count_distinct(records.fingerprint(F.filter("decisions", lambda d: d["kind"] == "choice"))).alias("different"))


@query(_REC + "SELECT item_id, pass, d.q AS question_id, d.k AS kind, d.c AS choice, round(d.v, 9) AS value, model FROM (SELECT item_id, pass, model, unnest([{'q': 'noul_a', 'k': 'noul', 'c': NULL, 'v': ya}, {'q': 'relation', 'k': 'choice', 'c': choice, 'v': NULL}]) AS d FROM rec)")
def parsed_responses(spark, sf):
    """Wire responses written as JSON and parsed again."""
    d = F.filter("decisions", lambda d: d["question_id"].isin("noul_a", "relation"))
    answers = F.map_from_entries(F.transform(d, lambda d: F.struct(d["question_id"].alias("key"), F.struct(d["kind"].alias("type"), d["choice"].alias("choice"), d["value"].alias("noul"), d["probabilities"].alias("probabilities")).alias("value"))))
    body = F.to_json(F.struct(F.col("decisions")[0]["model"].alias("model"), answers.alias("answers")))
    rows = _records(spark, sf).select("item_id", "pass", F.explode(records.parsed(body)).alias("d"))
    return rows.select("item_id", "pass", "d.question_id", "d.kind", "d.choice", F.round("d.value", 9).alias("value"), "d.model")


@query(_REC + """, x AS (SELECT client, item_id, pass, CASE WHEN pass % 2 = 0 THEN 1 ELSE 0 END AS para, (choice = 'N')::INT AS ok FROM rec WHERE client < 2),
    l AS (SELECT client, item_id, para, max_by(ok, pass) AS ok FROM x GROUP BY ALL), b AS (SELECT client, item_id, max(ok) FILTER (para = 0) AS a, max(ok) FILTER (para = 1) AS b FROM l GROUP BY ALL)
    SELECT client, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n, round(avg(a) FILTER (b IS NOT NULL AND a IS NOT NULL), 9) AS original, round(avg(b) FILTER (a IS NOT NULL AND b IS NOT NULL), 9) AS paraphrase, round(avg(a - b), 9) + 0.0 AS drop, 'scored' AS status FROM b GROUP BY 1""")
def contamination_table(spark, sf):
    para = F.col("pass") % 2 == 0
    rows = _records(spark, sf).where("client < 2").withColumn("ok", records.relation(F.col("decisions"))["choice"] == "N").withColumn("role", F.when(para, "paraphrase").otherwise("primary"))
    rows = rows.withColumns({"source_item_id": F.when(para & (F.col("pass") % 4 == 0), F.col("item_id")), "item_id": F.when(para, F.concat("item_id", F.lit("::paraphrase"))).otherwise(F.col("item_id"))})
    return records.contamination(rows).select("client", "n", *r9("original", "paraphrase", "drop"), "status")


@query(_REC + ", m AS (SELECT item_id, client, max(c) AS x FROM rec GROUP BY 1, 2) SELECT a.item_id, a.x AS first, b.x AS one, c.x AS two FROM m a JOIN m b USING (item_id) JOIN m c USING (item_id) WHERE a.client = 0 AND b.client = 1 AND c.client = 2")
def aligned_arms(spark, sf):
    best = V.panel(spark, sf).groupBy(F.col("item").cast("string").alias("item_id"), "client").agg(F.max("confidence").alias("x"))
    side = lambda c: best.where(F.col("client") == c)
    return records.aligned(side(0), {"one": side(1), "two": side(2)}, "item_id", "x")


@query("SELECT doc_id AS item_id, CASE doc_id % 3 WHEN 0 THEN 'cached' WHEN 1 THEN 'paraphrase' ELSE 'inline' END AS text_status, CASE doc_id % 3 WHEN 0 THEN CASE WHEN doc_id % 2 = 0 THEN md5(coalesce(text, '')) END WHEN 1 THEN CASE WHEN doc_id % 5 < 3 THEN md5('p' || coalesce(text, '')) END ELSE md5(text) END AS digest FROM documents")
def hydrated_texts(spark, sf):
    docs = V.table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "text")
    status = F.when(F.col("item_id") % 3 == 0, "cached").when(F.col("item_id") % 3 == 1, "paraphrase").otherwise("inline")
    cache = docs.where("item_id % 2 = 0").fillna("", ["text"])
    paraphrases = docs.where("item_id % 5 < 3").select("item_id", F.concat(F.lit("p"), F.coalesce("text", F.lit(""))).alias("text"))
    return records.hydrated(docs.withColumn("text_status", status), cache, paraphrases).select("item_id", "text_status", F.md5("text").alias("digest"))


@query("SELECT DISTINCT doc_id FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE source = (SELECT min(source) FROM documents))")
def excluded_overlap(spark, sf):
    docs = V.table(spark, sf, "documents")
    first = docs.agg(F.min("source").alias("source"))
    return records.overlap(V.table(spark, sf, "labels"), docs.join(F.broadcast(first), "source"), "doc_id")


@query("SELECT l.doc_id, l.doc_id * 2 AS ord, d.lang, d.doc_id IS NULL AS missing FROM (SELECT doc_id FROM labels UNION ALL SELECT -1) l LEFT JOIN documents d ON d.doc_id = l.doc_id")
def locked_rows(spark, sf):
    lock = V.table(spark, sf, "labels").select("doc_id").union(spark.range(1).select((F.col("id") - 1).alias("doc_id"))).withColumn("ord", F.col("doc_id") * 2)
    return records.locked(V.table(spark, sf, "documents").select("doc_id", "lang"), lock, "doc_id").select("doc_id", "ord", "lang", "missing")


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 11 = 0 THEN 'mismatch' ELSE 'ok' END AS status FROM documents")
def rebuilt_requests(spark, sf):
    made = V.table(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    log = made.withColumn("digest", F.when(F.col("doc_id") % 11 == 0, F.lit("0")).otherwise(F.col("digest")))
    return records.digest_check(log, made.where("doc_id % 7 <> 0"), "doc_id", "digest").select("doc_id", "status")


@query("SELECT doc_id FROM documents WHERE doc_id % 6 = 0 AND length(text) > 0")
def leaked_sentences(spark, sf):
    docs = V.table(spark, sf, "documents")
    sentences = docs.where("doc_id % 2 = 0").select("doc_id", F.substring("text", 1, 40).alias("sentence"))
    log = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise("-").alias("log"))
    return records.leaks(log, "log", sentences, "doc_id").select("doc_id")


@query("SELECT item, round(conf, 9) AS conf, round(correct, 9) AS correct FROM cal WHERE conf >= 0.5 AND correct < 0.35 ORDER BY conf DESC, item LIMIT 85")
def confidently_wrong(spark, sf):
    """Confidences are halved way to 1, so that some reach the predicate's .75."""
    rows = V.calibration(spark, sf).withColumn("raised", 0.5 + F.col("conf") / 2)
    return records.confidently_wrong(rows, "raised", "correct", "item").select("item", *r9("conf", "correct"))


@query("SELECT item, CASE WHEN item % 4 = 0 THEN 2 ELSE list_position(probs, list_max(probs)) - 1 END AS pred, round(probs[1], 9) AS p_a FROM cal")
def zero_shot_predictions(spark, sf):
    p = F.map_from_arrays(F.array(*[F.lit(k) for k in ORDER]), F.col("probs"))
    z = records.zero_shot(F.when(F.col("item") % 4 == 0, "R").otherwise("unknown"), p, ORDER)
    return V.calibration(spark, sf).select("item", z.alias("z")).select("item", "z.pred", F.round(F.col("z.p")[0], 9).alias("p_a"))


@query("SELECT p_partkey, CASE WHEN contains(lower(p_type), 'brass') THEN 'pilot' WHEN contains(lower(p_type), 'tin') THEN 'exp1' ELSE 'other' END AS kind FROM part")
def run_kinds(spark, sf):
    name = F.replace(F.replace(F.lower("p_type"), F.lit("brass"), F.lit("PILOT")), F.lit("tin"), F.lit("Exp1"))
    return V.table(spark, sf, "part").select("p_partkey", records.run_kind(name).alias("kind"))


@query("SELECT n_name AS name, CASE n_nationkey % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'MISMATCH' WHEN 2 THEN 'MISSING' ELSE 'EXTRA' END AS status FROM nation")
def manifest_check(spark, sf):
    n = V.table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.sha2("n_name", 256).alias("digest"), (F.col("n_nationkey") % 4).alias("k"))
    lines = files.manifest_lines(n.where("k <> 3").withColumn("digest", F.when(F.col("k") == 1, F.sha2(F.lit("x"), 256)).otherwise(F.col("digest"))))
    return files.compared(n.where("k <> 2"), files.parsed_manifest(lines))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN [] ELSE ['sum'] END AS faults FROM customer")
def vote_faults(spark, sf):
    n = F.array(F.lit(70), F.lit(30) + F.col("c_custkey") % 2, F.lit(0)).cast("array<bigint>")
    rows = V.table(spark, sf, "customer").select("c_custkey", n.alias("counts"), F.lit("a b").alias("premise"), F.lit("e").alias("code")).withColumn("entropy", X.entropy_bits(F.transform("counts", lambda x: x / 100.0)))
    checks = files.vote_checks("counts", "entropy", ["premise"], "code", {"e": 0, "n": 1, "c": 2})
    return rows.select("c_custkey", files.faults(checks).alias("faults"))


@query("SELECT id, source FROM (SELECT 'd' || doc_id AS id, 'documents' AS source FROM documents UNION ALL SELECT 'p' || page_id, 'pages' FROM pages)")
def population(spark, sf):
    docs = V.table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"))
    pages = V.table(spark, sf, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"))
    return files.population({"documents": docs, "pages": pages}, "id")


@query("SELECT DISTINCT n_name AS id FROM nation WHERE n_nationkey % 3 < 2 AND NOT contains(n_name, ' ')")
def disputed_ids(spark, sf):
    line = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("- id: "), "n_name")).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit("### "), "n_name", F.lit(" and more"))).otherwise(F.concat(F.lit("id "), "n_name"))
    return files.disputed(V.table(spark, sf, "nation").where("not contains(n_name, ' ')").select(line.alias("value")))


@query("SELECT name, kind, name = max(name) OVER (PARTITION BY kind) AS latest FROM (SELECT n_name AS name, CASE WHEN n_regionkey = 0 THEN 'pilot' WHEN n_regionkey = 1 THEN 'exp1' ELSE 'other' END AS kind FROM nation WHERE n_regionkey < 4)")
def run_catalogue(spark, sf):
    kind = F.when(F.col("n_regionkey") == 0, "pilot_").when(F.col("n_regionkey") == 1, "exp1_").when(F.col("n_regionkey") == 4, "_aborted_").otherwise("")
    names = V.table(spark, sf, "nation").select(F.concat(kind, "n_name").alias("name")).union(spark.range(1).select(F.lit("demo").alias("name")))
    return files.runs(names).select(F.regexp_replace("name", "^(?:pilot|exp1)_", "").alias("name"), "kind", "latest")


@query("SELECT count(*) AS n, round(po, 9) AS po, round((po - pe) / (1 - pe), 9) AS kappa, round(1 - po, 9) AS noise, (po - pe) / (1 - pe) >= 0.6 AS passes FROM (SELECT avg((y = y2)::INT) AS po, avg(y) * avg(y2) + avg(1 - y) * avg(1 - y2) AS pe FROM bina), bina GROUP BY po, pe")
def agreement_report(spark, sf):
    return agree.kappa_report(V.binary(spark, sf), "y", "y2", "doc_id").select("n", *r9("po", "kappa", "noise"), "passes")


@query("SELECT doc_id, y, y2 FROM bina WHERE y <> y2")
def disagreeing_items(spark, sf):
    return agree.disagreements(V.binary(spark, sf), "y", "y2", "doc_id")


@query(""", d AS (SELECT ts::DATE AS day, event_type AS kind, round(sum(value), 6) AS spent FROM events GROUP BY 1, 2), t AS (SELECT *, sum(spent) OVER (ORDER BY day, kind ROWS UNBOUNDED PRECEDING) AS total, sum(spent) OVER (PARTITION BY kind ORDER BY day ROWS UNBOUNDED PRECEDING) AS own FROM d)
    SELECT day, kind, round(spent, 6) AS spent, round(total, 4) AS total, round(own, 4) AS kind_total, (total > 500000 OR own > CASE kind WHEN 'click' THEN 50000 ELSE 80000 END) AS over FROM t""")
def budget_ledger(spark, sf):
    calls = V.table(spark, sf, "events").select(F.to_date("ts").alias("day"), F.col("event_type").alias("kind"), F.col("value").alias("cost")).groupBy("day", "kind").agg(F.round(F.sum("cost"), 6).alias("cost"))
    out = agree.ledger(calls, ["day", "kind"], 500000.0, {"click": 50000.0}, 80000.0)
    return out.select("day", "kind", F.round("spent", 6).alias("spent"), F.round("total", 4).alias("total"), F.round("kind_total", 4).alias("kind_total"), "over")


@query("SELECT event_type, count(*) AS calls, count(*) FILTER (value >= 400) AS errors, sum(event_id)::BIGINT AS tokens, round(count(*) / (epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts)))), 9) AS per_second FROM events GROUP BY 1")
def run_statistics(spark, sf):
    return agree.run_stats(V.table(spark, sf, "events"), "event_type", F.col("value") < 400, "event_id", "ts").select("event_type", "calls", "errors", "tokens", *r9("per_second"))


@query("SELECT source, round(sum(p), 6) AS cost, sum(correct)::DOUBLE AS correct, round(1000 * sum(p) / nullif(sum(correct), 0), 6) AS per_thousand FROM bina GROUP BY 1")
def cost_per_thousand(spark, sf):
    return agree.cost_per_thousand(V.binary(spark, sf), ["source"], "p", "correct").select("source", F.round("cost", 6).alias("cost"), "correct", F.round("per_thousand", 6).alias("per_thousand"))


@query("SELECT lang, source, count(*) AS n, round(avg(correct), 9) AS accuracy, round(avg(conf), 9) AS mean_conf, count(*) FILTER (pred = 0) AS n_0, count(*) FILTER (pred = 1) AS n_1, count(*) FILTER (pred = 2) AS n_2 FROM bina GROUP BY GROUPING SETS ((lang), (lang, source))")
def label_blocks(spark, sf):
    return agree.blocks(V.binary(spark, sf), "lang", "source", [0, 1, 2], truth="y").select("lang", "source", "n", *r9("accuracy", "mean_conf"), "n_0", "n_1", "n_2")


@query("SELECT stratum, count(DISTINCT item) AS items, bool_and(n > 1) AS all_primary FROM cal GROUP BY 1")
def strata_sizes(spark, sf):
    return agree.strata_sizes(V.calibration(spark, sf), "stratum", "item", F.col("n") > 1)


@query("SELECT item, round((abs(a[1] - b[1]) + abs(a[2] - b[2]) + abs(a[3] - b[3])) / 2, 9) AS tv, (['x', 'y', 'z'][majority + 1] = 'y')::INT AS is_y FROM (SELECT item, majority, [x / list_sum(probs) FOR x IN probs] AS a, [x / list_sum(label_dist) FOR x IN label_dist] AS b FROM cal)")
def normalised_distance(spark, sf):
    name = F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("z")), F.col("majority") + 1)
    place = X.label_index(name, ["x", "y", "z"])
    double = lambda c: F.transform(c, lambda x: 2 * x)  # noqa: E731  any positive multiple gives the same distribution
    return V.calibration(spark, sf).select("item", F.round(X.tvd_normalised(double("probs"), F.col("label_dist")), 9).alias("tv"), (place == 1).cast("int").alias("is_y"))


@query(", a AS (SELECT stratum, sum(n * abs(mc - mp)) / sum(n) AS ece FROM (SELECT stratum, bin, count(*) AS n, avg(correct) AS mc, avg(conf) AS mp FROM calb GROUP BY 1, 2) GROUP BY 1) SELECT stratum, round(ece, 9) AS ece, stratum <> 'mid' AS match FROM a")
def stamped_ece(spark, sf):
    made = calibrate.uniform_ece(V.calibration(spark, sf), ["stratum"]).select("stratum", "ece")
    stamped = made.withColumn("ece", F.col("ece") + F.when(F.col("stratum") == "mid", 1e-3).otherwise(1e-9))
    return calibrate.matched(made, stamped, ["stratum"]).select("stratum", *r9("ece"), "match")


@query("SELECT doc_id, quality, lang FROM labels JOIN documents USING (doc_id)")
def loaded_dataset(spark, sf):
    labels = V.table(spark, sf, "labels").select("doc_id", "quality")
    items = V.table(spark, sf, "documents").select("doc_id", "lang").join(labels.select("doc_id"), "doc_id", "left_semi")
    return jsonl.load_dataset(items, labels, "doc_id")


@query(_REC + "SELECT item_id, client, pass, choice FROM rec WHERE pass = 2")
def fixed_pass(spark, sf):
    out = records.fixed_pass(_records(spark, sf), 2, ["item_id", "client"])
    return out.select("item_id", "client", "pass", records.relation(F.col("decisions"))["choice"].alias("choice"))


@query("""SELECT doc_id, CASE WHEN length(text) > 5000 THEN 'long' WHEN regexp_matches(text, '(?i)\\bpass(word|phrase)\\b') THEN 'secret' WHEN contains(lower(text), 'copyright') OR contains(lower(text), 'license') THEN 'legal' ELSE 'prose' END AS label FROM documents""")
def rule_chain_labels(spark, sf):
    text = F.col("text")
    label = agree.rule_chain(text, rules=[(F.length(text) > 5000, "long")], patterns=[(r"\bpass(?:word|phrase)\b", "secret")], keywords=[("legal", ["Copyright", "license"])], majority="prose", options=["other"])
    return V.table(spark, sf, "documents").select("doc_id", label.alias("label"))


@query("""SELECT client, (SELECT count(*) FROM conversations) * repeats AS calls, t * repeats AS input_tokens, round((t * rate + (SELECT count(*) FROM conversations) * 100 * orate) * repeats / 1e6, 9) AS cost
    FROM (SELECT sum(CASE WHEN text IS NULL OR length(text) = 0 THEN 0 ELSE greatest(1, (length(text) + 3) // 4) END)::BIGINT AS t FROM conversations), (SELECT unnest([{'client': 'one', 'repeats': 10, 'rate': 0.042::DOUBLE, 'orate': 0.0::DOUBLE}, {'client': 'two', 'repeats': 1, 'rate': 0.1::DOUBLE, 'orate': 0.4::DOUBLE}], recursive := true))""")
def dry_run(spark, sf):
    clients = spark.createDataFrame([("one", 10, 0.042, 0.0, 100), ("two", 1, 0.1, 0.4, 100)], "client string, repeats long, input_rate double, output_rate double, output_tokens long")
    tokens = V.table(spark, sf, "conversations").select(agree.estimated_tokens(F.col("text")).alias("tokens"))
    return agree.dry_run(tokens, clients).select("client", "calls", "input_tokens", *r9("cost"))


@query("SELECT user_id, list_sort(list(DISTINCT event_type)) AS versions, count(DISTINCT event_type) > 1 AS mixed FROM events GROUP BY 1")
def client_versions(spark, sf):
    from plumbline.operators import stability

    return stability.versions(V.table(spark, sf, "events"), "user_id", "event_type")


@query("SELECT c.conv_id AS item_id, c.turn, d.lang AS source FROM conversations c LEFT JOIN (SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de')) d ON d.doc_id = c.turn * 7")
def sources_of_rows(spark, sf):
    items = V.table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), F.col("lang").alias("source"))
    rows = V.table(spark, sf, "conversations").select(F.col("conv_id"), "turn", (F.col("turn") * 7).alias("key"))
    found = records.source_of(items, ("en", "de")).withColumnRenamed("item_id", "key")
    return rows.join(found, "key", "left").select(F.col("conv_id").alias("item_id"), "turn", "source")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS premise FROM events")
def premise_pairs(spark, sf):
    state = F.to_json(F.struct(F.col("event_type").alias("premise"), F.when(F.col("event_id") % 3 == 0, " ").otherwise("h").alias("hypothesis")))
    return V.table(spark, sf, "events").select("event_id", records.premise_pair(state)["premise"].alias("premise"))


@query("SELECT doc_id AS item_id, doc_id % 4 = 0 AS same FROM documents WHERE doc_id % 4 = 0 OR doc_id % 5 = 0")
def paraphrase_faults(spark, sf):
    text = F.concat_ws(":", "source", "doc_id")
    rows = V.table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), F.concat(text, F.when(F.col("doc_id") % 4 == 0, " ").otherwise("!")).alias("text"), text.alias("source_text"), F.when(F.col("doc_id") % 5 == 0, "mid").otherwise("easy").alias("tier"))
    return records.paraphrase_faults(rows)


@query("SELECT doc_id, lang NOT IN ('en', 'de', 'fr') OR lang IS NULL AS bad_status, CASE WHEN contains(lower(text), 'password') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'license') THEN 1 ELSE 0 END AS n FROM documents WHERE lang IS NULL OR lang NOT IN ('en', 'de', 'fr') OR contains(lower(text), 'password') OR contains(lower(text), 'license')")
def unsafe_requests(spark, sf):
    out = records.unsafe(V.table(spark, sf, "documents"), "text", "lang", ("en", "de", "fr"), ("Password", "license"))
    return out.select("doc_id", "bad_status", F.size("tokens").alias("n"))


_NAME = "['relation', 'yes', 'level'][k + 1]"


@query(""", a AS (SELECT o_orderkey AS item_id, o_orderstatus, k, ['choice', 'noul', 'score'][k + 1] AS kind FROM orders, (SELECT unnest([0, 1, 2]) AS k)),
    b AS (SELECT *, CASE WHEN item_id % 11 = 0 THEN 'response isn' || chr(39) || 't JSON' WHEN (item_id + k) % 5 = 0 THEN 'missing answer for question ' || chr(39) || """ + _NAME + """ || chr(39) WHEN (item_id + k) % 7 = 0 THEN kind || ' answer missing ' || chr(39) || kind || chr(39) || ' field' END AS error FROM a)
    SELECT item_id, """ + _NAME + """ AS question_id, kind, CASE WHEN k = 0 THEN CASE WHEN error IS NULL THEN o_orderstatus ELSE '' END END AS value, CASE WHEN k > 0 THEN CASE WHEN error IS NULL THEN k / 4 + item_id % 2 ELSE 0 END END AS number,
    CASE WHEN k = 0 AND error IS NULL THEN 0.5::DOUBLE END AS confidence, CASE WHEN item_id % 11 > 0 THEN 'm1' END AS model, CASE WHEN item_id % 11 > 0 THEN item_id % 100 ELSE 0 END AS input_tokens, error FROM b""")
def answered_questions(spark, sf):
    """Three questions an order, of which some responses leave one out, garble one, or aren't JSON; none asks the fourth."""
    names, kinds = ["relation", "yes", "level"], ["choice", "noul", "score"]
    orders = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("item_id"), "o_orderstatus")
    asked = orders.select("item_id", F.explode(F.array(*[F.struct(F.lit(n).alias("question_id"), F.lit(k).alias("kind")) for n, k in zip(names, kinds, strict=True)])).alias("q")).select("item_id", "q.*")

    def answer(k: int):
        number = F.concat(F.lit(f'"{kinds[k]}": '), (F.lit(k / 4) + F.col("item_id") % 2).cast("string"))
        field = F.concat(F.lit('"choice": "'), "o_orderstatus", F.lit('", "confidence": 0.5')) if k == 0 else number
        body = F.when((F.col("item_id") + k) % 7 == 0, F.lit('"other": 1')).otherwise(field)
        return F.when((F.col("item_id") + k) % 5 != 0, F.concat(F.lit(f'"{names[k]}": {{'), body, F.lit("}")))

    body = F.concat(F.lit('{"model": "m1", "usage": {"input_tokens": '), (F.col("item_id") % 100).cast("string"), F.lit('}, "answers": {'), F.concat_ws(", ", *[answer(k) for k in range(3)], F.lit('"unasked": {"noul": 1}')), F.lit("}}"))
    responses = orders.select("item_id", F.when(F.col("item_id") % 11 == 0, F.lit("502 Bad Gateway")).otherwise(body).alias("body"))
    return records.answered(asked, responses).select("item_id", "question_id", "kind", "value", "number", "confidence", "model", "input_tokens", "error")

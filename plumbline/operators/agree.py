"""Agreement and classification: kappa, confusion, F1, negation sums, verdicts, prices, text rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, observed and expected agreement, Cohen's kappa (1 or 0 where chance agrees wholly)."""
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    size = cells.agg(F.sum("n").alias("size"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    left, right = cells.groupBy(F.col("a").alias("k")).agg(F.sum("n").alias("x")), cells.groupBy(F.col("b").alias("k")).agg(F.sum("n").alias("y"))
    chance = left.join(right, "k").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("xy"))
    po, pe = F.col("same") / F.col("size"), F.col("xy") / (F.col("size") * F.col("size"))
    out = size.crossJoin(chance).select(F.col("size").alias("n"), po.alias("po"), pe.alias("pe"))
    return out.withColumn("kappa", F.when(1 - F.col("pe") < 1e-12, F.when(1 - F.col("po") < 1e-12, 1.0).otherwise(0.0)).otherwise((F.col("po") - F.col("pe")) / F.when(1 - F.col("pe") < 1e-12, 1.0).otherwise(1 - F.col("pe"))))


def confusion(df: DataFrame, truth: str, pred: str, order: list) -> DataFrame:
    """Counts of every pair of the given labels, zeros included; other labels are left out."""
    spark = df.sparkSession
    spine = spark.range(len(order)).crossJoin(spark.range(len(order)).withColumnRenamed("id", "jd"))
    labels = F.array(*[F.lit(x) for x in order])
    spine = spine.select(F.element_at(labels, (F.col("id") + 1).cast("int")).alias("truth"), F.element_at(labels, (F.col("jd") + 1).cast("int")).alias("pred"))
    counts = df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    return spine.join(counts, ["truth", "pred"], "left").select("truth", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def macro_f1(df: DataFrame, by: list[str], truth: str, pred: str) -> DataFrame:
    """Accuracy and the mean F1 over labels that occur on either side; 0 where undefined."""
    sides = F.explode(F.array(F.struct(F.col(truth).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(pred).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"))))
    marg = df.select(*by, sides.alias("s"), (F.col(truth) == F.col(pred)).cast("int").alias("ok")).groupBy(*by, "s.label").agg(F.sum("s.t").alias("t"), F.sum("s.p").alias("p"), F.sum(F.col("ok") * F.col("s.t")).alias("tp"))
    return marg.groupBy(*by).agg((F.sum("tp") / F.sum("t")).alias("accuracy"), F.avg(2 * F.col("tp") / (F.col("t") + F.col("p"))).alias("macro_f1"))


def verdict(corrected: Column, p: Column, p_holds: Column) -> Column:
    """tracks: at least .09 and p < .05; holds: p_holds < .05 and at most .02; neither or both: inconclusive; null without figures."""
    tracks, holds = (corrected >= 0.09) & (p < 0.05), (p_holds < 0.05) & (corrected <= 0.02)
    return F.when(corrected.isNull() | p.isNull() | p_holds.isNull(), F.lit(None).cast("string")).when(tracks & ~holds, "tracks").when(holds & ~tracks, "holds").otherwise("inconclusive")


def estimated_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up, 1 at least; 0 for an empty text."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor((n + 3) / 4))).cast("long")


def rule_label(text: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """The first rule's label of which a keyword occurs in the text, without regard to case."""
    out = None
    for label, words in rules:
        hit = F.coalesce(text.rlike("(?i)(?:" + "|".join(words) + ")"), F.lit(False))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage with the cost of its tokens by the price of the longest suffix of its model (ties: first in order); cost null
    where none matches. Distinct models meet the prices, and usage meets its model's price by an equal key."""
    models = usage.select("model").distinct()
    hit = models.join(prices, F.endswith(F.lower("model"), F.lower("suffix")))
    best = hit.groupBy("model").agg(F.max_by(F.struct("suffix", "input_rate", "output_rate"), F.struct(F.length("suffix"), -F.xxhash64("suffix"))).alias("__p"))
    out = usage.join(best.select("model", "__p.*"), "model", "left")
    return out.withColumn("cost", (F.col("input_tokens") * F.col("input_rate") + F.col("output_tokens") * F.col("output_rate")) / 1e6)


def kappa_report(df: DataFrame, a: str, b: str, item: str, floor: float = 0.6) -> DataFrame:
    """kappa()'s row with noise (the share of disagreement) and whether kappa reaches the floor."""
    out = kappa(df, a, b)
    return out.withColumns({"noise": 1 - F.col("po"), "passes": F.col("kappa") >= floor})


def disagreements(df: DataFrame, a: str, b: str, item: str) -> DataFrame:
    """(item, a, b) of rows that differ, or where one label is missing, in order of items."""
    return df.where(~F.col(a).eqNullSafe(F.col(b))).select(item, a, b).orderBy(item)


def noise_rate(entropy: Column, ceiling: float) -> Column:
    """Label noise implied by the entropy of votes: half its share of the ceiling."""
    return entropy / (2 * ceiling)


def primitive_disagreement(df: DataFrame, yes: Column, choice: Column, threshold: float = 0.5) -> DataFrame:
    """Share of rows where the yes-probability and the choice's are on different sides."""
    return df.agg(F.count("*").alias("n"), F.avg(((yes >= threshold) != (choice >= 0.5)).cast("int")).alias("rate"))


def negation_sums(df: DataFrame, p: str, negated: str, eps: float = 0.05) -> DataFrame:
    """Of p and its negation's: n, mean, population deviation and exact median of their sum, its mean and median distance from 1, and the share off by over eps."""
    from plumbline.operators.rank import quantiles

    s = df.select((F.col(p) + F.col(negated)).alias("__s")).withColumn("__d", F.abs(F.col("__s") - 1))
    out = s.agg(F.avg("__s").alias("mean"), F.stddev_pop("__s").alias("sd"), F.avg("__d").alias("mean_distance"), F.avg((F.col("__d") > eps).cast("int")).alias("share_off"))
    medians = quantiles(s, [], "__s", {"median": 0.5}).crossJoin(F.broadcast(quantiles(s, [], "__d", {"mad": 0.5}).select("mad")))
    return medians.crossJoin(F.broadcast(out))


def blocks(df: DataFrame, client: str, source: str, labels: list, *, pred: str = "pred", truth: str = "label", conf: str = "conf") -> DataFrame:
    """Per client, and per client and source: n, accuracy, mean confidence, and how often each label is predicted (0 if never)."""
    freq = [F.count_if(F.col(pred) == x).alias(f"n_{x}") for x in labels]
    sets = [[F.col(client)], [F.col(client), F.col(source)]]
    return df.groupingSets(sets, client, source).agg(F.count("*").alias("n"), F.avg((F.col(pred) == F.col(truth)).cast("int")).alias("accuracy"), F.avg(conf).alias("mean_conf"), *freq)


def ledger(calls: DataFrame, order: list[str], cap: float, run_caps: dict[str, float], default_cap: float) -> DataFrame:
    """Spending by day and run kind (columns day, kind, cost) with running totals, over all and per kind, and whether either
    is beyond its cap. Totals are windows over one row a day and kind."""
    from pyspark.sql import Window

    days = calls.groupBy("day", "kind").agg(F.sum("cost").alias("spent"))
    whole = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = Window.partitionBy("kind").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    limit = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in run_caps.items() for x in (F.lit(k), F.lit(v))]), F.col("kind")), F.lit(default_cap))
    out = days.withColumns({"total": F.sum("spent").over(whole), "kind_total": F.sum("spent").over(own), "kind_cap": limit})
    return out.withColumns({"left": F.lit(cap) - F.col("total"), "over": (F.col("total") > cap) | (F.col("kind_total") > F.col("kind_cap"))})


def run_stats(calls: DataFrame, client: str, ok: Column, tokens: str, ts: str) -> DataFrame:
    """Per client: calls, errors, tokens, and calls a second between its first and last."""
    seconds = F.unix_timestamp(F.max(ts)) - F.unix_timestamp(F.min(ts))
    return calls.groupBy(client).agg(F.count("*").alias("calls"), F.count_if(~ok).alias("errors"), F.sum(tokens).alias("tokens"), F.when(seconds > 0, F.count("*") / F.when(seconds > 0, seconds)).alias("per_second"))


def cost_per_thousand(df: DataFrame, by: list[str], cost: str, correct: str) -> DataFrame:
    """Cost of a thousand correct answers; null without a correct one."""
    right = F.sum(F.col(correct).cast("double"))
    return df.groupBy(*by).agg(F.sum(cost).alias("cost"), right.alias("correct"), F.when(right > 0, 1000 * F.sum(cost) / F.when(right > 0, right)).alias("per_thousand"))


def work_plan(clients: DataFrame, items: DataFrame) -> DataFrame:
    """(client, pass, item) of all work: clients (client, repeats; a small table) times items (item)."""
    return items.crossJoin(F.broadcast(clients)).select("client", F.explode(F.sequence(F.lit(0).cast("long"), F.col("repeats") - 1)).alias("pass"), "item")


def strata_sizes(df: DataFrame, stratum: str, item: str, primary: Column) -> DataFrame:
    """Distinct items of each stratum, and whether all its rows are primary."""
    return df.groupBy(stratum).agg(F.count_distinct(item).alias("items"), F.bool_and(primary).alias("all_primary"))


def rule_chain(text: Column, *, rules: list[tuple[Column, str]] = (), patterns: list[tuple[str, str]] = (), keywords: list[tuple[str, list[str]]] = (), majority: str | None = None, default: str | None = None, options: list[str] = ()) -> Column:
    """The first that applies: a rule (a condition and its label), a pattern's label, a keyword list's label, the majority, the
    default, the first option. Case doesn't count; null text matches nothing."""
    steps = [(c, x) for c, x in rules] + [(text.rlike(f"(?i){p}"), x) for p, x in patterns]
    steps += [(F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(F.lower(text), w)), x) for x, words in keywords]
    last = F.lit(majority or default or (options[0] if options else None))
    out = None
    for condition, label in steps:
        here = F.coalesce(condition, F.lit(False))
        out = F.when(here, label) if out is None else out.when(here, label)
    return last if out is None else out.otherwise(last)


def dry_run(tokens: DataFrame, clients: DataFrame) -> DataFrame:
    """Per client (client, repeats, input_rate, output_rate, output_tokens; a small table): calls and cost of asking about every
    row of tokens (column tokens) as often as it repeats."""
    sums = tokens.agg(F.count("*").alias("items"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    out = clients.crossJoin(F.broadcast(sums))
    cost = (F.col("tokens") * F.col("input_rate") + F.col("items") * F.col("output_tokens") * F.col("output_rate")) * F.col("repeats") / 1e6
    return out.select("client", (F.col("items") * F.col("repeats")).alias("calls"), (F.col("tokens") * F.col("repeats")).alias("input_tokens"), cost.alias("cost"))

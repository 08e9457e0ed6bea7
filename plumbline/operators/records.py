"""Prediction records: flattening of decisions, normalised probabilities, pass selection, joins with labels and texts.

A record has item_id, client, pass, tier, role, error, label, latency_ms, and either a flat map `probabilities` with a
`choice`, or `decisions`: an array of (question_id, kind, choice, value, probabilities, latency_ms, model). `seq`, an
order of arrival, settles what would else depend on the order of files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import expr as X

DECISION = "question_id string, kind string, choice string, value double, probabilities map<string,double>, latency_ms double, model string"
#: A triplet of yes-probabilities with a sum below this is nearly zero.
NEAR_ZERO = 1e-6


def label_order(df: DataFrame, label: str) -> list[str]:
    """The labels that occur, in order; for sets of labels of a bounded size."""
    return sorted(r[0] for r in df.select(label).where(F.col(label).isNotNull()).distinct().collect())


def vector(probabilities: Column, order: list[str]) -> Column:
    """A map's values in label order, missing ones 0, over their sum; of a sum of zero, as they are."""
    return X.normalised(F.array(*[F.coalesce(F.try_element_at(probabilities, F.lit(k)), F.lit(0.0)) for k in order]))


def relation(decisions: Column, name: str = "relation") -> Column:
    """The decision named `name`, else the first choice whose name has no 'noul', else the first of all."""
    named = F.filter(decisions, lambda d: d["question_id"] == name)
    choices = F.filter(decisions, lambda d: (d["kind"] == "choice") & ~F.contains(d["question_id"], F.lit("noul")))
    return F.coalesce(F.try_element_at(named, F.lit(1)), F.try_element_at(choices, F.lit(1)), F.try_element_at(decisions, F.lit(1)))


def noul_value(decision: Column) -> Column:
    """P(true), else the value, else the largest probability, else 0."""
    p = decision["probabilities"]
    return F.coalesce(F.try_element_at(p, F.lit("true")), decision["value"], F.array_max(F.map_values(p)), F.lit(0.0))


def triplet(yes: Column) -> Column:
    """(p, near_zero_sum): three yes-probabilities as a distribution; uniform and marked where they are nearly all 0; p is
    null where one is missing."""

    def of(yes: Column, s: Column) -> Column:
        whole = (F.size(yes) == 3) & F.forall(yes, lambda x: x.isNotNull())
        p = F.when(whole & (s < NEAR_ZERO), F.array(*[F.lit(1 / 3)] * 3)).when(whole, F.transform(yes, lambda x: x / F.when(s < NEAR_ZERO, 1.0).otherwise(s)))
        return F.struct(p.alias("p"), (whole & (s < NEAR_ZERO)).alias("near_zero_sum"))

    return X.once(yes, lambda yes: X.once(X.total(F.transform(yes, lambda x: F.coalesce(x, F.lit(0.0)))), lambda s: of(yes, s)))


def nouls(decisions: Column, names: list[str]) -> Column:
    """triplet() of the decisions with these names, in order; without value, a decision counts as missing."""
    one = lambda n: F.try_element_at(F.transform(F.filter(decisions, lambda d: d["question_id"] == n), lambda d: F.coalesce(F.try_element_at(d["probabilities"], F.lit("true")), d["value"])), F.lit(1))
    return triplet(F.array(*[one(n) for n in names]))


def flattened(live: DataFrame, noul_names: list[str]) -> DataFrame:
    """Records with decisions as flat ones: that of `relation`, with the yes-probabilities beside it. Rows in error, or
    without probabilities, are left out."""
    d = live.where(~F.coalesce("error", F.lit(False))).withColumns({"__d": relation(F.col("decisions")), "__n": nouls(F.col("decisions"), noul_names)})
    flat = d.withColumns({"choice": F.col("__d.choice"), "probabilities": F.col("__d.probabilities"), "noul": F.col("__n.p"), "near_zero_sum": F.col("__n.near_zero_sum")})
    return flat.where("probabilities is not null").drop("__d", "__n", "decisions")


def with_labels(rows: DataFrame, labels: DataFrame | None = None, dists: DataFrame | None = None) -> DataFrame:
    """rows with label of `labels` (item_id, label; rows without one go) and label_dist of `dists` (kept without one)."""
    if labels is not None:
        rows = rows.drop("label").join(labels.select("item_id", "label"), "item_id")
    return rows if dists is None else rows.drop("label_dist").join(dists.select("item_id", "label_dist"), "item_id", "left")


def normalised(flat: DataFrame, live: DataFrame, noul_names: list[str], labels: DataFrame | None = None, dists: DataFrame | None = None) -> DataFrame:
    """Flat records (with probabilities and label) and flattened live ones, as one table with labels and label_dist."""
    whole = flat.where("probabilities is not null and label is not null").unionByName(flattened(live, noul_names), allowMissingColumns=True)
    return with_labels(whole, labels, dists)


def at_strata(rows: DataFrame, tiers: list[str]) -> DataFrame:
    """Primary rows of the tiers, with probabilities; soft: whether all of them have a label_dist, and null dists if not."""
    kept = rows.where(F.col("tier").isin(tiers) & (F.coalesce("role", F.lit("primary")) != "paraphrase") & F.col("probabilities").isNotNull())
    soft = kept.agg(F.coalesce(F.bool_and(F.col("label_dist").isNotNull()), F.lit(False)).alias("soft"))
    return kept.crossJoin(F.broadcast(soft)).withColumn("label_dist", F.when(F.col("soft"), F.col("label_dist")))


def first_pass(rows: DataFrame, by: list[str], order: str = "seq") -> DataFrame:
    """Of each group the record of pass 0 or 1 if there is any, else of the lowest pass; ties by order."""
    number = F.coalesce("pass", F.lit(0))
    rank = F.struct(~number.isin(0, 1), number, F.col(order))
    return rows.groupBy(*by).agg(F.min_by(F.struct(*rows.columns), rank).alias("__r")).select("__r.*")


def fixed_pass(rows: DataFrame, number: int, by: list[str], order: str = "seq") -> DataFrame:
    """Of each group the last record of one pass."""
    return rows.where(F.coalesce("pass", F.lit(0)) == number).groupBy(*by).agg(F.max_by(F.struct(*rows.columns), F.col(order)).alias("__r")).select("__r.*")


def arm(rows: DataFrame, number: int, by: list[str], order: list[str], seq: str = "seq") -> DataFrame:
    """Of each group its last record of the pass, or of any pass where it has none; p in label order over its sum, and pred:
    the choice where it is one of the labels, else the first largest."""
    here = F.coalesce("pass", F.lit(0)) == number
    rows = rows.groupBy(*by).agg(F.max_by(F.struct(*rows.columns), F.struct(here, F.col(seq))).alias("__r")).select("__r.*")
    p = vector(F.col("probabilities"), order)
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.coalesce("choice", F.lit("")))
    return rows.withColumn("p", p).withColumn("pred", F.when(place > 0, place - 1).otherwise(X.argmax(F.col("p"))).cast("int"))


def zero_shot(choice: Column, probabilities: Column, order: list[str]) -> Column:
    """(p, pred): p uniform where its sum is zero; pred the choice if it is a label, else the first largest."""
    raw = F.array(*[F.coalesce(F.try_element_at(probabilities, F.lit(k)), F.lit(0.0)) for k in order])
    s = X.total(raw)
    p = F.when(s > 0, F.transform(raw, lambda x: x / F.when(s > 0, s).otherwise(1.0))).otherwise(F.array(*[F.lit(1 / len(order))] * len(order)))
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.coalesce(choice, F.lit("")))
    return F.struct(p.alias("p"), F.when(place > 0, place - 1).otherwise(X.argmax(p)).cast("int").alias("pred"))


def whole_passes(rows: DataFrame, by: list[str], p: str, passes: int, *more: Column) -> DataFrame:
    """Per group `passes`, an array of (pass, p) in order of passes, and more aggregates; an error for a group without exactly
    that many passes, without a vector, or with vectors of several lengths. No group brings more than one row beyond `passes`
    together."""
    turn = F.row_number().over(Window.partitionBy(*by).orderBy("pass"))
    some = rows.withColumn("__turn", turn).where(F.col("__turn") <= passes + 1)
    got = some.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pass", F.col(p).alias("p")))).alias("passes"), *more)
    lengths, numbers = (F.array_distinct(F.transform("passes", f)) for f in (lambda x: F.greatest(F.lit(0), F.size(x["p"])), lambda x: x["pass"]))
    bad = (F.size("passes") != passes) | (F.size(F.array_compact(numbers)) != passes) | (F.size(lengths) != 1) | (lengths[0] == 0)
    stop = F.raise_error(F.concat(F.lit(f"not {passes} passes: "), F.to_json(F.struct(*by))))
    return got.withColumn("passes", F.when(bad, stop).otherwise(F.col("passes")))


def mean_vector(passes: Column) -> Column:
    """Elementwise means of the vectors of whole_passes(); null elements are left out."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))

    def add(s: Column, x: Column) -> Column:
        return F.struct((s["sum"] + F.coalesce(x, F.lit(0.0))).alias("sum"), (s["n"] + x.isNotNull().cast("int")).alias("n"))

    def mean(at: Column) -> Column:
        return F.aggregate(passes, start, lambda s, x: add(s, x["p"][at].cast("double")), lambda s: s["sum"] / F.nullif(s["n"], F.lit(0)))

    return F.transform(F.sequence(F.lit(0), F.size(passes[0]["p"]) - 1), mean)


def mean_over_passes(rows: DataFrame, by: list[str], p: str, passes: int) -> DataFrame:
    """Elementwise means of p; an error for a group without exactly that many passes. Rows without elements don't count."""
    return whole_passes(rows.where(F.size(p) > 0), by, p, passes).select(*by, mean_vector(F.col("passes")).alias(p))


def signals(rows: DataFrame, names: list[str], order: list[str]) -> DataFrame:
    """Per item and client its last record of the lowest pass: latency (the largest of its decisions), the choice, and
    signals, a map with the value of each named decision, 0 where it has none. Items without label or tier go."""
    number = F.coalesce("pass", F.lit(0))
    best = rows.groupBy("item_id", "client").agg(F.min_by(F.struct(*rows.columns), F.struct(number, -F.col("seq"))).alias("r")).select("r.*")
    one = lambda n: F.coalesce(F.try_element_at(F.transform(F.filter("decisions", lambda d: d["question_id"] == n), noul_value), F.lit(1)), F.lit(0.0))
    out = best.withColumns({"latency": F.array_max(F.transform("decisions", lambda d: d["latency_ms"])), "signals": F.create_map(*[x for n in names for x in (F.lit(n), one(n))]), "choice": relation(F.col("decisions"))["choice"]})
    return out.where("label is not null and tier is not null").select("item_id", "client", "pass", "tier", "label", "choice", "latency", "signals")


def summary(decisions: Column) -> Column:
    """(model, choice, latency_ms, n, n_empty): the first model, the choice, the largest latency, and decisions with no answer."""
    empty = F.filter(decisions, lambda d: d["choice"].isNull() & d["value"].isNull() & d["probabilities"].isNull())
    return F.struct(F.try_element_at(F.filter(decisions["model"], lambda m: m.isNotNull()), F.lit(1)).alias("model"), relation(decisions)["choice"].alias("choice"), F.array_max(decisions["latency_ms"]).alias("latency_ms"), F.size(decisions).alias("n"), F.size(empty).alias("n_empty"))


def fingerprint(decisions: Column) -> Column:
    """Decisions in order of their names, probabilities to eight places, as one string: equal for equal answers."""
    shown = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.8f", F.bround(e["value"], 8))))), ",")
    each = F.transform(decisions, lambda d: F.concat_ws("|", d["question_id"], F.coalesce(d["choice"], F.lit("")), F.coalesce(shown(d["probabilities"]), F.lit(""))))
    return F.array_join(F.array_sort(each), ";")


def parsed(body: Column) -> Column:
    """Decisions of a wire response, {"model": ..., "answers": {name: {"type", "choice", "noul", "score", "probabilities"}}}:
    one a name, in order of names. A yes-no answer has no confidence of its own; a score stays a number."""
    schema = "model string, answers map<string,struct<type:string,choice:string,noul:double,score:double,probabilities:map<string,double>>>"
    one = lambda r, e: F.struct(e["key"].alias("question_id"), e["value"]["type"].alias("kind"), e["value"]["choice"].alias("choice"), F.coalesce(e["value"]["noul"], e["value"]["score"]).alias("value"), e["value"]["probabilities"].alias("probabilities"), F.lit(None).cast("double").alias("latency_ms"), r["model"].alias("model"))
    by_name = lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    return X.once(F.from_json(body, schema), lambda r: F.transform(F.array_sort(F.map_entries(r["answers"]), by_name), lambda e: one(r, e)))


def error_decision(question: Column, kind: Column) -> Column:
    """What stands for a question without an answer: no choice, a value of 0 for yes-no questions, no probabilities."""
    return F.struct(question.alias("question_id"), kind.alias("kind"), F.lit(None).cast("string").alias("choice"), F.when(kind == "noul", 0.0).alias("value"), F.lit(None).cast("map<string,double>").alias("probabilities"), F.lit(None).cast("double").alias("latency_ms"), F.lit(None).cast("string").alias("model"))


def answered(asked: DataFrame, responses: DataFrame, item: str = "item_id") -> DataFrame:
    """A row for each question asked (item, question_id, kind), whatever the response: value (text of a choice), number
    (yes-no and score), probabilities, confidence (never of a yes-no answer), model, tokens and error. responses: item and
    body, wire JSON read as VARIANT: {"model", "usage": {"input_tokens", "output_tokens"}, "answers": {name: {...}}}. A
    question without an answer, and an answer without its field, becomes an error row with a kind's empty value, never a
    missing one; answers that nobody asked for are left out. A body that isn't a JSON object answers nothing."""
    v = F.try_parse_json("body")
    tokens = [F.coalesce(F.try_variant_get(v, f"$.usage.{t}", "long"), F.lit(0).cast("long")).alias(t) for t in ("input_tokens", "output_tokens")]
    read = responses.select(item, (~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))).alias("__broken"), F.try_variant_get(v, "$.model", "string").alias("model"), *tokens, F.try_variant_get(v, "$.answers", "map<string, variant>").alias("__answers"))
    rows = asked.select(item, "question_id", "kind").join(read, item, "left").withColumn("__a", F.try_element_at("__answers", F.col("question_id")))
    get = lambda name, kind: F.try_variant_get("__a", f"$.{name}", kind)
    number = F.when(F.col("kind") == "noul", get("noul", "double")).when(F.col("kind") == "score", get("score", "double"))
    choice = F.when(F.col("kind") == "choice", get("choice", "string"))
    missing = F.col("__a").isNull() | F.coalesce(F.is_variant_null("__a"), F.lit(True))
    error = F.when(F.coalesce("__broken", F.lit(False)), F.lit("response isn't JSON")).when(missing, F.concat(F.lit("missing answer for question '"), "question_id", F.lit("'")))
    error = error.when(((F.col("kind") == "choice") & choice.isNull()) | ((F.col("kind") != "choice") & number.isNull()), F.concat("kind", F.lit(" answer missing '"), "kind", F.lit("' field")))
    return rows.select(
        item,
        "question_id",
        "kind",
        F.when(F.col("kind") == "choice", F.coalesce(choice, F.lit(""))).alias("value"),
        F.when(F.col("kind") != "choice", F.coalesce(number, F.lit(0.0))).alias("number"),
        F.when((F.col("kind") != "noul") & error.isNull(), get("probabilities", "map<string, double>")).alias("probabilities"),
        F.when((F.col("kind") != "noul") & error.isNull(), get("confidence", "double")).alias("confidence"),
        "model",
        *[F.coalesce(t, F.lit(0).cast("long")).alias(t) for t in ("input_tokens", "output_tokens")],
        error.alias("error"),
    )


def confidently_wrong(rows: DataFrame, conf: str, correct: str, item: str, n: int = 85) -> DataFrame:
    """The n rows of most confidence with confidence of .75 or more and soft correctness below .35 (a report)."""
    return rows.where((F.col(conf) >= 0.75) & (F.col(correct) < 0.35)).orderBy(F.desc(conf), item).limit(n)


def source_id(item_id: Column, source_item_id: Column) -> Column:
    """What a paraphrase was made of: its source's id, else its own before '::paraphrase'."""
    return F.coalesce(source_item_id, F.substring_index(item_id, "::paraphrase", 1))


def contamination(rows: DataFrame, client: str = "client") -> DataFrame:
    """Per client: pairs of an original and its paraphrase (the last row of each, by seq), both accuracies and the drop;
    a client without pairs is unscored. rows: item_id, source_item_id, role, ok (correct or not), seq."""
    key = F.when(F.col("role") == "paraphrase", source_id(F.col("item_id"), F.col("source_item_id"))).otherwise(F.col("item_id"))
    last = rows.withColumn("__key", key).groupBy(client, "__key", (F.col("role") == "paraphrase").alias("__p")).agg(F.max_by("ok", "seq").alias("ok"))
    both = last.groupBy(client, "__key").agg(F.max(F.when(~F.col("__p"), F.col("ok").cast("int"))).alias("a"), F.max(F.when(F.col("__p"), F.col("ok").cast("int"))).alias("b"))
    pair = F.col("a").isNotNull() & F.col("b").isNotNull()
    out = both.groupBy(client).agg(F.count_if(pair).alias("n"), F.avg(F.when(pair, F.col("a"))).alias("original"), F.avg(F.when(pair, F.col("b"))).alias("paraphrase"))
    return out.withColumns({"drop": F.col("original") - F.col("paraphrase"), "status": F.when(F.col("n") > 0, "scored").otherwise("unscored")})


def aligned(first: DataFrame, others: dict[str, DataFrame], item: str, value: str) -> DataFrame:
    """Items of the first arm with the value of each other arm; items that one of them lacks go."""
    out = first.select(item, F.col(value).alias("first"))
    for name, df in others.items():
        out = out.join(df.select(item, F.col(value).alias(name)), item, "left")
    return out.where(" and ".join(f"`{c}` is not null" for c in out.columns[1:]))


def hydrated(items: DataFrame, cache: DataFrame, paraphrases: DataFrame) -> DataFrame:
    """items (item_id, text_status, text) with the text of the cache (status 'cached') or of the paraphrases ('paraphrase'),
    else their own; `missing` where the lookup has none."""
    out = items.join(cache.select("item_id", F.col("text").alias("__c")), "item_id", "left").join(paraphrases.select("item_id", F.col("text").alias("__p")), "item_id", "left")
    text = F.when(F.col("text_status") == "cached", F.col("__c")).when(F.col("text_status") == "paraphrase", F.col("__p")).otherwise(F.col("text"))
    return out.withColumn("text", text).withColumn("missing", F.col("text").isNull()).drop("__c", "__p")


def overlap(ids: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """The ids that must not be there; `assert_disjoint` raises where there are any."""
    return ids.select(key).distinct().join(excluded.select(key), key, "left_semi")


def assert_disjoint(ids: DataFrame, excluded: DataFrame, key: str) -> None:
    some = [str(r[0]) for r in overlap(ids, excluded, key).orderBy(key).limit(5).collect()]
    if some:
        raise ValueError(f"ids that must be left out: {', '.join(some)}")


def locked(rows: DataFrame, lock: DataFrame, key: str) -> DataFrame:
    """rows of the locked ids with their place (column ord of lock), missing ids as rows of nulls with `missing`."""
    return lock.select(key, "ord").join(rows.withColumn("__here", F.lit(True)), key, "left").withColumn("missing", F.col("__here").isNull()).drop("__here")


def canonical(fields: dict[str, Column]) -> Column:
    """JSON of the fields with keys in order, no spaces, nulls left out."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def request_digest(state: dict[str, Column], questions: Column, allowed: tuple[str, ...] = ("premise", "hypothesis", "pair_id", "source")) -> Column:
    """SHA-256 of the canonical request: the allowed fields of the state and the list of questions (structs)."""
    body = F.to_json(F.struct(F.transform(questions, lambda q: q).alias("questions"), F.struct(*[state[k].alias(k) for k in sorted(state) if k in allowed]).alias("state")))
    return F.sha2(body, 256)


def redacted(df: DataFrame, secret: tuple[str, ...] = ("premise", "hypothesis", "text")) -> DataFrame:
    """df without the columns that hold source sentences."""
    return df.drop(*[c for c in df.columns if c.lower() in secret])


def leaks(df: DataFrame, column: str, sentences: DataFrame, key: str) -> DataFrame:
    """Rows whose column still holds the sentence of their own key."""
    return df.join(sentences.select(key, F.col("sentence").alias("__s")), key).where((F.length("__s") > 0) & F.contains(F.col(column), F.col("__s"))).drop("__s")


def run_kind(name: Column) -> Column:
    low = F.lower(name)
    return F.when(F.contains(low, F.lit("pilot")), "pilot").when(F.contains(low, F.lit("exp1")), "exp1").otherwise("other")


def digest_check(log: DataFrame, cache: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows of the log with status: ok, mismatch, or missing from the cache, by the digest made anew there."""
    out = log.select(key, digest).join(cache.select(key, F.col(digest).alias("__again")), key, "left")
    return out.withColumn("status", F.when(F.col("__again").isNull(), "missing").when(F.col("__again") == F.col(digest), "ok").otherwise("mismatch")).drop("__again")


def premise_pair(state: Column) -> Column:
    """(premise, hypothesis) of a JSON state; null unless both are there and not blank."""
    one = lambda k: F.nullif(F.trim(F.get_json_object(state, f"$.{k}")), F.lit(""))
    a, b = one("premise"), one("hypothesis")
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("premise"), b.alias("hypothesis")))


def source_of(items: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """(item_id, source) of the items whose source is one of the allowed."""
    return items.where(F.col("source").isin(*allowed)).select("item_id", "source")


def public(items: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The columns that may be shown, in this order, of those that items has."""
    return items.select(*[c for c in columns if c in items.columns])


def paraphrase_faults(rows: DataFrame) -> DataFrame:
    """Paraphrases (item_id, text, source_text, tier) that equal their source, or whose tier isn't easy or hard."""
    same = F.trim("text").eqNullSafe(F.trim("source_text"))
    return rows.where(same | ~F.coalesce(F.col("tier").isin("easy", "hard"), F.lit(False))).select("item_id", same.alias("same"))


def unsafe(rows: DataFrame, body: str, status: str, allowed: tuple[str, ...], forbidden: tuple[str, ...]) -> DataFrame:
    """Rows whose status isn't one of the allowed, or whose request body holds a forbidden token, with what is wrong."""
    held = F.filter(F.array(*[F.lit(t) for t in forbidden]), lambda t: F.contains(F.lower(F.coalesce(F.col(body), F.lit(""))), F.lower(t)))
    odd = ~F.coalesce(F.col(status).isin(*allowed), F.lit(False))
    return rows.withColumns({"bad_status": odd, "tokens": held}).where(odd | (F.size("tokens") > 0))

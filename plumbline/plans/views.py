"""Evaluation tables made of the star schema: votes, model probabilities, calibration rows, binary outcomes, repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.expr import argmax, confidence, entropy_bits, soft_correctness
from plumbline.sources.tables import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shares(counts: list[str]):
    whole = sum((F.col(c) for c in counts[1:]), F.col(counts[0]))
    return F.array(*[F.col(c) / whole for c in counts])


def votes(spark: SparkSession, sf: str) -> DataFrame:
    """Per customer: label_dist over order states F, O, P, its entropy (12 places) and stratum by its quartiles."""
    n = {c: F.count_if(F.col("o_orderstatus") == c.upper()).alias(c) for c in "fop"}
    rows = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("item")).agg(*n.values(), F.count("*").alias("n"))
    rows = rows.withColumn("label_dist", shares(["f", "o", "p"])).withColumn("entropy", F.round(entropy_bits(F.col("label_dist")), 12) + 0.0)
    q = rows.agg(F.percentile("entropy", 0.25).alias("q25"), F.percentile("entropy", 0.75).alias("q75"))
    stratum = F.when(F.col("entropy") <= F.col("q25"), "easy").when(F.col("entropy") >= F.col("q75"), "hard").otherwise("mid")
    return rows.crossJoin(F.broadcast(q)).withColumn("stratum", stratum).drop("q25", "q75")


def probs(spark: SparkSession, sf: str) -> DataFrame:
    """Per customer: the shares of return flags A, N, R of their lines."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("item"))
    n = [F.count_if(F.col("l_returnflag") == c.upper()).alias(c) for c in "anr"]
    return lines.join(orders, "l_orderkey").groupBy("item").agg(*n).select("item", shares(["a", "n", "r"]).alias("probs"))


def calibration(spark: SparkSession, sf: str) -> DataFrame:
    """votes with probs: pred, conf, soft correctness, majority, hard correctness."""
    v = votes(spark, sf).join(probs(spark, sf), "item")
    p, d = F.col("probs"), F.col("label_dist")
    out = v.select("item", "stratum", "entropy", "label_dist", "probs", "n", argmax(p).alias("pred"), confidence(p).alias("conf"), soft_correctness(p, d).alias("correct"), argmax(d).alias("majority"))
    return out.withColumn("hard", F.col("pred") == F.col("majority"))


def binary(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents: p from their length, quality y and toxicity y2."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", "source", "lang")
    rows = table(spark, sf, "labels").join(docs, "doc_id")
    p = (F.col("n_chars") % 101) / 100.0
    return rows.select("doc_id", "source", "lang", p.alias("p"), F.col("quality").alias("y"), F.col("toxic").alias("y2"), (p >= 0.5).cast("int").alias("pred"), F.greatest(p, 1 - p).alias("conf"), ((p >= 0.5).cast("int") == F.col("quality")).cast("int").alias("correct"))


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of an order as repeats: decision, confidence, probs, tier, client."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    lines = spread(table(spark, sf, "lineitem"), "l_orderkey").withColumn("repeat", F.row_number().over(w))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("tier"))
    c = 0.5 + 5 * F.col("l_discount")
    return lines.join(orders, "l_orderkey").select(F.col("l_orderkey").alias("item"), "repeat", F.col("l_returnflag").alias("decision"), c.alias("confidence"), F.array(c, 1 - c).alias("probs"), "tier", (F.col("l_suppkey") % 3).alias("client"))

"""JSON lines: strict and lenient scans, a sorted sink, completed keys, and the shapes of prediction rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREDICTION = "item_id string, client string, pass int, tier string, label string, choice string, probabilities map<string,double>, latency_ms double, input_tokens long, output_tokens long, error boolean, unit_key string"


def _parsed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(path, value, r) of the lines that aren't blank; r null where a line isn't an object of the schema."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value").where("trim(value) <> ''")
    r = F.from_json("value", f"{schema}, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    return lines.withColumn("__r", r).withColumn("r", F.when(F.col("__r.__bad").isNull() & F.col("value").rlike(r"^\s*\{"), F.col("__r"))).drop("__r")


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of JSON lines; blank lines are skipped. A line that isn't JSON is a ValueError, one that isn't an object a
    TypeError, both with file and line; a missing file is Spark's own error."""
    rows = _parsed(spark, path, schema)
    bad = rows.where("r is null").select("path", "value").limit(1).collect()
    if bad:
        file, line = bad[0]
        numbered = spark.read.format("binaryFile").load(file).select(F.posexplode(F.split(F.col("content").cast("string"), "\r?\n")).alias("at", "value"))
        at = numbered.where(F.col("value") == line).agg(F.min("at")).first()[0]
        kind = ValueError if spark.range(1).select(F.try_parse_json(F.lit(line)).isNull()).first()[0] else TypeError
        raise kind(f"{file}:{'?' if at is None else at + 1}: not {'JSON' if kind is ValueError else 'an object of the schema'}")
    return rows.select("r.*").drop("__bad")


def read_lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Leaves malformed lines out, also where few or no columns are read."""
    return _parsed(spark, path, schema).where("r is not null").select("r.*").drop("__bad")


def write(df: DataFrame, path: str) -> None:
    """One object per line, keys in order."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode("overwrite").text(path)


def completed_keys(raw: DataFrame) -> DataFrame:
    """Distinct keys of rows without an error: unit_key, or pass:item:client."""
    key = F.coalesce("unit_key", F.concat_ws(":", F.coalesce("pass", F.lit(0)), "item_id", "client"))
    return raw.where(~F.coalesce("error", F.lit(False))).select(key.alias("unit_key")).distinct()


def pending(required: DataFrame, done: DataFrame) -> DataFrame:
    return required.join(done, "unit_key", "left_anti")


def validated(items: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """One row: repeated and unmatched keys of either side."""
    repeated = lambda d, n: d.groupBy(key).count().where("count > 1").agg(F.count("*").alias(n))
    missing = lambda a, b, n: a.join(b, key, "left_anti").agg(F.count("*").alias(n))
    parts = [repeated(items, "repeated_items"), repeated(labels, "repeated_labels"), missing(items, labels, "items_without_label"), missing(labels, items, "labels_without_item")]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # one row each
    return out


def load_dataset(items: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """items with their labels; an error for repeated keys, items without a label, and labels without an item."""
    found = validated(items, labels, key).first()
    wrong = {c: found[c] for c in found.asDict() if found[c]}
    if wrong:
        raise ValueError(", ".join(f"{c}: {n}" for c, n in wrong.items()))
    return items.join(labels, key)

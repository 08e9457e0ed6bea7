"""Extensions on streams: calibration per time window, spending per client, log rows without repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.expr import bin_digitize


def calibration(rows: DataFrame, ts: str = "ts", *, width: str = "1 day", late: str = "1 hour", bins: int = 10) -> DataFrame:
    """Per window and bin: n, summed confidence, summed correctness; ECE is a sum over these rows."""
    return rows.withWatermark(ts, late).groupBy(F.window(ts, width).alias("window"), bin_digitize(F.col("conf"), bins).alias("bin")).agg(F.count("*").alias("n"), F.sum("conf").alias("conf"), F.sum("correct").alias("correct"))


def spending(rows: DataFrame, ts: str = "ts", *, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    return rows.withWatermark(ts, late).groupBy(F.window(ts, width).alias("window"), "client").agg(F.sum("cost").alias("cost"))


def without_repeats(rows: DataFrame, key: str = "unit_key", ts: str = "ts", *, late: str = "1 hour") -> DataFrame:
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])

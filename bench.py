"""Headline queries timed on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
HEADLINE = ["ece_by_stratum", "reliability_bins", "delta_ece", "bootstrap_accuracy", "auroc_one_vs_rest", "spearman_conf_entropy", "divergences", "label_stability", "distribution_stability", "equal_n_subsample", "latency_percentiles", "temperature_grid"]


def main() -> None:
    from pyspark.sql import SparkSession

    from plumbline.plans.registry import QUERIES

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["ece_by_stratum"](spark, sf).write.format("noop").mode("overwrite").save()  # starts the JVM's compilers
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    from pyspark.sql import functions as F

    from plumbline.functions import expr as X
    from plumbline.operators import resample
    from plumbline.plans import views as V

    rows = V.calibration(spark, sf)
    items, began = rows.where("stratum <> 'mid'").count(), time.time()
    resample.delta_ece(rows, "stratum", "hard", "easy", X.bin_digitize(F.col("conf"), 10), "item", replicates=2_000).write.format("noop").mode("overwrite").save()
    boot = time.time() - began
    spark.stop()
    rates = {"items_times_replicates_per_sec": round(items * 2_000 / boot)}
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, **rates, "sf": sf.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()

"""Tables written once to the shared folder and read back, where a plan would else repeat what is below; tables spread over tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a table that one task orders or groups, about.
ROWS = 1 << 18


def stored(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:  # a session without a cluster's folder, as in tests
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="plumbline-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession, rows: int) -> int:
    """The number of parts of about ROWS rows of a table, at least that of the session."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df by a hash of keys, in parts of about ROWS rows, so that a task's memory doesn't grow with the table. Windows, joins and
    groups by these keys (and more) use the same parts."""
    return df.repartition(parts(df.sparkSession, df.count()), *keys)

"""Tables that grow by commits: guarded appends that a repeated batch doesn't repeat, and keyed upserts by bucket.

A commit writes its rows to a folder of its own, which no reader looks at, and then adds one entry to the table's log:
the batch it settles, and which parts of the table now lie in which folder. An entry is a file that is created once and
never changed, so a commit is there as a whole or not at all; two writers that meet at a number take turns. A batch
that is in the log is not written again, which makes a stream's sink exact over restarts. Folders of commits that never
reached the log are garbage, which `vacuum` removes.

Appends add a part per batch. Upserts keep one part per bucket of the key: only the buckets that a batch hits are read,
merged and written; the others keep their files. The log is read whole by the driver: a line per commit, of the number of
its parts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


HELD = "a row holds a secret; nothing was written"


def text_of(df: DataFrame) -> Column:
    """All string values of a row, those within structs, arrays and maps included, as they are and not as JSON writes
    them, one after the other."""

    def strings(c: Column, kind: T.DataType) -> list[Column]:
        if isinstance(kind, T.StringType):
            return [F.array(c)]
        if isinstance(kind, T.StructType):
            return [s for f in kind for s in strings(c.getField(f.name), f.dataType)]
        if isinstance(kind, T.ArrayType):
            inner = lambda x: F.flatten(F.array(*parts)) if (parts := strings(x, kind.elementType)) else F.array().cast("array<string>")
            return [F.flatten(F.coalesce(F.transform(c, inner), F.array().cast("array<array<string>>")))]
        if isinstance(kind, T.MapType):
            return strings(F.map_keys(c), T.ArrayType(kind.keyType)) + strings(F.map_values(c), T.ArrayType(kind.valueType))
        return []

    every = [F.coalesce(s, F.array().cast("array<string>")) for f in df.schema for s in strings(F.col(f"`{f.name}`"), f.dataType)]
    return F.array_join(F.flatten(F.array(*every)), "\n") if every else F.lit("")


def guarded(df: DataFrame, secrets: list[str]) -> DataFrame:
    """df, whose evaluation fails at the first row that holds one of the secrets, whatever the columns' types."""
    held = F.lit(False)
    for s in filter(None, secrets):
        held = held | F.contains(text_of(df), F.lit(s))
    stop = F.raise_error(F.lit(HELD)).cast("boolean")
    return df.where(F.when(held, stop).otherwise(True))


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)


def entries(spark: SparkSession, path: str) -> list[dict]:
    """The log's entries by number. A file that isn't whole belongs to a writer that died in it, and counts as empty."""
    fs, at = _fs(spark, path)
    log = f"{path}/_log"
    if not fs.exists(at(log)):
        return []
    names = sorted(f.getPath().getName() for f in fs.listStatus(at(log)))
    out = []
    for name in names:
        stream = fs.open(at(f"{log}/{name}"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        try:
            out.append({"number": int(name.split(".")[0]), **json.loads(text)})
        except ValueError:
            out.append({"number": int(name.split(".")[0]), "batch": None, "parts": {}})
    return out


def commit(spark: SparkSession, path: str, batch: str, parts: dict[str, str], seen: int) -> bool:
    """Adds an entry after number `seen`; False if another writer took the number first."""
    fs, at = _fs(spark, path)
    target = at(f"{path}/_log/{seen + 1:012d}.json")
    try:
        out = fs.create(target, False)
    except Exception as error:  # the JVM's own error, where the file is there
        if fs.exists(target):
            return False
        raise error
    out.write(bytearray(json.dumps({"batch": batch, "parts": parts}, sort_keys=True).encode()))
    out.close()
    return True


def state(log: list[dict]) -> tuple[int, dict[str, str], set[str]]:
    """The last number, each part's folder, and the batches that are done."""
    parts: dict[str, str] = {}
    for e in log:
        parts |= e["parts"]
    return (log[-1]["number"] if log else 0), parts, {e["batch"] for e in log if e["batch"] is not None}


def read(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The table as of its last commit."""
    _, parts, _ = state(entries(spark, path))
    folders = sorted({f"{path}/{f}" for f in parts.values() if f})
    reader = spark.read.schema(schema)
    return reader.parquet(*folders) if folders else spark.createDataFrame([], schema)


def append(df: DataFrame, path: str, batch: str, secrets: list[str] | None = None) -> bool:
    """df as the batch's rows: committed once, however often it is tried. False if it was done before."""
    spark, folder = df.sparkSession, None
    while True:
        seen, _, done = state(entries(spark, path))
        if batch in done:
            return False
        if folder is None:
            folder = f"data/{uuid.uuid4().hex}"
            guarded(df, secrets or []).write.parquet(f"{path}/{folder}")
        if commit(spark, path, batch, {f"batch {batch}": folder}, seen):
            return True


def sink(path: str, stream: str, secrets: list[str] | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch of the named stream is appended once, over restarts and repeats."""
    return lambda df, number: append(df, path, f"{stream}:{number}", secrets) and None


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def upsert(df: DataFrame, path: str, key: str, order: str, *, batch: str | None = None, buckets: int = 64) -> list[int]:
    """Rows by key: the greatest `order` wins within df, and df's over the table's, unless the table's is greater. Returns
    the buckets that were written; the other buckets keep their files. A table keeps its first number of buckets."""
    spark, batch = df.sparkSession, batch or uuid.uuid4().hex
    while True:
        seen, parts, done = state(entries(spark, path))
        if batch in done:
            return []
        buckets = int(parts.get("buckets", f"/{buckets}").rpartition("/")[2]) if parts else buckets
        hit = [r[0] for r in df.select(bucket_of(key, buckets)).distinct().collect()]  # at most `buckets` numbers
        old = sorted({f"{path}/{parts[str(b)]}" for b in hit if str(b) in parts})
        rows = df.withColumn("__new", F.lit(1))
        if old:
            rows = rows.unionByName(spark.read.schema(df.schema).parquet(*old).withColumn("__new", F.lit(0)))
        best = F.max_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(F.col(order), F.col("__new")))
        merged = rows.groupBy(F.col(key).alias("__key")).agg(best.alias("r")).select("r.*").withColumn("__bucket", bucket_of(key, buckets))
        folder = f"data/{uuid.uuid4().hex}"
        merged.repartition(len(hit) or 1, "__bucket").write.partitionBy("__bucket").parquet(f"{path}/{folder}")
        written = {str(b): f"{folder}/__bucket={b}" for b in hit}
        # The number of buckets is kept as a part without rows.
        if commit(spark, path, batch, {**written, "buckets": f"/{buckets}"}, seen):
            return sorted(hit)


def read_keyed(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """An upserted table as of its last commit."""
    _, parts, _ = state(entries(spark, path))
    folders = sorted(f"{path}/{f}" for p, f in parts.items() if p != "buckets")
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def vacuum(spark: SparkSession, path: str) -> int:
    """Removes folders that no part lies in, left by writers that died or by later upserts; for times without writers."""
    _, parts, _ = state(entries(spark, path))
    fs, at = _fs(spark, path)
    used, n = {"/".join(f.split("/")[:2]) for f in parts.values()}, 0
    if fs.exists(at(f"{path}/data")):
        for f in fs.listStatus(at(f"{path}/data")):
            if f"data/{f.getPath().getName()}" not in used:
                n += bool(fs.delete(f.getPath(), True))
    return n

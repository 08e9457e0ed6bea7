"""What the text operators share: reading, the shared folder, held-out splits, Arrow slices of bounded size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that a Python task works on at a time; one longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def others(columns: list[str], outputs: set[str] | list[str]) -> list[str]:
    """The columns that no output replaces; as Spark, without regard to case."""
    taken = {o.lower() for o in outputs}
    return [c for c in columns if c.lower() not in taken]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. One of our own only in local mode, where the cluster names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="plumbline-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/plumbline-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df written to the shared folder and read back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def draw(*columns: Column) -> Column:
    """A number from 0 to below 1 by a hash of the columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / float(1 << 30)


def labelled_sample(docs: DataFrame, labels: DataFrame, train: Column, *, label: str, doc_id: str, text: str, max_docs: int) -> DataFrame:
    """(y, text) of labelled rows that may teach, at most about max_docs, by a hash of id and text, of any length. Texts
    stay where they are: ids and hashes are joined to the labels, and the chosen ones, of a bounded number, broadcast."""
    whole = F.coalesce(col(text), F.lit(""))
    rows = docs.where(train & col(doc_id).isNotNull()).select(col(doc_id).alias("id"), F.xxhash64(whole).alias("h"), whole.alias("text"))
    known = labels.where(col(label).isNotNull()).select(col(doc_id).alias("id"), (col(label) > 0).cast("int").alias("y"))
    held = rows.select("id", "h").join(known, "id").distinct()
    n = held.count()
    chosen = (held.where(draw(F.col("id"), F.col("h")) < 0.95 * max_docs / n) if n > max_docs else held).limit(max_docs)
    return rows.join(F.broadcast(chosen), ["id", "h"]).dropDuplicates(["id", "h", "y"]).select("y", "text")


def crc_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as an empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have at most `most` bytes together, or one row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, and where each row starts (one entry more than rows). Null: empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, where, data = column.buffers()
    at = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1] if where else np.zeros(n + 1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def map_text(
    df: DataFrame,
    make: Callable[[], Callable[[np.ndarray, np.ndarray], dict[str, object]]],
    out: str,
    keep: list[str],
    text: str = "text",
) -> DataFrame:
    """Columns `keep` and those of the DDL string `out`, from a function of (bytes, row offsets) over bounded slices.

    make() runs once per task and returns the function, so that a model is loaded once. The function returns one
    value per row and output column. A kept column whose name is also an output is replaced by the output.
    """
    fields = T.StructType.fromDDL(out)
    keep = others(keep, [f.name for f in fields])
    source = df.select(*[col(c) for c in keep], col(text).alias("__text"))
    schema = T.StructType([*[source.schema[c] for c in keep], *fields])
    types = [T.StructType([f]) for f in fields]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(t[0].dataType) for t in types]
        work = None
        for batch in batches:
            if not batch.num_rows:
                continue
            work = work or make()
            data, at = text_bytes(batch.column(batch.num_columns - 1))
            for a, b in slices(at):
                got = work(data[at[a] : at[b]], at[a : b + 1] - at[a])
                columns = [batch.column(i).slice(a, b - a) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(got[n], k) for n, k in zip(names, kinds, strict=True)], names=[*keep, *names])

    return source.mapInArrow(run, schema)


def arrow_limits(spark: SparkSession, rows: int = 2000) -> None:
    """Smaller Arrow batches, so that long texts don't pile up in a Python task."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def runs(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words as maximal runs of bytes marked in `table`: starts, ends, words before each row (rows + 1), the marks."""
    marks = table[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64), marks
    first = marks.copy()
    first[1:] &= ~marks[:-1]
    edge = at[:-1][at[:-1] < at[1:]]
    first[edge] = marks[edge]
    last = marks.copy()
    last[:-1] &= ~marks[1:]
    last[at[1:][at[:-1] < at[1:]] - 1] |= marks[at[1:][at[:-1] < at[1:]] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at), marks


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each run of marked bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    length = ends - starts
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    place = np.arange(int(length.sum())) - np.repeat(first, length)
    values = (data[marks].astype(np.uint64) + np.uint64(1)) * powers(0x9E3779B97F4A7C15, int(length.max()))[place]
    return mix(np.add.reduceat(values, first) + length.astype(np.uint64))

"""Files around a dataset: digests and manifests, guarded appends, validations that fail, run catalogues, reports.

Files are listed by metadata and streamed in tasks; what is small (one row a file) is compared by joins, and errors name
the first offenders.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TASK_FILES = ("items.jsonl", "labels.jsonl", "schema.json", "README.md")


#: Bytes that a task holds of a file at a time.
PIECE = 8 << 20
#: Stores that tasks read by themselves, piece by piece; files of others come through Spark's binary source, 2 GB at most.
STREAMED = ("", "file", "hdfs", "s3", "s3a", "gs", "abfs", "abfss")


def binary_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, name, bytes, content) of the files below path; without content, a listing by metadata alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("bytes"), "content")


def digest_of(path: str) -> str:
    """SHA-256 in hex of a file of any size, read in pieces."""
    import hashlib

    h, (scheme, colon, rest) = hashlib.sha256(), path.partition(":")
    if not colon or scheme == "file":  # names are as they are, without escapes
        source = open("/" + rest.lstrip("/") if colon else path, "rb")
    else:
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
        source = store.open_input_stream(name)
    with source:
        while piece := source.read(PIECE):
            h.update(piece)
    return h.hexdigest()


def digests(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, name, bytes, digest) of the files below path: SHA-256 in hex. Files are listed by metadata and dealt to tasks
    in turns, the largest first; a task streams each of its files in pieces, so that files of any size have a digest."""
    files = binary_files(spark, path, glob)
    # Spark's index holds empty files, its scans leave them out.
    listed = [(re.sub("^file:/+", "file:/", unquote(p)),) for p in files.inputFiles()]
    empty = spark.createDataFrame(listed, "path string").join(files.select("path"), "path", "left_anti")
    empty = empty.select("path", F.substring_index("path", "/", -1).alias("name"), F.lit(0).cast("long").alias("bytes"), F.sha2(F.lit("").cast("binary"), 256).alias("digest"))
    first = files.select(F.regexp_extract("path", "^([a-z0-9]+):", 1).alias("s")).first()
    if first is not None and first["s"] not in STREAMED:
        return files.select("path", "name", "bytes", F.sha2("content", 256).alias("digest")).union(empty)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    turn = F.row_number().over(Window.orderBy(F.desc("bytes"), "path")) % tasks
    dealt = files.drop("content").withColumn("turn", turn).repartition(tasks, "turn").drop("turn")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(digest=[digest_of(p) for p in batch["path"]])

    return dealt.mapInPandas(read, "path string, name string, bytes long, digest string").union(empty)


def manifest_lines(files: DataFrame) -> DataFrame:
    """'digest  name' lines, in order."""
    return files.select(F.concat("digest", F.lit("  "), "name").alias("value")).orderBy("value")


def parsed_manifest(lines: DataFrame) -> DataFrame:
    return lines.where("value rlike '^[0-9a-f]{64}  '").select(F.substr("value", F.lit(67)).alias("name"), F.substring("value", 1, 64).alias("digest"))


def compared(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, status) by a full outer join: ok, MISMATCH, MISSING (in the manifest only) or EXTRA."""
    both = files.select("name", F.col("digest").alias("__file")).join(manifest.select("name", "digest"), "name", "full_outer")
    status = F.when(F.col("__file").isNull(), "MISSING").when(F.col("digest").isNull(), "EXTRA").when(F.col("digest") == F.col("__file"), "ok").otherwise("MISMATCH")
    return both.select("name", status.alias("status"))


def verify(spark: SparkSession, path: str, manifest: DataFrame) -> None:
    bad = compared(digests(spark, path), manifest).where("status in ('MISSING', 'MISMATCH')").orderBy("name").limit(10).collect()
    if bad:
        raise ValueError("; ".join(f"{r['status']} {r['name']}" for r in bad))


def task_layout(spark: SparkSession, path: str, required: tuple[str, ...] = TASK_FILES) -> DataFrame:
    """(name, present) of the files that a task has to have."""
    there = spark.read.format("binaryFile").load(path).select(F.substring_index("path", "/", -1).alias("name")).distinct().withColumn("present", F.lit(True))
    return spark.createDataFrame([(n,) for n in required], "name string").join(there, "name", "left").select("name", F.coalesce("present", F.lit(False)).alias("present"))


def append(df: DataFrame, path: str, secrets: list[str]) -> None:
    """df appended as JSON lines; an error, and nothing written, if a row holds one of the secrets, whatever the column's
    type and however JSON would write it. The guard is part of the write, so df is evaluated once."""
    from plumbline.sources.commits import HELD, guarded

    try:
        guarded(df, secrets).select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode("append").text(path)
    except PySparkException as error:
        if HELD in str(error):
            raise ValueError(HELD) from error
        raise


def faults(checks: dict[str, Column]) -> Column:
    """Names of the checks that don't hold (null counts as not)."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]), lambda x: x.isNotNull())


def vote_checks(counts: str, entropy: str, texts: list[str], majority: str, codes: dict[str, int], votes: int = 100) -> dict[str, Column]:
    """Checks of crowd-labelled rows: three counts that add up to `votes`, texts that aren't empty, the entropy of the counts
    within 1e-9, and a majority code that is the largest count's."""
    from plumbline.functions.expr import argmax, entropy_bits

    c = F.col(counts)
    share = F.transform(c, lambda x: x / F.lit(float(votes)))
    code = F.try_element_at(F.create_map(*[x for k, v in codes.items() for x in (F.lit(k), F.lit(v))]), F.col(majority))
    return {
        "three counts": F.size(c) == 3,
        "sum": F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x) == votes,
        "texts": F.forall(F.array(*[F.col(t) for t in texts]), lambda t: F.length(F.trim(t)) > 0),
        "entropy": F.abs(entropy_bits(share) - F.col(entropy)) <= 1e-9,
        "majority": F.element_at(c, code + 1) == F.array_max(c),
        "largest": code.isNotNull() & (argmax(c) >= 0),
    }


def validated(df: DataFrame, checks: dict[str, Column], key: str) -> DataFrame:
    """df; an error that names the first offenders where a check doesn't hold."""
    bad = df.withColumn("__faults", faults(checks)).where(F.size("__faults") > 0).select(key, "__faults").orderBy(key).limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r[key]}: {', '.join(r['__faults'])}" for r in bad))
    return df


def population(parts: dict[str, DataFrame], key: str, counts: dict[str, int] | None = None) -> DataFrame:
    """The union of named parts with their names (source); an error for a wrong count or a repeated key."""
    out = None
    for name, df in parts.items():
        df = df.withColumn("source", F.lit(name))
        out = df if out is None else out.unionByName(df)
    if counts:
        seen = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
        if seen != counts:
            raise ValueError(f"rows by source: {seen}, not {counts}")
    again = out.groupBy(key).count().where("count > 1").orderBy(key).limit(5).collect()
    if again:
        raise ValueError(f"repeated keys: {', '.join(str(r[key]) for r in again)}")
    return out


def pinned(spark: SparkSession, path: str, digest: str, rows: int) -> None:
    """An error unless the file at path has this digest and this many lines that aren't blank."""
    seen = digests(spark, path).select("digest").collect()
    n = spark.read.text(path).where("trim(value) <> ''").count()
    if [r["digest"] for r in seen] != [digest] or n != rows:
        raise ValueError(f"{path}: digest or number of rows ({n}) isn't as pinned")


def disputed(lines: DataFrame) -> DataFrame:
    """Ids of '- id: x' and '### x' lines, in any order."""
    found = F.coalesce(F.nullif(F.regexp_extract("value", r"^\s*-\s*id:\s*(\S+)", 1), F.lit("")), F.nullif(F.regexp_extract("value", r"^###\s+(\S+)", 1), F.lit("")))
    return lines.select(found.alias("id")).where("id is not null").distinct()


def runs(names: DataFrame) -> DataFrame:
    """Of run folders (name): those that count, neither demos nor aborted; latest: whether its name is the last of its kind."""
    from plumbline.operators.records import run_kind

    kept = names.where("name <> 'demo' and name not like '_aborted\\\\_%'").withColumn("kind", run_kind(F.col("name")))
    return kept.join(kept.groupBy("kind").agg(F.max("name").alias("__last")), "kind").select("name", "kind", (F.col("name") == F.col("__last")).alias("latest"))


def report(df: DataFrame) -> DataFrame:
    """Rows as JSON with keys in order, numbers rounded to twelve places, NaN as null."""
    plain = [F.when(~F.isnan(c), F.bround(c, 12)).alias(c) if df.schema[c].dataType.typeName() in ("double", "float") else F.col(c) for c in sorted(df.columns)]
    return df.select(F.to_json(F.struct(*plain), {"ignoreNullFields": "false"}).alias("value"))


def certificate(items: DataFrame, stamped: dict[str, float], schema: str) -> DataFrame:
    """One JSON line per item (item_id, stratum, human, probs, confidence, latency_ms, baseline) with the stamped results,
    which are copied, never made anew. A missing baseline is the first largest probability."""
    from plumbline.functions.expr import argmax

    result = F.struct(*[F.lit(stamped[k]).alias(k) for k in sorted(stamped)])
    row = F.struct("item_id", "stratum", "human", "probs", "confidence", "latency_ms", F.coalesce("baseline", argmax(F.col("probs"))).alias("baseline"))
    return items.select(F.to_json(F.struct(F.lit(schema).alias("schema"), result.alias("result"), row.alias("item"))).alias("value"))

import hashlib

import pytest

from plumbline.functions import expr as X
from plumbline.sources import files


def test_a_file_beyond_two_gigabytes_and_many_small_ones(spark, tmp_path):
    big = tmp_path / "big"
    with open(big, "wb") as f:  # sparse: the disk holds its end only
        f.truncate(2**31 + 5)
        f.seek(2**31 + 5)
        f.write(b"end")
    h = hashlib.sha256()
    zeros = bytes(1 << 20)
    for _ in range(2048):
        h.update(zeros)
    h.update(bytes(5) + b"end")
    (tmp_path / "small dir").mkdir()
    for i in range(10_000):
        (tmp_path / "small dir" / f"f%{i} é.txt").write_bytes(b"x" * (i % 7))
    rows = {r.name: r for r in files.digests(spark, str(tmp_path)).collect()}
    assert len(rows) == 10_001 and rows["big"].bytes == 2**31 + 8 and rows["big"].digest == h.hexdigest()
    assert all(rows[f"f%{i} é.txt"].digest == hashlib.sha256(b"x" * (i % 7)).hexdigest() for i in range(0, 10_000, 97))
    manifest = spark.createDataFrame(files.parsed_manifest(files.manifest_lines(files.digests(spark, str(tmp_path)))).collect())  # as it was
    files.verify(spark, str(tmp_path), manifest)
    (tmp_path / "small dir" / "f%3 é.txt").write_bytes(b"changed")
    with pytest.raises(ValueError, match="MISMATCH f%3 é.txt"):
        files.verify(spark, str(tmp_path), manifest)


def test_long_names_in_manifests(spark):
    name = "n" * 20_000
    row = files.parsed_manifest(spark.createDataFrame([(f"{'a' * 64}  {name}",)], "value string")).first()
    assert row.name == name and row.digest == "a" * 64


def test_permutations_are_undone_and_cover_all_letters(spark):
    from pyspark.sql import functions as F

    options = F.array(*[F.lit(f"o{i}") for i in range(5)])
    rows = spark.range(200).select("id", X.sentinels(options, 3, F.col("id")).alias("l"))
    back = rows.select("l", X.by_option(options, F.col("l"), F.map_from_arrays("l", F.array(*[F.lit(float(i)) for i in range(5)]))).alias("b")).collect()
    assert all(sorted(r.l) == list("ABCDE") and r.b == [0.0, 1.0, 2.0, 3.0, 4.0] for r in back) and len({tuple(r.l) for r in back}) > 50
    none = spark.range(1).select(X.softmax_logs(F.array(F.lit(None).cast("double"), F.lit(float("-inf")))).alias("p"), X.softmax_logs(F.array(F.lit(-1000.0), F.lit(float("nan")), F.lit(-1000.0))).alias("q")).first()
    assert none.p == [0.0, 0.0] and none.q == [0.5, 0.0, 0.5]

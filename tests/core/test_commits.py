import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from plumbline.sources import commits

SCHEMA = "unit_key string, n int"


def table(spark, path):
    return sorted(tuple(r) for r in commits.read(spark, path, SCHEMA).collect())


def test_a_repeated_batch_leaves_each_row_once(spark, tmp_path):
    path = str(tmp_path / "t")
    one, two = (spark.createDataFrame([(f"{b}{i}", i) for i in range(5)], SCHEMA) for b in "ab")
    assert table(spark, path) == []
    assert commits.append(one, path, "s:0") and not commits.append(one, path, "s:0")
    assert commits.append(two, path, "s:1") and not commits.append(two, path, "s:0")
    assert table(spark, path) == sorted(tuple(r) for r in one.union(two).collect())


def test_a_killed_batch_is_invisible_and_comes_back_whole(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "t"), spark.createDataFrame([("a", 1)], SCHEMA)
    real = commits.commit
    monkeypatch.setattr(commits, "commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        commits.append(rows, path, "s:0")
    assert table(spark, path) == []
    monkeypatch.setattr(commits, "commit", real)
    # A writer that died within its entry leaves a torn one: it counts as empty.
    (tmp_path / "t" / "_log").mkdir(exist_ok=True)
    (tmp_path / "t" / "_log" / "000000000001.json").write_text('{"batch": "s')
    assert commits.append(rows, path, "s:0")
    assert table(spark, path) == [("a", 1)]
    assert commits.vacuum(spark, path) == 1 and commits.vacuum(spark, path) == 0 and table(spark, path) == [("a", 1)]


def test_two_writers_take_turns(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    real, met = commits.commit, []

    def meeting(spark, path, batch, parts, seen):
        if not met:  # another writer is first, once
            met.append(commits.entries(spark, path))
            assert real(spark, path, "other", {"batch other": ""}, seen)
        return real(spark, path, batch, parts, seen)

    monkeypatch.setattr(commits, "commit", meeting)
    assert commits.append(spark.createDataFrame([("a", 1)], SCHEMA), path, "mine")
    assert [e["batch"] for e in commits.entries(spark, path)] == ["other", "mine"] and table(spark, path) == [("a", 1)]


@pytest.mark.parametrize("secret", ["plain", 'ab"cd', "back\\slash", "new\nline", "é/ü"])
def test_secrets_in_any_column(spark, tmp_path, secret):
    rows = spark.createDataFrame([(1, f"x{secret}y", ["a"], {"k": "v"}, ([("p", ["q"])],)), (2, None, None, None, None)], "id int, a string, b array<string>, c map<string,string>, d struct<e: array<struct<f: string, g: array<string>>>>")
    moved = [rows, rows.withColumn("b", F.array(F.lit("n"), "a")).drop("a"), rows.withColumn("c", F.create_map("a", F.lit("v"))).where("id = 1").drop("a"), rows.withColumn("c", F.create_map(F.lit("k"), "a")).drop("a"), rows.withColumn("d", F.struct(F.array(F.struct(F.lit("p").alias("f"), F.array("a").alias("g"))).alias("e"))).drop("a")]
    for i, df in enumerate(moved):
        path = str(tmp_path / str(i))
        with pytest.raises(PySparkException, match="secret"):
            commits.append(df, path, "s:0", [secret])
        assert commits.entries(spark, path) == []
        assert commits.append(df, path, "s:0", ["another", ""])


def test_a_stream_over_restarts(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "t")
    run = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source)).writeStream.foreachBatch(commits.sink(path, "raw", ["hush"])).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    source.mkdir()
    for i in range(3):
        (source / f"{i}.json").write_text(f'{{"unit_key": "k{i}", "n": {i}}}\n')
    run()
    # The last batch runs again, as after a failure between the sink's commit and Spark's.
    for f in (tmp_path / "check" / "commits").glob("*2*"):
        f.unlink()
    (source / "3.json").write_text('{"unit_key": "k3", "n": 3}\n')
    run()
    assert table(spark, path) == [(f"k{i}", i) for i in range(4)]


def test_upserts_rewrite_only_the_buckets_they_hit(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "id string, label string, at int"
    rows = {f"i{n}": ("x", 1) for n in range(200)}
    make = lambda d: spark.createDataFrame([(k, *v) for k, v in d.items()], schema)
    assert commits.upsert(make(rows), path, "id", "at", buckets=8) == list(range(8))
    before = commits.state(commits.entries(spark, path))[1]
    change = {"i5": ("y", 2), "new": ("z", 1), "i6": ("late", 0)}
    twice = make(change).union(make({"i5": ("w", 3)})).union(make({"i5": ("v", 2)}))
    hit = commits.upsert(twice, path, "id", "at", batch="b1", buckets=99)
    after = commits.state(commits.entries(spark, path))[1]
    assert 0 < len(hit) <= 3 and {b for b in before if before[b] != after[b]} == {str(b) for b in hit}
    rows |= {"i5": ("w", 3), "new": ("z", 1)}
    got = {r.id: (r.label, r.at) for r in commits.read_keyed(spark, path, schema).collect()}
    assert got == rows and commits.read_keyed(spark, path, schema).count() == 201
    assert commits.upsert(make({"i5": ("never", 9)}), path, "id", "at", batch="b1") == []
    assert commits.vacuum(spark, path) == 0 and commits.upsert(make({"i5": ("same", 3)}), path, "id", "at")
    assert commits.read_keyed(spark, path, schema).where("id = 'i5'").first().label == "same"

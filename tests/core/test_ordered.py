import datetime
import json
import random

from plumbline.operators import stability
from plumbline.streaming import ordered

SCHEMA = "client string, slot int, unit_key string, version string, cost double, ts timestamp"
START = datetime.datetime(2026, 1, 1, tzinfo=datetime.UTC)


def rows():
    rng = random.Random(3)
    out = []
    for i in range(300):
        at = START + datetime.timedelta(minutes=i // 3)  # ties in time
        out.append({"client": "hot" if i % 3 else rng.choice("ab"), "slot": i // 150, "unit_key": f"u{i:04d}", "version": rng.choice(["v1", "v1", "v1", "v2"]), "cost": (i % 5) / 4, "ts": at.isoformat()})
    return out


def written(folder, name, batch):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("".join(json.dumps(r) + "\n" for r in batch))


def run(spark, make, source, out, check):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
    q = make(stream).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(check)).trigger(availableNow=True).start()
    q.awaitTermination()


def through(spark, make, tmp_path):
    """The rows in shuffled batches with repeats, two runs over one checkpoint, then rows that move the watermark past all."""
    all_rows, rng = rows(), random.Random(5)
    source, out, check = tmp_path / "in", tmp_path / "out", tmp_path / "check"
    batches = [all_rows[i : i + 60] for i in range(0, 300, 60)]
    for i, batch in enumerate(batches):
        mixed = batch + batch[::7] + (batches[i - 1][-15::2] if i else [])  # repeats within a batch and of the last one
        rng.shuffle(mixed)
        written(source, f"{i}", mixed)
        if i in (2, 4):
            run(spark, make, source, out, check)
    for n, hours in ((8, 100), (9, 200)):
        written(source, f"{n}", [{"client": "end", "slot": 0, "unit_key": f"end{n}", "version": "v", "cost": 0.0, "ts": (START + datetime.timedelta(hours=hours)).isoformat()}])
    run(spark, make, source, out, check)
    return spark.read.parquet(str(out)).where("unit_key not like 'end%'"), spark.read.schema(SCHEMA).json([json.dumps(r) for r in all_rows] and spark.sparkContext.parallelize([json.dumps(r) for r in all_rows]))


def test_version_changes_as_in_batch(spark, tmp_path):
    got, plain = through(spark, lambda s: ordered.version_changes(s, late="30 minutes"), tmp_path)
    want = stability.version_changes(plain, "client", ["ts", "unit_key"], "version", "slot")
    columns = ["client", "slot", "unit_key", "ts", "previous", "version"]
    a, b = (sorted(tuple(r) for r in df.select(*columns).collect()) for df in (got, want))
    assert a == b and len(a) > 20


def test_spending_against_a_cap(spark, tmp_path):
    got, plain = through(spark, lambda s: ordered.capped(s, 20.0, run="client", late="30 minutes"), tmp_path)
    want, spent = [], {}
    for r in sorted(plain.collect(), key=lambda r: (r.ts, r.unit_key)):
        before = spent.get(r.client, 0.0)
        spent[r.client] = before + r.cost
        want.append((r.client, r.unit_key, spent[r.client], spent[r.client] > 20 + 1e-9, before <= 20 + 1e-9 < spent[r.client]))
    a = sorted(tuple(r) for r in got.select("client", "unit_key", "spent", "over", "first_over").collect())
    assert a == sorted(want) and sum(x[4] for x in a) == 3

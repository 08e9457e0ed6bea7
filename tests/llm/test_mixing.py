import re

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import mixing
from plumbline.llm.common import read


def brute_seats(votes, seats, caps):
    out = np.zeros(len(votes), int)
    for _ in range(min(seats, int(sum(c for v, c in zip(votes, caps) if v > 0)))):
        q = [v / (2 * s + 1) if s < c else -1 for v, s, c in zip(votes, out, caps)]
        out[int(np.argmax(q))] += 1
    return out


def test_apportionment_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(200):
        votes, caps = rng.integers(0, 50, 6), rng.integers(0, 9, 6)
        seats = int(rng.integers(0, 40))
        assert mixing.sainte_lague(votes, seats, caps).tolist() == brute_seats(votes, seats, caps).tolist()


def check(docs, **how):
    got = mixing.mix(docs, keep=["doc_id", "source"], **how).toPandas()
    rows = docs.select("doc_id", "text", "source").toPandas()
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t)) if isinstance(t, str) else 0 for d, t in zip(rows.doc_id, rows.text)}
    assert sorted(got.doc_id) == sorted(rows.doc_id)
    assert got["size"].tolist() == [size[d] for d in got.doc_id]
    assert (got.taken >= 0).all() and (got.taken <= 2 * got["size"]).all()
    for _, part in got.groupby("source", dropna=False):
        assert (part.source_size == part["size"].sum()).all()
        assert abs(part.taken.sum() - part.target.iloc[0]) <= max(0.02 * part.target.iloc[0], 8)
        assert part.target.iloc[0] <= 2 * part.source_size.iloc[0] + 1e-6
    total = got.groupby("source", dropna=False).target.first().sum()
    assert abs(total - min(1.5 * sum(size.values()), 2 * sum(size.values()))) <= 1e-6 * max(1, total)
    return got


def test_sources_meet_their_targets_and_reruns_agree(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    one, two = check(docs), check(docs.repartition(5))
    assert one.sort_values("doc_id").taken.tolist() == two.sort_values("doc_id").taken.tolist()


def test_odd_texts_null_sources_and_spans(spark, odd):
    check(odd.withColumn("source", F.when(F.col("doc_id") % 4 > 0, F.col("source"))))
    rows = mixing.mix(odd, spans=True).collect()
    assert all(sum((s["stop"] - s["start"]) * s["times"] for s in r["spans"]) == r["taken"] for r in rows)


def test_empty(make):
    assert mixing.mix(make([])).count() == 0

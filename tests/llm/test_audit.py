import re
from collections import defaultdict
from itertools import permutations

import duckdb
import pytest

from plumbline.llm import audit
from plumbline.llm import queries as Q

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(docs, labels):
    """Every order applied to every document, one filter after the other."""
    least = defaultdict(list)
    for d, t, _ in docs:
        if d is not None:
            least[t or ""].append(d)
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, x in labels if x == 1 and d is not None}
    out = defaultdict(lambda: [0] * 7)
    for part in {s or "" for _, _, s in docs}:
        for order in permutations("ABCDE"):
            for step in range(1, 6):
                out[part, "".join(order), step] = [0] * 7
    for d, t, s in docs:
        t, part = t or "", s or ""
        words = WORD.findall(t)
        fails = {n for n, f in zip("ABCDE", (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t)), d is not None and min(least[t]) < d), strict=True) if f}
        for order in permutations("ABCDE"):
            gone = False
            for i, f in enumerate(order):
                row = out[part, "".join(order), i + 1]
                removed = f in fails and not gone
                row[0] += f not in fails and not gone
                row[1] += removed
                row[2] += f in fails and gone
                row[3] += fails == {f}
                row[4] += removed and d in good
                row[5] += removed and d in toxic
                gone = gone or f in fails
    for part in {k[0] for k in out}:
        for f in "ABCDE":
            rows = [k for k in out if k[0] == part and k[1][k[2] - 1] == f]
            total = sum(out[k][1] for k in rows)
            for k in rows:
                out[k][6] = total
    return sorted((*k, *v) for k, v in out.items())


def found(df):
    return sorted(tuple(r) for r in df.select("part", "filter_order", "step", *audit.OUTCOMES).collect())


def test_orders_document_by_document(spark):
    long = " ".join(f"w{i}" for i in range(60))
    docs = [(1, long, "a"), (2, long, "a"), (2, long, "a"), (3, long, None), (None, long, ""), (None, None, "a"), (4, "", "b"), (5, None, "b"), (6, "LOUD " * 60, "b"), (7, "x | y", "a"), (8, "same word " * 40, "a"), (9, long + " #", "b"), (1, long, "b"), (10, long.upper(), "a"), (10, "\x1c\x85 é ü", "a")]
    labels = [(2, 1, 0), (2, 0, 1), (2, None, None), (6, 0, 1), (4, 1, 0), (None, 1, 1), (99, 1, 1)]
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, source string, n string, good long")
    x = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert found(audit.audit(d, x)) == brute(docs, labels)


def test_hot_text_and_hot_id(spark):
    docs = [(i % 7, "copy of a text", f"s{i % 3}") for i in range(400)] + [(3, f"text {i}", "s0") for i in range(300)] + [(None, f"other {i % 5}", None) for i in range(300)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(16)
    x = spark.createDataFrame([(3, 1, 0), (5, 0, 1)], "doc_id long, quality int, toxic int")
    assert found(audit.audit(d, x)) == brute(docs, [(3, 1, 0), (5, 0, 1)])


def test_many_parts_and_none(spark):
    docs = [(i, f"text {i // 2}", f"s{i % 150}") for i in range(300)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)
    x = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert found(audit.audit(d, x)) == brute(docs, [])
    assert audit.audit(d.limit(0), x).count() == 0


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf{sf}/{t}.parquet'")
    df = Q.op11_filter_audit(spark, f"/root/testdata/sf{sf}")
    cur = con.execute(Q.ORACLES["op11_filter_audit"])
    assert [c[0] for c in cur.description] == df.columns
    assert sorted(tuple(r) for r in df.collect()) == sorted(cur.fetchall())

import hashlib
import re

from plumbline.llm import decontaminate as D
from plumbline.llm.common import read

NAMES = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    lengths = {len(k) for k in windows}
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[key]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def check(docs, bench):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows, [(r.item_id, r.text) for r in bench.collect()])
    got = sorted(tuple(r) for r in D.decontaminate(docs, bench, keep=["doc_id"]).select(NAMES).collect())
    assert got == want
    return want


def test_against_brute_force(spark, sf):
    want = check(read(spark, sf, "documents"), read(spark, sf, "benchmark"))
    assert any(w[-1] for w in want)


def test_short_items_ties_and_odd_texts(spark, odd, make):
    bench = spark.createDataFrame([(1, "the cat"), (2, "The CAT!"), (3, ""), (None, "mat"), (10, "é ß 漢字"), (11, " ".join(f"w{i}" for i in range(30)))], "item_id long, text string")
    check(odd, bench)
    check(make(["x " + " ".join(f"w{i}" for i in range(5, 25)) + " y", "w1 w2 w3", "W1-w2 " * 30]), bench)


def test_blocks_agree_with_one_broadcast(spark, sf, odd):
    docs, bench = read(spark, sf, "documents").limit(60), read(spark, sf, "benchmark")
    short = spark.createDataFrame([(900, "the"), (None, "cat sat"), (901, " ".join(f"word{i}" for i in range(3000)))], "item_id long, text string")
    bench = bench.unionByName(short)
    docs = docs.unionByName(spark.createDataFrame([(5001, "x " + " ".join(f"word{i}" for i in range(100, 2000)), "en", "s", 1)], docs.schema))
    for d in (docs, odd):
        a, b = (D.decontaminate(d, bench, keep=["doc_id"], max_words=n) for n in (D.MAX_WORDS, 1500))
        assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_spans_are_removed_and_empty_tables(spark, make):
    bench = spark.createDataFrame([(7, "red green blue"), (8, "blaü")], "item_id long, text string")
    out = D.decontaminate(make(["so Red, green; blue! end blaü", "x", None, "é red green blue ü"]), bench).orderBy("doc_id")
    row = out.first()
    assert [tuple(s) for s in row.hit_spans] == [(3, 19), (25, 30)] and row["items"] == ["7", "8"]
    assert [r["text"] for r in D.remove_spans(out).collect()] == ["so ! end ", "x", None, "é  ü"]
    assert D.decontaminate(make([]), bench).count() == 0
    assert D.decontaminate(make(["a b"]), bench.limit(0)).first().n_hit == 0


def test_clashing_names(spark):
    bench = spark.createDataFrame([(7, "red green blue")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "red green blue", 3, "w")], "doc_id long, text string, N_Hit int, w string")
    for n in (D.MAX_WORDS, 1):
        row = D.decontaminate(docs, bench.union(bench), max_words=n).collect()[0]
        assert row["n_hit"] == 3 and row["w"] == "w"

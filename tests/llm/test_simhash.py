import re

import numpy as np
import pandas as pd
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import simhash
from plumbline.llm.common import read


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((2 * sum(h >> b & 1 for h in hs) > len(hs)) << b for b in range(64))


def brute_components(ids, fps, radius=2):
    fps = np.array(fps, np.uint64)
    label = list(range(len(ids)))

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= radius):
            label[find(i)] = find(int(j))
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        least[r] = min(least.get(r, d), d)
    return [least[find(i)] for i in range(len(ids))]


def check(docs):
    got = simhash.near_duplicates(docs).toPandas().sort_values("doc_id").reset_index(drop=True)
    rows = docs.toPandas().sort_values("doc_id").reset_index(drop=True)
    fps = [brute_fp(t if isinstance(t, str) else None) for t in rows.text]
    assert got.fingerprint.tolist() == [f"{x:016x}" for x in fps]
    assert got.component_id.tolist() == brute_components(rows.doc_id.tolist(), fps)


def test_against_brute_force(spark, sf):
    check(read(spark, sf, "documents"))


def test_odd_texts(odd):
    check(odd)


def test_empty_table_and_extra_columns(spark, make):
    assert simhash.near_duplicates(make([])).count() == 0
    docs = spark.createDataFrame([(1, "a b c d", "x"), (2, "a b c d", "y")], "doc_id long, text string, fingerprint string")
    got = simhash.near_duplicates(docs, keep=["doc_id", "fingerprint"])
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert {r.component_id for r in got.collect()} == {1}


def test_links_across_tiles(spark):
    """Chains of one and two bits over many cells, with tiles of a few fingerprints."""
    rng = np.random.default_rng(5)
    fps = list(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    for _ in range(600):
        x = fps[rng.integers(len(fps))]
        for b in rng.choice(64, rng.integers(1, 4), replace=False):
            x ^= np.uint64(1) << np.uint64(b)
        fps.append(x)
    fps = np.unique(np.array(fps))
    prints = spark.createDataFrame(pd.DataFrame({"fp": fps.view(np.int64)}))
    from plumbline.llm.components import components

    roots = {r.node: r.root for r in components(simhash.near(prints, 2, 4)).collect()}
    signed = fps.view(np.int64).tolist()
    want = brute_components(signed, fps)
    assert [roots.get(x, x) for x in signed] == want


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**64 - 1), max_size=600), max_size=6))
def test_majority(groups):
    got = simhash.majority(np.array([h for g in groups for h in g], np.uint64), np.array([len(g) for g in groups], np.int64))
    assert got.tolist() == [sum((2 * sum(h >> b & 1 for h in g) > len(g)) << b for b in range(64)) for g in groups]

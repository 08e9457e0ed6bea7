import math
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from plumbline.llm import katz
from plumbline.llm.common import crc_bucket, read

K = katz.K


def tokens_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["</s>"]


class Brute:
    def __init__(self, docs):
        self.c1, self.c2, self.after = Counter(), Counter(), defaultdict(set)
        for text in docs:
            t = tokens_of(text)
            self.c1.update(t)
            for h, w in zip(["<s>", *t], t):
                self.c2[h, w] += 1
                self.after[h].add(w)
        self.n, self.v = sum(self.c1.values()), len(self.c1)
        self.d1, self.d2 = self.discounts(self.c1), self.discounts(self.c2)
        left = self.n - sum(self.d1.get(c, 1) * c for c in self.c1.values())
        self.whole, self.left = (self.n, left) if left > 1e-12 else (self.n + 1, 1)

    @staticmethod
    def discounts(counts):
        n = Counter(counts.values())
        out, rest = {}, (K + 1) * n[K + 1] / n[1] if n[1] else 1
        for r in range(1, K + 1):
            if n[r] and rest < 1:
                d = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest)
                out[r] = d if 0 < d < 1 else 1
        return out

    def p1(self, w):
        c = self.c1[w]
        return self.d1.get(c, 1) * c / self.whole if c else self.left / self.whole

    def p2(self, h, w):
        seen = self.after.get(h)
        if not seen:
            return self.p1(w)
        n = sum(self.c2[h, x] for x in seen)
        left = n - sum(self.d2.get(self.c2[h, x], 1) * self.c2[h, x] for x in seen)
        whole, left = (n, left) if left > 1e-12 else (n + 1, 1)
        c = self.c2[h, w]
        return self.d2.get(c, 1) * c / whole if c else left / whole * self.p1(w) / (1 - sum(self.p1(x) for x in seen))


def check(docs, sample=60, **how):
    held = crc_bucket(F.col("doc_id"), 7) == 2
    got = {r["doc_id"]: r for r in katz.score(docs, ~held, keep=["doc_id"], **how).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    model = Brute([r["text"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2])
    for r in sorted(rows, key=lambda r: len(r["text"] or ""))[:sample]:
        t, out = tokens_of(r["text"]), got[r["doc_id"]]
        assert (out["n_tokens"], out["n_known"], out["train_tokens"]) == (len(t), sum(model.c1[w] > 0 for w in t), model.n)
        assert math.isclose(out["base_score"], sum(math.log10((model.c1[w] + 1) / (model.n + model.v + 1)) for w in t), rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(out["score"], sum(math.log10(model.p2(h, w)) for h, w in zip(["<s>", *t], t)), rel_tol=1e-8, abs_tol=1e-8)
    return model, got


def test_against_brute_force_and_better_than_words_alone(spark, sf):
    docs = read(spark, sf, "documents")
    model, got = check(docs, block_bytes=200_000, buckets=7)
    held = [r for d, r in got.items() if zlib.crc32(str(d).encode()) % 7 == 2]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    for h in ["<s>", "the", "of", "never-seen"]:
        assert math.isclose(sum(model.p2(h, w) for w in model.c1) + model.p2(h, "a new word"), 1, rel_tol=1e-9)


def test_results_do_not_depend_on_blocks(spark, sf):
    docs = read(spark, sf, "documents").limit(80)
    one = sorted(map(tuple, katz.score(docs.coalesce(1), F.lit(True), keep=["doc_id"]).collect()))
    many = sorted(map(tuple, katz.score(docs.repartition(5), F.lit(True), keep=["doc_id"], block_bytes=5000, buckets=3).collect()))
    assert all(a[:4] == b[:4] and math.isclose(a[5], b[5], rel_tol=1e-9) for a, b in zip(one, many, strict=True))


def test_odd_texts(odd):
    check(odd, buckets=5)


def test_empty_tables_no_training_and_extra_columns(spark, make):
    assert katz.score(make([]), F.lit(True), buckets=3).count() == 0
    docs = spark.createDataFrame([(1, "a b", "x"), (None, None, "y")], "doc_id long, text string, score string")
    out = katz.score(docs, F.lit(False), buckets=3).collect()
    assert {(r["doc_id"], r["text"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in out} == {(1, "a b", 3, 0, 0, 0.0, 0.0), (None, None, 1, 0, 0, 0.0, 0.0)}

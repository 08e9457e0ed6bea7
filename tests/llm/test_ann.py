import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import ann
from plumbline.llm.common import read


def test_recall_and_exact_scores(spark):
    vectors = read(spark, "/root/testdata/sf0.1", "embeddings")
    got = ann.search(vectors, F.col("vec_id") % 20 == 0).toPandas()
    rows = vectors.select("vec_id", "embedding").toPandas()
    x, ids, hits, n = np.stack(rows.embedding).astype(float), rows.vec_id.to_numpy(), 0, 0
    for q, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        at = int(np.flatnonzero(ids == q)[0])
        score = x @ x[at]
        score[at] = -np.inf
        best = np.lexsort((ids, -score))[:20]
        assert part["rank"].tolist() == list(range(1, len(part) + 1)) and q not in set(part.vec_id)
        assert np.allclose(part.score, [score[np.flatnonzero(ids == v)[0]] for v in part.vec_id], rtol=1e-12)
        hits, n = hits + len(set(part.vec_id) & set(ids[best])), n + 20
    assert got.query_id.nunique() == (ids % 20 == 0).sum() and hits / n >= 0.9


def recall(spark, x, k=20):
    ids = np.arange(len(x))
    vectors = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    got, hits, n = ann.search(vectors, F.col("vec_id") % 20 == 0, k=k).toPandas(), 0, 0
    x = x.astype(np.float32).astype(float)
    for q, part in got.groupby("query_id"):
        score = x @ x[q]
        score[q] = -np.inf
        least = np.sort(score)[-k]
        hits, n = hits + int((part.score >= least - 1e-9).sum()), n + k
    assert len(got) == n  # k of each query, however many lists it probes
    return hits / n


def test_recall_with_long_vectors_and_copies(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 24))
    x[7] *= 1000
    x[100:130] *= 20
    assert recall(spark, x) >= 0.9
    x[1000:2000] = x[1000]  # a third of all rows are copies
    assert recall(spark, x) >= 0.9


def test_odd_vectors_and_few_candidates(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (20, [0.5, 0.5]), (40, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, ann.search(vectors, F.col("vec_id") % 20 == 0).collect()))
    assert got == [(0, 1, 1, 1.0), (0, 2, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 1, 0.5)]


def test_empty(spark):
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0

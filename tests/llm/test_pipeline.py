import corpus_pipeline as P

from plumbline.llm import decontaminate, toxicity
from plumbline.llm.common import read
from pyspark.sql import functions as F
from test_nearcopies import brute

SF = "/root/testdata/sf0.001"


def test_every_stage_decides_on_what_it_gets(spark):
    docs = read(spark, SF, "documents")
    score = {r["doc_id"]: r["score"] for r in toxicity.classify(docs, read(spark, SF, "labels"), F.lit(True), keep=["doc_id"]).collect()}
    kept = P.toxic(spark, docs, SF)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d for d, s in score.items() if s < 0.5}
    alone = P.near_copies(spark, docs, SF)
    assert {r["doc_id"] for r in alone.collect()} == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    clean = P.decontamination(spark, docs, SF)
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in decontaminate.decontaminate(docs, read(spark, SF, "benchmark")).where("not contaminated").collect()}
    assert alone.columns == clean.columns == P.surrogates(spark, docs, SF).columns == docs.columns


def test_whole_pipeline_and_empty_tables(spark, make):
    out = P.run(spark, SF)
    assert 0 < out.count() <= 200 and "taken" in out.columns
    for _, stage in P.STAGES:
        assert stage(spark, make([]), SF).count() == 0


def test_odd_rows_pass_all_stages(spark):
    """Null ids, nulls in any column, repeated rows, very long texts and clashing names, through every stage in turn."""
    rows = [(None, None, None, None, 0, 1.0), (1, "", "en", "s", 0, 2.0), (1, "", "en", "s", 0, 2.0), (2, "one two three", None, None, None, None)]
    rows += [(i, "lorem ipsum dolor sit amet " * 40_000, "la", "t", 5, 0.5) for i in (3, 4)] + [(None, "mail a@b.com now", "en", "s", 1, 0.1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, Score double")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = out.checkpoint() if spark.sparkContext.getCheckpointDir() else out
        assert docs.count() == (8 if name == "toxicity" else 4), name
    last = P.STAGES[-1][1](spark, docs, SF).collect()
    assert len(last) == 4 and all(r["taken"] <= 2 * r["size"] for r in last) and not any("a@b.com" in (r["text"] or "") for r in last)

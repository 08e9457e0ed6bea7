"""A corpus pipeline: documents through five stages, each an operator of plumbline.llm, to a mix of sources.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and is written to the shared
folder before the next one reads it. All but the last return the columns of documents; extra columns stay, whatever
their names. An empty table passes through as empty. Repeated rows are judged alike in every stage, and one of them stays
in the second; null ids, null texts and texts of any length are rows like any other.

1. toxicity: documents with a score of 0.5 or more go.
2. near_duplicates: of texts that links of similarity 0.8 or more (five-word shingles) connect, the smallest id stays
   (null last; of equal ids, the row of the least hash of all columns; of rows equal in all columns, one).
3. decontamination: documents of which benchmark passages cover 5 % or more go.
4. pii: entities give way to surrogates; n_chars follows where it is there. Null texts stay null.
5. mixing: how many words the mix takes of each document; documents of which it takes none stay, with 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, mixing, nearcopies, pii, toxicity
from plumbline.llm.common import read, stored


def apart(docs: DataFrame, work: Callable[[DataFrame, dict[str, str]], DataFrame]) -> DataFrame:
    """work(docs, names) under names no operator uses, then under their own again."""
    own = {c: f"column_{i}" for i, c in enumerate(docs.columns)}
    out = work(docs.toDF(*own.values()), own)
    return out.select(*[F.col(new).alias(c) for c, new in own.items()])


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels")

    def work(d: DataFrame, names: dict[str, str]) -> DataFrame:
        return toxicity.classify(d, labels, F.lit(True), doc_id=names["doc_id"], text=names["text"], out="toxicity_score").where("toxicity_score < 0.5")

    return apart(docs, work)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """By op7's tiled comparison of simhash fingerprints, at five words, with an exact check."""
    return nearcopies.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = read(spark, sf_dir, "benchmark")
    return apart(docs, lambda d, names: decontaminate.decontaminate(d, benchmark, text=names["text"]).where("not contaminated"))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = apart(docs, lambda d, names: pii.replace(d, text=names["text"]))
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0).cast("long"))) if "n_chars" in docs.columns else out


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, keep=docs.columns)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic),
    ("near_duplicates", near_copies),
    ("decontamination", decontamination),
    ("pii", surrogates),
    ("mixing", mixed),
]

#: SQL can express neither the classifier nor the keyed draws; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

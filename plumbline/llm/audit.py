"""Filter interaction audit: what each filter removes in every order of a filter chain, by products of incidence matrices.

Five filters judge each text; the set that a document fails is a mask of 0 to 31. Documents are counted by part and
mask, once in all, once those of good quality and once the toxic ones: three rows of 32 counts for each part. What a
filter does at a step of an order depends on the mask alone, so each outcome is a fixed 32 x 600 matrix of integers
(120 orders of 5 steps), and a part's answers are its rows times these matrices, in 64-bit integers.

Failures: A, under 50 words; B, 100 * distinct words < 65 * words; C, 100 * letters A-Z > 5 * code points; D, holds any
of # $ % & * |; E, equal to the text of a row of a smaller id. Words are maximal runs without [\\x20\\x09-\\x0D].

Texts are read once and never shuffled: what travels is a SHA-256 digest, the id and the mask, added up where rows
lie. Equal texts share the mask of A to D, so E is settled on counts: per digest, part and labels the number of rows
and of those that hold the least id; a text that a third of all rows share is a row per part by then.

Defined results: a null text is an empty one; a null source is the part ""; a null id is nobody's smaller id, fails no
E and has no label; rows that share an id and a text don't fail E by one another; a document is good (toxic) where any
label row of its id says 1, and counts once however many label rows it has; extra columns are ignored; an empty table
has no parts and so no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import col

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MASKS = 1 << len(FILTERS)
#: Parts whose answers a task makes at a time: 600 rows each.
PARTS = 64
OUTCOMES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{o} long" for o in OUTCOMES)


def incidence() -> dict[str, np.ndarray]:
    """Per outcome the 32 x 600 matrix: what a document of the mask adds to it at (order, step)."""
    shape = (MASKS, len(ORDERS) * len(FILTERS))
    kept, removed, redundant, unique, shapley = (np.zeros(shape, np.int64) for _ in range(5))
    masks = np.arange(MASKS)
    for o, order in enumerate(ORDERS):
        before = np.zeros(MASKS, bool)
        for s, name in enumerate(order):
            fails, at = masks >> FILTERS.index(name) & 1 == 1, o * len(FILTERS) + s
            removed[:, at] = fails & ~before
            redundant[:, at] = fails & before
            unique[:, at] = masks == 1 << FILTERS.index(name)
            before |= fails
            kept[:, at] = ~before
    letter = np.array([FILTERS.index(name) for order in ORDERS for name in order])
    for f in range(len(FILTERS)):  # a filter's removals over all orders, at whatever step they fall
        shapley[:, letter == f] = removed[:, letter == f].sum(1, keepdims=True)
    return {"kept": kept, "removed": removed, "redundant": redundant, "unique_fails": unique, "shapley": shapley}


def failures(text: Column) -> Column:
    """The mask of A to D. Words: the pieces between separators that aren't empty."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, different = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    signs = F.translate(text, "#$%&*|", "") != text
    tests = [n < 50, 100 * different.cast("long") < 65 * n.cast("long"), 100 * capitals.cast("long") > 5 * F.length(text).cast("long"), signs]
    return sum((t.cast("int") * (1 << i) for i, t in enumerate(tests)), F.lit(0))


def histograms(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and the filters that they fail."""
    whole = F.coalesce(col(text), F.lit(""))
    rows = docs.select(col(doc_id).alias("id"), F.coalesce(col(source), F.lit("")).alias("part"), whole.alias("text"))
    rows = rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), failures(F.col("text")).alias("mask"))
    rows = rows.groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    known = labels.where(col(doc_id).isNotNull()).groupBy(col(doc_id).alias("id"))
    known = known.agg(F.max((col(quality) == 1).cast("long")).alias("good"), F.max((col(toxic) == 1).cast("long")).alias("toxic"))
    # Null ids have no label: a salt spreads them over the join's tasks, where they meet nothing.
    salt = F.when(F.col("id").isNull(), 1 + F.pmod(F.xxhash64("digest"), F.lit(1000))).otherwise(0)
    joined = rows.withColumn("salt", salt).join(known.withColumn("salt", F.lit(0).cast("long")), ["id", "salt"], "left")
    joined = joined.select("id", "part", "digest", "mask", "n", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])
    # Ids within a group are distinct, as repeated rows were added up before.
    groups = joined.groupBy("digest", "part", "mask", "good", "toxic", F.col("id").isNull().alias("unnamed")).agg(F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("first"))
    least = F.min("first.id").over(Window.partitionBy("digest"))
    unique = F.when(F.col("unnamed"), F.col("n")).when(F.col("first.id") == least, F.col("first.n")).otherwise(0)
    groups = groups.withColumn("unique", unique)
    split = F.explode(F.array(F.struct("mask", F.col("unique").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("unique")).alias("n"))))
    judged = groups.select("part", "good", "toxic", split.alias("s")).select("part", "s.mask", "s.n", "good", "toxic").where("n > 0")
    sums = [F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")]
    return judged.groupBy("part", "mask").agg(*sums)


def audit(docs: DataFrame, labels: DataFrame, **names: str) -> DataFrame:
    """One row per part, order of the filters and step: see the module for its columns."""
    h = histograms(docs, labels, **names)
    at = lambda c, m: F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(0))
    stacked = h.groupBy("part").agg(*[F.array(*[at(c, m) for m in range(MASKS)]).alias(c) for c in ("n", "good", "toxic")])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrices = incidence()
        order = pa.array([o for o in ORDERS for _ in FILTERS])
        step = pa.array(list(range(1, len(FILTERS) + 1)) * len(ORDERS), pa.int32())
        for batch in batches:
            for start in range(0, batch.num_rows, PARTS):
                some = batch.slice(start, PARTS)
                n, good, toxic = (some.column(i).flatten().to_numpy().reshape(-1, MASKS) for i in (1, 2, 3))
                found = {name: n @ m for name, m in matrices.items()} | {"good_lost": good @ matrices["removed"], "toxic_lost": toxic @ matrices["removed"]}
                every = np.tile(np.arange(len(order)), some.num_rows)
                part = some.column(0).take(pa.array(np.repeat(np.arange(some.num_rows), len(order))))
                yield pa.RecordBatch.from_arrays([part, order.take(pa.array(every)), step.take(pa.array(every)), *[pa.array(found[o].ravel()) for o in OUTCOMES]], names=["part", "filter_order", "step", *OUTCOMES])

    return stacked.mapInArrow(multiply, SCHEMA)


#: The same counts in SQL: each document's failures, then each order's steps document by document.
ORACLE_SQL = r"""WITH d AS (SELECT o.doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents o),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
u AS (SELECT t, min(doc_id) AS least FROM d GROUP BY 1),
m AS (SELECT part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, coalesce(d.doc_id > least, false) AS e, coalesce(good, 0) AS good, coalesce(l.toxic, 0) AS toxic FROM d JOIN u USING (t) LEFT JOIN l ON d.doc_id = l.doc_id),
g AS (SELECT part, a, b, c, d, e, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT v.x || w.x || x.x || y.x || z.x AS filter_order FROM f v, f w, f x, f y, f z WHERE len(list_distinct([v.x, w.x, x.x, y.x, z.x])) = 5),
s AS (SELECT filter_order, s::INT AS step, substr(filter_order, s::INT, 1) AS letter, substr(filter_order, 1, s::INT - 1) AS earlier FROM o, (SELECT unnest(range(1, 6)) AS s)),
j AS (SELECT g.*, s.*, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails FROM g, s),
k AS (SELECT *, contains(fails, letter) AS hit, len(list_intersect(string_split(fails, ''), string_split(earlier, ''))) > 0 AND fails <> '' AND earlier <> '' AS gone FROM j),
r AS (SELECT part, filter_order, step, letter, sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = letter THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM k GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r"""

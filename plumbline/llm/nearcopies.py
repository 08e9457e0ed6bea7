"""Near copies by wide simhash fingerprints: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or
more, directly or by links.

The 64 bits of `simhash` tell near copies of 0.8 badly apart from others, so here each text's distinct shingles give
LANES fingerprints of 64 bits. Texts are dealt into tiles by their number of shingles, as sets of 0.8 differ by a quarter
at most; tile pairs within that range are compared in full with numpy, exclusive-or and bit counts, the first lane
letting few pairs on to the others. A pair is a candidate within the distance that sets of 0.8 exceed with a chance of
about 1 in 30,000. Of each tile pair come the candidates of a least spanning forest, so output is linear.

Candidates are checked by the exact similarity: each text's closest one, then what still joins different classes.
Where a group of candidates stays in several classes, a rejected link may hide others: all texts of such a group are
compared exactly, by tiles of their shingle sets, which again return a forest. So no link is lost but beyond that distance.

Defined results: words are lowered in A-Z and split as in simhash; texts with at most five words are one shingle;
null, empty and blank texts are copies of each other; an empty table gives an empty result; of rows with equal ids the
one of the least hash of all columns stays, so reruns agree, and of rows equal in all columns one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import arrow_limits, col, map_text, mix, stored
from plumbline.llm.components import components
from plumbline.llm.simhash import SEED, forest, majority

WORDS, LANES, TILE, SET_TILE = 5, 4, 2048, 256
BAND = np.log(1.05)  # tiles hold texts whose numbers of shingles differ by 5 % at most
BANDS = 5  # 1.25 is fewer than five bands up
#: Chance that a bit differs at 0.8: arccos(8 / 9) / pi, and of sets of few shingles up to 6 / 32.
DIFFER = 0.1516, 0.1875
FEW = 20


def radius(n: np.ndarray, bits: int) -> np.ndarray:
    p = np.where(n < FEW, DIFFER[1], DIFFER[0])
    return bits * p + 4 * np.sqrt(bits * p * (1 - p))


def shingles(raw: bytes, words: int) -> np.ndarray:
    """Distinct XXH64 hashes of a text's shingles, in order."""
    import xxhash

    found = raw.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    most = max(1, len(found) - words + 1)
    spans = zip(starts[:most].tolist(), ends[min(words, len(found)) - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[x:y], SEED) for x, y in spans), np.uint64))


def sketcher(words: int):
    def work(data: np.ndarray, at: np.ndarray) -> dict[str, object]:
        raw = data.tobytes()
        sets = [shingles(raw[a:b], words) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        n, whole = np.array([len(s) for s in sets], np.int64), np.concatenate(sets)
        lanes = [majority(mix(whole + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15)), n).view(np.int64) for k in range(LANES)]
        return {"n": n, "lanes": pa.FixedSizeListArray.from_arrays(pa.array(np.stack(lanes, 1).ravel()), LANES).to_pylist()}

    return work


def listed(words: int):
    def work(data: np.ndarray, at: np.ndarray) -> dict[str, object]:
        raw = data.tobytes()
        return {"shingles": [shingles(raw[a:b], words).view(np.int64) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]}

    return work


def least_forest(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Places of the links of a least spanning forest by d (ties: the first): each component takes its least link, and again."""
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = where[: len(a)], where[len(a) :]
    order = np.argsort(d, kind="stable")
    rank = np.empty(len(d), np.int64)
    rank[order] = np.arange(len(d))
    label, taken = np.arange(len(nodes)), []
    while True:
        apart = np.flatnonzero(label[x] != label[y])
        if not len(apart):
            return np.unique(np.concatenate([np.zeros(0, np.int64), *taken]))
        best = np.full(len(nodes), len(d))
        np.minimum.at(best, label[x[apart]], rank[apart])
        np.minimum.at(best, label[y[apart]], rank[apart])
        chosen = order[np.unique(best[best < len(d)])]
        taken.append(chosen)
        tree = dict(forest(label[x[chosen]], label[y[chosen]]))
        root = np.arange(len(nodes))
        root[list(tree)] = list(tree.values())
        label = root[label]


def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of tile pairs (left, right: node, n, lanes): (a, b, d) of a least forest of the candidates."""
    for batch in batches:
        for i in range(batch.num_rows):
            left, right = (batch.column(k)[i].values for k in (0, 1))
            nodes, sizes = ([np.asarray(s.field(f), np.int64) for s in (left, right)] for f in ("node", "n"))
            lanes = [np.asarray(s.field("lanes").flatten(), np.int64).view(np.uint64).reshape(-1, LANES) for s in (left, right)]
            most = [radius(s, 64 * LANES) for s in sizes]
            p = DIFFER[int(min(s.min() for s in sizes) < FEW)]
            first = 64 * p + 4.5 * np.sqrt(64 * p * (1 - p))
            found = []
            step = max(1, (1 << 20) // len(nodes[1]))
            for at in range(0, len(nodes[0]), step):
                x, y = np.nonzero(np.bitwise_count(lanes[0][at : at + step, None, 0] ^ lanes[1][None, :, 0]) <= first)
                x += at
                d = np.bitwise_count(lanes[0][x] ^ lanes[1][y]).sum(1, dtype=np.int64)
                small, large = np.minimum(sizes[0][x], sizes[1][y]), np.maximum(sizes[0][x], sizes[1][y])
                near = (d <= np.maximum(most[0][x], most[1][y])) & (5 * small >= 4 * large) & (nodes[0][x] != nodes[1][y])
                found.append((nodes[0][x[near]], nodes[1][y[near]], d[near]))
            a, b, d = (np.concatenate(x) for x in zip(*found, strict=True))
            if len(a):
                kept = least_forest(a, b, d)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[kept]), pa.array(np.maximum(a, b)[kept]), pa.array(d[kept])], names=["a", "b", "d"])


def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of tile pairs (left, right: node, shingles): (a, b) of a forest of the links at 0.8 or more."""
    for batch in batches:
        for i in range(batch.num_rows):
            left, right = (batch.column(k)[i].values for k in (0, 1))
            nodes = [np.asarray(s.field("node"), np.int64) for s in (left, right)]
            counts = [np.diff(np.asarray(s.field("shingles").offsets)) for s in (left, right)]
            flat = [np.asarray(s.field("shingles").flatten(), np.int64) for s in (left, right)]
            known, where = np.unique(np.concatenate(flat), return_inverse=True)
            rows = [np.repeat(np.arange(len(c)), c) for c in counts]
            both = np.zeros((len(nodes[0]), len(nodes[1])), np.float32)
            parts = where[: len(flat[0])], where[len(flat[0]) :]
            for at in range(0, len(known), 4096):  # shared shingles by products of 0/1 matrices of bounded width
                m = [np.zeros((len(n), 4096), np.float32) for n in nodes]
                for k in (0, 1):
                    here = (parts[k] >= at) & (parts[k] < at + 4096)
                    m[k][rows[k][here], parts[k][here] - at] = 1
                both += m[0] @ m[1].T
            x, y = np.nonzero((9 * both >= 4 * (counts[0][:, None] + counts[1][None, :])) & (nodes[0][:, None] != nodes[1][None, :]))
            if len(x):
                tree = forest(nodes[0][x], nodes[1][y])
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in tree], pa.int64()) for k in (0, 1)], names=["a", "b"])


def tile_pairs(packed: DataFrame, steps: int, tasks: int) -> DataFrame:
    """(left, right) of packed (cell, tile, rows): all tile pairs of a cell and of the `steps` cells above it. Pairs are
    made of numbers only, spread over tasks, and then fetch their rows."""
    ids = packed.select("cell", "tile")
    left = ids.select(F.col("cell").alias("c"), F.col("tile").alias("t"), F.explode(F.expr(f"sequence(cell, cell + {steps})")).alias("cell"))
    pairs = left.join(ids, "cell").where((F.col("c") != F.col("cell")) | (F.col("t") <= F.col("tile"))).repartition(tasks, "c", "t")
    pairs = pairs.join(packed.selectExpr("cell as c", "tile as t", "rows as left"), ["c", "t"]).repartition(tasks, "c", "t", "cell", "tile")
    return pairs.join(packed.selectExpr("cell", "tile", "rows as right"), ["cell", "tile"]).select("left", "right")


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with ok: whether they are at 0.8 or more."""
    both = pairs.join(sets.selectExpr("node as a", "shingles as x"), "a").join(sets.selectExpr("node as b", "shingles as y"), "b")
    # i / (m + n - i) >= 4 / 5
    return both.select("a", "b", (9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).alias("ok"))


def labelled(links: DataFrame, labels: DataFrame) -> DataFrame:
    """links between different labels (node, root), with these as p and q; a node without a label is its own."""
    out = links.join(labels.selectExpr("node as a", "root as p"), "a", "left").join(labels.selectExpr("node as b", "root as q"), "b", "left")
    return out.withColumns({"p": F.coalesce("p", "a"), "q": F.coalesce("q", "b")}).where("p <> q")


def roots(texts: DataFrame, words: int = WORDS, tile: int = TILE, set_tile: int = SET_TILE) -> DataFrame:
    """(node, root) of the nodes of texts (node, t) with a near copy: root is the least node that links reach."""
    spark = texts.sparkSession
    arrow_limits(spark)
    sketches = stored(map_text(texts, lambda: sketcher(words), "n long, lanes array<long>", ["node"], "t").dropDuplicates(["node"]), "sketches")
    cell = F.floor(F.ln(F.greatest(F.col("n"), F.lit(1))) / float(BAND)).cast("int")
    cells = sketches.where("n > 0").withColumn("cell", cell)
    sizes = cells.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))  # a few hundred rows: one per band
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int((sizes.agg(F.sum("tiles")).first()[0] or 1) // 2))
    dealt = cells.join(F.broadcast(sizes), "cell").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    packed = stored(dealt.groupBy("cell", "tile").agg(F.collect_list(F.struct("node", "n", "lanes")).alias("rows")), "tiles")
    links = stored(tile_pairs(packed, BANDS, tasks).mapInArrow(candidates, T.StructType.fromDDL("a long, b long, d long")), "links")

    members = stored(links.selectExpr("a as node").union(links.selectExpr("b as node")).distinct(), "members")
    sets = stored(map_text(texts.join(members, "node", "left_semi").dropDuplicates(["node"]), lambda: listed(words), "shingles array<long>", ["node"], "t"), "sets")
    ends = links.select(F.explode(F.array("a", "b")).alias("node"), F.struct("d", "a", "b").alias("link"))
    closest = ends.groupBy("node").agg(F.min("link").alias("link")).select("link.a", "link.b").distinct()
    checked = stored(alike(closest, sets), "checked")
    true = checked.where("ok").select("a", "b")
    labels = components(true)
    # Then, of each pair of classes that candidates still join, the closest candidate; and at last all that are left.
    for one in (True, False):
        left = stored(labelled(links, labels).join(checked.select("a", "b"), ["a", "b"], "left_anti"), "left")
        if left.isEmpty():
            break
        asked = left.groupBy(F.least("p", "q"), F.greatest("p", "q")).agg(F.min(F.struct("d", "a", "b")).alias("link")).select("link.a", "link.b") if one else left.select("a", "b")
        more = stored(alike(asked, sets), "checked")
        checked, true = checked.union(more), true.union(more.where("ok").select("a", "b"))
        labels = components(true)

    # Classes that rejected candidates join, and all their texts.
    across = stored(labelled(links, labels).select(F.col("p").alias("a"), F.col("q").alias("b")), "across")
    if across.isEmpty():
        return labels
    named = members.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = named.join(components(across).selectExpr("node as root", "root as cell"), "root")
    split = stored(named.groupBy("cell").agg(F.count("*").alias("held")), "split")
    mixed = named.join(split.select("cell", F.ceil(F.col("held") / set_tile).cast("int").alias("tiles")), "cell").join(sets, "node")
    mixed = mixed.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    packed = stored(mixed.groupBy("cell", "tile").agg(F.collect_list(F.struct("node", "shingles")).alias("rows")), "set_tiles")
    tasks = max(tasks, int((split.agg(F.sum(F.ceil(F.col("held") / set_tile))).first()[0] or 1) // 2))
    rest = tile_pairs(packed, 0, min(tasks, 20_000)).mapInArrow(exact, T.StructType.fromDDL("a long, b long"))
    return components(true.union(stored(rest, "rest")))


def deduplicate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """One row of each class: that of the smallest id, null last. Classes and the rows that stay are found without texts."""
    whole = F.coalesce(col(text), F.lit(""))
    blank = ~F.coalesce(col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    node, mark = F.when(blank, F.lit(0).cast("long")).otherwise(F.xxhash64(whole)), F.xxhash64(*[col(c) for c in docs.columns])
    named = docs.select(node.alias("node"), whole.alias("t"), col(doc_id).alias("id"), mark.alias("mark"))
    rows = stored(named.select("node", "id", "mark"), "rows")
    found = roots(named.select("node", "t"), words)
    least = rows.groupBy("node").agg(F.min(F.struct(F.isnull("id").alias("none"), "id", "mark")).alias("first"))
    first = least.join(found, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct("first", "node")).alias("x"))
    winners = stored(first.select(F.col("x.first.mark").alias("__mark"), F.col("x.node").alias("__node")).distinct(), "winners")
    kept = docs.withColumns({"__mark": mark, "__node": node}).join(winners, ["__mark", "__node"], "left_semi")
    one = F.row_number().over(Window.partitionBy("__mark", "__node").orderBy("__mark"))  # rows equal in all columns
    return kept.withColumn("__one", one).where("__one = 1").select(*[col(c) for c in docs.columns])

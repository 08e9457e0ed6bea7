"""SimHash near-duplicates: 64-bit fingerprints of word shingles, compared exactly tile by tile.

Fingerprints are made per text with numpy (bit counts of XXH64 shingle hashes). Equal fingerprints meet first by
aggregation, so copies of any number are one. The distinct ones are dealt into tiles by the bit counts of their four
16-bit words: two fingerprints within `radius` bits have counts whose differences add up to at most `radius`, so
tile pairs beyond that are never formed, and the others are compared in full by exclusive-or and bit counts. A tile
has some thousands of fingerprints at most; a full cell is split into several tiles, and all their pairs compared.
Each tile pair returns a spanning forest of its links, not every pair; components follow by label propagation.

Defined results: null, empty and blank texts have fingerprint 0 and link like any other; texts with fewer words than
a shingle hash the whole sequence; repeated rows give repeated rows; documents whose ids are all null in a component
have a null component_id; an empty table gives an empty result; columns named like outputs are replaced, whatever
their case. The pipeline's stage, with wider fingerprints and an exact check, is nearcopies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import arrow_limits, col, map_text, others, stored
from plumbline.llm.components import components

SEED = 42
TILE = 2048
LANES = np.uint64(0x0101010101010101)


def majority(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Per group of consecutive hashes: the bits set in over half of them. Groups of none give 0."""
    out = np.zeros(len(count), np.uint64)
    full = np.flatnonzero(count)
    if not len(full):
        return out
    n = count[full]
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    parts = (n + 254) // 255  # a byte lane holds up to 255
    part_at = np.concatenate([[0], np.cumsum(parts)[:-1]])
    starts = np.repeat(first, parts) + 255 * (np.arange(int(parts.sum())) - np.repeat(part_at, parts))
    bits = np.zeros(len(full), np.uint64)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & LANES, starts)
        sums = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), part_at, axis=0)
        for j in range(8):
            bits |= (2 * sums[:, j] > n).astype(np.uint64) << np.uint64(8 * j + k)
    out[full] = bits
    return out


def fingerprinter(words: int):
    import xxhash

    digest = xxhash.xxh64_intdigest

    def work(data: np.ndarray, at: np.ndarray) -> dict[str, object]:
        raw, hashes, count = data.tobytes(), [], np.zeros(len(at) - 1, np.int64)
        for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            found = raw[a:b].lower().split()  # bytes: lowers A-Z and splits at space and \x09-\x0D only
            if not found:
                continue
            joined = b" ".join(found)
            if len(found) <= words:
                here = [digest(joined, SEED)]
            else:
                ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
                starts = np.concatenate([[0], ends[:-1] + 1])
                here = [digest(joined[x:y], SEED) for x, y in zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]
            count[i] = len(here)
            hashes.append(np.array(here, np.uint64))
        return {"fp": majority(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), count).view(np.int64)}

    return work


def fingerprints(docs: DataFrame, *, keep: list[str], text: str = "text", words: int = 3) -> DataFrame:
    """docs' columns `keep` with fp, the fingerprint as a signed long."""
    arrow_limits(docs.sparkSession)
    return map_text(docs, lambda: fingerprinter(words), "fp long", keep, text)


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links (a[i], b[i]): pairs (node, smallest node of its component here)."""
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = where[: len(a)], where[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return [(nodes[i], nodes[label[i]]) for i in moved]


def compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                left = np.asarray(batch.column(0)[i].values, np.int64)
                right = np.asarray(batch.column(1)[i].values, np.int64)
                links_a, links_b = [], []
                step = max(1, (1 << 20) // len(right))
                for at in range(0, len(left), step):
                    part = left[at : at + step]
                    x, y = np.nonzero(np.bitwise_count((part[:, None] ^ right[None, :]).view(np.uint64)) <= radius)
                    links_a.append(part[x])
                    links_b.append(right[y])
                a, b = np.concatenate(links_a), np.concatenate(links_b)
                tree = forest(a[a != b], b[a != b])
                if tree:
                    yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in tree], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def near(prints: DataFrame, radius: int = 2, tile: int = TILE) -> DataFrame:
    """(a, b): links that connect whatever distinct fp of `prints` are linked within `radius` bits, directly or not."""
    words = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(0xFFFF)) for k in range(4)]
    cells = prints.select("fp", F.array(*[w.cast("int") for w in words]).alias("cell"))
    # 17 ** 4 cells at most: their counts are a small table of bounded size.
    tiles = cells.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    dealt = cells.join(F.broadcast(tiles), "cell").select("cell", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int").alias("tile"), "fp")
    packed = stored(dealt.groupBy("cell", "tile").agg(F.collect_list("fp").alias("fps")), "tiles")
    steps = [()]
    for _ in range(4):
        steps = [(*s, d) for s in steps for d in range(-radius, radius + 1) if sum(map(abs, s)) + abs(d) <= radius]
    steps = [s for s in steps if s >= (0, 0, 0, 0)]  # of a cell pair, one direction
    shift = F.explode(F.array(*[F.array(*[F.lit(d) for d in s]) for s in steps]))
    # Pairs are made of tiles' numbers only, so that a full cell's pairs spread over tasks, and then fetch their arrays.
    ids = packed.select("cell", "tile")
    left = ids.select(F.col("cell").alias("own"), F.col("tile").alias("own_tile"), shift.alias("step")).withColumn("cell", F.zip_with("own", "step", lambda x, d: x + d))
    pairs = left.join(ids, "cell").where((F.col("own") != F.col("cell")) | (F.col("own_tile") <= F.col("tile"))).select("own", "own_tile", "cell", "tile")
    tasks = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(20_000, packed.count() // 16))
    pairs = pairs.repartition(tasks, "own", "own_tile", "cell", "tile")
    pairs = pairs.join(packed.selectExpr("cell as own", "tile as own_tile", "fps as left"), ["own", "own_tile"])
    pairs = pairs.join(packed.selectExpr("cell", "tile", "fps as right"), ["cell", "tile"])
    return pairs.select("left", "right").mapInArrow(compare(radius), T.StructType.fromDDL("a long, b long"))


def classes(docs: DataFrame, *, doc_id: str, text: str, words: int, radius: int, keep: list[str], tile: int) -> DataFrame:
    """docs' columns `keep` with fp, root (a fingerprint that names the class) and component_id."""
    prints = stored(fingerprints(docs, keep=keep, text=text, words=words), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min(col(doc_id)).alias("least")), "distinct")
    roots = components(near(distinct, radius, tile))
    grouped = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(stored(grouped.join(least, "root").select("fp", "root", "component_id"), "classes"), "fp")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 3, radius: int = 2, keep: list[str] | None = None, tile: int = TILE) -> DataFrame:
    """docs' columns `keep` (default: the id) with fingerprint (16 hex digits) and component_id (the smallest id that
    links within `radius` bits reach)."""
    keep = others([doc_id] if keep is None else keep, ["fingerprint", "component_id"])
    named = docs.select(*[col(c).alias(f"k_{i}") for i, c in enumerate(keep)], col(doc_id).alias("id"), col(text).alias("t"))
    out = classes(named, doc_id="id", text="t", words=words, radius=radius, keep=[*[f"k_{i}" for i in range(len(keep))], "id"], tile=tile)
    return out.select(*[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)], F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

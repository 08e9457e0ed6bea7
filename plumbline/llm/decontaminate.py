"""Benchmark decontamination: a broadcast hash set of benchmark windows, scanned for in every training text.

Texts are lower-cased (A-Z only); words are runs of digits, a-z and characters outside ASCII. A window is 13
consecutive words of an item; an item with fewer words is one window. Each text's word windows are hashed with
numpy, looked up in the benchmark's set and verified byte by byte. Words inside any occurrence count as hit.

What is broadcast is bounded: a benchmark of more than MAX_WORDS words (about 60 bytes each) is dealt into blocks of at
most about as many, long items in pieces that overlap by a window, and texts are scanned once for each block. The
results of the blocks are put together by row, so columns and values are the same for any size. `remove_spans` cuts
the hit words out of the texts; dropping contaminated rows drops documents.

Defined results: a null or empty text has no words and isn't contaminated; a null or empty item has no window;
repeated items and repeated texts count like any other; an item with a null id marks words but isn't listed; an
empty table gives an empty result; columns of the input with the names of outputs are replaced, whatever their case.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.llm.common import arrow_limits, col, map_text, others, run_hashes, runs, stored

WINDOW = 13
MAX_WORDS = 500_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
FOUND = "n_words long, spans array<struct<first:int,last:int,start:int,end:int>>, items array<string>"
OUT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, hit_spans array<struct<start:int,end:int>>"

WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[0x30:0x3A] = WORD_BYTES[0x61:0x7B] = True
WORD_BYTES[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
STEP = 0xD6E8FEB86659FD93
BITS = 1 << 20


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n consecutive words."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        out = out * np.uint64(STEP) + words[k : k + len(out)]
    return out


def low_bits(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(BITS - 1)).astype(np.int64)


class Windows:
    """The windows of pieces of items: by length, hashes in order and the places of their first words."""

    def __init__(self, pieces: list[tuple[str | None, str]], n: int) -> None:
        """pieces: item and its words, joined by a space."""
        raw = [text.encode() for _, text in pieces]
        self.items, self.data = [item for item, _ in pieces], np.frombuffer(b"".join(r + b" " for r in raw), np.uint8)
        at = np.cumsum([0, *(len(r) + 1 for r in raw)])
        self.starts, self.ends, self.first, marks = runs(self.data, at, WORD_BYTES)
        hashes = run_hashes(self.data, self.starts, self.ends, marks)
        size = np.minimum(n, np.diff(self.first))
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in np.unique(size[size > 0]).tolist():
            places = np.concatenate([np.arange(a, b - k + 1) for a, b in zip(self.first[:-1][size == k], self.first[1:][size == k], strict=True)])
            rolled = window_hashes(hashes, k)[places]
            order = np.argsort(rolled, kind="stable")
            bits = np.zeros(BITS, bool)
            bits[low_bits(rolled)] = True
            self.tables[k] = (rolled[order], places[order], bits)

    def holders(self, k: int, window_hash: np.uint64, words: bytes) -> tuple[bool, set[str]]:
        """Whether `words`, joined by a space, are a window of k words, and the items that hold it."""
        hashes, places, _ = self.tables[k]
        found, items = False, set()
        for p in places[np.searchsorted(hashes, window_hash) : np.searchsorted(hashes, window_hash, side="right")].tolist():
            if self.data[self.starts[p] : self.ends[p + k - 1]].tobytes() == words:
                found, item = True, self.items[int(np.searchsorted(self.first, p, side="right")) - 1]
                if item is not None:
                    items.add(item)
        return found, items


def scan(windows: Windows, data: np.ndarray, at: np.ndarray) -> dict[str, list]:
    """Of a slice of texts: words, spans of hit words (places among the text's words, and bytes), and items."""
    data = LOWER[data]
    starts, ends, before, marks = runs(data, at, WORD_BYTES)
    hashes = run_hashes(data, starts, ends, marks)
    count = np.diff(before)
    row_of = np.repeat(np.arange(len(count)), count)
    change = np.zeros(len(starts) + 1, np.int64)
    items: dict[int, set[str]] = {}
    for k, (_, _, bits) in windows.tables.items():
        rolled = window_hashes(hashes, k)
        maybe = np.flatnonzero(bits[low_bits(rolled)])
        maybe = maybe[row_of[maybe] == row_of[maybe + k - 1]]
        known: dict[tuple[int, bytes], tuple[bool, set[str]]] = {}  # a window that many texts of the slice share is looked up once
        for i in maybe.tolist():
            key = int(rolled[i]), b" ".join(data[starts[i + j] : ends[i + j]].tobytes() for j in range(k))
            if key not in known:
                known[key] = windows.holders(k, rolled[i], key[1])
            found, of = known[key]
            if found:
                change[i] += 1
                change[i + k] -= 1
                items.setdefault(int(row_of[i]), set()).update(of)
    spans: list[list[dict]] = [[] for _ in count]
    marked = np.flatnonzero(np.cumsum(change)[:-1] > 0)
    if len(marked):
        new = np.concatenate([[True], (np.diff(marked) > 1) | (np.diff(row_of[marked]) > 0)])
        for a, b in zip(marked[new], marked[np.concatenate([new[1:], [True]])], strict=True):
            row = int(row_of[a])
            spans[row].append({"first": int(a - before[row]), "last": int(b + 1 - before[row]), "start": int(starts[a] - at[row]), "end": int(ends[b] - at[row])})
    return {"n_words": count.tolist(), "spans": spans, "items": [sorted(items.get(i, ())) for i in range(len(count))]}


def concluded(found: dict[str, list], min_share: float) -> dict[str, list]:
    """The columns OUT of those of FOUND, whose spans may overlap."""
    out: dict[str, list] = {name: [] for name in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "hit_spans")}
    for n, spans, items in zip(found["n_words"], found["spans"], found["items"], strict=True):
        whole: list[dict] = []
        for s in sorted(spans, key=lambda s: (s["first"], s["last"])):
            if whole and s["first"] <= whole[-1]["last"]:
                if s["last"] > whole[-1]["last"]:
                    whole[-1] = whole[-1] | {"last": s["last"], "end": s["end"]}
            else:
                whole.append(s)
        hit, items = sum(s["last"] - s["first"] for s in whole), sorted(set(items))
        row = (n, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0 and hit >= min_share * n, items, [{"start": s["start"], "end": s["end"]} for s in whole])
        for column, value in zip(out.values(), row, strict=True):
            column.append(value)
    return out


def words_of(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, NOT_WORD), lambda w: w != "")


def pieces_of(benchmark: DataFrame, item_id: str, item_text: str, window: int, most: int) -> DataFrame:
    """(item, words, n): items in pieces of at most `most` words, each of which repeats the window - 1 before it."""
    step = max(1, most - window + 1)
    items = benchmark.select(col(item_id).cast("string").alias("item"), words_of(col(item_text)).alias("w")).where(F.size("w") > 0)
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (window - 1)), F.lit(step)))
    cut = items.select("item", "w", at.alias("at")).select("item", F.slice("w", F.col("at"), F.lit(step + window - 1)).alias("w"))
    return cut.select("item", F.array_join("w", " ").alias("words"), F.size("w").alias("n")).distinct()


def dealt(pieces: DataFrame, max_words: int) -> tuple[DataFrame, int]:
    """pieces with a block each, and the number of blocks: each holds at most twice max_words words, or a single piece."""
    blocks = max(1, -(-(pieces.agg(F.sum("n")).first()[0] or 0) // max_words))
    while True:
        out = pieces.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(blocks)))
        worst = out.groupBy("block").agg(F.sum("n").alias("n"), F.count("*").alias("pieces")).where("pieces > 1").agg(F.max("n")).first()[0] or 0
        if worst <= 2 * max_words:
            return out, blocks
        blocks *= 2


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, keep: list[str] | None = None, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, min_share: float = 0.05, max_words: int = MAX_WORDS) -> DataFrame:
    """docs' columns `keep` (default: all) with n_words, n_hit, n_items, items_sha256, contaminated, items and
    hit_spans (byte spans of hit words in the UTF-8 text)."""
    spark = docs.sparkSession
    arrow_limits(spark)
    keep = others(docs.columns if keep is None else keep, ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "hit_spans"])
    pieces, blocks = dealt(stored(pieces_of(benchmark, item_id, item_text, window, max(1, max_words // 4)), "pieces"), max_words)
    load = lambda b: spark.sparkContext.broadcast(Windows(sorted((tuple(r) for r in pieces.where(F.col("block") == b).select("item", "words").collect()), key=str), window))
    if blocks == 1:
        windows = load(0)
        return map_text(docs, lambda: lambda data, at: concluded(scan(windows.value, data, at), min_share), OUT, keep, text)

    rows = stored(docs.select(*[col(c).alias(f"k_{i}") for i, c in enumerate(keep)], col(text).alias("__text"), F.monotonically_increasing_id().alias("__row")), "rows")
    found = None
    for b in range(blocks):
        windows = load(b)
        part = map_text(rows, lambda windows=windows: lambda data, at: scan(windows.value, data, at), FOUND, ["__row"], "__text")
        part = stored(part if b == 0 else part.where(F.size("spans") > 0), "found")
        windows.unpersist()
        found = part if found is None else found.unionByName(part)
    whole = found.groupBy("__row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    schema = StructType.fromDDL(f"__row long, {OUT}")

    def conclude(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted = to_arrow_schema(schema)
        for batch in batches:
            got = {"__row": batch.column("__row").to_pylist()} | concluded(batch.select(["n_words", "spans", "items"]).to_pydict(), min_share)
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in wanted], schema=wanted)

    out = rows.join(whole.mapInArrow(conclude, schema), "__row")
    return out.select(*[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)], "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "hit_spans")


def remove_spans(found: DataFrame, text: str = "text") -> DataFrame:
    """A result of decontaminate() that kept its text, with the hit spans cut out of it; a null text stays null."""
    raw, start = col(text).cast("binary"), F.struct(F.lit(bytearray()).alias("out"), F.lit(0).alias("at"))
    cut = F.aggregate("hit_spans", start, lambda a, s: F.struct(F.concat(a["out"], F.substring(raw, a["at"] + 1, s["start"] - a["at"])).alias("out"), s["end"].alias("at")))
    rest = lambda a: F.concat(a["out"], F.substring(raw, a["at"] + 1, F.octet_length(col(text)))).cast("string")
    new = F.element_at(F.transform(F.array(cut), rest), 1)
    return found.select(*[F.when(F.size("hit_spans") > 0, new).otherwise(col(c)).alias(c) if c == text else col(c) for c in found.columns])

"""Language identification by partial matching: per-language byte context trees with escape probabilities.

Training counts byte sequences of four in the training rows of each language (a sample of about MAX_DOCS texts and MAX_MB
megabytes at most of each language, drawn by a hash of the text, of any length; one text at least). From these come, per
language, contexts of three to zero bytes. In a context seen T times with q distinct next bytes, a seen byte has
probability n / (T + q) (escape method C) and the escape q / (T + q); an escape goes on in the context shortened by its
first byte, without the bytes already excluded, down to equal chances for all 256 bytes. A context that its language
saw once is its shorter one. Statistics are frozen, so a text's code length is a sum of table entries; it is exact: each
context's probabilities add up to 1. The language with the shortest code, its prior included, is the prediction, and its
posterior the score.

Nothing of a language's tables depends on other languages. They are fitted by tasks, GROUP languages to one, which
share a table of the contexts and bytes that any of them saw, and written to the shared folder; the driver holds one
group's at a time. Scoring takes as many groups as PASS_MB holds in one pass over the texts; of more groups, each
further pass reads what the one before wrote.

Defined results: null texts and texts without a letter give `und` with score 0; rows with null language teach
nothing, and a language whose texts are all empty isn't learned; without any training row every text is `und`; equal code lengths give the language first by code point;
columns named like outputs are replaced, whatever their case.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_limits, col, draw, map_text, others, slices, stored, text_bytes

MAX_DOCS = 2000
MAX_MB = 4
GROUP = 4
PASS_MB = 128
ORDER = 3
BASE = 257  # byte + 1; 0 stands for what precedes a text


def before(symbols: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The symbols one, two and three places back, 0 before a text's start."""
    starts = at[:-1][at[:-1] < at[1:]]
    out, here = [], symbols
    for _ in range(ORDER):
        here = np.concatenate([[0], here[:-1]]).astype(symbols.dtype) if len(here) else here
        here[starts] = 0
        out.append(here)
    return out


def count_sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.asarray(batch.column(0), np.int64)
        data, at = text_bytes(batch.column(1))
        for a, b in slices(at):
            part, where = data[at[a] : at[b]].astype(np.int64) + 1, at[a : b + 1] - at[a]
            one, two, three = before(part, where)
            keys = ((three * BASE + two) * BASE + one) * BASE + part
            of = np.repeat(langs[a:b], np.diff(where))
            for lang in np.unique(langs[a:b]):
                key, n = np.unique(keys[of == lang], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), lang, np.int32)), pa.array(key, pa.int64()), pa.array(n, pa.int64())], names=["lang", "key", "n"])


class Places:
    """Where each of some distinct keys (none negative) stands, -1 for others: open addressing, half of the slots free at least."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.place = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.key[slot] < 0
            self.key[slot[free]] = keys[left[free]]  # of several at a slot one stays
            here = self.key[slot] == keys[left]
            self.place[slot[here]] = left[here]
            left, slot = left[~here], (slot[~here] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        held, out = self.key[slot], self.place[slot]
        other = held != keys
        out[other] = -1
        miss = np.flatnonzero(other & (held >= 0))
        while len(miss):
            slot[miss] = at = (slot[miss] + 1) & self.mask
            held = self.key[at]
            found = held == keys[miss]
            out[miss[found]] = self.place[at[found]]
            miss = miss[~found & (held >= 0)]
        return out


class Tables:
    """Trees of some languages. contexts: keys of the known ones, by size; cells: context and byte of each row of `bits`
    (by language), in order; escapes: each context's escape bits by language; shorter: the context without its first byte."""

    def __init__(self, lang: np.ndarray, keys: np.ndarray, n: np.ndarray, k: int) -> None:
        """lang: which of the k languages, keys of four symbols, n: how often."""
        byte = keys % BASE - 1
        first, held = 0, np.zeros(0, np.int64)
        self.contexts, self.shorter, self.cells = (np.zeros(0, np.int64) for _ in range(3))
        self.escapes, self.bits = np.zeros((0, k)), np.zeros((0, k))
        for size in range(ORDER + 1):
            known, which = np.unique(keys // BASE % BASE**size, return_inverse=True)
            total = np.bincount(which * k + lang, n, len(known) * k).reshape(-1, k)
            used = total >= (2 if size else 0)  # a language's longer context only where it has the shorter one
            kept = used.any(1)
            number = np.cumsum(kept) - 1
            hit = used[which, lang]
            cell, row = np.unique(number[which[hit]] * 256 + byte[hit], return_inverse=True)
            count = np.bincount(row * k + lang[hit], n[hit], len(cell) * k).reshape(-1, k)
            known, total = known[kept], np.where(used, total, 0)[kept]
            context, symbol = np.divmod(cell, 256)
            shorter = self.contexts[:0] if not size else first + np.searchsorted(held, known % BASE ** (size - 1))
            lower = 2.0 ** -self.along(shorter[context], symbol) if size else np.full(count.shape, 1 / 256)
            distinct, given = np.zeros(total.shape), np.zeros(total.shape)
            np.add.at(distinct, context, count > 0)
            np.add.at(given, context, np.where(count > 0, lower, 0))  # what the seen bytes have in the shorter context
            full = distinct >= 256  # no escape where every byte was seen
            with np.errstate(invalid="ignore", divide="ignore"):
                out = np.where(total == 0, 1.0, np.where(full, 1e-300, distinct / (total + distinct) / np.maximum(1 - given, 1e-300)))
                p = np.where(count > 0, count / np.where(full, total, total + distinct)[context], out[context] * lower)
            first = len(self.contexts)
            self.contexts = np.concatenate([self.contexts, known * (ORDER + 1) + size])
            self.shorter = np.concatenate([self.shorter, shorter if size else np.zeros(len(known), np.int64)])
            self.escapes = np.concatenate([self.escapes, -np.log2(out)])
            self.cells = np.concatenate([self.cells, cell + first * 256])
            self.bits = np.concatenate([self.bits, -np.log2(p)])
            held = known
            self.places = None
        self.bits, self.escapes, self.shorter = self.bits.astype(np.float32), self.escapes.astype(np.float32), self.shorter.astype(np.int32)

    def ready(self) -> Tables:
        """With places to find contexts and cells by; not part of what is written."""
        self.places = Places(self.contexts), Places(self.cells)
        return self

    def rows(self, cells: np.ndarray) -> np.ndarray:
        if self.places:
            return self.places[1].find(cells)
        at = np.minimum(np.searchsorted(self.cells, cells), len(self.cells) - 1)
        return np.where(self.cells[at] == cells, at, -1)

    def along(self, context: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Bits by language of bytes in contexts: along the shorter contexts down to where the byte was seen."""
        out = np.zeros((len(context), self.bits.shape[1]), self.bits.dtype)
        left, at = np.arange(len(context)), context.astype(np.int64)
        while len(left):
            row = self.rows(at * 256 + byte[left])
            seen = row >= 0
            out[left[seen]] += self.bits[row[seen]]
            left, at = left[~seen], at[~seen]
            out[left] += self.escapes[at]
            root = at == 0
            out[left[root]] += np.float32(8)
            left, at = left[~root], self.shorter[at[~root]].astype(np.int64)
        return out

    def code_lengths(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Bits of each text by language."""
        out = np.zeros((len(at) - 1, self.bits.shape[1]))
        full = np.flatnonzero(at[:-1] < at[1:])
        if len(full):
            one, two, three = before(data.astype(np.int64) + 1, at)
            key = (three * BASE + two) * BASE + one
            context, left = np.zeros(len(data), np.int32), np.arange(len(data))
            for size in range(ORDER, 0, -1):
                found = self.places[0].find(key[left] % BASE**size * (ORDER + 1) + size)
                context[left] = np.maximum(found, 0)
                left = left[found < 0]
            out[full] = np.add.reduceat(self.along(context, data.astype(np.int64)), at[full], axis=0, dtype=np.float64)
        return out


class Model:
    """langs and their priors in bits; groups: group, tables (GROUP languages in turn, written), size in bytes."""

    def __init__(self, docs: dict[str, int], groups: DataFrame) -> None:
        self.langs, self.groups = sorted(docs), groups
        share = np.array([docs[x] for x in self.langs], float)
        self.prior = -np.log2(share / share.sum())
        self.sizes = {r["group"]: r["size"] for r in groups.select("group", "size").collect()}  # one row for GROUP languages

    def tables(self, group: int) -> bytes:
        return bytes(self.groups.where(F.col("group") == group).first()["tables"])

    def passes(self, pass_mb: float = PASS_MB) -> list[list[int]]:
        """The groups, in order, as many to a pass as its bytes hold, one at least."""
        out, used = [], np.inf
        for group in sorted(self.sizes):
            used += self.sizes[group]
            if used > pass_mb * 1e6:
                out.append([])
                used = self.sizes[group]
            out[-1].append(group)
        return out

    def code_lengths(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Bits of each text by language, priors included; for small checks."""
        return self.prior + np.hstack([pickle.loads(self.tables(g)).ready().code_lengths(data, at) for g in sorted(self.sizes)])


def scorer(shared: dict, langs: list[str], prior: np.ndarray, names: list[str]):
    """Of the groups in `shared` (broadcasts): the shortest code's bits, its language, and the sum of all languages' chances by its own."""
    tables = {g: pickle.loads(b.value).ready() for g, b in shared.items()}
    mine = np.concatenate([np.arange(g * GROUP, min((g + 1) * GROUP, len(langs))) for g in tables])

    def work(data: np.ndarray, at: np.ndarray) -> dict[str, object]:
        bits = np.hstack([t.code_lengths(data, at) for t in tables.values()]) + prior[mine]
        least = bits.min(1)
        whole = np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
        return dict(zip(names, (least, [langs[mine[i]] for i in bits.argmin(1)], whole), strict=True))

    return work


def fit(train: DataFrame, *, lang: str = "lang", text: str = "text", max_docs: int = MAX_DOCS, max_mb: float = MAX_MB) -> Model | None:
    """The model of train's languages; None without any."""
    rows = train.where(col(lang).isNotNull() & col(text).isNotNull()).select(col(lang).cast("string").alias("lang"), col(text).alias("text"))
    known = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"), F.min(F.when(F.col("text") != "", draw(F.col("text")))).alias("least")).where("size > 0").toPandas().sort_values("lang", key=lambda c: c.map(str.encode), ignore_index=True)
    if known.empty:
        return None
    known["share"] = np.minimum(1.0, np.minimum(max_docs / known.n, max_mb * 1e6 / np.maximum(known["size"], 1)))
    shares = train.sparkSession.createDataFrame([(x, i, float(s), float(t)) for i, (x, s, t) in enumerate(zip(known.lang, known.share, known.least, strict=True))], "lang string, place int, share double, least double")
    chosen = (draw(F.col("text")) < F.col("share")) | (draw(F.col("text")) == F.col("least"))
    sample = rows.join(F.broadcast(shares), "lang").where(chosen).select("place", "text")
    counts = sample.mapInArrow(count_sequences, "lang int, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    n_langs = len(known)

    def trees(rows: pd.DataFrame) -> pd.DataFrame:
        group = int(rows["group"].iloc[0])
        tables = Tables(rows["lang"].to_numpy(np.int64) - group * GROUP, rows["key"].to_numpy(np.int64), rows["n"].to_numpy(float), min(GROUP, n_langs - group * GROUP))
        written = pickle.dumps(tables, protocol=5)
        return pd.DataFrame({"group": [group], "tables": [written], "size": [len(written)]})

    grouped = counts.withColumn("group", F.floor(F.col("lang") / GROUP).cast("int")).groupBy("group").applyInPandas(trees, "group int, tables binary, size long")
    return Model(dict(zip(known.lang, known.n.astype(int), strict=True)), stored(grouped, "trees"))


def identify(docs: DataFrame, train: Column, *, lang: str = "lang", text: str = "text", keep: list[str] | None = None, pass_mb: float = PASS_MB, **bounds) -> DataFrame:
    """docs' columns `keep` (default: all) with lang_pred and score. train: which rows may teach."""
    arrow_limits(docs.sparkSession)
    keep = others(docs.columns if keep is None else keep, ["lang_pred", "score"])
    model = fit(docs.where(train), lang=lang, text=text, **bounds)
    letters = F.coalesce(col(text).rlike(r"\p{L}"), F.lit(False))
    out = docs.select(*[col(c) for c in keep], col(text).alias("__own_text"), letters.alias("__letters"))
    carried = [*keep, "__letters"]
    if model is None:
        return out.select(*[col(c) for c in keep], F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    passes = model.passes(pass_mb)
    for i, groups in enumerate(passes):
        shared = {g: docs.sparkSession.sparkContext.broadcast(model.tables(g)) for g in groups}
        names = [f"__{x}_{i}" for x in ("bits", "lang", "whole")]
        make = partial(scorer, shared, model.langs, model.prior, names)
        last = i == len(passes) - 1
        out = map_text(out, make, f"{names[0]} double, {names[1]} string, {names[2]} double", [*carried, *([] if last else ["__own_text"])], "__own_text")
        carried += names
        out = out if last else stored(out, "languages")
    least = F.array_min(F.array(*[F.col(f"__bits_{i}") for i in range(len(passes))]))
    best = F.coalesce(*[F.when(F.col(f"__bits_{i}") == least, F.col(f"__lang_{i}")) for i in range(len(passes))])
    whole = sum((F.col(f"__whole_{i}") * F.pow(F.lit(2.0), F.greatest(least - F.col(f"__bits_{i}"), F.lit(-1000.0))) for i in range(len(passes))), F.lit(0.0))
    known = F.col("__letters")
    return out.select(*[col(c) for c in keep], F.when(known, best).otherwise("und").alias("lang_pred"), F.when(known, 1 / whole).otherwise(0.0).alias("score"))

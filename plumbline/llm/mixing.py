"""Mixing sources to target weights, by Sainte-Laguë apportionment of equal-token blocks.

Each source's target comes from its weight and a share of all words, stopped at `most` times the source's words; the
excess is shared anew by weight until no source is above. Blocks of an equal number of words are allocated to the
sources, and within a source to its shards, each time by highest quotients votes / (2 * seats + 1). A shard's
documents follow each other in a seeded order; of its n blocks, quota q is selected at q / n steps from a seeded
start, so each block is taken 0, 1, ... or `most` times, q in all. A document takes the selected parts of its words.

Only one row per source and one per shard come to the driver: there are at most MAX_SHARDS shards besides one per
source, however many documents; sources themselves (about 100 bytes each) have to fit the driver. Shards are dealt by a hash, so a source with a third of all rows is many tasks.

Defined results: a null or empty text has size 0 and takes nothing; a null source is a source of its own, last in
order; equal quotients go to the source or shard first in order; repeated rows are documents of their own, told
apart only by their order, which leaves the set of results as it is; an empty table gives an empty result; columns
named like outputs are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import col, others, stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SHARD_WORDS = 1 << 16
MAX_SHARDS = 20_000
BLOCK_WORDS = 128
#: Rows of sources or shards, already on the driver, up to which they are broadcast: some MB. Beyond: a shuffled join.
MAX_BROADCAST = 100_000
SPACE = r"[\x20\x09-\x0D]+"


def sainte_lague(votes: np.ndarray, seats: int, caps: np.ndarray) -> np.ndarray:
    """Seats by highest quotients votes / (2 * seats + 1), none above its cap. Ties: first in order."""
    votes, caps = np.asarray(votes, float), np.asarray(caps, np.int64)
    caps = np.where(votes > 0, caps, 0)
    seats = min(int(seats), int(caps.sum()))
    if seats <= 0:
        return np.zeros(len(votes), np.int64)
    given = lambda m: np.minimum(caps, np.floor(np.minimum(votes * m + 0.5, caps.max() + 1.0))).astype(np.int64)
    low, high = 0.0, (caps.max() + 1.0) / votes[votes > 0].min()
    for _ in range(200):  # the largest common multiplier whose rounded seats aren't too many
        mid = (low + high) / 2
        low, high = (mid, high) if given(mid).sum() <= seats else (low, mid)
    out = given(low)
    while (left := seats - int(out.sum())) > 0:
        quotient = np.where(out < caps, votes / (2 * out + 1), -1.0)
        best = np.lexsort((np.arange(len(votes)), -quotient))[:left]
        out[best[quotient[best] > 0]] += 1
    return out


def targets(sizes: np.ndarray, weights: np.ndarray, share: float, most: float) -> np.ndarray:
    """Shares of share * all words by weight, each at most `most` times its size, the excess shared anew."""
    caps, out = most * sizes.astype(float), np.zeros(len(sizes))
    left, open_ = min(share * float(sizes.sum()), float(caps.sum())), sizes > 0
    while open_.any():
        offer = left * weights / weights[open_].sum()
        full = open_ & (offer >= caps)
        if not full.any():
            out[open_] = offer[open_]
            break
        out[full] = caps[full]
        left -= float(caps[full].sum())
        open_ &= ~full
    return out


def small(df: DataFrame, rows: list) -> DataFrame:
    return F.broadcast(df) if len(rows) <= MAX_BROADCAST else df


def mix(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = 11, keep: list[str] | None = None, spans: bool = False) -> DataFrame:
    """docs' columns `keep` (default: the id) with size, source_size, target and taken. spans: also the taken parts,
    as words from `start` to before `stop` (from 0), `times` times. weights: repeating, for sources by code point."""
    spark = docs.sparkSession
    keep = others([doc_id] if keep is None else keep, ["size", "source_size", "target", "taken", "spans"])
    size = F.coalesce(F.regexp_count(col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    key = F.coalesce(F.concat(F.lit("="), col(source).cast("string")), F.lit(""))  # null: the empty key
    sized = docs.select(*[col(c).alias(f"k_{i}") for i, c in enumerate(keep)], key.alias("key"), size.alias("size"), col(doc_id).alias("id"))
    sized = stored(sized.withColumn("draw", F.xxhash64(F.lit(seed), "id", "size")), "sized")

    known = sized.groupBy("key").agg(F.sum("size").alias("size")).toPandas()
    known = known.assign(last=known["key"] == "").sort_values(["last", "key"], ignore_index=True)
    sizes = known["size"].to_numpy(np.int64) if len(known) else np.zeros(0, np.int64)
    goal = targets(sizes, np.resize(np.array(weights, float), len(sizes)), share, most)
    block = int(max(1, min([block_words, *(goal[goal > 0] // 200)])))
    per_shard = max(shard_words, -(-int(sizes.sum()) // MAX_SHARDS))
    known = known.assign(target=goal, shards=np.maximum(1, -(-sizes // per_shard)))

    rows = [(k, int(s), float(t), int(n)) for k, s, t, n in zip(known["key"], sizes, goal, known["shards"], strict=True)]
    sources = spark.createDataFrame(rows, "key string, source_size long, target double, shards long")
    dealt = sized.join(small(sources, rows), "key").withColumn("shard", F.pmod("draw", "shards"))
    shards = dealt.groupBy("key", "shard").agg(F.sum("size").alias("words")).toPandas().sort_values(["key", "shard"], ignore_index=True)
    shards["blocks"] = -(-shards["words"] // block)
    own_blocks = shards.groupby("key")["blocks"].sum().reindex(known["key"]).fillna(0).to_numpy(np.int64)
    wanted = goal * own_blocks / np.maximum(1, sizes)  # a shard's last block may be short
    quotas = []
    by_key, none = dict(list(shards.groupby("key"))), shards.iloc[:0]
    for (k, own), q in zip(((k, by_key.get(k, none)) for k in known["key"]), sainte_lague(wanted, round(float(wanted.sum())), most * own_blocks), strict=True):
        n = own["blocks"].to_numpy(np.int64)
        for shard, count, quota in zip(own["shard"], n, sainte_lague(own["words"].to_numpy(np.int64), int(q), most * n), strict=True):
            start = int.from_bytes(hashlib.sha256(f"{seed}:{k}:{shard}".encode()).digest()[:6], "big") % max(1, int(count))
            quotas.append((k, int(shard), int(count), int(quota), start))
    quota = spark.createDataFrame(quotas, "key string, shard long, blocks long, quota long, start long")

    order = Window.partitionBy("key", "shard").orderBy("draw", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.join(small(quota, quotas), ["key", "shard"]).withColumn("to", F.sum("size").over(order))
    chosen = f"((k * quota + start) div greatest(blocks, 1))"  # blocks selected before block k
    before = lambda t: f"({chosen.replace('k *', f'({t} div {block}) *')} * {block} + ({t} % {block}) * ({chosen.replace('k *', f'({t} div {block} + 1) *')} - {chosen.replace('k *', f'({t} div {block}) *')}))"
    out = placed.withColumn("taken", F.when(F.col("size") > 0, F.expr(f"{before('to')} - {before('(to - size)')}")).otherwise(F.lit(0).cast("long")))
    names = [F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)]
    more = []
    if spans:
        parts = f"transform(sequence((to - size) div {block}, (to - 1) div {block}), k -> named_struct('start', greatest(k * {block} - (to - size), 0L), 'stop', least((k + 1) * {block} - (to - size), size), 'times', {chosen.replace('k *', '(k + 1) *')} - {chosen}))"
        none = F.expr("cast(array() as array<struct<start: bigint, stop: bigint, times: bigint>>)")
        more = [F.when(F.col("size") > 0, F.filter(F.expr(parts), lambda p: p["times"] > 0)).otherwise(none).alias("spans")]
    return out.select(*names, "size", "source_size", "target", "taken", *more)

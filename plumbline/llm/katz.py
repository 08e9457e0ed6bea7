"""Language-model scores by Katz backoff over word pairs.

Training counts are discounted by Good-Turing for counts up to K, and what that frees is shared among a context's
unseen words in proportion to the lower order, with exactly normalised backoff weights. A token is evaluated
recursively: its pair's discounted probability where the pair was seen, else the context's backoff weight times the
word's own probability, which itself backs off to the event of a new word. So each context's probabilities over the
V training words and that one event add up to 1.

Documents are cut into blocks of some BLOCK_BYTES, stored with their tokens numbered. The tables of each order are
partitioned by a hash of the context into buckets: blocks send each bucket their distinct words (or pairs) with the
training counts; a bucket adds them up and returns to each block the counts it needs, so a frequent pair is one entry
per block however often it occurs. The answers are stored, too. A context with over 1 / HOT of all training tokens is
spread over the buckets by its successors; its sums, of at most HOT contexts, reach every task. Buckets grow in
number with the corpus.

Defined results: null and empty texts are one token, the end; without training tokens a new word has probability 1;
a discount that the counts-of-counts can't give (or outside 0 to 1) is left out, and a context without discounted
mass gives one count to unseen words; repeated rows count and score like any other; an empty table gives an empty
result; columns named like outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import arrow_limits, col, mix, others, run_hashes, runs, slices, stored, text_bytes

K = 5
HOT = 256
BLOCK_BYTES = 16 << 20
BUCKET_BYTES = 16 << 20
BUCKETS = (64, 1 << 16)
#: Numbers in place of hashes for a text's end and for what precedes its first word; START sorts last.
END, START = np.uint64(1), np.uint64(2**64 - 1)
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32
#: Of a context: its count, seen words of counts 1 to K after it, seen words of own counts 1 to K, own counts beyond K.
FIELDS = 2 * K + 2


def pack(values: np.ndarray, ascending: bool = False) -> bytes:
    """Whole numbers in few bytes: differences where ascending, then byte by byte of all, compressed."""
    v = np.ascontiguousarray(values, "<u8")
    if ascending:
        v = np.diff(v, prepend=np.uint64(0))
    return len(v).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def unpack(raw: bytes, ascending: bool = False) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(pa.decompress(raw[8:], 8 * n, "zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    v = np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").ravel()
    return np.cumsum(v, dtype=np.uint64) if ascending else v


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's end included, and the number of tokens of each text."""
    parts, counts = [], []
    for a, b in slices(at):
        low, where = FOLD[data[at[a] : at[b]]], at[a : b + 1] - at[a]
        starts, ends, first, marks = runs(low, where, NOT_SPACE)
        h = np.clip(run_hashes(low, starts, ends, marks), END + np.uint64(1), START - np.uint64(1))
        parts.append(np.insert(h, first[1:], END))
        counts.append(np.diff(first) + 1)
    return np.concatenate([np.zeros(0, np.uint64), *parts]), np.concatenate([np.zeros(0, np.int64), *counts])


def blocks_of(docs: DataFrame, train: Column, keep: list[str], text: str, block_bytes: int) -> DataFrame:
    """One row per block: kept columns and token counts of its texts, whether they teach, distinct words, tokens."""
    kept = F.struct(*[col(c).alias(f"k_{i}") for i, c in enumerate(keep)]) if keep else F.struct(F.lit(0).alias("k_0"))
    source = docs.select(kept.alias("kept"), F.coalesce(train, F.lit(False)).alias("train"), col(text).alias("text"))
    numbered = source.withColumn("block", F.monotonically_increasing_id())
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("kept", T.ArrayType(source.schema["kept"].dataType)), *T.StructType.fromDDL("train array<boolean>, counts array<int>, words binary, tokens binary")])

    def lists(value: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(value)], pa.int32()), value)

    def block(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        hashes, counts = [], []
        for r in rows:
            h, n = word_hashes(*text_bytes(r.column("text")))
            hashes.append(h)
            counts.append(n)
        words, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
        whole = pa.Table.from_batches([r.select(["kept", "train"]) for r in rows]).combine_chunks()
        counts = pa.array(np.concatenate(counts), pa.int32())
        columns = [rows[0].column("block")[:1], *[lists(whole.column(c).chunk(0)) for c in ("kept", "train")], lists(counts), pa.array([pack(words, True)], pa.binary()), pa.array([pack(tokens)], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            at = text_bytes(batch.column("text"))[1]
            for a, b in slices(at, block_bytes):
                if held and size + at[b] - at[a] > block_bytes:
                    yield block(held)
                    held, size = [], 0
                held.append(batch.slice(a, b - a))
                size += int(at[b] - at[a])
        if held:
            yield block(held)

    return numbered.mapInArrow(run, schema)


ASK = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("payload", T.ArrayType(T.BinaryType()))])
ANSWER = T.StructType([*ASK, T.StructField("stats", T.ArrayType(T.LongType()))])


def rows_of(schema: T.StructType, *columns: list) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    wanted = to_arrow_schema(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, wanted, strict=True)], schema=wanted)


def cut(bucket: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
    """Places of each bucket in order, of those that have any."""
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(n + 1))
    return [(b, order[ends[b] : ends[b + 1]]) for b in range(n) if ends[b] < ends[b + 1]]


def ask_words(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.select(["block", "train", "counts", "words", "tokens"]).to_pylist():
                words, tokens = unpack(row["words"], True), unpack(row["tokens"]).astype(np.int64)
                teach = np.repeat(np.array(row["train"], bool), row["counts"])
                n = np.bincount(tokens[teach], minlength=len(words))
                parts = cut((mix(words) % np.uint64(buckets)).astype(np.int64), buckets)
                yield from rows_of(ASK, [b for b, _ in parts], [row["block"]] * len(parts), [[pack(words[i], True), pack(n[i])] for _, i in parts]).to_batches()

    return run


def count_words(table: pa.Table) -> pa.Table:
    """Of a bucket: each block's words with their counts in training; stats: tokens, types, types of counts 1 to K + 1."""
    asked = [[unpack(p[0], True), unpack(p[1])] for p in table.column("payload").to_pylist()]
    known, number = np.unique(np.concatenate([w for w, _ in asked]), return_inverse=True)
    total = np.bincount(number, np.concatenate([n for _, n in asked]).astype(float), len(known)).astype(np.int64)
    blocks, bucket, at = table.column("block").to_pylist(), table.column("bucket")[0].as_py(), np.cumsum([0] + [len(w) for w, _ in asked])
    stats = [int(total.sum()), int((total > 0).sum()), *[int((total == r).sum()) for r in range(1, K + 2)]]
    hot = np.argsort(-total, kind="stable")[: HOT + 1]  # to be compared with all tokens later
    answers = [[pack(total[number[a:b]])] for a, b in zip(at[:-1], at[1:], strict=True)]
    return rows_of(ANSWER, [bucket] * (len(blocks) + 1), [*blocks, None], [*answers, [pack(known[hot]), pack(total[hot])]], [*[None] * len(blocks), stats])


class Pairs:
    """A block's distinct pairs: places of context and word among its words (context len(words): START)."""

    def __init__(self, row: dict, hot: np.ndarray, buckets: int) -> None:
        self.words, self.tokens = unpack(row["words"], True), unpack(row["tokens"]).astype(np.int64)
        self.counts, self.train = np.array(row["counts"], np.int64), np.array(row["train"], bool)
        self.first = np.concatenate([[0], np.cumsum(self.counts)[:-1]]).astype(np.int64)
        size = len(self.words)
        context = np.concatenate([[size], self.tokens[:-1]])
        context[self.first] = size
        pair, self.of = np.unique(self.tokens * (size + 1) + context, return_inverse=True)
        self.word, self.context = np.divmod(pair, size + 1)  # by word, then context
        self.hashes = np.append(self.words, START)
        spread = np.isin(self.hashes, hot)[self.context]
        key = mix(self.hashes[self.context]) ^ np.where(spread, mix(self.words[self.word] + np.uint64(7)), np.uint64(0))
        self.parts = cut((key % np.uint64(buckets)).astype(np.int64), buckets)
        self.word_parts = cut((mix(self.words) % np.uint64(buckets)).astype(np.int64), buckets)

    def own_counts(self, answers: dict[int, list[bytes]]) -> np.ndarray:
        out = np.zeros(len(self.words), np.int64)
        for b, i in self.word_parts:
            out[i] = unpack(answers[b][0]).astype(np.int64)
        return out


def ask_pairs(hot: np.ndarray, buckets: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        for row in left.select(["block", "train", "counts", "words", "tokens"]).to_pylist():
            x = Pairs(row, hot, buckets)
            own = x.own_counts(dict(zip(right.column("bucket").to_pylist(), right.column("payload").to_pylist(), strict=True)))
            n = np.bincount(x.of[np.repeat(x.train, x.counts)], minlength=len(x.word))
            for b, i in x.parts:
                contexts, place = np.unique(x.context[i], return_inverse=True)
                out[0].append(b)
                out[1].append(row["block"])
                out[2].append([pack(x.hashes[contexts], True), pack(place), pack(x.words[x.word[i]], True), pack(n[i]), pack(own[x.word[i]])])
        return rows_of(ASK, *out)

    return run


def count_pairs(hot: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        """Of a bucket: each block's pairs with their counts, and FIELDS of its contexts; stats: types of counts 1 to
        K + 1, and FIELDS of the hot contexts here."""
        asked = [[unpack(p[0], True), unpack(p[1]).astype(np.int64), unpack(p[2], True), unpack(p[3]), unpack(p[4])] for p in table.column("payload").to_pylist()]
        context = np.concatenate([a[0][a[1]] for a in asked])
        contexts, of = np.unique(context, return_inverse=True)
        word, own = np.concatenate([a[2] for a in asked]), np.concatenate([a[4] for a in asked]).astype(np.int64)
        _, first, number = np.unique(mix(context) * np.uint64(0x9E3779B97F4A7C15) + word, return_index=True, return_inverse=True)
        total = np.bincount(number, np.concatenate([a[3] for a in asked]).astype(float), len(first)).astype(np.int64)
        seen = total > 0
        at, c, w = of[first][seen], total[seen], own[first][seen]
        sums = lambda weights: np.bincount(at, weights, len(contexts)).astype(np.int64)
        fields = np.stack([sums(c), *[sums(c == r) for r in range(1, K + 1)], *[sums(w == r) for r in range(1, K + 1)], sums(w * (w > K))], 1)
        mine = np.zeros((len(hot), FIELDS), np.int64)
        place = np.searchsorted(hot, contexts)
        held = np.isin(contexts, hot)
        mine[place[held]] = fields[held]
        stats = [*[int((c == r).sum()) for r in range(1, K + 2)], *mine.ravel().tolist()]
        ends, answers = np.cumsum([0] + [len(a[1]) for a in asked]), []
        for a, (x, y) in zip(asked, zip(ends[:-1], ends[1:], strict=True), strict=True):
            answers.append([pack(total[number[x:y]]), pack(fields[np.searchsorted(contexts, a[0])].T.ravel())])
        blocks, bucket = table.column("block").to_pylist(), table.column("bucket")[0].as_py()
        return rows_of(ANSWER, [bucket] * (len(blocks) + 1), [*blocks, None], [*answers, None], [*[None] * len(blocks), stats])

    return run


def discounts(types: list[int]) -> np.ndarray:
    """Good-Turing's d_r for r from 0 to K (0: unused) from numbers of types with counts 1 to K + 1."""
    out = np.ones(K + 1)
    n = [0, *types]
    if n[1] and (rest := (K + 1) * n[K + 1] / n[1]) < 1:
        for r in range(1, K + 1):
            if n[r]:
                d = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest)
                out[r] = d if 0 < d < 1 else 1.0
    return out


class Model:
    """Discounts of both orders, tokens and types in training, FIELDS of the hot contexts (sorted by hash)."""

    def __init__(self, tokens: int, types: int, of_words: list[int], of_pairs: list[int], hot: np.ndarray, hot_fields: np.ndarray) -> None:
        self.n, self.v, self.one, self.two, self.hot, self.hot_fields = tokens, types, discounts(of_words), discounts(of_pairs), hot, hot_fields
        freed = float(((1 - self.one[1:]) * np.arange(1, K + 1) * of_words[:K]).sum())
        self.whole = tokens if freed > 0 else tokens + 1
        self.new = (freed if freed > 0 else 1.0) / self.whole

    def word(self, c: np.ndarray) -> np.ndarray:
        """Probabilities of words by their counts; 0: the event of a new word."""
        return np.where(c > 0, c * self.one[np.where(c <= K, c, 0)] / self.whole, self.new)

    def contexts(self, fields: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What pair counts are divided by, and backoff weights."""
        count, by_count, by_own, beyond = fields[:, 0], fields[:, 1 : K + 1], fields[:, K + 1 : 2 * K + 1], fields[:, -1]
        r = np.arange(1, K + 1)
        freed = by_count @ ((1 - self.two[1:]) * r)
        whole = np.where(freed > 0, count, count + 1)
        seen = (by_own @ (self.one[1:] * r) + beyond) / self.whole
        return whole, np.where(count > 0, np.where(freed > 0, freed, 1.0) / whole / np.maximum(1 - seen, self.new), 1.0)

    def pair(self, c: np.ndarray, whole: np.ndarray, weight: np.ndarray, word: np.ndarray) -> np.ndarray:
        return np.where(c > 0, c * self.two[np.where(c <= K, c, 0)] / np.maximum(whole, 1), weight * word)


def score_blocks(model: Model, schema: T.StructType, buckets: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted, out = to_arrow_schema(schema), []
        for i in range(left.num_rows):
            row = left.select(["train", "counts", "words", "tokens"]).slice(i, 1).to_pylist()[0]
            x = Pairs(row, model.hot, buckets)
            answers: dict[int, dict[int, list[bytes]]] = {1: {}, 2: {}}
            for b, p in zip(right.column("bucket").to_pylist(), right.column("payload").to_pylist(), strict=True):
                answers[len(p)][b] = p
            own = x.own_counts(answers[1])
            c, fields = np.zeros(len(x.word), np.int64), np.zeros((len(x.hashes), FIELDS), np.int64)
            for b, at in x.parts:
                c[at] = unpack(answers[2][b][0]).astype(np.int64)
                fields[np.unique(x.context[at])] = unpack(answers[2][b][1]).astype(np.int64).reshape(FIELDS, -1).T
            spread = np.isin(x.hashes, model.hot)
            fields[spread] = model.hot_fields[np.searchsorted(model.hot, x.hashes[spread])]
            whole, weight = model.contexts(fields)
            p = model.pair(c, whole[x.context], weight[x.context], model.word(own)[x.word])
            total = lambda by_token: np.add.reduceat(by_token, x.first)
            made = [x.counts, total((own > 0).astype(np.int64)[x.tokens]), total(np.log10((own + 1) / (model.n + model.v + 1))[x.tokens]), total(np.log10(p)[x.of])]
            kept = left.column("kept").combine_chunks().slice(i, 1).flatten()
            columns = [kept.field(j) for j in range(len(wanted) - len(made))] + [pa.array(m) for m in made]
            out.append(pa.Table.from_arrays([a.cast(f.type) for a, f in zip(columns, wanted, strict=True)], schema=wanted))
        return pa.concat_tables(out) if out else wanted.empty_table()

    return run


def summed(answers: DataFrame) -> list[int]:
    """Sums of the buckets' stats, place by place."""
    rows = answers.where("stats is not null").select(F.posexplode("stats").alias("place", "n")).groupBy("place").agg(F.sum("n").alias("n")).collect()
    return [n for _, n in sorted((r["place"], r["n"]) for r in rows)]


def score(docs: DataFrame, train: Column, *, keep: list[str] | None = None, text: str = "text", block_bytes: int = BLOCK_BYTES, buckets: int | None = None) -> DataFrame:
    """docs' columns `keep` (default: all) with n_tokens, n_known, train_tokens, base_score (add-one words) and score,
    in log10. train: which rows may teach."""
    spark = docs.sparkSession
    arrow_limits(spark)
    keep = others(docs.columns if keep is None else keep, ["n_tokens", "n_known", "train_tokens", "base_score", "score"])
    blocks = stored(blocks_of(docs, train, keep, text, block_bytes), "blocks")
    size = docs.select(F.sum(F.octet_length(col(text)))).first()[0] or 0
    if buckets is None:
        buckets = int(np.clip(-(-size // BUCKET_BYTES), *BUCKETS))
    # A task is some bucket, or some block, however large the corpus: their number, not their size, grows with it.
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_bucket = lambda df: df.repartition(max(least, buckets), "bucket").groupBy("bucket")
    by_block = lambda df: df.repartition(max(least, -(-size // block_bytes)), "block").groupBy("block")
    words = stored(by_bucket(blocks.mapInArrow(ask_words(buckets), ASK)).applyInArrow(count_words, ANSWER), "words")
    tokens, types, *of_words = summed(words) or [0] * (K + 3)

    @F.udf("array<struct<word:string,n:long>>")
    def most(payload):
        return [(str(w), int(n)) for w, n in zip(unpack(payload[0]), unpack(payload[1]), strict=True) if n * HOT > tokens]

    frequent = words.where("stats is not null").select(F.explode(most("payload")).alias("x")).select("x.word").collect()  # HOT at most
    hot = np.unique(np.array([int(r[0]) for r in frequent] + [int(START)], np.uint64))
    answers = words.where("block is not null").select("block", "bucket", "payload")
    asks = by_block(blocks).cogroup(by_block(answers)).applyInArrow(ask_pairs(hot, buckets), ASK)
    pairs = stored(by_bucket(asks).applyInArrow(count_pairs(hot), ANSWER), "pairs")
    stats = summed(pairs) or [0] * (K + 1 + len(hot) * FIELDS)
    model = Model(tokens, types, of_words, stats[: K + 1], hot, np.array(stats[K + 1 :], np.int64).reshape(len(hot), FIELDS))
    whole = answers.unionByName(pairs.where("block is not null").select("block", "bucket", "payload"))
    fields = [T.StructField(f"k_{i}", docs.schema[c].dataType) for i, c in enumerate(keep)] or [T.StructField("k_0", T.IntegerType())]
    schema = T.StructType([*fields, *T.StructType.fromDDL("n_tokens long, n_known long, base_score double, score double")])
    out = by_block(blocks).cogroup(by_block(whole)).applyInArrow(score_blocks(model, schema, buckets), schema)
    return out.select(*[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)], "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")

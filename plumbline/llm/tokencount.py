"""Token counts through a digest cache.

Each text is keyed by the digest of its content and of the tokenizer's version (the digest of its vocabulary file).
Keys are joined to the stored counts; only distinct keys without a count are encoded, and their counts appended to
the cache, a Parquet table in a folder the caller names, which may outlive the call, or else in the shared one. Missing keys are found from digests alone, and of a text's rows the one of the least mark (a hash of its other
columns) is encoded, where it lies: texts aren't shuffled while at most MAX_BROADCAST digests have to be sent to them.
Beyond that they meet the digests by a shuffled join. Rows equal in every column share a mark, and a task encodes them
once.

Normalising is the identity: byte-level vocabularies tell all texts apart. A null text counts as empty (0 tokens).
Special strings inside texts are handled as the library does by default. Runs of millions of spaces are encoded whole.
Repeated texts are encoded once; an empty table appends nothing; columns named like outputs are replaced, whatever
their case.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import arrow_limits, col, map_text, others, shared_dir, slices, stored

CACHE = "digest binary, n_tokens long"
#: Digests (some 50 bytes each) up to which they are broadcast: 10 MB.
MAX_BROADCAST = 200_000
#: Text bytes encoded at a time, as an encoding takes some hundred times its text.
ENCODE_BYTES = 1 << 18


def encoder(kind: str, content: bytes):
    """A function from a list of texts to their token counts, for a vocabulary file of one of two libraries."""
    if kind == "json":
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        model = Tokenizer.from_str(content.decode())
        model.no_truncation()
        model.no_padding()
        return lambda texts: [len(e) for e in model.encode_batch(texts, add_special_tokens=False)]
    if kind == "model":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=content)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    raise ValueError(f"no library for a .{kind} vocabulary")


def count_tokens(docs: DataFrame, vocabulary: str, *, cache_dir: str | None = None, keep: list[str] | None = None, text: str = "text", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """docs' columns `keep` (default: all) with n_bytes and n_tokens. vocabulary: a local path on the driver; its
    content (some MB) goes to the tasks. cache_dir: a folder with the counts known so far (default: one of this call's
    own in the shared folder, empty at first); grows by this call."""
    spark = docs.sparkSession
    arrow_limits(spark)
    keep = others(docs.columns if keep is None else keep, ["n_bytes", "n_tokens"])
    with open(vocabulary, "rb") as f:
        content = f.read()
    kind, version = vocabulary.rpartition(".")[2], hashlib.sha256(content).digest()
    cache_dir = cache_dir or f"{shared_dir(spark)}/token-counts"
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache_dir)  # so that the folder exists

    whole = F.coalesce(col(text), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(whole.cast("binary"), F.lit(bytearray(version))), 256)).alias("digest")
    keyed = docs.select(*[col(c).alias(f"k_{i}") for i, c in enumerate(keep)], digest, F.octet_length(whole).cast("long").alias("n_bytes"))
    known = spark.read.schema(CACHE).parquet(cache_dir)
    # A row's mark: which of the rows of a text is encoded doesn't depend on partitions or retries.
    plain = [col(f.name) for f in docs.schema if isinstance(f.dataType, (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.BooleanType)) and f.name != text]
    marked = docs.select(digest, F.xxhash64(F.lit(0), *plain).alias("mark"), whole.alias("text"))
    groups = marked.groupBy("digest").agg(F.min("mark").alias("least"), F.count("*").alias("n"))
    missing = stored(groups.join(known.select("digest").distinct(), "digest", "left_anti"), "missing")
    n_missing, n_known = missing.count(), known.limit(1).count()
    # Texts stay where they lie while one side's digests can be sent to them: the missing ones, or, where nothing is known,
    # those of texts with copies; the others are one row each. Beyond that, texts meet the digests by a shuffled join.
    if n_missing <= max_broadcast:
        misses = marked.join(F.broadcast(missing), "digest").where("mark = least")
    else:
        copied = missing.where("n > 1")
        if n_known == 0 and copied.count() <= max_broadcast:
            misses = marked.join(F.broadcast(copied), "digest", "left").where("least is null or mark = least")
        else:
            misses = marked.join(missing, "digest").where("mark = least")
    shared = spark.sparkContext.broadcast(content)

    def make():
        encode, seen = encoder(kind, shared.value), {}

        def work(data: np.ndarray, at: np.ndarray) -> dict[str, object]:
            raw, counts = data.tobytes(), []
            for a, b in slices(at, ENCODE_BYTES):
                texts = [raw[x:y] for x, y in zip(at[a:b], at[a + 1 : b + 1], strict=True)]
                # Rows equal in all columns have one mark: a task encodes a text once, as long as it is among its last ones.
                fresh = [t for t in dict.fromkeys(texts) if t not in seen]
                if sum(map(len, seen)) > ENCODE_BYTES:
                    seen.clear()
                    fresh = list(dict.fromkeys(texts))
                seen.update(zip(fresh, encode([t.decode() for t in fresh]) if fresh else [], strict=True))
                counts += [seen[t] for t in texts]
            return {"n_tokens": counts}

        return work

    if n_missing:
        map_text(misses, make, "n_tokens long", ["digest"]).write.mode("append").parquet(cache_dir)
    counts = spark.read.schema(CACHE).parquet(cache_dir)
    counts = stored(counts.join(groups.select("digest"), "digest", "left_semi").dropDuplicates(["digest"]), "counts")  # a digest may have been appended twice
    return keyed.join(counts, "digest", "left").select(*[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)], "n_bytes", "n_tokens")

import public_tokenizers
from tokenizers import Tokenizer

from plumbline.llm import queries as Q
from plumbline.llm import tokencount
from plumbline.llm.common import read

JSON = public_tokenizers.path("byte_bpe_50k.json")


def brute(rows):
    model = Tokenizer.from_file(JSON)
    return sorted((d, len((t or "").encode()), len(model.encode(t or "", add_special_tokens=False).ids)) for d, t in rows)


def lengths(texts):
    model = Tokenizer.from_file(JSON)
    return [len(model.encode(t or "", add_special_tokens=False).ids) for t in texts]


def counted(docs, **more):
    return sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in tokencount.count_tokens(docs, JSON, keep=["doc_id"], **more).collect())


def test_against_the_library(spark):
    sf = "/root/testdata/sf0.01"
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in Q.op10_token_counts(spark, sf).collect())
    assert got == brute([tuple(r) for r in read(spark, sf, "documents").select("doc_id", "text").collect()])


def test_odd_texts_and_special_strings(odd, make):
    assert counted(odd) == brute([tuple(r) for r in odd.select("doc_id", "text").collect()])
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext", "  x\n\n\n y\t\t", "I'll we've it's 123 4x   　z", "<|ENDOFTEXT|>", "!!!???" * 50]
    assert counted(make(texts)) == brute(list(enumerate(texts)))


def test_very_long_white_space(make):
    texts = [" " * 2_000_000, "\n" * 1_500_000, " x" + " " * 1_200_000 + "y"]
    assert counted(make(texts)) == brute(list(enumerate(texts)))


def test_cache_is_used_and_appended(spark, make, tmp_path):
    where = str(tmp_path / "cache")
    docs = make(["one two", "one two", "three"])
    first = counted(docs, cache_dir=where)
    assert spark.read.parquet(where).count() == 2
    assert counted(make(["three", "four", "four"]), cache_dir=where)[0][2] == first[2][2]
    assert spark.read.parquet(where).count() == 3
    assert counted(make(["five", "one two"]), cache_dir=where, max_broadcast=0)[1][2] == first[0][2]
    assert spark.read.parquet(where).count() == 4


def test_second_run_encodes_nothing(spark, sf, tmp_path):
    where = str(tmp_path / "cache")
    spark.conf.set("spark.plumbline.token.cache", where)
    try:
        first = sorted(map(tuple, Q.op10_token_counts(spark, sf).collect()))
        size = spark.read.parquet(where).count()
        assert sorted(map(tuple, Q.op10_token_counts(spark, sf).collect())) == first
        assert size == spark.read.parquet(where).count() == read(spark, sf, "documents").fillna("", ["text"]).select("text").distinct().count()
    finally:
        spark.conf.unset("spark.plumbline.token.cache")


def test_other_library_empty_and_clashing_names(spark, make):
    docs = make(["hello world", None])
    for name in ("piece_bpe_32k.model", "word_bpe_49k.json"):
        got = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(docs, public_tokenizers.path(name)).collect()}
        assert got[0] > 0 and got[1] == 0
    assert tokencount.count_tokens(make([]), JSON).count() == 0
    clash = spark.createDataFrame([(1, "a b", 7, "d")], "doc_id long, text string, N_Tokens int, digest string")
    row = tokencount.count_tokens(clash, JSON).collect()[0]
    assert row["n_tokens"] == 2 and row["digest"] == "d"


def test_texts_stay_where_they_lie_whatever_the_copies(spark, tmp_path):
    rows = [(i, "hot copy of a text") for i in range(300)] + [(7, "equal rows")] * 200 + [(i, f"text {i % 40}") for i in range(200)] + [(None, None)] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    want = sorted(((d, len((t or "").encode()), n) for (d, t), n in zip(rows, lengths([t for _, t in rows]), strict=True)), key=repr)
    for most, where in ((10, "a"), (1000, "b"), (0, "c")):  # copies by broadcast and by a join, and missing ones by broadcast
        got = sorted(map(tuple, tokencount.count_tokens(docs, JSON, keep=["doc_id"], cache_dir=str(tmp_path / where), max_broadcast=most).collect()), key=repr)
        assert got == want
        assert spark.read.parquet(str(tmp_path / where)).select("digest").distinct().count() == 43

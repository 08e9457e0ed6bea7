import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    def build(texts, schema=SCHEMA):
        rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)] if texts and not isinstance(texts[0], tuple) else texts
        return spark.createDataFrame(rows, schema)

    return build


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


#: Empty, blank, null, very long, repeated and odd texts that every operator must survive.
ODD = ["", None, " \t\n", "word", "word", "a" * 300_000, "lorem ipsum dolor " * 20_000, "é ß 漢字 😀", "\x00\x01 a b", "the cat sat on the mat"] + ["the cat sat on the mat"] * 5


@pytest.fixture(scope="session")
def odd(make):
    return make(ODD)

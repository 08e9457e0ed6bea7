import re

import duckdb
from pyspark.sql import functions as F

from plumbline.llm import licenses
from plumbline.llm import queries as Q

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text, templates=licenses.TEMPLATES):
    """Every template at every start, word by word."""
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, found = WORD.findall(text), []
    for t, template in enumerate(templates):
        form, keys = template[1].split(), licenses.key_places(template)
        for start in range(-len(form) + 1, len(words)):
            stands = [0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(form)]
            if sum(stands) >= licenses.needed(len(form)) and all(stands[i] for i in keys):
                found.append((template[0], t, start, len(form), sum(stands)))
    return len(words), sorted(found)


def scanned(df, **how):
    return sorted(((r.doc_id, r.n_words, sorted(tuple(f) for f in r.found)) for r in licenses.scan(df, keep=["doc_id"], **how).collect()), key=repr)


def expected(df, **how):
    return sorted(((r.doc_id, *brute(r.text, **how)) for r in df.select("doc_id", "text").collect()), key=repr)


NOTICES = {label: phrase for label, phrase, _ in licenses.NOTICES}


def mangled(phrase, every):
    return " ".join(w if (i + 1) % every else "other" for i, w in enumerate(phrase.split()))


TEXTS = [
    *NOTICES.values(),
    *[mangled(p, n) for p in NOTICES.values() for n in (4, 5, 6, 9)],
    *[" ".join(p.split()[:-2]) for p in NOTICES.values()],
    *[" ".join(p.split()[3:]) for p in NOTICES.values()],
    "MIT License MIT LICENSE mit-license, mit\nlicense; MITLicense MIT éLicense",
    "cc by cc by cc BY-NC 4.0 CC-BY-SA cc",
    "GNU General Public License, version 3. gnu general\x00public   license version 2",
    "general public license gnu", "mit", "license", "gnu gnu general public license",
    "K mit lİcense mİt license KMIT License MIT LICENſE",
    "mit license " * 3000,
]


def test_every_template_at_every_start(make, odd):
    assert scanned(odd) == expected(odd)
    docs = make(TEXTS + ["", None, "mit license", "mit license"])
    assert scanned(docs) == expected(docs)


def test_other_templates_and_a_corpus_that_turns_the_index_around(make):
    forms = [("x", "a b a b c", ["b c"]), ("y", "p q r s t u v w x y z", ["r s", "x"]), ("z", "a", ["a"])]
    texts = ["a b a b c", "a b a b a b c", "p q r s t u v w x y z", "p q r s t u k w x l z", "k q r s t u v w x l z", "p q s r t u v w x y z", "x p q r s"]
    for more in ([], ["a b " * 5] * 40, ["p q r s t u v w x y"] * 40 + ["z"]):  # other words are rare
        docs = make(texts + more)
        assert scanned(docs, templates=forms) == expected(docs, templates=forms)


def test_index_holds_one_word_more_than_a_template_may_miss():
    postings = licenses.index(licenses.TEMPLATES, 10, {"the": 9, "license": 8})
    for t, (_, phrase, _) in enumerate(licenses.TEMPLATES):
        n = len(phrase.split())
        assert sum(p[0] == t for ps in postings.values() for p in ps) == n - licenses.needed(n) + 1


def test_columns_of_the_digest(make):
    docs = make(["An MIT License, and CC BY; mit license", None])
    out = licenses.scan(docs, keep=["doc_id"])
    a, b = out.select("doc_id", *[c.alias(n) for n, c in licenses.digest(F.col("found")).items()]).orderBy("doc_id").collect()
    assert tuple(a) == (0, 3, 1, 6, "cc-by,mit", "cc-by,mit", 1.0)
    assert tuple(b) == (1, 0, None, None, "", "", 0.0)


def test_clashing_names_stay_apart(spark):
    docs = spark.createDataFrame([(1, "mit license", "old", 5)], "doc_id long, text string, found string, `a.b` int")
    row = licenses.scan(docs).first()
    assert row["a.b"] == 5 and row.n_words == 2 and row.found[0].label == "mit" and row.text == "mit license"
    assert licenses.scan(docs.limit(0)).count() == 0


def test_no_python_and_no_shuffle_on_the_main_path(spark, sf):
    plan = licenses.scan(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_query_against_sql_and_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = Q.op12_license_scan(spark, sf)
    cur = con.execute(Q.ORACLES["op12_license_scan"])
    assert [c[0] for c in cur.description] == df.columns
    assert sorted((tuple(r) for r in df.collect()), key=repr) == sorted(cur.fetchall(), key=repr)
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 10 = 0")
    assert scanned(docs) == expected(docs)

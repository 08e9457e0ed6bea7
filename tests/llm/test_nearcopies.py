import corpus_pipeline as P
import xxhash

from plumbline.llm import nearcopies
from plumbline.llm.common import read


def brute(rows):
    """Ids kept: the least of each component of pairs at 0.8 or more, all pairs compared."""
    rows = sorted(rows)
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({xxhash.xxh64_intdigest(b" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 9 * len(a & b) >= 4 * (len(a) + len(b)):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label] if old != new else label
    return {d for k, (d, _) in enumerate(rows) if label[k] == k}


def kept(spark, docs):
    return {r["doc_id"] for r in dict(P.STAGES)["near_duplicates"](spark, docs, None).collect()}


def test_stage_against_brute_force(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")  # README has the figures of sf0.1
    assert kept(spark, docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_stage_drops_edited_copies(spark, make):
    words = [f"word{i}" for i in range(200)]
    edited = [" ".join([*words[:k], "changed", *words[k + 1 :]]) for k in range(5, 195, 10)]
    chain = [" ".join(words[k : k + 150]) for k in range(0, 51, 10)]  # neighbours are alike, the ends aren't
    texts = [" ".join(words), *edited, "quite another text of a few words", *[c.replace("word", "w") for c in chain], " ".join(words).upper()]
    assert kept(spark, make(texts)) == {0, 20, 21} == brute(list(enumerate(texts)))


def test_odd_empty_and_repeated_ids(spark, odd, make):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert kept(spark, odd) == brute(rows)
    assert nearcopies.deduplicate(make([])).count() == 0
    same = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "c"), (3, "c"), (None, "c")], "doc_id long, text string")
    assert sorted((r["text"], r["doc_id"]) for r in nearcopies.deduplicate(same).collect()) == [("a b", None), ("c", 3)]


def test_repeated_and_equal_rows_are_settled_alike(spark):
    rows = [(2, "a b c d e f", "x"), (2, "a b c d e f", "y"), (1, " ", "x"), (1, None, "z"), (9, "a b c d e f", "y"), (5, "g", "q"), (5, "g", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Root string")
    kept = [sorted(map(tuple, nearcopies.deduplicate(d).collect()), key=str) for d in (docs, docs.repartition(5), docs.orderBy("Root"))]
    assert kept[0] == kept[1] == kept[2] and sorted(r[0] for r in kept[0]) == [1, 2, 5]


def test_groups_near_the_limit_against_brute_force(spark, make):
    """Many texts at about 0.8 of each other, over several tiles of both kinds."""
    import random

    rng, texts = random.Random(5), []
    for base in range(3):
        words = [f"w{base}_{i}" for i in range(60 + 40 * base)]
        for _ in range(25):
            edited = list(words)
            for k in rng.sample(range(len(words)), rng.randint(1, 3)):
                edited[k] = f"e{rng.randint(0, 10**6)}"
            texts.append(" ".join(edited))
    rows = list(enumerate(texts))
    docs = make(rows_of(texts))
    node = docs.selectExpr("doc_id as node", "text as t")
    found = {r["node"]: r["root"] for r in nearcopies.roots(node, tile=16, set_tile=8).collect()}
    assert {d for d, _ in rows if found.get(d, d) == d} == brute(rows)


def rows_of(texts):
    return [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]

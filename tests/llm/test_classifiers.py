import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import langid, quality, toxicity
from plumbline.llm import queries as Q
from plumbline.llm.common import read

SF = "/root/testdata/sf0.01"


def bucket(d, n):
    return zlib.crc32(str(d).encode()) % n


def held_out(spark, query, label, n, left, sf=SF):
    got = query(spark, sf).toPandas()
    docs = read(spark, sf, "documents").toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id)
    assert got.score.between(0, 1).all() and (got.held_out == [bucket(d, n) == left for d in got.doc_id]).all()
    known = got[got.held_out].merge(read(spark, sf, "labels").toPandas(), on="doc_id")
    pos, neg = known[known[label] == 1].score.to_numpy(), known[known[label] == 0].score.to_numpy()
    area = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    return area, (known.predicted == known[label]).mean()


def test_quality_on_held_out_rows(spark):
    area, right = held_out(spark, Q.op1_quality, "quality", 4, 2)
    assert area > 0.9 and right > 0.85, (area, right)


def test_toxicity_on_held_out_rows(spark):
    area, right = held_out(spark, Q.op4_toxicity, "toxic", 5, 0)
    assert area > 0.8 and right > 0.95, (area, right)  # six toxic rows are held out; one Spanish row is missed, as its stem isn't mined from so few rows


def test_toxicity_on_more_held_out_rows(spark):
    area, right = held_out(spark, Q.op4_toxicity, "toxic", 5, 0, "/root/testdata/sf0.1")
    assert area > 0.95 and right > 0.985, (area, right)


def text_rows(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])


def test_stems_are_those_of_two_different_words():
    texts = ["grimbo grimta xy", "grimbo grimbo", "", "ab cd", "réeuxa réeuxb Réeuxb"]
    data, at = text_rows(texts)
    places = []
    _, hashes, of = toxicity.Voters([], [])(data, at, places)
    rows, _ = toxicity.repeated_stems(*places, hashes, of)
    # "grim" in the first text; "réeux" has six bytes, and so three stems of at least four, in the last.
    assert rows.tolist() == [0, 4, 4, 4]


def test_stem_voters_need_different_words_and_a_share():
    word, = {int(h) for h in toxicity.stem_hashes(np.frombuffer(b"grim", np.uint8), np.array([0]), np.array([4]))[0][1]}
    data, at = text_rows(["grimbo grimta", "grimbo grimbo grimbo", "grimbo grimta grimma", "grimbo grimta " + "x " * 1000, "grim"])
    votes = toxicity.Voters([], [word])(data, at)[0]
    assert votes[:, toxicity.VOTERS.index("stems")].tolist() == [True, False, True, False, False]
    assert votes[:, toxicity.VOTERS.index("more_stems")].tolist() == [False, False, True, False, False]


def test_language_on_held_out_rows(spark):
    got = Q.op8_language_id(spark, SF).toPandas().merge(read(spark, SF, "documents").select("doc_id", "lang", "text").toPandas(), on="doc_id")
    letters = got[got.held_out & got.lang.notna() & got.text.fillna("").str.contains(r"[^\W\d_]")]
    assert (letters.lang_pred == letters.lang).mean() > 0.97


def test_odd_texts(spark, odd):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(15)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    for out in (quality.classify(odd, labels, F.lit(True)), toxicity.classify(odd, labels, F.lit(True)), langid.identify(odd, F.lit(True))):
        rows = out.toPandas()
        assert len(rows) == 15 and rows.score.between(0, 1).all()
        assert rows[rows.text == "the cat sat on the mat"].score.nunique() == 1
    und = langid.identify(odd, F.lit(True)).where("lang_pred = 'und'").select("doc_id").toPandas().doc_id
    assert {0, 1, 2} <= set(und)


def test_empty_tables_and_clashing_columns(spark, make):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for classify in (lambda d: quality.classify(d, labels, F.lit(True)), lambda d: toxicity.classify(d, labels, F.lit(True)), lambda d: langid.identify(d, F.lit(True))):
        assert classify(make([])).count() == 0
        clash = spark.createDataFrame([(1, "a b", "x", None)], "doc_id long, text string, Score string, lang string")
        row = classify(clash).collect()
        assert len(row) == 1 and 0 <= row[0]["score"] <= 1


@pytest.mark.parametrize("n", [1, 5])
def test_attention_weights_add_up(n):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(40 * n, quality.N_FEATURES)), np.arange(40) % 2
    bags = np.arange(0, 40 * n + 1, n)
    model = quality.Model(x + np.repeat(y, n)[:, None], bags, y.astype(float), epochs=5)
    score, weight = model.score(x + np.repeat(y, n)[:, None], bags)
    assert np.allclose(np.add.reduceat(weight, bags[:-1]), 1) and ((score > 0.5) == y).mean() > 0.9


def test_quality_gradients_by_differences():
    rng = np.random.default_rng(3)
    bags, y = np.array([0, 3, 4, 9]), np.array([1.0, 0.0, 1.0])
    x = rng.normal(size=(9, 11))
    model = quality.Model(x, bags, y, epochs=1)
    z = (x - model.mean) / model.scale
    loss = lambda: -np.mean(y * np.log(p := model._forward(z, bags)[5]) + (1 - y) * np.log(1 - p))
    for name, grad in model._gradients(z, bags, y).items():
        weights = model.w[name]
        for at in list(np.ndindex(weights.shape))[:: max(1, weights.size // 12)]:
            kept, h = weights[at], 1e-5
            weights[at] = kept + h
            up = loss()
            weights[at] = kept - h
            down = loss()
            weights[at] = kept
            assert abs((up - down) / (2 * h) - grad[at]) < 1e-6, (name, at)


def test_quality_forward_by_hand():
    rng = np.random.default_rng(4)
    bags, y, x = np.array([0, 2, 5]), np.array([1.0, 0.0]), rng.normal(size=(5, 6))
    model = quality.Model(x, bags, y, epochs=1)
    w, got = model.w, model.score(x, bags)
    z = (x - model.mean) / model.scale
    for d in range(2):
        rows = [np.tanh(r @ w["w"] + w["b"]) for r in z[bags[d] : bags[d + 1]]]
        raw = np.exp([float(np.sum(w["a"] * np.tanh(h @ w["v"]) / (1 + np.exp(-(h @ w["u"]))))) for h in rows])
        bag = sum(a * h for a, h in zip(raw / raw.sum(), rows, strict=True))
        assert abs(got[0][d] - 1 / (1 + np.exp(-(bag @ w["c"] + w["d"][0])))) < 1e-9


def test_long_texts_teach_by_passages_of_the_whole_text(spark):
    rows = spark.createDataFrame([(1, "good words here. " * 9000), (0, "1234 |||| ####\n" * 9000)] * 8, "y int, text string")
    model = quality.fit(rows)
    assert isinstance(model, quality.Model)


def direct_bits(rows, text, lang):
    """Code length of text by the definition: method C with exclusion, contexts that the language itself saw at least twice."""
    counts = {}
    for t, of in rows:
        raw = [0, 0, 0] + [b + 1 for b in t.encode()]
        for i in range(3, len(raw) if of == lang else 0):
            for size in range(4):
                here = counts.setdefault(tuple(raw[i - size : i]), {})
                here[raw[i]] = here.get(raw[i], 0) + 1
    counts = {c: v for c, v in counts.items() if not c or sum(v.values()) >= 2}

    def prob(context, symbol):
        here = counts.get(context, {})
        lower = (lambda s: prob(context[1:], s)) if context else (lambda s: 1 / 256)
        if not here:
            return lower(symbol)
        total, q = sum(here.values()), len(here)
        if q == 256:
            return here.get(symbol, 0) / total
        if symbol in here:
            return here[symbol] / (total + q)
        return q / (total + q) * lower(symbol) / (1 - sum(lower(s) for s in here))

    raw = [0, 0, 0] + [b + 1 for b in text.encode()]
    return -sum(np.log2(prob(tuple(raw[i - 3 : i]), raw[i])) for i in range(3, len(raw)))


def test_code_lengths_by_definition(spark):
    rows = [("the cat sat on the mat", "en"), ("the dog that sat", "en"), ("der hund und die katze", "de"), ("das ist der hut", "de"), ("ñandú y gato", "es")]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    texts = ["the hat", "der kater", "ñu", "zzz!", "cat the dog und das"]
    data, at = text_rows(texts)
    got = model.code_lengths(data, at) - model.prior
    for i, t in enumerate(texts):
        for j, lang in enumerate(model.langs):
            assert abs(got[i, j] - direct_bits(rows, t, lang)) < 1e-3 * max(1, got[i, j]), (t, lang)


def test_a_language_does_not_depend_on_the_number_of_others(spark):
    rows = [(f"{w} {w}{i} text of words {w}", f"l{i:02d}") for i, w in enumerate(["alpha", "bravo", "cedar"] * 20)]
    few, many = (langid.fit(spark.createDataFrame(r, "text string, lang string")) for r in ([x for x in rows if x[1] < "l02"], rows))
    data, at = text_rows(["alpha alpha0 text of words alpha", "bravo"])
    a, b = (m.code_lengths(data, at) - m.prior for m in (few, many))
    assert len(many.langs) == 60 and np.abs(a - b[:, :2]).max() < 1e-9


def test_passes_over_groups_of_languages_agree_with_one(spark):
    """Each group a pass of its own, or all in one: as by all code lengths at once, ties and empty texts too."""
    words = ["alpha", "bravo", "cedar", "delta", "eagle", "fjord", "gamma", "hotel", "india"]
    rows = [(f"{w} {w}{i}", f"l{i % 11:02d}") for i, w in enumerate(words * 11)] + [("", "l99"), (None, "l01"), ("12", None), ("same", None)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    one = sorted(map(tuple, langid.identify(docs, F.lit(True)).collect()), key=repr)
    each = sorted(map(tuple, langid.identify(docs, F.lit(True), pass_mb=0).collect()), key=repr)
    model = langid.fit(docs)
    assert len(model.passes(0)) == 3 and len(model.passes()) == 1 and "l99" not in model.langs
    for (text, _, pred, score), other in zip(one, each, strict=True):
        assert other[2] == pred and abs(other[3] - score) < 1e-12
        if pred != "und":
            bits = model.code_lengths(*text_rows([text]))[0]
            assert pred == model.langs[bits.argmin()] and abs(score - 1 / np.exp2(bits.min() - bits).sum()) < 1e-9


def test_a_long_text_leaves_its_language_a_sample(spark):
    rows = [("lone words " * 200000, "xx"), ("short text", "yy")] * 2
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"), max_mb=0.001)
    bits = model.code_lengths(*text_rows(["lone words lone words"])) - model.prior
    assert model.langs == ["xx", "yy"] and bits[0, 0] < bits[0, 1] / 4


def test_places_of_keys():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 1 << 40, 5000))
    asked = np.concatenate([keys, keys + 1, [0]])
    want = np.where(np.isin(asked, keys), np.searchsorted(keys, asked), -1)
    assert (langid.Places(keys).find(asked) == want).all() and (langid.Places(keys[:0]).find(asked) == -1).all()


def test_votes_keep_to_their_rows(spark):
    texts = ["what s*t", "apple pie", "end f*", "ck start", "you", "idiot", "A B", "you idiot", ""]
    alone = [toxicity.Voters([], [])(*text_rows([t]))[0][0].tolist() for t in texts]
    for order in (range(9), reversed(range(9)), [2, 3, 0, 1, 4, 5, 8, 6, 7]):
        order = list(order)
        votes = toxicity.Voters([], [])(*text_rows([texts[i] for i in order]))[0]
        assert [v.tolist() for v in votes] == [alone[i] for i in order]
    assert alone[0][toxicity.VOTERS.index("masked")] and not alone[2][toxicity.VOTERS.index("masked")]


def test_scores_do_not_depend_on_order_or_partitions(spark):
    docs, labels = read(spark, "/root/testdata/sf0.001", "documents"), read(spark, "/root/testdata/sf0.001", "labels")
    score = lambda d: {r["doc_id"]: r["score"] for r in toxicity.classify(d, labels, F.lit(True), keep=["doc_id"]).collect()}
    one = score(docs.coalesce(1).orderBy("text"))
    assert score(docs.repartition(7).sortWithinPartitions(F.desc("n_chars"))) == one


def test_label_model_by_brute_force():
    """Posteriors by Bayes' rule from the model's own tables, and accuracies near those that made the votes."""
    rng = np.random.default_rng(9)
    truth = rng.random(20000) < 0.3
    rates = np.array([[0.05, 0.1, 0.02, 0.2], [0.7, 0.6, 0.5, 0.8]])
    votes = rng.random((20000, 4)) < rates[truth.astype(int)]
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = toxicity.LabelModel(patterns, counts, 0.2, np.array([[0.1] * 4, [0.5] * 4]))
    assert np.abs(model.accuracy[1] - rates[1]).max() < 0.05 and np.abs(model.accuracy[0] - (1 - rates[0])).max() < 0.05
    for v, q in zip(patterns.astype(int), model.posterior(patterns), strict=True):
        like = []
        for k, share in ((0, 1 - model.share), (1, model.share)):
            for i in range(4):
                r = model.table[k, i, v[model.parent[i]] if model.parent[i] >= 0 else 0]
                share *= r if v[i] else 1 - r
            like.append(share)
        assert abs(like[1] / sum(like) - q) < 1e-12

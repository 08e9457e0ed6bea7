"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Voters look at each text's words: fixed lexicons by theme and language, two lexicons mined from labelled training
rows, stems mined from them (word starts of 4 to 8 bytes that several different words of a toxic text share), and
patterns (an insult soon after "you", several insults by word or stem, masked profanity, shouting). A stem alone says little, as clean
texts have such words by chance, so its voters ask for several different words that make up a share of the text.
Votes over all documents are counted by vote pattern. A generative model of a hidden class and the votes is fitted to
these counts by expectation maximisation: it has each voter's rates in both classes (its accuracy), which come from how
voters agree, and, along the strongest edges of a tree over voters, their correlations within a class. Labels mine the
lexicons and stems and say where the fit starts, which names the classes; they don't enter it. Its posteriors label a
sample of documents (at most MAX_DOCS, of any length, drawn by a hash of id and text, held-out rows left out), from
which a logistic model over chosen words and votes learns. That model scores every whole text.

Words and stems of the samples are counted by Spark. To the driver come vote patterns, 16 min-hashes of each labelled
row, the words chosen, and which of these each row of the sample has: all bounded by MAX_DOCS, whatever the texts.

Defined results: null and empty texts have no votes and get the score of such texts; without labelled training rows
the mined lexicons and stems are empty and the class share starts at 0.1; repeated rows get equal scores; columns named like
outputs are replaced.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_limits, col, draw, labelled_sample, map_text, mix, others, powers, run_hashes, runs, stored

MAX_DOCS = 10_000
SIGNS = 16
MINED = 256
STEM_BYTES = range(4, 9)
CHOSEN = 512

# Lexicons, by theme or language.
LEXICONS = {
    "wits": "idiot idiots moron morons stupid dumb dumbass imbecile fool foolish brainless dimwit halfwit retard retarded ignoramus",
    "worth": "worthless loser losers pathetic useless pitiful failure nobody wretch wretched incompetent",
    "disgust": "trash scum disgusting garbage filth filthy vermin vile repulsive revolting parasite parasites maggot cockroach pig swine",
    "mockery": "clown clowns joke freak freaks creep weirdo coward cowards liar liars hypocrite crybaby",
    "profanity": "fuck fucking fucker fucked shit shitty bullshit bitch bitches bastard bastards asshole assholes dick cunt crap damn whore slut",
    "spanish": "idiota imbécil estúpido estúpida basura asqueroso asquerosa perdedor perdedora inútil patético patética mierda cabrón puta payaso escoria",
    "french": "crétin crétine abruti abrutie ordure connard connarde salaud salope merde minable dégoûtant dégoûtante débile imbécile raclure",
    "german": "idioten dummkopf trottel abschaum widerlich erbärmlich versager arschloch scheiße scheisse hurensohn wertlos müll ekelhaft schwachkopf",
}
YOU = "you your youre you're ur u"
MASKED = re.compile(rb"(?<![a-z])(?:f[*@#]+ck?|s[*@#!]+t|b[*@#!]+tch|a[*@#$]+hole|c[*@#]+nt|d[*@#!]+ck)(?![a-z])")
VOTERS = [*LEXICONS, "mined_even", "mined_odd", "after_you", "several", "masked", "shouting", "stems", "more_stems"]

WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x41:0x5B] = WORD[0x61:0x7B] = WORD[0x80:] = WORD[0x27] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32
BITS = 1 << 20


def word_hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(run_hashes(raw, np.array([0]), np.array([len(raw)]), np.ones(len(raw), bool))[0])


def stem_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length of STEM_BYTES, the words at least that long and hashes of their starts."""
    out, power = [], powers(0x9E3779B97F4A7C15, max(STEM_BYTES))
    word, total = np.arange(len(starts)), np.zeros(len(starts), np.uint64)
    for k in range(max(STEM_BYTES)):
        long = ends[word] - starts[word] > k
        word, total = word[long], total[long]
        total = total + (low[starts[word] + k].astype(np.uint64) + np.uint64(1)) * power[k]
        if k + 1 in STEM_BYTES:
            out.append((word, mix(total ^ np.uint64(k + 1))))
    return out


class Words:
    """A set of word hashes to look up, each with a number."""

    def __init__(self, hashes: list[int]) -> None:
        self.sorted = np.unique(np.array(hashes, np.uint64))
        self.bits = np.zeros(BITS, bool)
        self.bits[(self.sorted & np.uint64(BITS - 1)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where hashes are of the set, and their numbers there."""
        maybe = np.flatnonzero(self.bits[(hashes & np.uint64(BITS - 1)).astype(np.int64)])
        number = np.minimum(np.searchsorted(self.sorted, hashes[maybe]), max(0, len(self.sorted) - 1))
        hit = self.sorted[number] == hashes[maybe] if len(self.sorted) else np.zeros(0, bool)
        return maybe[hit], number[hit]


def pairs(of: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, in order of both."""
    order = np.lexsort((hashes, of))
    of, hashes = of[order], hashes[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])
    return of[new], hashes[new]


class Voters:
    """Votes of a slice of texts: a boolean matrix of texts by VOTERS."""

    def __init__(self, mined: list[int], stems: list[int]) -> None:
        groups = {name: [word_hash(w) for w in words.split()] for name, words in LEXICONS.items()}
        groups["mined_even"], groups["mined_odd"] = sorted(mined)[::2], sorted(mined)[1::2]
        self.words = Words([h for g in groups.values() for h in g])
        self.member = np.zeros((len(self.words.sorted), len(groups)), bool)
        for i, g in enumerate(groups.values()):
            self.member[np.isin(self.words.sorted, np.array(g, np.uint64)), i] = True
        self.you = np.array([word_hash(w) for w in YOU.split()], np.uint64)
        self.stems = Words(stems)

    def stemmed(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which words start with a mined stem."""
        found = np.zeros(len(starts), bool)
        if len(self.stems.sorted):
            for word, hashes in stem_hashes(low, starts, ends):
                found[word[self.stems.find(hashes)[0]]] = True
        return np.flatnonzero(found)

    def __call__(self, data: np.ndarray, at: np.ndarray, places: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Votes; and the hash and the text of every word. To `places`, if given, go the words' bytes, starts and ends."""
        n = len(at) - 1
        low = FOLD[data]
        starts, ends, first, marks = runs(low, at, WORD)
        if places is not None:
            places += [low, starts, ends]
        hashes, count = run_hashes(low, starts, ends, marks), np.diff(first)
        of = np.repeat(np.arange(n), count)
        votes = np.zeros((n, len(VOTERS)), bool)
        hit, number = self.words.find(hashes)
        groups = self.member.shape[1]
        for i in range(groups):
            votes[of[hit[self.member[number, i]]], i] = True
        for back in range(1, 5):
            prior = hit[hit >= back]
            prior = prior[of[prior] == of[prior - back]]
            votes[of[prior[np.isin(hashes[prior - back], self.you)]], groups] = True
        votes[:, groups + 1] = np.bincount(of[hit], minlength=n) >= 2
        raw = low.tobytes()
        votes[:, groups + 2] = [MASKED.search(raw[a:b]) is not None for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        sums = np.concatenate([[0], np.cumsum((data >= 0x41) & (data <= 0x5A))])
        upper, letters = np.diff(sums[at]), np.diff(np.concatenate([[0], np.cumsum(WORD[data])])[at])
        votes[:, groups + 3] = upper > 0.5 * np.maximum(letters, 1)
        held = self.stemmed(low, starts, ends)
        share = np.bincount(of[held], minlength=n) / np.maximum(count, 1)
        different = np.bincount(pairs(of[held], hashes[held])[0], minlength=n)
        votes[:, groups + 4] = (different >= 2) & (share >= 0.005)
        votes[:, groups + 1] |= votes[:, groups + 4]  # insults by word or by stem: else each kind's absence speaks against the other
        votes[:, groups + 5] = (different >= 3) & (share >= 0.01)
        return votes, hashes, of


class LabelModel:
    """P(class | votes) from counts of vote patterns."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, share: float, rates: np.ndarray, rounds: int = 60) -> None:
        """patterns: bool (patterns, voters); share and rates (2, voters): where to start, which names the classes."""
        n, v, m = counts.astype(float), patterns.astype(int), patterns.shape[1]
        self.parent = np.full(m, -1)
        q = self._posterior_independent(v, share, rates)
        for step in range(rounds):
            if step in (10, 30):
                self.parent = self._tree(v, n, q)
            self._fit(v, n, q)
            q = self.posterior(patterns)
        self.accuracy = np.array([[(n * w * (v[:, i] == k)).sum() / max(1e-9, (n * w).sum()) for i in range(m)] for k, w in ((0, 1 - q), (1, q))])
        self.correlation = self._correlations(v, n, q)

    @staticmethod
    def _posterior_independent(v: np.ndarray, share: float, rates: np.ndarray) -> np.ndarray:
        log = [np.log(p) + (v * np.log(r) + (1 - v) * np.log(1 - r)).sum(1) for p, r in ((1 - share, rates[0]), (share, rates[1]))]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))

    def _fit(self, v: np.ndarray, n: np.ndarray, q: np.ndarray) -> None:
        m = v.shape[1]
        total = n.sum()
        self.share = ((n * q).sum() + 0.1) / (total + 1)
        self.table = np.zeros((2, m, 2))  # P(vote | class, parent's vote)
        for k, w in ((0, n * (1 - q)), (1, n * q)):
            for i in range(m):
                p = v[:, self.parent[i]] if self.parent[i] >= 0 else np.zeros(len(v), int)
                overall = ((w * v[:, i]).sum() + 0.05) / (w.sum() + 1)
                for held in (0, 1):
                    here = w * (p == held)
                    self.table[k, i, held] = ((here * v[:, i]).sum() + overall) / (here.sum() + 1)
        self.table = np.clip(self.table, 1e-6, 1 - 1e-6)
        self.table[1] = np.maximum(self.table[1], self.table[0])  # a vote never speaks for the clean class

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        v = patterns.astype(int)
        held = np.where(self.parent >= 0, v[:, np.maximum(self.parent, 0)], 0)
        log = []
        for k, p in ((0, 1 - self.share), (1, self.share)):
            r = self.table[k, np.arange(v.shape[1]), held]
            log.append(np.log(p) + np.where(v == 1, np.log(r), np.log(1 - r)).sum(1))
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))

    @staticmethod
    def _correlations(v: np.ndarray, n: np.ndarray, q: np.ndarray) -> np.ndarray:
        out = []
        for w in (n * (1 - q), n * q):
            mean = (w[:, None] * v).sum(0) / max(1e-9, w.sum())
            away = v - mean
            cov = (w[:, None] * away).T @ away / max(1e-9, w.sum())
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            out.append(cov / sd / sd[:, None])
        return np.array(out)

    def _tree(self, v: np.ndarray, n: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Parents along the largest spanning tree by correlation within classes; weak edges are left out."""
        strength = np.abs(self._correlations(v, n, q)).max(0)
        m = len(strength)
        parent, reached = np.full(m, -1), {0}
        while len(reached) < m:
            i, j = max(((i, j) for i in reached for j in range(m) if j not in reached), key=lambda e: (strength[e], -e[0], -e[1]))
            reached.add(j)
            parent[j] = i if strength[i, j] > 0.1 else -1
        return parent


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.3, rounds: int = 400) -> np.ndarray:
    """Weights, the intercept last, of a logistic model with soft labels y, by Nesterov's gradient steps. The last
    column of x is all ones."""
    w, z, big = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.ones(x.shape[1])
    penalty = np.full(x.shape[1], l2)
    penalty[-1] = 0
    for _ in range(30):  # the largest eigenvalue of x'x
        big = x.T @ (x @ (big / np.linalg.norm(big)))
    size = 1.1 * np.linalg.norm(big) / 4 + l2
    for k in range(rounds):
        grad = x.T @ (1 / (1 + np.exp(-(x @ z))) - y) + penalty * z
        new = z - grad / size
        z = new + k / (k + 3) * (new - w)
        w = new
    return w


class Classifier:
    """Votes and chosen words to a score."""

    def __init__(self, voters: Voters, words: list[int], weights: np.ndarray) -> None:
        self.voters, self.words, self.weights = voters, Words(words), weights

    def features(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Votes, and (text, word number) of the chosen words in each text."""
        votes, hashes, of = self.voters(data, at)
        hit, number = self.words.find(hashes)
        held = np.unique(of[hit] * max(1, len(self.words.sorted)) + number)
        return votes, held // max(1, len(self.words.sorted)), held % max(1, len(self.words.sorted))

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        votes, of, number = self.features(data, at)
        m = votes.shape[1]
        return 1 / (1 + np.exp(-(votes @ self.weights[:m] + self.weights[-1] + np.bincount(of, self.weights[m:-1][number], len(votes)))))


def vote(docs: DataFrame, voters, *, keep: list[str], text: str = "text") -> DataFrame:
    """docs' columns `keep` with votes, a number whose bits are the votes of VOTERS."""

    def make():
        known = voters.value

        def work(data: np.ndarray, at: np.ndarray) -> dict[str, object]:
            return {"votes": known(data, at)[0] @ (1 << np.arange(len(VOTERS)))}

        return work

    return map_text(docs, make, "votes int", keep, text)


def by_text(of: np.ndarray, hashes: np.ndarray, n: int) -> list[np.ndarray]:
    cut = np.searchsorted(of, np.arange(n))
    return [hashes[a:b].view(np.int64) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def repeated_stems(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, stem) where at least two different words of the text start with the stem."""
    order = np.lexsort((hashes, of))
    new = np.ones(len(order), bool)
    new[1:] = (of[order][1:] != of[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    own = order[new]
    found = [(of[own][word], stem) for word, stem in stem_hashes(low, starts[own], ends[own])]
    text, stem = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((stem, text))
    text, stem = text[order], stem[order]
    again = np.zeros(len(text), bool)
    again[1:] = (text[1:] == text[:-1]) & (stem[1:] == stem[:-1])
    return pairs(text[again], stem[again])


def word_sets(rows: DataFrame, voters, keep: list[str]) -> DataFrame:
    """Kept columns, votes, min-hashes of the words, the distinct word hashes of each text, and the stems that at least
    two different words of it have."""

    def make():
        known = voters.value

        def work(data: np.ndarray, at: np.ndarray) -> dict[str, object]:
            places: list = []
            votes, hashes, of = known(data, at, places)
            words = by_text(*pairs(of, hashes), len(at))
            signs = [[int(mix(w.view(np.uint64) ^ np.uint64(k + 1)).min().view(np.int64)) for k in range(SIGNS)] if len(w) else [] for w in words]
            return {"votes": votes @ (1 << np.arange(len(VOTERS))), "signs": signs, "words": words, "stems": by_text(*repeated_stems(*places, hashes, of), len(at))}

        return work

    return map_text(rows, make, "votes int, signs array<long>, words array<long>, stems array<long>", keep)


def without_copies(rows: pd.DataFrame) -> list[int]:
    """Numbers (column row) of the rows (y, signs) that aren't later near copies, whose shared words would all look like
    insults if the first is toxic: copies agree with one earlier row of the label in half the min-hashes."""
    first: dict[tuple, int] = {}
    keep = []
    for i, (row, y, signs) in enumerate(zip(rows.row, rows.y, rows.signs, strict=True)):
        marks = [(y, k, int(s)) for k, s in enumerate(signs)]
        agree = Counter(first[m] for m in marks if m in first)
        if not agree or max(agree.values()) < SIGNS / 2:
            keep.append(int(row))
        for m in marks:
            first.setdefault(m, i)
    return keep


def surprise(share: float) -> Column:
    """Log likelihood that the documents of two classes (columns bad, good) gain over the classes' shares."""
    part = lambda c, p: F.when(F.col(c) > 0, F.col(c) * F.ln(F.col(c) / ((F.col("bad") + F.col("good")) * p))).otherwise(0.0)
    return F.round(part("bad", share) + part("good", 1 - share), 9)


def bits(votes: np.ndarray | pd.Series) -> np.ndarray:
    return (np.asarray(votes, np.int64)[:, None] >> np.arange(len(VOTERS)) & 1).astype(bool)


def document_counts(rows: DataFrame, sets: str, weight: str) -> DataFrame:
    """(w, bad, good): of each word or stem, its documents by weight and by the rest of 1."""
    each = rows.select(F.col(weight).cast("double").alias("y"), F.explode(sets).alias("w"))
    return stored(each.groupBy("w").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good")), "counts")


def telling(rows: DataFrame, sets: str, share: float, ratio: float, margin: float, but: list[int], most: int = MINED) -> list[int]:
    """The `most` words or stems that toxic rows have and clean rows rarely do, beyond chance over as many as three rows have."""
    counts = document_counts(rows, sets, "y")
    least = float(np.log(max(2, counts.where("bad + good >= 3").count())) + margin)
    sure = counts.withColumn("gain", surprise(share)).where((F.col("bad") > ratio * F.col("good")) & (F.col("gain") > least) & ~F.col("w").isin(but))
    return [r["w"] & (1 << 64) - 1 for r in sure.orderBy(F.desc("gain"), "w").limit(most).collect()]


def mine(known: DataFrame, plain: Voters) -> tuple[list[int], list[int], float]:
    """The most telling words outside the lexicons, the most telling stems, and the toxic share, of rows of word_sets().
    To the driver come a row's label and min-hashes (at most max_docs rows), and the words chosen."""
    seen = known.select("row", "y", "signs").toPandas()
    seen = seen.assign(key=[tuple(s) for s in seen.signs]).sort_values(["y", "key", "row"], ignore_index=True)  # whatever the partitions
    rows = known.join(F.broadcast(known.sparkSession.createDataFrame([(r,) for r in without_copies(seen)], "row long")), "row")
    share = float(np.clip(seen.y.mean(), 0.01, 0.5)) if len(seen) else 0.1
    words = [int(h) for h in plain.words.sorted.view(np.int64)]
    return telling(rows, "words", share, 20, 4, words), telling(rows, "stems", share, 4, 2, []), share


def rates_of(known: DataFrame, voters) -> np.ndarray:
    """(2, voters): how often each votes for clean and for toxic rows of the labelled sample, from which the label
    model starts; beside each class's rows stand ten that vote by guess (0.01 clean, 0.3 toxic)."""
    seen = vote(known, voters, keep=["y"]).groupBy("y", "votes").count().toPandas()
    v, n, y = bits(seen.votes), seen["count"].to_numpy(float), seen.y.to_numpy(int)
    return np.array([((n * (y == k)) @ v + 10 * guess) / ((n * (y == k)).sum() + 10) for k, guess in ((0, 0.01), (1, 0.3))])


def fit(docs: DataFrame, labels: DataFrame, train: Column, *, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", max_docs: int = MAX_DOCS) -> tuple[Classifier, LabelModel]:
    spark = docs.sparkSession
    whole = F.coalesce(col(text), F.lit("")).alias("text")
    known = labelled_sample(docs, labels, train, label=label, doc_id=doc_id, text=text, max_docs=max_docs)
    known = stored(known, "labelled")
    plain = spark.sparkContext.broadcast(Voters([], []))
    sets = stored(word_sets(known.withColumn("row", F.monotonically_increasing_id()), plain, ["row", "y"]), "sets")
    mined, stems, share = mine(sets, plain.value)
    voters = Voters(mined, stems)
    shared = spark.sparkContext.broadcast(voters)

    # All documents' vote patterns: at most 2 ** voters rows, whatever the number of documents.
    patterns = vote(docs.select(whole), shared, keep=[]).groupBy("votes").count().toPandas().sort_values("votes", ignore_index=True)
    if patterns.empty:
        patterns = pd.DataFrame({"votes": [0], "count": [1]})
    model = LabelModel(bits(patterns.votes), patterns["count"].to_numpy(), share, rates_of(known, shared))

    texts = docs.where(train).select(col(doc_id).alias("id"), whole)
    n = texts.count()
    texts = (texts.where(draw(F.col("id"), F.col("text")) < 0.95 * max_docs / n).limit(max_docs) if n > max_docs else texts).select("text")
    belief = {int(k): float(q) for k, q in zip(patterns.votes, model.posterior(bits(patterns.votes)), strict=True)}
    beliefs = spark.createDataFrame(list(belief.items()), "votes int, q double")
    sample = stored(word_sets(texts, shared, []).join(F.broadcast(beliefs), "votes").select("votes", "q", "words"), "sample")
    mean = sample.agg(F.avg("q")).first()[0] or 0.0
    counts = document_counts(sample, "words", "q")
    least = float(np.log(max(2, counts.count())) + 2)
    sure = counts.withColumn("gain", surprise(float(np.clip(mean, 1e-6, 1 - 1e-6)))).where(F.col("gain") > least)
    chosen = np.array(sorted(r["w"] for r in sure.orderBy(F.desc("gain"), "w").limit(CHOSEN).collect()), np.int64)
    held = F.filter("words", lambda w: w.isin([int(c) for c in chosen])) if len(chosen) else F.array().cast("array<bigint>")
    rows = sample.select("votes", "q", F.sort_array(held).alias("held")).toPandas()
    rows = rows.assign(key=[tuple(h) for h in rows.held]).sort_values(["votes", "key"], ignore_index=True)  # whatever the partitions
    x = np.zeros((max(1, len(rows)), len(VOTERS) + len(chosen) + 1), np.float32)
    x[:, -1] = 1
    if len(rows):
        x[:, : len(VOTERS)] = bits(rows.votes)
        x[np.repeat(np.arange(len(rows)), rows.held.map(len)), len(VOTERS) + np.searchsorted(chosen, np.concatenate(rows.held.to_list()).astype(np.int64))] = 1
    # Words.find() numbers by unsigned hashes.
    order = np.argsort(chosen.view(np.uint64))
    x[:, len(VOTERS) : -1] = x[:, len(VOTERS) + order]
    weights = logistic(x, rows.q.to_numpy(float) if len(rows) else model.posterior(np.zeros((1, len(VOTERS)), bool)))
    return Classifier(voters, [int(h) for h in chosen.view(np.uint64)], weights), model


def score(docs: DataFrame, model: Classifier, *, keep: list[str] | None = None, text: str = "text", out: str = "score") -> DataFrame:
    """docs' columns `keep` (default: all) with the score, named `out`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = others(docs.columns if keep is None else keep, [out])
    return map_text(docs, lambda: lambda data, at: {out: shared.value.score(data, at)}, f"{out} double", keep, text)


def classify(docs: DataFrame, labels: DataFrame, train: Column, *, label: str = "toxic", doc_id: str = "doc_id", label_id: str = "doc_id", keep: list[str] | None = None, text: str = "text", out: str = "score", **bounds) -> DataFrame:
    """score() of docs by a model fitted to them. train: which documents may teach."""
    arrow_limits(docs.sparkSession)
    labels = labels.select(col(label_id).alias(doc_id), col(label).alias("y"))
    return score(docs, fit(docs, labels, train, label="y", doc_id=doc_id, text=text, **bounds)[0], keep=keep, text=text, out=out)

"""Licence scans: notices found word for word or nearly so, by a positional index of their rarest words.

A template is a notice: its label, its words, the key phrases that it can't do without, and how many of its words have
to stand at their places. Words of templates are weighed by IDF over the documents (one count per document and
licence word). Only the rarest words of a template are indexed: as many as it may miss and one more, so that each
place where the template stands holds at least one of them. A file's words are looked up in that index; each posting
(template, place in it) of a word at some position proposes a start; proposals of one template and start meet there.
At each start the template's words are compared place by place, and it is found where enough of them agree and all of
its key phrases stand whole. IDF decides what is looked up, never what is found.

Everything is expressions on one row at a time: no document is shuffled, copied or capped. The templates and their
index are literals of the plan (some hundred words); what comes to the driver is one count per licence word.

Words: A-Z in lower case, then maximal runs without [\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]; letters beyond ASCII belong to words
and never equal a template's. Defined results: a null or empty text has no words and no notice; a notice that the
text's end cuts off counts if enough of its words and all key phrases are there; overlapping notices all count; rows
that repeat are each judged; extra columns stay as they are, except those named as outputs, which are replaced; an
empty table gives an empty result.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import col, others

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Templates of this many words or more may miss a fifth of them; shorter ones none.
LONG = 10
SHARE = 0.8

# Phrases and labels that the scan has to count.
BASE = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]
# Public notices, their labels and key phrases.
NOTICES = [
    ("agpl", "gnu affero general public license", ["gnu affero general public license"]),
    ("apache-2.0", "apache license version 2 0", ["apache license version 2 0"]),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ["except in compliance with the license"]),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ["as is basis", "warranties or conditions of any kind"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["endorse or promote products derived from this software"]),
    ("cc-by-4.0", "cc by 4 0", ["cc by 4 0"]),
    ("cc-by-4.0", "creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("cc-by-nc", "cc by nc", ["cc by nc"]),
    ("cc-by-nc", "creative commons attribution noncommercial", ["creative commons attribution noncommercial"]),
    ("cc-by-nd", "cc by nd", ["cc by nd"]),
    ("cc-by-sa", "cc by sa", ["cc by sa"]),
    ("cc-by-sa", "creative commons attribution sharealike", ["creative commons attribution sharealike"]),
    ("cc0", "cc0 1 0 universal", ["cc0 1 0"]),
    ("epl", "eclipse public license", ["eclipse public license"]),
    ("gpl-2.0", "gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-3.0", "gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["redistribute it and or modify it", "free software foundation"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["with or without fee is hereby granted"]),
    ("lgpl", "gnu lesser general public license", ["gnu lesser general public license"]),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge", "without restriction"]),
    ("mpl", "mozilla public license", ["mozilla public license"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license v 2 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software", "public domain"]),
]
Template = tuple[str, str, list[str]]
TEMPLATES: list[Template] = [(label, phrase, [phrase]) for label, phrase in BASE] + NOTICES


def needed(n: int) -> int:
    """How many of a template's n words have to stand at their places."""
    return math.ceil(SHARE * n) if n >= LONG else n


def key_places(template: Template) -> list[int]:
    """The places within a template that its key phrases fill, at each phrase's first occurrence."""
    words, out = template[1].split(), set()
    for phrase in template[2]:
        key = phrase.split()
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        out |= set(range(at, at + len(key)))
    return sorted(out)


def lowered(text: Column) -> Column:
    """A-Z in lower case. lower() changes other letters too, which no comparison sees: only the Kelvin sign would become
    a letter of ASCII, and is set aside before."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lowered(text), SEPARATORS), "")


def frequencies(docs: DataFrame, templates: list[Template], text: str = "text") -> tuple[int, dict[str, int]]:
    """The number of documents, and of those that hold each licence word."""
    vocabulary = sorted({w for t in templates for w in t[1].split()})
    held = F.array_distinct(F.filter(words_of(col(text)), lambda w: w.isin(vocabulary)))
    # The empty word stands for the document itself, so that one pass counts both.
    counts = docs.select(F.explode(F.array_append(held, F.lit(""))).alias("word")).groupBy("word").count()
    found = {r["word"]: r["count"] for r in counts.collect()}
    return found.pop("", 0), found


def index(templates: list[Template], n: int, frequency: dict[str, int]) -> dict[str, list[tuple[int, int]]]:
    """Postings (template, place) of each template's rarest words: as many as it may miss, and one more."""
    idf = lambda w: math.log((n + 1) / (frequency.get(w, 0) + 1))
    out: dict[str, list[tuple[int, int]]] = {}
    for t, (_, phrase, _) in enumerate(templates):
        words = phrase.split()
        rarest = sorted(range(len(words)), key=lambda i: (-idf(words[i]), words[i], i))
        for i in rarest[: len(words) - needed(len(words)) + 1]:
            out.setdefault(words[i], []).append((t, i))
    return out


def scan(docs: DataFrame, *, templates: list[Template] = TEMPLATES, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or `keep` of it) with n_words, and found: each place where a template stands, as label, template (its
    number), start (words from 0), n_words of the template and how many agree."""
    n, frequency = frequencies(docs, templates, text)
    postings = index(templates, n, frequency)
    # Tables in the plan as one literal each: folded once, small while it is analysed.
    lookup = F.from_json(F.lit(json.dumps({w: [{"t": t, "i": i} for t, i in ps] for w, ps in postings.items()})), "map<string, array<struct<t: int, i: int>>>")
    table = [{"label": t[0], "words": t[1].split(), "need": needed(len(t[1].split())), "keys": key_places(t)} for t in templates]
    forms = F.from_json(F.lit(json.dumps(table)), "array<struct<label: string, words: array<string>, need: int, keys: array<int>>>")
    kept = others(keep if keep is not None else docs.columns, ["n_words", "found"])
    rows = docs.select(*[col(c) for c in kept], words_of(col(text)).alias("__words"))
    words = F.col("__words")
    hits = F.array_compact(F.transform(words, lambda w, at: F.when(w.isin(list(postings)), at)))
    proposed = F.transform(hits, lambda at: F.transform(lookup[F.get(words, at)], lambda p: F.struct(p["t"].alias("t"), (at - p["i"]).alias("start"))))
    rows = rows.withColumn("__starts", F.array_distinct(F.flatten(proposed)))
    rows = rows.withColumn("__starts", F.transform("__starts", lambda c: F.struct(c["t"].alias("t"), c["start"].alias("start"), F.get(forms, c["t"]).alias("form"))))

    def compared(c: Column) -> Column:
        form = c["form"]
        stands = lambda i: F.coalesce(F.get(words, c["start"] + i) == F.get(form["words"], i), F.lit(False))
        agree = F.size(F.filter(F.sequence(F.lit(0), F.size(form["words"]) - 1), stands))
        return F.struct(form["label"].alias("label"), c["t"].alias("template"), c["start"].alias("start"), F.size(form["words"]).alias("n_words"), agree.alias("agree"))

    whole = lambda c: F.forall(c["form"]["keys"], lambda i: F.coalesce(F.get(words, c["start"] + i) == F.get(c["form"]["words"], i), F.lit(False)))
    rows = rows.withColumn("__found", F.transform(F.filter("__starts", whole), lambda c: F.struct(compared(c).alias("f"), c["form"]["need"].alias("need"))))
    found = F.transform(F.filter("__found", lambda c: c["f"]["agree"] >= c["need"]), lambda c: c["f"])
    return rows.select(*[col(c) for c in kept], F.size(words).cast("long").alias("n_words"), found.alias("found"))


def digest(found: Column, base: int = len(BASE)) -> dict[str, Column]:
    """Columns drawn from `found`: counts and ends of base phrases (the first `base` templates), labels, the best share."""
    plain = F.filter(found, lambda f: f["template"] < base)
    labels = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda f: f["label"]))), ",")
    starts = F.transform(plain, lambda f: f["start"].cast("long"))
    return {
        "n_base": F.size(plain).cast("long"),
        "first_word": F.array_min(starts),
        "last_word": F.array_max(starts),
        "base_labels": labels(plain),
        "labels": labels(found),
        "score": F.coalesce(F.array_max(F.transform(found, lambda f: f["agree"] / f["n_words"])), F.lit(0.0)),
    }


def oracle_sql(templates: list[Template] = TEMPLATES, base: int = len(BASE)) -> str:
    """The scan in SQL: words joined to templates' words by equality, counted by template and start."""
    forms = ", ".join(f"({t}, '{label}', {len(phrase.split())}, {needed(len(phrase.split()))}, {len(key_places((label, phrase, keys)))})" for t, (label, phrase, keys) in enumerate(templates))
    places = ", ".join(f"({t}, {i}, '{w}', {int(i in key_places(template))})" for t, template in enumerate(templates) for i, w in enumerate(template[1].split()))
    return rf"""WITH forms(t, label, n, need, n_keys) AS (VALUES {forms}), places(t, i, w, is_key) AS (VALUES {places}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
w AS (SELECT r, unnest(words) AS w, unnest(range(len(words))) AS place FROM d),
f AS (SELECT r, t, place - i AS start, count(*) AS agree, sum(is_key) AS keys FROM w JOIN places USING (w) GROUP BY ALL),
g AS (SELECT r, f.t, start, agree / n AS share, label FROM f JOIN forms USING (t) WHERE agree >= need AND keys = n_keys),
s AS (SELECT r, count(*) FILTER (t < {base}) AS n_base, min(start) FILTER (t < {base}) AS first_word, max(start) FILTER (t < {base}) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (t < {base}) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM g GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score FROM d LEFT JOIN s USING (r)"""

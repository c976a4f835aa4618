"""License scans by a positional index of rare words, in DataFrame functions alone.

Each template is a licence's wording with key phrases that must stand in it.  Its rare words are those that the
fewest documents have (the highest IDF over all documents); the rarest word of its first key phrase is its
anchor.  The index has for each rare word its postings: template and position.  A file's words are looked up in
it; an anchor's posting says where the template would begin.  There the postings of the template's other rare
words are intersected by their position relative to it, give or take a few words, and the key phrases are
verified word by word.  The share of the rare words' IDF that stands in its place makes the score.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class LicenseParams:
    """`rare`: a template's rare words; `slack`: words by which a place may be off, where a copy adds or leaves
    out some; `least_share`: of the rare words' IDF, without which a template isn't there."""

    rare: int = 8
    slack: int = 5
    least_share: float = 0.5


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    keys: tuple[str, ...]
    base: bool = False


#: The phrases asked for, then usual notices, then wordings of licences, each with its key phrases.
TEMPLATES = (
    Template("cc-by", "cc by", ("cc by",), True),
    Template("gpl", "general public license", ("general public license",), True),
    Template("reserved", "all rights reserved", ("all rights reserved",), True),
    Template("apache", "licensed under the apache license version", ("apache license",)),
    Template("cc-by-nc", "licensed under cc by nc", ("cc by nc",)),
    Template("cc-by-nd", "licensed under cc by nd", ("cc by nd",)),
    Template("cc-by-sa", "licensed under cc by sa", ("cc by sa",)),
    Template("gpl-notice", "this work is licensed under the gnu general public license version", ("gnu general public license",)),
    Template("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    Template("agpl", "gnu affero general public license", ("affero general public license",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mpl", "mozilla public license version", ("mozilla public license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("for any purpose with or without fee is hereby granted",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice", ("redistribution and use in source and binary forms",)),
    Template("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products derived from this software", "without specific prior written permission")),
    Template("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("you may not use this file except in compliance with the license",)),
    Template("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", ("terms of the gnu general public license", "free software foundation")),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ("this source code form is subject to the terms of the mozilla public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ("free and unencumbered software released into the public domain",)),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0 international",)),
)


def plain_words(text: Column) -> Column:
    """The words of a text with A-Z in lower case.  `lower` also changes letters beyond ASCII, which no
    template has and which stay letters beyond ASCII; only the Kelvin sign would become a k, so it is
    put aside first."""
    one_sign = F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138"))
    return F.regexp_extract_all(F.lower(one_sign), F.lit(WORD), F.lit(0))


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, conditions)


def read_words(docs: DataFrame, text: str, keep: list[str], templates: tuple[Template, ...]) -> DataFrame:
    """One pass over the texts: `row` (the columns to keep), n_words, `seen` (the templates' words that are in
    it) and `words`, which are null where some word of every template's first key phrase is missing."""
    vocabulary = F.array(*[F.lit(w) for w in sorted({w for t in templates for w in t.words.split()})])
    rows = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in keep]).alias("row"), plain_words(F.col(f"`{text}`")).alias("words"))
    rows = rows.select("row", F.size("words").cast("long").alias("n_words"), "words", F.array_intersect("words", vocabulary).alias("seen"))
    keys = sorted({tuple(sorted(set(t.keys[0].split()))) for t in templates})
    may = reduce(lambda x, y: x | y, [_all([F.array_contains("seen", w) for w in key]) for key in keys])
    return rows.withColumn("words", F.when(may, F.col("words")))


def rarity(rows: DataFrame, templates: tuple[Template, ...]) -> dict[str, float]:
    """IDF of the templates' words over all documents: 1 + ln((1 + N) / (1 + df)).  The driver gets one
    number for each word of the templates, whatever the input."""
    df = {r["w"]: r["n"] for r in rows.select(F.explode("seen").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    n = rows.count()
    return {w: 1 + math.log((1 + n) / (1 + df.get(w, 0))) for t in templates for w in t.words.split()}


def rare_words(template: Template, idf: dict[str, float], rare: int) -> list[tuple[int, str]]:
    """The positions of a template's rarest words, the first of equals, in order."""
    words = template.words.split()
    return sorted(sorted(enumerate(words), key=lambda x: (-idf[x[1]], x[0]))[:rare])


def phrase_at(words: list[str], phrase: list[str]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)


def anchor_at(template: Template, idf: dict[str, float]) -> int:
    """The position of the rarest word of the first key phrase, the first of equals."""
    key = template.keys[0].split()
    return phrase_at(template.words.split(), key) + max(range(len(key)), key=lambda j: (idf[key[j]], -j))


def places(template: Template, number: int, idf: dict[str, float], params: LicenseParams) -> Column:
    """Where a template stands in a file: structs of s (the word its first key phrase begins with) and share,
    from `_starts`, the beginnings that the anchors' postings give, and `words`."""
    words = template.words.split()
    keys = [k.split() for k in template.keys]
    first = phrase_at(words, keys[0])

    def stands(phrase: list[str], at: Column) -> Column:
        return _all([F.coalesce(F.get("words", at + F.lit(j)) == F.lit(w), F.lit(False)) for j, w in enumerate(phrase)])

    def nearby(at: Column, holds: Callable[[Column], Column]) -> Column:
        return F.exists(F.sequence(F.lit(-params.slack), F.lit(params.slack)), lambda d: holds(at + d))

    def with_key(key: list[str], start: Column) -> Column:
        return nearby(start + F.lit(phrase_at(words, key)), lambda at: stands(key, at))

    def share(start: Column) -> Column:
        rare = rare_words(template, idf, params.rare)
        total = sum(idf[w] for _, w in rare)
        low = lambda p: F.greatest(start + F.lit(p - params.slack), F.lit(0))
        near = lambda p: F.slice("words", low(p) + 1, F.greatest(start + F.lit(p + params.slack + 1) - low(p), F.lit(0)))
        return reduce(lambda x, y: x + y, [F.when(F.array_contains(near(p), w), F.lit(idf[w] / total)).otherwise(F.lit(0.0)) for p, w in rare])

    mine = F.transform(F.filter("_starts", lambda x: x["t"] == F.lit(number)), lambda x: x["s"])
    found = F.filter(mine, lambda s: stands(keys[0], s + F.lit(first)))
    for key in keys[1:]:
        found = F.filter(found, partial(with_key, key))
    found = F.transform(found, lambda s: F.struct((s + F.lit(first)).cast("long").alias("s"), (F.lit(1.0) if template.base else share(s)).alias("share")))
    return F.filter(found, lambda x: x["share"] >= F.lit(params.least_share))


NEW = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def scan_licenses(docs: DataFrame, text: str = "text", templates: tuple[Template, ...] = TEMPLATES, params: LicenseParams = LicenseParams()) -> DataFrame:
    """Of every row: its columns but the text, then n_words, n_base, first_word, last_word, base_labels, labels
    and score.

    A null text is empty: no words, no places, empty labels, null first and last word, score 0.  Places
    may overlap; all count.  Labels are distinct, sorted and comma-joined.  score is the largest matched
    share of a template's rare words, 0 without labels, 1 at most.  Rows stay where they are; there is no join
    and one pass over the texts.  Columns named like the new ones are replaced, in letters of either case."""
    keep = [c for c in docs.columns if c != text and c.lower() not in NEW]
    rows = written(read_words(docs, text, keep, templates), "license-words")
    idf = rarity(rows, templates)
    postings: dict[str, list[tuple[int, int]]] = {}
    for number, t in enumerate(templates):
        at = anchor_at(t, idf)
        postings.setdefault(t.words.split()[at], []).append((number, at))
    index = F.create_map(*[x for w, found in sorted(postings.items()) for x in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in found]))])
    hits = F.filter(F.transform("words", lambda w, i: F.struct(index[w].alias("posts"), i.alias("i"))), lambda h: h["posts"].isNotNull())
    starts = F.flatten(F.transform(hits, lambda h: F.transform(h["posts"], lambda x: F.struct(x["t"].alias("t"), (h["i"] - x["p"]).alias("s")))))
    rows = rows.withColumn("_starts", F.coalesce(starts, F.array().cast("array<struct<t:int,s:int>>")))
    none = F.array().cast("array<struct<s:bigint,share:double>>")
    rows = rows.withColumns({f"_t{k}": F.when(F.size("_starts") > 0, places(t, k, idf, params)).otherwise(none) for k, t in enumerate(templates)})
    base = [k for k, t in enumerate(templates) if t.base]
    joined = lambda ks: F.array_join(F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(F.size(f"_t{k}") > 0, F.lit(templates[k].label)) for k in ks]), lambda x: x.isNotNull()))), ",")
    rows = rows.withColumn("_places", F.transform(F.concat(*[F.col(f"_t{k}") for k in base]), lambda x: x["s"]))
    best = F.array_max(F.transform(F.concat(*[F.col(f"_t{k}") for k in range(len(templates))]), lambda x: x["share"]))
    return rows.select(
        *[F.col("row")[c].alias(c) for c in keep],
        "n_words",
        F.size("_places").cast("long").alias("n_base"),
        F.array_min("_places").alias("first_word"),
        F.array_max("_places").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(range(len(templates))).alias("labels"),
        F.least(F.coalesce(best, F.lit(0.0)), F.lit(1.0)).alias("score"),
    )


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))

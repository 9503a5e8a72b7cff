"""Licence scans with a positional index of rare words, in DataFrame functions alone.

1. The document frequency of every word of a template's key phrases, over all
   documents, gives its inverse document frequency. This is a list as long as
   that vocabulary.
2. A document's postings are the places of its rarest licence words: of each
   key phrase the two words of highest inverse document frequency. The
   postings of a template's two words are intersected by relative position:
   each alignment that both propose stays.
3. There the key phrase must stand word by word, and every other key phrase
   of the template complete within ``DRIFT`` words of its place. Of the
   template's whole text, the share of words that stand within ``DRIFT`` words
   of their places (so that gaps and inserted words cost what they are) must
   reach ``least``.

Everything happens inside a row; the only shuffle carries the frequencies of
the vocabulary. The texts are read twice and nothing is written.

The score is the largest, over matches, of the share times n / (n + 2) for a
template of n words: more words in place say more.

Defined results: a null or empty text has no words; texts of any length are
read whole; a document without a match has n_base 0, null places, empty labels
and score 0; repeated rows and rows that share a doc_id are scanned each for
itself; an empty table gives none; only id and text are read, so names of
other columns can't clash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of ASCII bytes that are no digit or lower-case letter.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words by which parts of a template may stand apart from where its first key phrase puts them.
DRIFT = 8
#: Words of a template at which a match weighs half.
HALF = 2.0


@dataclass(frozen=True)
class Template:
    """Every phrase of ``keys`` (default: the text) occurs in ``text`` and must stand complete; of ``text``, the share ``least`` must be in place."""

    text: str
    label: str
    keys: tuple[str, ...] = ()
    least: float = 1.0
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def phrases(self) -> list[tuple[int, list[str]]]:
        """(place in the text, words) of each key phrase."""
        out = []
        for key in self.keys or (self.text,):
            words = key.split()
            out.append((next(i for i in range(len(self.words)) if self.words[i : i + len(words)] == words), words))
        return out


#: Phrases and their labels, and public licence texts and notices.
TEMPLATES = (
    Template("gnu general public license", "gpl", base=True),
    Template("apache license", "apache", base=True),
    Template("cc by", "cc-by", base=True),
    Template("mit license", "mit", base=True),
    Template("licensed under apache license version 2", "apache-2", ("apache license version 2",), 0.6),
    Template("gnu lesser general public license", "lgpl"),
    Template("mozilla public license version 2", "mpl", ("mozilla public license",), 0.6),
    Template("eclipse public license", "epl"),
    Template("creative commons attribution license", "cc", ("creative commons",), 0.5),
    Template("copyright holders all rights reserved", "all-rights-reserved", ("all rights reserved",), 0.6),
    Template(
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
        "copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
        "fitness for a particular purpose and noninfringement",
        "mit-text", ("permission is hereby granted free of charge", "without restriction including without limitation"), 0.6,
    ),
    Template(
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at unless required by applicable law or agreed to in writing "
        "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
        "apache-2-notice", ("except in compliance with the license", "required by applicable law or agreed to in writing"), 0.6,
    ),
    Template(
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
        "in the documentation and or other materials provided with the distribution",
        "bsd", ("redistribution and use in source and binary forms", "must retain the above copyright notice"), 0.6,
    ),
    Template(
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies",
        "isc", ("with or without fee is hereby granted",), 0.6,
    ),
    Template(
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
        "as published by the free software foundation either version 3 of the license or at your option any later version "
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty "
        "of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "gpl-notice", ("as published by the free software foundation", "distributed in the hope that it will be useful"), 0.6,
    ),
    Template(
        "this source code form is subject to the terms of the mozilla public license v 2 0 "
        "if a copy of the mpl was not distributed with this file you can obtain one at",
        "mpl-notice", ("subject to the terms of the mozilla public license",), 0.6,
    ),
    Template(
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software "
        "either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        "unlicense", ("free and unencumbered software released into the public domain",), 0.6,
    ),
    Template(
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
        "zlib", ("held liable for any damages arising from the use of this software",), 0.6,
    ),
)


def vocabulary(templates=TEMPLATES) -> list[str]:
    """Words of the key phrases."""
    return sorted({w for t in templates for _, phrase in t.phrases for w in phrase})


def words_of(text: Column) -> Column:
    """Lower-cased words (A-Z only) of a text."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), BREAK)
    return F.filter(parts, lambda w: w != "")


def rarity(docs: DataFrame, text_col: str, templates=TEMPLATES) -> dict[str, float]:
    """Inverse document frequency of the key phrases' words over all documents; as long as the vocabulary."""
    known = F.array_distinct(F.filter(words_of(F.col(text_col).cast("string")), lambda w: w.isin(*vocabulary(templates))))
    # the empty word counts the documents themselves
    found = docs.select(F.explode(F.array_append(known, F.lit(""))).alias("w")).groupBy("w").count().collect()
    count = {r["w"]: r["count"] for r in found}
    return {w: math.log((count.get("", 0) + 1) / (count.get(w, 0) + 1)) for w in vocabulary(templates)}


def anchors(phrase: list[str], idf: dict[str, float]) -> list[tuple[int, str]]:
    """(place, word) of the phrase's two rarest different words."""
    first = {w: j for j, w in reversed(list(enumerate(phrase)))}
    best = sorted(first, key=lambda w: (-idf[w], first[w]))[:2]
    return [(first[w], w) for w in best]


def _stands(words: Column, at: Column, phrase: list[str]) -> Column:
    """Whether the phrase stands at the place ``at``."""
    there = F.slice(words, F.greatest(at, F.lit(0)) + 1, F.lit(len(phrase))) == F.array(*map(F.lit, phrase))
    return (at >= 0) & there


def _aligned(t: Template, hits: Column, words: Column, idf: dict[str, float]) -> Column:
    """Places of the first key phrase."""
    _, phrase = t.phrases[0]

    def starts(j: int, w: str) -> Column:
        return F.transform(F.filter(hits, lambda h: h["w"] == w), lambda h: h["i"] - j)

    proposed = [starts(j, w) for j, w in anchors(phrase, idf)]
    both = proposed[0] if len(proposed) == 1 else F.array_intersect(*proposed)
    return F.filter(both, lambda at: _stands(words, at, phrase))


def _others(t: Template, words: Column, at: Column) -> Column:
    """Whether the other key phrases stand near where the first one at ``at`` puts them."""
    (head, _), *rest = t.phrases

    def near(place: int, phrase: list[str]) -> Column:
        return F.exists(F.sequence(at + (place - head - DRIFT), at + (place - head + DRIFT)), lambda x: _stands(words, x, phrase))

    return reduce(Column.__and__, (near(*r) for r in rest))


def _share(t: Template, words: Column, at: Column) -> Column:
    """Share of the template's words that stand within DRIFT words of their places."""
    head = t.phrases[0][0]

    def there(w: Column, j: Column) -> Column:
        place = at + j - head
        low = F.greatest(place - DRIFT, F.lit(0))
        return F.array_contains(F.slice(words, low + 1, F.greatest(place + DRIFT - low + 1, F.lit(0))), w)

    return F.size(F.filter(F.array(*map(F.lit, t.words)), there)) / F.lit(float(len(t.words)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and matches (label, first word of the first key phrase, share in place, words of the template)."""
    idf = rarity(docs, text_col, templates)
    rare = sorted({w for t in templates for _, w in anchors(t.phrases[0][1], idf)})
    pick = lambda w, i: F.when(w.isin(*rare), F.struct(w.alias("w"), i.alias("i")))
    own = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col).cast("string")).alias("words"))
    out = own.withColumn("hits", F.array_compact(F.transform("words", pick)))
    some, words = F.size("hits") > 0, F.col("words")
    for k, t in enumerate(templates):
        out = out.withColumn(f"at{k}", F.when(some, _aligned(t, F.col("hits"), words, idf)).otherwise(F.array().cast("array<int>")))

    def found(k: int, t: Template) -> Column:
        share = (lambda at: F.lit(1.0)) if not t.keys else (lambda at: _share(t, words, at))
        places = F.filter(f"at{k}", lambda at: _others(t, words, at)) if len(t.phrases) > 1 else F.col(f"at{k}")
        made = F.transform(places, lambda at: F.struct(F.lit(t.label).alias("label"), at.cast("long").alias("place"), share(at).alias("share"), F.lit(len(t.words)).alias("size")))
        return F.filter(made, lambda m: m["share"] >= t.least) if t.keys else made

    base = F.concat(*(F.transform(f"at{k}", lambda at: at.cast("long")) for k, t in enumerate(templates) if t.base))
    out = out.select("doc_id", F.size("words").cast("long").alias("n_words"), base.alias("base"), F.concat(*(found(k, t) for k, t in enumerate(templates))).alias("matches"))
    named = [t.label for t in templates if t.base]
    labels = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["label"])))
    weight = F.transform("matches", lambda m: m["share"] * m["size"] / (m["size"] + F.lit(HALF)))
    return out.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base").alias("first_word"), F.array_max("base").alias("last_word"),
        F.array_join(F.filter(labels, lambda x: x.isin(named)), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.round(F.coalesce(F.array_max(weight), F.lit(0.0)), 6).alias("score"), "matches",
    )

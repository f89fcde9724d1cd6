"""Licence notices in texts, found through a positional index of the rarest words of licence templates.

The templates are paragraphs of public licences and the notices by which files name them. The document
frequencies of their words over all texts give weights, and the rarest words of each template, with their
places in it, make the index. A text looks up its own licence words: places of rare words minus their places
in a template are offsets, and where enough words agree on a template and an offset the notice may stand
there. It does if the template's key phrases stand word by word and the words in place hold SHARE of the
template's weight. A template's index words outweigh what may be missing even without the heaviest of them,
so every place that meets the share is found. SQL functions only, no shuffle of texts.
"""

from __future__ import annotations

import json
import math
import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import let

# Fixed values of the query contract.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Paragraphs of public licences and the notices that name them, as their publishers word them.
#: Label, text, key phrases that must stand word by word.
TEMPLATES = (
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("GNU Affero General Public License",)),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("Apache License",)),
    ("apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ("apache org licenses",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", ("source and binary forms",)),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", ("this list of conditions",)),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ("endorse or promote products",)),
    ("cc", "This work is licensed under a Creative Commons Attribution License", ("Creative Commons",)),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("Creative Commons",)),
    ("cc", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License", ("Creative Commons",)),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ("Eclipse Public License",)),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", ("GNU General Public License", "version 2 of the License")),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("GNU General Public License", "version 3")),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("GNU General Public License", "version 3 of the License")),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ("with or without fee is hereby granted",)),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", ("GNU Lesser General Public License",)),
    ("mit", "Released under the MIT License", ("under the MIT License",)),
    ("mit", "Licensed under the MIT License", ("under the MIT License",)),
    ("mit-terms", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", ("Permission is hereby granted",)),
    ("mit-terms", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so", ("sell copies of the Software",)),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", ("Mozilla Public License",)),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License", ("Mozilla Public License",)),
    ("unlicense", "This is free and unencumbered software released into the public domain.", ("unencumbered software",)),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", ("In no event will the authors be held liable",)),
    ("zlib", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.", ("must not be misrepresented",)),
)
#: Share of a template's weight that must stand in place.
SHARE = 0.8
#: Index words that must agree on template and offset.
AGREE = 2
#: Score of a text that has only a contract phrase.
PHRASE_SCORE = 0.5

INDEX = "struct<vocabulary:array<string>,templates:array<struct<label:string,words:array<struct<w:string,v:double>>,keys:array<int>,total:double>>,postings:map<string,array<struct<t:int,p:int>>>>"


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))


def vocabulary() -> list[str]:
    """All words of the templates and of the contract's phrases."""
    return sorted({w for _, text, _ in TEMPLATES for w in words_of(text)} | {w for p in BASE_PHRASES for w in p.split()})


def _words(text: Column) -> Column:
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lowered, F.lit(f"({WORD})"), F.lit(1))


def word_weights(docs: DataFrame, text: str = "text") -> dict[str, float]:
    """Inverse document frequency of each licence word over all texts (one number a word); a word of no text weighs most."""
    known = F.lit(" ".join(vocabulary()))
    own = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = own.select(F.explode(F.array_append(F.array_intersect(_words(F.col("text")), F.split(known, " ")), F.lit(""))).alias("word"))
    counts = {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = counts.pop("", 0)  # the empty word stands once in every text
    return {word: math.log((2 + total) / (1 + counts.get(word, 0))) for word in vocabulary()}


def index_of(weights: dict[str, float]) -> dict:
    """Templates with their words' weights and the places of their key phrases, and postings of their rarest words."""
    templates, postings = [], {}
    for number, (label, text, phrases) in enumerate(TEMPLATES):
        words = words_of(text)
        keys = set()
        for phrase in map(words_of, phrases):
            at = next(k for k in range(len(words)) if words[k : k + len(phrase)] == phrase)
            keys.update(range(at, at + len(phrase)))
        worth = [weights[w] for w in words]
        total = math.fsum(worth)
        spare = (1 - SHARE) * total * (1 + 1e-9)
        taken = []
        for place in sorted(range(len(words)), key=lambda k: (-worth[k], words[k], k)):
            if math.fsum(worth[k] for k in taken[1:]) > spare:  # the heaviest of them may be the only one in place
                break
            taken.append(place)
        for place in sorted(taken):
            postings.setdefault(words[place], []).append({"t": number, "p": place})
        listed = [{"w": w, "v": v} for w, v in zip(words, worth)]
        templates.append({"label": label, "words": listed, "keys": sorted(keys), "total": total})
    return {"vocabulary": vocabulary(), "templates": templates, "postings": postings}


def _base_places(words: Column, known: Column) -> Column:
    """Places of the contract's phrases; looked for only where all words of one are among the text's words."""

    def stands(i: Column, phrase: list[str]) -> Column:
        hit = F.lit(True)
        for k, w in enumerate(phrase):
            hit = hit & F.coalesce(F.get(words, i + k) == w, F.lit(False))
        return hit

    def label(x: Column, i: Column) -> Column:
        found = F.lit(None).cast("string")
        for phrase, name in BASE_PHRASES.items():
            found = F.when((x == phrase.split()[0]) & stands(i, phrase.split()), name).otherwise(found)
        return F.struct(i.cast("long").alias("i"), found.alias("label"))

    possible = F.lit(False)
    for phrase in BASE_PHRASES:
        possible = possible | (F.size(F.array_intersect(known, F.split(F.lit(phrase), " "))) == len(phrase.split()))
    places = F.filter(F.transform(words, label), lambda p: p["label"].isNotNull())
    return F.when(possible, places).otherwise(F.array().cast("array<struct<i:bigint,label:string>>"))


def _notices(words: Column, known: Column, index: Column) -> Column:
    """Verified notices in a text: label, and the share of the template's weight that stands in place."""
    templates, postings = index["templates"], index["postings"]

    def weight(parts: Column) -> Column:
        return F.aggregate(parts, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))

    def reachable(t: Column) -> Column:
        """Whether the text's words, in any order, could hold the share."""
        return weight(F.transform(t["words"], lambda x: F.when(F.array_contains(known, x["w"]), x["v"]))) >= SHARE * t["total"] * (1 - 1e-9)

    numbers = F.filter(F.sequence(F.lit(0), F.lit(len(TEMPLATES) - 1)), lambda n: reachable(F.get(templates, n)))

    def candidates(open_: Column) -> Column:
        def posted(w: Column) -> Column:
            return F.filter(postings[w], lambda q: F.array_contains(open_, q["t"]))

        rare = F.filter(F.map_keys(postings), lambda w: F.array_contains(known, w) & (F.size(posted(w)) > 0))

        def agreed(rare_words: Column) -> Column:
            places = F.filter(F.transform(words, lambda x, i: F.struct(x.alias("w"), i.alias("i"))), lambda h: F.array_contains(rare_words, h["w"]))
            votes = F.flatten(F.transform(places, lambda h: F.transform(posted(h["w"]), lambda q: F.struct(q["t"].alias("t"), (h["i"] - q["p"]).alias("o")))))

            def together(order: Column) -> Column:
                def equal(i: Column, x: Column) -> Column:
                    return F.coalesce(F.get(order, i) == x, F.lit(False))

                return F.filter(order, lambda x, i: equal(i - (AGREE - 1), x) & ~equal(i - AGREE, x))

            return let(F.sort_array(votes), together)

        return let(rare, agreed)

    def verified(place: Column) -> Column:
        def judged(t: Column) -> Column:
            held = weight(F.transform(t["words"], lambda x, k: F.when(F.get(words, place["o"] + k) == x["w"], x["v"])))
            stand = F.forall(t["keys"], lambda k: F.coalesce(F.get(words, place["o"] + k) == F.get(t["words"], k)["w"], F.lit(False)))
            share = F.when(t["total"] > 0, F.least(held / t["total"], F.lit(1.0))).otherwise(1.0)
            return F.when(stand, F.struct(t["label"].alias("label"), share.alias("share")))

        return let(F.get(templates, place["t"]), judged)

    places = let(numbers, lambda n: F.when(F.size(n) > 0, candidates(n)).otherwise(F.array().cast("array<struct<t:int,o:int>>")))
    return F.filter(F.transform(places, verified), lambda n: n.isNotNull() & (n["share"] >= SHARE))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``licence``: n_words, n_base, first_word, last_word, base_labels, labels, score, notices.

    Base places are those of the contract's phrases; ``labels`` has theirs and those of verified notices,
    distinct, sorted, comma-joined (empty text if none). ``score`` is the best notice's share of weight in
    place, at least 0.5 with a base phrase, else 0. A licence that is only mentioned gives no label: SHARE of
    a notice must stand, at one offset. Null and empty texts have no words and score 0. Rows are judged one by
    one, so repeated rows, null ids and other columns change nothing.
    """
    index = F.from_json(F.lit(json.dumps(index_of(word_weights(docs, text)))), INDEX)

    def found(words: Column) -> Column:
        known = F.array_intersect(words, index["vocabulary"])
        return let(known, lambda k: result(words, _base_places(words, k), _notices(words, k, index)))

    def result(words: Column, base_places: Column, notices: Column) -> Column:
        return let(F.struct(F.size(words).alias("n"), base_places.alias("base"), notices.alias("notices")), fields)

    def fields(f: Column) -> Column:
        base, notices = f["base"], f["notices"]
        base_labels = F.transform(base, lambda p: p["label"])
        labels = F.array_union(base_labels, F.transform(notices, lambda n: n["label"]))
        at_least = F.when(F.size(base) > 0, PHRASE_SCORE).otherwise(0.0)
        best = F.coalesce(F.array_max(F.transform(notices, lambda n: n["share"])), F.lit(0.0))
        return F.struct(
            f["n"].cast("long").alias("n_words"),
            F.size(base).cast("long").alias("n_base"),
            F.get(base, F.lit(0))["i"].alias("first_word"),
            F.get(base, F.size(base) - 1)["i"].alias("last_word"),
            F.array_join(F.sort_array(F.array_distinct(base_labels)), ",").alias("base_labels"),
            F.array_join(F.sort_array(F.array_distinct(labels)), ",").alias("labels"),
            F.greatest(best, at_least).alias("score"),
            notices.alias("notices"),
        )

    return docs.withColumn("licence", let(_words(F.coalesce(F.col(text), F.lit(""))), found))


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of findings for each text."""
    scanned = scan(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    fields = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    return scanned.select("doc_id", *[F.col("licence")[f].alias(f) for f in fields])

"""Licence scan by a positional index of rare words, in DataFrame operations only.

1. The licence words of all templates are counted over the whole corpus; each template is indexed by those of its words that the
   fewest documents have (the highest IDF), with every place they have in it.
2. One pass over whole texts keeps the places of these words and of the phrases. A word found at ``at`` that a template has at ``q``
   speaks for the template beginning at ``at - q``; places that lie within ``SLACK`` words of each other are intersected.
3. A template that enough of its rare words agree on is accepted if all its key phrases stand there.

The index has a few hundred rows, bounded by the templates, and is broadcast; texts are never joined with each other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.llm.common import kept, small

# What parts words: ASCII without digits and small letters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RARE, SLACK, AGREE = 8, 16, 60

# Phrases that name a licence by themselves.
PHRASES = [("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license")]


@dataclass(frozen=True)
class Template:
    """A licence's label, the words of its notice, and the phrases without which the notice is not there."""

    label: str
    text: str
    keys: tuple[str, ...]


# Opening or standing notices of public licences, in lower case and without punctuation.
TEMPLATES = [
    Template("agpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published "
             "by the free software foundation either version 3 of the license or at your option any later version", ("affero general public license", "version 3")),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy "
             "of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is "
             "distributed on an as is basis without warranties or conditions of any kind either express or implied", ("apache license version 2 0", "except in compliance")),
    Template("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
             "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must "
             "reproduce the above copyright notice", ("source and binary forms", "above copyright notice")),
    Template("bsd-3-clause", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and "
             "or other materials provided with the distribution neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
             "products derived from this software without specific prior written permission", ("endorse or promote products", "prior written permission")),
    Template("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this "
             "license", ("person or organization obtaining", "covered by this license")),
    Template("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("commons attribution 4 0 international",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("neighboring rights",)),
    Template("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license 2 0",)),
    Template("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free "
             "software foundation either version 2 of the license or at your option any later version", ("gnu general public license", "version 2")),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free "
             "software foundation either version 3 of the license or at your option any later version", ("gnu general public license", "version 3")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice "
             "and this permission notice appear in all copies", ("without fee", "hereby granted")),
    Template("lgpl-2.1", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free "
             "software foundation either version 2 1 of the license or at your option any later version", ("lesser general public license", "version 2 1")),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the "
             "software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
             ("hereby granted free of charge", "without restriction")),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain "
             "one at", ("mozilla public license v 2 0",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of "
             "this software", ("held liable", "damages arising")),
]


def _split(text: Column) -> Column:
    """The words of a text, with an empty one at an end where a gap is. No capital outside A-Z becomes a letter of a base phrase."""
    return F.split(F.lower(text), GAP)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _split(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("parts"))


def postings(docs: DataFrame, templates: list[Template], rare: int) -> list[tuple[str, int, int, int]]:
    """(word, template, rank, place): of each template the ``rare`` words that the fewest documents have (half of its words at most), with all their
    places.

    Ties go by the word. At most as many counts as the templates have words come to the driver."""
    bodies = [template.text.split() for template in templates]
    words = sorted({word for body in bodies for word in body})
    if not words:
        return []
    own = _texts(docs).select(F.explode(F.array_distinct(F.filter("parts", lambda word: word.isin(words)))).alias("word"))
    counts = {row["word"]: row["n"] for row in own.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = []
    for at, body in enumerate(bodies):
        names = set(body)
        # A word that no document has is as rare as can be: it finds nothing, and a text without it agrees on less.
        best = sorted((counts.get(word, 0), word) for word in names)[: min(rare, -(-len(names) // 2))]
        found += [(word, at, rank, place) for rank, (_, word) in enumerate(best) for place, other in enumerate(body) if other == word]
    return found


def _stands(hits: Column, at: Column, one: Column, words: list[str]) -> Column:
    """Whether the phrase begins at the hit ``one``, the ``at``-th: its words are hits all, so they follow each other there too."""
    rest = [F.get(hits, at + k) for k in range(1, len(words))]
    return F.coalesce(_all([one["word"] == words[0], *[(x["word"] == word) & (x["at"] == one["at"] + k) for k, (x, word) in enumerate(zip(rest, words[1:]), 1)]]), F.lit(False))


def _all(conditions: list[Column]) -> Column:
    whole = conditions[0]
    for condition in conditions[1:]:
        whole = whole & condition
    return whole


def placed(docs: DataFrame, phrases: list[str], rare: set[str]) -> DataFrame:
    """row, doc_id, n_words, places (phrase number, at) of every phrase, hits (word, at) of every rare word, written once."""
    wanted = sorted(rare | {word for phrase in phrases for word in phrase.split()})
    parts = F.col("parts")
    lead = F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0)
    ends = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    shaped = _texts(docs).select("doc_id", (F.size(parts) - lead - ends).cast("long").alias("n_words"), F.filter(
        F.transform(parts, lambda word, at: F.when(word.isin(wanted), F.struct((at - lead).alias("at"), word.alias("word")))), lambda hit: hit.isNotNull()).alias("hits"))
    hits = F.col("hits")

    def begun(nth: int, words: list[str]) -> Column:
        """(phrase, at) of the hits where a phrase begins."""
        found = F.transform(hits, lambda one, at: F.when(_stands(hits, at, one, words), F.struct(F.lit(nth).alias("phrase"), one["at"].alias("at"))))
        return F.filter(found, lambda place: place.isNotNull())

    places = [begun(nth, phrase.split()) for nth, phrase in enumerate(phrases)]
    # Where none of the words is, no phrase is looked for.
    found = F.when(F.size(hits) > 0, F.concat(*places)).otherwise(F.array().cast("array<struct<phrase: int, at: int>>"))
    return kept(shaped.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", found.alias("places"),
                              F.filter(hits, lambda hit: hit["word"].isin(sorted(rare)) if rare else F.lit(False)).alias("hits")))


def matched(rows: DataFrame, index: list[tuple[str, int, int, int]], templates: list[Template], phrases: list[str], agree: int = AGREE, slack: int = SLACK) -> DataFrame:
    """row, found (labels), covered: the templates whose rare words agree on a place, as a share of ``agree`` percent at least, with all key phrases there."""
    spark = rows.sparkSession
    of = {(at, rank) for _, at, rank, _ in index}
    sizes = {at: sum(1 for one, _ in of if one == at) for at in {one for one, _ in of}}
    posted = spark.createDataFrame(index, "word string, template int, rank int, place int")
    # Two grids, half a cell apart, so that places close to each other share a cell.
    votes = rows.select("row", F.explode("hits").alias("hit")).select("row", "hit.word", "hit.at").join(F.broadcast(posted), "word").select(
        "row", "template", "rank", (F.col("at") - F.col("place")).alias("shift"), F.explode(F.array(F.lit(0), F.lit(slack // 2))).alias("grid"))
    cells = votes.groupBy("row", "template", "grid", F.floor((F.col("shift") + F.col("grid")) / slack).alias("cell")).agg(
        F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("rank")))).alias("agreed"))
    known = spark.createDataFrame([(at, templates[at].label, size, len(templates[at].text.split()), [phrases.index(key) for key in templates[at].keys]) for at, size in sorted(sizes.items())],
                                  "template int, label string, size int, length int, keys array<int>")
    likely = kept(cells.join(F.broadcast(known), "template").where((F.col("agreed") >= F.least(F.lit(2), F.col("size"))) & (F.col("agreed") * 100 >= F.col("size") * agree)))
    begin = F.col("cell") * slack - F.col("grid")

    def near(place: Column) -> Column:
        return (place["at"] >= begin - slack) & (place["at"] <= begin + 2 * slack + F.col("length"))

    whole = F.forall("keys", lambda key: F.exists("places", lambda place: (place["phrase"] == key) & near(place)))
    return rows.select("row", "places").join(small(likely), "row").where(whole).groupBy("row").agg(
        F.collect_set("label").alias("found"), F.max(F.col("agreed") / F.col("size")).alias("covered"))


def license_scan(docs: DataFrame, templates: list[Template] = TEMPLATES, named: list[tuple[str, str]] = PHRASES, rare: int = RARE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base (places of the ``named`` phrases), first_word, last_word (their smallest and largest start),
    base_labels, labels (with those of the templates; sorted, comma-joined), score (1 with a base label, else the best template's share of rare words).

    A null text counts as empty. A text without a licence has empty labels, null places and score 0. Repeated rows come back once each, with or
    without an id. Other columns are ignored; an empty table gives an empty result."""
    phrases = list(dict.fromkeys([phrase for _, phrase in named] + [key for template in templates for key in template.keys]))
    index = postings(docs, templates, rare)
    rows = placed(docs, phrases, {word for word, *_ in index})
    own = F.create_map(*[F.lit(item) for nth, (label, _) in enumerate(named) for item in (nth, label)])
    base = rows.withColumn("base", F.filter("places", lambda place: place["phrase"] < len(named))).withColumn(
        "base_set", F.array_sort(F.array_distinct(F.transform("base", lambda place: own[place["phrase"]])))).drop("places", "hits")
    more = kept(matched(rows, index, templates, phrases)) if index else rows.select("row", F.array().cast("array<string>").alias("found"), F.lit(0.0).alias("covered")).limit(0)
    starts = F.transform("base", lambda place: place["at"])
    joined = base.join(small(more), "row", "left")
    return joined.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.array_join("base_set", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_set", F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("covered", F.lit(0.0))).alias("score"))

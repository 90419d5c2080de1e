"""License scans by diagonal voting.

Templates are license phrases and texts, as words. Every text is cut into rolling word k-grams, k = 2 for phrases
and 4 for longer templates; their hashes meet the templates' hashes in a Spark join (the templates' side
is counted and small). A hit of text word i and template word t votes for the diagonal i - t of its
text and template. Diagonals at most ``shift`` apart are merged into a band, as words that were
put in or left out move the rest of a copy to a neighbouring diagonal. Bands go on if they have
the votes that a copy has to have: if a share 1 - s of n template words is changed, at least
n - k + 1 - k (1 - s) n grams are left whole, so no copy is lost with up to ``shift`` words put in or left out in one place. What goes on is verified on the text itself:
the share of template words that stand, equal, on one of the band's diagonals must reach s (phrases: all of them, on one diagonal).

Equal texts vote once, whatever their number. Nothing is grouped but votes, by text and template; the
spans that go on are few, and meet the texts by digest in a join that is broadcast if they are counted few and else
shuffled, where adaptive execution splits a digest that many rows share.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased.

Cases: a null or empty text has no words, no place and no label; overlapping and repeated places all count; repeated
rows and ids are rows like any other; empty tables give empty results; a template without words is left out, a repeated
one counts once. Of the input only the id and the text are read, so other columns don't matter.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinograph.llm.common import cut, narrow_side

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a gram, for templates of up to SHORT words and longer ones.
SHORT, GRAM, LONG_GRAM = 3, 2, 4
#: Texts with spans that may be broadcast, some 200 bytes each.
FEW_TEXTS = 200_000
#: What lies between words, after A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPANS = "array<struct<label: string, phrase: boolean, start: bigint, end: bigint, similarity: double>>"

#: Phrases with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Parts of public license texts and usual notices, with their labels.
TEXTS = {
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "warranty-disclaimer": "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-3-line": "licensed under the GNU General Public License, version 3",
    "lgpl-notice": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "mit-line": "Released under the MIT License",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0-line": "licensed under a Creative Commons Attribution 4.0 International License",
}


@dataclass(frozen=True)
class Template:
    """``phrase`` templates count only where all their words stand one after the other."""

    label: str
    words: tuple[str, ...]
    phrase: bool

    @property
    def k(self) -> int:
        return GRAM if len(self.words) <= SHORT else LONG_GRAM

    def votes_needed(self, similarity: float) -> int:
        grams = len(self.words) - self.k + 1
        return grams if self.phrase else max(1, grams - math.floor(self.k * (1 - similarity) * len(self.words) + 1e-9))


def template_words(text: str) -> tuple[str, ...]:
    return tuple(w for w in re.split(BETWEEN, text.translate(str.maketrans(UPPER, LOWER))) if w)


def templates(phrases: dict[str, str] | None = None, texts: dict[str, str] | None = None) -> list[Template]:
    """Phrases (text: label) and longer texts (label: text) as templates; texts of up to SHORT words are phrases, too."""
    found = [(label, template_words(text), True) for text, label in (PHRASES if phrases is None else phrases).items()]
    found += [(label, w := template_words(text), len(w) <= SHORT) for label, text in (TEXTS if texts is None else texts).items()]
    if short := [f[0] for f in found if len(f[1]) < GRAM]:
        raise ValueError(f"templates need {GRAM} words: {short}")
    return sorted({Template(*f) for f in found}, key=lambda t: (t.label, t.words, t.phrase))


def words_of(text: Column) -> Column:
    """The text's words, in order."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN)
    return F.array_remove(parts, "")


def gram_hash(words: Column, i: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(words, i + j) for j in range(k)])


def template_grams(spark: SparkSession, held: list[Template]) -> DataFrame:
    """(hash, template, place) of every gram of every template."""
    rows = [(n, i, t.k, list(t.words[i : i + t.k])) for n, t in enumerate(held) for i in range(len(t.words) - t.k + 1)]
    found = spark.createDataFrame(rows, "template int, place int, k int, gram array<string>")
    start = F.lit(0)
    return found.select(F.when(F.col("k") == GRAM, gram_hash(F.col("gram"), start, GRAM)).otherwise(gram_hash(F.col("gram"), start, LONG_GRAM)).alias("hash"), "template", "place")


def votes(texts: DataFrame, held: list[Template]) -> DataFrame:
    """(digest, template, diagonal, votes) of texts (digest, text): how many grams of a template stand on a diagonal of a text."""
    words = texts.select("digest", words_of(F.col("text")).alias("words"))
    # two hashes a word, in turn; a gram cut off by the text's end hashes what is left, which verification tells apart
    hashes = F.flatten(F.transform("words", lambda _, i: F.array(gram_hash(F.col("words"), i, GRAM), gram_hash(F.col("words"), i, LONG_GRAM))))
    rows = words.select("digest", F.posexplode(hashes).alias("at", "hash"))
    hits = rows.join(F.broadcast(template_grams(texts.sparkSession, held)), "hash")
    diagonal = (F.shiftright("at", 1) - F.col("place")).alias("diagonal")
    return hits.select("digest", "template", diagonal, "place").groupBy("digest", "template", "diagonal").agg(F.count_distinct("place").alias("votes"))


def by_template(values: list) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.col("template"))


def bands(voted: DataFrame, held: list[Template], similarity: float, shift: int) -> DataFrame:
    """(digest, bands: array<struct<template, diagonals>>): neighbouring diagonals merged, those with votes enough."""
    reach = by_template([0 if t.phrase else shift for t in held])
    ordered = Window.partitionBy("digest", "template").orderBy("diagonal")
    opens = (F.col("diagonal") - F.lag("diagonal").over(ordered) > reach).cast("int")
    numbered = voted.withColumn("opens", F.coalesce(opens, F.lit(1))).withColumn("band", F.sum("opens").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy("digest", "template", "band").agg(F.sum("votes").alias("votes"), F.array_sort(F.collect_list("diagonal")).alias("diagonals"))
    enough = merged.where(F.col("votes") >= by_template([t.votes_needed(similarity) for t in held]))
    return enough.groupBy("digest").agg(F.collect_list(F.struct("template", "diagonals")).alias("bands"))


def verified(words: Column, band: Column, held: list[Template], similarity: float) -> Column:
    """struct<label, base, start, end, similarity> of a band, by the text's own words; null if they don't hold."""
    template = F.get(F.array(*[F.array(*map(F.lit, t.words)) for t in held]), band["template"])
    stands = F.transform(template, lambda w, t: F.get(F.filter(F.transform(band["diagonals"], lambda d: d + t), lambda i: F.get(words, i) == w), F.lit(0)))
    places = F.array_compact(stands)
    pick = lambda values: F.get(F.array(*map(F.lit, values)), band["template"])
    share = F.size(places) / F.size(template)
    needed = pick([1.0 if t.phrase else similarity for t in held])
    found = F.struct(pick([t.label for t in held]).alias("label"), pick([t.phrase for t in held]).alias("phrase"), F.array_min(places).cast("long").alias("start"), (F.array_max(places) + 1).cast("long").alias("end"), share.alias("similarity"))
    return F.when(share >= needed, found)


def scan(docs: DataFrame, held: list[Template] | None = None, similarity: float = 0.8, shift: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, n_words, spans: array<struct<label, phrase, start, end, similarity>>): every place of every template, by start and label."""
    held = templates() if held is None else held
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn("digest", F.md5(F.col("text").cast("binary")))
    if not held:
        return rows.select(F.col("id").alias(id_col), F.size(words_of(F.col("text"))).cast("long").alias("n_words"), F.array().cast(SPANS).alias("spans"))
    found = cut(bands(votes(rows, held), held, similarity, shift))
    joined = rows.join(narrow_side(found, FEW_TEXTS), "digest", "left").select("id", words_of(F.col("text")).alias("words"), "bands")
    spans = F.transform("bands", lambda band: verified(F.col("words"), band, held, similarity))
    order = lambda a, b: F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"])).when(a["label"] < b["label"], -1).when(a["label"] > b["label"], 1).otherwise(F.signum(a["end"] - b["end"])).cast("int")
    spans = F.coalesce(F.array_sort(F.array_compact(spans), order), F.array().cast(SPANS))
    return joined.select(F.col("id").alias(id_col), F.size("words").cast("long").alias("n_words"), spans.alias("spans"))

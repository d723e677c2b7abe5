"""License scans by an exact set-similarity join, with DataFrame functions only.

A text's blocks are windows of BLOCK_WORDS words, half overlapping, so a notice of up to half a block lies wholly in
one; blocks grow with the longest template. The text is split once: what the later steps need of it is written. A block meets a template if it contains at least THRESHOLD of the template's distinct words. Words are ordered by
their frequency over all documents, rarest first. A block can only meet a template if it holds a word of the template's
prefix (prefix filter), has enough words (length filter) and has enough of them left where the first word meets (positional
filter); what remains is verified exactly.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# Phrases that name a license, and openings of well-known license notices.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
TEMPLATES = {
    "apache": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
}

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK_WORDS, STRIDE = 128, 64
THRESHOLD = 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_set(text: str) -> list[str]:
    return sorted({w for w in re.split(GAP, text.translate(str.maketrans(_UPPER, _LOWER))) if w})


def _lower(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def _words(lower: Column) -> Column:
    return F.array_remove(F.split(lower, GAP), "")


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _places(lower: Column, words: Column, phrase: str) -> Column:
    """Where the phrase's words stand consecutively; the words are only looked at where the text holds the last and, for a short phrase, both together."""
    parts = phrase.split()
    maybe = lower.contains(parts[-1]) & lower.contains(parts[0])
    if min(map(len, parts)) < 3:
        maybe &= lower.rlike(GAP.join(parts))
    indices = F.sequence(F.lit(0), F.size(words) - len(parts))
    hit = lambda i: F.forall(F.sequence(F.lit(0), F.lit(len(parts) - 1)), lambda k: F.get(words, i + k) == F.get(_strings(parts), k))
    exact = lambda i: (F.get(words, i) == parts[0]) & hit(i)
    return F.when(maybe & (F.size(words) >= len(parts)), F.filter(indices, exact)).otherwise(F.array().cast("array<int>"))


def _split(docs: DataFrame, vocabulary: list[str], shortest: int, block_words: int) -> DataFrame:
    """doc_id, n_words, the places of each phrase, the vocabulary's words that the text holds, and its blocks of at least ``shortest`` of them."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _lower(F.col("text").cast("string")).alias("lower"))
    rows = docs.withColumn("words", _words(F.col("lower")))
    rows = rows.withColumn("known", F.transform("words", lambda w: F.when(w.isin(vocabulary), w)))
    held = lambda words: F.array_distinct(F.filter(words, lambda w: w.isNotNull()))
    stride = block_words // 2
    firsts = F.sequence(F.lit(0), F.greatest(F.size("words") - stride - 1, F.lit(0)), F.lit(stride))
    blocks = F.transform(firsts, lambda i: F.struct(i.alias("block"), held(F.slice("known", i + 1, block_words)).alias("held")))
    places = [_places(F.col("lower"), F.col("words"), p).alias(f"at_{i}") for i, p in enumerate(PHRASES)]
    # the length filter, first for the whole text
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), *places, "known", blocks.alias("blocks"))
    rows = rows.withColumn("held", held(F.col("known")))
    kept = F.when(F.size("held") >= shortest, F.filter("blocks", lambda b: F.size(b["held"]) >= shortest))
    return rows.select("doc_id", "n_words", *[f"at_{i}" for i in range(len(PHRASES))], "held", kept.alias("blocks"))


def word_order(rows: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary by the number of documents that hold each word, rarest first; at most as many rows as it has words reach the driver."""
    counts = {r["w"]: r["count"] for r in rows.select(F.explode("held").alias("w")).groupBy("w").count().collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def _met(held: Column, order: list[str], sets: dict[str, list[str]], least: dict[str, int]) -> Column:
    """The templates that a block meets, as (label, containment), by prefix, length and positional filter and then exactly."""
    rank = {w: i for i, w in enumerate(order)}
    ints = lambda xs: F.array(*map(F.lit, xs)).cast("array<int>")
    ordered = {k: sorted(rank[w] for w in s) for k, s in sets.items()}
    templates = F.array(*[F.struct(F.lit(k).alias("label"), F.lit(least[k]).alias("least"), ints(r).alias("ranks"), ints(r[: len(r) - least[k] + 1]).alias("prefix")) for k, r in ordered.items()])
    ranks = F.array_sort(F.transform(held, lambda w: F.array_position(_strings(order), w).cast("int") - 1))

    def meets(t: Column, b: Column) -> Column:
        first = F.array_min(F.array_intersect(t["prefix"], b))  # the rarest word that both hold, if it lies in the prefix
        left = lambda x: F.size(x) - F.array_position(x, first).cast("int") + 1
        return (F.size(b) >= t["least"]) & first.isNotNull() & (F.least(left(b), left(t["ranks"])) >= t["least"]) & (F.size(F.array_intersect(b, t["ranks"])) >= t["least"])

    def of(b: Column) -> Column:
        return F.transform(F.filter(templates, lambda t: meets(t, b)), lambda t: F.struct(t["label"].alias("label"), (F.size(F.array_intersect(b, t["ranks"])) / F.size(t["ranks"])).alias("containment")))

    return F.flatten(F.transform(F.array(ranks), of))


def _scanned(docs: DataFrame, templates: dict[str, str] | None, threshold: float) -> DataFrame:
    """The columns of ``_split`` with the blocks that meet a template, as (block, met)."""
    templates = TEMPLATES if templates is None else templates
    sets = {k: s for k, t in templates.items() if (s := word_set(t))}
    longest = max((len(re.split(GAP, t)) for t in templates.values()), default=0)
    least = {k: math.ceil(threshold * len(s) - 1e-9) for k, s in sets.items()}
    vocabulary = sorted(set().union(*sets.values()))
    rows = written(_split(docs, vocabulary, min(least.values(), default=1), max(BLOCK_WORDS, 2 * longest)))
    if not sets:
        return rows.withColumn("blocks", F.lit(None).cast("array<struct<block:int,met:array<struct<label:string,containment:double>>>>"))
    order = word_order(rows, vocabulary)
    blocks = F.transform("blocks", lambda b: F.struct(b["block"].alias("block"), _met(b["held"], order, sets, least).alias("met")))
    return rows.withColumn("blocks", F.filter(blocks, lambda b: F.size(b["met"]) > 0))


def find_blocks(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """All (doc_id, block, label, containment) with a containment of at least ``threshold``; ``block`` is the block's first word.

    Repeated rows give repeated results; null, empty and letterless texts and an empty table none; null ids stay null.
    """
    return _scanned(docs, templates, threshold).select("doc_id", F.inline("blocks")).select("doc_id", "block", F.inline("met"))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Licenses named in or quoted by every whole text.

    Columns: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score. A null or empty text has no
    words, no labels and score 0. The score is 1 where a phrase names a license, else the largest containment.
    One row for each input row; equal rows get equal results; null ids stay null; an empty table gives no rows; other columns are left out. No shuffle but of the words' counts.
    """
    rows = _scanned(docs, templates, threshold)
    places = {p: f"at_{i}" for i, p in enumerate(PHRASES)}
    every = F.concat(*places.values())
    named = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(F.size(c) > 0, F.lit(PHRASES[p])) for p, c in places.items()]), lambda x: x.isNotNull())))
    met = F.coalesce(F.flatten(F.transform("blocks", lambda b: b["met"])), F.array().cast("array<struct<label:string,containment:double>>"))
    rows = rows.select("doc_id", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), named.alias("named"), met.alias("met"))
    labels = F.array_sort(F.array_union("named", F.transform("met", lambda m: m["label"])))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("met", lambda m: m["containment"])), F.lit(0.0)))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("named", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))

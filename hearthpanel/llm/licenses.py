"""License scans by diagonal voting.

All rolling word k-grams of the documents are joined to their positions in license templates. Matches of
one copy of a template lie on one diagonal (word place in the document minus place in the template);
diagonals that lie next to each other, as after an inserted or lost word, are merged, and a merged span
is verified against the template's length and order.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthpanel.llm.quality_rules import bound
from hearthpanel.llm.store import saved

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GRAM = 4
GAP = 6
"""Diagonals at most this far apart, or a third of the template if that is less, belong to one span."""
LEAST_SCORE = 0.6

# Phrases with their labels, and public notices that name a license, in usual wording.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("mit", "Released under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
               "compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
            "(at your option) any later version."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
             "General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights"),
]


def words_of(text: Column) -> Column:
    """Words of a whole text, A-Z lower-cased; null counts as empty."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _places(words: Column, joined: Column, phrase: str) -> Column:
    """Ascending start words of a phrase; the words are looked through only where the joined text has it."""
    parts = phrase.split()
    target = F.array(*[F.lit(p) for p in parts])
    starts = bound(words, lambda w: F.filter(F.sequence(F.lit(0), F.size(w) - len(parts)),
                                             lambda i: F.slice(w, i + 1, len(parts)) == target))
    return F.coalesce(F.when(F.contains(joined, F.lit(f" {phrase} ")), starts), F.array().cast("array<int>"))


def _template_grams(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """Template number, label, its number of grams, and each gram with its place."""
    split = re.compile(WORD).findall
    rows = []
    for number, (label, text) in enumerate(templates):
        words = split(text.translate(str.maketrans(UPPER, LOWER)))
        size = min(GRAM, len(words))
        grams = [words[i:i + size] for i in range(len(words) - size + 1)]
        if size < GRAM:
            raise ValueError(f"a template needs {GRAM} words: {text}")
        rows += [(number, label, len(grams), place, gram) for place, gram in enumerate(grams)]
    return spark.createDataFrame(rows, "template int, label string, grams int, place int, gram array<string>")


def matched_spans(keyed: DataFrame, keys: list[str], templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Verified spans of templates in rows that have `keys` and an array `words`.

    Returns keys, label, template, first_word, last_word (of the span, inclusive) and score: the share of
    the template's grams found in the span. A span is verified where the score is at least LEAST_SCORE and it
    is at most half as long again as the template plus GAP.
    The template table is a constant of the library, so it can be broadcast.
    """
    grams = bound(F.col("words"), lambda w: F.when(F.size(w) >= GRAM, F.transform(
        F.sequence(F.lit(1), F.size(w) - GRAM + 1), lambda i: F.xxhash64(F.slice(w, i, GRAM)))))
    known = _template_grams(keyed.sparkSession, templates).select(
        "template", "label", "grams", "place", F.xxhash64("gram").alias("hash"))
    spread = keyed.select(*keys, F.posexplode(grams).alias("at", "hash"))
    votes = spread.join(F.broadcast(known), "hash").select(
        *keys, "template", "label", "grams", "place", "at", (F.col("at") - F.col("place")).alias("diagonal")).distinct()
    lines = votes.groupBy(*keys, "template", "label", "grams", "diagonal").agg(
        F.count(F.lit(1)).alias("votes"), F.min("at").alias("first"), F.max("at").alias("last"))
    # Diagonals of one copy lie close to each other, those of another copy a template's length away.
    order = Window.partitionBy(*keys, "template").orderBy("diagonal")
    near = F.least(F.lit(GAP), F.greatest(F.lit(1), F.floor(F.col("grams") / 3)))
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > near, F.lit(True))
    merged = (lines.withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(order))
              .groupBy(*keys, "template", "label", "grams", "span")
              .agg(F.sum("votes").alias("votes"), F.min("first").alias("first_word"),
                   (F.max("last") + GRAM - 1).alias("last_word")))
    score = F.least(F.lit(1.0), F.col("votes") / F.col("grams"))
    long = F.col("last_word") - F.col("first_word") + 1 > 1.5 * (F.col("grams") + GRAM - 1) + GAP
    return (merged.withColumn("score", score).filter((F.col("score") >= LEAST_SCORE) & ~long)
            .select(*keys, "label", "template", "first_word", "last_word", "score"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: what licenses its whole text names or quotes.

    Returns `key`, n_words, n_base (places where a phrase's words stand together), first_word and
    last_word (smallest and largest such start, from 0; null without), base_labels, labels (with those
    of verified template spans; both distinct, sorted, comma-joined, empty without) and score (the best
    verified template score, 0.0 without).

    Null or empty text: no words, no labels. Rows that are equal in key and text share the spans found
    for them, each keeps its own row. Null keys are fine. Other columns are ignored. No rows give no rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.col(key).alias("id"), words_of(F.col(text)).alias("words"),
                        F.xxhash64(body).alias("print"), F.hash(body).alias("print_2"))
    keys = ["id", "print", "print_2"]
    joined = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    places = keyed.withColumn("joined", joined).select(*keys, F.size("words").cast("bigint").alias("n_words"), *[
        _places(F.col("words"), F.col("joined"), phrase).alias(f"at_{i}") for i, phrase in enumerate(PHRASES)])
    every = F.concat(*[F.col(f"at_{i}") for i in range(len(PHRASES))])
    named = F.array_compact(F.array(*[F.when(F.size(f"at_{i}") > 0, F.lit(label)) for i, label in enumerate(PHRASES.values())]))
    base = places.select(*keys, "n_words", F.size(every).cast("bigint").alias("n_base"),
                         F.array_min(every).cast("bigint").alias("first_word"),
                         F.array_max(every).cast("bigint").alias("last_word"),
                         F.array_sort(F.array_distinct(named)).alias("names"))
    # The few spans are a small table of known size, so the engine can choose how to join them.
    spans = saved(matched_spans(keyed, keys).groupBy(*keys).agg(
        F.collect_set("label").alias("quoted"), F.max("score").alias("score")), "spans")
    spans = spans.select(F.col("id").alias("id_2"), F.col("print").alias("p"), F.col("print_2").alias("p_2"), "quoted", "score")
    both = base.join(spans, F.col("id").eqNullSafe(F.col("id_2")) & (F.col("print") == F.col("p"))
                     & (F.col("print_2") == F.col("p_2")), "left")
    none = F.array().cast("array<string>")
    return both.select(
        F.col("id").alias(key), "n_words", "n_base", "first_word", "last_word",
        F.array_join("names", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("names", F.coalesce("quoted", none)))), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))

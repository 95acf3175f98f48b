"""Licence scan with a positional index of rare tokens, in DataFrame functions only.

The templates are short licence notices. Their words are weighted by inverse template frequency, and
the rare ones are indexed with (template, position). All of them that stand in a text are looked up;
each occurrence at place p of a word at template position q votes for the template to
start at p - q, so postings are intersected by relative position. A template with enough votes for
one start gives its label when all its mandatory phrases stand in the text. The score is the largest
share of a template's rare tokens that agree on one start, over templates whose phrases were found.

Phrases of the base labels are found directly, word by word.

Only texts that may hold a mandatory phrase are exploded, and only those and votes are shuffled; the index is a table of
constant size. Votes are partly aggregated, so a very long text is spread like many short ones.

Cases: null and empty texts have no words and no labels; repeated rows get equal results; rows
without doc_id are scanned like others; equal votes for two starts count once; other columns are not
returned; empty input gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Word characters, base phrases with their labels, licence notices and the phrases each must have.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
TEMPLATES = [
    ("apache-2", "Licensed under the Apache License, Version 2.0", ["apache license"]),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
     "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ["apache license", "in compliance with the license"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
     ["redistribution and use in source and binary forms"]),
    ("cc-by", "Licensed under CC BY 4.0", ["cc by 4"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ["cc by nc"]),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ["cc by sa"]),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2", ["gnu general public license", "version 2"]),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3", ["gnu general public license", "version 3"]),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
     "the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ["gnu general public license", "either version 3"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
     "copyright notice and this permission notice appear in all copies", ["for any purpose with or without fee"]),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License", ["gnu lesser general public license"]),
    ("mit", "Released under the MIT License", ["mit license"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the "
     "Software without restriction", ["permission is hereby granted free of charge"]),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
]
#: Words in more than this share of the templates are not indexed.
MAX_TEMPLATE_SHARE = 0.34
#: Share of a template's rare tokens that must agree on one start.
MIN_SHARE = 0.6


def template_words(text: str) -> list[str]:
    return re.findall(WORD, text.translate({ord(u): l for u, l in zip(UPPER, LOWER)}))


class TemplateIndex:
    """Words by falling weight, and their (template, position) postings."""

    def __init__(self, templates: list[tuple[str, str, list[str]]] | None = None):
        self.templates = TEMPLATES if templates is None else templates
        words = [template_words(text) for _, text, _ in self.templates]
        frequency = Counter(w for ws in words for w in set(ws))
        weight = {w: math.log(len(words) / n) for w, n in frequency.items() if n <= max(1, MAX_TEMPLATE_SHARE * len(words))}
        self.words = sorted(weight, key=lambda w: (-weight[w], w))
        self.postings: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for t, ws in enumerate(words):
            for q, w in enumerate(ws):
                if w in weight:
                    self.postings[w].append((t, q))
        self.rare = [sum(w in weight for w in ws) for ws in words]
        self.phrases = sorted({p for _, _, ps in self.templates for p in ps})

    def table(self, spark) -> DataFrame:
        """(word, template, position, rare, label, phrases); as many rows as rare tokens in the templates."""
        rows = [(w, t, q, self.rare[t], self.templates[t][0], self.templates[t][2]) for w, posts in self.postings.items() for t, q in posts]
        return spark.createDataFrame(rows, "word string, template int, position int, rare int, label string, phrases array<string>")


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _class(separators: str) -> str:
    """Runs of characters that are not listed. Java matches single listed characters by a table, ranges one by one."""
    return "[^" + "".join(f"\\x{ord(c):02x}" for c in separators) + "]+"


_SEPARATORS = "".join(chr(c) for c in range(128) if not re.fullmatch(WORD, chr(c)))
_LOWER_WORD = _class(_SEPARATORS)
_ANY_WORD = _class("".join(c for c in _SEPARATORS if c not in UPPER))


def words_of(text: Column) -> Column:
    """Words of a text after lower-casing A-Z."""
    full = F.coalesce(text, F.lit(""))
    lowered = F.when(F.octet_length(full) == F.length(full), F.lower(full)).otherwise(F.translate(full, UPPER, LOWER))
    return F.regexp_extract_all(lowered, F.lit(_LOWER_WORD), F.lit(0))


def may_hold(text: Column, phrases: list[str]) -> Column:
    """False only where no phrase can stand: some word of each is not even part of the text."""
    lowered = F.lower(F.coalesce(text, F.lit("")))

    def test(low: Column) -> Column:
        any_phrase = F.lit(False)
        for phrase in phrases:
            here = F.lit(True)
            for word in sorted(set(phrase.split(" ")), key=lambda w: (-len(w), w)):
                here = here & F.contains(low, F.lit(word))
            any_phrase = any_phrase | here
        return any_phrase

    return _let(lowered, test)


def phrase_starts(words: Column, phrase: str) -> Column:
    """Places where the words of a phrase stand consecutively."""
    wanted = phrase.split(" ")

    def here(i: Column) -> Column:
        hit = words[i] == wanted[0]
        for k, w in enumerate(wanted[1:], 1):
            hit = hit & (words[i + k] == w)
        return hit

    places = F.filter(F.sequence(F.lit(0), F.size(words) - len(wanted)), here)
    return F.when(F.size(words) >= len(wanted), places).otherwise(F.array().cast("array<int>"))


def _literal(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def _base(docs: DataFrame) -> DataFrame:
    """Word counts of all texts, and the base phrases of those that may hold one."""
    def find(words: Column) -> Column:
        return F.struct(*[phrase_starts(words, p).alias(f"p{i}") for i, p in enumerate(BASE_PHRASES)])

    none = F.struct(*[F.array().cast("array<int>").alias(f"p{i}") for i in range(len(BASE_PHRASES))])
    found = docs.select("doc_id", F.xxhash64("text").alias("__text"), F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_ANY_WORD), F.lit(0))).cast("bigint").alias("n_words"),
                        F.when(may_hold(F.col("text"), list(BASE_PHRASES)), _let(words_of(F.col("text")), find)).otherwise(none).alias("__p"))
    each = [F.col(f"__p.p{i}") for i in range(len(BASE_PHRASES))]
    places = F.concat(*each)
    labels = [F.when(F.size(p) > 0, F.array(F.lit(label))).otherwise(F.array().cast("array<string>")) for p, label in zip(each, BASE_PHRASES.values())]
    return found.select("doc_id", "__text", "n_words", F.size(places).cast("bigint").alias("n_base"), F.array_min(places).cast("bigint").alias("first_word"),
                        F.array_max(places).cast("bigint").alias("last_word"), F.array_sort(F.array_distinct(F.concat(*labels))).alias("__base"))


def _by_index(docs: DataFrame, index: TemplateIndex) -> DataFrame:
    """(__id, __text, method labels, score) of the texts in which a template was found."""
    rare = _literal(index.words)

    def look_up(words: Column) -> Column:
        """The words, the phrases that stand in them, and the indexed words among them."""
        joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
        found = _let(joined, lambda line: F.filter(_literal(index.phrases), lambda p: F.contains(line, F.concat(F.lit(" "), p, F.lit(" ")))))
        return F.struct(words.alias("words"), found.alias("found"), F.array_intersect(rare, words).alias("rare"))

    near = (docs.where(may_hold(F.col("text"), index.phrases)).select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__text"), "text")
            .dropDuplicates(["__id", "__text"]).select("__id", "__text", F.inline(F.array(_let(words_of(F.col("text")), look_up)))))
    placed = near.where(F.size("found") > 0).select("__id", "__text", F.col("found").alias("__found"), F.col("rare").alias("__rare"), F.posexplode("words").alias("__place", "word"))
    votes = (placed.where(F.array_contains("__rare", F.col("word"))).join(F.broadcast(index.table(docs.sparkSession)), "word")
             .where(F.size(F.array_except("phrases", "__found")) == 0)
             .groupBy("__id", "__text", "label", "template", (F.col("__place") - F.col("position")).alias("__start"))
             .agg(F.count(F.lit(1)).alias("__votes"), F.first("rare").alias("rare")))
    shares = votes.groupBy("__id", "__text", "label").agg(F.max(F.col("__votes") / F.col("rare")).alias("__share"))
    return shares.groupBy("__id", "__text").agg(F.collect_set(F.when(F.col("__share") >= MIN_SHARE, F.col("label"))).alias("__labels"), F.max("__share").alias("score"))


def scan_licenses(docs: DataFrame, index: TemplateIndex | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row of (doc_id, text)."""
    base, method = _base(docs), _by_index(docs, index or TemplateIndex())
    both = base.join(method, base["doc_id"].eqNullSafe(method["__id"]) & (base["__text"] == method["__text"]), "left")
    labels = F.array_sort(F.array_union("__base", F.coalesce("__labels", F.array().cast("array<string>"))))
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("__base", ",").alias("base_labels"),
                       F.array_join(labels, ",").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))

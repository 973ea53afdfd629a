"""License scan by a positional rare-token index (operator 10, DataFrame functions only).

1. Document frequency, over all texts, of every word of the mandatory key phrases.
2. Each template is looked up in every text by its key phrase's word with the highest IDF, however
   frequent that is. Postings (text class, template, position) at which the whole key phrase stands
   are the index.
3. At each posting all words of the template vote on relative position: it stands where enough of
   them agree on one shift near the phrase's own. So neither other notices in the text nor the
   other texts switch a template's result.
4. Base phrases are templates of which every word is mandatory.

The templates are a fixed small table, so they and their word statistics are broadcast.
Every text's result is worked out once per text class (see `common`).

Defined results: null or empty text has no words, no labels, score 0; very long texts only have more
postings; of a template's equally rare words the lesser is looked up; ids may be null or repeated, each
row gives one row; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# The contract's phrases and labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Label, mandatory key phrase, notice text.
TEMPLATES = [
    ("gpl", "general public license", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "general public license", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "lesser general public license", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("apache", "apache license", "Licensed under the Apache License, Version 2.0."),
    ("apache", "apache license", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("mit", "mit license", "Released under the MIT License."),
    ("mit", "permission is hereby granted", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "mozilla public license", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc-by-nc", "cc by nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "cc by sa", "Licensed under CC BY-SA 4.0."),
    ("cc0", "cc0", "Released to the public domain under CC0 1.0."),
    ("all-rights-reserved", "all rights reserved", "All rights reserved."),
]

#: A template stands where at least this share of its words agree on the shift.
LEAST_SHARE = 0.6
#: The shift may differ by so many words from that of the key phrase.
AROUND = 4


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())


def lookups(spark: SparkSession, shares: dict[str, float], templates=TEMPLATES) -> DataFrame:
    """(term, template, base, label, key, key_at, body, offset): templates and base phrases by the key's rarest word.

    `key_at` is the key's place in the body, `offset` the term's in the key.
    """
    rows = []
    for i, (base, label, key, text) in enumerate([(True, label, p, p) for p, label in BASE.items()] + [(False, *t) for t in templates]):
        key, body = words_of(key), words_of(text)
        key_at = next(at for at in range(len(body)) if body[at : at + len(key)] == key)
        term = min(key, key=lambda w: (shares[w], w))
        rows.append((term, i, base, label, key, key_at, body, key.index(term)))
    return spark.createDataFrame(rows, "term string, template int, base boolean, label string, key array<string>, key_at int, body array<string>, offset int")


def document_frequency(docs: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """Share of the texts that have each word of a fixed, short vocabulary."""
    own = F.transform(F.array_distinct(common.contract_words(F.col("text"))), common.lower_ascii)
    seen = docs.select(F.explode(F.array_append(F.array_intersect(own, F.array(*map(F.lit, vocabulary))), F.lit(""))).alias("term"))
    counts = {r["term"]: r["n"] for r in seen.groupBy("term").agg(F.count("*").alias("n")).collect()}  # a row per word of the vocabulary
    return {w: counts.get(w, 0) / max(1, counts.get("", 0)) for w in vocabulary}


def index(docs: DataFrame, looked_up: DataFrame, key_words: int) -> DataFrame:
    """Postings (k1, k2, n_words, template, base, label, pos, share): key phrases (of up to `key_words` words) at pos, share of the template's words that agree.

    A text's last word has a row even if template is null. Only the words around a posting leave the scan.
    """
    words = docs.select(*common.text_key(F.col("text")), common.contract_words(F.col("text")).alias("words"))
    each = words.select("k1", "k2", "words", F.posexplode("words").alias("at", "word")).withColumn("term", common.lower_ascii(F.col("word")))
    pos = F.col("at") - F.col("offset")
    # Without a lambda, which would cut the compiled scan and copy the whole text with every word.
    key_there = F.size("key") > 0
    for j in range(key_words):
        key_there &= (F.size("key") <= j) | F.coalesce(common.lower_ascii(F.get("words", pos + j)) == F.get("key", j), F.lit(False))
    stands = F.coalesce(key_there, F.lit(False))
    found = each.join(F.broadcast(looked_up), "term", "left").filter(stands | (F.col("at") == F.size("words") - 1))
    begin = pos - F.col("key_at")
    first = F.greatest(begin - AROUND, F.lit(0))
    near = F.slice("words", first + 1, F.size("body") + 2 * AROUND)
    own = {"template": F.col("template"), "base": F.col("base"), "label": F.col("label"), "pos": pos, "body": F.col("body"), "near": near, "own_start": begin - first}
    postings = found.select("k1", "k2", F.size("words").cast("long").alias("n_words"), *[F.when(stands, c).alias(n) for n, c in own.items()])

    def agreeing(shift: Column) -> Column:
        return F.size(F.filter(F.sequence(F.lit(0), F.size("body") - 1), lambda i: common.lower_ascii(F.get("near", F.col("own_start") + shift + i)) == F.get("body", i)))

    votes = F.array_max(F.transform(F.sequence(F.lit(-AROUND), F.lit(AROUND)), agreeing))
    share = F.when(F.col("base"), 1.0).when(~F.col("base"), votes / F.size("body"))
    return postings.select("k1", "k2", "n_words", "template", "base", "label", "pos", share.alias("share")).distinct()


def base_places(postings: DataFrame) -> DataFrame:
    """(k1, k2, n_base, first_word, last_word, base_labels) of the texts with base phrases."""
    return postings.filter("base").groupBy("k1", "k2").agg(
        F.count("*").alias("n_base"), F.min("pos").cast("long").alias("first_word"), F.max("pos").cast("long").alias("last_word"), F.array_sort(F.collect_set("label")).alias("base_labels")
    )


def template_matches(postings: DataFrame) -> DataFrame:
    """(k1, k2, labels, share): labels whose template stands in the text."""
    stands = postings.filter(~F.col("base") & (F.col("share") >= LEAST_SHARE))
    return stands.groupBy("k1", "k2").agg(F.collect_set("label").alias("labels"), F.max("share").alias("share"))


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Each row of (doc_id, text) with n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    keys = [key for _, key, _ in templates] + list(BASE)
    shares = document_frequency(docs, sorted({w for key in keys for w in words_of(key)}))
    postings = common.cut(index(docs, lookups(spark, shares, templates), max(len(words_of(key)) for key in keys)))
    found = (
        postings.groupBy("k1", "k2").agg(F.max("n_words").alias("n_words"))
        .join(base_places(postings), ["k1", "k2"], "left")
        .join(template_matches(postings), ["k1", "k2"], "left")
    )
    rows = docs.select("doc_id", *common.text_key(F.col("text"))).join(found, ["k1", "k2"], "left")
    none = F.array().cast("array<string>")
    base, more = F.coalesce("base_labels", none), F.coalesce("labels", none)
    return rows.select(
        "doc_id",
        F.coalesce("n_words", F.lit(0)).alias("n_words"),
        F.coalesce("n_base", F.lit(0)).alias("n_base"),
        "first_word",
        "last_word",
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, more)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).when(F.col("share") > 0, F.least("share", F.lit(1.0))).otherwise(0.0).alias("score"),
    )


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text"))

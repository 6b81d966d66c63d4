"""12. License scan: exact set-similarity join of text blocks with license templates, in DataFrame functions only.

A text's words are the runs of ASCII letters and digits and of all other non-ASCII characters, A-Z lower-cased.
Its blocks are windows of BLOCK words that start every BLOCK / 2 words, so whatever stretch of BLOCK / 2 words lies
whole in one block, and line breaks don't matter. A template T is found in a block B if
    100 * |B and T| >= PERCENT * |T|        (both as sets of words).
The join is exact and compares few pairs:
* tokens are in a global order, rare first, by the number of blocks of the whole corpus that hold them;
* prefix: a block that reaches need(T) = ceil(PERCENT * |T| / 100) shares one of the first |T| - need + 1 tokens of T;
* length: the block has need(T) tokens or more of the templates' vocabulary;
* position: if the first shared token is the p-th of T and the q-th of the block, at most
  1 + min(|T| - p - 1, |B| - q - 1) tokens are shared.
What passes is verified by the whole intersection. Blocks hold only words of the templates' vocabulary (others can't
be shared), which the scan keeps next to each text's base finds in one pass; no text is shuffled.

What is broadcast is the prefix index of the templates, whose size is that of the parameter (MOST_TOKENS at most,
checked), and the join gives a row for each block and template that agree, however many copies a text has.

Base phrases are found word by word at every place. Null and empty texts have no words, no labels and score 0; long
texts are scanned whole. Repeated rows and ids are judged each by itself. An empty table gives an empty result.
Only doc_id and text are read; other columns, whatever their names, don't matter.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomrank.llm.shared import only, written

BLOCK = 64
PERCENT = 90
MOST_TOKENS = 20_000

# Phrases and labels of the base scan.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices by which the licenses are usually stated.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "To the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("gpl", "This work is licensed under the GNU General Public License"),
    ("lgpl", "Licensed under the GNU Lesser General Public License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files"),
    ("mit", "Released under the MIT License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
KELVIN = "K"  # the one other character that lower() turns into an ASCII letter


def template_words(text: str) -> list[str]:
    return [w.lower() for w in re.split(NO_WORD, text) if w]


def text_words(text: Column) -> Column:
    """The words of a text. lower() also changes non-ASCII letters, but none into an ASCII one, which is all that matters here."""
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(KELVIN), F.lit("ß")))
    return F.filter(F.split(plain, NO_WORD), lambda w: w != "")


def places(words: Column, phrase: list[str]) -> Column:
    """Where the phrase's words stand consecutively, ascending."""
    def at(w: Column, i: Column) -> Column:
        fits = w == phrase[0]
        for k, p in enumerate(phrase[1:], 1):
            fits = fits & (F.get(words, i + k) == p)
        return F.when(fits, i.cast("long"))

    none = F.expr("cast(array() as array<bigint>)")
    return F.when(F.array_contains(words, phrase[0]), F.filter(F.transform(words, at), lambda i: i.isNotNull())).otherwise(none)


def scanned(docs: DataFrame, vocabulary: list[str], phrases: dict[str, str] = PHRASES, block: int = BLOCK,
            doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text: row, doc_id, n_words, the base finds, and its blocks as (block, tokens of the vocabulary); written."""
    step = block // 2
    rows = only(docs, doc_id=doc_id, text=text).select("doc_id", text_words(F.col("text")).alias("words"))
    found = rows.select("doc_id", "words", *[places(F.col("words"), p.split()).alias(f"at{k}") for k, p in enumerate(phrases)])
    n = F.size("words")
    starts = F.sequence(F.lit(0), F.greatest(n - step - 1, F.lit(0)), F.lit(step))
    blocks = F.filter(F.transform(starts, lambda s: F.struct(
        (s / step).cast("int").alias("block"),
        F.array_distinct(F.filter(F.slice(F.col("words"), s + 1, F.lit(block)), lambda w: w.isin(vocabulary))).alias("tokens"))),
        lambda b: F.size(b["tokens"]) > 0)
    ats = F.concat(*[F.col(f"at{k}") for k in range(len(phrases))])
    base = F.array_sort(F.array_distinct(F.concat(*[F.when(F.size(f"at{k}") > 0, F.array(F.lit(label))).otherwise(
        F.expr("cast(array() as array<string>)")) for k, label in enumerate(phrases.values())])))
    return written(found.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", n.cast("long").alias("n_words"), F.size(ats).cast("long").alias("n_base"),
        F.array_min(ats).alias("first_word"), F.array_max(ats).alias("last_word"), base.alias("base"), blocks.alias("blocks")), "license-scan")


def block_counts(blocks: DataFrame) -> DataFrame:
    """(token, c): the number of blocks of the corpus that hold the token; as many rows as the vocabulary has words at most."""
    return blocks.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("c"))


def prefix_rows(templates: list[tuple[str, str]], counts: dict[str, int], percent: int = PERCENT) -> list[tuple]:
    """(token, p, size, need, label, template): the prefix tokens of each template in the global order, with the whole template."""
    rows = []
    for label, text in templates:
        tokens = sorted(set(template_words(text)), key=lambda w: (counts.get(w, 0), w))
        need = -(-percent * len(tokens) // 100)
        rows += [(w, p, len(tokens), need, label, tokens) for p, w in enumerate(tokens[:len(tokens) - need + 1])]
    return rows


def containments(blocks: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """(row, block, label, containment) of every block and template that meet the threshold; blocks has (row, block, tokens).

    A pair may come more than once, with the same values.
    """
    counts = {r.token: r.c for r in block_counts(blocks).collect()}  # bounded by the templates' vocabulary
    rows = prefix_rows(templates, counts, percent)
    index = blocks.sparkSession.createDataFrame(rows, "token string, p int, size int, need int, label string, template array<string>")
    order = sorted({w for r in rows for w in r[5]}, key=lambda w: (counts.get(w, 0), w))
    least, firsts = min((r[3] for r in rows), default=1), sorted({r[0] for r in rows})
    open_ = blocks.where((F.size("tokens") >= least) & F.exists("tokens", lambda w: w.isin(firsts)))
    # array_intersect keeps the order of its first array: the block's tokens in the global order
    placed = (open_.select("row", "block", F.array_intersect(F.array(*map(F.lit, order)), F.col("tokens")).alias("tokens"))
              .select("row", "block", "tokens", F.posexplode("tokens").alias("q", "token")))
    met = placed.join(F.broadcast(index), "token").where(
        (F.size("tokens") >= F.col("need"))
        & (1 + F.least(F.col("size") - F.col("p") - 1, F.size("tokens") - F.col("q") - 1) >= F.col("need")))
    shared = F.size(F.array_intersect("tokens", "template"))
    return (met.withColumn("shared", shared).where(F.col("shared") >= F.col("need"))
            .select("row", "block", "label", (F.col("shared") / F.col("size")).alias("containment")))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, percent: int = PERCENT,
         block: int = BLOCK, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the greatest containment of a template found, 1 if a base phrase stands, else 0. A template may have
    block / 2 words at most (so that its notice lies whole in a block) and all together MOST_TOKENS words.
    """
    sizes = [len(template_words(t)) for _, t in templates]
    if max(sizes, default=0) > block // 2 or sum(sizes) > MOST_TOKENS or 0 in sizes:
        raise ValueError(f"templates must have 1 to {block // 2} words, and {MOST_TOKENS} together at most")
    texts = scanned(docs, sorted({w for _, t in templates for w in template_words(t)}), phrases, block, doc_id, text)
    blocks = texts.select("row", F.inline("blocks"))
    found = (containments(blocks, templates, percent).groupBy(F.col("row").alias("of"))
             .agg(F.collect_set("label").alias("more"), F.max("containment").alias("most")))
    base = F.col("base")
    labels = F.array_sort(F.array_union(base, F.coalesce(F.col("more"), F.expr("cast(array() as array<string>)"))))
    return texts.drop("blocks").join(found, F.col("row") == F.col("of"), "left").select(
        F.col("doc_id").alias(doc_id), "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", base).alias("base_labels"),
        F.concat_ws(",", labels).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("most", F.lit(0.0))).alias("score"))

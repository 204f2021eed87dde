"""Licence scan: exact set-similarity join of text blocks with licence templates, in DataFrame operations only.

Blocks are the lines of a text and, for notices wrapped over several lines, overlapping runs of words across lines; tokens
are their different words.  A block meets a template if it holds at least ``threshold``
of the template's tokens.  Tokens are put in global frequency order (rarest first, counted over all blocks).  Then only
blocks that share a token within both prefixes can reach the needed overlap (prefix filter), if they have enough tokens
(length filter) and enough are left after the shared place on both sides (positional filter); these are verified in full.
Overlap counts template words alone, so blocks are cut down to those before anything moves.  In a run across lines the
overlap is that of the best stretch of as many words as the template has, so words scattered over lines do not add up.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases whose words stand consecutively, and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Licence notices as commonly written, by label.  A parameter: pass a longer list for other licences.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "lesser general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("public-domain", "this work has been released into the public domain"),
    ("reserved", "all rights reserved"),
)
THRESHOLD = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain(text: Column) -> Column:
    """Lower-case A-Z; anything but digits, letters and characters from 0x80 on becomes a blank; lines stay apart."""
    return F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+", " ")


def _blanks(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" ")))


def phrase_columns(padded: Column, phrases=PHRASES) -> dict[str, Column]:
    """n_words, n_base, first_word, last_word, base labels (array) of ``padded``: the words with one blank before, between and after them."""
    n_words = F.when(padded == "  ", 0).otherwise(_blanks(padded) - 1).cast("long")
    places, first, last, labels = F.lit(0).cast("long"), [], [], []
    for phrase, label in phrases:
        there = padded.contains(f" {phrase} ")
        many = F.when(there, F.regexp_count(padded, F.lit(f" {phrase}(?= )"))).otherwise(0)
        places = places + many.cast("long")
        first.append(F.when(there, _blanks(F.substring_index(padded, f" {phrase} ", 1)).cast("long")))
        last.append(F.when(there, n_words - _blanks(F.substring_index(padded, f" {phrase} ", -1)) - len(phrase.split())))
        labels.append(F.when(there, F.lit(label)))
    return {"n_words": n_words, "n_base": places, "first_word": F.least(*first), "last_word": F.greatest(*last), "_base": F.array_compact(F.array(*labels))}


def blocks(docs: DataFrame, key: str = "_key", text: str = "_plain") -> DataFrame:
    return docs.select(key, F.explode(F.split(text, "\n")).alias("_block"))


def runs_across_lines(docs: DataFrame, words: int, rare: list[str], key: str = "_key", text: str = "_plain") -> DataFrame:
    """Blocks of 2 x ``words`` words, one every ``words`` words: each stretch of ``words`` words is whole in one of them.

    Only of texts with several lines that have one of the words ``rare``.
    """
    many = docs.filter(F.col(text).contains("\n")).select(key, F.split(F.trim(F.regexp_replace(text, r"[ \n]+", " ")), " ").alias("_words"))
    own = many.filter(F.arrays_overlap("_words", F.array(*map(F.lit, rare))))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_words") - words), F.lit(words))
    return own.select(key, F.explode(F.transform(starts, lambda i: F.array_join(F.slice("_words", i, 2 * words), " "))).alias("_block"))


def _ordered_tokens(vocabulary: list[str]) -> Column:
    """The different words of a block that templates have, in the order of ``vocabulary``."""
    return F.array_intersect(F.array(*map(F.lit, vocabulary)), F.split("_block", " "))


def token_counts(lines: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Number of blocks that hold each template word, over all blocks; as many rows as templates have words."""
    rows = lines.select(F.explode(_ordered_tokens(vocabulary)).alias("t")).groupBy("t").count().collect()
    return {w: 0 for w in vocabulary} | {r["t"]: r["count"] for r in rows}


def template_matches(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """_key, label, containment of every (block, template) of ``docs`` (_key, _plain) that reaches the threshold (a pair may come more than once)."""
    spark, lines = docs.sparkSession, blocks(docs)
    sets = [(label, sorted(set(text.split())), len(text.split())) for label, text in templates]
    vocabulary = sorted({w for _, ws, _ in sets for w in ws})
    counts = token_counts(lines, vocabulary)
    order = sorted(vocabulary, key=lambda w: (counts[w], w))
    rank = {w: i for i, w in enumerate(order)}
    prefixes = []
    for label, ws, long in sets:
        ws = sorted(ws, key=rank.__getitem__)
        need = math.ceil(threshold * len(ws) - 1e-9)
        prefixes += [(w, label, i, len(ws), need, ws, long) for i, w in enumerate(ws[: len(ws) - need + 1])]
    side = F.broadcast(spark.createDataFrame(prefixes, "_t string, label string, _i int, _size int, _need int, _all array<string>, _long int"))  # as large as the template list
    least = min(p[4] for p in prefixes)
    n = F.size("_tokens")

    def met(rows: DataFrame, *more: str) -> DataFrame:
        own = rows.select("_key", *more, _ordered_tokens(order).alias("_tokens")).filter(F.size("_tokens") >= least)
        prefix = own.select("_key", *more, "_tokens", F.posexplode("_tokens").alias("_j", "_t"))
        near = prefix.join(side, "_t").filter((n >= F.col("_need")) & (F.col("_j") <= n - F.col("_need")) & (F.least(F.col("_size") - F.col("_i"), n - F.col("_j")) >= F.col("_need")))
        return near.withColumn("_overlap", F.size(F.array_intersect("_tokens", "_all"))).filter(F.col("_overlap") >= F.col("_need"))

    across = met(runs_across_lines(docs, max(p[6] for p in prefixes), sorted({p[0] for p in prefixes})), "_block").withColumn("_w", F.split("_block", " "))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_w") - F.col("_long") + 1))
    stretch = F.array_max(F.transform(starts, lambda i: F.size(F.array_intersect(F.slice("_w", i, F.col("_long")), F.col("_all")))))
    whole = across.withColumn("_overlap", stretch).filter(F.col("_overlap") >= F.col("_need"))
    columns = ("_key", "label", (F.col("_overlap") / F.col("_size")).alias("containment"))
    return met(lines).select(*columns).unionByName(whole.select(*columns))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", templates=TEMPLATES, threshold: float = THRESHOLD, phrases=PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (1 with a base phrase, else the best containment found, else 0).

    A null text is an empty one: no words, no labels, score 0.  Rows are told apart by key (null is a key too) and
    text.  An empty table gives an empty result.  Other columns are not read.
    """
    one = docs.select(F.col(key).alias("_k"), plain(F.col(text)).alias("_plain")).select(F.struct("_k", F.xxhash64("_plain").alias("_h")).alias("_key"), "_plain")
    found = template_matches(one, templates, threshold).groupBy("_key").agg(F.collect_set("label").alias("_found"), F.max("containment").alias("_best"))
    padded = one.select("_key", F.concat(F.lit(" "), F.trim(F.regexp_replace("_plain", r"[ \n]+", " ")), F.lit(" ")).alias("_padded"))
    base = padded.select("_key", *(c.alias(n) for n, c in phrase_columns(F.col("_padded")).items()))
    hits = found.select(F.col("_key._k").alias("_other"), F.col("_key._h").alias("_other_text"), "_found", "_best")
    met = base.join(hits, F.col("_key._k").eqNullSafe(F.col("_other")) & (F.col("_key._h") == F.col("_other_text")), "left")
    all_labels = F.array_union("_base", F.coalesce("_found", F.array().cast("array<string>")))
    comma = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_best", F.lit(0.0)))
    return met.select(F.col("_key._k").alias(key), "n_words", "n_base", "first_word", "last_word", comma(F.col("_base")).alias("base_labels"), comma(all_labels).alias("labels"), score.alias("score"))

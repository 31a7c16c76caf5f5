"""License scan by an exact set-similarity join, in DataFrame operations only.

A block is a window of consecutive words, over line ends and sentence ends, as long as
the template's text and a quarter more. It meets the template if it holds at least
``threshold`` of the template's distinct words, and as large a share of its telling words
(those that no other label's templates have), so that words that all notices share don't
make a license. The join is exact: template words are put into one global order, by the
number of documents that have them, rarest first; a text is a candidate only if it shares
a word of the template's prefix and of its own prefix (prefix filter), has enough template
words (length filter), and enough of both orders is left from the shared word on
(positional filter). Every window of a candidate is verified by intersection.

Phrases are found word by word in whole texts beside that (the base labels). All texts
are read once; the words of those that can hold a notice are kept for the join.

The templates are a parameter of fixed size: what is broadcast is their words.

Defined results: a null or empty text has no words and no labels; a text of any length is
read whole; repeated rows give repeated results, tied ids are told apart by their texts;
an empty table gives an empty one; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .words import count_words, spaced, word_array

#: Phrases whose places are counted, with their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: A window is so much longer than the template's text.
WIDER = 1.25

#: Label -> texts of license notices.
TEMPLATES = {
    "apache": ["Licensed under the Apache License, Version 2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial license"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike license"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License"],
    "mit": ["Released under the MIT License", "Licensed under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License"],
}


@dataclass(frozen=True)
class Template:
    label: str
    words: frozenset[str]
    need: int
    telling: frozenset[str]
    need_telling: int
    width: int


def template_rows(templates: dict[str, list[str]], threshold: float) -> list[Template]:
    cut = {label: [re.findall(r"[0-9a-z\x80-\U0010FFFF]+", t.lower()) for t in texts] for label, texts in templates.items()}
    held = {label: set().union(*map(set, texts)) if texts else set() for label, texts in cut.items()}
    out = []
    for label in sorted(cut):
        others = set().union(*(w for x, w in held.items() if x != label))
        for words in filter(None, cut[label]):
            own, telling = frozenset(words), frozenset(words) - others
            out.append(Template(label, own, least(threshold, len(own)), telling, least(threshold, len(telling)), math.ceil(len(words) * WIDER)))
    return out


def least(threshold: float, n: int) -> int:
    return math.ceil(threshold * n - 1e-9)


def literals(words: list[str]) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def read_once(docs: DataFrame, rows: list[Template], id_col: str, text_col: str, phrases: dict[str, str]) -> DataFrame:
    """A row for each document: base columns, its template words, and all its words where they can hold a notice."""
    s = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), spaced(text_col).alias("s"))
    found = {label: phrase_counts(F.col("s"), phrase) for phrase, label in phrases.items()}
    vocabulary = sorted(set().union(*(r.words for r in rows))) if rows else []
    base = s.select(
        "id",
        "text_key",
        count_words(F.col("s")).alias("n_words"),
        sum((x[0] for x in found.values()), F.lit(0).cast("long")).alias("n_base"),
        F.array_min(F.array(*(x[1] for x in found.values()))).alias("first_word") if found else F.lit(None).cast("long").alias("first_word"),
        F.array_max(F.array(*(x[2] for x in found.values()))).alias("last_word") if found else F.lit(None).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(x[0] > 0, label) for label, x in found.items()))))).alias("base") if found else literals([]).alias("base"),
        word_array(F.col("s")).alias("words"),
    )
    base = base.withColumn("held", F.array_intersect(literals(vocabulary), "words"))
    hopeful = F.lit(False)
    for r in rows:
        hopeful = hopeful | (F.size(F.array_intersect("held", literals(sorted(r.words)))) >= r.need)
    return staged(base.withColumn("words", F.when(hopeful, F.col("words"))), "licenses")


def matched(read: DataFrame, rows: list[Template]) -> DataFrame:
    """(id, text_key, label, score, start, block): each text and label that meet, with the best window and its first word."""
    counts = {r["w"]: r["n"] for r in read.select(F.explode("held").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}  # a count for each template word
    order = sorted(set().union(*(r.words for r in rows)), key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    fewest = min(r.need for r in rows)
    side = []
    for n, r in enumerate(rows):
        ranked = sorted(r.words, key=rank.get)
        side += [(w, n, r.label, p, len(ranked), r.need, ranked, sorted(r.telling), r.need_telling, r.width) for p, w in enumerate(ranked[: len(ranked) - r.need + 1])]
    side = read.sparkSession.createDataFrame(side, "word string, template int, label string, p int, size int, need int, sought array<string>, telling array<string>, need_telling int, width int")
    texts = read.where("words IS NOT NULL").select("id", "text_key", "words", F.array_intersect(literals(order), "held").alias("held"))
    probes = texts.select("*", F.posexplode(F.expr(f"slice(held, 1, greatest(size(held) - {fewest} + 1, 0))")).alias("q", "word"))
    pairs = probes.join(F.broadcast(side), "word")
    held = F.size("held")
    pairs = pairs.where((held >= F.col("need")) & (F.least("p", "q") + 1 + F.least(F.col("size") - F.col("p") - 1, held - F.col("q") - 1) >= F.col("need")))
    # of the words that a text and a template share in their prefixes, the first stands for the pair
    pairs = pairs.where(F.get(F.array_intersect("sought", "held"), F.lit(0)) == F.col("word"))
    # a window that meets the template begins at one of its words, if it is moved on to the first
    starts = "filter(sequence(0, size(words) - 1), i -> array_contains(sought, words[i]))"
    windows = f"transform({starts}, i -> named_struct('i', i, 'met', array_intersect(sought, slice(words, i + 1, width))))"
    good = "x -> size(x.met) >= need AND size(array_intersect(x.met, telling)) >= need_telling"
    best = F.expr(f"array_max(transform(filter({windows}, {good}), x -> named_struct('n', size(x.met), 'at', -x.i)))")
    pairs = pairs.withColumn("best", best).where("best IS NOT NULL")
    block = F.array_join(F.expr("slice(words, 1 - best.at, width)"), " ")
    pairs = pairs.select("id", "text_key", "label", F.struct((F.col("best.n") / F.col("size")).alias("score"), "best.at", block.alias("block")).alias("best"))
    top = pairs.groupBy("id", "text_key", "label").agg(F.max("best").alias("best"))
    return top.select("id", "text_key", "label", "best.score", (-F.col("best.at")).alias("start"), "best.block")


def notices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None, threshold: float = 0.8) -> DataFrame:
    """(id, label, score, start, block) of every notice that a document holds: its best window, whose first word is number ``start``."""
    rows = template_rows(TEMPLATES if templates is None else templates, threshold)
    return matched(read_once(docs, rows, id_col, text_col, {}), rows).drop("text_key").withColumnRenamed("id", id_col)


def phrase_counts(s: Column, phrase: str) -> tuple[Column, Column, Column]:
    """Places of a phrase in a ``spaced`` string: how many, the first and the last start."""
    sought, k = F.lit(" " + phrase.replace(" ", "  ") + " "), len(phrase.split())
    there = F.contains(s, sought)
    n = (F.octet_length(s) - F.octet_length(F.replace(s, sought, F.lit("")))) / F.octet_length(sought)
    first = count_words(F.substring_index(s, " " + phrase.replace(" ", "  ") + " ", 1))
    last = count_words(s) - count_words(F.substring_index(s, " " + phrase.replace(" ", "  ") + " ", -1)) - k
    return F.when(there, n).otherwise(0).cast("long"), F.when(there, first), F.when(there, last)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, templates: dict[str, list[str]] | None = None, threshold: float = 0.8) -> DataFrame:
    """Words, phrase places, labels and the best containment of every row."""
    rows = template_rows(TEMPLATES if templates is None else templates, threshold)
    read = read_once(docs, rows, id_col, text_col, PHRASES if phrases is None else phrases)
    out = read.drop("words", "held")
    if rows:
        more = matched(read, rows).groupBy(F.col("id").alias("i"), F.col("text_key").alias("k")).agg(F.collect_set("label").alias("more"), F.max("score").alias("score"))
        out = out.join(more, F.col("id").eqNullSafe(F.col("i")) & (F.col("text_key") == F.col("k")), "left")
    else:
        out = out.withColumns({"more": literals([]), "score": F.lit(0.0)})
    labels = F.array_sort(F.array_union("base", F.coalesce("more", literals([]))))
    return out.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base").alias("base_labels"), F.concat_ws(",", labels).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))

"""License scans: an exact set-similarity join of text blocks and notice templates.

A block is a run of lines without a blank line between; a template matches a block if the block
holds at least ``THRESHOLD`` of the template's distinct words. ``matches`` gives every such pair.
A label goes to a document if a block matches its template and also holds the template's
``MARKS``, the words without which it would be another notice. The join is exact:

* tokens are ordered by the documents they occur in, rarest first, counted over all
  documents (only template tokens can match, so only they are counted);
* prefix filter: a block that holds at least ``need`` of a template's tokens holds one of
  its ``size - need + 1`` rarest; only those are indexed;
* length filter: such a block has at least ``need`` template tokens at all;
* positional filter: when the first common token stands at i in the template and at j in the
  block, at most ``1 + min(size - i, tokens - j) - 1`` tokens are common (both in that order);
* what passes is counted in full.

Beside it, ``PHRASES`` are looked for word by word. Spark expressions only.

Defined results: a null or empty text has no words, places or labels and a score of 0; the
score is 1 where a phrase stands, else the best containment of a template found, else 0;
labels are distinct, sorted and comma-joined, empty if there are none; repeated rows get a
row each; an empty table gives an empty result. A text of any length is one row's work, and blocks
are numbered from 0 within it.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, functions as F

from ._words import GAP, LOWER, UPPER, lower_ascii, words
from ._work import Work

THRESHOLD = 0.8
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# The usual wording of well-known license notices, and a label for each.
TEMPLATES = (
    ("agpl-notice", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0-notice", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-notice", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc-notice", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit-release", "Released under the MIT License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
# The words that tell a notice from others that share most of its wording.
MARKS = {
    "agpl-notice": ("affero",), "apache-2.0": ("apache",), "cc-by-4.0": ("commons", "attribution"), "cc-by-nc-4.0": ("cc", "nc"), "cc-by-sa-4.0": ("cc", "sa"),
    "gpl-3.0": ("gnu", "general"), "gpl-notice": ("gnu", "general"), "mit-release": ("mit",), "mpl-2.0": ("mozilla",), "unlicense": ("unencumbered",),
}
BLANK_LINE = r"\n[\x20\x09-\x0D]*\n"


def template_tokens(text: str) -> list[str]:
    return sorted({w for w in re.split(GAP, text.translate(str.maketrans(UPPER, LOWER))) if w})


def need_of(size: int, threshold: float) -> int:
    """Tokens that a block must share with a template of this size."""
    return max(1, math.ceil(round(threshold * size, 9)))


def _joined(work: Work, docs: DataFrame, keep: list[str], templates, threshold: float, phrases, marks: dict) -> tuple[DataFrame, DataFrame]:
    """(rows as written, every match of theirs: row, block, label, share, marked)."""
    tokens = {label: template_tokens(text) for label, text in templates}
    vocabulary = sorted({t for ts in tokens.values() for t in ts})
    present = F.array_intersect(words(F.col("text")), F.array(*[F.lit(t) for t in vocabulary]))
    counted = docs.select("text").select(F.explode(present).alias("token")).groupBy("token").count()
    frequency = {r["token"]: r["count"] for r in counted.collect()}  # at most a row for each template token
    order = sorted(vocabulary, key=lambda t: (frequency.get(t, 0), t))
    place = {t: i for i, t in enumerate(order)}
    index = []
    for label, ts in tokens.items():
        need, by_rank = need_of(len(ts), threshold), sorted(ts, key=place.__getitem__)
        index += [(t, label, i, len(ts), need, by_rank) for i, t in enumerate(by_rank[: len(ts) - need + 1])]
    prefix = F.array(*[F.lit(t) for t in sorted({t for t, *_ in index})])

    w = F.col("w")
    base = docs.select(*keep, "text", words(F.coalesce("text", F.lit(""))).alias("w"))
    starts = []
    for phrase, label in phrases:
        parts = phrase.split(" ")
        here = F.filter(F.sequence(F.lit(0), F.size("w") - 1), _stands_in(w, parts))
        starts.append(F.when(F.array_contains(w, parts[0]) & F.array_contains(w, parts[-1]), here).otherwise(F.array().cast("array<int>")).alias(f"at_{label}"))
    ordered = F.array(*[F.lit(t) for t in order])
    blocks = F.transform(F.split(lower_ascii(F.col("text")), BLANK_LINE), lambda b: F.array_intersect(ordered, F.split(b, GAP)))
    blocks = F.when(F.arrays_overlap("w", prefix), blocks)
    rows = base.select(*keep, F.size("w").cast("long").alias("n_words"), *starts, blocks.alias("blocks"))
    rows = work.save(rows.withColumn("row", F.monotonically_increasing_id()), "rows")

    entries = [F.struct(F.lit(t).alias("token"), F.lit(label).alias("label"), F.lit(i).alias("i"), F.lit(size).alias("size"), F.lit(need).alias("need"), F.array(*map(F.lit, ts)).alias("template"), F.array(*map(F.lit, marks.get(label, ()))).cast("array<string>").alias("marks")) for t, label, i, size, need, ts in index]
    lookup = F.broadcast(work.spark.range(1).select(F.inline(F.array(*entries))))  # as many rows as the templates' prefixes have tokens
    blocks = rows.select("row", F.posexplode("blocks").alias("block", "b")).where(F.size("b") > 0)
    probes = blocks.select("row", "block", "b", F.posexplode("b").alias("j", "token")).join(lookup, "token")
    fits = (F.size("b") >= F.col("need")) & (F.least(F.col("size") - F.col("i"), F.size("b") - F.col("j")) >= F.col("need"))
    share = F.size(F.array_intersect("b", "template")) / F.col("size")
    found = probes.where(fits).where(F.size(F.array_intersect("b", "template")) >= F.col("need"))
    marked = F.size(F.array_intersect("b", "marks")) == F.size("marks")
    # A block can meet a template by several prefix tokens.
    return rows, found.select("row", "block", "label", share.alias("share"), marked.alias("marked")).distinct()


def matches(work: Work, docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, marks: dict = MARKS) -> DataFrame:
    """(doc_id, block, label, share, marked): every block that meets a template's threshold, and whether it holds its marks."""
    rows, found = _joined(work, docs, ["doc_id"], templates, threshold, (), marks)
    return rows.select("doc_id", "row").join(found, "row").select("doc_id", F.col("block").cast("long").alias("block"), "label", "share", "marked")


def scan(work: Work, docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, phrases=PHRASES, marks: dict = MARKS) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, found, score); the labels as sorted arrays."""
    rows, found = _joined(work, docs, ["doc_id"], templates, threshold, phrases, marks)
    found = found.where("marked").groupBy("row").agg(F.collect_set("label").alias("found"), F.max("share").alias("best"))
    out = rows.drop("blocks").join(found, "row", "left")
    ats = [F.col(f"at_{label}") for _, label in phrases]
    every = F.concat(*ats)
    labels = F.filter(F.array(*[F.when(F.size(a) > 0, F.lit(label)) for a, (_, label) in zip(ats, phrases)]), lambda x: x.isNotNull())
    return out.select(
        "doc_id", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        F.sort_array(F.array_distinct(labels)).alias("base_labels"), F.sort_array(F.coalesce("found", F.array().cast("array<string>"))).alias("found"),
        F.when(F.size(every) > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def _stands_in(w, parts):
    """A function of i: whether the parts are the words from place i on."""

    def at(i):
        out = F.get(w, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            out = out & F.coalesce(F.get(w, i + k) == part, F.lit(False))
        return out

    return at

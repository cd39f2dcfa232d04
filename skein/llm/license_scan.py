"""License scans: an exact set-similarity join between blocks of words and license templates.

A block is any run of `span` words of a document, which is `SLACK` times the words of the template, so that it goes across lines and what
stands between them. A template is found where a block holds `threshold` of its tokens.

Tokens are ordered by their frequency in the whole corpus, rarest first. A document can hold such a block only if it has `required` of the
template's tokens at all (length filter). In a block that does, the first common token in that order is one of the template's first
`size - required + 1` (prefix filter), so only blocks around those places are looked at; and the tokens from that one on, in the template and
around the place, must make up the overlap (positional filter). What passes is counted exactly, so every block that meets the threshold is
found and no other. DataFrame functions only; texts are split into words once; what is broadcast is bounded by the template list.

Defined results: null text counts as empty (no words, no labels, score 0); null ids stay null, and ids may be of any type; results join back by
a number of each row, and repeated rows get equal results, one each; very long texts are scanned whole; other columns are not read; an empty
table gives an empty table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.tables import cut
from skein.llm.text import ascii_lower, let, words

#: The contract's word class, and its phrases with their labels.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: A block's words, as a multiple of the template's.
SLACK = 1.25

#: Sentences of public licenses and license notices, by label.
TEMPLATES = {
    "agpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-grant": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "cc-by-4.0-work": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl-redistribute": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "lgpl-notice": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mit-notice": "Released under the MIT License",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "no-warranty": "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED",
    "unlicense": "This is free and unencumbered software released into the public domain",
}


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def phrase_places(w: Column, phrases: dict[str, str] = PHRASES) -> Column:
    """struct(n, first, last, labels) of the places where a phrase's words stand consecutively in w, an array<string>."""

    def one(line: Column, phrase: str, label: str) -> Column:
        size = len(phrase.split())
        at = let(
            F.split(line, f"(?<= ){phrase}(?= )"),
            lambda p: F.struct(
                (F.size(p) - 1).cast("long").alias("n"),
                F.when(F.size(p) > 1, _spaces(p[0]) - 1).cast("long").alias("first"),
                F.when(F.size(p) > 1, F.size(w) - size - (_spaces(F.element_at(p, -1)) - 1)).cast("long").alias("last"),
                F.lit(label).alias("label"),
            ),
        )
        none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"), F.lit(label).alias("label"))
        return F.when(F.contains(line, F.lit(f" {phrase} ")), at).otherwise(none)

    return let(F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" ")), lambda line: F.filter(F.array(*[one(line, p, k) for p, k in phrases.items()]), lambda x: x["n"] > 0))


@dataclass(frozen=True)
class Template:
    label: str
    tokens: frozenset[str]
    required: int
    span: int


def templates_of(templates: dict[str, str], threshold: float = 0.9, slack: float = SLACK) -> list[Template]:
    out = []
    for label, x in templates.items():
        own = re.findall(WORD, x.lower())
        out.append(Template(label, frozenset(own), ceil(threshold * len(set(own)) - 1e-9), ceil(slack * len(own))))
    return out


def _literals(x: list[str]) -> Column:
    return F.array(*[F.lit(t) for t in x])


def template_hits(rows: DataFrame, templates: list[Template]) -> DataFrame:
    """(key, label, containment) from rows (key, w, own): w, the words, of documents that may hold a template, else null; own, the template
    tokens that a document has."""
    # one row for each template token, so what comes to the driver is bounded by the template list
    freq = {r["token"]: r["count"] for r in rows.select(F.explode("own").alias("token")).groupBy("token").count().collect()}
    index, whole = [], []
    for t in templates:
        ordered = sorted(t.tokens, key=lambda x: (freq.get(x, 0), x))
        whole.append((t.label, ordered, t.required, t.span))
        index += [(x, t.label, ordered[p:]) for p, x in enumerate(ordered[: len(ordered) - t.required + 1])]
    prefixes = rows.sparkSession.createDataFrame(index, "token string, label string, onward array<string>")
    full = rows.sparkSession.createDataFrame(whole, "label string, tokens array<string>, required int, span int")
    first = _literals(sorted({x[0] for x in index}))

    # each place takes only the words within reach of the longest span along, so the work is linear in a text
    reach = max([t.span for t in templates], default=1)
    places = F.filter(F.transform("w", lambda x, i: F.struct(i.alias("at"), x.alias("token"))), lambda x: F.array_contains(first, x["token"]))
    begin = lambda at: F.greatest(at - reach + 1, F.lit(0))
    near = F.transform(places, lambda x: F.struct(x["at"].alias("at"), x["token"].alias("token"), F.slice("w", begin(x["at"]) + 1, F.lit(2 * reach)).alias("near")))
    pairs = rows.where("w is not null").select("key", F.inline(near)).join(F.broadcast(prefixes), "token").join(F.broadcast(full), "label")
    low, off = F.greatest(F.col("at") - F.col("span") + 1, F.lit(0)), begin(F.col("at"))
    around = F.slice("near", low - off + 1, F.col("at") + F.col("span") - low)
    pairs = pairs.where(F.size(F.array_intersect("onward", around)) >= F.col("required"))
    held = F.array_max(F.transform(F.sequence(low, F.col("at")), lambda start: F.size(F.array_intersect(F.col("tokens"), F.slice("near", start - off + 1, F.col("span"))))))
    pairs = pairs.withColumn("held", held).where("held >= required")
    return pairs.groupBy("key", "label").agg(F.max(F.col("held") / F.size("tokens")).alias("containment"))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = 0.9, slack: float = SLACK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, the phrases' places and labels, all labels, and score (1 at a phrase, else the best containment)."""
    known = templates_of(templates, threshold, slack)
    rows = docs.select(F.col(id_col).alias("doc_id"), words(ascii_lower(F.col(text_col)), WORD).alias("w"))
    rows = rows.select("doc_id", "w", F.size("w").cast("long").alias("n_words"), phrase_places(F.col("w")).alias("at"), F.array_intersect(_literals(sorted({x for t in known for x in t.tokens})), "w").alias("own"))
    able = reduce(lambda a, b: a | b, [F.size(F.array_intersect("own", _literals(sorted(t.tokens)))) >= t.required for t in known])
    # words go on only where some template may be, so the written table is small
    rows = cut(rows.select(F.monotonically_increasing_id().alias("key"), "doc_id", "n_words", "at", "own", F.when(able, F.col("w")).alias("w")))
    hits = template_hits(rows, known).groupBy("key").agg(F.collect_set("label").alias("found"), F.max("containment").alias("containment"))
    out = rows.drop("own", "w").join(hits, "key", "left")
    own = F.transform("at", lambda x: x["label"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return out.select(
        "doc_id",
        "n_words",
        F.aggregate("at", F.lit(0).cast("long"), lambda n, x: n + x["n"]).alias("n_base"),
        F.array_min(F.transform("at", lambda x: x["first"])).alias("first_word"),
        F.array_max(F.transform("at", lambda x: x["last"])).alias("last_word"),
        joined(own).alias("base_labels"),
        joined(F.concat(own, F.coalesce("found", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("at") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )

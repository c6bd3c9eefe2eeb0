r"""License scan: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

Words are runs of letters and digits in lower case; shingles are five words, and a shorter template is one shingle. Each
template belongs to a size class whose windows are up to 1.5 times its length and overlap by so much that any place of the
template lies within one window. If a window holds at least `CONTAINMENT` of a template's shingles, their Jaccard similarity is
at least `least_similarity`; `bands_for` sets the number of single-row bands so that such a window collides with the
template in one of them with probability `RECALL`. A retrieved template is then verified exactly: the share of its
distinct shingles within the window.

A text is looked into only if it holds an anchor. By the pigeonhole principle a window with enough of a template's
shingles holds one of any `n - needed + 1` of them; the anchors are words chosen so that these shingles all have one. The
test for anchors is a plain substring search, so most texts are never cut into words, and windows without an
anchor are never hashed. Templates are a parameter of the job, some thousand at most; only they are broadcast.

Edge cases: null and empty texts have no license; a template without words is left out and templates with equal words are
each reported; a license found at several places is reported with its best containment, ties at the first place; repeated
rows of equal doc_id and text give one row per license; a null doc_id is kept; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.llm.common import table

SHINGLE = 5
CONTAINMENT = 0.8
RECALL = 0.9995
GROWTH, OVERLAP = 1.2, 1.25
SEPARATOR = r"[^\p{L}\p{N}]+"

# License notices as their owners word them.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                         "General Public License as published by the Free Software Foundation, either version 3 of the "
                         "License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                         "General Public License as published by the Free Software Foundation; either version 2 of the "
                         "License, or (at your option) any later version."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the "
                          "GNU Lesser General Public License as published by the Free Software Foundation; either version "
                          "2.1 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def template_words(text: str) -> list[str]:
    """Words of a template, cut as the texts are."""
    return [w for w in re.split(r"[^\w]+|_", text.lower()) if w]


def _shingles(tokens: Sequence[str]) -> list[str]:
    size = min(SHINGLE, len(tokens))
    return list(dict.fromkeys(" ".join(tokens[k:k + size]) for k in range(len(tokens) - size + 1)))


def size_class(n: int) -> int:
    """Class of a template of n words: templates of a class differ by GROWTH in length at most."""
    return max(0, math.ceil(math.log(n / SHINGLE) / math.log(GROWTH) - 1e-9))


def window_of(kind: int) -> tuple[int, int]:
    """Length and step of a class's windows: any run of the class's longest template lies within one."""
    longest = math.ceil(SHINGLE * GROWTH ** kind)
    length = max(longest, math.floor(longest * OVERLAP))
    return length, length - longest + 1


def least_similarity(containment: float = CONTAINMENT) -> float:
    """Jaccard similarity of a template and a window that holds `containment` of it, for the smallest template of a class."""
    least = 1.0
    for kind in range(40):
        length, _ = window_of(kind)
        shortest = max(SHINGLE, math.floor(SHINGLE * GROWTH ** (kind - 1)) + 1) - SHINGLE + 1
        held = math.ceil(containment * shortest)
        least = min(least, held / (length - SHINGLE + 1 + shortest - held))
    return least


def bands_for(recall: float = RECALL, containment: float = CONTAINMENT) -> int:
    """Bands of one row that retrieve a template with the asked probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - least_similarity(containment)))


def anchors(templates: Sequence[Sequence[str]], containment: float = CONTAINMENT) -> list[str]:
    """Words of which every window that holds enough of a template has one, chosen greedily."""
    needs = {}  # per template the shingles that still lack an anchor, and how many may stay without one
    for k, tokens in enumerate(templates):
        rows = [set(s.split(" ")) for s in _shingles(tokens)]
        needs[k] = [rows, math.ceil(containment * len(rows)) - 1]
    chosen: list[str] = []
    while any(len(rows) > spare for rows, spare in needs.values()):
        gain: dict[str, int] = {}
        for rows, spare in needs.values():
            if len(rows) > spare:
                for word in set().union(*rows):
                    gain[word] = gain.get(word, 0) + (min(sum(word in r for r in rows), len(rows) - spare) if len(word) > 4 else 0)
        word = max(gain, key=lambda w: (gain[w], len(w), w))
        chosen.append(word)
        for need in needs.values():
            need[0] = [r for r in need[0] if word not in r]
    return chosen


def _hashes(tokens: Column) -> Column:
    """Hash of the shingle at each place of the text; one shingle if the text is shorter."""
    size = F.least(F.size(tokens), F.lit(SHINGLE))
    starts = F.sequence(F.lit(1), F.greatest(F.size(tokens) - SHINGLE + 1, F.lit(1)))
    return F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(tokens, i, size), " ")))


def _bands(hashes: Column, bands: int) -> Column:
    """Minimum of the shingles' hashes under each band's seed, with the band's number mixed in."""
    def band(k: int) -> Column:
        return F.xxhash64(F.array_min(F.transform(hashes, lambda h: F.xxhash64(F.lit(k), h))), F.lit(k))

    return F.array(*[band(k) for k in range(bands)])


def scan(documents: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, license, template, containment, start, words): per row the licenses of a text, by template number.

    start and words name the window of the best match, in words of the text.
    """
    spark: SparkSession = documents.sparkSession
    known = [(k, name, w) for k, (name, text) in enumerate(templates) if (w := template_words(text))]
    bands = bands_for(containment=containment)
    kinds = sorted({size_class(len(w)) for _, _, w in known})
    marks = anchors([w for _, _, w in known], containment)
    rows = spark.createDataFrame([(k, name, size_class(len(w)), w) for k, name, w in known], "template int, license string, kind int, w array<string>")
    wanted = rows.select("template", "license", "kind", F.array_distinct(_hashes(F.col("w"))).alias("wanted"))
    keys = wanted.select("*", F.explode(_bands(F.col("wanted"), bands)).alias("band"))

    lowered = F.lower(F.coalesce("text", F.lit("")))
    has_anchor = F.lit(False)
    for mark in marks:
        has_anchor |= F.contains(lowered, F.lit(mark))
    tokens = F.array_remove(F.split(lowered, SEPARATOR), "")
    places = F.filter(
        F.transform(F.col("w"), lambda w, i: F.when(F.array_contains(F.array(*[F.lit(m) for m in marks]), w), i)), lambda i: i.isNotNull())
    texts = (
        documents.where(has_anchor).select("doc_id", F.xxhash64("text").alias("text_hash"), tokens.alias("w"))
        .select("doc_id", "text_hash", F.size("w").alias("n"), _hashes(F.col("w")).alias("h"), places.alias("at")).where(F.size("at") > 0)
    )

    def starts(kind: int) -> Column:
        # Windows of the class that hold an anchor: from the first that reaches it to the last that starts before it.
        length, step = window_of(kind)
        first = lambda a: F.greatest(F.lit(0), F.ceil((a - length + 1) / step)).cast("int")
        runs = F.transform(F.col("at"), lambda a: F.transform(F.sequence(first(a), F.floor(a / step).cast("int")), lambda s: s * step))
        return F.transform(F.array_distinct(F.flatten(runs)), lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("start"), F.lit(length).alias("length")))

    windows = (
        texts.select("doc_id", "text_hash", "n", "h", F.explode(F.concat(*[starts(k) for k in kinds])).alias("v"))
        .where("v.start < n")
        .select("doc_id", "text_hash", "v.*", F.array_distinct(F.slice("h", F.col("v.start") + 1, F.col("v.length") - SHINGLE + 1)).alias("held"))
        .where(F.size("held") > 0)
    )
    found = (
        windows.select("*", F.explode(_bands(F.col("held"), bands)).alias("band"))
        .join(F.broadcast(keys), ["band", "kind"])
        .withColumn("containment", F.size(F.array_intersect("held", "wanted")) / F.size("wanted"))
        .where(F.col("containment") >= containment)
    )
    best = F.max(F.struct("containment", (-F.col("start")).alias("order"), "length")).alias("b")
    return found.groupBy("doc_id", "text_hash", "license", "template").agg(best).select(
        "doc_id", "license", "template", F.col("b.containment").alias("containment"), (-F.col("b.order")).alias("start"), F.col("b.length").alias("words"))


def op8_licenses(spark, folder: str) -> DataFrame:
    """Licenses in the whole `documents` table."""
    return scan(table(spark, folder, "documents"))


def oracle(templates: Sequence[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> str:
    """DuckDB SQL of op8_licenses: every window of every text against every template, without MinHash."""
    rows = []
    for k, (name, text) in enumerate(templates):
        tokens = template_words(text)
        length, step = window_of(size_class(len(tokens)))
        rows += [f"({k}, '{name}', {length}, {step}, {len(_shingles(tokens))}, '{s}')" for s in _shingles(tokens)]
    return rf"""
WITH t(template, license, length, step, n, s) AS (VALUES {', '.join(rows)}),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS w FROM documents),
g AS (SELECT r, doc_id, i, array_to_string(w[i + 1:i + {SHINGLE}], ' ') AS s FROM (SELECT *, unnest(range(0, greatest(len(w) - {SHINGLE - 1}, least(len(w), 1)))) AS i FROM d)),
hit AS (SELECT DISTINCT r, doc_id, i, t.* FROM g JOIN t USING (s)),
win AS (SELECT *, unnest(range(greatest(0, ceil((i - (length - {SHINGLE})) / step)::BIGINT), (i // step) + 1)) * step AS start FROM hit),
part AS (SELECT r, doc_id, license, template, length, start, count(DISTINCT s) / any_value(n) AS c FROM win GROUP BY ALL)
SELECT doc_id, license, template::INT AS template, max(c) AS containment, arg_max(start, c * 1e9 - start)::INT AS start, any_value(length)::INT AS words
FROM part WHERE c >= {containment} GROUP BY r, doc_id, license, template
"""

"""License scans: base phrases by their places among a text's words, and an exact set-similarity join of blocks of text with
license templates, in DataFrame functions only.

A block is a window of BLOCK words, one every half block, so any passage of up to BLOCK / 2 + 1 words stands whole in one. A block
matches a template if it holds at least `threshold` of the template's distinct words. Words that no template has can't count, so a block is
its set of template words, in global order: those found in the fewest blocks first. Then
  - length: a block of fewer words than the template needs is left out;
  - prefix: with `need` common words, one of them is among the first size - need + 1 of the template;
  - position: the words behind a common one must suffice for `need`;
what is left is counted in full. Templates are a parameter (a list), so their words, prefixes and frequencies are of bounded size; they alone
are broadcast.

Cases: a null or empty text has no words, no places and no labels, and score 0; repeated rows give a row each; long texts are read
whole; an empty table gives an empty result; other columns, of whatever name, are ignored. Only A-Z are lowered. score is 1 with a base
place, else the largest share of a template that a block holds (0 if none reaches the threshold).
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of letters, digits and anything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK, THRESHOLD = 256, 0.8
#: Most words of all templates together.
MOST_WORDS = 100_000
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
# Passages of published licenses and their usual notices, of at most BLOCK / 2 words each.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."),
    ("cc0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain Dedication along with this software."),
)


def words_of(text: str) -> list[str]:
    return [w.translate(str.maketrans(UPPER, LOWER)) for w in re.findall(WORD, text)]


def needed(size: int, threshold: float) -> int:
    """Least number of common words."""
    return max(1, math.ceil(threshold * size - 1e-9))


def words(text: Column) -> Column:
    one = F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD), F.lit(0))
    # beyond ASCII, lower() would change more than A-Z
    return F.transform(one, lambda w: F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER)))


def places(w: Column, at: Column, phrases: Sequence[tuple[str, str]]) -> Column:
    """Array of (at, label): where a phrase's words stand one after another. at: places of words that begin a phrase."""

    def one(phrase: str, label: str) -> Column:
        parts = words_of(phrase)

        def whole(i: Column) -> Column:
            out = F.get(w, i) == parts[0]
            for k, p in enumerate(parts[1:], 1):
                out = out & (F.get(w, i + k) == p)
            return out

        return F.transform(F.filter(at, whole), lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))

    return F.concat(*(one(*p) for p in phrases))


def blocks(w: Column, vocabulary: list[str], block: int, least: int) -> Column:
    """Array of the distinct template words of each block that has at least `least`."""
    half = block // 2
    marked = F.transform(w, lambda x: F.when(x.isin(vocabulary), x))
    last = F.greatest(F.lit(0), F.ceil((F.size(w) - block) / F.lit(half))).cast("int")
    sets = F.transform(F.sequence(F.lit(0), last), lambda b: F.array_distinct(F.array_compact(F.slice(marked, b * half + 1, block))))
    some = F.size(F.array_compact(marked)) >= least
    return F.when(some, F.filter(sets, lambda s: F.size(s) >= least)).otherwise(F.array().cast("array<array<string>>"))


def scan(df: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, block: int = BLOCK, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word long, base_labels, labels string, score double) of each row of df. phrases and templates: (text, label) and (label, text); a template of no words matches nothing."""
    spark = df.sparkSession
    sets = [(label, list(dict.fromkeys(words_of(t)))) for label, t in templates]
    sets = [(label, s) for label, s in sets if s]
    if sum(len(s) for _, s in sets) > MOST_WORDS:
        raise ValueError(f"templates of more than {MOST_WORDS} words")
    vocabulary = sorted({x for _, s in sets for x in s})
    least = min((needed(len(s), threshold) for _, s in sets), default=1)
    heads = sorted({words_of(p)[0] for p, _ in phrases})
    read = df.select(F.col(f"`{key}`").alias("doc_id"), words(F.col(f"`{text}`")).alias("w"))
    at = F.array_compact(F.transform("w", lambda x, i: F.when(x.isin(heads), i)))
    whole = cut(
        read.select("doc_id", "w", at.alias("at")).select("doc_id", F.size("w").cast("long").alias("n_words"), places(F.col("w"), F.col("at"), phrases).alias("base"), blocks(F.col("w"), vocabulary, block, least).alias("blocks")).withColumn("row", F.monotonically_increasing_id()),
        "licenses",
    )
    found = matches(whole.select("row", F.explode("blocks").alias("block")), sets, threshold, spark)
    labels = F.coalesce("labels", F.array().cast("array<string>"))
    base = F.transform("base", lambda p: p["label"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    starts = F.transform("base", lambda p: p["at"])
    return whole.join(found, "row", "left").select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, labels)).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def matches(blocks: DataFrame, sets: list[tuple[str, list[str]]], threshold: float, spark) -> DataFrame:
    """(row, labels, share) of rows with a block that holds the threshold of a template. blocks: (row, block array of template words)."""
    often = {r["word"]: r["n"] for r in blocks.select(F.explode("block").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}  # of the templates' words
    order = sorted({x for _, s in sets for x in s}, key=lambda x: (often.get(x, 0), x))
    rank = {x: i for i, x in enumerate(order)}
    kept = [(label, sorted(s, key=rank.__getitem__), needed(len(s), threshold)) for label, s in sets]
    rows = [F.struct(F.lit(label).alias("label"), F.lit(len(s)).alias("size"), F.lit(need).alias("need"), F.array(*map(F.lit, s)).alias("words")) for label, s, need in kept]
    table = spark.range(1).select(F.inline(F.array(*rows) if rows else F.array().cast("array<struct<label:string,size:int,need:int,words:array<string>>>")))
    prefixes = table.select("*", F.posexplode(F.slice("words", F.lit(1), F.col("size") - F.col("need") + 1)).alias("i", "word"))
    # array_intersect keeps the order of its first array: the global order
    sorted_blocks = blocks.select("row", F.array_intersect(F.array(*map(F.lit, order)) if order else F.array().cast("array<string>"), "block").alias("block"))
    each = sorted_blocks.select("row", "block", F.size("block").alias("m"), F.posexplode("block").alias("j", "word"))
    fits = (F.col("m") >= F.col("need")) & (F.least(F.col("size") - F.col("i"), F.col("m") - F.col("j")) >= F.col("need"))
    common = F.size(F.array_intersect("words", "block"))
    pairs = each.join(F.broadcast(prefixes), "word").where(fits).select("row", "label", "size", "need", common.alias("common")).where("common >= need")
    return pairs.groupBy("row").agg(F.collect_set("label").alias("labels"), F.max(F.col("common") / F.col("size")).alias("share"))


def sql(templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, threshold: float = THRESHOLD, block: int = BLOCK) -> str:
    """The same rows in DuckDB's SQL: every block against every template."""
    half = block // 2
    rows = ", ".join(f"('{label}', {list(dict.fromkeys(words_of(t)))}, {needed(len(set(words_of(t))), threshold)})" for label, t in templates)
    phrase_rows = ", ".join(f"({words_of(p)}, '{label}')" for p, label in phrases)
    return f"""
WITH t(label, words, need) AS (VALUES {rows}), f(words, label) AS (VALUES {phrase_rows}),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
p AS (SELECT row, label, i FROM (SELECT row, w, unnest(range(len(w))) AS i FROM d) d JOIN f ON w[i + 1:i + len(words)] = words),
b AS (SELECT row, list_distinct(w[k * {half} + 1:k * {half} + {block}]) AS s FROM (SELECT row, w, unnest(range(0, 1 + greatest(0, ceil((len(w) - {block}) / {half}::DOUBLE)::BIGINT))) AS k FROM d)),
m AS (SELECT row, label, len(list_intersect(s, words)) / len(words) AS share FROM b JOIN t ON len(list_intersect(s, words)) >= need),
x AS (SELECT row, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY row),
y AS (SELECT row, max(share) AS share FROM m GROUP BY row),
z AS (SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT row, label FROM p UNION SELECT row, label FROM m) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN x USING (row) LEFT JOIN y USING (row) LEFT JOIN z USING (row)
"""

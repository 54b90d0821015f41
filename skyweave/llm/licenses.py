"""License scans with DataFrame operations alone.

Overlapping windows of a text's words are sketched with MinHash; bands of one
row retrieve templates, and exact containment of the template's shingles in the
window verifies them.  A window is twice as long as its class of templates and
windows start at every template length, so any run of template length lies
whole inside one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Wordings of public license notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "published by the Free Software Foundation, either version 3 of the License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Apache-2.0", "distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("GPL-2.0", "published by the Free Software Foundation; either version 2 of the License"),
    ("LGPL", "under the terms of the GNU Lesser General Public License"),
    ("AGPL", "under the terms of the GNU Affero General Public License"),
    ("BSD", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("BSD", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("EPL-2.0", "made available under the terms of the Eclipse Public License 2.0"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable"),
)
#: What parts words: all but letters and digits.
BREAK = r"[^\p{L}\p{N}]+"


@dataclass
class Settings:
    """``bands`` of one row: the least match, a template of n shingles of which a
    share ``least`` lies in a window of 2 n + 4, has similarity of at least 1/8,
    so one band or more agrees with probability 1 - (7/8)^bands, over 0.9999."""

    shingle: int = 5
    least: float = 0.75
    bands: int = 80


def words_of(text: str) -> list[str]:
    return "".join(c.lower() if c.isalnum() else " " for c in text).split()


def anchors(templates, settings: Settings) -> list[str]:
    """Few words of which every match of a template holds one.

    A match holds a share ``least`` of a template's shingles; words are chosen
    until fewer shingles than that are without any of them.
    """
    chosen: list[str] = []
    sets = []
    for _, text in templates:
        own = words_of(text)
        sets.append([own[i : i + settings.shingle] for i in range(len(own) - settings.shingle + 1)])
    rare = sorted({w for s in sets for x in s for w in x}, key=lambda w: (-sum(any(w in x for x in s) for s in sets) - len(w) / 10, w))
    rare = [w for w in rare if len(w) > 3 and not w.isdigit()]
    for own in sets:
        while sum(not set(x) & set(chosen) for x in own) >= settings.least * len(own):
            open_ = [x for x in own if not set(x) & set(chosen)]
            need = len(open_) - math.ceil(settings.least * len(own)) + 1  # of words that cover enough the longest, as the rarest
            chosen.append(max(rare, key=lambda w: (min(sum(w in x for x in open_), need), len(w), w)))
    return sorted(chosen)


def _shingles(words: Column, size: int) -> Column:
    """Hashes of the distinct shingles of an array of words."""
    starts = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(words, i, size), " "))))


def _bands(shingles: Column, bands: int) -> Column:
    """The least value of every hash function over the shingles."""
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, b))))


def _template_table(spark: SparkSession, templates, settings: Settings) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(i).alias("template"), F.lit(name).alias("license"), F.lit(" ".join(own)).alias("words"), F.lit(len(own)).alias("length")) for i, (name, text) in enumerate(templates) if len(own := words_of(text)) >= settings.shingle))
    table = spark.range(0, 1, 1, 1).select(F.explode(rows).alias("t")).select("t.*")
    return table.withColumn("own", _shingles(F.split("words", " "), settings.shingle)).drop("words")


def scan(docs: DataFrame, templates=TEMPLATES, settings: Settings | None = None) -> DataFrame:
    """(doc_id, license, template, n_windows, first_word, containment) for each template found in each row.

    ``containment``: the largest share of the template's distinct shingles in
    one window, at least ``least``; ``n_windows``: windows with that or more;
    ``first_word``: place of the first such window.  Words are runs of letters
    and digits in lower case, over the whole text.  Null and empty texts, and
    those without any match, have no row; rows that repeat a doc_id count as
    one document; a null doc_id has its matches under null; other columns are
    ignored.  Texts without any anchor word cannot match and go first; the
    table of templates is a parameter of fixed size and is broadcast.
    """
    settings = settings or Settings()
    spark = docs.sparkSession
    table = _template_table(spark, templates, settings)
    anchor = anchors(templates, settings)
    lengths = sorted({len(words_of(t)) for _, t in templates if len(words_of(t)) >= settings.shingle})
    low = F.lower("text")
    rows = docs.select("doc_id", low.alias("text")).where(F.col("text").rlike("|".join(anchor)))
    rows = rows.select("doc_id", F.filter(F.split("text", BREAK, -1), lambda w: w != "").alias("words"))

    def windows(length: int) -> Column:
        last = F.greatest(F.ceil((F.size("words") - 2 * length) / length), F.lit(0)).cast("int")
        return F.transform(
            F.sequence(F.lit(0), last),
            lambda k: F.struct(F.lit(length).alias("length"), (k * length).alias("start"), F.slice("words", k * length + 1, 2 * length).alias("part")),
        )

    marked = F.array(*(F.lit(w) for w in anchor))
    every = F.filter(F.concat(*(windows(n) for n in lengths)), lambda w: F.arrays_overlap(w["part"], marked))
    cut = rows.where(F.size("words") >= settings.shingle).select("doc_id", F.explode(every).alias("w"))
    cut = cut.select("doc_id", "w.length", "w.start", _shingles(F.col("w.part"), settings.shingle).alias("held")).where(F.size("held") > 0)

    banded = cut.select("*", F.posexplode(_bands(F.col("held"), settings.bands)).alias("band", "value"))
    keys = table.select("template", "license", "length", "own", F.posexplode(_bands(F.col("own"), settings.bands)).alias("band", "value"))
    found = banded.join(F.broadcast(keys), ["length", "band", "value"])
    share = F.size(F.array_intersect("held", "own")) / F.size("own")
    matched = found.select("doc_id", "license", "template", "start", share.alias("share")).where(F.col("share") >= settings.least)
    one = matched.groupBy("doc_id", "license", "template", "start").agg(F.max("share").alias("share"))
    return one.groupBy("doc_id", "license", "template").agg(
        F.count("*").alias("n_windows"), F.min("start").cast("long").alias("first_word"), F.max("share").alias("containment")
    )


def sql(templates=TEMPLATES, settings: Settings | None = None) -> str:
    """The same by exact comparison of every window with every template."""
    settings = settings or Settings()
    values = ", ".join(f"({i}, '{name}', '{' '.join(words_of(text))}')" for i, (name, text) in enumerate(templates))
    k = settings.shingle
    return f"""
WITH t AS (SELECT i AS template, l AS license, string_split(w, ' ') AS w FROM (VALUES {values}) v(i, l, w)),
ts AS (SELECT DISTINCT template, license, len(w) AS length, array_to_string(list_slice(w, p, p + {k - 1}), ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - {k - 2})) AS p FROM t)),
tn AS (SELECT template, count(*) AS total FROM ts GROUP BY template),
d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
ds AS (SELECT doc_id, len(w) AS words, p - 1 AS "at", array_to_string(list_slice(w, p, p + {k - 1}), ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - {k - 2})) AS p FROM d)),
hit AS (SELECT DISTINCT doc_id, template, license, length, words, "at", ds.s FROM ds JOIN ts ON ds.s = ts.s),
placed AS (SELECT *, unnest(range(greatest(0, ("at" + {k} - 2 * length + length - 1) // length), "at" // length + 1)) AS win FROM hit),
share AS (SELECT doc_id, template, license, win * length AS start, count(DISTINCT s) AS n FROM placed
  WHERE "at" + {k} <= win * length + 2 * length AND win <= greatest(ceil((words - 2 * length) / length), 0) GROUP BY ALL)
SELECT doc_id, license, template, count(*) AS n_windows, CAST(min(start) AS BIGINT) AS first_word, max(n / total) AS containment
FROM share JOIN tn USING (template) WHERE n / total >= {settings.least} GROUP BY doc_id, license, template
""".replace("\\\\", "\\")

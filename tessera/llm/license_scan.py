"""Operator 3: license notices found by MinHash bands over overlapping text windows.

Everything is DataFrame functions. A template of m shingles (runs of five words) is sought in
windows of 2m shingles that start every m/2 shingles (every one for m = 1): so any stretch of 1.5m
shingles lies whole in some window. A window that holds a share c of the template's shingles has at
most 2m + (1 - c)m shingles with it together, hence a Jaccard similarity of at least c / (3 - c),
0.36 for MIN_CONTAINMENT. A window and a template are compared if the minima of their shingles
agree in a band; each band is one row of a hash function of its own (xxhash64 of shingle and band),
so a window is missed with probability (1 - c / (3 - c))^bands, and bands() takes as many as make
that less than MISS. Then the share of the template's shingles that the window holds is counted
exactly, and from MIN_CONTAINMENT on it is a match. A window can only agree in a band if it holds a
shingle of a template, so windows are formed around those places alone; that leaves out no match.

A null or wordless text, a text or template of fewer than five words, and an empty table have no matches. Null and repeated doc_ids are kept, each row
with matches of its own. Texts are read whole. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

K, MIN_CONTAINMENT, MISS = 5, 0.8, 1e-12
#: Above all window sizes (twice a template's shingles).
WINDOWS = 1 << 24
#: Templates whose bands are broadcast at a time; more are scanned in blocks of this many.
BLOCK = 2000

#: Notices of public licenses.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("BSD-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC-notice", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
]


def words(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda x: x != "")


def shingle(words: Column, at: Column) -> Column:
    return F.xxhash64(*(F.get(words, at + j) for j in range(K)))


def _shingles(words: Column, start: Column, end: Column) -> Column:
    """Hashes of the shingles start .. end - 1; none if there are none."""
    return F.when(end > start, F.transform(F.sequence(start, end - 1), lambda i: shingle(words, i))).otherwise(F.array().cast("array<long>"))


def bands(min_containment: float) -> int:
    """Bands that miss a window of min_containment with a probability below MISS."""
    return math.ceil(math.log(MISS) / math.log1p(-min_containment / (3 - min_containment)))


def _minima(shingles: Column, n: int) -> Column:
    """The least hash of each of n bands, by a hash function of its own."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda band: F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, band))))


def template_table(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """license, w, t_shingles (distinct), window."""
    df = spark.createDataFrame(templates, "license string, notice string").withColumn("w", words(F.col("notice")))
    df = df.withColumn("t_shingles", F.array_distinct(_shingles(F.col("w"), F.lit(0), F.size("w") - K + 1))).filter(F.size("t_shingles") > 0)
    return df.select("license", "w", "t_shingles", (2 * F.size("t_shingles")).alias("window"))


def scan(docs: DataFrame, templates: list[tuple[str, str]], min_containment: float = MIN_CONTAINMENT) -> DataFrame:
    """doc_id, license, containment, n_windows, first_word: one row for each template in each document."""
    parts = [templates[k : k + BLOCK] for k in range(0, len(templates), BLOCK)] or [[]]
    return reduce(DataFrame.unionByName, [_scan(docs, part, min_containment) for part in parts])


def _scan(docs: DataFrame, templates: list[tuple[str, str]], min_containment: float) -> DataFrame:
    known = template_table(docs.sparkSession, templates)
    n = bands(min_containment)
    rows = known.collect()  # at most BLOCK rows
    kinds = sorted({r["window"] for r in rows})
    openings = [sorted({r["w"][i + j] for r in rows for i in range(len(r["w"]) - K + 1)}) for j in range(K)]
    hashes = sorted({x for r in rows for x in r["t_shingles"]})

    def hits(w: Column) -> Column:
        """Places of templates' shingles; words are looked at first, as that is cheaper."""
        first = lambda i: F.get(w, i).isin(openings[0]) & F.get(w, i + 1).isin(openings[1]) & F.get(w, i + 2).isin(openings[2])
        places = F.filter(F.sequence(F.lit(0), F.size(w) - K), lambda i: first(i) & shingle(w, i).isin(hashes))
        return F.when(F.size(w) >= K, places).otherwise(F.array().cast("array<int>"))

    def around(size: int) -> Column:
        """Starts of the windows of this size that hold a hit."""
        step = max(1, size // 4)
        starts = lambda i: F.sequence(F.greatest(F.lit(0), F.floor((i - size) / step).cast("int") + 1), F.floor(i / step).cast("int"))
        return F.flatten(F.transform("hits", lambda i: F.transform(starts(i), lambda j: (j * step).cast("long") * WINDOWS + size)))

    # A column that a lambda uses often is bound by a lambda of its own, and made once a row by explode.
    bound = F.transform(F.array(words(F.col("text"))), lambda w: F.struct(w.alias("w"), hits(w).alias("hits")))
    df = docs.withColumn("_row", F.monotonically_increasing_id()).select("doc_id", "_row", F.inline(F.filter(bound, lambda x: F.size(x["hits"]) > 0)))
    # Windows as numbers, which are made distinct by a hash set (structs would be compared pair by pair);
    # each takes its own words along, not the whole text's.
    spots = F.array_distinct(F.concat(*(around(size) for size in kinds))) if kinds else F.array().cast("array<long>")
    piece = lambda start, size: F.slice("w", start + 1, size + K - 1)
    spot = lambda x: F.struct((x % WINDOWS).cast("int").alias("window"), F.floor(x / WINDOWS).cast("int").alias("start"))
    pieces = F.transform(F.transform(spots, spot), lambda x: F.struct(x["window"].alias("window"), x["start"].alias("start"), piece(x["start"], x["window"]).alias("piece")))
    df = df.select("doc_id", "_row", F.inline(pieces))
    sh = _shingles(F.col("piece"), F.lit(0), F.size("piece") - K + 1)
    df = df.select("doc_id", "_row", "window", "start", F.inline(F.transform(F.array(sh), lambda x: F.struct(x.alias("_sh"), _minima(x, n).alias("_bands")))))
    keys = df.select("doc_id", "_row", "window", "start", "_sh", F.posexplode("_bands").alias("band", "least"))
    known_keys = known.select("license", "t_shingles", "window", F.posexplode(_minima(F.col("t_shingles"), n)).alias("band", "least"))
    met = keys.join(F.broadcast(known_keys), ["window", "band", "least"])
    share = F.size(F.array_intersect("_sh", "t_shingles")) / F.size("t_shingles")
    met = met.withColumn("containment", share).filter(F.col("containment") >= min_containment)
    found = met.groupBy("_row", "license").agg(F.first("doc_id").alias("doc_id"), F.max("containment").alias("containment"), F.countDistinct("start").alias("n_windows"), F.min("start").alias("first_word"))
    return found.select("doc_id", "license", "containment", "n_windows", F.col("first_word").cast("long").alias("first_word"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), TEMPLATES).withColumn("containment", F.round("containment", 6))


_VALUES = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in t)) for t in TEMPLATES)
_SPLIT = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"
ORACLE = f"""
WITH t AS (SELECT license, {_SPLIT.format("notice")} AS w FROM (VALUES {_VALUES}) v(license, notice)),
ts AS (SELECT DISTINCT license, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM t WHERE len(w) >= 5),
tm AS (SELECT license, count(*) AS m, 2 * count(*) AS win, greatest(1, 2 * count(*) // 4) AS step FROM ts GROUP BY license),
d AS (SELECT row_number() OVER () AS r, doc_id, {_SPLIT.format("text")} AS w FROM documents),
ds AS (SELECT r, doc_id, unnest(range(0, len(w) - 4)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM d WHERE len(w) >= 5),
h AS (SELECT r, doc_id, license, i, s, m, win, step FROM ds JOIN ts USING (s) JOIN tm USING (license)),
p AS (SELECT r, doc_id, license, s, m, win, unnest(range(greatest(0, CAST(floor((i - win) / step) AS BIGINT) + 1), i // step + 1)) * step AS start FROM h),
c AS (SELECT r, doc_id, license, start, count(DISTINCT s) / m AS containment FROM p GROUP BY r, doc_id, license, start, m)
SELECT doc_id, license, round(max(containment), 6) AS containment, count(*) AS n_windows, min(start) AS first_word
FROM c WHERE containment >= 0.8 GROUP BY r, doc_id, license
"""

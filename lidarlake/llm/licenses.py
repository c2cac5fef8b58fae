"""License scans by MinHash over text windows, in DataFrame functions alone.

A template and a text are sequences of word shingles. Templates fall into classes by length; a
class has one window size and stride, so that every stretch as long as a template lies in one
window whole. The sketch of a set is its SKETCH least shingle hashes, and each of them is a
band of one row: window and template meet on any common value. A template of which the share c
stands in the window has a Jaccard similarity j with it that the class bounds from
below, and the chance to miss all bands is at most (1 - j) ** SKETCH. For the shortest class the
sketch holds the whole window, and nothing is missed. What meets is verified: the share of
the template's shingles that the window holds, exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a shingle, and values of a sketch.
SHINGLE = 5
SKETCH = 24
#: Least share of a template's shingles that a window must hold.
CONTAINMENT = 0.8
#: Rows of templates that may be broadcast.
MOST_TEMPLATES = 50_000
#: Band values that texts are looked through for before windows are formed.
LISTED_BANDS = 20_000
#: Per class: most shingles of a template, shingles of a window, stride. A window is as long as
#: the longest template and a stride together, less one. Longer templates are cut.
CLASSES = ((8, 16, 8), (32, 48, 16), (128, 192, 64))

# Names and wordings of public licenses.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
            "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
            "and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the "
                   "License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "it under the terms of the GNU General Public License as published by the Free Software "
                         "Foundation, either version 3 of the License, or (at your option) any later version"),
    ("GPL-2.0-or-later", "it under the terms of the GNU General Public License as published by the Free Software "
                         "Foundation; either version 2 of the License, or (at your option) any later version"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
)


def default_templates(spark: SparkSession) -> DataFrame:
    """``template_id, license, text`` of the built-in wordings."""
    return spark.createDataFrame(
        [(i, name, text) for i, (name, text) in enumerate(TEMPLATES)], "template_id long, license string, text string"
    )


def _hashed(df: DataFrame) -> DataFrame:
    """``text`` as ``_hashes``, its shingles in order; null for fewer than SHINGLE words."""
    w = F.col("_words")
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    hashes: Column = F.when(
        F.size(w) >= SHINGLE,
        F.transform(
            F.sequence(F.lit(1), F.size(w) - SHINGLE + 1),
            lambda i: F.xxhash64(*[F.element_at(w, (i + j).cast("int")) for j in range(SHINGLE)]),
        ),
    )
    return df.withColumn("_words", words).withColumn("_hashes", hashes).drop("_words", "text")


def _pieces(templates: DataFrame, most: int) -> DataFrame:
    """Templates as pieces of at most ``most`` shingles: ``template_id, piece, class, shingles``."""
    hashed = _hashed(templates.select("template_id", "text")).where("_hashes is not null")
    starts = F.sequence(F.lit(1), F.size("_hashes"), F.lit(most))
    pieces = hashed.select("template_id", "_hashes", F.posexplode(starts).alias("piece", "at")).select(
        "template_id", "piece", F.array_distinct(F.slice("_hashes", F.col("at"), F.lit(most))).alias("shingles")
    )
    size = F.size("shingles")
    kind = F.when(size <= CLASSES[0][0], 0)
    for i, (longest, _, _) in enumerate(CLASSES[1:], 1):
        kind = kind.when(size <= longest, i)
    return pieces.withColumn("class", kind)


def scan(docs: DataFrame, templates: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """``doc_id, template_id, share``: the templates that a document holds.

    ``share`` is the part of the template's distinct five-word shingles that one window of the text
    holds, at least ``containment``; for a template longer than the longest class, the least share of
    its pieces. Words are lower-cased runs of letters and digits. Null or empty texts and
    texts or templates of fewer than five words match nothing. A doc_id that repeats gives one
    row per template, at its best; a null doc_id likewise. Other columns are ignored.
    Templates are a parameter, not data: more than MOST_TEMPLATES of them are refused.
    """
    if templates.count() > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    pieces = _pieces(templates, CLASSES[-1][0])
    wanted = pieces.groupBy("template_id").agg(F.count(F.lit(1)).alias("pieces"))
    hashed = _hashed(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    kinds = sorted(r[0] for r in pieces.select("class").distinct().collect())
    if not kinds:
        return docs.select(F.col("doc_id"), F.lit(0).cast("long").alias("template_id"), F.lit(0.0).alias("share")).where("false")

    def windows_of(kind: int) -> Column:
        _, window, stride = CLASSES[kind]
        # The last window may be shorter; each starts where a stretch of a stride begins.
        last = F.greatest(F.lit(1), F.size("_hashes") - (window - stride))
        return F.transform(
            F.sequence(F.lit(1), last, F.lit(stride)),
            lambda at: F.struct(F.lit(kind).alias("class"), F.slice("_hashes", at, F.lit(window)).alias("window")),
        )

    keys = pieces.select(
        "template_id", "piece", "class", "shingles", F.explode(F.slice(F.array_sort("shingles"), 1, SKETCH)).alias("band")
    )
    # One pass over the texts for all classes. A window that meets a template holds one of its band values, so
    # texts and windows without any are left out before anything is sorted. (Beyond LISTED_BANDS the join does it.)
    formed = F.concat(*[windows_of(kind) for kind in kinds])
    values = [r[0] for r in keys.select("band").distinct().limit(LISTED_BANDS + 1).collect()]
    if len(values) <= LISTED_BANDS:
        listed = F.lit(values)
        formed = F.filter(formed, lambda w: F.arrays_overlap(w["window"], listed))
        formed = F.when(F.arrays_overlap("_hashes", listed), formed)
    windows = hashed.select("doc_id", F.inline(formed))
    bands = windows.select(
        "doc_id", "class", "window", F.explode(F.slice(F.array_sort(F.array_distinct("window")), 1, SKETCH)).alias("band")
    )
    shared = F.size(F.array_intersect("window", "shingles")) / F.size("shingles")
    found = (
        bands.join(F.broadcast(keys), ["band", "class"])
        .select("doc_id", "template_id", "piece", shared.alias("share"))
        .where(F.col("share") >= containment)
    )
    best = found.groupBy("doc_id", "template_id", "piece").agg(F.max("share").alias("share"))
    whole = best.groupBy("doc_id", "template_id").agg(F.min("share").alias("share"), F.count(F.lit(1)).alias("_n"))
    return (
        whole.join(F.broadcast(wanted), "template_id")
        .where(F.col("_n") == F.col("pieces"))
        .select("doc_id", "template_id", "share")
    )

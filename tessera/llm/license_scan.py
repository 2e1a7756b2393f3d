"""License scan in DataFrame functions alone.

Templates are whole licenses and their usual notices. They are cut into pieces of at most ``PIECE`` words; text windows that
overlap by a grid are as long as a piece plus the grid's step, so that a piece lies whole in one. MinHash bands of windows and
pieces retrieve candidates, whatever their share, and the share of the whole template's distinct word shingles that the
text holds is then counted exactly. One pass over the documents finds the places of template shingles; a window is made where
one stands, and of its shingles only those are hashed. Others agree with no piece in a MinHash value: leaving them out can only
raise the chance that a piece is retrieved, and no text is moved.

``BANDS`` bands of one value each: a window with the share ``CONTAINED`` of a piece has at least a Jaccard
similarity of about 0.4 with it, so it is missed with a probability of at most 0.6 ** 24, or 5e-6. A text with
that share of a template has it of one piece at least, of a long one of many.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.workspace import written

from .decontaminate import met_runs, numbered_runs, words_of
from .rows import TAGS, row_tags

WIDTH = 5
PIECE = 16
BANDS = 24
CONTAINED = 0.8

#: Usual notices of public licenses; the whole texts are the files of the folder ``licenses``.
NOTICES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0 header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "MIT notice": "Released under the MIT License.",
    "MIT grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "BSD clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def templates() -> dict[str, str]:
    """License to text: the notices and the whole texts."""
    files = sorted((f for f in resources.files(__package__).joinpath("licenses").iterdir() if f.name.endswith(".txt")), key=lambda f: f.name)
    return NOTICES | {f.name.removesuffix(".txt"): f.read_text() for f in files}


def templates_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(templates().items()), "license string, text string")


def shingles(words: str) -> Column:
    """Distinct runs of ``WIDTH`` words."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - WIDTH + 1), lambda i: F.slice(words, i, F.lit(WIDTH))))


def pieces_of(templates: DataFrame) -> DataFrame:
    """(license, piece, m, grams): the pieces of each template, their words and shingles. Pieces overlap so that no shingle is lost; the last ends with the template."""
    split = templates.select("license", words_of(F.col("text")).alias("w")).where(F.size("w") >= WIDTH)
    step = PIECE - WIDTH + 1
    last = F.greatest(F.lit(0), F.size("w") - PIECE)
    at = F.array_append(F.filter(F.sequence(F.lit(0), last, F.lit(step)), lambda k: k < last), last)
    cut = split.select("license", F.posexplode(at).alias("piece", "k"), "w").select("license", "piece", F.slice("w", F.col("k") + 1, PIECE).alias("w"))
    return cut.select("license", "piece", F.size("w").alias("m"), shingles("w").alias("grams"))


def grid_step(m: Column) -> Column:
    """Words between the windows for pieces of m words: half of the piece's shingles, so that these are most of a window's."""
    return F.greatest(F.lit(1), F.floor((m - WIDTH + 1) / 2)).cast("int")


def min_hashes(grams: str) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda seed: F.array_min(F.transform(F.col(grams), lambda g: F.xxhash64(g, seed))))


def license_scan(docs: DataFrame, templates: DataFrame | None = None, id_col: str = "doc_id", text: str = "text", contained: float = CONTAINED) -> DataFrame:
    """One row per document and license found in it: (id_col, license, n_pieces, matched_pieces, containment).

    Words are as in the decontamination. A license is found if the text holds at least ``contained`` of its
    distinct shingles (containment is their share); ``matched_pieces`` counts the pieces of which it holds as much. Null and empty
    texts have no license, templates of fewer than five words none to find. Rows that repeat id and text (null ids too) count
    as one document, rows of one id with other texts each as their own. Either table may be empty. Other columns are not read.
    """
    templates = templates if templates is not None else templates_table(docs.sparkSession)
    keys = list(TAGS)
    pieces = written(pieces_of(templates), "pieces")
    wanted = numbered_runs(pieces.select(F.explode("grams").alias("run")).distinct(), [WIDTH])
    classes = [r["m"] for r in pieces.select("m").distinct().orderBy("m").collect()]  # at most PIECE values
    split = docs.select(F.col(id_col).alias("id"), *row_tags(id_col, text), words_of(F.col(text)).alias("words"))
    met = written(met_runs(split, ["id", *keys], wanted, [WIDTH] if classes else []), "met")

    m = F.explode(F.array(*map(F.lit, classes)) if classes else F.array().cast("array<int>"))
    places = met.select(*keys, "pos", "token", m.alias("m")).withColumn("step", grid_step(F.col("m")))
    length = F.col("m") + F.col("step") - 1
    first = F.greatest(F.lit(0), F.ceil((F.col("pos") + WIDTH - length) / F.col("step"))).cast("int")
    starts = F.explode(F.sequence(first, F.floor(F.col("pos") / F.col("step")).cast("int")))
    grid = places.select(*keys, "m", starts.alias("k"), "token").groupBy(*keys, "m", "k").agg(F.collect_set("token").alias("own"))  # at most a window's shingles
    windows = written(grid, "windows")

    bands = lambda df, own: df.withColumn("band", F.explode(F.arrays_zip(F.sequence(F.lit(1), F.lit(BANDS)).alias("b"), min_hashes(own).alias("v")))).select("*", "band.b", "band.v").drop("band")
    left = bands(windows, "own").select(*keys, "m", "b", "v")
    listed = written(pieces.select("license", "piece", "m", F.size("grams").alias("n"), F.explode("grams").alias("run")).join(wanted, "run").drop("run"), "listed")
    right = bands(listed.groupBy("license", "piece", "m").agg(F.collect_set("token").alias("own")), "own").select("license", "m", "b", "v")
    candidates = written(left.join(right, ["m", "b", "v"]).select(*keys, "license").distinct(), "candidates")
    hit = met.select(*keys, "number").distinct().join(listed, "number").join(candidates, [*keys, "license"])
    whole = hit.select(*keys, "license", "number").distinct().groupBy(*keys, "license").agg(F.count("*").alias("hit"))
    parts = hit.groupBy(*keys, "license", "piece", "n").agg(F.count("*").alias("c")).groupBy(*keys, "license").agg(F.count_if(F.col("c") / F.col("n") >= contained).alias("matched_pieces"))
    every = listed.groupBy("license").agg(F.countDistinct("piece").alias("n_pieces"), F.countDistinct("number").alias("total"))
    found = whole.join(parts, [*keys, "license"]).join(every, "license").where(F.col("hit") / F.col("total") >= contained)
    names = met.select("id", *keys).distinct()
    out = found.join(names, keys)
    return out.select(F.col("id").alias(id_col), "license", "n_pieces", "matched_pieces", F.round(F.col("hit") / F.col("total"), 6).alias("containment"))

"""Licence scans, in DataFrame functions alone: TF-IDF cosine to templates, then inheritance.

A file is cut into passages: its lines, the sentences of lines and its paragraphs.  Passages
with one of the anchor words become sparse term vectors, weighted by inverse document
frequencies counted over the whole texts of all files, and are joined by term with the
templates' vectors; the best cosine that reaches the threshold is the file's own licence.  A
licence file (by its name) speaks for its directory; a file without a licence of its own
inherits from the nearest ancestor directory that has one, by joins on paths.

Cases: null or empty texts have no licence of their own; a null path has no directory and
inherits nothing; of equal cosines the licence first in alphabet wins, of several licence
files in a directory the best cosine; repeated paths are files of their own; an empty table
gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetable.session import staged

# The sentences by which licences are stated.
TEMPLATES = (
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright to the public domain. CC0 1.0 Universal."),
    ("GPL-2.0", "This program is free software; you can redistribute it under the terms of the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
)
ANCHORS = ("licens", "licenc", "copyright", "permission", "permitted", "redistribut", "rights", "gnu", "apache", "mozilla", "cc by", "cc0")
LICENCE_FILE = r"(?i)(^|/)(licen[sc]e|copying|unlicense)[^/]*$"


@dataclass(frozen=True)
class Settings:
    """Cosine that a passage must reach; characters of the longest passage compared as one."""

    threshold: float = 0.6


def templates(spark: SparkSession, rows=TEMPLATES) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "template int, license string, text string")


def terms(text: Column) -> Column:
    """Lower-case words and version numbers, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+(?:[.-][a-z0-9]+)*)"), 1)


def passages(text: Column) -> Column:
    """Distinct lines, sentences and paragraphs of a text that hold an anchor word."""
    lines = F.split(text, r"\n")
    sentences = F.flatten(F.transform(lines, lambda x: F.split(x, r"(?<=[.!?;])\s+")))
    paragraphs = F.split(text, r"\n\s*\n")
    every = F.array_distinct(F.concat(lines, sentences, paragraphs))
    return F.filter(every, lambda p: anchored(p))


def anchored(text: Column) -> Column:
    low, found = F.lower(text), F.lit(False)
    for word in ANCHORS:
        found = found | F.contains(low, F.lit(word))
    return found


def inverse_frequencies(files: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, idf) of the templates' terms: ln((1 + files) / (1 + files with the term)) + 1."""
    known = [r[0] for r in vocabulary.select("term").distinct().orderBy("term").collect()]  # the templates' words
    held = F.array_intersect(terms(F.col("text")), F.array(*[F.lit(t) for t in known]))
    counted = files.select(F.explode(F.concat(held, F.array(F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    counted = staged(counted)
    total = F.broadcast(counted.filter("term = ''").select(F.col("df").alias("n")))  # one row at most
    every = vocabulary.select("term").distinct().join(counted, "term", "left").join(total, how="left", on=F.lit(True))
    return every.select("term", (F.log((1 + F.coalesce("n", F.lit(0))) / (1 + F.coalesce("df", F.lit(0)))) + 1).alias("idf"), (F.log(1.0 + F.coalesce("n", F.lit(0))) + 1).alias("rarest"))


def own_licences(files: DataFrame, known: DataFrame, settings: Settings) -> DataFrame:
    """(file, license, score) of the files with a passage that reaches the threshold."""
    words = known.select("template", "license", F.explode(terms(F.col("text"))).alias("term"))
    words = words.groupBy("template", "license", "term").agg(F.count("*").alias("tf"))
    idf = F.broadcast(staged(inverse_frequencies(files, words)))  # the templates' terms: some two hundred rows
    rarest = F.broadcast(idf.select("rarest").limit(1))
    weighed = words.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = weighed.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    vectors = F.broadcast(staged(weighed.join(norms, "template").select("template", "license", "term", (F.col("w") / F.col("norm")).alias("t"))))
    found = files.filter(anchored(F.col("text"))).select("file", F.posexplode(passages(F.col("text"))).alias("passage", "p"))
    found = found.select("file", "passage", F.explode(terms(F.col("p"))).alias("term")).groupBy("file", "passage", "term").agg(F.count("*").alias("tf"))
    # Terms that no template has weigh like the rarest ones.
    found = found.join(idf.drop("rarest"), "term", "left").join(rarest, how="left", on=F.lit(True))
    found = staged(found.select("file", "passage", "term", (F.col("tf") * F.coalesce("idf", "rarest")).alias("w")))
    lengths = found.groupBy("file", "passage").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    dots = found.join(vectors, "term").groupBy("file", "passage", "template", "license").agg(F.sum(F.col("w") * F.col("t")).alias("dot"))
    scored = dots.join(lengths, ["file", "passage"]).withColumn("score", F.round(F.col("dot") / F.col("length"), 6)).filter(F.col("score") >= settings.threshold)
    best = scored.groupBy("file", "license").agg(F.max("score").alias("score"))
    first = best.groupBy("file").agg(F.min(F.struct(-F.col("score"), F.col("license"))).alias("b"))
    return first.select("file", F.col("b.license").alias("license"), (-F.col("b.col1")).alias("score"))


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def ancestors(folder: Column) -> Column:
    """The directory itself and all above it, up to the root ''; struct<depth, dir>."""
    parts = F.split(folder, "/")
    depths = F.sequence(F.lit(0), F.when(folder == "", 0).otherwise(F.size(parts)))
    return F.transform(depths, lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(parts, F.lit(1), d), "/").alias("dir")))


def inherited(folders: DataFrame, declared: DataFrame) -> DataFrame:
    """(dir, from_dir, inherited): for each directory the licence of its nearest declaring ancestor."""
    above = folders.select("dir", F.explode(ancestors(F.col("dir"))).alias("a")).select("dir", "a.depth", F.col("a.dir").alias("above"))
    found = above.join(declared.select(F.col("dir").alias("above"), "license"), "above")
    return found.groupBy("dir").agg(F.max(F.struct("depth", "above", "license")).alias("n")).select("dir", F.col("n.above").alias("from_dir"), F.col("n.license").alias("inherited"))


def scan(files: DataFrame, known: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """One row per file (file, path, text): file, path, license, score, origin, from_dir.

    ``origin`` is own, inherited or none; score is that of an own licence, else null.
    """
    known = templates(files.sparkSession) if known is None else known
    rows = files.select("file", "path", F.coalesce("text", F.lit("")).alias("text"))
    own = staged(own_licences(rows, known, settings))
    placed = staged(rows.select("file", "path", directory(F.col("path")).alias("dir")).join(own, "file", "left"))
    heads = placed.filter(F.rlike("path", F.lit(LICENCE_FILE)) & F.col("license").isNotNull())
    declared = heads.groupBy("dir").agg(F.min(F.struct(-F.col("score"), F.col("license"))).alias("b")).select("dir", "b.license")
    folders = placed.filter("license is null and dir is not null").select("dir").distinct()
    found = placed.join(inherited(folders, declared), "dir", "left")
    lacks = F.col("license").isNull()
    return found.select(
        "file",
        "path",
        F.coalesce("license", "inherited").alias("license"),
        "score",
        F.when(~lacks, "own").when(F.col("inherited").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(lacks, F.col("from_dir")).alias("from_dir"),
    )

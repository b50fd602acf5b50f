"""Licence scans: TF-IDF cosine of lines and licence files to templates, then inheritance by path.

The segments of a file are its lines and, for a file named like a licence file, its whole text. A
segment's terms are its words in lower case. The weight of a template's term is its inverse
document frequency over all files; all other terms share the weight of a term that no file has. So
the vectors are sparse in the vocabulary of the templates, which is small and broadcast, and the norm of
a segment still counts every one of its words. A segment can only reach the threshold if it holds
one of the terms without which no template is close enough; all others are left out at once.

A file has the licence of its best segment. A directory has the licence of most licence files in
it; a file without a licence inherits from the nearest directory above it that has one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmgauge.llm.common import stored

#: Notices by licence: the statements that the licences' own texts recommend, or that files use for short.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction',
        "SPDX-License-Identifier: MIT",
    ),
    "proprietary": ("All rights reserved.",),
}
#: Names of licence files.
NAMED = r"(?i)^(licen[cs]e|copying|notice)([.\-_].*)?$"
TERM = r"[a-z0-9]+"


@dataclass(frozen=True)
class Scan:
    cosine: float = 0.75      #: least similarity of a segment to a template
    file_share: float = 0.5   #: a file is a licence file too if so much of its words are in matching lines


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), 1)


def parts(path: Column) -> tuple[Column, Column]:
    """(directory, name): the directory is empty for a path without a slash."""
    return F.regexp_extract(path, r"^(?s:(.*))/", 1), F.regexp_extract(path, r"([^/]*)$", 1)


def vocabulary(files: DataFrame) -> tuple[dict[str, float], float]:
    """(weight of each template term, weight of any other term) from document frequencies over all files."""
    words = sorted({w for texts in TEMPLATES.values() for t in texts for w in re.findall(TERM, t.lower())})
    # One pattern finds which of the vocabulary's words a file has; the rest of its words never leave the task.
    pattern = r"(?<![a-z0-9])(" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + r")(?![a-z0-9])"
    found = files.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(pattern), 1))).alias("term"))
    often = {r["term"]: r["n"] for r in found.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most the vocabulary
    n = files.count()
    return {w: math.log((1 + n) / (1 + often.get(w, 0))) + 1 for w in words}, math.log(1 + n) + 1


def scan_lines(files: DataFrame, scan: Scan = Scan()) -> DataFrame:
    """The best template of every matching segment: (key, no, licence, cosine, n_terms); no = -1: the whole file.

    ``files``: key, named, text. Ties go to the licence that comes first by name.
    """
    spark = files.sparkSession
    weight, other = vocabulary(files)
    rows, must = [], set()
    for licence, texts in sorted(TEMPLATES.items()):
        for i, text in enumerate(texts):
            vector = {w: c * weight[w] for w, c in Counter(re.findall(TERM, text.lower())).items()}
            norm = math.sqrt(sum(v * v for v in vector.values()))
            rows += [(licence, i, w, v / norm) for w, v in vector.items()]
            rest = norm * norm  # without the terms in ``must`` a segment gets at most sqrt(rest) / norm
            for w in sorted(vector, key=lambda w: (-weight[w], w)):
                if rest < (scan.cosine * norm) ** 2:
                    break
                must.add(w)
                rest -= vector[w] ** 2
    templates = spark.createDataFrame(rows, "licence string, template int, term string, part double")
    known = spark.createDataFrame(list(weight.items()), "term string, weight double")
    segments = files.select("key", F.posexplode(F.split("text", "\n", -1)).alias("no", "segment")).unionByName(
        files.where("named").select("key", F.lit(-1).alias("no"), F.col("text").alias("segment")))
    needed = r"(?<![a-z0-9])(" + "|".join(sorted(must)) + r")(?![a-z0-9])"
    words = segments.where(F.lower("segment").rlike(needed)).select("key", "no", F.explode(terms(F.col("segment"))).alias("term"))
    counted = words.groupBy("key", "no", "term").agg(F.count(F.lit(1)).alias("n")).join(
        F.broadcast(known), "term", "left").withColumn("value", F.col("n") * F.coalesce("weight", F.lit(other)))
    counted = stored(counted, "terms")
    norm = counted.groupBy("key", "no").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"), F.sum("n").alias("n_terms"))
    dot = counted.join(F.broadcast(templates), "term").groupBy("key", "no", "licence", "template").agg(
        F.sum(F.col("value") * F.col("part")).alias("dot"))
    close = dot.join(norm, ["key", "no"]).withColumn("cosine", F.col("dot") / F.col("norm")).where(F.col("cosine") >= scan.cosine)
    best = close.groupBy("key", "no", "n_terms").agg(F.max("cosine").alias("cosine"), F.min_by(
        "licence", F.struct(-F.round("cosine", 9), "licence")).alias("licence"))
    return best.select("key", "no", "licence", "cosine", "n_terms")


def scan_files(files: DataFrame, path: str = "path", text: str = "text", scan: Scan = Scan()) -> DataFrame:
    """``files`` (without the text) with licence, cosine, found_by and licence_dir.

    ``found_by``: ``own`` (a segment of the file matches), ``inherited`` (from directory
    ``licence_dir``, the file's own or one above it) or null. A null path is a path without
    directory and inherits from nothing; a null or empty text has no segments that match. Rows with one
    path are files of their own. Of several licences in a file that with most matching words wins, then the
    closest, then by name; of several in a directory the one of most licence files, then by name.
    Columns with the names of the results are replaced.
    """
    made = ("licence", "cosine", "found_by", "licence_dir")
    kept = [c for c in files.columns if c != text and c.lower() not in made]
    directory, name = parts(F.coalesce(F.col(path), F.lit("")))
    columns = [F.struct(F.lit(0).alias("_"), *kept).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"), directory.alias("dir"),
               name.rlike(NAMED).alias("named")]
    key = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).alias("key")
    try:
        rows = files.select(*columns, key)
    except AnalysisException:
        rows = stored(files, "files").select(*columns, key)
    lines = stored(scan_lines(rows, scan), "lines")
    share = lines.groupBy("key", "licence").agg(F.sum("n_terms").alias("n"), F.max("cosine").alias("cosine"))
    own = share.groupBy("key").agg(F.sum("n").alias("matched"), F.min_by(
        F.struct("licence", "cosine"), F.struct(-F.col("n"), -F.round("cosine", 9), "licence")).alias("best"))
    # The text's size is counted before the join, so no text is shuffled.
    sized = rows.select("row", "dir", "named", "key", F.regexp_count(F.lower("text"), F.lit(TERM)).alias("size"))
    judged = stored(sized.join(own, "key", "left").select(
        "row", "dir", "best.licence", "best.cosine",
        (F.col("best").isNotNull() & (F.col("named") | (F.col("matched") >= scan.file_share * F.col("size")))).alias("is_file")), "judged")
    votes = judged.where("is_file").groupBy("dir", "licence").agg(F.count(F.lit(1)).alias("n"))
    named = votes.groupBy("dir").agg(F.min_by("licence", F.struct(-F.col("n"), "licence")).alias("dir_licence"))
    steps = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))
    places = judged.select("dir").distinct().select("dir", F.explode(F.array_distinct(F.array_append(above, F.lit("")))).alias("at"))
    nearest = places.join(named.withColumnRenamed("dir", "at"), "at").groupBy("dir").agg(
        F.max_by(F.struct("at", "dir_licence"), F.length("at")).alias("near"))
    whole = judged.join(nearest, "dir", "left")
    mine = F.col("licence").isNotNull()
    return whole.select(
        *[F.col("row")[c].alias(c) for c in kept], F.coalesce("licence", "near.dir_licence").alias("licence"), "cosine",
        F.when(mine, F.lit("own")).when(F.col("near").isNotNull(), F.lit("inherited")).alias("found_by"),
        F.when(~mine, F.col("near.at")).alias("licence_dir"))

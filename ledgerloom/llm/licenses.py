"""License scans: TF-IDF cosine to templates, then inheritance along directories.

1. Text is cut into segments at line ends and block tags. A segment with a cue word is a header; a file whose name marks it as a licence
   file gives its whole text as one segment.
2. Segments and templates are sparse TF-IDF vectors over the templates' words: tf is 1 + ln(count), idf is ln(1 + S / (1 + df)) + 1 with
   the number of segments S and their frequencies df counted over the whole table. A segment's norm also counts its words outside the
   templates, at the largest idf. The best cosine of at least ``threshold`` names the licence; ties go to the first name. A licence file is
   also compared as a whole with full texts of licences, ``license_texts``; these are alike (MIT and ISC 0.77), so at least ``FULL`` is asked.
   Where that finds one of the GNU licences, which differ in few words, the title lines in the file decide.
3. A licence file, or the index page of a directory, declares its licence for the directory. A file with no licence of its own takes over
   the declaration of its nearest ancestor directory: (host, directory) of each ancestor is joined with the declarations, the deepest wins.

Everything is DataFrame operations; only the templates and the full texts, constants of this module, are broadcast.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.urls import host_of, path_of

#: The notices that the licences' own texts tell authors to attach, and common short forms.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software")'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

RESULT = ("host", "directory", "own_license", "similarity", "inherited_license", "inherited_from", "license")
#: The least similarity of a licence file to a full text.
FULL = 0.8

CUE = r"(?i)licen[sc]e|copyright|public domain|redistribut|permission is hereby|spdx-license|all rights reserved"
LICENCE_FILE = r"(?i)^(licen[sc]e|copying|notice|unlicense)([.-][^/]*)?$"
INDEX_FILE = r"(?i)^(index\.[a-z]+|readme(\.[a-z]+)?)?$"
WORD = r"[a-z0-9]+(?:\.[0-9]+)*"
#: The title of a GNU licence's full text, in capitals as no licence's body has it.
TITLE = r"GNU (?:AFFERO |LESSER |LIBRARY )?GENERAL PUBLIC LICENSE\s+Version [0-9]+(?:\.[0-9]+)?"


@cache
def full_texts() -> list[tuple[str, str]]:
    """(licence, full text), read on the driver."""
    return [(p.stem, p.read_text(encoding="utf-8")) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]


def template_words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def segments(files: DataFrame, text: str, is_file: Column) -> DataFrame:
    """(__id, segment number, words) of every header and licence file."""
    plain = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    pieces = F.when(is_file, F.array(F.regexp_replace(plain, r"<[^>]*>", " "))).otherwise(
        F.transform(F.filter(F.split(plain, r"(?i)\r?\n|</?(?:p|div|br|li|h[1-6]|article|section|header|footer|nav|td|tr|table|title|body|pre)\b[^>]*>"), lambda s: s.rlike(CUE)), lambda s: F.regexp_replace(s, r"<[^>]*>", " "))
    )
    found = files.filter(F.col(text).rlike(CUE)).select("__id", F.posexplode(pieces).alias("segment", "s"))
    return found.select("__id", "segment", F.regexp_extract_all(F.lower("s"), F.lit(WORD), 0).alias("words")).filter(F.size("words") > 0)


def matches(seg: DataFrame, threshold: float, templates: list[tuple[str, str]]) -> DataFrame:
    """The best template of each __id: (__id, own_license, similarity)."""
    spark = seg.sparkSession
    vocabulary = sorted({w for _, t in templates for w in template_words(t)})
    counts = [(i, name, w, 1 + math.log(n)) for i, (name, t) in enumerate(templates) for w, n in Counter(template_words(t)).items()]
    term = spark.createDataFrame(counts, "template int, license string, word string, t_tf double")
    words = seg.select("__id", "segment", F.explode("words").alias("w")).groupBy("__id", "segment", "w").agg((1 + F.log(F.count("*"))).alias("tf"))
    known = spark.createDataFrame([(w,) for w in vocabulary], "word string")
    df = words.join(F.broadcast(known), words.w == known.word).groupBy("word").agg(F.count("*").alias("df"))
    total = seg.agg(F.count("*").alias("s"))
    idf = known.join(df, "word", "left").crossJoin(F.broadcast(total)).select("word", (F.log(1 + F.col("s") / (1 + F.coalesce("df", F.lit(0)))) + 1).alias("idf"))
    weights = dict(idf.collect())  # one number for each word of the templates
    largest = max(weights.values(), default=1.0)
    idf = spark.createDataFrame(list(weights.items()), "word string, idf double")
    norms = {i: math.sqrt(sum((tf * weights[w]) ** 2 for j, _, w, tf in counts if j == i)) for i in range(len(templates))}
    side = spark.createDataFrame([(i, name, w, tf * weights[w] / norms[i]) for i, name, w, tf in counts], "template int, license string, word string, t_weight double")
    weighed = words.join(F.broadcast(idf), words.w == idf.word, "left").select("__id", "segment", "word", (F.col("tf") * F.coalesce("idf", F.lit(largest))).alias("x"))
    norm = weighed.groupBy("__id", "segment").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = weighed.filter("word is not null").join(F.broadcast(side), "word").groupBy("__id", "segment", "template", "license").agg(F.sum(F.col("x") * F.col("t_weight")).alias("dot"))
    scored = dots.join(norm, ["__id", "segment"]).select("__id", "license", F.round(F.col("dot") / F.col("norm"), 9).alias("similarity")).filter(F.col("similarity") >= threshold)
    return best_of(scored)


def best_of(scored: DataFrame) -> DataFrame:
    """Of (__id, license, similarity) the most similar of each __id: (__id, own_license, similarity)."""
    best = scored.groupBy("__id").agg(F.min(F.struct((-F.col("similarity")).alias("less"), "license")).alias("b"))
    return best.select("__id", F.col("b.license").alias("own_license"), (-F.col("b.less")).alias("similarity"))


def _titled(text: Column) -> Column:
    """What the title lines of the GNU licences in a text say, as their full texts differ in few words: one name, the lesser licence where the general one that it refers to follows it, or several."""
    lines = F.regexp_extract_all(text, F.lit(TITLE), F.lit(0))
    version = lambda x: F.regexp_extract(x, r"([0-9]+(?:\.[0-9]+)?)$", 1)
    kind = lambda x: F.when(x.contains("AFFERO"), "AGPL-").when(x.contains("LESSER") | x.contains("LIBRARY"), "LGPL-").otherwise("GPL-")
    names = F.array_sort(F.array_distinct(F.transform(lines, lambda x: F.concat(kind(x), version(x), F.when(version(x).contains("."), "").otherwise(".0")))))
    lesser = F.filter(names, lambda x: x.startswith("LGPL-"))
    pair = (F.size(names) == 2) & (F.size(lesser) == 1) & F.exists(names, lambda x: x.startswith("GPL-"))
    return F.when(pair, lesser[0]).when(F.size(names) > 0, F.array_join(names, " AND "))


def scan(files: DataFrame, key: str, url: str, text: str, threshold: float = 0.6) -> DataFrame:
    """One row per row of ``files``: key, host, directory, own_license, similarity, inherited_license, inherited_from, license.

    ``key`` names the rows and should be unique: rows that repeat a key share what is found in any of them. A null key, text or URL gives a
    row with nothing found; a URL without :// has an empty host and directory, which no file shares. Of several declarations for one
    directory that of a licence file precedes an index page's, then the higher similarity, then the first name. Other columns are ignored. Texts are read whole however
    long they are, an empty table has no rows, and a key that is called as another column of the result is refused.
    """
    if key.lower() in RESULT:
        raise ValueError(f"{key} is a column of the result; rename the key")
    path = path_of(F.col(url))
    base = files.select(F.col(key).alias("__id"), F.col(text).alias("__text"), host_of(F.col(url)).alias("host"), path.alias("path"))
    base = base.withColumn("__name", F.regexp_extract("path", r"([^/]*)$", 1)).withColumn("directory", F.regexp_replace("path", r"[^/]*$", ""))
    base = base.withColumn("directory", F.when((F.col("directory") == "") & (F.col("host") != ""), "/").otherwise(F.col("directory")))
    # An index page with a bare last step, as /a/b, and the directory /a/b/ are different places; only the latter is an index.
    is_file, is_index = F.col("__name").rlike(LICENCE_FILE), F.col("__name").rlike(INDEX_FILE)
    named = base.filter("__id is not null")
    notices = matches(segments(named, "__text", is_file), threshold, TEMPLATES)
    full = matches(segments(named.filter(is_file), "__text", F.lit(True)), FULL, full_texts())
    found = best_of(notices.unionByName(full).withColumnRenamed("own_license", "license"))
    slim = base.select("__id", "host", "directory", F.when(is_file, 0).when(is_index, 1).alias("rank"), F.when(is_file, _titled(F.col("__text"))).alias("__titled"))
    own = slim.join(found, "__id", "left")
    own = own.withColumn("own_license", F.when(F.col("own_license").rlike("^L?GPL-"), F.coalesce("__titled", "own_license")).otherwise(F.col("own_license"))).drop("__titled")
    declared = own.filter("own_license is not null and rank is not null and host <> ''").groupBy("host", "directory").agg(F.min(F.struct("rank", (-F.col("similarity")).alias("less"), "own_license")).alias("d"))
    declared = declared.select("host", F.col("directory").alias("ancestor"), F.col("d.own_license").alias("given"))
    wanting = own.filter("own_license is null and host <> ''").select("host", "directory").distinct()
    # The ancestors of /a/b/ are /a/b/, /a/ and /.
    parts = F.split(F.regexp_replace("directory", r"^/|/$", ""), "/")
    above = wanting.select("host", "directory", F.explode(F.when(F.col("directory") == "/", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(parts)))).alias("depth"))
    above = above.withColumn("ancestor", F.when(F.col("depth") == 0, "/").otherwise(F.concat(F.lit("/"), F.concat_ws("/", F.slice(parts, 1, F.greatest("depth", F.lit(1)))), F.lit("/"))))
    nearest = above.join(declared, ["host", "ancestor"]).groupBy("host", "directory").agg(F.max(F.struct("depth", "ancestor", "given")).alias("n"))
    nearest = nearest.select("host", "directory", F.col("n.given").alias("given"), F.col("n.ancestor").alias("from"))
    out = own.join(nearest, ["host", "directory"], "left")
    lacking = F.col("own_license").isNull()
    return out.select(
        F.col("__id").alias(key), "host", "directory", "own_license", F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
        F.when(lacking, F.col("given")).alias("inherited_license"), F.when(lacking, F.col("from")).alias("inherited_from"), F.coalesce("own_license", "given").alias("license"),
    )

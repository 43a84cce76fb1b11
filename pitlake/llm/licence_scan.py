"""Licence scans: sparse TF-IDF cosine to templates, then inheritance along directories, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from .common import let, query, same, table

# Notices, and paragraphs of licence files, by their usual identifiers.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "Apache License 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("GPL-2.0", "Licensed under the GNU General Public License, Version 2"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("GPL-3.0", "Licensed under the GNU General Public License, Version 3"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, Version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, Version 3"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("EPL-2.0", "SPDX-License-Identifier: EPL-2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0"),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
]
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Terms around which a file is compared with templates; every template has one. And what a text must hold to have any.
ANCHOR = r"licen[sc]|^permission$|^redistribution$|^domain$"
HINT = r"licen[sc]|permission|redistribution|domain"
#: Least cosine of a match, and least part of a template's length that a window's known words must make up.
LEAST_COSINE = 0.85
LEAST_KNOWN = 0.5
#: Templates are compared by shape, of which the plan holds a list.
MAX_TEMPLATES = 1000


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def vectors(templates: DataFrame) -> DataFrame:
    """``template``, ``licence``, ``n`` (its number of words), ``o`` (words before its first anchor), ``term``, ``idf``, ``v`` (weight) and ``size`` (length of the vector)."""
    count = templates.count()
    if count > MAX_TEMPLATES:
        raise ValueError(f"at most {MAX_TEMPLATES} templates")
    words = templates.select("template", "licence", terms(F.col("text")).alias("t"))
    first = let(F.col("t"), lambda t: F.get(F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: F.get(t, i - 1).rlike(ANCHOR)), 0))
    shaped = words.where(F.size("t") > 0).select("template", "licence", F.size("t").alias("n"), (first - 1).alias("o"), F.explode("t").alias("term")).where("o is not null")
    each = shaped.groupBy("template", "licence", "n", "o", "term").agg(F.count(F.lit(1)).alias("tf"))
    held = each.groupBy("term").agg((F.log(F.lit(1.0 + count) / (1 + F.count(F.lit(1)))) + 1).alias("idf"))
    raw = each.join(held, "term").withColumn("v", F.col("tf") * F.col("idf"))
    length = raw.groupBy("template").agg(F.sqrt(F.sum(F.col("v") ** 2)).alias("size"))
    return materialise(raw.join(length, "template").select("template", "licence", "n", "o", "term", "idf", "v", "size"), "licence-templates")


def windows(files: DataFrame, vector: DataFrame, repository: str, path: str, text: str) -> DataFrame:
    """``repository``, ``path``, ``key``, ``n``, ``o`` and ``words``: what stands where a template might.

    For each anchor in a whole text and each shape (number of words, words before the first anchor) of
    a template: the stretch that the template would cover, reduced to words that any template has.
    So comments, names and sentences around a notice don't count against it, and copies of a notice
    among other words are the same row. Stretches with too few known words are left out.
    """
    shapes = [tuple(r) for r in vector.select("n", "o").distinct().orderBy("n", "o").collect()]
    known = [r.term for r in vector.select("term").distinct().orderBy("term").collect()]
    schema = "repository string, path string, key binary, n int, o int, words array<string>"
    if not shapes:
        return files.sparkSession.createDataFrame([], schema)
    # the words are found once for a text, not once for each word that is looked at
    read = let(terms(F.col(text)), lambda t: F.struct(
        F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: (i <= F.size(t)) & F.get(t, i - 1).rlike(ANCHOR)).alias("at"), F.transform(t, lambda x: F.when(x.isin(known), x)).alias("t")))
    some = files.where(F.lower(F.col(text)).rlike(HINT)).select(F.col(repository).alias("repository"), F.col(path).alias("path"), read.alias("r"))
    at = some.select("repository", "path", F.col("r.t").alias("t"), F.explode("r.at").alias("a"))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(o).alias("o")) for n, o in shapes])).alias("s")
    begin, over = F.greatest(F.lit(1), F.col("a") - F.col("s.o")), F.least(F.lit(0), F.col("a") - F.col("s.o") - 1)
    cut = at.select("*", each).select("repository", "path", F.col("s.n").alias("n"), F.col("s.o").alias("o"), F.filter(F.slice("t", begin, F.col("s.n") + over), lambda x: x.isNotNull()).alias("words"))
    enough = cut.where(F.size("words") >= F.col("n") * LEAST_KNOWN)
    key = F.unhex(F.md5(F.concat_ws(" ", F.col("n").cast("string"), F.col("o").cast("string"), F.array_join("words", " "))))
    return enough.select("repository", "path", key.alias("key"), "n", "o", "words")


def matches(window: DataFrame, vector: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """``key``, ``template``, ``licence``, ``cosine`` and ``mass`` (the part of the template that is there) of distinct windows near a template of their shape.

    Sparse vectors of TF-IDF weights; only terms are joined, and only distinct windows.
    """
    once = window.groupBy("key").agg(F.first(F.struct("n", "o", "words")).alias("w"))
    each = once.select("key", F.col("w.n").alias("n"), F.col("w.o").alias("o"), F.explode("w.words").alias("term")).groupBy("key", "n", "o", "term").agg(F.count(F.lit(1)).alias("tf"))
    idf = vector.select("term", "idf").distinct()
    weighed = each.join(idf, "term").withColumn("u", F.col("tf") * F.col("idf")).drop("idf")
    length = weighed.groupBy("key").agg(F.sqrt(F.sum(F.col("u") ** 2)).alias("length"))
    dot = weighed.join(vector.select("template", "licence", "n", "o", "term", "v", "size"), ["n", "o", "term"]).groupBy("key", "template", "licence").agg(F.sum(F.col("u") * F.col("v")).alias("dot"), F.max("size").alias("size"))
    cosine = F.round(F.col("dot") / F.col("length") / F.col("size"), 6)
    near = dot.join(length, "key").select("key", "template", "licence", cosine.alias("cosine"), F.col("size")).where(F.col("cosine") >= least)
    return near.select("key", "template", "licence", "cosine", (F.col("cosine") * F.col("size")).alias("mass"))


def own_licences(files: DataFrame, templates: DataFrame, repository: str, path: str, text: str, least: float = LEAST_COSINE) -> DataFrame:
    """``repository``, ``path``, ``own_licence`` and ``cosine`` of the files near any template.

    All templates of a licence that a file holds speak for it, each by the part of it that is there; so a
    sentence that two licences share does not decide between them, and the passage with the version or
    the further clause does. Equal ones go to the first identifier. The cosine is that of the licence's best passage.
    """
    vector = vectors(templates)
    window = materialise(windows(files, vector, repository, path, text), "licence-windows")
    found = window.select("repository", "path", "key").join(matches(window, vector, least), "key")
    best = found.groupBy("repository", "path", "template", "licence").agg(F.max("cosine").alias("cosine"), F.max("mass").alias("mass"))
    by = best.groupBy("repository", "path", "licence").agg(F.max("cosine").alias("cosine"), F.round(F.sum("mass"), 4).alias("mass"))
    top = by.groupBy("repository", "path").agg(F.min(F.struct((-F.col("mass")).alias("m"), "licence", "cosine")).alias("b"))
    return top.select("repository", "path", F.col("b.licence").alias("own_licence"), F.col("b.cosine").alias("cosine"))


def directory(path: Column) -> Column:
    """All of a path up to its last slash; the root is empty."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(files: DataFrame, templates: DataFrame, is_licence_file: Column, repository: str = "repository", path: str = "path", text: str = "text", least: float = LEAST_COSINE) -> DataFrame:
    """Add ``own_licence``, ``cosine``, ``licence``, ``inherited_from`` to files, whose text is left out.

    A file's own licence is that whose notices it holds. A licence file (``is_licence_file``)
    also gives its licence to its directory, the best match (then first identifier) if there are
    several; a file without its own takes that of the nearest directory above it, ``inherited_from``.
    Ancestors are looked up once for each distinct directory, one row a level, so files are joined by
    directory only. Rows of one repository and path are one file. NULL or empty texts have no
    notices; a NULL path has no directory; NULL repositories are one. Columns of the four names are
    replaced, all others but the text stay, whatever their names.
    """
    own_names = ["own_licence", "cosine", "licence", "inherited_from"]
    rest = [c for c in files.columns if c not in (text, *own_names)]
    marked = files.select(
        F.struct(*rest).alias("_row"), F.col(repository).cast("string").alias("_repository"), F.col(path).alias("_path"), F.col(text).alias("_text"), F.coalesce(is_licence_file, F.lit(False)).alias("_file"))
    own = materialise(own_licences(marked, templates, "_repository", "_path", "_text", least).withColumnsRenamed({"repository": "_r", "path": "_p"}), "licence-own")
    listed = marked.filter("_file").select(F.col("_repository").alias("repository"), F.col("_path").alias("path")).distinct()
    given = listed.join(own, same(F.col("repository"), F.col("_r")) & (F.col("path") == F.col("_p")))
    by_directory = given.groupBy(F.col("repository").alias("_r"), directory(F.col("path")).alias("_d")).agg(F.min(F.struct((-F.col("cosine")).alias("c"), "own_licence")).alias("b"))
    by_directory = by_directory.select("_r", "_d", F.col("b.own_licence").alias("given"))
    places = marked.filter("_path is not null").select(F.col("_repository").alias("repository"), directory(F.col("_path")).alias("directory")).distinct()
    parts = F.split("directory", "/")
    ancestors = F.when(F.col("directory") == "", F.array(F.lit(""))).otherwise(
        F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))))
    above = places.select("repository", "directory", F.posexplode(ancestors).alias("level", "ancestor"))
    nearest = above.join(by_directory, same(F.col("repository"), F.col("_r")) & (F.col("ancestor") == F.col("_d"))).groupBy("repository", "directory").agg(
        F.max_by(F.struct("given", "ancestor"), "level").alias("n"))
    inherited = materialise(nearest.select(F.col("repository").alias("_ir"), F.col("directory").alias("_id"), F.col("n.given").alias("_given"), F.col("n.ancestor").alias("_from")), "licence-inherited")
    out = marked.drop("_text", "_file").withColumn("_dir", directory(F.col("_path")))
    out = out.join(own, same(F.col("_repository"), F.col("_r")) & (F.col("_path") == F.col("_p")), "left")
    out = out.join(inherited, same(F.col("_repository"), F.col("_ir")) & (F.col("_dir") == F.col("_id")), "left")
    return out.select("_row.*", "own_licence", "cosine", F.coalesce("own_licence", "_given").alias("licence"), F.when(F.col("own_licence").isNull(), F.col("_from")).alias("inherited_from"))


def template_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, licence, text) for i, (licence, text) in enumerate(TEMPLATES)], "template int, licence string, text string")


def digit_path(key: Column) -> Column:
    """A place in a tree of directories: all digits of an id but the last two, one a level, then the id."""
    digits = F.split(key.cast("string"), "")
    above = F.greatest(F.size(digits) - 2, F.lit(0))
    return F.concat_ws("/", F.slice(digits, F.lit(1), above), F.array(key.cast("string")))


@query("op10_licence_scan")
def licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a repository per source; one that begins with a licence notice is its directory's licence file."""
    path = F.when(F.col("doc_id").isNotNull(), digit_path(F.col("doc_id")))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("repository"), path.alias("path"), "text")
    begins = F.lower(F.substring_index("text", "\n", 1)).contains("licens")
    return scan(docs, template_table(spark), begins).select("doc_id", "repository", "path", "own_licence", "cosine", "licence", "inherited_from")

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pitlake.llm import licence_scan as s

SCHEMA = "repository string, path string, text string, licence string"


def licence_of(text):
    """Every anchor, template and window by plain counting."""
    split = lambda t: re.findall(s.TERM, t.lower())
    n, words = len(s.TEMPLATES), [split(t) for _, t in s.TEMPLATES]
    idf = {w: math.log((1 + n) / (1 + sum(w in t for t in words))) + 1 for t in words for w in t}
    vector = lambda t: {w: k * idf[w] for w, k in Counter(t).items()}
    length = lambda v: math.sqrt(sum(x * x for x in v.values()))
    t, best = split(text), {}
    for i, w in enumerate(t):
        if not re.search(s.ANCHOR, w):
            continue
        for j, ((name, _), own) in enumerate(zip(s.TEMPLATES, words)):
            o = next(k for k, x in enumerate(own) if re.search(s.ANCHOR, x))
            window = [x for x in t[max(0, i - o) : i - o + len(own)] if x in idf]
            if len(window) >= len(own) * s.LEAST_KNOWN:
                u, v = vector(own), vector(window)
                c = round(sum(v.get(x, 0) * y for x, y in u.items()) / length(u) / length(v), 6)
                if c >= s.LEAST_COSINE:
                    best[j] = max(best.get(j, (0, 0)), (c, c * length(u)))
    by = {}
    for j, (c, mass) in best.items():
        k, m = by.get(s.TEMPLATES[j][0], (0, 0))
        by[s.TEMPLATES[j][0]] = (max(k, c), m + mass)
    return min(((-round(m, 4), name, c) for name, (c, m) in by.items()), default=(None, None, None))[1:]


APACHE = """/*
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *     http://www.apache.org/licenses/LICENSE-2.0
 */
int main() { return 0; }"""
GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version."""
BSD = """Copyright (c) 2011, Somebody. All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice."""
NOTICES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", APACHE,
        "Copyright 2020 Example Corp. All rights reserved. Licensed under the Apache License, Version 2.0.", "# SPDX-License-Identifier: Apache-2.0", "word " * 40_000 + APACHE],
    "MIT": ["This file is licensed under the MIT License. See the LICENSE file for details.", "SPDX-License-Identifier: MIT", "x = 1  // SPDX-License-Identifier: MIT\ny = 2",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")"],
    "GPL-3.0": [GPL, "// This work is licensed under the GNU General Public License, version 3."],
    "GPL-2.0": [GPL.replace("software:", "software;").replace("version 3", "version 2")],
    "BSD-2-Clause": [BSD],
    "BSD-3-Clause": [BSD + "\nNeither the name of X nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0"],
    None: ["a licensed electrician", "licensed under the Foo License", "The license was granted to the driver in June 2007.", "Permission to enter the public domain of the city", "", None, "no notice at all", "licensed"],
}
PASSAGES = ["Licensed under the Apache License, Version 2.0.", "", "", "", "", "Licensed under CC BY 4.0"]


def test_usual_notices_among_other_words(spark):
    texts = [(name, t) for name, each in NOTICES.items() for t in each]
    files = spark.createDataFrame([("r", str(i), t) for i, (_, t) in enumerate(texts)], "repository string, path string, text string")
    got = {int(r.path): (r.own_licence, r.cosine) for r in s.own_licences(files, s.template_table(spark), "repository", "path", "text").collect()}
    for i, (name, t) in enumerate(texts):
        assert got.get(i, (None, None))[0] == name, t[-300:] if t else t
        if t:
            want = licence_of(t)
            assert got.get(i, (None, None)) == (want[0], pytest.approx(want[1]) if want[1] else None)


def test_clashing_columns_stay(spark):
    rows = [("r", "LICENSE", PASSAGES[0], "x", 1, "f"), ("r", "a/b.py", None, "y", 2, "g")]
    files = spark.createDataFrame(rows, "repository string, path string, text string, _file string, _r int, _dir string").withColumns({"cosine": F.lit("old"), "n": F.lit(5), "key": F.lit("k")})
    out = s.scan(files, s.template_table(spark), F.col("path").endswith("LICENSE"))
    assert out.columns == ["repository", "path", "_file", "_r", "_dir", "n", "key", "own_licence", "cosine", "licence", "inherited_from"]
    assert sorted((r.path, r._file, r._r, r._dir, r.n, r.key, r.licence) for r in out.collect()) == [("LICENSE", "x", 1, "f", 5, "k", "Apache-2.0"), ("a/b.py", "y", 2, "g", 5, "k", "Apache-2.0")]


def test_inheritance_takes_the_nearest_directory(spark):
    apache, mit, by = PASSAGES[0], "Released under the MIT License", PASSAGES[5]
    rows = [
        ("r", "LICENSE", apache, ""), ("r", "a/LICENSE", mit, ""), ("r", "a/b/c/x.py", "code", ""), ("r", "ab/x.py", "code", ""), ("r", "a/own.py", f"code\n{by}\nmore", ""),
        ("r", "d/LICENSE", "nothing known", ""), ("r", "d/e/x.py", None, ""), ("q", "a/x.py", "", ""), (None, "LICENSE", mit, ""), (None, "z/x.py", "code", ""), ("r", None, "code", ""),
        ("r", "a/b/c/x.py", "code", ""), ("r", "long/x.py", "word " * 50_000 + "\n\n" + apache, ""),
    ]
    out = s.scan(spark.createDataFrame(rows, SCHEMA), s.template_table(spark), F.col("path").endswith("LICENSE")).collect()
    assert len(out) == len(rows)
    got = {(r.repository, r.path): (r.licence, r.inherited_from) for r in out}
    assert got[("r", "a/b/c/x.py")] == ("MIT", "a") and got[("r", "ab/x.py")] == ("Apache-2.0", "")
    assert got[("r", "a/own.py")] == ("CC-BY-4.0", None) and got[("r", "d/e/x.py")] == ("Apache-2.0", "")
    assert got[("q", "a/x.py")] == (None, None) and got[(None, "z/x.py")] == ("MIT", "") and got[("r", None)] == (None, None)
    assert got[("r", "long/x.py")] == ("Apache-2.0", None)


def test_empty_tables_and_paths(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert s.scan(none, s.template_table(spark), F.lit(False)).count() == 0
    ids = spark.createDataFrame([(7,), (123,), (51281,)], "i long").select(s.digit_path(F.col("i")).alias("p"))
    assert [r.p for r in ids.collect()] == ["7", "1/123", "5/1/2/51281"]

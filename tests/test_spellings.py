"""Spellings are hashed once for all lengths of the first word; white space as before."""

import re
import unicodedata

from pyspark.sql import functions as F

from pitlake.functions.names import normalise_name
from pitlake.operators import joins as J


def test_a_spelling_is_hashed_once_for_all_lengths(spark):
    rest = " son of the smith who lives near the river"
    names = ["konstantin" + rest, "konrad" + rest, "kon" + rest, "ann", "anna lee", "anne  lee", "", None, "annabel lee"]
    people = spark.createDataFrame(list(enumerate(names)), "code long, name string")
    variants = people.select(normalise_name("name").alias("norm"), "code", F.col("code").alias("ord"))
    index = J.prefix_index(variants, "code")
    exploded = [x for x in index._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate " in x]
    assert exploded and not any("norm#" in x for x in exploded)
    probes = spark.createDataFrame([(x,) for x in ["konstan" + rest, "kon" + rest, "konr" + rest, "ko" + rest, "an lee", "ann lee", "ANNAB lee", "anna", "ann", "anne lee", "", None]], "name string")
    got = {r.name: r.code for r in J.match_names(probes, "name", variants, "code").collect()}
    norms = [(x and " ".join(x.lower().split()), i) for i, x in enumerate(names)]

    def brute(probe):
        if probe is None:
            return None
        p = " ".join(probe.lower().split())
        exact = [i for x, i in norms if x == p]
        first, _, tail = p.partition(" ")
        short = [i for x, i in norms if x and " " in x and tail and x.partition(" ")[2] == tail and x.startswith(first) and 3 <= len(first) < len(x.partition(" ")[0])]
        return min(exact) if exact else min(short) if short else None

    assert got == {x: brute(x) for x in got}


def test_white_space_of_names(spark):
    names = ["a b", " a  b ", "a\tb\n", "É  o\u00a0x", "", "  ", "a \u0085", "x\u2003y", None]
    got = spark.createDataFrame([(x,) for x in names], "n string").select("n", normalise_name("n").alias("m")).collect()
    plain = lambda x: "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))
    assert {r.n: r.m for r in got} == {x: x if x is None else re.sub(r"[ \t\n\x0b\f\r]+", " ", plain(x).lower()).strip(" ") for x in names}
    parts = spark.createDataFrame([(1, "O'x 'Nick' y", " de la  Cruz ", "Cruz")], "code long, f string, s string, w string")
    rows = [(r.norm, r.ord) for r in J.name_variants(parts, "code", "code", "f", "s", "w").collect()]
    assert {("o'x 'nick' y cruz", 12), ("de la cruz", 14), ("cruz", 11)} <= set(rows)

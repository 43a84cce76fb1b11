import random
import re

import pytest

from pitlake.llm import jaccard_join as j
from pitlake.llm.graph import components


def shingles(text, size=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute(rows, percent=90):
    """All pairs of rows, then a walk over the links."""
    sets = [shingles(t) for _, t in rows]
    part = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                old, new = part[a], part[b]
                part = [new if p == old else p for p in part]
    least = {}
    for (k, _), p in zip(rows, part):
        if k is not None:
            least[p] = min(k, least.get(p, k))
    return sorted((repr(k), len(s), repr(least.get(p))) for (k, _), s, p in zip(rows, sets, part))


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = rng.choices(vocabulary, k=25)
    rows = []
    for base in range(25):
        words = rng.choices(vocabulary, k=rng.choice([1, 2, 3, 4, 12, 40, 90, 150]))
        if base % 3 == 0:
            words[1:1] = passage
        for _ in range(rng.randint(1, 7)):
            w = list(words)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(w).title() if rng.random() < 0.3 else " ".join(w)))
    chain = [f"c{i}" for i in range(60)]
    for i in range(40):
        rows.append((1000 - i, " ".join(chain)))
        chain[(7 * i) % 60] = f"n{i}"
    rows += [(2000, None), (2001, ""), (2002, " \n\t"), (None, rows[0][1]), (None, "only null ids here"), (None, "only null ids here"), (3, rows[3][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [0, 1])
@pytest.mark.parametrize("percent", [90, 60])
def test_components_match_brute_force(spark, seed, percent):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    keyed, merged = j.groups(docs, percent=percent)
    got = j.attach(keyed, merged).collect()
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in got) == brute(rows, percent)


def test_sampling_never_drops_a_partner(spark):
    rows = corpus(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for share in (0.01, 0.99):
        keyed, merged = j.groups(docs, share=share)
        got = j.attach(keyed, merged).collect()
        assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in got) == brute(rows)


def test_stage_keeps_one_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(2, text, "en"), (1, text, "fr"), (1, text, "fr"), (3, text + " x", None), (4, None, "en"), (5, "", "en"), (None, "alone here now", "en"), (6, "other words", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_shingles string")
    out = j.stage(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(map(repr, (r.doc_id for r in out.collect()))) == ["1", "4", "5", "6", "None"]
    assert j.stage(spark, docs.limit(0), "").count() == 0


def test_long_chains_contract(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 501), (501, 500), (7, 7), (None, 3)], "a long, b long")
    got = {(r.node, r.component) for r in components(links, "a", "b").collect()}
    assert got == {(i, 0) for i in range(301)} | {(500, 500), (501, 500)}

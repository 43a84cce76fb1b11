import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitlake.llm import site_quality as s


def posterior(rows, levels):
    """Moments and shrinkage, level by level, in plain Python."""
    overall = sum(r["_good"] for r in rows) / sum(r["_weight"] for r in rows)
    rate = {(): overall}
    for k in range(1, levels + 1):
        groups = {}
        for r in rows:
            g = groups.setdefault(r["key"][:k], [0.0, 0.0])
            g[0] += r["_good"]
            g[1] += r["_weight"]
        prior = {key: rate[key[:-1]] for key in groups}
        spread = sum(n * (g / n - prior[key]) ** 2 for key, (g, n) in groups.items())
        chance = sum(prior[key] * (1 - prior[key]) for key in groups)
        between = max((spread - chance) / sum(n for _, n in groups.values()), 1e-9)
        strength = min(max(np.mean([p * (1 - p) for p in prior.values()]) / between, s.LEAST_STRENGTH), s.MOST_STRENGTH)
        rate |= {key: (g + strength * prior[key]) / (n + strength) for key, (g, n) in groups.items()}
    return rate


def test_posteriors_match_plain_python(spark):
    rng = random.Random(0)
    rows = []
    for i in range(2000):
        host = rng.choice(["hot"] * 5 + ["a", "b", None, f"h{rng.randint(0, 30)}"])
        path = rng.choice(["x", "y", None])
        weight = rng.choice([0.5, 1.0])
        rows.append({"key": (host, path), "_good": weight * float(rng.random() < (0.9 if host == "hot" else 0.3 if host == "a" else 0.6)), "_weight": weight})
    df = spark.createDataFrame([(*r["key"], r["_good"], r["_weight"]) for r in rows], "host string, path string, _good double, _weight double")
    want = posterior(rows, 2)
    got = s.posteriors(df, ["host", "path"]).collect()
    assert len(got) == sum(len(k) == 2 for k in want)
    for r in got:
        assert r.rate == pytest.approx(want[(r.host, r.path)], abs=1e-9)
    overall = want[()]
    sparse = [r for r in got if r["all"] < 3]
    assert all(abs(r.rate - overall) < abs(r.good / r["all"] - overall) + 0.35 for r in sparse)


def corpus():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    rows, labels = [], []
    for i in range(600):
        good = int(rng.random() < 0.8)
        words = [word() for _ in range(rng.randint(15, 60))]
        rows.append((i, " ".join(words) if good else " ".join(w.upper() + "!! ###" for w in words), rng.choice(["a", "b", None]), rng.choice(["x", None])))
        if i % 2:
            labels.append((i, good))
    return rows + [(None, None, None, None), (9000, "", "new", "z"), (3, rows[3][1], "a", "x")], labels


def test_classifies_and_keeps_clean_documents(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string").withColumn("score", F.lit("clash"))
    out = s.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int"), ["host", "path"]).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    bad = {r[0] for r in rows if r[1] and "###" in r[1]}
    assert all(r.kept != (r.doc_id in bad) for r in out if r.doc_id is not None and r.doc_id < 600)


def test_without_labels_and_rows(spark):
    rows, _ = corpus()
    docs = spark.createDataFrame(rows[:20], "doc_id long, text string, host string, path string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.document_score for r in s.classify(docs, none, ["host", "path"]).collect()} == {0.5}
    assert s.classify(docs.limit(0), none, ["host", "path"]).count() == 0


def left_out(rows, own):
    """The finest posterior of a row from all rows but itself, with the strengths learnt from all, in plain Python."""
    strengths, rate = [], {(): sum(r["_good"] for r in rows) / sum(r["_weight"] for r in rows)}
    sums = {}
    for k in (0, 1, 2):
        for r in rows:
            g = sums.setdefault(r["key"][:k], [0.0, 0.0])
            g[0] += r["_good"]
            g[1] += r["_weight"]
    for k in (1, 2):
        groups = [key for key in sums if len(key) == k]
        prior = {key: rate[key[:-1]] for key in groups}
        spread = sum(sums[key][1] * (sums[key][0] / sums[key][1] - prior[key]) ** 2 for key in groups)
        chance = sum(p * (1 - p) for p in prior.values())
        between = max((spread - chance) / sum(sums[key][1] for key in groups), 1e-9)
        strengths.append(min(max(np.mean([p * (1 - p) for p in prior.values()]) / between, s.LEAST_STRENGTH), s.MOST_STRENGTH))
        rate |= {key: (sums[key][0] + strengths[-1] * prior[key]) / (sums[key][1] + strengths[-1]) for key in groups}
    g, w = own["_good"], own["_weight"]
    out = (sums[()][0] - g) / (sums[()][1] - w)
    for k in (1, 2):
        good, count = sums[own["key"][:k]]
        out = (good - g + strengths[k - 1] * out) / (count - w + strengths[k - 1])
    return out


def sites(n=900):
    """Texts that tell nothing, on a good site, a bad one and many sparse ones, whose labels differ; a part is unlabelled."""
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        host = ("good", "bad", f"sparse{i}")[i % 3]
        rows.append((i, " ".join(rng.choices([f"w{k}" for k in range(40)], k=20)), host, rng.choice(["x", "y"])))
        labels.append((i, int(rng.random() < {"good": 0.97, "bad": 0.03}.get(host, 0.6))))
    return rows, labels


def test_sites_decide_where_texts_do_not(spark):
    rows, labels = sites()
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    out = s.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int"), ["host", "path"]).collect()
    truth, held = dict(labels), lambda r: zlib.crc32(str(r.doc_id).encode()) % 4 == 2
    assert all(held(r) == r.held_out for r in out)
    overall = np.mean([y for i, y in labels])
    for r in out:
        if r.host.startswith("sparse"):
            assert abs(r.site_rate - overall) < 0.15
        else:
            assert r.site_rate > 0.8 if r.host == "good" else r.site_rate < 0.2
    unseen = [r for r in out if held(r) and not r.host.startswith("sparse")]
    right = np.mean([r.kept == truth[r.doc_id] for r in unseen])
    alone = np.mean([(r.document_score >= s.KEEP_FROM) == truth[r.doc_id] for r in unseen])
    assert right > 0.9 and right > alone + 0.2
    assert sum(r.kept != (r.document_score >= s.KEEP_FROM) for r in out) > 50


def test_own_label_is_left_out(spark):
    rows, labels = sites(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    out = s.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int"), ["host", "path"]).collect()
    truth, plain = dict(labels), []
    for r in out:
        weight = s.SOFT_COUNT if r.held_out else 1.0
        plain.append({"key": (r.host, r.path), "_weight": weight, "_good": weight * (r.document_score if r.held_out else truth[r.doc_id])})
    for r, own in zip(out, plain):
        assert r.site_rate == pytest.approx(left_out(plain, own), abs=1e-9)


def test_labels_of_held_out_ids_change_nothing(spark):
    rows, labels = sites(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    a, b = ({r.doc_id: r for r in s.classify(docs, spark.createDataFrame(x, "doc_id long, quality int"), ["host", "path"]).collect()} for x in (labels, flipped))
    assert flipped != labels and all(a[i].score == pytest.approx(b[i].score, abs=1e-9) for i in a)


def test_odd_rows_and_clashing_names(spark):
    rows, labels = corpus()
    long = " ".join(f"word{i % 977}" for i in range(200_000))
    odd = [(7000, long, None, None), (7001, None, None, None), (None, "x", "a", None), (1, rows[1][1], rows[1][2], rows[1][3])]
    names = "_key long, _text string, _good string, _l1 string"
    docs = spark.createDataFrame(rows + odd, names).withColumns({c: F.lit("clash") for c in ("_x", "_p", "_d", "_weight", "site_rate", "prediction")})
    out = s.classify(docs, spark.createDataFrame(labels, "_key long, quality int"), ["_good", "_l1"], key="_key", text="_text").collect()
    assert len(out) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in out)
    assert {r._good for r in out} == {"a", "b", "new", None}


def test_levels_of_urls(spark):
    urls = ["https://A.Example.com/blog/2020/x?q=/y/", "http://h", "http://h/file", "no url", None, "http://h?x=/a/b/", "u://H/a/#/b/"]
    got = [tuple(r) for r in spark.createDataFrame([(u,) for u in urls], "u string").select(*s.url_levels(F.col("u"))).collect()]
    assert got == [("a.example.com", "/blog/"), ("h", ""), ("h", "/"), ("", ""), ("", ""), ("h", ""), ("h", "/a/")]


def test_repeated_word_measure(spark):
    df = spark.createDataFrame([("aa aa b b c",), ("aab ab b",), (None,)], "t string")
    got = [r.m for r in df.select(s.evidence(F.col("t"))["word_twice"].alias("m")).collect()]
    assert got[0] > 0 and got[1:] == [0.0, 0.0]

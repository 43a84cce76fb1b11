"""The random field against enumeration of all labellings, features against plain Python, held-out accuracy, odd rows."""

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pitlake.llm import language as L
from pitlake.llm.words import pieces

SF = "/root/testdata/sf0.01"


def enumerated(scores, change, begin):
    """Posteriors and expected changes of one sequence over all labellings."""
    size, n = scores.shape
    posterior, pairs, total = np.zeros((size, n)), np.zeros((n, n)), 0.0
    for way in itertools.product(range(n), repeat=size):
        w = np.exp(begin[way[0]] + sum(scores[t, x] for t, x in enumerate(way)) + sum(change[a, b] for a, b in zip(way, way[1:])))
        total += w
        for t, x in enumerate(way):
            posterior[t, x] += w
        for a, b in zip(way, way[1:]):
            pairs[a, b] += w
    return posterior / total, pairs / total, np.log(total)


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(1)
    scores, change, begin = rng.normal(size=(6, 5, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    posterior, pairs, total = L.forward_backward(scores, change, begin)
    each = [enumerated(s, change, begin) for s in scores]
    assert np.allclose(posterior, [e[0] for e in each]) and np.allclose(pairs, sum(e[1] for e in each)) and np.allclose(total, [e[2] for e in each])


@pytest.mark.parametrize("block", [1, 2, 3, 256])
def test_posteriors_of_texts_of_any_length(block):
    rng = np.random.default_rng(block)
    sizes = [0, 1, 7, 0, 2, 40, 3, 1, 6, 0]
    first = np.r_[0, np.cumsum(sizes)]
    scores, change, begin = rng.normal(size=(sum(sizes), 3)) * 2, rng.normal(size=(3, 3)) * 2, rng.normal(size=3)
    got = L.marginals(scores, first, change, begin, block)
    for a, b in zip(first, first[1:]):
        if b > a:
            assert np.allclose(got[a:b], L.forward_backward(scores[None, a:b], change, begin)[0][0])
            if b - a < 8:
                assert np.allclose(got[a:b], enumerated(scores[a:b], change, begin)[0])
    far = L.marginals(np.full((5000, 2), -900.0) + [0, 5], np.array([0, 5000]), np.zeros((2, 2)), np.zeros(2), 64)
    assert np.isfinite(far).all() and (far[:, 1] > 0.99).all()


def test_features_are_affixes_and_runs_of_characters():
    texts = ["año Ño, été", "a", "", "été"]
    words = L.words_of(next(pieces(pa.array(texts))))
    assert np.diff(words.first).tolist() == [3, 1, 0, 1]
    assert words.form[2] == words.form[4] and len(words.key) == 4
    for text, at in (("año", 0), ("été", 2), ("a", 3)):
        own = words.of == words.form[at]
        n = len(text)
        assert own.sum() == 1 + 2 * min(n, 3) + sum(max(n - k + 1, 0) for k in (2, 3))
        assert words.weight[own].sum() == pytest.approx(1 + 2 * min(n, 3) + (n >= 2) + (n >= 3))
    # the same affix of two words is one feature: "o" ends año and Ño (case is folded before)
    ends = [set(words.feature[words.of == words.form[i]].tolist()) for i in (0, 1)]
    assert ends[0] & ends[1]


def invented(rng, letters, n):
    return " ".join("".join(rng.choice(list(letters), rng.integers(2, 7))) for _ in range(n))


def test_code_switched_words_get_their_languages():
    rng = np.random.default_rng(4)
    kinds = {"x": "abcdefghij", "y": "ghijklmnop", "z": "mnopqrstuv"}
    texts = [(invented(rng, a, 40), k) for _ in range(60) for k, a in kinds.items()]
    model = L.fit_sample([t for t, _ in texts], [k for _, k in texts])
    assert (np.diag(model.change) > model.change - 10 * np.eye(3)).all()  # languages stay
    mixed = " ".join([invented(rng, kinds["x"], 30), invented(rng, kinds["z"], 30), invented(rng, kinds["y"], 30)])
    posterior = model.tag(L.words_of(next(pieces(pa.array([mixed])))), model.table())
    right = np.repeat([0, 2, 1], 30)
    assert (posterior.argmax(1) == right).mean() > 0.93
    assert [r["lang"] for r in L._runs(posterior, model.languages) if r["words"] > 5] == ["x", "z", "y"]


def test_more_likely_after_fitting():
    rng = np.random.default_rng(6)
    texts = [invented(rng, "abcdef", 30) for _ in range(20)] + [invented(rng, "defghi", 30) for _ in range(20)]
    model = L.fit_sample(texts, ["a"] * 20 + ["b"] * 20)
    held = [invented(rng, "abcdef", 30) for _ in range(20)] + [invented(rng, "defghi", 30) for _ in range(20)]
    words = L.words_of(next(pieces(pa.array(held))))
    posterior = model.tag(words, model.table())
    own = np.repeat([0, 1], 600)
    assert np.log(posterior[np.arange(1200), own]).mean() > np.log(0.5) / 2


def test_held_out_accuracy_and_what_is_not_learnt(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = L.fit(docs)
    got = {r.doc_id: r for r in L.identify(docs, model).collect()}
    assert len(got) == 1000
    held = [r for i, r in got.items() if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 150 and sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    # other texts and languages in held-out rows change nothing
    out = L.held_out(docs.doc_id)
    spoiled = docs.selectExpr("doc_id", "text", "lang").withColumns({"lang": L.F.when(out, "zz").otherwise(docs.lang), "text": L.F.when(out, "spoiled").otherwise(docs.text)})
    again = L.fit(spoiled)
    assert again.languages == model.languages and np.array_equal(again.weight, model.weight)


def test_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i, invented(rng, "abcde", 20) if i % 2 else invented(rng, "vwxyz", 20), "k" if i % 2 else "v", 1.5) for i in range(80)]
    long_text = invented(rng, "abcde", 30_000)
    odd = [(1000, None, "k", 0.0), (1001, "", None, 0.0), (1002, "123 -- !", "v", 0.0), (1003, long_text, None, 0.0), (None, "abc abd", "k", 0.0), (1004, "— …", "k", 0.0), (3, "abc bad cab", "k", 0.0), (3, "abc bad cab", "k", 0.0)]
    schema = "doc_id long, text string, lang string, score double"
    df = spark.createDataFrame(rows + odd, schema)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = L.language_id(spark, str(tmp_path)).collect()
    assert len(got) == 88
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1000, 1001, 1002, 1003, 1004, None)] == ["und", "und", "und", "k", "und", "k"]
    assert by[1002].score == 0 and not by[None].held_out
    assert [r.lang_pred for r in got if r.doc_id == 3] == ["k"] * 3
    runs = L.identify(df, L.fit(df), runs=True).where("doc_id in (1003, 1002)").select("doc_id", "score", "runs").collect()
    assert {r.doc_id: sum(x.words for x in r.runs) for r in runs} == {1003: 30_000, 1002: 0}
    nothing = L.identify(df, L.fit(df.where("lang is null")))
    assert {(r.lang_pred, r.score) for r in nothing.collect()} == {("und", 0.0)}
    empty = df.limit(0)
    assert L.identify(empty, L.fit(empty)).count() == 0

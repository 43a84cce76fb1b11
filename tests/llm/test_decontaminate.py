import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitlake.llm import decontaminate as d
from pitlake.llm.fm_index import FMIndex

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def brute(docs, items, window):
    """Word lists compared position by position."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = {}
    for key, text in docs:
        words = split(text)
        hit, names = set(), set()
        for item, body in items:
            own = split(body)
            for p in {tuple(own[i : i + window]) for i in range(max(1, len(own) - window + 1))} if own else ():
                for i in range(len(words) - len(p) + 1):
                    if tuple(words[i : i + len(p)]) == p:
                        hit |= set(range(i, i + len(p)))
                        names.add(str(item))
        out[key] = (len(words), len(hit), sorted(names))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_index_finds_what_a_scan_finds(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(1, 4, 400)
    starts = np.unique(np.r_[0, rng.integers(1, 400, 15)])
    index = FMIndex(text, starts, 5)
    phrases = [rng.integers(1, 6, n) for n in rng.integers(1, 7, 60)]
    table = np.zeros((60, 6), np.int64)
    for i, p in enumerate(phrases):
        table[i, : len(p)] = p
    lengths = np.array([len(p) for p in phrases])
    low, high = index.search(table, lengths)
    ends = np.append(starts[1:], len(text))
    for i, p in enumerate(phrases):
        want = [j for s, e in zip(starts, ends) for j in range(s, e - len(p) + 1) if (text[j : j + len(p)] == p).all()]
        assert sorted(index.locate(np.arange(low[i], high[i]))) == want


def fixture():
    rng = random.Random(3)
    words = ["Alpha", "beta", "Été", "x1", "the", "of"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(100, None), (101, ""), (102, "... !!"), (None, texts[3]), (5, texts[5])]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([3, 4, 12, 5, 2, 1])] + [
        (20, None), (21, "--"), (22, texts[7]), (23, texts[7])]
    return docs, items


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_matches_brute_force(spark, block):
    docs, items = fixture()
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = d.find(frame, bench, window=4, block_chars=block).select("doc_id", "text", "found.*").collect()
    want = {}
    for key, text in docs:
        want[(key, text)] = brute([(key, text)], items, 4)[key]
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_words, r.n_hit, sorted(r["items"])) == want[(r.doc_id, r.text)]
        if r.text:
            inside = sum(len(d.WORD.findall(r.text[s.start : s.end])) for s in r.spans)
            assert inside == r.n_hit


def test_empty_tables_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "clash")], "doc_id long, text string, found string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.find(docs, none).select("found.n_words", "found.n_hit").first() == (3, 0)
    assert d.find(docs.limit(0), none).count() == 0


def test_stage_cuts_passages_only(spark, tmp_path):
    passage = " ".join(f"w{i}" for i in range(30))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, f"Before. {passage}! After", "en", "s", 9), (2, "clean text", "en", "s", 10), (3, None, None, None, None), (4, passage, "en", "s", 1)]
    out = {r.doc_id: r for r in d.stage(spark, spark.createDataFrame(rows, DOC), str(tmp_path)).collect()}
    assert out[1].text == "Before. ! After" and out[1].n_chars == 15
    assert (out[2].text, out[2].n_chars) == ("clean text", 10)
    assert out[3].text is None and out[3].n_chars is None
    assert out[4].text == "" and out[4].n_chars == 0


CASED = [
    ("A I THE passage", "Alpha Beta gAmMa X delta EPSILON zETA Eta Theta IoTa", "B C after it"),
    ("The", "ALPHA BETA GAMMA X DELTA EPSILON ZETA ETA THETA IOTA", "McTavish WENT"),
    ("camelCase iPhone I", "alpha beta gamma x delta epsilon zeta eta theta iota", "End"),
]


def test_words_of_raw_and_folded_text_agree():
    for text in [*(" ".join(c) for c in CASED), "A", "iPhone [X] `Y` @Z {W} x_Y", "Été ÀB c\x7fD", "I"]:
        assert [m[0].encode().translate(d.FOLD) for m in d.WORD.finditer(text)] == d.words(text)


def test_spans_of_capitals_in_one_and_several_blocks(spark, tmp_path):
    items = [(1, "alpha beta gamma x delta epsilon zeta eta theta iota"), (2, "Other Words A b C"), (3, "I AM")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, " ".join(c)) for i, c in enumerate(CASED)] + [(9, "I am. OTHER words a B c; A Clean End")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (1 << 20, 10):
        got = {r.doc_id: r for r in d.find(docs, bench, block_chars=block).select("doc_id", "text", "found.*").collect()}
        for i, (before, passage, after) in enumerate(CASED):
            r = got[i]
            assert [r.text[s.start : s.end] for s in r.spans] == [passage]
            assert (r.n_words, r.n_hit) == (len(r.text.split()), 10)
        assert [got[9].text[s.start : s.end] for s in got[9].spans] == ["I am. OTHER words a B c"] and (got[9].n_words, got[9].n_hit) == (10, 7)
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(i, t, "en", "s", len(t)) for i, t in rows]
    out = {r.doc_id: r.text for r in d.stage(spark, spark.createDataFrame(rows, DOC), str(tmp_path)).collect()}
    assert out == {**{i: f"{a}  {c}" for i, (a, _, c) in enumerate(CASED)}, 9: "; A Clean End"}


def test_stage_keeps_clashing_columns_and_needs_no_size(spark, tmp_path):
    passage = " ".join(f"w{i}" for i in range(12))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = ["_found", "found", "_spans", "spans", "row", "new", "a.b"]
    docs = spark.createDataFrame([(1, f"x {passage} y"), (2, None), (3, ""), (None, "clean"), (1, f"x {passage} y")], "doc_id long, text string")
    docs = docs.select("*", *(d.F.lit(f"own {n}").alias(n) for n in names))
    out = d.stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    rows = [tuple(r) for r in out.collect()]
    own = tuple(f"own {n}" for n in names)
    assert sorted(rows, key=str) == sorted([(1, "x  y", *own), (2, None, *own), (3, "", *own), (None, "clean", *own), (1, "x  y", *own)], key=str)


def test_passage_in_a_very_long_text(spark, tmp_path):
    passage = [f"w{i}" for i in range(10)]
    spark.createDataFrame([("a", " ".join(passage))], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    words = [f"v{i % 5000}" for i in range(300_000)]
    for at in (0, 150_000, 299_990):
        words[at : at + 10] = passage
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "short")], "doc_id long, text string")
    out = {r.doc_id: r.found for r in d.find(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).collect()}
    assert (out[1].n_words, out[1].n_hit, out[1]["items"], len(out[1].spans)) == (300_000, 30, ["a"], 3) and out[2].n_hit == 0

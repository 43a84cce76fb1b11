import random
import re
from collections import Counter

from pyspark.sql import functions as F

from pitlake.llm import quality_rules as q

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            inside |= set(range(i, i + 5))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def prose(rng, n=80):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n)) + "."


def test_base_measures_match_brute_force(spark):
    rng = random.Random(0)
    texts = [None, "", " \t\n\x0b\x0c\r ", "one", "a\x1cb c d", "x y z x y z x y z x y z", "é😀 é😀\n\né😀 é😀\r\n a | b # <c>", "\n".join(["same line here"] * 5 + [" ", "same line here "])]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 60))) for _ in range(40)] + ["w " * 30_000, "y" * 200_000]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    got = q.measure(spark.createDataFrame(rows, SCHEMA)).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text), r.text[:80] if r.text else r.text


def corpus():
    rng = random.Random(1)
    rows = [(i, prose(rng), ["en", "de", None][i % 3], ["a", "b", None][i % 2], 1) for i in range(900)]
    rows += [(1000 + i, " ".join(w + "###" for w in prose(rng).split()), "en", "a", 1) for i in range(20)]
    rows += [(2000 + i, prose(rng).upper(), "en", "b", 1) for i in range(20)]
    rows += [(3000, None, "en", "a", None), (3001, "short text", None, None, 1), (3002, prose(rng), "xx", "rare", 1), (3003, "again and again it is " * 20, "en", "a", 1), (5, rows[5][1], "en", "a", 1)]
    return rows


def test_adaptive_verdicts(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    measured = q.materialise(q.measure(docs).drop("text"), "test")
    out = {r.doc_id: r for r in q.judge(measured, ["lang", "source"]).collect()}
    assert len(out) == 944
    assert all(out[i].kept for i in range(900)) and out[3002].kept
    assert not any(out[i].kept or out[i].base_failed for i in [*range(1000, 1020), *range(2000, 2020)])
    assert all(out[i].base_failed and not out[i].kept for i in (3000, 3001, 3003))


def test_sketches_merge_to_the_same_quartiles(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    measured = q.materialise(q.measure(docs).drop("text"), "test")
    whole = q.sketch(measured, ["lang"])
    halves = q.sketch(measured.filter("doc_id % 2 = 0"), ["lang", "source"]).unionByName(q.sketch(measured.filter("doc_id % 2 = 1"), ["lang", "source"]))
    key = ["lang", "measure"]
    assert sorted(map(str, q.quartiles(whole, ["lang"]).orderBy(*key).collect())) == sorted(map(str, q.quartiles(q.merge(halves, ["lang"]), ["lang"]).orderBy(*key).collect()))
    exact = measured.agg(F.percentile(F.col("word_chars") / F.greatest("n_words", F.lit(1)), 0.5)).first()[0]
    close = q.quartiles(q.merge(whole, []), []).filter("measure = 'chars_per_word'").first().q[1]
    assert abs(close - exact) < 0.03 * exact


def test_stage_returns_the_columns_of_documents(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA).withColumn("fences", F.lit("clash")).withColumn("n_words", F.lit("clash"))
    out = q.stage(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted([*range(900), 5, 3002])
    assert q.stage(spark, docs.limit(0), "").count() == 0

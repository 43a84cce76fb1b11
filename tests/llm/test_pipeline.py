"""The pipeline against plain Python over a small corpus with planted cases."""

import random
import re

import corpus_pipeline
from pitlake.llm import decontaminate, jaccard_join, quality_rules, secret_scan

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def planted(tmp_path, spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n)) + "."
    item = prose(40)
    rows = [[i, prose(rng.randint(30, 120)), rng.choice(["en", "de"]), f"s{i % 4}"] for i in range(300)]
    for i in range(20):
        rows.append([400 + i, rows[i][1], "en", "s0"])  # exact copies
        w = rows[40 + i][1].split()
        w[0] = "changed"
        rows.append([500 + i, " ".join(w), "en", "s1"])  # near copies of long enough texts
    rows.append([600, prose(30) + " " + item + " " + prose(30), "en", "s2"])
    rows.append([601, prose(30) + " password=abcdef123456 " + prose(20), "en", "s3"])
    rows.append([602, "too short", "en", "s3"])
    rows.append([603, "the same words again and " * 30, "en", "s3"])
    rows.append([604, None, None, None])
    rows = [(*r, len(r[1] or "")) for r in rows]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return rows, item


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def test_stages_and_whole_run(spark, tmp_path):
    rows, item = planted(tmp_path, spark)
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, sf)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        out.write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
    assert seen["quality_rules"].keys() == {r[0] for r in rows} - {602, 603, 604}
    texts = {k: r.text for k, r in seen["quality_rules"].items()}
    part = {k: k for k in texts}
    keys = sorted(texts)
    sets = {k: shingles(texts[k]) for k in keys}
    for a in keys:
        for b in keys:
            if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                old, new = max(part[a], part[b]), min(part[a], part[b])
                part = {k: new if p == old else p for k, p in part.items()}
    assert seen["jaccard_join"].keys() == set(part.values()) and len(set(part.values())) < len(texts)
    assert item not in seen["decontaminate"][600].text and seen["decontaminate"].keys() == seen["jaccard_join"].keys()
    same = [k for k in seen["decontaminate"] if k != 600]
    assert all(seen["decontaminate"][k].text == texts[k] for k in same)
    assert "password=" not in seen["secret_scan"][601].text and secret_scan.REDACTED in seen["secret_scan"][601].text
    assert all(seen["secret_scan"][k].text == seen["decontaminate"][k].text for k in seen["secret_scan"] if k != 601)
    size = {k: len(r.text.split()) for k, r in seen["secret_scan"].items()}
    mixed = seen["source_mix"]
    assert all(r.size == size[k] and 0 < r.taken <= 3 * r.size for k, r in mixed.items())
    by_source = {}
    for k, r in seen["secret_scan"].items():
        by_source[r.source] = by_source.get(r.source, 0) + size[k]
    for source in by_source:
        own = [r for r in mixed.values() if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 32
    whole = {r.doc_id: r.taken for r in corpus_pipeline.run(spark, sf).collect()}
    assert whole == {k: r.taken for k, r in mixed.items()}


def test_stages_call_the_operators():
    assert [f for _, f in corpus_pipeline.STAGES][:4] == [quality_rules.stage, jaccard_join.stage, decontaminate.stage, secret_scan.stage]
    assert corpus_pipeline.ORACLE_SQL is None


def test_run_over_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_between_the_bounds(spark, tmp_path):
    """Five-word similarity of 0.8 or more counts, also where three-word similarity is below 0.9."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 8)))
    rows, near, apart = [], [], []
    for i in range(12):
        words = [word() for _ in range(100)]
        rows.append((i, " ".join(words) + ".", "en", "s0"))
        for key, places, found in ((100 + i, (30, 60), near), (200 + i, (20, 45, 70), apart)):
            w = list(words)
            for at in places:
                w[at] = f"changed{key}"
            rows.append((key, " ".join(w) + ".", "en", "s0"))
            found.append(key)
    rows = [(*r, len(r[1])) for r in rows]
    five = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    text = {r[0]: r[1] for r in rows}
    alike = lambda a, b, f: len(f(text[a]) & f(text[b])) / len(f(text[a]) | f(text[b]))
    assert all(alike(k, k - 100, five) >= 0.8 and alike(k, k - 100, shingles) < 0.9 for k in near)
    assert all(alike(k, k - 200, five) < 0.8 and alike(k, k - 100, five) < 0.8 for k in apart)
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = {r.doc_id for r in jaccard_join.stage(spark, docs, "").collect()}
    assert kept == {r[0] for r in rows} - set(near)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert not set(near) & {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

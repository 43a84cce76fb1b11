import random
import zlib

import numpy as np

from pitlake.llm import toxicity as t


def corpus(n=600, seed=0):
    """Neutral and toxic sentences; one group is named mostly in toxic ones."""
    rng = random.Random(seed)
    plain, bad = [f"word{i}" for i in range(150)], ["vile", "scumbag", "wretch", "hatefulness", "hateful"]
    rows = []
    for i in range(n):
        toxic = int(rng.random() < 0.4)
        words = rng.choices(plain, k=rng.randint(5, 40)) + (rng.choices(bad, k=rng.randint(1, 3)) if toxic else [])
        if rng.random() < (0.7 if toxic else 0.05):
            words.append("muslim")
        elif rng.random() < 0.2:
            words.append("christian")
        rng.shuffle(words)
        rows.append((i, " ".join(words), toxic))
    return rows


def score(model, texts):
    lookup = model.lookup()
    return np.concatenate([model.scores(p, lookup) for p in t.pieces(t.pa.array(texts, t.pa.string()))])


def test_counterfactual_term_lowers_false_positives():
    rows = corpus()
    texts, labels = [r[1] for r in rows], np.array([r[2] for r in rows], float)
    neutral = ["the muslim " + " ".join(f"word{i + k}" for k in range(6)) for i in range(100)]
    with_term, without = score(t.fit_sample(texts, labels), neutral), score(t.fit_sample(texts, labels, penalty=0.0), neutral)
    swapped = score(t.fit_sample(texts, labels), [t.swapped(x) for x in neutral])
    assert with_term.mean() < without.mean() and abs(with_term - swapped).mean() < 0.05
    assert (with_term >= t.THRESHOLD).mean() < (without >= t.THRESHOLD).mean() or (without >= t.THRESHOLD).mean() == 0


def test_held_out_accuracy_and_split(spark):
    rows = corpus(900, 3)
    docs = spark.createDataFrame([(i, x) for i, x, _ in rows] + [(None, "vile"), (5000, None), (5001, ""), (5, rows[5][1])], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (7, 9), (8, None)], "doc_id long, toxic int")
    model = t.fit(docs, labels)
    out = t.score(docs, model).withColumn("held", t.held_out(t.F.col("doc_id"))).collect()
    assert len(out) == len(rows) + 4 and all(0 <= r.score <= 1 for r in out)
    truth = {i: y for i, _, y in rows}
    held = [r for r in out if r.held and r.doc_id in truth]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held for r in out if r.doc_id is not None)
    assert np.mean([(r.score >= t.THRESHOLD) == truth[r.doc_id] for r in held]) > 0.95
    assert len({r.score for r in out if r.doc_id in (5000, 5001)}) == 1


def test_held_out_labels_do_not_matter(spark):
    rows = corpus(300, 4)
    docs = spark.createDataFrame([(i, x) for i, x, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    turned = labels.withColumn("toxic", t.F.when(t.held_out(t.F.col("doc_id")), 1 - t.F.col("toxic")).otherwise(t.F.col("toxic")))
    a, b = t.fit(docs, labels), t.fit(docs, turned)
    assert (a.kept == b.kept).all() and np.allclose(a.weight, b.weight) and a.constant == b.constant


def test_no_usable_labels(spark):
    docs = spark.createDataFrame([(1, "a", "clash")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert 0 < t.score(docs, t.fit(docs, none)).first().score < 0.3
    assert t.score(docs.limit(0), t.fit(docs.limit(0), none)).count() == 0
    ones = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert t.score(docs, t.fit(docs, ones)).first().score < 0.5


def test_repeated_ids_are_one_row_of_the_sample(spark):
    """Repeated rows crowd no other id out of a bounded sample."""
    rows = corpus(300)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    once = [(i, x) for i, x, _ in rows]
    many = once + [(i, "zzz repeated text") for i in range(0, 40) for _ in range(20)]
    a, b = (t.fit(spark.createDataFrame(d, "doc_id long, text string"), labels, max_docs=150) for d in (once, many))
    assert len(a.kept) and np.array_equal(a.kept, b.kept) and np.array_equal(a.weight, b.weight) and a.constant == b.constant


def plain_fit(texts, labels, penalty):
    """Every word and word beginning counted in dictionaries, and the exact least loss on dense columns by Newton steps."""
    def counts(text):
        out = {}
        for w in "".join(c if c.isalnum() else " " for c in text).split():
            for f in (("w", w.lower()), *((n, w.lower()[:n]) for n in t.STEMS)):
                out[f] = out.get(f, 0) + 1
        return out

    swaps = [(x, t.swapped(x)) for x in texts if t.swapped(x) is not None]
    held = [counts(x) for x in texts]
    names = sorted({f for h in held for f in h if sum(f in o for o in held) >= t.MIN_DOCS}, key=str)
    dense = lambda xs: np.array([[np.log2(1 + c.get(f, 0)) for f in names] for c in map(counts, xs)])
    x, change = dense(texts), dense([a for a, _ in swaps]) - dense([b for _, b in swaps])
    n, m = len(texts), max(1, len(swaps))
    x, change = np.c_[x, np.ones(n)], np.c_[change, np.zeros(len(swaps))]
    fixed = np.diag([t.RIDGE / n] * len(names) + [0.0]) + 2 * penalty / m * change.T @ change
    w = np.zeros(len(names) + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - labels) / n + fixed @ w
        w -= 0.5 * np.linalg.solve((x.T * (p * (1 - p))) @ x / n + fixed + 1e-9 * np.eye(len(w)), slope)
    return lambda xs: 1 / (1 + np.exp(-np.clip(np.c_[dense(xs), np.ones(len(xs))] @ w, -30, 30)))


def test_scores_match_plain_descent():
    rows = corpus(160, 9)
    texts, labels = [r[1] for r in rows], np.array([r[2] for r in rows], float)
    want, got = plain_fit(texts, labels, t.PENALTY)(texts), score(t.fit_sample(texts, labels), texts)
    assert abs(want - got).mean() < 0.01 and abs(want - got).max() < 0.05 and np.mean((want >= 0.5) == (got >= 0.5)) >= 0.97

"""Toxicity: a classifier with a counterfactual penalty, fitted on a bounded sample, applied to whole texts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, table
from .words import U64, alphabet, hashes, mix, pieces, spans

#: Labelled documents used for fitting, at most; chosen by a hash of their id.
TRAIN_DOCS = 6_000
#: Hashed features, and how many of them a model may use.
DIMENSIONS = 1 << 21
KEPT = 4096
#: Training documents that must hold a feature.
MIN_DOCS = 8
#: Weights of the ridge term and of the counterfactual term.
RIDGE = 0.2
PENALTY = 5.0
THRESHOLD = 0.3
#: Characters of a word's beginning that are features besides the whole word.
STEMS = (4, 5, 6)

# Names of groups, by kind; a term is swapped for the others of its kind.
IDENTITY = [
    ["women", "men", "girls", "boys"],
    ["woman", "man", "girl", "boy"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "latino"],
    ["gay", "straight", "lesbian", "bisexual"],
    ["immigrant", "native", "refugee", "foreigner"],
    ["immigrants", "natives", "refugees", "foreigners"],
    ["frauen", "männer"],
    ["femmes", "hommes"],
    ["mujeres", "hombres"],
]

#: Everything but digits, letters and bytes beyond ASCII stands between words.
BETWEEN = bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))


def held_out(key: Column) -> Column:
    """True for the rows whose labels are not learnt: CRC-32 of the id as text leaves 2 when divided by 4. NULL ids are not held out."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def features(piece) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs of a piece: whole words and word beginnings, hashed."""
    letters = alphabet(BETWEEN)
    begins, ends, first = spans(piece, letters)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    marks = [mix(hashes(piece, letters, begins, ends) + U64(1))]
    for n in STEMS:
        marks.append(mix(hashes(piece, letters, begins, np.minimum(begins + n, ends)) + U64(n * 1000)))
    at = np.concatenate([m % U64(DIMENSIONS) for m in marks]).astype(np.int64)
    return np.tile(doc, len(marks)), at


def _counted(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each (text, feature) pair once, with the logarithm of how often it occurs: 1 for once, 2 for three times."""
    both, n = np.unique(doc * np.int64(DIMENSIONS) + at, return_counts=True)
    return both // DIMENSIONS, both % DIMENSIONS, np.log2(1 + n)


def _swaps() -> tuple[re.Pattern, dict[str, str]]:
    """Each identity term and the next of its kind."""
    following = {t: kind[(i + 1) % len(kind)] for kind in IDENTITY for i, t in enumerate(kind)}
    return re.compile(rf"\b(?:{'|'.join(following)})\b", re.IGNORECASE), following


def swapped(text: str) -> str | None:
    """The text with each identity term replaced by another of its kind; None if it has none."""
    terms, following = _swaps()
    out, n = terms.subn(lambda m: following[m[0].lower()], text)
    return out if n else None


@dataclass
class Model:
    """Weights of the kept features and the score's constant."""

    kept: np.ndarray
    weight: np.ndarray
    constant: float

    def lookup(self) -> np.ndarray:
        """The weight of every feature, 0 for most."""
        out = np.zeros(DIMENSIONS)
        out[self.kept] = self.weight
        return out

    def scores(self, piece, lookup: np.ndarray) -> np.ndarray:
        """A score from 0 to 1 for each text of a piece, from the features that it holds."""
        doc, at = features(piece)
        some = lookup[at] != 0
        doc, at, value = _counted(doc[some], at[some])
        total = np.bincount(doc, value * lookup[at], minlength=piece.last - piece.first)
        return 1 / (1 + np.exp(-np.clip(total + self.constant, -30, 30)))


def _sparse(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    docs, ats, values = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.float32)]
    for piece in pieces(pa.array(texts, pa.string())):
        doc, at, value = _counted(*features(piece))
        values.append(value.astype(np.float32))
        docs.append((doc + piece.first).astype(np.int32))
        ats.append(at.astype(np.int32))
    return np.concatenate(docs), np.concatenate(ats), np.concatenate(values)


def fit_sample(texts: list[str], labels: np.ndarray, penalty: float = PENALTY) -> Model:
    """Logistic regression with ridge and counterfactual terms on some labelled texts.

    The loss adds ``penalty`` times the mean squared change of the linear score between each text and
    its swapped form, so what only tells groups apart gets no weight.
    """
    n = len(texts)
    if not n or labels.min() == labels.max():
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.clip(np.log((labels.sum() + 0.5) / (n - labels.sum() + 0.5)), -20, 20)) if n else -3.0)
    doc, at, value = _sparse(texts)
    held, rate = np.bincount(at, minlength=DIMENSIONS), labels.mean()
    apart = np.bincount(at, value * (labels[doc] - rate), minlength=DIMENSIONS)
    gain = np.where(held >= MIN_DOCS, apart**2 / np.maximum(np.bincount(at, value**2, minlength=DIMENSIONS) * rate * (1 - rate), 1e-9), 0)
    pairs = [(i, s) for i, t in enumerate(texts) if (s := swapped(t)) is not None]
    kept = np.sort(np.argsort(-gain, kind="stable")[:KEPT])
    kept = kept[gain[kept] > 0]
    place = np.full(DIMENSIONS, -1)
    place[kept] = np.arange(len(kept))

    def columns(doc: np.ndarray, at: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        some = place[at] >= 0
        return doc[some], place[at[some]], value[some]

    doc, col, value = columns(doc, at, value)
    row_a, col_a, value_a = columns(*_sparse([texts[i] for i, _ in pairs]))
    row_b, col_b, value_b = columns(*_sparse([s for _, s in pairs]))
    row, change = np.r_[row_a, row_b], np.r_[value_a, -value_b]
    col_ab, k, m = np.r_[col_a, col_b], len(kept), len(pairs)
    w, b = np.zeros(k), np.log(rate / (1 - rate))
    mean, var, mean_b, var_b = np.zeros(k), np.zeros(k), 0.0, 0.0
    for t in range(1, 401):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, value * w[col], minlength=n) + b, -30, 30)))
        error = (p - labels) / n
        grad = np.bincount(col, value * error[doc], minlength=k) + RIDGE * w / n
        if m:
            moved = np.bincount(row, change * w[col_ab], minlength=m)
            grad += 2 * penalty / m * np.bincount(col_ab, change * moved[row], minlength=k)
        grad_b = error.sum()
        mean, var = 0.9 * mean + 0.1 * grad, 0.99 * var + 0.01 * grad**2
        mean_b, var_b = 0.9 * mean_b + 0.1 * grad_b, 0.99 * var_b + 0.01 * grad_b**2
        fix, fix2 = 1 - 0.9**t, 1 - 0.99**t
        rate_t = 0.1 / (1 + t / 100)
        w -= rate_t * (mean / fix) / (np.sqrt(var / fix2) + 1e-8)
        b -= rate_t * (mean_b / fix) / (np.sqrt(var_b / fix2) + 1e-8)
    return Model(kept, w, float(b))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_docs: int = TRAIN_DOCS) -> Model:
    """Fit on at most ``max_docs`` labelled rows that are not held out, chosen by a hash of their id.

    Labels other than 0 and 1 and NULL ids are left out; of several labels for one id the largest
    counts, and of several texts the least. The sample has one row an id before it goes to the one task
    that fits it; only the model comes back.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(key).agg(F.max(label).alias("_y"))
    chosen = known.orderBy(F.xxhash64(key), key).limit(max_docs)
    sample = docs.select(key, F.coalesce(text, F.lit("")).alias("_t")).join(F.broadcast(chosen), key).groupBy(key).agg(F.min("_t").alias("_t"), F.max("_y").alias("_y"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((k, t, y) for b in batches for k, t, y in zip(*(c.to_pylist() for c in b.columns)))[:max_docs]
        model = fit_sample([t for _, t, _ in rows], np.array([y for _, _, y in rows], float))
        yield pa.RecordBatch.from_arrays([pa.array([model.kept.tolist()]), pa.array([model.weight.tolist()], pa.list_(pa.float64())), pa.array([model.constant])], names=["kept", "weight", "constant"])

    r = sample.select(key, "_t", "_y").repartition(1).mapInArrow(learn, "kept array<long>, weight array<double>, constant double").first()
    return Model(np.array(r.kept, np.int64), np.array(r.weight), r.constant) if r else Model(np.zeros(0, np.int64), np.zeros(0), -3.0)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``score`` to every row, from its whole text; NULL and empty texts get the constant's score. A column ``score`` is replaced."""
    names = [c for c in docs.columns if c != "score"]
    out = docs.select(*names, F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = model.lookup()
        for batch in batches:
            each = [model.scores(p, lookup) for p in pieces(batch.column(batch.schema.names.index(text)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(each) if each else np.zeros(0), pa.float64())], names=batch.schema.names)

    return out.mapInArrow(run, out.schema)


@query("op2_toxicity")
def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))

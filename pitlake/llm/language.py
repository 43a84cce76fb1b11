"""Language identification: a linear-chain conditional random field labels every word of code-switched texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scale import top_rows
from .common import query, table
from .words import U64, Piece, alphabet, hashes, mix, pieces, spans

#: Labelled documents of a language used for fitting, at most; languages, the most frequent first; words of a document.
TRAIN_DOCS = 150
MAX_LANGUAGES = 64
TRAIN_WORDS = 80
#: Characters of a labelled document from which those words come.
TRAIN_CHARS = 4000
#: Words of a training sequence, and the share of sequences made of two documents of different languages.
SEQUENCE = 20
SWITCHED = 0.5
#: Hashed affixes and n-grams; times a word must occur in the sample to enter a lexicon, and the share in one language.
DIMENSIONS = 1 << 17
LEXICON_COUNT, LEXICON_SHARE = 5, 0.9
RIDGE = 1e-4
STEPS = 40
#: Words of a text that are scanned step by step; longer texts are cut into blocks of so many.
BLOCK_WORDS = 256
#: Bytes of texts worked on together.
PIECE = 1 << 20

BETWEEN = bytes(b for b in range(128) if not (65 <= b <= 90 or 97 <= b <= 122))


def held_out(key: Column) -> Column:
    """True for rows from which nothing is learnt: CRC-32 of the id as text is divisible by 5. NULL ids are not held out."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


@dataclass
class Words:
    """The words of some texts: the number of each word's distinct form, where texts begin, and the features of the forms.

    ``form`` and ``feature`` pair forms with hashed features, ``weight`` is 1 for affixes and one part of 1 for each n-gram.
    """

    form: np.ndarray
    first: np.ndarray
    key: np.ndarray
    of: np.ndarray
    feature: np.ndarray
    weight: np.ndarray


def words_of(piece: Piece) -> Words:
    """Words are runs of ASCII letters and other bytes beyond ASCII; features come once for each distinct word.

    Features are the word, its first and last one to three characters and its runs of two and three
    characters; a word's features depend on the word alone.
    """
    letters = alphabet(BETWEEN)
    begins, ends, first = spans(piece, letters)
    key, at, form = np.unique(hashes(piece, letters, begins, ends), return_index=True, return_inverse=True)
    begins, ends = begins[at], ends[at]
    starts = np.flatnonzero((piece.data & 0xC0) != 0x80)  # characters
    stops = np.append(starts, len(piece.data))
    a, b = np.searchsorted(starts, begins), np.searchsorted(starts, ends)
    size, forms = b - a, np.arange(len(key))
    of, marks, weights = [forms], [mix(key + U64(1))], [np.ones(len(key))]

    def add(some: np.ndarray, lo: np.ndarray, hi: np.ndarray, kind: int, weight: np.ndarray) -> None:
        of.append(some)
        marks.append(mix(hashes(piece, letters, stops[lo], stops[hi]) + U64(kind * 7919)))
        weights.append(weight)

    for n in (1, 2, 3):
        some = np.flatnonzero(size >= n)
        one = np.ones(len(some))
        add(some, a[some], a[some] + n, n, one)
        add(some, b[some] - n, b[some], n + 3, one)
        if n > 1:
            count = np.maximum(size - n + 1, 0)
            each = np.repeat(forms, count)
            place = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
            add(each, a[each] + place, a[each] + place + n, n + 6, 1.0 / count[each])
    of, feature, weight = np.concatenate(of), (np.concatenate(marks) % U64(DIMENSIONS)).astype(np.int64), np.concatenate(weights)
    return Words(form, first, key, of, feature, weight)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def forward_backward(scores: np.ndarray, change: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences of one length: ``scores[n, t, l]``; ``change[l, m]`` from one word to the next, ``begin[l]``.

    Posteriors of labels, expected changes summed over everything, and the logarithm of the partition function.
    """
    n, size, labels = scores.shape
    fore, back = np.empty_like(scores), np.zeros_like(scores)
    fore[:, 0] = begin + scores[:, 0]
    for t in range(1, size):
        fore[:, t] = scores[:, t] + _lse(fore[:, t - 1, :, None] + change, 1)
    for t in range(size - 2, -1, -1):
        back[:, t] = _lse(change + (scores[:, t + 1] + back[:, t + 1])[:, None, :], 2)
    total = _lse(fore[:, -1], 1)
    posterior = np.exp(fore + back - total[:, None, None])
    pairs = np.zeros((labels, labels))
    for t in range(size - 1):
        pairs += np.exp(fore[:, t, :, None] + change + (scores[:, t + 1] + back[:, t + 1])[:, None, :] - total[:, None, None]).sum(0)
    return posterior, pairs, total


def marginals(scores: np.ndarray, first: np.ndarray, change: np.ndarray, begin: np.ndarray, block: int = BLOCK_WORDS) -> np.ndarray:
    """Posteriors of all words of texts of any lengths; ``first`` tells where each text begins in ``scores``.

    Words pass in step, the same step of all blocks at once. A text of several blocks is exact too: the
    matrix that leads through a block, from the label of its first word to that of its last, is made
    for all blocks at once; along the text these matrices give what enters each block from the left and
    from the right.
    """
    n_words = np.diff(first)
    if not len(scores):
        return scores
    per = -(-n_words // block)
    text = np.repeat(np.arange(len(n_words)), per)
    number = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    lo = first[:-1][text] + number * block
    size = np.minimum(first[1:][text] - lo, block)
    order = np.argsort(-size, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    lo, size, deep = lo[order], size[order], (per[text] > 1)[order]
    live = np.searchsorted(-size, -np.arange(block), "left")  # blocks of more than t words come first
    local = np.exp(scores - scores.max(1, keepdims=True))
    step, start = np.exp(change - change.max()), np.exp(begin - begin.max())
    enter = np.tile(start, (len(lo), 1))
    leave = np.ones((len(lo), scores.shape[1]))
    cut = np.flatnonzero(deep)
    if len(cut):
        through = np.zeros((len(lo), *step.shape))
        through[cut] = np.eye(len(step)) * local[lo[cut]][:, None, :]
        for t in range(1, int(size[cut].max())):
            some = np.flatnonzero(deep[: live[t]])
            through[some] = (through[some] @ step) * local[lo[some] + t][:, None, :]
            through[some] /= through[some].max((1, 2), keepdims=True)
        ends = np.cumsum(per)
        for x in np.flatnonzero(per > 1):
            mine = place[ends[x] - per[x] : ends[x]]
            for i, j in zip(mine, mine[1:]):
                now = enter[i] @ through[i] @ step
                enter[j] = now / now.max()
            for i, j in zip(mine[::-1], mine[-2::-1]):
                now = step @ (through[i] @ leave[i])
                leave[j] = now / now.max()
    fore, back = np.empty_like(local), np.empty_like(local)
    now = enter * local[lo]
    fore[lo] = now / now.sum(1, keepdims=True)
    for t in range(1, int(size[0])):
        rows = lo[: live[t]] + t
        now = (fore[rows - 1] @ step) * local[rows]
        fore[rows] = now / now.sum(1, keepdims=True)
    back[lo + size - 1] = leave
    for t in range(int(size[0]) - 2, -1, -1):
        rows = lo[: live[t + 1]] + t
        now = (local[rows + 1] * back[rows + 1]) @ step.T
        back[rows] = now / now.max(1, keepdims=True)
    both = fore * back
    return both / both.sum(1, keepdims=True)


@dataclass
class Model:
    """What is learnt: ``weight[i]`` for feature ``feature[i]`` (those from DIMENSIONS on mean: in the lexicon of a language)."""

    languages: list[str]
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weight: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    change: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    begin: np.ndarray = field(default_factory=lambda: np.zeros(0))
    lexicon: np.ndarray = field(default_factory=lambda: np.zeros(0, U64))
    member: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def table(self) -> np.ndarray:
        """Weights of all features, 0 for those not learnt."""
        out = np.zeros((DIMENSIONS + len(self.languages), len(self.languages)))
        out[self.feature] = self.weight
        return out

    def tag(self, words: Words, weights: np.ndarray, block: int = BLOCK_WORDS) -> np.ndarray:
        """The posterior of every language for every word."""
        of, feature, value = _with_lexicon(words, self.lexicon, self.member)
        return marginals(_emit(of, feature, value, weights, len(words.key))[words.form], words.first, self.change, self.begin, block)


def _with_lexicon(words: Words, lexicon: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(lexicon):
        return words.of, words.feature, words.weight
    at = np.minimum(np.searchsorted(lexicon, words.key), len(lexicon) - 1)
    known = np.flatnonzero(lexicon[at] == words.key)
    return np.r_[words.of, known], np.r_[words.feature, DIMENSIONS + member[at[known]]], np.r_[words.weight, np.ones(len(known))]


def _emit(of: np.ndarray, feature: np.ndarray, value: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(of, value * weights[feature, label], minlength=n) for label in range(weights.shape[1])], 1)


def _lexicons(form: np.ndarray, label: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Words that occur often and nearly always in one language of the sample, and that language."""
    counts = np.bincount(form * n + label, minlength=len(key) * n).reshape(-1, n)
    total, most = counts.sum(1), counts.max(1)
    some = np.flatnonzero((total >= LEXICON_COUNT) & (most >= LEXICON_SHARE * total))
    return key[some], counts[some].argmax(1)


def sequences(n_words: np.ndarray, first: np.ndarray, label: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers and labels of training sequences; some pass from one language into another at a drawn place."""
    rng = np.random.default_rng(seed)
    each, own = [], []
    for x in np.unique(label):
        docs = rng.permutation(np.flatnonzero(label == x))
        line = np.concatenate([np.arange(first[d], first[d] + min(n_words[d], TRAIN_WORDS)) for d in docs]) if len(docs) else np.zeros(0, np.int64)
        if len(line):
            line = np.resize(line, max(SEQUENCE, len(line) // SEQUENCE * SEQUENCE)).reshape(-1, SEQUENCE)
            each.append(line)
            own.append(np.full(len(line), x))
    words, label = np.concatenate(each), np.concatenate(own)
    labels = np.repeat(label[:, None], SEQUENCE, 1)
    other = rng.permutation(len(words))
    at = rng.integers(1, SEQUENCE, len(words))
    mixed = (rng.random(len(words)) < SWITCHED) & (label != label[other])
    later = (np.arange(SEQUENCE) >= at[:, None]) & mixed[:, None]
    return np.where(later, words[other], words), np.where(later, labels[other], labels)


def fit_sample(texts: list[str], languages: list[str]) -> Model:
    """Gradient ascent on the conditional likelihood of word labels, a word's label being its document's language."""
    names = sorted(set(languages))
    if not names:
        return Model([])
    whole = next(pieces(pa.array(texts, pa.string()), 1 << 40))
    words = words_of(whole)
    n = len(names)
    label = np.array([names.index(x) for x in languages])
    n_words = np.diff(words.first)
    some = np.flatnonzero(n_words > 0)
    if not len(some):
        return Model([])
    seq, gold = sequences(n_words[some], words.first[:-1][some], label[some])
    doc = np.repeat(np.arange(len(n_words)), n_words)
    lexicon, member = _lexicons(words.form, label[doc], words.key, n)
    of, feature, value = _with_lexicon(words, lexicon, member)
    used, column = np.unique(feature, return_inverse=True)
    form, right = words.form[seq], np.eye(n)[gold]
    pairs = np.zeros((n, n))
    np.add.at(pairs, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
    params = [np.zeros((len(used), n)), np.zeros((n, n)), np.zeros(n)]
    mean, var = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    count = seq.size
    for t in range(1, STEPS + 1):
        weights, change, begin = params
        posterior, expected, _ = forward_backward(_emit(of, column, value, weights, len(words.key))[form], change, begin)
        error = (posterior - right) / count
        by_form = np.stack([np.bincount(form.ravel(), error[..., x].ravel(), minlength=len(words.key)) for x in range(n)], 1)
        grad = [np.stack([np.bincount(column, value * by_form[of, x], minlength=len(used)) for x in range(n)], 1) + RIDGE * weights / len(used),
                (expected - pairs) / count + RIDGE * change, error[:, 0].sum(0) + RIDGE * begin]
        rate = 0.2 / (1 + t / 20)
        for p, g, m, v in zip(params, grad, mean, var):
            m += 0.1 * (g - m)
            v += 0.05 * (g * g - v)
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.95**t)) + 1e-10)
    return Model(names, used, params[0], params[1], params[2], lexicon, member)


_PARTS = {"feature": np.int64, "weight": np.float64, "change": np.float64, "begin": np.float64, "lexicon": U64, "member": np.int64}


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_docs: int = TRAIN_DOCS) -> Model:
    """Fit on at most ``max_docs`` documents of each of the ``MAX_LANGUAGES`` most frequent languages, none of them held out.

    Documents are chosen by a hash of their id, one row each (the least of several texts), and a stretch
    of at most ``TRAIN_CHARS`` characters at a place that the hash gives; so rows and characters are
    bounded before they go to the one task that fits. Rows without id, text or language teach nothing.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
    counts = known.groupBy(F.col(lang).alias("_l")).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "_l").limit(MAX_LANGUAGES)
    names = [r._l for r in counts.collect()]
    ids = known.where(F.col(lang).isin(names)).select(F.col(key).alias("_k"), F.col(lang).alias("_l")).distinct()
    chosen = top_rows(ids.withColumn("_h", F.xxhash64("_k")), ["_l"], [F.col("_h"), F.col("_k")], max_docs).select("_k", "_l", "_h")
    size = F.length(text)
    at = F.when(size > TRAIN_CHARS, F.pmod(F.col("_h"), size - TRAIN_CHARS + 1)).otherwise(0).cast("int") + 1
    stretch = F.lower(F.substr(F.col(text), at, F.lit(TRAIN_CHARS)))
    # at most max_docs rows a language, MAX_LANGUAGES languages
    sample = known.join(F.broadcast(chosen), (F.col(key) == F.col("_k")) & (F.col(lang) == F.col("_l"))).groupBy("_h", "_k", "_l").agg(F.min(stretch).alias("_t"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((h, k, x, t) for b in batches for h, k, x, t in zip(*(c.to_pylist() for c in b.columns)))
        model = fit_sample([t for *_, t in rows], [x for _, _, x, _ in rows])
        parts = [pa.array([getattr(model, p).astype(kind).tobytes()], pa.binary()) for p, kind in _PARTS.items()]
        yield pa.RecordBatch.from_arrays([pa.array([model.languages], pa.list_(pa.string())), *parts], names=["languages", *_PARTS])

    r = sample.select("_h", F.col("_k").cast("string"), "_l", "_t").repartition(1).mapInArrow(learn, "languages array<string>, " + ", ".join(f"{p} binary" for p in _PARTS)).first()
    if not r or not r.languages:
        return Model([])
    parts = {p: np.frombuffer(bytes(r[p]), kind) for p, kind in _PARTS.items()}
    n = len(r.languages)
    return Model(list(r.languages), **{**parts, "weight": parts["weight"].reshape(-1, n), "change": parts["change"].reshape(n, n)})


_RUNS = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("lang", pa.string()), ("score", pa.float64())]))


def _runs(posterior: np.ndarray, languages: list[str]) -> list[dict]:
    best = posterior.argmax(1)
    edge = np.flatnonzero(np.r_[True, best[1:] != best[:-1]]) if len(best) else np.zeros(0, int)
    ends = np.r_[edge[1:], len(best)] if len(best) else edge
    return [{"first": int(a), "words": int(b - a), "lang": languages[best[a]], "score": float(posterior[a:b, best[a]].mean())} for a, b in zip(edge, ends)]


def identify(docs: DataFrame, model: Model, text: str = "text", runs: bool = False) -> DataFrame:
    """Add ``lang_pred`` and ``score``, and on request the ``runs`` of words of one language, from whole texts.

    A word's label is the language with the largest posterior; the document's is that of the largest mean
    posterior over all words, which is its score (ties: the first by name). Texts without a letter,
    NULL or empty ones are ``und`` with score 0 and no runs, as is every text if nothing was
    learnt. All rows stay; columns named ``lang_pred``, ``score`` or ``runs`` are replaced.
    """
    own = ["lang_pred", "score", *(["runs"] if runs else [])]
    rest = [c for c in docs.columns if c not in own]
    work = docs.select(F.struct(*rest).alias("_row"), F.when(F.col(text).rlike(r"\p{L}"), F.lower(F.col(text))).alias("_text"))
    schema = "lang_pred string, score double" + (", runs array<struct<first: long, words: long, lang: string, score: double>>" if runs else "")
    names = model.languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.table() if names else None
        for batch in batches:
            texts = batch.column(1)
            lang: list[str] = []
            score: list[np.ndarray] = [np.zeros(0)]
            found: list[list[dict]] = []
            for piece in pieces(texts, PIECE):
                n = piece.last - piece.first
                if not names:
                    lang += ["und"] * n
                    score.append(np.zeros(n))
                    found += [[]] * n
                    continue
                words = words_of(piece)
                posterior = model.tag(words, weights)
                count = np.diff(words.first)
                sums = np.vstack([np.zeros(len(names)), np.cumsum(posterior, 0)])
                mean = (sums[words.first[1:]] - sums[words.first[:-1]]) / np.maximum(count, 1)[:, None]
                best = mean.argmax(1)
                lang += [names[b] if c else "und" for b, c in zip(best, count)]
                score.append(np.where(count > 0, np.clip(mean[np.arange(n), best], 0, 1), 0.0))
                if runs:
                    found += [_runs(posterior[a:b], names) for a, b in zip(words.first, words.first[1:])]
            out = [batch.column(0), pa.array(lang, pa.string()), pa.array(np.concatenate(score))]
            yield pa.RecordBatch.from_arrays([*out, pa.array(found, _RUNS)] if runs else out, names=["_row", *own])

    row = work.schema["_row"].dataType.simpleString()
    return work.mapInArrow(run, f"_row {row}, {schema}").select("_row.*", *own)


@query("op11_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language by the words of its whole text; learnt from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.select("doc_id", "text", "lang"))
    ids = docs.select("doc_id", "text")
    # the text stays behind: only its id comes back from the tasks
    found = identify(ids, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")

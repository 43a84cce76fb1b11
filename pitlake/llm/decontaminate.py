"""Benchmark decontamination: an FM-index per training shard, searched for the benchmark's phrases."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .common import query, table
from .fm_index import FMIndex

PHRASE_WORDS = 10
#: Words of a shard; a shard is indexed when it holds so many, or at the end of its partition.
SHARD_WORDS = 1 << 21
#: Characters of benchmark items that are searched for at once; larger benchmarks take several rounds.
BLOCK_CHARS = 8 << 20

#: A word of the raw text, A-Z included: word for word the same as ``words`` finds on folded bytes.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bytes to lower case, and everything between words to a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))

HITS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])


def words(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased; letters beyond ASCII stay as they are."""
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


@dataclass
class Phrases:
    """Distinct windows of some benchmark items as numbered words, and which items hold each."""

    number: dict[bytes, int]
    symbols: np.ndarray
    lengths: np.ndarray
    item_of: np.ndarray
    item_start: np.ndarray
    items: list[str]


def phrases(items: list[tuple[object, str | None]], window: int) -> Phrases:
    """Windows of all items as rows of numbers, 0 behind the end of a short item, each distinct one once."""
    number: dict[bytes, int] = {}
    names = sorted({str(k) for k, _ in items if k is not None})
    place = {k: i for i, k in enumerate(names)}
    rows, owner = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int64)]
    for key, text in items:
        ids = [number.setdefault(w, len(number) + 1) for w in words(text)]
        if key is not None and ids:
            padded = np.array(ids + [0] * (window - len(ids)), np.int32)
            rows.append(np.lib.stride_tricks.sliding_window_view(padded, window))
            owner.append(np.full(len(rows[-1]), place[str(key)]))
    symbols, at = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
    held = np.unique(at.ravel() * np.int64(max(1, len(names))) + np.concatenate(owner))
    phrase, item = np.divmod(held, max(1, len(names)))
    return Phrases(number, symbols, (symbols > 0).sum(axis=1), item, np.searchsorted(phrase, np.arange(len(symbols) + 1)), names)


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, .. for each pair, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(start, size)


def search_shard(symbols: np.ndarray, doc_start: np.ndarray, wanted: Phrases) -> tuple[np.ndarray, list[list[str]]]:
    """Which words of a shard lie in a match, and each document's items.

    ``symbols`` are the shard's words, 0 for those that no phrase has. The index is built over the
    stretches between such words and document ends that are as long as the shortest phrase or longer:
    no match leaves or crosses them.
    """
    n_docs = len(doc_start) - 1
    hit, items = np.zeros(len(symbols) + 1, np.int64), [[] for _ in range(n_docs)]
    cut = np.zeros(len(symbols) + 1, bool)
    cut[doc_start] = True
    inside = symbols > 0
    begins = np.flatnonzero(inside & (cut[:-1] | ~np.r_[False, inside[:-1]]))
    ends = np.flatnonzero(inside & (cut[1:] | ~np.r_[inside[1:], False])) + 1
    if len(wanted.lengths):
        long = ends - begins >= wanted.lengths.min()
        begins, ends = begins[long], ends[long]
    if not len(begins) or not len(wanted.lengths):
        return hit[:-1].astype(bool), items
    size = ends - begins
    source = _spread(begins, size)
    index = FMIndex(symbols[source], np.cumsum(size) - size, len(wanted.number))
    low, high = index.search(wanted.symbols, wanted.lengths)
    phrase = np.repeat(np.arange(len(low)), high - low)
    at = source[index.locate(_spread(low, high - low))]
    np.add.at(hit, at, 1)
    np.add.at(hit, at + wanted.lengths[phrase], -1)
    doc = np.searchsorted(doc_start, at, "right") - 1
    pair = np.unique(doc * np.int64(len(low)) + phrase)
    doc, phrase = pair // len(low), pair % len(low)
    many = wanted.item_start[phrase + 1] - wanted.item_start[phrase]
    item = wanted.item_of[_spread(wanted.item_start[phrase], many)]
    for d, i in zip(*np.divmod(np.unique(np.repeat(doc, many) * np.int64(len(wanted.items)) + item), len(wanted.items))):
        items[d].append(wanted.items[i])
    return np.cumsum(hit[:-1]) > 0, items


def _char_spans(text: str, hit: np.ndarray) -> list[dict[str, int]]:
    """Runs of hit words as character ranges, from the first word's begin to the last one's end."""
    out: list[dict[str, int]] = []
    before = False
    for m, now in zip(WORD.finditer(text), hit):
        if now and before:
            out[-1]["end"] = m.end()
        elif now:
            out.append({"start": m.start(), "end": m.end()})
        before = bool(now)
    return out


def _searcher(wanted: Phrases, text: str, found: str):
    """Arrow function that fills column ``found`` of each shard, merging with what earlier blocks found."""
    kind = pa.struct([
        ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def shard(batches: list[pa.RecordBatch], ids: list[list[int]]) -> Iterator[pa.RecordBatch]:
        start = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int64)
        symbols = np.fromiter((s for x in ids for s in x), np.int64, int(start[-1]))
        hit, items = search_shard(symbols, start, wanted)
        d = 0
        for batch in batches:
            rows = []
            texts, column = batch.column(batch.schema.names.index(text)), batch.schema.names.index(found)
            for i in range(batch.num_rows):
                own, mine = hit[start[d] : start[d + 1]], items[d]
                spans = _char_spans(texts[i].as_py(), own) if mine else []
                if (old := batch.column(column)[i].as_py()) and old["items"]:
                    mine = sorted({*old["items"], *mine})
                    spans, own = _union(texts[i].as_py(), old["spans"], spans)
                rows.append({"n_words": len(own), "n_hit": int(own.sum()), "items": mine, "spans": spans})
                d += 1
            columns = [*batch.columns]
            columns[column] = pa.array(rows, kind)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, held, ids, n = wanted.number.get, [], [], 0
        for batch in batches:
            own = [[get(w, 0) for w in words(t.as_py())] for t in batch.column(batch.schema.names.index(text))]
            held.append(batch)
            ids += own
            n += sum(map(len, own))
            if n >= SHARD_WORDS:
                yield from shard(held, ids)
                held, ids, n = [], [], 0
        if held:
            yield from shard(held, ids)

    return run


def _union(text: str, a: list[dict], b: list[dict]) -> tuple[list[dict], np.ndarray]:
    """Spans of two searches of one text, merged word by word."""
    at = [m.span() for m in WORD.finditer(text)]
    begins, hit = np.array([x for x, _ in at], np.int64), np.zeros(len(at), bool)
    for s in [*a, *b]:
        hit[np.searchsorted(begins, s["start"]) : np.searchsorted(begins, s["end"])] = True
    return _char_spans(text, hit), hit


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
         window: int = PHRASE_WORDS, block_chars: int = BLOCK_CHARS, found: str = "found") -> DataFrame:
    """Add struct ``found``: ``n_words``, ``n_hit``, ``items`` (sorted as strings), ``spans`` of characters to remove.

    A phrase is ``window`` consecutive words of an item, or all of a shorter item. Each shard, some
    two million words of a partition's whole documents, gets an FM-index; all phrases are searched
    backward at once. The benchmark comes to the tasks in blocks of ``block_chars``; with more than
    one block the documents are written between rounds. NULL and empty texts have no words; items
    without words or id find nothing; rows keep all their columns, repeats and order within a
    partition; an existing column ``found`` is replaced.
    """
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    rounds = max(1, -(-total // block_chars))
    out = docs.withColumn(found, F.lit(None).cast(HITS))
    for i in range(rounds):
        block = items if rounds == 1 else items.filter(F.pmod(F.xxhash64("item"), F.lit(rounds)) == i)
        wanted = phrases([tuple(r) for r in block.toLocalIterator()], window)
        out = out.mapInArrow(_searcher(wanted, text, found), out.schema)
        out = materialise(out, "decontaminate") if i + 1 < rounds else out
    return out


def remove_spans(text: str, spans: str) -> F.Column:
    """The text without the spans; what separated the words on either side stays."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    piece = lambda acc, s: F.struct(F.concat(acc["out"], F.substr(F.col(text), acc["at"] + 1, s["start"] - acc["at"])).alias("out"), s["end"].alias("at"))
    done = lambda acc: F.concat(acc["out"], F.substr(F.col(text), acc["at"] + 1))
    return F.when(F.size(spans) > 0, F.aggregate(F.col(spans), start, piece, done)).otherwise(F.col(text))


@query("op1_decontaminate")
def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie in a benchmark item's window of ten words, and the items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "found.n_words", "found.n_hit", F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"), (F.col("found.n_hit") > 0).alias("contaminated"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without the benchmark's passages, which are cut out; ``n_chars`` follows where it is there.

    NULL and empty texts stay as they are, and so do rows without a passage; every other column, whatever its
    name, passes unchanged.
    """
    columns = docs.columns
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns if c != "text")).alias("row"), "text")
    found = find(packed, table(spark, sf_dir, "benchmark")).withColumn("spans", F.col("found.spans"))
    clean = found.withColumn("new", remove_spans("text", "spans"))
    fields = {"text": F.col("new")}
    if "n_chars" in columns:
        fields["n_chars"] = F.when(F.size("spans") > 0, F.length("new").cast("long")).otherwise(F.col("row.n_chars"))
    return clean.select(*(fields[c] if c in fields else F.col(f"row.`{c}`") for c in columns)).toDF(*columns)

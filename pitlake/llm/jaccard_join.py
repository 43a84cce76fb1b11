"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .common import SPACES, query, same, small, table
from .graph import components
from .words import U64, alphabet, hashes, mix, pieces, spans

SHINGLE_WORDS = 3
PERCENT = 90
#: The pipeline's stage takes near copies in a wider sense than ``op7``, whose statement fixes the two values above.
STAGE_SHINGLE_WORDS = 5
STAGE_PERCENT = 80
#: Share of all possible shingles (by hash) in which unique ones are counted first, as a multiple of what a set
#: can spare: 0.2 at 90 percent, 0.4 at 80. At a multiple of 1 or less hardly a set could be proved alone. Results don't depend on it.
SAMPLE_OF_SPARE = 2
#: Rounds in which documents are compared with leaders, before all remaining pairs.
LEADER_ROUNDS = 2
#: Depth of the suffix filter's halvings.
SUFFIX_DEPTH = 3


def shingle_sets(piece, letters, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and where each text's begin."""
    begins, ends, first = spans(piece, letters)
    word = hashes(piece, letters, begins, ends)
    count = np.diff(first)
    many = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    start = np.r_[0, np.cumsum(many)]
    at = np.arange(start[-1]) - np.repeat(start[:-1], many) + np.repeat(first[:-1], many)
    width = np.repeat(np.minimum(count, size), many)
    h = np.zeros(len(at), U64)
    for k in range(size):
        inside = np.minimum(at + k, max(len(word) - 1, 0))
        h = np.where(k < width, mix(h * U64(0x9E3779B97F4A7C15) + word[inside]) if len(word) else h, h)
    for lo, hi in zip(start[:-1].tolist(), start[1:].tolist()):
        h[lo:hi].sort()
    fresh = np.ones(len(h), bool)
    fresh[1:] = h[1:] != h[:-1]
    fresh[start[:-1][many > 0]] = True
    return h[fresh], np.r_[0, np.cumsum(fresh)][start]


def _keys(h: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two order-free 64-bit sums that stand for each set."""
    sums = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        total = np.zeros(len(h) + 1, U64)
        np.cumsum(mix(h ^ U64(salt)), out=total[1:])
        sums.append((total[start[1:]] - total[start[:-1]]).view(np.int64))
    return np.diff(start), sums[0], sums[1]


def _over_texts(text: str, size: int, emit):
    """An Arrow function that hands each piece of each batch to ``emit(batch, piece, sets, starts)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, (column, *fields) = alphabet(SPACES), text.split(".")
        for batch in batches:
            texts = batch.column(batch.schema.names.index(column))
            for field in fields:
                texts = pc.struct_field(texts, field)
            for piece in pieces(texts):
                yield emit(batch, piece, *shingle_sets(piece, letters, size))

    return run


def with_keys(docs: DataFrame, text: str = "text", size: int = SHINGLE_WORDS) -> DataFrame:
    """Add ``n_shingles``, ``key_a``, ``key_b``, which are equal for equal shingle sets; ``text`` may be a field, as in ``row.text``."""

    def emit(batch, piece, h, start):
        part = batch.slice(piece.first, piece.last - piece.first)
        return pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, _keys(h, start))], names=[*part.schema.names, "n_shingles", "key_a", "key_b"])

    added = [T.StructField(c, T.LongType()) for c in ("n_shingles", "key_a", "key_b")]
    return docs.mapInArrow(_over_texts(text, size, emit), T.StructType([*docs.schema.fields, *added]))


def _sampled(docs: DataFrame, text: str, size: int, share: float) -> DataFrame:
    """Rows of ``token``, ``key_a`` for the shingles whose hash lies in the lowest ``share``."""

    def emit(batch, piece, h, start):
        low = h < U64(int(share * 2**64))
        owner = np.repeat(_keys(h, start)[1], np.diff(start))[low]
        return pa.RecordBatch.from_arrays([pa.array(h[low].view(np.int64)), pa.array(owner)], names=["token", "key_a"])

    return docs.select(text).mapInArrow(_over_texts(text, size, emit), "token long, key_a long")


def _bits(h: np.ndarray, start: np.ndarray) -> pa.Array:
    """For each set 512 bits, each telling whether an odd number of its hashes falls there.

    Two sets differ in at least as many elements as their bits do.
    """
    doc = np.repeat(np.arange(len(start) - 1), np.diff(start))
    odd = np.bincount(doc * 512 + (mix(h ^ U64(0xA4093822299F31D0)) & U64(511)).astype(np.int64), minlength=512 * (len(start) - 1)) & 1
    words = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(start), dtype=np.int32) * 8), pa.array(words))


def _full_sets(docs: DataFrame, text: str, size: int) -> DataFrame:
    def emit(batch, piece, h, start):
        sets = pa.LargeListArray.from_arrays(pa.array(start), pa.array(h.view(np.int64))).cast(pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([*map(pa.array, _keys(h, start)), sets, _bits(h, start)], names=["n", "key_a", "key_b", "tokens", "bits"])

    return docs.select(text).mapInArrow(_over_texts(text, size, emit), "n long, key_a long, key_b long, tokens array<long>, bits array<long>")


def must_share(n: Column, percent: int) -> Column:
    """Least intersection of a set of ``n`` with any partner."""
    return F.ceil(n * percent / 100)


def survivors(docs: DataFrame, classes: DataFrame, text: str, size: int, percent: int, share: float) -> DataFrame:
    """Classes that may have a partner.

    A set can spare ``n - must_share(n)`` shingles. One with more shingles that no other set holds has
    no partner: its rare-first prefix is all unique. Uniqueness is looked up in a part of all
    shingles that is the same for every document, so a count above the limit is a proof.
    """
    held = _sampled(docs, text, size, share).groupBy("token").agg(F.min("key_a").alias("key_a"), F.max("key_a").alias("_last"))
    unique = held.filter("key_a = _last").groupBy("key_a").agg(F.count("*").alias("unique"))
    alone = F.coalesce(F.col("unique"), F.lit(0)) > F.col("n_shingles") - must_share(F.col("n_shingles"), percent)
    return classes.join(unique, "key_a", "left").filter(~alone).drop("unique")


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """``token``, ``id``, ``n``, ``at``: the shared shingles of each set's rare-first prefix.

    Shingles stand by how many sets hold them, then by hash; those of one set only come first and
    need no row. ``at`` is the place in that order.
    """
    each = sets.select("id", "n", F.explode("tokens").alias("token"))
    held = each.groupBy("token").agg(F.count("*").alias("held")).filter("held > 1")
    shared = each.join(held, "token").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("held", "token"))).alias("shared"))
    alone = F.col("n") - F.size("shared")
    length = F.col("n") - must_share(F.col("n"), percent) + 1
    cut = F.slice("shared", F.lit(1), F.greatest(F.lit(0), length - alone).cast("int"))
    return shared.select("id", "n", alone.alias("_alone"), F.posexplode(cut).alias("_k", "_t")).select(
        F.col("_t.token").alias("token"), "id", "n", (F.col("_alone") + F.col("_k")).alias("at"))


def _possible(percent: int) -> Column:
    """What two sets with a common prefix shingle must meet to be near: length, positional and bit filter.

    The positional filter takes the shingle for their first common one. If it is not, another row of
    the pair has that, and the pair comes through there.
    """
    lengths = (F.col("n") * 100 >= F.col("n2") * percent) & (F.col("n2") * 100 >= F.col("n") * percent)
    need = F.ceil((F.col("n") + F.col("n2")) * percent / (100 + percent))
    room = F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2"))
    apart = reduce(lambda a, b: a + b, (F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("bits2")[i])) for i in range(8)))
    return (F.col("part") != F.col("part2")) & lengths & (room >= need) & (apart <= F.col("n") + F.col("n2") - 2 * need)


def _pairs(matches: DataFrame) -> DataFrame:
    """Each pair once, the lower id first."""
    return matches.select(F.least("id", "id2").alias("x"), F.greatest("id", "id2").alias("y")).distinct()


def _bound(x: np.ndarray, y: np.ndarray, depth: int) -> int:
    """A number of elements that two ascending sets surely do not share (suffix filter): halving both at a pivot, again and again."""
    if depth == 0 or not len(x) or not len(y):
        return abs(len(x) - len(y))
    pivot = y[len(y) // 2]
    i, j = int(np.searchsorted(x, pivot)), len(y) // 2
    here = int(i < len(x) and x[i] == pivot)
    return _bound(x[:i], y[:j], depth - 1) + _bound(x[i + here :], y[j + 1 :], depth - 1) + 1 - here


def _verifier(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                x, y = a.values.to_numpy().view(U64), b.values.to_numpy().view(U64)
                need = -(-percent * (len(x) + len(y)) // (100 + percent))
                if len(x) + len(y) - _bound(x, y, SUFFIX_DEPTH) < 2 * need:
                    keep.append(False)
                    continue
                keep.append(len(np.intersect1d(x, y, assume_unique=True)) >= need)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are near: suffix filter, then the full intersection, once a pair."""
    left = sets.select(F.col("id").alias("x"), F.col("tokens").alias("tx"))
    right = sets.select(F.col("id").alias("y"), F.col("tokens").alias("ty"))
    return pairs.join(left, "x").join(right, "y").select("x", "y", "tx", "ty").mapInArrow(_verifier(percent), "x long, y long")


def set_links(sets: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """``links`` (x, y) that connect all near sets, and ``component`` per set that has any.

    ``sets`` is a written table of ``id``, ``n``, ascending ``tokens`` and ``bits``. First, in each group of
    equal prefix shingle and like size, all are compared with one leader; then all pairs in different
    components are. A pair in the same component needs no look: so a group of near copies costs
    its size and not its square, and no link between components is lost.
    """
    prefix = materialise(prefixes(sets, percent).join(sets.select("id", "bits"), "id"), "jaccard-prefixes")
    links = None
    placed = prefix.withColumn("part", F.col("id"))
    for turn in range(LEADER_ROUNDS):
        band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + F.lit(0.5 * turn)).cast("int")
        grouped = placed.withColumn("band", band)
        lead = grouped.groupBy("token", "band").agg(
            F.min_by(F.struct("id", "n", "at", "bits", "part"), F.xxhash64(F.lit(turn), "token", "id")).alias("l"), F.count("*").alias("_size")).filter("_size > 1")
        right = lead.select("token", "band", *(F.col(f"l.{c}").alias(f"{c}2") for c in ("id", "n", "at", "bits", "part")))
        found = materialise(verified(_pairs(grouped.join(right, ["token", "band"]).filter(_possible(percent))), sets, percent), "jaccard-links")
        links = found if links is None else links.unionByName(found)
        parts = components(links, "x", "y")
        placed = prefix.join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component")
    placed = materialise(placed, "jaccard-placed")
    by_part = placed.groupBy("token", "part").agg(F.count("*").alias("size"))
    major = by_part.groupBy("token").agg(F.max_by("part", F.struct("size", "part")).alias("major"), F.count("*").alias("parts")).filter("parts > 1").select("token", "major")
    mixed = placed.join(major, "token")
    right = mixed.select("token", *(F.col(c).alias(f"{c}2") for c in ("id", "n", "at", "bits", "part")))
    matches = mixed.filter("part <> major").join(right, "token").filter(_possible(percent))
    links = links.unionByName(materialise(verified(_pairs(matches), sets, percent), "jaccard-links"))
    return links, components(links, "x", "y")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE_WORDS, percent: int = PERCENT, share: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Near-duplicate classes of documents: ``keyed`` (key and set keys per row), ``merged`` (set keys, ``component_id``).

    A text's set are its distinct shingles of ``size`` words, A-Z lower-cased; a shorter text with words has one;
    texts without words, empty or NULL have none and link with nothing. Sets are linked if 100 times
    their intersection is ``percent`` times their union or more; shingles are compared by 64-bit
    hashes. Equal sets are one class from the start, so copies are never paired. ``merged`` lists the
    classes of several documents or with links; ``component_id`` is the least key reachable (NULL keys are
    passed over). Repeated rows are copies like any other.
    """
    share = min(SAMPLE_OF_SPARE * (100 - percent) / 100, 0.99) if share is None else share
    keyed = materialise(with_keys(docs.select(key, text), text, size).drop(text), "jaccard-keys")
    of_class = ["n_shingles", "key_a", "key_b"]
    classes = keyed.filter("n_shingles > 0").groupBy(*of_class).agg(F.min(key).alias("first"), F.count("*").alias("rows"))
    classes = materialise(classes, "jaccard-classes")
    open_ = survivors(docs, classes, text, size, percent, share).withColumn("id", F.monotonically_increasing_id())
    open_ = materialise(open_, "jaccard-open")
    wanted = small(open_.select(F.col("first").alias("_first")))
    texts = docs.select(key, text).join(wanted, same(F.col(key), F.col("_first")), "left_semi")
    full = _full_sets(texts, text, size).join(small(open_.select("id", "n_shingles", "key_a", "key_b")), ["key_a", "key_b"]).filter("n = n_shingles")
    sets = materialise(full.groupBy("id", "n").agg(F.first("tokens").alias("tokens"), F.first("bits").alias("bits")), "jaccard-sets")
    _, parts = set_links(sets, percent)
    named = open_.join(parts.withColumnRenamed("node", "id"), "id").select(*of_class, "first", "component")
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    linked = named.join(least, "component").select(*of_class, "component_id")
    copies = classes.filter("rows > 1").join(linked, of_class, "left_anti").select(*of_class, F.col("first").alias("component_id"))
    return keyed, materialise(linked.unionByName(copies), "jaccard-classes")


def attach(keyed: DataFrame, merged: DataFrame, key: str = "doc_id") -> DataFrame:
    """Add ``component_id``: that of the row's class, or its own key."""
    of_class = ["n_shingles", "key_a", "key_b"]
    return keyed.join(small(merged), of_class, "left").withColumn("component_id", F.coalesce("component_id", key))


@query("op7_jaccard_join")
def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed, merged = groups(table(spark, sf_dir, "documents").select("doc_id", "text"), size=SHINGLE_WORDS, percent=PERCENT)
    return attach(keyed, merged).select("doc_id", "n_shingles", "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group, that with the least ``doc_id``; rows without words all stay.

    Groups are of ``STAGE_SHINGLE_WORDS`` words a shingle and ``STAGE_PERCENT`` percent.
    Of rows that are equal in set and ``doc_id``, one stays; rows of one ``doc_id`` that differ in set
    count as one document.
    """
    columns, same_row = docs.columns, ["doc_id", "n_shingles", "key_a", "key_b"]
    keyed, merged = groups(docs, size=STAGE_SHINGLE_WORDS, percent=STAGE_PERCENT)
    stays = (F.col("n_shingles") == 0) | same(F.col("doc_id"), F.col("component_id"))
    rows = with_keys(docs.select(F.struct(*columns).alias("_row"), "doc_id"), "_row.text", STAGE_SHINGLE_WORDS)
    kept = attach(rows, merged).filter(stays)
    again = attach(keyed, merged).filter(stays & (F.col("n_shingles") > 0)).groupBy(*same_row).agg(F.count("*").alias("_rows")).filter("_rows > 1")
    again = materialise(again.select(*(F.col(c).alias(f"_{c}") for c in same_row)), "jaccard-repeated")
    if again.isEmpty():
        return kept.select("_row.*")
    match = reduce(lambda a, b: a & b, (same(F.col(c), F.col(f"_{c}")) for c in same_row))
    first = kept.join(again, match, "left_semi").groupBy(*same_row).agg(F.first("_row").alias("_row"))
    return kept.join(again, match, "left_anti").select("_row.*").unionByName(first.select("_row.*"))

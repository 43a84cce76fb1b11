"""URL filters: a Bloom filter cascade over the corpus's complete key universe."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, table

#: Bits of a filter for each key it encodes. The first level, which meets the whole universe, gets more.
BITS_PER_KEY = 10
#: Rules of one cascade, which is sent to all tasks: some MB of filters. More rules make more cascades.
MAX_RULES = 1_000_000
MAX_LEVELS = 60
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# The rules to apply (verdict, host, path).
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Between host and path of a key.
MARK = "\n"


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for NULL or without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    stop = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:stop]


def keys(host: str, path: str, lengths: list[int]) -> Iterator[str]:
    """All rules that would fit: each suffix of whole labels with each path prefix of a listed length, longest first."""
    labels = host.split(".")
    suffixes = [".".join(labels[i:]) for i in range(len(labels))]
    fits = [(len(s) + n, len(s), s + MARK + path[:n]) for s in suffixes for n in lengths if n <= len(path)]
    for _, _, key in sorted(fits, key=lambda x: (-x[0], -x[1])):
        yield key


def probes(names: Iterable[str], level: int) -> np.ndarray:
    """Two 64-bit halves of a keyed hash for each name."""
    raw = b"".join(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16, key=b"%d" % level).digest() for x in names)
    return np.frombuffer(raw, np.uint64).reshape(-1, 2)


class Bloom:
    """A Bloom filter of a level of the cascade."""

    def __init__(self, level: int, n_keys: int, bits_per_key: int = BITS_PER_KEY) -> None:
        self.level, self.size, self.probes = level, max(64, n_keys * bits_per_key), max(1, round(bits_per_key * 0.69))
        self.bits = np.zeros(self.size // 8 + 1, np.uint8)

    def _at(self, names: list[str]) -> np.ndarray:
        h = probes(names, self.level)
        return (h[:, :1] + np.arange(self.probes, dtype=np.uint64) * (h[:, 1:] | np.uint64(1))) % np.uint64(self.size)

    def add(self, names: list[str]) -> None:
        if names:
            at = self._at(names).ravel()
            np.bitwise_or.at(self.bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def has(self, names: list[str]) -> np.ndarray:
        if not names:
            return np.zeros(0, bool)
        at = self._at(names)
        return ((self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


class Cascade:
    """Levels in turn hold the listed keys, the others they wrongly have, the listed keys those wrongly have, and so on."""

    def __init__(self, levels: list[Bloom]) -> None:
        self.levels = levels

    def has(self, names: list[str]) -> np.ndarray:
        """Exact membership for keys of the universe: the first level that lacks a key decides."""
        out, left = np.zeros(len(names), bool), np.arange(len(names))
        for i, bloom in enumerate(self.levels):
            inside = bloom.has([names[k] for k in left])
            out[left[~inside]] = i % 2 == 1
            left = left[inside]
        out[left] = len(self.levels) % 2 == 1
        return out


def _filter_of(names: DataFrame, level: int, bits_per_key: int = BITS_PER_KEY) -> Bloom:
    """A filter of all ``key`` rows: each task fills its own bits, which are joined by OR."""
    n = names.count()

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bloom(level, n, bits_per_key)
        for batch in batches:
            own.add(batch.column(0).to_pylist())
        at = np.flatnonzero(own.bits)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own.bits[at].astype(np.int64))], names=["at", "bits"])

    out = Bloom(level, n, bits_per_key)
    for part in names.mapInArrow(fill, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow().to_batches():
        out.bits[part.column(0).to_numpy()] = part.column(1).to_numpy().astype(np.uint8)
    return out


def build(listed: DataFrame, universe: DataFrame) -> Cascade:
    """The cascade of ``listed`` over ``universe``; both have a column ``key``, repeats allowed, NULL left out.

    The first level's bits grow with the logarithm of universe by list, so that about as many others
    as listed keys pass it, whatever the universe's size: only these go on, and each later round's keys
    are a hundredth of those two rounds before.
    """
    listed = listed.select("key").dropna().distinct().persist()
    ratio = max(2.0, universe.count() / max(1, listed.count()))
    levels = [_filter_of(listed, 0, max(BITS_PER_KEY, math.ceil(1.45 * math.log2(ratio))))]

    def passing(names: DataFrame, bloom: Bloom) -> DataFrame:
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(bloom.has(batch.column(0).to_pylist()), pa.bool_()))

        return names.select("key").mapInArrow(keep, "key string")

    wrong = passing(universe.select("key").dropna(), levels[0]).distinct().join(listed, "key", "left_anti").persist()
    right = listed
    while not wrong.isEmpty():
        if len(levels) == MAX_LEVELS:
            raise ValueError("the cascade does not end: two keys share their hashes")
        levels.append(_filter_of(wrong, len(levels)))
        right, wrong = wrong, passing(right, levels[-1]).persist()
    return Cascade(levels)


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow", max_rules: int = MAX_RULES) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (NULL if none fits) and ``verdict``; rows and other columns stay.

    ``rules`` has ``verdict`` (block or allow), ``host``, ``path``. A rule fits its host and all
    subdomains, if the path starts with its path; the longest host and path together wins, then the
    longer host; of a rule listed both ways block holds. Without a fitting rule the verdict is
    ``otherwise``. No page is joined with the list: two cascades, of listed keys and of those that
    block, answer for every key that a page can ask for, because these are the universe they were
    made over. Lists of more than ``max_rules`` are dealt by hash to several pairs of cascades, applied in turn.
    """
    own = rules.filter("host is not null").select("verdict", F.translate("host", UPPER, UPPER.lower()).alias("host"), F.coalesce("path", F.lit("")).alias("path")).distinct()
    own = own.select("verdict", F.concat_ws(MARK, "host", "path").alias("key"), F.length("path").alias("n"))
    parts = max(1, -(-own.count() // max_rules))
    out = pages.withColumn("host", F.lit("")).withColumn("path", F.lit("")).withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(otherwise))
    for part in range(parts):
        block = own if parts == 1 else own.filter(F.pmod(F.xxhash64("key"), F.lit(parts)) == part)
        lengths = sorted(r.n for r in block.select("n").distinct().collect())

        def asked(batches: Iterator[pa.RecordBatch], lengths=lengths) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([k for u in batch.column(0).to_pylist() for k in keys(*split_url(u), lengths)], pa.string())], names=["key"])

        universe = pages.select(url).mapInArrow(asked, "key string")
        listed = build(block, universe)
        blocking = build(block.filter("verdict = 'block'"), block)

        def apply(batches: Iterator[pa.RecordBatch], lengths=lengths, listed=listed, blocking=blocking) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names = batch.schema.names
                at = {c: names.index(c) for c in ("host", "path", "rule", "verdict")}
                split = [split_url(u) for u in batch.column(names.index(url)).to_pylist()]
                each = [list(keys(h, p, lengths)) for h, p in split]
                flat = [k for ks in each for k in ks]
                inside, hard = listed.has(flat), blocking.has(flat)
                rule, verdict, n = batch.column(at["rule"]).to_pylist(), batch.column(at["verdict"]).to_pylist(), 0
                for i, ks in enumerate(each):
                    found = np.flatnonzero(inside[n : n + len(ks)])
                    if len(found):
                        key = ks[found[0]]
                        size = lambda k: (len(k) - 1, k.index(MARK))
                        old = rule[i]
                        if old is None or size(key) > size(old):
                            rule[i], verdict[i] = key, "block" if hard[n + found[0]] else "allow"
                    n += len(ks)
                columns = [*batch.columns]
                for c, v in (("host", [h for h, _ in split]), ("path", [p for _, p in split]), ("rule", rule), ("verdict", verdict)):
                    columns[at[c]] = pa.array(v, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=names)

        out = out.mapInArrow(apply, out.schema)
    return out.withColumn("rule", F.replace("rule", F.lit(MARK), F.lit("")))


@query("op6_url_filter")
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")

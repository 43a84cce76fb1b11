"""Quality rules with adaptive thresholds from mergeable quantile sketches, in DataFrame functions only."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import SPACE_CLASS, SPACES, let, query, same, table

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW_WORDS = 5
#: Relative error of a sketch's quantiles.
ACCURACY = 0.01
#: Documents that a group needs for thresholds of its own; smaller groups use their language's, then all.
MIN_GROUP = 100
#: Fences stand this many spreads outside the quartiles.
FENCE = 4.0
#: Words at which a text's own sampling error doubles the variance: short texts get wider fences.
NOISE_WORDS = 50
#: Measure -> least spread. A spread is the distance of the quartiles, or this resolution where most
#: documents agree.
MEASURES = {"symbols_per_word": 0.03, "chars_per_word": 0.3, "dup_line_share": 0.1, "repeat_share": 0.04, "upper_share": 0.03}
TWO_SIDED = ("chars_per_word",)


def _covered(windows: Column) -> Column:
    """Words inside the windows (hashes by position) that are found twice or more."""
    in_order = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = let(in_order, lambda s: F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))))
    at = F.sort_array(F.transform(twice, lambda x: x["i"]))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW_WORDS).alias("last"))
    step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW_WORDS), p - acc["last"])).alias("n"), p.alias("last"))
    return F.aggregate(at, start, step, lambda acc: acc["n"])


def _repeated(words: Column) -> Column:
    size = F.size(words)
    windows = F.transform(F.sequence(F.lit(1), size - (WINDOW_WORDS - 1)), lambda i: F.xxhash64(*(F.element_at(words, i + k) for k in range(WINDOW_WORDS))))
    none = F.lit(0).cast("long")
    counted = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h)).otherwise(none))
    return F.when(size >= WINDOW_WORDS, counted).otherwise(none)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``n_lines``, ``n_upper``.

    Words are runs without white space. NULL and empty texts have 0 of everything. Windows of five
    words are compared by 64-bit hashes within one text. Columns of these names are replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    bare = F.btrim(whole, F.lit(SPACES))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACE_CLASS}]+"))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    from_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), _repeated(w).alias("repeat")))
    from_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    out = docs.withColumn("_w", from_words).withColumn("_l", from_lines)
    return out.withColumns({
        "n_words": F.col("_w.n"),
        "word_chars": F.col("_w.chars"),
        "n_symbols": F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": F.col("_l.dup"),
        "n_repeat_words": F.col("_w.repeat"),
        "n_lines": F.col("_l.n"),
        "n_upper": F.regexp_count(whole, F.lit(r"\p{Lu}")).cast("long"),
    }).drop("_w", "_l")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def values() -> dict[str, Column]:
    """The measures that have adaptive thresholds; 0 for a text without words."""
    per = lambda n, of: F.when(F.col(of) > 0, F.col(n) / F.col(of)).otherwise(F.lit(0.0))
    return {
        "symbols_per_word": per("n_symbols", "n_words"),
        "chars_per_word": per("word_chars", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"),
        "upper_share": per("n_upper", "word_chars"),
    }


def sketch(measured: DataFrame, groups: list[str]) -> DataFrame:
    """One quantile sketch per group and measure: counts of logarithmic buckets.

    A bucket holds values within ``ACCURACY`` of each other, so a sketch has some thousand rows at
    most, whatever the group's size; sketches merge by adding counts, in any order, with one result.
    """
    base = math.log((1 + ACCURACY) / (1 - ACCURACY))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), F.when(v > 0, F.floor(F.ln(v) / base)).alias("bucket")) for k, v in values().items())))
    return measured.select(*groups, each.alias("m")).select(*groups, "m.*").groupBy(*groups, "measure", "bucket").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, groups: list[str]) -> DataFrame:
    return sketches.groupBy(*groups, "measure", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """Per group and measure: ``n`` and the three quartiles ``q`` of a sketch."""
    by = [*groups, "measure"]
    upto = Window.partitionBy(*by).orderBy(F.col("bucket").asc_nulls_first())
    counted = sketches.withColumn("_upto", F.sum("n").over(upto)).withColumn("_all", F.sum("n").over(Window.partitionBy(*by)))
    base = math.log((1 + ACCURACY) / (1 - ACCURACY))
    value = F.coalesce(F.exp((F.col("bucket") + 0.5) * base), F.lit(0.0))
    at = lambda q: F.min(F.when(F.col("_upto") >= q * F.col("_all"), value))
    return counted.groupBy(*by).agg(F.sum("n").alias("n"), F.array(at(0.25), at(0.5), at(0.75)).alias("q"))


def thresholds(measured: DataFrame, groups: list[str], fence: float = FENCE, min_group: int = MIN_GROUP) -> DataFrame:
    """One row per group with ``fences``: measure -> the outer quartiles and how far beyond them is still kept.

    The groups' sketches are made once; those of the first column and of everything are merged from
    them. A group of fewer than ``min_group`` documents takes the next level's quartiles.
    """
    fine = sketch(measured, groups)
    own = quartiles(fine, groups)
    upper = [(quartiles(merge(fine, groups[:k]), groups[:k]), groups[:k]) for k in range(len(groups) - 1, -1, -1)]
    levels = own.withColumn("_q", F.when(F.col("n") >= min_group, F.col("q"))).drop("q")
    for i, (q, by) in enumerate(upper):
        right = q.select(*(F.col(c).alias(f"_g{c}") for c in by), F.col("measure").alias("_m"), F.col("n").alias("_n"), F.col("q").alias("_u"))
        match = reduce(lambda a, b: a & b, (same(F.col(c), F.col(f"_g{c}")) for c in by), F.col("measure") == F.col("_m"))
        usable = F.when((F.col("_n") >= min_group) | F.lit(i == len(upper) - 1), F.col("_u"))
        levels = levels.join(right, match, "left").withColumn("_q", F.coalesce("_q", usable)).drop("_m", "_n", "_u", *(f"_g{c}" for c in by))
    least = F.create_map(*(F.lit(x) for kv in MEASURES.items() for x in kv))[F.col("measure")]
    reach = fence * F.greatest(F.col("_q")[2] - F.col("_q")[0], least)
    limits = F.struct(F.col("measure"), F.struct(F.col("_q")[0].alias("low"), F.col("_q")[2].alias("high"), reach.alias("reach")))
    return levels.groupBy(*groups).agg(F.map_from_entries(F.collect_list(limits)).alias("fences"))


def judge(measured: DataFrame, groups: list[str]) -> DataFrame:
    """Add ``base_failed`` and ``kept`` to measured documents, which must be a written table.

    Thresholds come from the documents that pass the base rules. A document goes if it fails those or
    if any measure lies outside its group's fences. NULL is a group like any other; a group without a
    passing document has no fences, as it has nothing to judge; no documents give no rows.
    """
    passed = measured.filter(~base_failed())
    limits = materialise(thresholds(passed, groups), "quality-thresholds")
    right = limits.select(*(F.col(c).alias(f"_t{c}") for c in groups), "fences")
    match = reduce(lambda a, b: a & b, (same(F.col(c), F.col(f"_t{c}")) for c in groups))
    wider = F.sqrt(1 + F.lit(float(NOISE_WORDS)) / F.greatest(F.col("n_words"), F.lit(1)))

    def fits(name: str, value: Column) -> Column:
        fence = F.col("fences")[name]
        reach = fence["reach"] * wider
        below = value <= fence["high"] + reach
        return F.coalesce(below & (value >= fence["low"] - reach) if name in TWO_SIDED else below, F.lit(True))

    inside = reduce(lambda a, b: a & b, (fits(k, v) for k, v in values().items()))
    joined = measured.join(right, match, "left")
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & inside).drop("fences", *(f"_t{c}" for c in groups))


@query("op3_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    measured = materialise(measure(docs).drop("text"), "quality-measures")
    return judge(measured, ["lang", "source"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_upper")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the rules keep, unchanged."""
    columns = docs.columns
    measured = materialise(measure(docs.select(F.struct(*columns).alias("_row"), "lang", "source", "text")).drop("text"), "quality-documents")
    return judge(measured, ["lang", "source"]).filter("kept").select("_row.*")

"""Quality classifier: hierarchical empirical Bayes over sites and paths, combined with document evidence."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from .common import SPACE_CLASS, WORD, query, same, table
from .toxicity import held_out

#: Labelled documents used for fitting the document classifier, at most; chosen by a hash of their id.
TRAIN_DOCS = 20_000
#: Hashed words that the document classifier weighs beside the measures.
WORD_FEATURES = 1 << 12
#: Bounds of the strength of a prior, in documents.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1000.0
#: How much an unlabelled document's classifier probability counts against a label.
SOFT_COUNT = 0.5
KEEP_FROM = 0.5

FEATURES = ("log_words", "chars_per_word", "symbols", "uppercase", "marks", "digits", "line_words", "word_twice")


def evidence(text: Column) -> dict[str, Column]:
    """Measures of a whole text that a document classifier can weigh; NULL is an empty text."""
    whole = F.coalesce(text, F.lit(""))
    count = lambda pattern: F.regexp_count(whole, F.lit(pattern)).cast("double")
    n = F.greatest(count(WORD), F.lit(1.0))
    size = F.greatest(F.length(whole).cast("double"), F.lit(1.0))
    return {
        "log_words": F.log1p(count(WORD)),
        "chars_per_word": F.least(size / n, F.lit(50.0)),
        "symbols": F.log1p(100 * count(r"[#*$%&|<>]") / n),
        "uppercase": F.log1p(100 * count(r"\p{Lu}") / size),
        "marks": F.log1p(100 * count(r"[!?]") / n),
        "digits": F.log1p(100 * count(r"[0-9]") / size),
        "line_words": F.log1p(n / (count("\n") + 1)),
        "word_twice": F.log1p(100 * count(rf"(?<![^{SPACE_CLASS}])({WORD}+)[{SPACE_CLASS}]+\1(?![^{SPACE_CLASS}])") / n),
    }


def url_levels(url: Column) -> list[Column]:
    """Host (lower case) and first directory of the path, for tables that carry urls; both empty without ``://``."""
    whole = F.coalesce(url, F.lit(""))
    return [F.lower(F.regexp_extract(whole, r"^.*?://([^/?#]*)", 1)), F.regexp_extract(whole, r"^.*?://[^/?#]*(/(?:[^/?#]*/)?)", 1)]


def _vectors(texts: DataFrame, text: str) -> DataFrame:
    """Add ``_x``: the measures of a text and which hashed words it has."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), rf"[{SPACE_CLASS}]+"), "")
    measured = texts.select("*", words.alias("_w"), *(c.alias(f"_m_{k}") for k, c in evidence(F.col(text)).items())).drop(text)
    steps = [HashingTF(inputCol="_w", outputCol="_h", numFeatures=WORD_FEATURES, binary=True),
             VectorAssembler(inputCols=[*(f"_m_{k}" for k in FEATURES), "_h"], outputCol="_x")]
    return PipelineModel(steps).transform(measured).drop("_w", "_h", *(f"_m_{k}" for k in FEATURES))


def document_model(texts: DataFrame, known: DataFrame, max_docs: int = TRAIN_DOCS):
    """Logistic regression over measures and words of the labelled texts, or None if the labels are of one kind.

    ``texts`` has ``_key`` and ``_text``, ``known`` one ``_y`` for a ``_key``. At most ``max_docs`` ids are taken,
    one text (the least) for each, as vectors of bounded size.
    """
    chosen = known.orderBy(F.xxhash64("_key"), "_key").limit(max_docs)
    sample = texts.select("_key", "_text").join(F.broadcast(chosen), "_key").groupBy("_key").agg(F.min("_text").alias("_text"), F.max("_y").alias("_y"))
    train = materialise(_vectors(sample, "_text").select("_x", "_y"), "site-training")
    if train.select("_y").distinct().count() < 2:
        return None
    return LogisticRegression(featuresCol="_x", labelCol="_y", probabilityCol="_p", regParam=1e-3, maxIter=60, standardization=False).fit(train)


def _match(names: list[str]) -> Column:
    """Equality of columns with those of the same names behind an underscore; true without names."""
    match = F.lit(True)
    for c in names:
        match = match & same(F.col(c), F.col(f"_{c}"))
    return match


def _rate(depth: int, strengths: list[float], total: tuple[float, float], good: Column, count: Column) -> Column:
    """Posterior at a depth without a row's own evidence: each level's sums are shrunk to the rate of the level above."""
    left = F.greatest(F.lit(total[1]) - count, F.lit(0.0))
    rate = F.when(left > 1e-9, F.greatest(F.lit(total[0]) - good, F.lit(0.0)) / left).otherwise(0.5)
    for k in range(depth):
        hits, seen = F.greatest(F.col(f"_good_{k}") - good, F.lit(0.0)), F.greatest(F.col(f"_all_{k}") - count, F.lit(0.0))
        rate = (hits + strengths[k] * rate) / (seen + strengths[k])
    return rate


def _strength(good: Column, count: Column, rate: Column) -> Column:
    """Documents that a level's prior is worth: by how much the groups' rates differ beyond chance (moments)."""
    spread = F.sum(count * (good / count - rate) ** 2)
    chance = F.sum(rate * (1 - rate))
    between = F.greatest((spread - chance) / F.greatest(F.sum(count), F.lit(1e-9)), F.lit(1e-9))
    return F.least(F.greatest(F.avg(rate * (1 - rate)) / between, F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH))


def shrinkage(scored: DataFrame, levels: list[str]) -> tuple[DataFrame, list[float], tuple[float, float]]:
    """One row per finest group with ``_good_k`` and ``_all_k`` of each level k; each level's prior strength; the whole's sums.

    A group of few documents is worth little beside its prior, whose strength each level learns from
    how its groups differ. All sums combine before they are shuffled, and coarser levels sum the finer
    one's rows, so a group with a third of all rows is as cheap as any. NULL names are groups.
    """
    fine = materialise(scored.groupBy(*levels).agg(F.sum("_good").alias("_good"), F.sum("_weight").alias("_all")), "site-sums")
    r = fine.agg(F.sum("_good").alias("g"), F.sum("_all").alias("n")).first()
    total, strengths, above, zero = (float(r.g or 0), float(r.n or 0)), [], None, F.lit(0.0)
    for k in range(len(levels)):
        names = levels[: k + 1]
        sums = fine.groupBy(*names).agg(F.sum("_good").alias(f"_good_{k}"), F.sum("_all").alias(f"_all_{k}"))
        if above is not None:
            upper = above.select(*(F.col(c).alias(f"_{c}") for c in names[:-1]), *(f"_{s}_{i}" for i in range(k) for s in ("good", "all")))
            sums = sums.join(upper, _match(names[:-1])).drop(*(f"_{c}" for c in names[:-1]))
        prior = _rate(k, strengths, total, zero, zero)
        strengths.append(sums.agg(_strength(F.col(f"_good_{k}"), F.col(f"_all_{k}"), prior).alias("s")).first().s or MOST_STRENGTH)
        above = sums
    return above, strengths, total


def posteriors(scored: DataFrame, levels: list[str]) -> DataFrame:
    """One row per finest group: ``good`` and ``all`` evidence and ``rate``, shrunk to the level above, and that to the whole."""
    groups, strengths, total = shrinkage(scored, levels)
    last, zero = len(levels) - 1, F.lit(0.0)
    return groups.select(*levels, F.col(f"_good_{last}").alias("good"), F.col(f"_all_{last}").alias("all"), _rate(len(levels), strengths, total, zero, zero).alias("rate"))


def classify(docs: DataFrame, labels: DataFrame, levels: list[str], key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """``key``, the levels, ``held_out``, ``document_score``, ``site_rate``, ``score`` and ``kept`` for every row.

    ``document_score`` is the classifier's probability from the text alone. ``site_rate`` is the
    posterior of the row's finest group (``levels`` from coarse to fine, such as host and path) from
    all rows but the row itself: labels, and half a document's probability where there is none. The
    score adds the group's log odds against the overall ones to the document's, and ``kept`` is a score
    of ``KEEP_FROM`` or more. Labels of held-out ids (CRC-32 of the id leaves 2 when divided by 4) are learnt
    nowhere; prior strengths are learnt from all groups. Without usable labels all document scores are
    one half. Several labels for an id count as their largest; repeated rows count each, so one of
    them leaves only itself out. NULL ids have no label; NULL and empty texts are texts without words; NULL
    level names are groups; other columns of ``docs`` are not looked at.
    """
    inner = [f"_l{i}" for i in range(len(levels))]
    whole = docs.select(F.col(key).alias("_key"), *(F.col(c).alias(i) for c, i in zip(levels, inner)), F.col(text).alias("_text"))
    usable = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key)))
    known = usable.groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("double").alias("_y"))
    model = document_model(whole, known)
    if model is None:
        p = whole.drop("_text").withColumn("_d", F.lit(0.5))
    else:
        p = model.transform(_vectors(whole, "_text")).select("_key", *inner, vector_to_array("_p")[1].alias("_d"))
    given = p.join(known, "_key", "left")
    weight = F.when(F.col("_y").isNotNull(), 1.0).otherwise(SOFT_COUNT)
    scored = materialise(given.withColumn("_weight", weight).withColumn("_good", weight * F.coalesce("_y", "_d")).drop("_y"), "site-evidence")
    groups, strengths, total = shrinkage(scored, inner)
    sums = materialise(groups.withColumnsRenamed({c: f"_{c}" for c in inner}), "site-groups")
    own = (F.col("_good"), F.col("_weight"))
    odds = lambda x: F.log(F.greatest(x, F.lit(1e-6)) / F.greatest(1 - x, F.lit(1e-6)))
    rated = scored.join(sums, _match(inner)).withColumn("_r", _rate(len(levels), strengths, total, *own)).withColumn("_o", _rate(0, [], total, *own))
    out = rated.withColumn("_s", 1 / (1 + F.exp(-(odds(F.col("_d")) + odds(F.col("_r")) - odds(F.col("_o"))))))
    return out.select(
        F.col("_key").alias(key), *(F.col(i).alias(c) for c, i in zip(levels, inner)), held_out(F.col("_key")).alias("held_out"),
        F.col("_d").alias("document_score"), F.col("_r").alias("site_rate"), F.col("_s").alias("score"), (F.col("_s") >= KEEP_FROM).alias("kept"))


@query("op5_site_quality")
def site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents; ``source`` stands for the host and ``lang`` for the path, as ``documents`` has no urls."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("host"), F.col("lang").alias("path"))
    out = classify(docs, table(spark, sf_dir, "labels"), ["host", "path"])
    return out.select("doc_id", "held_out", "score", F.col("kept").cast("int").alias("predicted"), "kept", "document_score", "site_rate", "host", "path")

"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import WORD, query, same, table

BLOCK_TOKENS = 16
MAX_EPOCHS = 3
SHARD_DOCS = 2_000


def n_words(text: Column) -> Column:
    """Words of a text; NULL has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add ``target``: each source's share of all tokens by weight, at most ``max_epochs`` times its size.

    ``sources`` has one row per source with ``source_size`` and ``weight``. The excess of a source at
    its limit is shared again by weight among those below, until none is above; that is one level
    ``x`` with ``target = least(limit, x * weight)``. Each round reads two sums. A source of weight 0
    or NULL, or without tokens, gets 0. If all reach their limits, the targets sum to less.
    """
    limit = F.lit(max_epochs) * F.col("source_size")
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(0.0))
    total, weights = sources.agg(F.sum("source_size"), F.sum(weight)).first()
    total, weights, level, before = total or 0, weights or 0.0, 0.0, -1
    if total and weights:
        level, at_limit = total / weights, 0
        while at_limit != before:
            before = at_limit
            at_limit, held, gone = sources.filter(limit <= level * weight).agg(F.count("*"), F.sum(limit), F.sum(weight)).first()
            if at_limit == before or not at_limit:
                break
            if weights - gone <= 1e-12 * weights:
                break
            level = max(level, (total - held) / (weights - gone))
    return sources.withColumn("target", F.least(limit.cast("double"), F.lit(float(level)) * weight))


def sainte_lague(parties: DataFrame, group: str, order: list[str], votes: str, seats: str) -> DataFrame:
    """Add ``quota``: the seats of a party when ``seats`` of its group go to the highest quotients ``votes / (2 a + 1)``.

    All quotients above a divisor that is surely too large are won at once, by rounding; only the
    last few, four a party at most, are ranked. Equal quotients go by ``order``. ``seats`` must be the
    same in all rows of a group; NULL groups are groups; parties without votes get nothing. A group's
    parties meet in one task: they are sources, or the shards of a source, whose number grows with the
    root of its documents.
    """
    v = F.col(votes).cast("double")
    of_group = Window.partitionBy(group)
    scaled = lambda by: F.floor(v * by / F.col("_all") + 0.5)
    wide = (
        parties.withColumn("_all", F.sum(v).over(of_group)).withColumn("_n", F.count(F.when(v > 0, 1)).over(of_group))
        .withColumn("_low", F.when(v > 0, F.greatest(F.lit(0), scaled(F.col(seats) - F.col("_n") / 2) - 1)).otherwise(0).cast("long"))
        .withColumn("_high", F.when(v > 0, F.greatest(F.col("_low"), scaled(F.col(seats) + F.col("_n") / 2) + 1)).otherwise(0).cast("long"))
    )
    best_first = Window.partitionBy(group).orderBy(F.desc("_quotient"), *order, "_a")
    ranked = (
        wide.withColumn("_left", F.col(seats) - F.sum("_low").over(of_group))
        .withColumn("_a", F.explode(F.when(F.col("_high") > F.col("_low"), F.sequence("_low", F.col("_high") - 1)).otherwise(F.array(F.col("_low")))))
        .withColumn("_quotient", F.when(F.col("_high") > F.col("_low"), v / (2 * F.col("_a") + 1)).otherwise(-1.0))
        .withColumn("_rank", F.row_number().over(best_first))
    )
    won = F.count(F.when((F.col("_rank") <= F.col("_left")) & (F.col("_quotient") > 0), 1))
    return ranked.groupBy(*parties.columns).agg((F.first("_low") + won).alias("quota"))


def mix(
    docs: DataFrame, weights: DataFrame, key: list[str], source: str = "source", size: str = "size",
    block_tokens: int = BLOCK_TOKENS, max_epochs: int = MAX_EPOCHS, seed: int = 42,
) -> DataFrame:
    """Add ``source_size``, ``target`` and ``taken``: how many tokens of each document the mix holds, repeats counted.

    ``weights`` has a row per ``source`` with its ``weight``. Sources get blocks of ``block_tokens``
    by Sainte-Lague on their targets, and hand them on, by the same rule, to their shards (documents
    dealt by a seeded hash; a large source has many). A shard's documents stand in seeded order on a
    ring of tokens; its blocks are the ring's consecutive pieces, taken from a seeded first block on,
    going round again up to ``max_epochs`` times. So quotas are met to the token, a document may be
    taken in part, and reruns agree. ``key``, with the size, orders rows; fully equal rows are
    interchangeable. NULL sources form a source; sizes of NULL count 0; a source absent from
    ``weights`` gets nothing; no documents give no rows. Other columns are left out.
    """
    base = materialise(
        docs.select(*key, F.col(source).alias("source"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"))
        .withColumn("_h", F.xxhash64(F.lit(seed), *key)),
        "mix-sizes",
    )
    by_source = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_docs"))
    w = weights.select(F.col(source).alias("_s"), F.col("weight"))
    listed = materialise(by_source.join(w, same(F.col("source"), F.col("_s")), "left").drop("_s"), "mix-sources")
    aimed = targets(listed, max_epochs)
    blocks = round((aimed.agg(F.sum("target")).first()[0] or 0.0) / block_tokens)
    shard_docs = F.greatest(F.lit(float(SHARD_DOCS)), F.sqrt("_docs"))
    quotas = materialise(
        sainte_lague(aimed.withColumn("_all_sources", F.lit(0)).withColumn("_seats", F.lit(blocks)), "_all_sources", ["source"], "target", "_seats")
        .select("source", "source_size", "target", F.col("quota").alias("_blocks"), F.ceil(F.col("_docs") / shard_docs).alias("_shards")),
        "mix-quotas",
    )
    dealt = base.join(quotas.withColumnRenamed("source", "_s"), same(F.col("source"), F.col("_s"))).drop("_s")
    dealt = dealt.withColumn("_shard", F.pmod(F.col("_h"), F.col("_shards")))
    shards = dealt.groupBy("source", "_shard").agg(F.sum("size").alias("_ring"), F.first("_blocks").alias("_blocks"))
    shares = sainte_lague(shards, "source", ["_shard"], "_ring", "_blocks").select(
        F.col("source").alias("_s"), F.col("_shard").alias("_k"), "_ring", F.col("quota").alias("_quota"))
    in_shard = Window.partitionBy("source", "_shard").orderBy("_h", *key, "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_at", F.coalesce(F.sum("size").over(in_shard), F.lit(0)))
    placed = placed.join(shares, same(F.col("source"), F.col("_s")) & (F.col("_shard") == F.col("_k")))
    length = F.least(F.col("_quota") * block_tokens, F.col("_ring") * max_epochs)
    first = F.pmod(F.xxhash64(F.lit(seed), F.lit("first block"), "source", "_shard"), F.greatest(F.lit(1), F.floor(F.col("_ring") / block_tokens))) * block_tokens
    overlap = lambda lo, hi: F.greatest(F.lit(0), F.least(F.col("_at") + F.col("size"), hi) - F.greatest(F.col("_at"), lo))
    placed = placed.withColumn("_len", length).withColumn("_from", first).withColumn("_rounds", F.floor(F.col("_len") / F.greatest(F.lit(1), F.col("_ring"))))
    placed = placed.withColumn("_to", F.col("_from") + F.col("_len") - F.col("_rounds") * F.col("_ring"))
    taken = F.col("_rounds") * F.col("size") + overlap(F.col("_from"), F.least("_to", "_ring")) + overlap(F.lit(0), F.col("_to") - F.col("_ring"))
    return placed.select(*key, "source", "size", "source_size", "target", F.when(F.col("_ring") > 0, taken).otherwise(0).cast("long").alias("taken"))


def cyclic_weights(docs: DataFrame, source: str = "source", cycle: int = 3) -> DataFrame:
    """Weights 1, 2, .. ``cycle``, 1, .. for the distinct sources by code point, NULL last. One small row per source."""
    by_name = Window.orderBy(F.col(source).asc_nulls_last())
    return docs.select(source).distinct().select(source, ((F.row_number().over(by_name) - 1) % cycle + 1).alias("weight"))


@query("op8_source_mix")
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return mix(sized, cyclic_weights(sized), ["doc_id"])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the mix takes words of, with how many (repeats counted) and their source's target.

    Rows come with their ids, not their texts: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``taken``.
    """
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return mix(sized, cyclic_weights(sized), ["doc_id"]).filter("taken > 0")

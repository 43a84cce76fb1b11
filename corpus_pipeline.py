"""The corpus pipeline: quality rules, near duplicates, decontamination, secrets, mixing; each stage works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pitlake.llm import decontaminate, jaccard_join, mixing, quality_rules, secret_scan
from pitlake.session import materialise, tune

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("jaccard_join", jaccard_join.stage),
    ("decontaminate", decontaminate.stage),
    ("secret_scan", secret_scan.stage),
    ("source_mix", mixing.stage),
]

#: Phrase search and components of near duplicates have no SQL form that ends on whole tables; the
#: pipeline is tested against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    tune(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = materialise(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Session settings and the shared scratch folder."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: The run folder in use, and where materialised tables lie.
_RUN: ContextVar[str | None] = ContextVar("run_folder", default=None)
_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()

# Adaptive execution sizes the shuffles, splits skewed join partitions and switches to a
# broadcast only after a side has been measured, so no operator here forces a broadcast.
CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join partition even where the next step needs one more shuffle for it
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # tables that are both partitioned by some of the join's keys meet without another shuffle
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "pitlake", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings above; ``master`` is only for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> None:
    """Give a session made elsewhere the adaptive settings above."""
    for key, value in CONF.items():
        if key.startswith("spark.sql.adaptive."):
            spark.conf.set(key, value)


def _scratch_root(spark: SparkSession) -> str:
    """The cluster's shared ``spark.checkpoint.dir``.

    Only in local mode, where driver and executors are one machine, a temporary folder takes the
    place of an unset setting; on a cluster the setting is required.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="pitlake-")
    return root.rstrip("/")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the run folder in use, else under the shared scratch folder."""
    return f"{_RUN.get() or _scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def run_folder(spark: SparkSession, name: str = "run") -> Iterator[str]:
    """Everything that is materialised inside goes to one folder, which is deleted at the end.

    A result must be written elsewhere, or collected, before the end; folders nest.
    """
    path = f"{_RUN.get() or _scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    token = _RUN.set(path)
    try:
        yield path
    finally:
        _RUN.reset(token)
        delete(spark, path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage, and no later step computes it again."""
    path = scratch_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def co_partitioned(df: DataFrame, keys: Sequence[str], name: str, buckets: int | None = None) -> DataFrame:
    """``df`` written to the shared folder in buckets of ``keys``, as a table of this session, and read back.

    Aggregates, windows and joins whose keys contain these keep that partitioning and need no
    shuffle of the table; column pruning and filters work as on any Parquet table. There are as many buckets as
    shuffle partitions, unless a number is given.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_dir(spark, name)
    table = f"{name}_{path.rsplit('-', 1)[1]}"
    df.repartition(n, *keys).write.option("path", path).option("compression", "zstd").bucketBy(n, *keys).sortBy(*keys).saveAsTable(table)
    out = spark.table(table)
    _WRITTEN[out] = path
    return out


def release(df: DataFrame) -> None:
    """Delete the files of a table that ``materialise`` returned, once nothing reads it any more."""
    path = _WRITTEN.pop(df, None)
    if path:
        delete(df.sparkSession, path)


def slots(spark: SparkSession) -> int:
    """How many tasks can run at once now."""
    context = spark.sparkContext._jsc.sc()
    return max(1, context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile()))


def forget(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs, which stay until the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()

"""Session helpers: a local session for tests, and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str = "8", memory: str = "8g", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("oligoweave")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only where nothing is configured (tests on one machine) a fresh local folder is
    made and recorded in the session.
    """
    context = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if not configured:
        configured = context._jsc.sc().getCheckpointDir()
        configured = configured.get() if configured.isDefined() else None
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="oligoweave-")
        context.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path under the shared folder."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back.

    A written table outlives the loss of any executor, and the reader starts from
    exact file sizes, so the planner sizes the next joins from facts.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "stage")
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside go when it ends, not when the driver happens to collect its garbage.

    For writes: their plans run once, and the table stays.
    """
    before = spark.conf.get(CLEANUP_KEY, None)
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP_KEY) if before is None else spark.conf.set(CLEANUP_KEY, before)


def by_shuffle(df: DataFrame) -> DataFrame:
    """The same rows as a side of a join, which then shuffles and never collects them in the driver.

    The planner broadcasts a written table of up to so many bytes as compressed; rows that
    repeat each other are tens of times that in the driver's memory.
    """
    return df.hint("merge")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows over as many tasks as a shuffle has, by keys if given: few bytes, much work.

    A small table is one block of one file, so without this one task does all the work on it.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)

"""Session settings and lineage helpers.

Library functions never create a session; they take DataFrames. ``local_session``
is for tests, the benchmark and the driver entry point only.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job of this package expects: adaptive execution (runtime
# broadcast decisions from measured sizes, partition coalescing, skew-join
# splitting) and Arrow for the single markup UDF.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: int = 8, shuffle_partitions: int | None = None,
                  app: str = "termweave") -> SparkSession:
    """A local session for tests and benchmarks (UI off, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.default.parallelism", str(cores))
        .config("spark.driver.memory", "16g")
        .config("spark.sql.files.maxPartitionBytes", str(32 * 1024 * 1024))
    )
    for k, v in RECOMMENDED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; where it is unset, a folder in
    the session's warehouse, which driver and executors share."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None) or "/".join(
        [spark.conf.get("spark.sql.warehouse.dir").rstrip("/"), "_checkpoints", sc.applicationId])
    sc.setCheckpointDir(folder)
    return folder


# Bytes of input files for one partition of tokens: an n-gram row takes some hundred times
# the room that its part of the file does, so a task's counts stay within a few hundred MB.
BYTES_PER_PART = 4 * 1024 * 1024


def input_bytes(df: DataFrame) -> int:
    """Bytes of the largest table ``df`` reads, from the file listing (no job runs)."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return max((s for s in sizes if s < 1 << 60), default=0)  # more stands for an unknown size


def parts(df: DataFrame) -> int:
    """Partitions for data that grows after its exchange: the shuffle partitions, or more
    where the input has more than ``BYTES_PER_PART`` for each.  Given to ``repartition``
    they are not coalesced by adaptive execution, which sees the bytes before they are
    exploded."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-input_bytes(df) // BYTES_PER_PART))


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition on the keys of a large aggregate where the shuffle partitions are too
    few for its input; smaller ones are left to Spark, which combines before the exchange."""
    n = parts(df)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def broadcast_limit(spark: SparkSession) -> int:
    """Bytes up to which Spark broadcasts a table by itself; below 0 where it never does."""
    return spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a scan over the cluster when it arrives in too few partitions.

    Large inputs come as many files / row groups and are left alone (no
    shuffle); a scan with fewer partitions than the default parallelism (for
    instance one big row group) is hash-partitioned on ``keys`` so every
    per-row step after it runs in parallel.  Reading the partition count only
    plans the scan; it runs no job.
    """
    spark = df.sparkSession
    want = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    want = max(want, -(-input_bytes(df) // BYTES_PER_PART))
    return df.repartition(want, *keys) if keys else df.repartition(want)


def ship_package(spark: SparkSession) -> None:
    """Make ``termweave`` importable in the Python workers (what ``--py-files``
    does): zip the package once and add it to the session's Python files.
    Needed by operators that run Python; a no-op after a session's first call."""
    import shutil

    sc = spark.sparkContext
    if getattr(sc, "_termweave_shipped", False):
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="termweave-pyfiles-")
    archive = shutil.make_archive(os.path.join(out, "termweave"), "zip",
                                  root_dir=os.path.dirname(pkg), base_dir=os.path.basename(pkg))
    sc.addPyFile(archive)
    sc._termweave_shipped = True

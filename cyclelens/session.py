"""Session settings the plans count on, and the shared folder for written intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "cyclelens") -> SparkSession:
    """A session for tests and benches on one machine; a cluster job brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Shuffled bytes that adaptive execution gives a task, about: four times less than Spark's own, as a task joins, groups and sorts what it reads.
TASK_BYTES = "16m"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def adapt(spark: SparkSession) -> SparkSession:
    """Switch on the runtime re-planning the plans rely on: partition coalescing and splitting of skewed join partitions.

    A grouping takes over the partitioning of the join before it, which saves its shuffle. Where the join turns out skewed, it is split all the
    same and the grouping shuffles then (`forceOptimizeSkewedJoin`). A task then holds the sorts of two joins and the tables of two groupings at
    once, so partitions are not coalesced to what one sort could hold: large ones spill several times what they read. A size of the session's own stays.
    """
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    if spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", None) is None:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", TASK_BYTES)
    return spark


def release(spark: SparkSession) -> SparkSession:
    """Have the shuffle files of a query removed when it ends, and not when the driver next collects garbage.

    For chains of large writes, each of which reads what the one before it stored: their shuffles would lie on the disks together. A frame that is
    run again makes its shuffles anew. A value of the session's own stays.
    """
    if spark.conf.get(CLEANUP, None) in (None, "false"):
        spark.conf.set(CLEANUP, "true")
    return spark


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder for `label` under the cluster's shared `spark.checkpoint.dir`.

    Only a local session may fall back to a temporary folder: on a cluster, executors could not read it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="cyclelens-")
    return f"{base.rstrip('/')}/cyclelens/{label}-{uuid.uuid4().hex}"

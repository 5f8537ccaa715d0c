"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "gaugeflow", cores: str = "8", partitions: int = 8) -> SparkSession:
    """Session for tests and the benchmark. On a cluster the caller brings their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors see: the one the cluster names in ``spark.checkpoint.dir``.

    Only a local session without one, as in tests, gets a folder of its own; on a cluster that
    would be a disk which the other machines do not see, so it is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if named is None:
        named = tempfile.mkdtemp(prefix="gaugeflow-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named


def task_count(spark: SparkSession) -> int:
    """Number of tasks for stages with little data and much arithmetic.

    Given as a number it is kept; partitions merged by size would leave cores idle there.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def new_folder(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_folder(spark)}/gaugeflow-tables/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Used where one table feeds many passes (model fits, report fan-out). A stored columnar table
    survives lost executors, is pruned by column in each pass, and gives the planner its true
    size, so that it broadcasts what is small and only that.
    """
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

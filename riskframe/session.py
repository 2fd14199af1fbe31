"""Session construction and the one place that decides where lineage is cut."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # wide feature projections: methods beyond this size would run uncompiled
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  **extra: str) -> SparkSession:
    """A session with the settings the library relies on; cluster values win when set."""
    builder = SparkSession.builder.appName("riskframe")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables, one per application, that driver and executors share.

    It lies below ``spark.checkpoint.dir``, or below the warehouse where that is not set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/riskframe-{spark.sparkContext.applicationId}"


#: Whether Spark drops the shuffle files of a written query when it ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame, drop_shuffles: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it from there.

    Later passes all see the same rows, survive lost executors, and read only the
    columns they need. ``drop_shuffles`` frees the shuffle files of the write at once, which
    else stay on disk until the driver happens to collect its garbage.
    """
    path, conf = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}", df.sparkSession.conf
    before = conf.get(DROP_SHUFFLES, "false")
    conf.set(DROP_SHUFFLES, "true" if drop_shuffles else before)
    try:
        df.write.parquet(path)
    finally:
        conf.set(DROP_SHUFFLES, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_intermediates(spark: SparkSession) -> None:
    """Delete this application's intermediate tables once no result needs them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

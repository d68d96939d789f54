"""Reading tables, and keeping steps in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or for a local session without one, a new folder that is set there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Spark's setting by which an execution's shuffle files go when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stash(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Writes a step as Parquet to the shared folder and reads it back: its lineage ends there, and its shuffle files,
    which nothing reads again, are removed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/step-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """Deals rows of fewer partitions than cores, such as those of one file that cannot be split, to all cores before
    work that costs much a row. Filters and column choices are still pushed to the scan below."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.isStreaming or rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def dealt_by_rows(rows: DataFrame, most: int = 50_000) -> DataFrame:
    """Deals rows out in parts of about ``most``, before work that costs much a row: tasks grow in number with the input,
    not in length. Splits of a file do not tell: a row group is read by one of them, and the others have no rows."""
    if rows.isStreaming:
        return rows
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // most)))

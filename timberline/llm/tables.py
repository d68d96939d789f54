"""Reading inputs and keeping steps in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or for tests without one, a local folder that is then set there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def discard(step: DataFrame) -> None:
    """Removes the files of a stashed step that nothing reads any more."""
    spark = step.sparkSession
    folders = {file.rsplit("/", 1)[0] for file in step.inputFiles()}
    for folder in folders:
        if folder.rsplit("/", 1)[1].startswith("step-"):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


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


def row_key(text: str = "text") -> list:
    """doc_id with the 128-bit digest of the text: tells apart rows of one doc_id, or without any, that differ."""
    return [F.col("doc_id"), text_key(text).alias("row_hash")]


def text_key(text: str = "text") -> Column:
    """16 bytes that stand for a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))

"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    A session without that setting gets a temporary folder only where it runs in one process (local tests); on a cluster
    executors would write to disks of their own.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quillspark/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it again.

    Unlike localCheckpoint the rows outlive the executors that made them. Shuffle files of the plan go as soon as the
    table is complete, since later plans start from it.
    """
    conf, path = df.sparkSession.conf, new_path(df.sparkSession, name)
    before = conf.get(CLEAN_UP, "false")
    conf.set(CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(CLEAN_UP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete what table() wrote, when no later plan reads it."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def share(order: Column) -> Column:
    """A number from 0 up to 1 from all bits of a 64-bit hash, so that shares of any table's rows can be told apart."""
    return (F.pmod(order, F.lit(1 << 20)) + F.shiftrightunsigned(order, 20) / float(1 << 44)) / float(1 << 20)


def least_hashes(rows: DataFrame, order_col: str, most: int, total: int) -> Iterator[DataFrame]:
    """Frames of the rows of the `most` smallest shares of order_col, each for when the one before held fewer than it could.

    total, the rows counted, says from which share on rows can be left out before they are put in order; should that leave
    too few, the share is widened until all rows are in."""
    part = min(1.0, 1.2 * most / max(total, 1))
    while True:
        yield rows.where(share(F.col(order_col)) < part) if part < 1 else rows
        if part >= 1:
            return
        part = min(1.0, 64 * part)


def words_of(text: Column) -> Column:
    """Array of the maximal runs of anything but the six ASCII white-space characters."""
    return F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

"""Scratch tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SET = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where that is unset, a local one is set if all of Spark runs on this machine."""
    folder = spark.sparkContext.getConf().get(_SET, None) or spark.conf.get(_SET, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_SET} must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="ledgerline-")
        spark.conf.set(_SET, folder)
    return folder.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder; Hadoop deletes it when the driver ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def staged(df: DataFrame, what: str) -> DataFrame:
    """df written once to the shared folder and read back: cuts lineage and outlives lost executors."""
    path = shared_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, what: str, key: str, buckets: int | None = None) -> DataFrame:
    """df written once to the shared folder in buckets of `key`, one file each, sorted by it (by default as many as a shuffle has
    partitions): joins and groupings by the key read it without an exchange."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path, name = shared_path(spark, what), f"{what}_{uuid.uuid4().hex}".replace("-", "_")
    df.repartition(n, key).write.option("path", path).option("compression", "zstd").format("parquet").bucketBy(n, key).sortBy(key).saveAsTable(name)
    return spark.table(name)


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt to all cores if the scan has fewer tasks than there are cores, as with one file of one row group; else as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows

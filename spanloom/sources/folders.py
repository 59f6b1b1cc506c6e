"""Folders of tables: the shared scratch folder, and what lies in a partitioned one."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir, which driver and executors share; where that is unset, one of this machine, for sessions that run on it alone."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, name: str) -> DataFrame:
    """A table written to the shared folder and read back: what is read several times is made once, and lost executors cost nothing."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


#: Rows of a dealt table for which it has a further bucket, about. A task sums up a bucket, so that what it holds at once has a bound at every size.
PER_BUCKET = 250_000


def dealt(rows: DataFrame, name: str, key: str, most: int = 0) -> DataFrame:
    """A table as of `written`, in buckets by key: sums and joins by that key read it where it lies, so it is dealt once, however often it is read. `most` rows are expected."""
    spark = rows.sparkSession
    path, buckets = scratch(spark, name), buckets_of(spark, most)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    rows.repartition(buckets, key).write.bucketBy(buckets, key).option("path", path).saveAsTable(table)
    return spark.table(table)


def buckets_of(spark: SparkSession, most: int) -> int:
    """Buckets for so many rows: as many as a shuffle has partitions, at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-most // PER_BUCKET))


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, fs = _place(spark, path)
    return bool(fs.exists(place))


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if there is no such folder."""
    place, fs = _place(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    place, fs = _place(spark, path)
    fs.delete(place, True)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a folder."""
    place, fs = _place(spark, path)
    return int(fs.getContentSummary(place).getLength()) if fs.exists(place) else 0


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a pattern names; nothing is read, so empty files are found too."""
    place, fs = _place(spark, pattern)
    return sorted(s.getPath().toString() for s in fs.globStatus(place) or ())

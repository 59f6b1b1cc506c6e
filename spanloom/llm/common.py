"""Helpers that the corpus operators share: written tables in the cluster's shared folder, words, row keys."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as Java's, RE2's and Python's regular expressions all read it.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder of this machine will do only for a session whose tasks all run on it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage is cut, lost executors cost nothing, and Spark knows its size when it picks a join."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """A folder of its own in the shared folder for the tables of one run, which clear() removes when its result is written elsewhere."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.tables, self.dealt = spark, new_path(spark, name), 0, []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.tables += 1
        path = f"{self.path}/{self.tables:03d}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def deal(self, df: DataFrame, name: str, key: str | tuple[str, ...], least: int = 0) -> DataFrame:
        """As write, in buckets by key (one column or several), of which there are `least`, or as many as a shuffle has partitions: a join by that key reads them where they lie."""
        self.tables += 1
        buckets = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), least)
        key = (key,) if isinstance(key, str) else key
        table = f"{name}_{self.tables:03d}_{self.path.rsplit('-', 1)[1]}"
        df.repartition(buckets, *key).write.bucketBy(buckets, *key).option("path", f"{self.path}/{self.tables:03d}-{name}").saveAsTable(table)
        self.dealt.append(table)
        return self.spark.table(table)

    def clear(self) -> None:
        for table in self.dealt:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def give_back() -> None:
    """Hands memory that Arrow keeps for later back to the system: workers outlive a task, and the next one may need it elsewhere."""
    pa.default_memory_pool().release_unused()


def row_keys(*names: str) -> tuple[Column, Column]:
    """Two 64-bit keys, equal for rows that are equal in these columns; together they tell rows apart at any size of a table."""
    nulls = F.concat(*(F.col(n).isNull().cast("string") for n in names))
    return F.xxhash64(nulls, *names), F.xxhash64(*reversed(names), nulls)


def word_count(text: Column) -> Column:
    """Words in a text as a long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

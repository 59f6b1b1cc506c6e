"""Line dedup by levelled sorted runs of line hashes, in DataFrame functions only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, materialize, row_keys
from .linefreq import let

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a null doc_id; below all others.
NO_ID = -(1 << 63)


def line_key(line: Column) -> Column:
    """A line stripped of white space at both ends, A-Z in lower case."""
    return let(F.btrim(line, F.lit(WHITE)), lambda t: F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER)))


class LineRuns:
    """Line hashes (a, b) with their uses, as sorted runs on levels.

    A run is a table bucketed and sorted by its hashes, so a batch is merged with it where it lies: only the batch is dealt.
    A batch's hashes that a run already has `enough` times add nothing; the others become a run of level 0. Two runs of
    a level are compacted to one of the next, by a full outer merge join that moves no row. A hash's uses are the sum
    over all runs. Runs are never united (UNION): Spark 4.1.2 takes a union of bucketed tables for bucketed itself, and
    sums over it come out wrong.
    """

    def __init__(self, spark: SparkSession, enough: int):
        self.spark, self.enough = spark, enough
        self.space = Scratch(spark, "line-runs")
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[str | None] = []

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "a", "b").sortBy("a", "b").option("path", f"{self.space.path}/{name}").saveAsTable(name)
        return name

    def _runs(self) -> list[str]:
        return [n for n in self.levels if n]

    def add(self, keys: DataFrame) -> None:
        """Takes in a batch (a, b; one row a use)."""
        new = keys.groupBy("a", "b").agg(F.count("*").alias("uses"))
        for name in self._runs():
            known = self.spark.table(name).where(F.col("uses") >= self.enough).select("a", "b")
            new = new.join(known.hint("merge"), ["a", "b"], "left_anti")
        run, level = self._write(new), 0
        while level < len(self.levels) and self.levels[level]:
            run, self.levels[level] = self._compacted(self.levels[level], run), None
            level += 1
        if level == len(self.levels):
            self.levels.append(None)
        self.levels[level] = run

    def _compacted(self, one: str, other: str) -> str:
        x, y = (self.spark.table(n).withColumnRenamed("uses", u) for n, u in ((one, "u"), (other, "v")))
        uses = F.coalesce("u", F.lit(0)) + F.coalesce("v", F.lit(0))
        name = self._write(x.join(y.hint("merge"), ["a", "b"], "full").select("a", "b", uses.alias("uses")))
        self._drop([one, other])
        return name

    def often(self) -> DataFrame:
        """The hashes with `enough` uses or more, once all runs are compacted to one."""
        first, *rest = self._runs()
        for name in rest:
            first = self._compacted(first, name)
        self.levels = [first]
        return self.spark.table(first).where(F.col("uses") >= self.enough).select("a", "b")

    def _drop(self, runs: list[str]) -> None:
        for name in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def clear(self) -> None:
        self._drop(self._runs())
        self.space.clear()


def gone_lines(docs: DataFrame, enough: int = 5, least_chars: int = 40, batches: int = 4) -> DataFrame:
    """row_a, row_b (row_keys of doc_id and text), gone (numbers of lines from 0) of the rows of docs (doc_id, text) that lose lines.

    Lines whose key (line_key) has `least_chars` code points or more and is found in `enough` documents or more stay in the
    document with the largest doc_id of those alone. Rows with one doc_id are one document; rows without one are together one, below
    all others. Lines are hashed once (128 bits); the hashes go through LineRuns in `batches` parts, counted by rows, which
    preselects; documents are counted for what remains, lines of a hot key by Spark's split of skewed joins and partial sums.
    """
    spark = docs.sparkSession
    a, b = row_keys("doc_id", "text")
    keyed = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.struct(line_key(x).alias("k"), i.alias("pos")))
    hashed = F.transform(F.filter(keyed, lambda l: F.char_length(l["k"]) >= least_chars), lambda l: F.struct(F.xxhash64(l["k"]).alias("a"), F.xxhash64(F.lit("line"), l["k"]).alias("b"), l["pos"].alias("pos")))
    rows = docs.select(a.alias("row_a"), b.alias("row_b"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), hashed.alias("lines")).where(F.size("lines") > 0)
    space = Scratch(spark, "line-dedup")
    lined = space.write(rows, "hashed")
    runs = LineRuns(spark, enough)
    for i in range(batches):
        part = lined.where(F.pmod(F.col("row_a"), F.lit(batches)) == i)
        distinct = F.array_distinct(F.transform("lines", lambda l: F.struct(l["a"].alias("a"), l["b"].alias("b"))))
        runs.add(part.select(F.explode(distinct).alias("k")).select("k.*"))
    often = space.write(runs.often(), "often")
    runs.clear()
    lines = lined.select("row_a", "row_b", "doc", F.explode("lines").alias("l")).select("row_a", "row_b", "doc", "l.*")
    held = space.write(lines.join(often.hint("merge"), ["a", "b"]), "held")
    counts = held.groupBy("a", "b").agg(F.count_distinct("doc").alias("docs"), F.max("doc").alias("last")).where(F.col("docs") >= enough)
    frequent = space.write(counts.select("a", "b", "last"), "frequent")
    gone = held.join(frequent, ["a", "b"]).where(F.col("doc") != F.col("last"))
    out = materialize(gone.groupBy("row_a", "row_b").agg(F.array_sort(F.collect_set("pos")).alias("gone")), "gone-lines")
    space.clear()
    return out


def _with_gone(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """row (all columns of docs as a struct), lines (of the whole text, null as empty), gone (null for none). Texts are dealt by their rows' keys once, at every size."""
    a, b = row_keys("doc_id", "text")
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"), a.alias("row_a"), b.alias("row_b"))
    return rows.join(gone.hint("merge"), ["row_a", "row_b"], "left")


def _kept() -> Column:
    return F.array_join(F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x, i: ~F.array_contains("gone", i))), "\n")


def dedup(docs: DataFrame, **limits: int) -> DataFrame:
    """docs, whatever their further columns, without the lines that gone_lines names (limits: its arguments). Null texts stay null, empty ones empty; a text that loses all lines becomes empty; repeated rows fare alike; an empty table gives an empty one."""
    found = _with_gone(docs, gone_lines(docs, **limits))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(_kept())
    return found.select(*(text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


def report(docs: DataFrame, **limits: int) -> DataFrame:
    """Per row of docs: doc_id, n_lines (before), n_dropped, kept_sha256 (of the lines that stay, joined by \\n). A null or empty text is one empty line. See gone_lines and dedup."""
    found = _with_gone(docs, gone_lines(docs, **limits))
    dropped = F.coalesce(F.size("gone"), F.lit(0)).cast("long")
    return found.select(F.col("row.doc_id").alias("doc_id"), F.size("lines").cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), F.lit(0).cast("long")).otherwise(dropped).alias("n_dropped"), F.sha2(_kept(), 256).alias("kept_sha256"))

"""A corpus from raw documents to packed sequences: five stages, each a table that the next one reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import crf, linefreq, minhash, mixture, packing
from spanloom.llm.common import documents, materialize, word_count
from spanloom.llm.queries import crc_mod, labels, tokenizer_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.3; the field learns from the labels of those whose checksum mod 4 is not 2. Null and empty texts score as texts without words and stay; without two classes of labels all stay. Repeated rows fare alike."""
    return crf.keep_clean(docs, labels(spark, sf_dir), crc_mod(4) != 2)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and keep enough words once their source's frequent lines are gone; without those lines. Null, empty and short texts go; repeated rows count as one document and fare alike."""
    return linefreq.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id, and of repeated rows one. Null texts and those without words have no duplicates and stay."""
    return minhash.keep_first(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks for, repeats as rows of their own. Null sources are one source; documents without words are taken as often as any."""
    whole = docs.select("doc_id", "source", "text", F.struct("*").alias("_doc"))
    mixed = mixture.mix(whole, word_count(F.col("text")), keep=("_doc",))
    return mixed.where("copies > 0").select("_doc", F.explode(F.sequence(F.lit(1), "copies"))).select("_doc.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents' pieces, packed into sequences of 1024 tokens; a null text is one token. Each stage gives an empty table for an empty one, and carries further columns, whatever their names, up to here."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("best_fit_packing", best_fit_packing),
]

#: A learnt model, hashed signatures and a tokenizer are beyond SQL; the tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}

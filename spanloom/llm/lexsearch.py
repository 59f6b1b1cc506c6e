"""Ranked lexical search: the best documents of each item, by two trees whose nodes hold coordinate maxima."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, new_path

#: A-Z become a-z; other bytes that are no letter, digit or part of a non-ASCII character become spaces.
TABLE = bytes(c if c >= 128 or chr(c).isalnum() and not chr(c).isupper() else c + 32 if chr(c).isupper() else 32 for c in range(256))
#: Documents of a leaf, leaves of a branch, items of a group; documents and items that are compared at a time.
LEAF, BRANCH, GROUP, SLICE, BLOCK, BLOCK_BYTES = 32, 16, 8, 4096, 512, 2 << 20
VECTORS = "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>"
FOUND = "item int, doc_id bigint, score bigint"


def terms_of(text: str | None) -> list[bytes]:
    """A text's terms; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split() if text else []


def _runs(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal neighbours."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, "int64")


def exact_sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers by place, in 64 bits: two sums of halves, each exact in doubles."""
    low, high = values & (1 << 26) - 1, values >> 26
    return np.bincount(at, low, n).astype("int64") + (np.bincount(at, high, n).astype("int64") << 26)


@dataclass
class Postings:
    """For each term the rows (items or groups of them) that have it, with their values."""

    starts: np.ndarray
    rows: np.ndarray
    values: np.ndarray
    n: int

    @classmethod
    def of(cls, row: np.ndarray, term: np.ndarray, value: np.ndarray, n: int, n_terms: int) -> Postings:
        """Of several values for one row and term the largest counts."""
        order = np.lexsort((row, term))
        row, term, value = row[order], term[order], value[order]
        first = _runs(term * n + row)
        value = np.maximum.reduceat(value, first) if len(first) else value
        return cls(np.searchsorted(term[first], np.arange(n_terms + 1)), row[first], value, n)

    def products(self, owner: np.ndarray, term: np.ndarray, value: np.ndarray, n_owners: int) -> np.ndarray:
        """The matrix of inner products of owners' vectors (owner, term, value) with these rows."""
        lengths = self.starts[term + 1] - self.starts[term]
        total = int(lengths.sum())
        at = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(self.starts[term], lengths)
        place = np.repeat(owner, lengths) * self.n + self.rows[at]
        return exact_sums(place, np.repeat(value, lengths) * self.values[at], n_owners * self.n).reshape(n_owners, self.n)


@dataclass
class Items:
    """A block of items as a tree: the root, groups of items with alike heaviest terms, items. Nodes hold the largest value of each term below them."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    vectors: list[list[tuple[int, int]]] = field(default_factory=list)

    def add(self, text: str | None) -> None:
        self.vectors.append([(self.vocabulary.setdefault(t, len(self.vocabulary)), c) for t, c in Counter(terms_of(text)).items()])

    def tree(self, weights: np.ndarray) -> tuple[Postings, Postings, Postings, np.ndarray]:
        """Postings of items, groups and the root, and each item's group, once the terms' weights are known."""
        row = np.array([i for i, v in enumerate(self.vectors) for _ in v], "int64")
        term = np.array([t for v in self.vectors for t, _ in v], "int64")
        value = weights[term] * np.array([c for v in self.vectors for _, c in v], "int64")
        n, n_terms = len(self.vectors), len(self.vocabulary)
        heavy = np.zeros(n, "int64")
        order = np.lexsort((value, row))
        heavy[row[order]] = term[order]  # the last one of each item stays
        group = np.empty(n, "int64")
        group[np.argsort(heavy, kind="stable")] = np.arange(n) // GROUP
        groups = int(group.max()) + 1 if n else 0
        return Postings.of(row, term, value, n, n_terms), Postings.of(group[row], term, value, groups, n_terms), Postings.of(np.zeros_like(row), term, value, 1, n_terms), group


def vectors(docs: DataFrame, items: Items) -> DataFrame:
    """doc_id, n (all terms), terms and tfs (those of the items' vocabulary) of the documents that have a term. Whole texts are read, once."""
    numbers = items.vocabulary

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = terms_of(text)
                if found:
                    held = Counter(filter(numbers.__contains__, found))
                    rows.append((doc, len(found), [numbers[t] for t in held], list(held.values())))
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int32())), pa.array(cols[3], pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(read, VECTORS)


class Best:
    """The k best documents so far of each item of a block, by score, then doc_id with null last."""

    def __init__(self, n: int, k: int):
        self.k, self.weakest = k, np.ones(n, "int64")
        self.item, self.doc, self.score, self.null = (np.empty(0, t) for t in ("int64", "int64", "int64", "bool"))

    def offer(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray, null: np.ndarray) -> None:
        item, doc, score, null = (np.concatenate(x) for x in ((self.item, item), (self.doc, doc), (self.score, score), (self.null, null)))
        order = np.lexsort((doc, null, -score, item))
        first = _runs(item[order])
        place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        kept = order[place < self.k]
        self.item, self.doc, self.score, self.null = item[kept], doc[kept], score[kept], null[kept]
        last = order[place == self.k - 1]
        self.weakest[item[last]] = score[last]


def _maxima(owner: np.ndarray, term: np.ndarray, value: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of vectors (owner, term, value) the largest value of each owner and term."""
    key = owner * n_terms + term
    order = np.argsort(key, kind="stable")
    first = _runs(key[order])
    if not len(first):
        return owner, term, value
    return key[order][first] // n_terms, key[order][first] % n_terms, np.maximum.reduceat(value[order], first)


def search_slice(best: Best, tree: tuple, docs: np.ndarray, null: np.ndarray, ptr: np.ndarray, term: np.ndarray, value: np.ndarray, n_terms: int) -> int:
    """Offers to `best` all documents of a slice that can matter; gives the number of documents compared.

    Documents with alike heaviest terms form leaves, leaves form branches, each with its coordinates' maxima. From the top down a pair of
    nodes is left out if its bound is below the weakest kth score of all items below it: no document there can enter, as equal
    scores are still compared. The leaves with the best bound of an item come first, to raise the scores that the others must reach.
    """
    items, groups, root, group = tree
    owner = np.repeat(np.arange(len(docs)), np.diff(ptr))
    largest = np.zeros(n_terms, "int64")
    largest[np.diff(root.starts) > 0] = root.values
    top = largest[term] * value
    heavy = np.zeros(len(docs), "int64")
    order = np.lexsort((top, owner))
    heavy[owner[order]] = term[order]
    place = np.empty(len(docs), "int64")
    place[np.argsort(heavy, kind="stable")] = np.arange(len(docs))
    leaf_of = place // LEAF
    n_leaves = int(leaf_of.max()) + 1
    n_branches = (n_leaves - 1) // BRANCH + 1
    leaves = _maxima(leaf_of[owner], term, value, n_terms)
    branches = _maxima(leaves[0] // BRANCH, leaves[1], leaves[2], n_terms)
    compared = 0

    def group_weakest() -> np.ndarray:
        out = np.full(groups.n, np.iinfo("int64").max)
        np.minimum.at(out, group, best.weakest)
        return out

    def evaluate(wanted: np.ndarray) -> None:
        """wanted: leaves by items."""
        nonlocal compared
        some = wanted.any(axis=1)[leaf_of]
        compared += int(some.sum())
        renumber = np.cumsum(some) - 1
        mine = some[owner]
        scores = items.products(renumber[owner[mine]], term[mine], value[mine], int(some.sum()))
        d, i = np.nonzero((scores >= best.weakest) & wanted[leaf_of[some]])
        at = np.flatnonzero(some)[d]
        best.offer(i, docs[at], scores[d, i], null[at])

    open_branches = (root.products(*branches, n_branches)[:, 0] >= best.weakest.min())
    pairs = open_branches[:, None] & (groups.products(*branches, n_branches) >= group_weakest())
    live = pairs.any(axis=1)[leaves[0] // BRANCH]
    bounds = items.products(leaves[0][live], leaves[1][live], leaves[2][live], n_leaves)
    allowed = pairs[np.arange(n_leaves) // BRANCH][:, group]
    first = np.zeros_like(allowed)
    first[bounds.argmax(axis=0), np.arange(items.n)] = True
    first &= allowed & (bounds >= best.weakest)
    if first.any():
        evaluate(first)
    rest = allowed & (bounds >= best.weakest) & ~first
    if rest.any():
        evaluate(rest)
    return compared


def search_block(docs: DataFrame, items: Items, k: int, space: Scratch) -> DataFrame | None:
    """item (its number in the block), doc_id, score: each task's k best documents of each item; None where nothing can be found."""
    found = space.write(vectors(docs, items), "vectors")
    n_docs, n_all = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    counts = found.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()  # at most the block's vocabulary
    weights = np.zeros(len(items.vocabulary), "int64")
    for t, df in counts:
        weights[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    if not counts:
        return None
    tree, n_items, n_terms = items.tree(weights), len(items.vectors), len(items.vocabulary)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(n_items, k)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                ids, n, lists, tfs = part.columns
                null = np.asarray(ids.is_null())
                docs_ = np.asarray(ids.fill_null(0))
                ptr = np.asarray(lists.offsets).astype("int64")
                ptr = ptr - ptr[0]
                term, tf = np.asarray(lists.flatten()).astype("int64"), np.asarray(tfs.flatten())
                lengths, back = np.unique(np.asarray(n), return_inverse=True)
                m = np.array([25 + 75 * int(x) * n_docs // n_all for x in lengths], "int64")[back]
                value = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, np.diff(ptr)))
                if len(term):
                    search_slice(best, tree, docs_, null, ptr, term, value, n_terms)
        yield pa.record_batch([pa.array(best.item.astype("int32")), pa.array(best.doc, mask=best.null), pa.array(best.score)], names=["item", "doc_id", "score"])

    return found.where(F.size("terms") > 0).mapInArrow(search, FOUND)


def rank(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents (doc_id, text) of each item (item_id, text) with a score above 0, equal scores by doc_id, null last.

    Items are dealt to blocks of about BLOCK items and BLOCK_BYTES of text by a hash, and each block is searched in one reading
    of the texts. Null and empty texts have no terms: as documents they don't count, as items they find nothing. Each row of docs ranks for
    itself, repeated ones too; rows of items with equal ids and texts are one item; equal ids with other texts are ranked each for itself. Other
    columns are ignored; empty tables give an empty result.
    """
    spark = docs.sparkSession
    asked = items.select("item_id", "text").where(F.col("text").isNotNull()).distinct()
    n, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK), -(-size // BLOCK_BYTES))
    parts, path = 0, new_path(spark, "search")
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        block = Items()
        for r in rows:
            block.add(r["text"])
        space = Scratch(spark, "search-block")
        out = search_block(docs, block, k, space) if block.vocabulary else None
        if out is None:
            space.clear()
            continue
        ids = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], "item int, item_id bigint")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        ranked.join(ids, "item").select("item_id", "rank", "doc_id", "score").write.mode("append").parquet(path)
        space.clear()
        parts += 1
    schema = "item_id bigint, rank int, doc_id bigint, score bigint"
    return spark.read.schema(schema).parquet(path) if parts else spark.createDataFrame([], schema)

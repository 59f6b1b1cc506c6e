"""Phrase collocations from a weighted de Bruijn graph of words.

Edges are grams of three words, from the node of their first two words to the node of their last two. Each position of a
piece gives its longest gram: three words, or two at the end; a piece of one word gives that. So a node's occurrences are the
weights of its edges plus how often it ends a piece, and a word's those of the nodes that it begins plus how often it stands
last, as the nodes that end pieces tell, or alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, materialize

#: Pieces end at these; A-Z become a-z; a tab is a space.
BREAKS = b".,;:!?\n\x0b\x0c\r"
TABLE = bytes(10 if c in BREAKS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Words that a task holds before it gives out their grams.
CHUNK = 4_000_000
#: Three numbers of words below 2 ** PACK_BITS are counted as one.
PACK_BITS = 21
GRAMS = pa.schema([("lang", pa.string()), ("node", pa.string()), ("last", pa.string()), ("n", pa.int64())])


def _grams(lang: str, words: list[bytes], ids: np.ndarray) -> pa.RecordBatch:
    """The distinct longest grams of a run of word numbers (0: a piece ends) with their counts; a piece's last word gives none unless it stands alone."""
    a, b, c = ids, np.append(ids[1:], 0), np.append(ids[2:], [0, 0])[: len(ids)]
    c = np.where(b == 0, 0, c)
    first = np.append(0, ids[:-1]) == 0
    a, b, c = (x[(ids > 0) & ((b > 0) | first)] for x in (a, b, c))
    if len(words) < 1 << PACK_BITS:
        keys, n = np.unique(a << 2 * PACK_BITS | b << PACK_BITS | c, return_counts=True)
        low = (1 << PACK_BITS) - 1
        a, b, c = keys >> 2 * PACK_BITS, keys >> PACK_BITS & low, keys & low
    else:
        pairs, at = np.unique(a * len(words) + b, return_inverse=True)
        keys, n = np.unique(at * len(words) + c, return_counts=True)
        pairs, c = pairs[keys // len(words)], keys % len(words)
        a, b = pairs // len(words), pairs % len(words)
    text = pa.array(words, pa.binary()).cast(pa.string())
    some = lambda x: text.take(pa.array(np.where(x > 0, x, 0), mask=x == 0))
    node = pc.binary_join_element_wise(some(a), some(b), " ", null_handling="skip")
    return pa.record_batch([pa.array([lang] * len(n), pa.string()), node, some(c), pa.array(n.astype("int64"))], schema=GRAMS)


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams of texts (lang, text), added up for CHUNK words at a time."""
    held: dict[str, tuple[dict, list]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, (numbers, parts) in held.items():
            out = _grams(lang, list(numbers), np.concatenate(parts))
            for at in range(0, out.num_rows, 65_536):
                yield out.slice(at, 65_536)
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not text:
                continue
            if lang not in held:
                numbers: dict = {}
                numbers[b"\n"] = 0
                held[lang] = (numbers, [])
            numbers, parts = held[lang]
            tokens = list(filter(None, (text.encode("utf-8", "surrogatepass").translate(TABLE) + b"\n").replace(b"\n", b" \n ").split(b" ")))
            fresh = count(len(numbers))
            for t in dict.fromkeys(tokens):
                if t not in numbers:
                    numbers[t] = next(fresh)
            parts.append(np.fromiter(map(numbers.__getitem__, tokens), "int64", len(tokens)))
            size += len(tokens)
            if size >= CHUNK:
                yield from flush()
                size = 0
    yield from flush()


def graph(docs: DataFrame, least: int) -> DataFrame:
    """A written table of docs (lang, text; a null lang is `und`): lang, node (two words, or one that is a piece), flow (the node's occurrences), is_node (true on one row a node), last, n (the edge to the word `last` and its weight; last is null for a piece's end).

    Grams are added up in tasks first, then dealt by their node, so a node's edges meet: a frequent pair has at most one row a following word and chunk of a task. All nodes are kept, the rows of those that end pieces being their ends, and of the other edges those that weigh `least` or more.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").alias("text"))
    grams = texts.mapInArrow(count_grams, "lang string, node string, last string, n bigint")
    dealt = grams.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "lang", "node")
    # one sort by lang, node, last, n serves all four
    edge = Window.partitionBy("lang", "node", "last").orderBy("n")
    node = Window.partitionBy("lang", "node").orderBy("last")
    whole = (Window.unboundedPreceding, Window.unboundedFollowing)
    rows = dealt.withColumns({"w": F.sum("n").over(edge.rowsBetween(*whole)), "e": F.row_number().over(edge)}).where("e = 1")
    rows = rows.withColumns({"flow": F.sum("w").over(node.rowsBetween(*whole)), "r": F.row_number().over(node)})
    return rows.select("lang", "node", "flow", (F.col("r") == 1).alias("is_node"), "last", F.col("w").alias("n")).where((F.col("r") == 1) | (F.col("n") >= least))


def _head(phrase: str) -> Column:
    return F.substring_index(phrase, " ", 1)


def _two(phrase: str = "node") -> Column:
    return F.instr(phrase, " ") > 0


def compacted(edges: DataFrame, space: Scratch) -> DataFrame:
    """lang, words, n, from_flow (of the path's first node), to (its last node): unary paths of edges (lang, node, last, n, flow), each as one row.

    An edge goes on in another where its end node has no other edges and neither begins nor ends a piece: both weights equal the node's flow.
    So all edges of a path weigh the same, and every occurrence of its first edge lies in one piece with the rest: a path is no
    longer than a piece. Heads are found by pointer doubling over a written table, in as many rounds as the logarithm of the longest path;
    edges of a ring would have no head and stay paths of their own (but some piece begins in every ring, so none is unary).
    """
    to = F.concat(F.substring_index("node", " ", -1), F.lit(" "), F.col("last")).alias("to")
    flows = edges.groupBy(F.col("lang").alias("l"), F.col("node").alias("v")).agg(F.max("flow").alias("out_flow"), F.max("n").alias("out_n"))
    rows = edges.select("lang", "node", "last", "n", "flow", to)
    ends = rows.join(flows, (F.col("lang") == F.col("l")) & (F.col("to") == F.col("v")), "left").drop("l", "v")
    ends = space.write(ends.withColumn("on", F.coalesce((F.col("n") == F.col("out_flow")) & (F.col("n") == F.col("out_n")), F.lit(False))), "ends")
    before = ends.where("on").select(F.col("lang").alias("l"), F.col("to").alias("v"), F.struct("node", "last").alias("up"))
    linked = ends.join(before, (F.col("lang") == F.col("l")) & (F.col("node") == F.col("v")), "left")
    own = F.struct("node", "last")
    heads = space.write(linked.select("lang", own.alias("id"), F.coalesce("up", own).alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).alias("d"), F.col("up").isNull().alias("done")), "links")
    left = heads.where("not done").count()
    while left:
        above = heads.select(F.col("lang").alias("l"), F.col("id").alias("v"), F.col("up").alias("up2"), F.col("d").alias("d2"), F.col("done").alias("done2"))
        step = heads.join(above, (F.col("lang") == F.col("l")) & (F.col("up") == F.col("v")))
        heads = space.write(step.select("lang", "id", F.when(F.col("done"), F.col("up")).otherwise(F.col("up2")).alias("up"), F.when(F.col("done"), F.col("d")).otherwise(F.col("d") + F.col("d2")).alias("d"), (F.col("done") | F.col("done2")).alias("done")), "links")
        before_, left = left, heads.where("not done").count()
        if left == before_:  # only rings
            break
    at = heads.select(F.col("lang").alias("l"), F.col("id.node").alias("v"), F.col("id.last").alias("w"), F.when(F.col("done"), F.col("up")).otherwise(F.col("id")).alias("head"), F.when(F.col("done"), F.col("d")).otherwise(0).alias("d"))
    placed = ends.join(at, (F.col("lang") == F.col("l")) & (F.col("node") == F.col("v")) & (F.col("last") == F.col("w")))
    paths = placed.groupBy("lang", "head").agg(F.array_sort(F.collect_list(F.struct("d", "last"))).alias("rest"), F.first("n").alias("n"), F.min_by("flow", "d").alias("from_flow"), F.max_by("to", "d").alias("to"))
    words = F.concat(F.split("head.node", " "), F.transform("rest", lambda x: x["last"]))
    return space.write(paths.select("lang", words.alias("words"), "n", "from_flow", "to"), "paths")


def _score(a: Column, l: Column, r: Column) -> Column:
    """floor(1000000 a a / (l r)), exactly."""
    d = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", (d(a) * d(a)).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)"), (d(l) * d(r)).cast("decimal(38,0)"))


def phrases(docs: DataFrame, least: int = 10, cover: int = 50, most: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `most` best phrases of two or three words.

    a, l and r are the occurrences of the phrase and of the parts of its lowest-scoring cut (ties: the first), n all words of the
    language; phrases occur `least` times or more. One that a longer phrase with `cover` percent of its occurrences holds is dropped. The order is score,
    a (both descending), phrase by bytes. Null and empty texts have no words, a null language is `und`, repeated rows count as often as they
    stand there, other columns are ignored, and an empty table gives an empty result. A single word or text may be of any length.
    """
    space = Scratch(docs.sparkSession, "collocations")
    g = space.write(graph(docs, least), "graph")
    edges = g.where((F.col("n") >= least) & F.col("last").isNotNull()).select("lang", "node", "last", "n", "flow")
    pairs = space.write(g.where(F.col("is_node") & _two() & (F.col("flow") >= least)).select("lang", "node", "flow"), "pairs")
    begun = F.struct(_head("node").alias("word"), F.col("flow").alias("f"))
    ended = F.when(F.col("last").isNull() & _two(), F.struct(F.substring_index("node", " ", -1).alias("word"), F.col("n").alias("f")))
    words = space.write(g.where("is_node").select("lang", F.inline(F.array_compact(F.array(begun, ended)))).groupBy("lang", "word").agg(F.sum("f").alias("f")), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n_words"))
    paths = compacted(edges, space)

    def word(name: str) -> DataFrame:
        return words.where(F.col("f") >= least).select("lang", F.col("word").alias(name), F.col("f").alias(f"f_{name}"))

    known = space.write(pairs.select("lang", "node", "flow", _head("node").alias("x"), F.substring_index("node", " ", -1).alias("y")).join(word("x"), ["lang", "x"]).join(word("y"), ["lang", "y"]), "known-pairs")
    # inner nodes of a path flow as its edges weigh; only the two ends are looked up
    k = F.size("words") - 2
    triples = paths.select("lang", "n", "from_flow", "to", k.alias("k"), F.explode(F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.struct(i.alias("i"), F.get("words", i).alias("x"), F.get("words", i + 1).alias("y"), F.get("words", i + 2).alias("z")))).alias("t")).select("lang", "n", "from_flow", "to", "k", "t.*")
    ends = pairs.select("lang", F.col("node").alias("to"), F.col("flow").alias("to_flow"))
    triples = triples.join(ends, ["lang", "to"]).join(word("x"), ["lang", "x"]).join(word("z"), ["lang", "z"])
    xy = F.when(F.col("i") == 0, F.col("from_flow")).otherwise(F.col("n"))
    yz = F.when(F.col("i") == F.col("k") - 1, F.col("to_flow")).otherwise(F.col("n"))
    a = F.col("n")
    cut = lambda l, r: F.struct(_score(a, l, r).alias("score"), l.alias("l"), r.alias("r"))
    cuts = F.array(cut(F.col("f_x"), yz), cut(xy, F.col("f_z")))
    best = F.when(cuts[0]["score"] <= cuts[1]["score"], cuts[0]).otherwise(cuts[1])
    three = space.write(triples.select("lang", F.concat_ws(" ", "x", "y", "z").alias("phrase"), a.alias("a"), best.alias("b")), "triples")
    first, last = F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2)
    longer = three.select("lang", "a", F.explode(F.array(first, last)).alias("node")).groupBy("lang", "node").agg(F.max("a").alias("longer"))
    free = known.join(longer, ["lang", "node"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("flow")))
    two = free.select("lang", F.col("node").alias("phrase"), F.col("flow").alias("a"), F.struct(_score(F.col("flow"), F.col("f_x"), F.col("f_y")).alias("score"), F.col("f_x").alias("l"), F.col("f_y").alias("r")).alias("b"))
    found = two.unionByName(three).select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    # the best of each part of a language first: no task sorts all phrases of a language
    order = (F.desc("score"), F.desc("a"), "phrase")
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    few = found.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= most).drop("_r")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    out = materialize(ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("n_words").alias("n"), "score"), "phrases")
    space.clear()
    return out


def long_phrases(docs: DataFrame, least: int = 10) -> DataFrame:
    """lang, words, n: the maximal phrases of three words or more that the compacted graph holds: each stretch that its pieces always pass as a whole, and n times."""
    space = Scratch(docs.sparkSession, "long-phrases")
    edges = graph(docs, least).where((F.col("n") >= least) & F.col("last").isNotNull()).select("lang", "node", "last", "n", "flow")
    out = materialize(compacted(space.write(edges, "edges"), space).select("lang", "words", "n"), "long-phrases")
    space.clear()
    return out

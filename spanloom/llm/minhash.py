"""Near-duplicate documents: banded MinHash, sequential Bayesian pruning, exact verification, components.

Every step works on *classes*: texts with the same set of shingles are one class, so that copies are never
compared with each other. Candidates are the classes that share a band. A band's bucket is tried as a star around one
pivot, then around another for the members that are not yet in its component, and so on while that helps. At last, small
buckets that still hold several components are tried pair by pair, and the members of large ones are written as
*differences* from a set at their centre. With m shingles of the centre missing and a others added, a member costs
100 m + t a, for a threshold of t percent. Two members are linked if and only if (100 + t) times their common differences
is at least the sum of their costs less (100 - t) times the centre's size. So members far from the centre must have about
half of their differences in common, and an inverted list over each member's rarest differences finds all such pairs:
exactly, and without trying the pairs within a bucket. No link between components is lost.
Candidate pairs go through two sieves: their signatures are compared batch by batch until the posterior
probability of reaching the threshold falls below the chosen miss probability, and the survivors' whole sets
are intersected.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ASCII_LOWER, WORD_RE, Scratch, materialize

Write = Callable[[DataFrame, str], DataFrame]

ROWS, BANDS, BATCH = 6, 40, 24
#: Shingles hashed at a time, so that a block stays in the processor's cache.
BLOCK = 1 << 15
#: Sets that are held at once for one pivot.
CHUNK = 64
#: Whole sets or documents in a bucket, about, where they are more than a shuffle's partitions can hold.
PER_BUCKET = 4000
#: Turns of stars before what is left in mixed buckets is tried by pairs or by differences.
MOST_TURNS = 3
#: Members of a bucket up to which its pairs are tried one by one.
SMALL = 8
PIVOT_SEEDS = (0, 0x2545F4914F6CDD1D, 0x5851F42D4C957F2D, 0x14057B7EF767814F, 0x369DEA0F31A53F85, 0x27BB2EE687B0B0FD, 0x61C8864680B583EB, 0x106689D45497FDB5)


#: The chance that the sieve loses a link.
MISS = 1e-6
#: A row's key, 128 bits.
KEY = ("rid", "rid2")

#: Links of one text from which they are dealt to many tasks when components are formed.
HUB = 50_000


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes; a text with fewer words is one shingle, one without words none."""
    words = [WORD_RE.findall(t.translate(ASCII_LOWER)) if t else [] for t in texts]
    flat = np.array([w for ws in words for w in ws], dtype=object)
    hashes = pd.util.hash_array(flat, categorize=False) if len(flat) else np.empty(0, np.uint64)
    out, at = [], 0
    for ws in words:
        h, n = hashes[at : at + len(ws)], len(ws)
        at += n
        out.append(np.unique(_roll(h, min(n, size))) if n else np.empty(0, np.uint64))
    return out


def _roll(h: np.ndarray, size: int) -> np.ndarray:
    x = np.full(len(h) - size + 1, 0x9E3779B97F4A7C15 + size, np.uint64)
    for i in range(size):
        x = (x ^ h[i : len(h) - size + 1 + i]) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


def _multipliers() -> np.ndarray:
    return np.random.default_rng(20240607).integers(1, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ROWS * BANDS minima for each set; sets must not be empty."""
    a, out, i = _multipliers(), np.empty((len(sets), ROWS * BANDS), np.uint64), 0
    while i < len(sets):
        j, total = i, 0
        while j < len(sets) and (j == i or total + len(sets[j]) <= BLOCK):
            total += len(sets[j])
            j += 1
        block = np.concatenate(sets[i:j])
        starts = np.cumsum([0, *map(len, sets[i : j - 1])])
        product = np.empty_like(block)
        for k in range(len(a)):
            np.multiply(block, a[k], out=product)
            out[i:j, k] = np.minimum.reduceat(product, starts)
        i = j
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band; the three lowest bits name the band's pivot seed."""
    keys = np.empty((len(sig), BANDS), np.uint64)
    for b in range(BANDS):
        x = np.full(len(sig), 0xA0761D6478BD642F * (b + 1) & (1 << 64) - 1, np.uint64)
        for r in range(ROWS):
            x = (x ^ sig[:, b * ROWS + r]) * np.uint64(0xE7037ED1A0B428DB)
            x ^= x >> np.uint64(29)
        keys[:, b] = x & ~np.uint64(7) | np.uint64(b % len(PIVOT_SEEDS))
    return keys.view(np.int64)


def fingerprint(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def least_matches(threshold: float, miss: float) -> list[tuple[int, int]]:
    """(hashes compared, least matches to go on). With a uniform prior, the posterior chance that a hash byte matches at the threshold's rate or more, after m of n matches, is P(Bin(n + 1, rate) <= m)."""
    rate, out = threshold + (1 - threshold) / 256, []
    stops = list(range(BATCH, ROWS * BANDS + 1, BATCH))
    for n in stops:
        tail, m = 0.0, -1
        while m < n and tail < miss / len(stops):
            m += 1
            tail += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(rate) + (n + 1 - m) * math.log1p(-rate))
        out.append((n, m))
    return out


def _sketch(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                part = pdf.iloc[at : at + 512]
                sets = shingle_sets([t if isinstance(t, str) else None for t in part["text"]], size)
                full = [i for i, s in enumerate(sets) if len(s)]
                sig = signatures([sets[i] for i in full])
                keys, low = band_keys(sig), (sig >> np.uint64(56)).astype(np.uint8) ^ (sig >> np.uint64(24)).astype(np.uint8)
                bits = np.packbits(((sig[:, :64] >> np.uint64(17)) & np.uint64(1)).astype(np.uint8), axis=1).view(">i8")[:, 0] if full else []
                cols = {c: [None] * len(sets) for c in ("fp", "sig", "bands", "bits")}
                for k, i in enumerate(full):
                    cols["fp"][i], cols["sig"][i], cols["bands"][i], cols["bits"][i] = fingerprint(sets[i]), low[k].tobytes(), keys[k].tolist(), int(bits[k])
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "rid": part["rid"], "rid2": part["rid2"], "n": [len(s) for s in sets], **cols, "bits": pd.array(cols["bits"], dtype="Int64")})

    return run


def keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, rid, rid2 and text of docs, and more."""
    doc_id, text = docs["doc_id"], docs["text"]
    return docs.select(doc_id.cast("long").alias("doc_id"), F.xxhash64(doc_id, text).alias("rid"), F.xxhash64(text, doc_id).alias("rid2"), text.alias("text"), *more)


def sketch(rows: DataFrame, size: int) -> DataFrame:
    """For rows as of keyed: doc_id, rid, rid2, n (size of the set), and for texts with words fp, sig, bands, bits."""
    return rows.select("doc_id", *KEY, "text").mapInPandas(_sketch(size), "doc_id long, rid long, rid2 long, n long, fp binary, sig binary, bands array<long>, bits long")


def _sieve(threshold: float, miss: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stops = least_matches(threshold, miss)
        for pdf in batches:
            if not len(pdf):
                continue
            x, y = (np.frombuffer(b"".join(pdf[c]), np.uint8).reshape(len(pdf), -1) for c in ("sig_a", "sig_b"))
            live, matches, done = np.arange(len(pdf)), np.zeros(len(pdf), np.int32), 0
            for n, least in stops:
                matches[live] += (x[live, done:n] == y[live, done:n]).sum(axis=1, dtype=np.int32)
                live, done = live[matches[live] >= least], n
            yield pd.DataFrame({"a": pdf["a"].to_numpy()[live], "b": pdf["b"].to_numpy()[live], "matches": matches[live]})

    return run


def bayes_prune(pairs: DataFrame, classes: DataFrame, threshold: float, miss: float) -> DataFrame:
    """Of pairs (a, b) of class ids, those whose signatures leave the threshold likely enough, with their matches."""
    side = lambda c: classes.select(F.col("cid").alias(c), F.col("sig").alias(f"sig_{c}"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").mapInPandas(_sieve(threshold, miss), "a long, b long, matches int")


def _sets(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                part = pdf.iloc[at : at + 512]
                part = part[~part["cid"].isin(seen)].drop_duplicates("cid") if part["cid"].isin(seen).any() or part["cid"].duplicated().any() else part
                sets = shingle_sets(part["text"].tolist(), size)
                # rows of which the key met by chance have another fingerprint
                keep = [i for i, (s, fp) in enumerate(zip(sets, part["fp"], strict=True)) if fingerprint(s) == bytes(fp)]
                found = part["cid"].to_numpy()[keep]
                seen.update(found.tolist())
                yield pd.DataFrame({"cid": found, "words": [sets[i].tobytes() for i in keep]})

    return run


def whole_sets(rows: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """cid, words (the whole set) for the classes in wanted (cid, rid, rid2, fp), from rows as of keyed. Of repeated rows a task gives one. Texts are dealt by their rows' keys, once and at every size, as no bound holds for the classes; rows in buckets by key stay where they lie."""
    return rows.select(*KEY, "text").join(wanted.hint("merge"), [*KEY]).select("cid", "fp", "text").mapInPandas(_sets(size), "cid long, words binary")


def _intersect(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, out = int(pdf["a"].iloc[0]), []
        pivot = pdf.loc[pdf["cid"] == a, "words"]
        if len(pivot):
            x = np.frombuffer(pivot.iloc[0], np.uint64)
            for b, words in zip(pdf["cid"], pdf["words"], strict=True):
                if b != a:
                    y = np.frombuffer(words, np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        out.append(b)
        return pd.DataFrame({"a": np.full(len(out), a, np.int64), "b": np.array(out, np.int64)})

    return run


def _around(pairs: DataFrame, sets: DataFrame, compare, schema: str) -> DataFrame:
    """`compare` over the whole sets of pairs (a, b), grouped by pivot a. A pivot's set is sent once for every CHUNK of its partners."""
    pairs = pairs.select("a", "b")
    chunks = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    dealt = pairs.join(chunks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("chunks")).alias("chunk"))
    members = dealt.select("a", "chunk", F.col("b").alias("cid"))
    pivots = chunks.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.col("a").alias("cid"))
    return members.unionByName(pivots).join(sets, "cid").groupBy("a", "chunk").applyInPandas(compare, schema)


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose whole sets meet the threshold; of repeated rows, a pair may come again."""
    return _around(pairs, sets, _intersect(percent), "a long, b long")


def _differences(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, out = int(pdf["a"].iloc[0]), []
        pivot = pdf.loc[pdf["cid"] == a, "words"]
        if len(pivot):
            x = np.frombuffer(pivot.iloc[0], np.uint64)
            # a centre or member met twice, as repeated rows can do, gives equal rows
            for b, words in {b: w for b, w in zip(pdf["cid"], pdf["words"], strict=True) if b != a}.items():
                y = np.frombuffer(words, np.uint64)
                lost, new = np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)
                out.append((a, b, (100 - percent) * len(x), 100 * len(lost) + percent * len(new), np.concatenate([lost, new]).view(np.int64)))
        return pd.DataFrame(out, columns=["ref", "cid", "slack", "cost", "d"])

    return run


def _by_differences(labelled: DataFrame, large: DataFrame, links: DataFrame, sets: DataFrame, percent: int, write: Write) -> tuple[DataFrame, DataFrame]:
    """(links with centres, pairs (a, b) that may be links) for the buckets in `large` (key). A bucket's centre is the class with most links in its largest component."""
    counts = labelled.join(large, "key").groupBy("key", "root").agg(F.count("*").alias("m"))
    largest = counts.groupBy("key").agg(F.max_by("root", F.struct("m", -F.col("root"))).alias("main"))
    inside = labelled.select(F.col("cid").alias("a"), "root").distinct()
    hubs = links.groupBy("a").count().join(inside, "a").groupBy(F.col("root").alias("main")).agg(F.max_by("a", F.struct("count", "a")).alias("hub"))
    centres = largest.join(hubs, "main", "left").select("key", F.coalesce("hub", "main").alias("ref"))
    around = write(labelled.join(centres, "key").select("ref", "cid", "root", "n").distinct().where("ref <> cid"), "around")

    found = write(_around(around.select(F.col("ref").alias("a"), F.col("cid").alias("b")), sets, _differences(percent), "ref long, cid long, slack long, cost long, d array<long>"), "differences")
    linked = found.where("cost <= slack").select(F.col("ref").alias("a"), F.col("cid").alias("b"))

    each = found.select("ref", "cid", F.explode("d").alias("e"))
    often = each.groupBy("ref", "e").count().where("count > 1")
    rarest = each.join(often, ["ref", "e"]).withColumn("rank", F.row_number().over(Window.partitionBy("ref", "cid").orderBy(F.desc("count"), "e")))
    # ranks count from the commonest difference, so those met once need no row; a pair that needs k differences in common shares one of rank k or more, in both
    own = found.select("ref", "cid", "slack", "cost", (F.col("cost") > F.col("slack")).alias("far")).join(around, ["ref", "cid"])
    least = F.when(F.col("far"), F.col("cost") + 1 - F.col("slack")).otherwise(F.col("cost") + 1)
    listed = write(rarest.join(own, ["ref", "cid"]).where(F.col("rank") * (100 + percent) >= least).drop("count"), "listed")
    x, y = listed.where("far").alias("x"), listed.alias("y")
    need = F.col("x.cost") + F.col("y.cost") - F.col("x.slack")
    on = (F.col("x.ref") == F.col("y.ref")) & (F.col("x.e") == F.col("y.e")) & (F.col("x.root") != F.col("y.root")) & (~F.col("y.far") | (F.col("x.cid") < F.col("y.cid")))
    deep = F.least("x.rank", "y.rank") * (100 + percent) >= need
    close = F.lit(100) * F.least("x.n", "y.n") >= F.lit(percent) * F.greatest("x.n", "y.n")
    return linked, x.join(y, on & deep & close).select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).distinct()


def components(links: DataFrame, write: Write) -> DataFrame:
    """cid, root for every class with a link: the smallest id that can be reached. Edges are turned into stars, towards larger and smaller neighbours by turns, until all are stars; each round is a written table."""
    edges = write(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        done, most = _stars_and_most(edges)
        if done:
            return edges.select(F.col("u").alias("cid"), F.col("v").alias("root"))
        # each edge from both of its ends, in one reading
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        m = F.least("m", "u").alias("v")
        large = _with_least(both, most, write).where("v > u").select(F.col("v").alias("u"), m)
        ends = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
        small = _with_least(large, most, write).select(ends.alias("e")).select("e.*")
        edges = write(small.where("u <> v").distinct(), "edges")


def _with_least(pairs: DataFrame, most: int, write: Write) -> DataFrame:
    """pairs (u, v) with m, the least v of their u. Where one end has over HUB edges, pairs are dealt by u and a part of v, and all that is gathered by u is each part's least."""
    if most <= HUB:
        return pairs.select("u", "v", F.min("v").over(Window.partitionBy("u")).alias("m"))
    dealt = pairs.select("u", "v", F.pmod(F.xxhash64("v"), F.lit(1 + most // HUB)).alias("part"))
    parts = write(dealt.groupBy("u", "part").agg(F.min("v").alias("m")), "parts")
    return dealt.join(parts.select("u", "part").join(parts.groupBy("u").agg(F.min("m").alias("m")), "u"), ["u", "part"])


def _stars_and_most(edges: DataFrame) -> tuple[bool, int]:
    """Whether each upper end has one edge and is no lower end; and the most edges that one end has."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    each = ends.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("low"), F.count("*").alias("n"))
    row = each.agg(F.count_if((F.col("ups") > 1) | (F.col("ups") == 1) & (F.col("low") == 0)).alias("other"), F.max("n").alias("most")).first()
    return not row["other"], row["most"] or 0


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, miss: float = MISS) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_shingles, component_id (the smallest doc_id that links reach), kept.

    Texts are linked if their sets of distinct `size`-word shingles have 100 * intersection >= percent * union.
    Null texts and texts without words have no shingles and no links. Rows with a null doc_id count, but lend no id:
    their component_id is null only if all of the component have none, and they are kept only then. Repeated rows
    get equal results. Other columns are ignored. An empty table gives an empty result. The result is a written table; those on the
    way to it are removed.
    """
    return _of_keyed(keyed(docs), size, percent, miss)


def _of_keyed(rows: DataFrame, size: int, percent: int, miss: float) -> DataFrame:
    scratch = Scratch(rows.sparkSession, "near-duplicates")
    try:
        return materialize(_near_duplicates(rows, size, percent, percent / 100, miss, scratch), "duplicates")
    finally:
        scratch.clear()


def _near_duplicates(texts: DataFrame, size: int, percent: int, threshold: float, miss: float, scratch: Scratch) -> DataFrame:
    write = scratch.write
    rows = write(sketch(texts, size), "sketch")
    full = rows.where("fp is not null")
    by_text = full.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first(F.struct(*KEY)).alias("key"), F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    classes = write(by_text.select("*", "key.*").drop("key").withColumn("cid", F.monotonically_increasing_id()), "classes")

    sized = lambda x, y: F.lit(100) * F.least(x, y) >= F.lit(percent) * F.greatest(x, y)
    # dealt by key once, for the count and for the join
    banded = classes.select("cid", F.explode("bands").alias("key")).repartition("key")
    shared = banded.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    members = write(banded.join(shared, "key").join(classes.select("cid", "n", "bits"), "cid").select("key", "cid", "n", "bits", F.col("cid").alias("root")), "members")
    # from here on, only classes that share a band; their texts are read once
    near = write(classes.select("cid", *KEY, "fp", "sig").join(members.select("cid"), "cid", "left_semi"), "near")
    # the largest table here, and each turn joins it with its pairs: it is dealt by class once, and stays where it lies
    sets = scratch.deal(whole_sets(texts, near.select("cid", *KEY, "fp"), size), "sets", "cid", near.count() // PER_BUCKET)
    links, roots, tried, labelled, before = None, None, None, members, None
    for turn in range(MOST_TURNS):
        stars = _stars(labelled, turn).where(sized(F.col("n_a"), F.col("n_b"))).select("a", "b").distinct()
        stars = stars if tried is None else stars.join(tried, ["a", "b"], "left_anti")
        likely = bayes_prune(stars, near, threshold, miss)
        best = write(likely.groupBy("b").agg(F.max_by("a", F.struct("matches", "a")).alias("a")), "best")
        tried = best.select("a", "b") if tried is None else tried.union(best.select("a", "b"))
        new = write(verify(best, sets, percent), "links")
        links = new if links is None else links.union(new)
        roots = components(new if roots is None else new.union(_stars_of(roots)), write)
        labelled = write(members.drop("root").join(roots, "cid", "left").select("key", "cid", "n", "bits", F.coalesce("root", "cid").alias("root")), "labelled")
        counts = labelled.groupBy("key", "root").agg(F.count("*").alias("m")).groupBy("key").agg(F.sum("m").alias("c"), F.sum(F.col("m") * F.col("m")).alias("same"))
        mixed = write(counts.where("c * c > same").select("key", "c", ((F.col("c") * F.col("c") - F.col("same")) / 2).alias("pairs")), "mixed")
        left, rows_left = mixed.agg(F.coalesce(F.sum("pairs"), F.lit(0)), F.coalesce(F.sum("c"), F.lit(0))).first()
        labelled = write(labelled.join(mixed.select("key"), "key"), "labelled")
        if left <= rows_left or before is not None and left > 0.7 * before:
            break
        before = left

    x, y = (labelled.join(mixed.where(F.col("c") <= SMALL).select("key"), "key").alias(side) for side in "xy")
    far = F.bit_count(F.col("x.bits").bitwiseXOR(F.col("y.bits")))
    on = (F.col("x.key") == F.col("y.key")) & (F.col("x.cid") < F.col("y.cid")) & (F.col("x.root") != F.col("y.root")) & sized(F.col("x.n"), F.col("y.n")) & (far <= _most_bits(threshold, miss))
    small = x.join(y, on).select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"))
    linked, large = _by_differences(labelled, mixed.where(F.col("c") > SMALL).select("key"), links, sets, percent, write)
    tried = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = write(bayes_prune(small.union(large).distinct().join(tried, ["a", "b"], "left_anti"), near, threshold, miss), "rest")
    roots = components(_stars_of(roots).union(linked).union(verify(rest, sets, percent)), write)
    label = F.coalesce("root", "cid").alias("root")

    found = classes.select("cid", "fp", "doc_id").join(roots, "cid", "left").select("cid", "fp", "doc_id", label)
    ids = found.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_fp = found.join(ids, "root").select("fp", "component_id")
    out = rows.select("doc_id", "rid", "rid2", F.col("n").alias("n_shingles"), "fp").join(by_fp, "fp", "left")
    component = F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "rid", "rid2")


def keep_first(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, that near_duplicates keeps: one of each component, and of repeated rows one. Null texts and those without words are kept, with their repeats. An empty table gives an empty result.

    Rows are dealt by key once, at every size, into a table that both the whole sets and the result are joined from where it lies. That table stays, as the result reads it.
    """
    rows = keyed(docs, F.struct(*(docs[c] for c in docs.columns if c != "text")).alias("row"))
    dealt = Scratch(docs.sparkSession, "keep-first").deal(rows, "rows", KEY, docs.count() // PER_BUCKET)
    found = _of_keyed(dealt, size, percent, MISS)
    gone = materialize(found.where(~F.col("kept")).select(*KEY).distinct(), "gone")
    left = dealt.join(gone, [*KEY], "left_anti")
    again = materialize(found.where(F.col("kept") & (F.col("n_shingles") > 0)).groupBy(*KEY).count().where("count > 1").select(*KEY), "repeated")
    if not again.isEmpty():
        left = left.join(again, [*KEY], "left_anti").unionByName(left.join(again, [*KEY], "left_semi").dropDuplicates([*KEY]))
    return left.select(*((F.col("text") if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns))


def _stars_of(roots: DataFrame) -> DataFrame:
    """Components that are known, as links."""
    return roots.select(F.col("root").alias("a"), F.col("cid").alias("b"))


def _stars(labelled: DataFrame, turn: int) -> DataFrame:
    """a (a bucket's pivot), b (a member in another component), n_a, n_b. The pivot is the member whose id is least when exclusive-or mixes it with a seed, which the turn and the key's lowest bits pick."""
    seeds = F.array(*(F.lit((s ^ (turn * 0x9E3779B97F4A7C15)) & (1 << 63) - 1) for s in PIVOT_SEEDS))
    seed = F.element_at(seeds, (F.col("key").bitwiseAND(F.lit(7)) + 1).cast("int"))
    x = F.col("cid").bitwiseXOR(seed)
    pivots = labelled.groupBy("key").agg(F.min_by("cid", x).alias("a"), F.min_by("n", x).alias("n_a"), F.min_by("root", x).alias("root_a"))
    return labelled.join(pivots, "key").where("root <> root_a").select("a", F.col("cid").alias("b"), "n_a", F.col("n").alias("n_b"))


def _most_bits(threshold: float, miss: float) -> int:
    """Of 64 one-bit hashes, the most that may differ: P(Bin(64, (1 - threshold) / 2) > most) is at most the miss probability."""
    p, tail, d = (1 - threshold) / 2, 0.0, 64
    while d > 0 and (tail := tail + math.comb(64, d) * p**d * (1 - p) ** (64 - d)) <= miss:
        d -= 1
    return d

"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Only whole documents are labelled, so tokens get their training labels from a cover: the words and word beginnings that
are common in toxic documents, next to unknown in the others, and together explain the toxic ones. The field then learns
weights of hashed word features and of transitions between two states (clean, toxic). Forward and backward sums are kept
as odds of the toxic state, so that a step over many chains is one line of numpy. A document is one chain, however long.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back

TOKEN = re.compile(r"[^\W_]+")
FEATURE_BITS = 18
BEGINNINGS = (3, 4, 5, 6)
#: Tokens that are stepped through side by side; a document of more is carried from block to block exactly.
BLOCK = 64
#: Words whose emissions a task keeps at hand.
MEMORY = 150_000


def tokens(text: str) -> list[str]:
    """A text's tokens in lower case. Each is lower-cased by itself, as that can change a text's length: so the tokens are those of the text as it stands, in number and place."""
    return list(map(str.lower, TOKEN.findall(text)))


def features(word: str) -> list[int]:
    """Hashed features of a token: a bias, the word, its beginnings and its end."""
    names = [word, word[-3:], *[word[:n] for n in BEGINNINGS]]
    return [0, *[zlib.crc32(x.encode("utf-8", "surrogatepass"), k) & (1 << FEATURE_BITS) - 1 for k, x in enumerate(names, 1)]]


def cover(texts: list[set[str]], toxic: list[int]) -> set[str]:
    """Words ("idiot") and beginnings of four letters or more ("idio*") that explain the toxic documents, given each document's words.

    A candidate occurs in three toxic documents and 0.2 % of them at least, and its share of the clean ones is at most a
    fiftieth of that. The candidate in most unexplained documents is taken (ties: the longest, then by code point) as long as
    there are at least three and 0.2 % of all; then all candidates in a twentieth of the toxic documents are.
    """
    names = [w | {f"{x[:n]}*" for x in w for n in BEGINNINGS if 4 <= n < len(x)} for w in texts]
    bad, good = [n for n, t in zip(names, toxic, strict=True) if t], [n for n, t in zip(names, toxic, strict=True) if not t]
    least = max(3, len(bad) / 500)
    seen = Counter(x for n in bad for x in n)
    held = {x: c for x, c in seen.items() if c >= least}
    clean = Counter(x for n in good for x in n if x in held)
    held = {x for x, c in held.items() if clean[x] / max(len(good), 1) <= 0.02 * c / len(bad)}
    where = defaultdict(set)
    for i, n in enumerate(bad):
        for x in n & held:
            where[x].add(i)
    found = {x for x, ids in where.items() if len(ids) >= max(least, len(bad) / 20)}
    while where:
        best = max(where, key=lambda x: (len(where[x]), len(x), x))
        explained = where.pop(best)
        if len(explained) < least:
            break
        found.add(best)
        where = {x: left for x, ids in where.items() if (left := ids - explained)}
    return found


def covered(word: str, found: set[str]) -> bool:
    return word in found or any(f"{word[:n]}*" in found for n in BEGINNINGS if 4 <= n < len(word))


def _ahead(x: np.ndarray, lengths: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Forward odds of chains that lie one after another in x (exponentials of emissions); m are the exponentials of the moves.

    A step takes odds r to x (m01 + r m11) / (m00 + r m10). Chains are cut into blocks and the blocks stepped through side by
    side. What a block makes of any incoming odds is the product of its steps as matrices; by those, odds are carried over the
    cuts first, so a chain of any length gets its exact sums.
    """
    blocks = -(-lengths // BLOCK)
    first = np.cumsum(blocks) - blocks
    place = np.arange(len(x)) + np.repeat(first * BLOCK - (np.cumsum(lengths) - lengths), lengths)
    cells = np.ones(int(blocks.sum()) * BLOCK)
    cells[place] = x
    cells = np.ascontiguousarray(cells.reshape(-1, BLOCK).T)

    def steps(of: np.ndarray, start: np.ndarray) -> np.ndarray:
        out = np.empty_like(of)
        out[0] = start
        for t in range(1, len(of)):
            r = out[t - 1]
            out[t] = of[t] * (m[0, 1] + r * m[1, 1]) / (m[0, 0] + r * m[1, 0])
        return out

    out = np.empty_like(cells)
    out[:, first] = steps(cells[:, first], cells[0, first])
    if (blocks > 1).any():
        inner = np.setdiff1d(np.arange(cells.shape[1]), first)
        of = cells[:, inner]
        # toxic and clean sums of a block that is entered in the clean state (a, c) or in the toxic one (b, d)
        a, b, c, d = of[0] * m[0, 1], of[0] * m[1, 1], np.full(len(inner), m[0, 0]), np.full(len(inner), m[1, 0])
        for t in range(1, BLOCK):
            a, c = of[t] * (c * m[0, 1] + a * m[1, 1]), c * m[0, 0] + a * m[1, 0]
            b, d = of[t] * (d * m[0, 1] + b * m[1, 1]), d * m[0, 0] + b * m[1, 0]
            size = a + b + c + d
            a, b, c, d = a / size, b / size, c / size, d / size
        where = np.full(cells.shape[1], -1)
        where[inner] = np.arange(len(inner))
        entry, r, live = np.empty(len(inner)), out[-1, first], np.arange(len(lengths))
        for k in range(1, int(blocks.max())):
            keep = blocks[live] > k
            live, r = live[keep], r[keep]
            at = where[first[live] + k]
            entry[at] = r
            r = (a[at] + r * b[at]) / (c[at] + r * d[at])
        out[:, inner] = steps(of, of[0] * (m[0, 1] + entry * m[1, 1]) / (m[0, 0] + entry * m[1, 0]))
    return out.T.ravel()[place]


def odds(emission: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward odds, backward odds times exp(emission), and the toxic state's marginal for chains that lie one after another; emission is the toxic state's score less the clean one's, moves[i, j] the score of going from i to j."""
    lengths = np.asarray(lengths)
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return (np.zeros(0),) * 3
    m, x = np.exp(moves), np.exp(np.clip(emission, -30, 30))
    ahead = _ahead(x, lengths, m)
    # read backwards, a chain is a chain whose moves are transposed
    back = _ahead(x[::-1], lengths[::-1], m.T)[::-1]
    both = ahead * back / x
    return ahead, back, both / (1 + both)


@dataclass
class Model:
    weights: np.ndarray
    moves: np.ndarray
    scale: np.ndarray

    def emissions(self, words: list[str]) -> list[float]:
        return self.weights[np.array([features(w) for w in words])].sum(axis=1).tolist()


def _summary(p: np.ndarray) -> list[float]:
    total = float(p.sum())
    return [1.0, math.log(total + 1e-3), float(p.max()) if len(p) else 0.0, math.log(total / (len(p) + 20) + 1e-5)]


def train(texts: list[str], toxic: list[int], prior: float, epochs: int = 6, batch: int = 64, rate: float = 0.3, seed: int = 17) -> Model:
    """Fits the field on four documents in five, and on the fifth the logistic curve that makes scores of marginals; prior is the share of toxic documents among all, which the sample need not have."""
    words = [tokens(t) for t in texts]
    ids: dict[str, int] = {}
    codes = [np.array([ids.setdefault(w, len(ids)) for w in ws], np.int32) for ws in words]
    del words
    vocabulary = list(ids)
    found = cover([{vocabulary[i] for i in set(c.tolist())} for c in codes], toxic)
    marked = np.array([covered(w, found) for w in vocabulary] or [False])
    table = np.array([features(w) for w in vocabulary] or [features("")], np.int32)
    rng = np.random.default_rng(seed)
    shuffled = rng.permutation(len(texts))
    fit, rest = shuffled[len(texts) // 5 :], shuffled[: len(texts) // 5]
    use = np.array([i for i in fit if len(codes[i])], int)
    weights, moves = np.zeros(1 << FEATURE_BITS, np.float64), np.zeros((2, 2))
    weights[0] = -2.0
    gained, gained_moves = np.full(1 << FEATURE_BITS, 1e-6), np.full((2, 2), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(use)
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            code, lengths = np.concatenate([codes[i] for i in part]), np.array([len(codes[i]) for i in part])
            tag = (marked[code] & np.repeat([bool(toxic[i]) for i in part], lengths)).astype(float)
            score = weights[table[code]].sum(axis=1)
            ahead, back, p = odds(score, lengths, moves)
            # gradient of the log likelihood: what is tagged less what is expected
            g = np.bincount(table[code].ravel(), np.repeat(tag - p, table.shape[1]), 1 << FEATURE_BITS) / len(part)
            inside = np.ones(len(code) - 1, bool)
            inside[np.cumsum(lengths)[:-1] - 1] = False
            m, r, s = np.exp(moves), ahead[:-1][inside], back[1:][inside]
            joint = np.stack([np.full(len(r), m[0, 0]), m[0, 1] * s, r * m[1, 0], r * m[1, 1] * s])
            joint = (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)
            a, b = tag[:-1][inside], tag[1:][inside]
            gold = np.array([[((1 - a) * (1 - b)).sum(), ((1 - a) * b).sum()], [(a * (1 - b)).sum(), (a * b).sum()]])
            gm = (gold - joint) / len(part)
            g -= 1e-5 * weights
            gained += g * g
            gained_moves += gm * gm
            weights += rate * g / np.sqrt(gained)
            moves += 0.2 * rate * gm / np.sqrt(gained_moves)
    model = Model(weights.astype(np.float32), moves - moves[0, 0], np.zeros(4))
    emission = model.weights[table].sum(axis=1) if len(vocabulary) else np.zeros(1)
    use = rest if len({toxic[i] for i in rest}) > 1 else shuffled
    x = np.array([_summary(p) for p in split_marginals([emission[codes[i]] for i in use], model.moves)]).reshape(-1, 4)
    y = np.array([toxic[i] for i in use], float)
    # classes count as they do among all documents
    each = np.where(y > 0, prior / max(y.sum(), 1), (1 - prior) / max(len(y) - y.sum(), 1))
    scale = np.array([-1.0, 1.0, 0.0, 0.0])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ scale, -30, 30)))
        curve = (x * (each * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(4)
        scale = scale + 0.5 * np.linalg.solve(curve, x.T @ (each * (y - p)) - 1e-3 * scale * [0, 1, 1, 1])
    model.scale = scale
    return model


def marginals(model: Model, texts: list[str], memory: dict[str, float]) -> list[np.ndarray]:
    """Each text's tokens' toxic marginals. memory holds the emissions of words already met."""
    emissions = []
    for t in texts:
        ws = tokens(t)
        try:
            e = [memory[w] for w in ws]
        except KeyError:
            if len(memory) > MEMORY:
                memory.clear()
            new = [w for w in set(ws) if w not in memory]
            memory.update(zip(new, model.emissions(new), strict=True))
            e = [memory[w] for w in ws]
        emissions.append(np.array(e))
    return split_marginals(emissions, model.moves)


def split_marginals(emissions: list[np.ndarray], moves: np.ndarray) -> list[np.ndarray]:
    """The toxic marginals of each chain's tokens."""
    if not emissions:
        return []
    lengths = np.array([len(e) for e in emissions])
    return np.split(odds(np.concatenate(emissions), lengths, moves)[2], np.cumsum(lengths)[:-1])


def document_score(model: Model, p: np.ndarray) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(_summary(p), model.scale))))))


def spans(text: str, p: np.ndarray, least: float = 0.5) -> list[list[int]]:
    """Begin and end, in characters of the text, of runs of tokens with a marginal of at least `least`."""
    out: list[list[int]] = []
    last = -2
    for i, m in enumerate(TOKEN.finditer(text)):
        if i < len(p) and p[i] >= least:
            if last == i - 1:
                out[-1][1] = m.end()
            else:
                out.append([m.start(), m.end()])
            last = i
    return out


def sample(docs: DataFrame, labels: DataFrame, learn: Column, most: int, most_bytes: int) -> tuple[list[str], list[int], float]:
    """Texts and labels of `most` documents of each class, or of all it has: those with the least hashes of doc_id; of rows that repeat a doc_id one. A class's texts end where they pass half of most_bytes; texts that pass it by themselves come last, so one is taken only where its class has no other. And the share of toxic ones among all that may be learnt from."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.where("toxic in (0, 1)").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    h = F.xxhash64(F.lit("sample"), "doc_id")
    picked = [known.where(F.col("toxic") == label).select("doc_id", "toxic", h.alias("h")).orderBy("h", "doc_id").limit(most) for label in counts]
    if not picked:
        return [], [], 0.0
    # two times `most` ids at the most, whatever the tables' sizes
    ids = F.broadcast(reduce(DataFrame.union, picked))
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(ids, "doc_id").groupBy("doc_id", "toxic", "h").agg(F.min("text").alias("text"))
    half = most_bytes // 2
    order = Window.partitionBy("toxic").orderBy(F.octet_length("text") > half, "h", "doc_id")
    ranked = rows.withColumns({"so_far": F.sum(F.octet_length("text")).over(order), "rank": F.row_number().over(order)})
    found = sorted((r["toxic"], r["text"]) for r in ranked.where((F.col("rank") == 1) | (F.col("so_far") <= half)).select("toxic", "text").collect())
    return [t for _, t in found], [y for y, _ in found], counts.get(1, 0) / max(1, counts.get(0, 0) + counts.get(1, 0))


def _score(model: Model | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory: dict[str, float] = {}
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                texts = [t if isinstance(t, str) else "" for t in part["text"]]
                found = marginals(model, texts, memory) if model else [np.zeros(0)] * len(texts)
                score = [document_score(model, p) if model else 0.0 for p in found]
                offending = [spans(t, p) if (p >= 0.5).any() else [] for t, p in zip(texts, found, strict=True)]
                yield part.drop(columns="text").assign(doc_id=part["doc_id"].astype("Int64"), score=score, spans=offending)

    return run


def _keep(model: Model | None, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, float] = {}
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column("text").to_pylist()]
                found = marginals(model, texts, memory) if model else None
                yield part.filter(pa.array([found is None or document_score(model, p) < least for p in found or texts], pa.bool_()))
        memory.clear()
        give_back()

    return run


def fitted(docs: DataFrame, labels: DataFrame, learn: Column, most: int, most_bytes: int = 64_000_000) -> Model | None:
    texts, toxic, prior = sample(docs, labels, learn, most, most_bytes)
    return train(texts, toxic, prior) if len(set(toxic)) == 2 else None


def keep_clean(docs: DataFrame, labels: DataFrame, learn: Column, least: float = 0.3, most: int = 1200) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores under `least`; see tag."""
    return docs.mapInArrow(_keep(fitted(docs, labels, learn, most), least), docs.schema)


def tag(docs: DataFrame, labels: DataFrame, learn: Column, most: int = 1200) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out (learn is false), score, spans (begins and ends of toxic runs in characters).

    Trains on a sample of `most` toxic and as many other documents from labels (doc_id, toxic) for which learn holds (64 MB at most; see sample);
    a document labelled twice is toxic if either label says so. Every whole text is scored. Null and empty texts are scored as
    texts without tokens; with nothing to learn from, or but one class, all score 0. Repeated rows get equal results.
    An empty table gives an empty result.
    """
    model = fitted(docs, labels, learn, most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~F.coalesce(learn, F.lit(True))).alias("held_out"), "text")
    return rows.mapInPandas(_score(model), "doc_id long, held_out boolean, score double, spans array<array<int>>")

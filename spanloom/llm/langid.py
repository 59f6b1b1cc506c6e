"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by stochastic gradient descent in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

BUCKET_BITS, DIM = 15, 16
#: Lengths in characters of the subwords; a blank stands for white space, so that some mark words' ends.
GRAMS = (1, 2, 3, 4)
#: Characters whose subwords are hashed at a time.
BLOCK = 1 << 18


def has_letter(text: str) -> bool:
    """Whether a character of Unicode's categories L stands in the text; digits, fractions and enclosed numbers are none."""
    return any(map(str.isalpha, text))


@dataclass
class Model:
    """languages, and for each bucket the embedding times the softmax's weights; scores are divided by temperature. Below reject_below a prediction is marked as rejected."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of the texts, and where each text's begin; after each text stands at least one filler of bucket 2 ** BUCKET_BITS."""
    parts = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    n = np.array([len(p) + 1 for p in parts])
    codes = np.concatenate([x for p in parts for x in (p, np.zeros(1, np.uint32))]) if parts else np.empty(0, np.uint32)
    codes = np.where((codes == 32) | ((codes >= 9) & (codes <= 13)), np.uint32(32), codes)
    left = np.repeat(np.cumsum(n), n) - np.arange(len(codes)) - 1  # characters up to the text's end
    out, h = np.empty((len(GRAMS), len(codes)), np.int32), np.zeros(len(codes), np.uint32)
    for k, size in enumerate(GRAMS):
        shifted = np.zeros_like(codes)
        shifted[: max(0, len(codes) - size + 1)] = codes[size - 1 :]
        h = (h ^ shifted) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        bucket = ((h + np.uint32(size * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BUCKET_BITS)).astype(np.int32)
        out[k] = np.where(left >= size, bucket, 1 << BUCKET_BITS)
    starts = np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else np.empty(0, np.int64)
    return out, starts.astype(np.int64)


def scores(model: Model, texts: list[str]) -> np.ndarray:
    """Logits of each text, a long text's subwords being summed block by block."""
    out = np.empty((len(texts), len(model.languages)))
    i = 0
    while i < len(texts):
        j, total = i, 0
        while j < len(texts) and (j == i or total + len(texts[j]) <= BLOCK):
            total += len(texts[j])
            j += 1
        grams, starts = subwords(texts[i:j])
        summed, counted = np.zeros((j - i, len(model.languages))), np.zeros(j - i)
        for row in grams:
            counted += np.add.reduceat((row < 1 << BUCKET_BITS).astype(np.int64), starts)
            for c in range(len(model.languages)):
                summed[:, c] += np.add.reduceat(model.table[c][row], starts, dtype=np.float64)
        out[i:j] = (summed / np.maximum(counted, 1)[:, None] + model.bias) / model.temperature
        i = j
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text and their shares of its subwords."""
    found, n = np.unique(subwords([text])[0], return_counts=True)
    n = n[found < 1 << BUCKET_BITS].astype(np.float32)
    return found[found < 1 << BUCKET_BITS], n / max(n.sum(), 1)


def train(texts: list[str], languages: list[str], epochs: int = 12, rate: float = 60.0, batch: int = 32, seed: int = 17) -> Model:
    """Fits embeddings and weights on nine texts in ten of each language; the tenth sets the temperature by likelihood, and reject_below as the score that half of its wrong predictions stay under (0.5 if none is wrong)."""
    names, rng = sorted(set(languages)), np.random.default_rng(seed)
    y = np.array([names.index(x) for x in languages])
    order = rng.permutation(len(texts))
    place = {i: k for c in range(len(names)) for k, i in enumerate(order[y[order] == c].tolist())}
    held, fit = np.array([i for i in order if place[i] % 10 == 9], int), np.array([i for i in order if place[i] % 10 != 9], int)
    shares = {i: _counted(texts[i]) for i in fit}
    e = rng.normal(0, 0.3, (1 << BUCKET_BITS, DIM)).astype(np.float32)
    w, b = rng.normal(0, 0.3, (DIM, len(names))).astype(np.float32), np.zeros(len(names), np.float32)
    for epoch in range(epochs):
        step, order = np.float32(rate * (1 - epoch / epochs)), rng.permutation(fit)
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            x = np.zeros((len(chosen), 1 << BUCKET_BITS), np.float32)
            for k, i in enumerate(chosen):
                x[k, shares[i][0]] = shares[i][1]
            m = x @ e
            g = softmax((m @ w + b).astype(np.float64)).astype(np.float32)
            g[np.arange(len(chosen)), y[chosen]] -= 1
            g /= len(chosen)
            down = g @ w.T
            w -= step * np.float32(0.02) * (m.T @ g)
            b -= step * np.float32(0.005) * g.sum(axis=0)
            e -= step * (x.T @ down)
    model = Model(names, np.ascontiguousarray(np.vstack([e @ w, np.zeros((1, len(names)), np.float32)]).T), b.astype(np.float64), 1.0, 0.5)
    if len(held):
        z, rows = scores(model, [texts[i] for i in held]), np.arange(len(held))
        grid = np.geomspace(0.02, 4, 60)
        loss = [-np.log(np.maximum(softmax(z / t)[rows, y[held]], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        p = softmax(z / model.temperature)
        wrong = p.max(axis=1)[p.argmax(axis=1) != y[held]]
        model.reject_below = float(np.median(wrong)) if len(wrong) else 0.5
    return model


def sample(docs: DataFrame, learn: Column, most: int, least: int, most_bytes: int) -> tuple[list[str], list[str]]:
    """Labelled texts, the languages as evenly as they can be: each of k languages gives max(most / k, least) distinct texts, picked by a hash of the text, or all that it has; fewer where they would pass most_bytes / k bytes, one at least. Texts over that bound come last, so one is taken only where a language has no other. A text counts once for a language, however often it is repeated, and no language is left out."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64(F.lit("sample"), "text").alias("t"))
    counts = materialize(rows.groupBy(F.col("lang").alias("name")).agg(F.count_distinct("t").alias("n")), "languages")
    k = counts.count()
    if not k:
        return [], []
    each, cap = max(most // k, least), most_bytes // k
    h = F.pmod(F.col("t"), F.lit(10**9)) / F.lit(10.0**9)
    # twice the texts that are wanted, so that the cut below finds enough of them
    few = rows.join(counts, F.col("lang") == F.col("name")).where(h * F.col("n") < F.lit(2.0 * each)).dropDuplicates(["lang", "t"]).select("lang", "text", h.alias("h"), F.octet_length("text").alias("size"))
    by_hash = Window.partitionBy("lang").orderBy(F.col("size") > cap, "h", "text")
    few = few.withColumns({"rank": F.row_number().over(by_hash), "upto": F.sum("size").over(by_hash)})
    taken = few.where((F.col("rank") <= each) & ((F.col("rank") == 1) | (F.col("upto") <= cap))).select("text", "lang")
    found = [(t, x) for t, x in sorted((r["text"], r["lang"]) for r in taken.collect()) if has_letter(t)]
    return [t for t, _ in found], [x for _, x in found]


def _predict(model: Model | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                part = pdf.iloc[at : at + 512]
                texts = [t if isinstance(t, str) else "" for t in part["text"]]
                full = [i for i, t in enumerate(texts) if model and has_letter(t)]
                lang, score = ["und"] * len(texts), [0.0] * len(texts)
                if full:
                    p = softmax(scores(model, [texts[i] for i in full]))
                    for k, i in enumerate(full):
                        lang[i], score[i] = model.languages[int(p[k].argmax())], float(p[k].max())
                rejected = [x == "und" or s < model.reject_below for x, s in zip(lang, score, strict=True)]
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "held_out": part["held_out"], "lang_pred": lang, "score": score, "rejected": rejected})

    return run


def identify(docs: DataFrame, learn: Column, most: int = 2000, least: int = 20, most_bytes: int = 32_000_000) -> DataFrame:
    """Per row of docs (doc_id, text, lang): doc_id, held_out (learn is false), lang_pred, score, rejected.

    Trains on a sample of `most` distinct texts for which learn holds and lang is not null (at least `least` of each language, if it has
    them, and about most_bytes bytes; see sample), and predicts every whole text from its characters alone. score is the calibrated probability of lang_pred. Texts that are null, empty or have no
    letter get `und`, score 0 and rejected; so do all if there is nothing to learn from. rejected also marks scores
    under the model's threshold. Repeated rows get equal results. An empty table gives an empty result.
    """
    texts, languages = sample(docs, learn, most, least, most_bytes)
    model = train(texts, languages) if texts else None
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~F.coalesce(learn, F.lit(True))).alias("held_out"), "text")
    return rows.mapInPandas(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")

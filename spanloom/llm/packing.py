"""Packing documents into fixed-length sequences by the sum-of-squares rule."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialize

#: Pieces that one task packs, about; the waste of a group is a fixed few sequences, so larger groups waste less.
PER_GROUP = 40_000
#: Parts of texts of which a worker remembers the ids, and the most characters of one. Half of them are the latest; of the others those are kept
#: that come again while the next half fills up.
REMEMBERED, PART_CHARS = 600_000, 64
#: New parts that the tokenizer takes as one text.
PARTS_AT_ONCE = 128
#: A part of letters, and ASCII marks after them: the tokenizer's own rule parts them there, so the word's ids serve for it with any marks.
#: Apostrophes may begin a token with letters. The letters are those of scripts that Unicode no longer adds to.
MARKS, MARKED = frozenset("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"), re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\[-`{-~]+)")
#: Texts that are cut at once, and about the most characters of them: a longer text stands alone. A part is looked up once for all of them.
TEXTS, CHARS = 2048, 8_000_000
#: A part of a text: up to a space that stands alone. A byte-level tokenizer's own rule never makes a token over such an edge, nor looks over
#: one: see the tests. Texts without a space that lies within or ends a run of white space may be cut before each space.
PART, WITHIN_RUN = re.compile(r"(?s).(?:[^ ]+|(?<!\S) | (?!\S))*"), re.compile(r" (?<=\s )(?:\s|\Z)")


@lru_cache(maxsize=4)
def encoder(path: str):
    """A function from texts to their ids by the `tokenizers` library.

    Its time goes into words, and most words of a corpus come again; so texts are cut at edges that no token crosses, each part
    is encoded once, many at a time, and its ids are remembered. Arrow cuts many texts at once and numbers their parts, so only
    distinct ones become Python strings. A tokenizer for which the edges don't hold (other than byte-level with
    the usual rule, or with a normalizer, or with special tokens that hold white space or take it) encodes whole texts.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    model = json.loads(whole.to_str())
    before = model["pre_tokenizer"] or {}
    plain = before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and not model["normalizer"]
    apart = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and re.fullmatch(r"<\|?[A-Za-z_]+\|?>", t["content"]) for t in model["added_tokens"])
    known: dict[str, bytes] = {}
    older: dict[str, bytes] = {}
    token_bytes = np.zeros(max(whole.get_vocab().values()) + 1, np.int64)
    for token, i in whole.get_vocab(with_added_tokens=False).items():
        token_bytes[i] = len(token)  # a character stands for a byte
    for t in model["added_tokens"]:
        token_bytes[t["id"]] = len(t["content"].encode())

    def ids(texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in whole.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_new(new: list[str]) -> Iterator[bytes]:
        """The ids of each part and the space before it. Tokens are bytes of the text, so their lengths tell where in a text of many parts each one ends."""
        for at in range(0, len(new), PARTS_AT_ONCE):
            some = new[at : at + PARTS_AT_ONCE]
            [found] = ids([" " + " ".join(some)])
            ends, tokens = np.cumsum(pc.binary_length(pa.array(some, pa.large_string())).to_numpy() + 1), np.cumsum(token_bytes[found])
            stops = np.searchsorted(tokens, ends) + 1
            if len(tokens) and stops[-1] == len(tokens) and (tokens[stops - 1] == ends).all():
                raw, stops = found.tobytes(), (4 * stops).tolist()
                yield from [raw[start:stop] for start, stop in zip([0, *stops], stops, strict=False)]
            else:
                yield from (x.tobytes() for x in ids([" " + x for x in some]))

    @lru_cache(maxsize=4096)
    def marks(text: str) -> bytes:
        return ids([text])[0].tobytes()

    def unknown(parts: Iterable[str]) -> list[str]:
        """Those parts that are not remembered; the others are among the latest from now on."""
        missing = [x for x in parts if x not in known]
        known.update((x, older[x]) for x in missing if x in older)
        return [x for x in missing if x not in known]

    def learn(parts: list[str]) -> list[str]:
        """Sees to it that the ids of these parts are known; returns those that were not, and words in them."""
        if len(known) + len(parts) > REMEMBERED // 2:
            older.clear()
            older.update(known)
            known.clear()
        new = unknown(parts)
        marked = [m for x in new if x[-1:] in MARKS and (m := MARKED.fullmatch(x))]
        whole = set(new).difference(m[0] for m in marked)
        whole.update(unknown({m[1] for m in marked}))
        inner = [x for x in whole if x and x.strip() == x]  # side by side, others could make runs of white space
        outer = [x for x in whole if not x or x.strip() != x] if len(inner) < len(whole) else []
        known.update(zip(inner, encode_new(inner), strict=True))
        known.update(zip(outer, (x.tobytes() for x in ids([" " + x for x in outer])), strict=True))
        known.update((m[0], known[m[1]] + marks(m[2])) for m in marked)
        return [*whole, *(m[0] for m in marked)]

    def encode(texts: list[str]) -> list[np.ndarray]:
        if not plain or not apart:
            return ids(texts)
        if not texts:
            return []
        inside = [bool(WITHIN_RUN.search(t)) for t in texts]
        order = sorted(range(len(texts)), key=inside.__getitem__)
        cut = pc.split_pattern(pa.array([t for t, x in zip(texts, inside, strict=True) if not x], pa.large_string()), " ")
        slow = [[x[i > 0 :] for i, x in enumerate(PART.findall(t))] for t, x in zip(texts, inside, strict=True) if x]
        parts = pa.concat_arrays([cut.flatten(), pa.array(list(chain.from_iterable(slow)), pa.large_string())])
        stops = np.cumsum(np.concatenate([pc.list_value_length(cut).to_numpy(), np.array([len(x) for x in slow], np.int64)]))
        starts = np.concatenate([[0], stops[:-1]])
        later = np.ones(len(parts), bool)
        later[starts] = False
        first = ids(parts.take(pa.array(starts)).to_pylist())  # the only ones without a space before them, which the others' keys leave out
        coded = parts.filter(pa.array(later)).dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = learn(distinct)
        found = pa.array([known[x] for x in distinct], pa.large_binary()).take(coded.indices)
        for x in new:
            if len(x) > PART_CHARS:
                del known[x]
        _, ends, raw = found.buffers()
        ends, flat = (np.frombuffer(ends, np.int64) // 4, np.frombuffer(raw, "<u4")) if len(found) else (np.zeros(1, np.int64), np.empty(0, "<u4"))
        before = np.arange(len(texts))  # first parts of the texts up to this one
        out = dict(zip(order, (np.concatenate([x, flat[a:b]]) for x, a, b in zip(first, ends[starts - before], ends[stops - before - 1], strict=True)), strict=True))
        return [out[i] for i in range(len(texts))]

    return encode


def _runs(chars: list[int]) -> Iterator[tuple[int, int]]:
    """Where runs of texts of these lengths begin and end: TEXTS at most, and CHARS but for a single longer text."""
    at, total = 0, 0
    for i, n in enumerate(chars):
        if i > at and (i - at == TEXTS or total + n > CHARS):
            yield at, i
            at, total = i, 0
        total += n
    if chars:
        yield at, len(chars)


def _pieces(path: str, most: int, end: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path)
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            for at, to in _runs([len(t) for t in texts]):
                part = pdf.iloc[at:to]
                out = {c: [] for c in ("doc_id", "row", "piece", "start", "length", "ids_crc32")}
                for doc_id, row, found in zip(part["doc_id"].astype("Int64"), part["row"], encode(texts[at:to]), strict=True):
                    ids = np.append(found, np.uint32(end)).astype("<u4", copy=False)
                    start = 0
                    for piece, stop in enumerate(range((len(ids) - 1) % most + 1, len(ids) + 1, most)):
                        for c, v in zip(out, (doc_id, row, piece, start, stop - start, zlib.crc32(ids[start:stop])), strict=True):
                            out[c].append(v)
                        start = stop
                yield pd.DataFrame(out).astype({"doc_id": "Int64"})
        give_back()

    return run


def sum_of_squares(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset for each piece, placed in the given order where the squared counts of open bins per gap sum to least.

    Putting a piece of length s into a bin with gap g changes that sum by 2 - 2 N(g) + 2 N(g - s); closing a bin or opening
    a new one lacks one of the two terms. Ties: the smallest gap. Among bins of one gap, the last to get it.
    """
    counts = np.zeros(most + 1, np.int64)
    bins: list[list[int]] = [[] for _ in range(most + 1)]
    where, offset, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        gaps = counts[s:most]
        change = np.where(gaps > 0, 1 - 2 * gaps + 2 * counts[: most - s] + 1, np.iinfo(np.int64).max)
        if len(change):
            change[0] -= 1 if gaps[0] > 0 else 0  # the bin closes: no gap gets it
        g = int(change.argmin()) + s if len(change) else most
        new = 2 * counts[most - s] + 1 if s < most else 0
        if g == most or gaps[g - s] == 0 or new < change[g - s]:
            b, made, g = made, made + 1, most
        else:
            b = bins[g].pop()
            counts[g] -= 1
        where[i], offset[i] = b, most - g
        if g > s:
            bins[g - s].append(b)
            counts[g - s] += 1
    return where, offset


def _pack(most: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        long = -pdf["length"].where(4 * pdf["length"] >= most, 0)
        pdf = pdf.assign(long=long).sort_values(["long", "ids_crc32", "row", "piece"], kind="stable").drop(columns="long")
        where, offset = sum_of_squares(pdf["length"].to_numpy(), most)
        return pdf.assign(sequence_id=pdf["grp"].to_numpy() * (1 << 32) + where, offset=offset).drop(columns=["grp", "row"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, most: int = 1024, end: int = 2) -> DataFrame:
    """Per piece of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids are its text's and then `end`; a null text is empty. Only documents of more than `most` ids are cut,
    into pieces of `most`, the first of which may be shorter. Pieces are dealt to groups by random numbers
    that are written with them, so repeated rows spread as others do, and each group is packed by the sum-of-squares rule: pieces of a quarter of a sequence and more first, the longest first, then the
    others in the order of their checksums, which is as good as random (closer than all longest first or all random; README). Ids of sequences are unique, not gapless. Null doc_ids are
    carried; repeated rows are packed each. An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row"), "text")
    pieces = materialize(rows.mapInPandas(_pieces(tokenizer_path, most, end), "doc_id long, row long, piece int, start long, length long, ids_crc32 long").withColumn("deal", F.rand(17)), "pieces")
    groups = -(-pieces.count() // PER_GROUP) or 1
    dealt = pieces.withColumn("grp", F.floor(F.col("deal") * groups)).drop("deal")
    return dealt.groupBy("grp").applyInPandas(_pack(most), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

"""The corpus operators against brute force, exact round trips and odd rows."""

import base64
import hashlib
import io
import itertools
import json
import re
import struct
import time
import zipfile
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanloom.llm import common, crf, langid, linefreq, minhash, mixture, mpegaudio, packing, shards, warc, wrappers
from spanloom.llm.common import materialize, word_count
from spanloom.llm.queries import tokenizer_path

WHOLE = Tokenizer.from_file(tokenizer_path())
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, size int, key string"


def odd_docs(spark, rows=None):
    long = "word " * 30000
    rows = rows if rows is not None else [(1, "a b c d e f", "en", "s"), (2, "a b c d e f", "en", "s"), (2, "a b c d e f", "en", "s"), (3, "", "en", None), (None, "x y", None, "s"), (4, None, None, None), (5, "\n \t\n", "de", "t"), (6, long, "de", "t"), (7, "é<|endoftext|>中", "de", "t")]
    return spark.createDataFrame([(*r, None, "clash", 1, "clash") for r in rows], DOCS)


def brute_components(texts, k, percent=80):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(minhash.ASCII_LOWER))
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(sorted(sets), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_brute_force(spark, k):
    rng = np.random.default_rng(k)
    texts = {}
    for g in range(12):
        base = [f"w{x}" for x in rng.integers(0, 500, 80)]
        for c in range(6):
            words = list(base)
            for _ in range(c * 2):
                words[rng.integers(len(words))] = f"v{rng.integers(1000)}"
            texts[g * 10 + c] = " ".join(words)
    texts |= {900: "", 901: None, 902: "one", 903: "One", 904: "one two"}
    got = minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), k)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute_components(texts, k)


@pytest.mark.parametrize(("k", "turns"), [(2, 1), (5, 1), (2, 3)])
def test_large_buckets_of_unlinked_copies_equal_brute_force(spark, monkeypatch, k, turns):
    """Copies at all distances from their base, with copies of the far ones: links that only the differences find."""
    monkeypatch.setattr(minhash, "MOST_TURNS", turns)
    rng = np.random.default_rng(k)
    edit = lambda words, n: [f"v{rng.integers(60)}" if i in set(rng.integers(0, len(words), n).tolist()) else w for i, w in enumerate(words)]
    texts = {}
    for g in range(3):
        base = [f"w{x}" for x in rng.integers(0, 400, 150)]
        for c in range(70):
            copy = edit(base, int(rng.integers(0, 26 if k == 2 else 12)))
            texts[g * 1000 + c] = " ".join(copy)
            if c % 3 == 0:
                texts[g * 1000 + 500 + c] = " ".join(edit(copy, int(rng.integers(1, 12 if k == 2 else 5))))
    asked = []
    by_differences = minhash._by_differences

    def spy(*args):
        found = by_differences(*args)
        asked.append(found[1].count())
        return found

    monkeypatch.setattr(minhash, "_by_differences", spy)
    got = minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), k)
    expected = brute_components(texts, k)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == expected
    assert 3 < len({c for _, c in expected.values()}) < len(texts)
    assert turns > 1 or asked[0] > 0


def test_hubs_are_dealt_to_many_tasks(spark, monkeypatch):
    """Components are the same when every end counts as a hub."""
    monkeypatch.setattr(minhash, "HUB", 2)
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (330, 2))] + [(7, i) for i in range(400, 460)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    got = minhash.components(spark.createDataFrame(edges, "a long, b long"), materialize)
    assert {r["cid"]: r["root"] for r in got.collect()} == {x: find(x) for x in root if find(x) != x}


def test_pruning_spares_likely_pairs():
    stops = minhash.least_matches(0.8, 1e-6)
    assert all(m < 0.8 * n for n, m in stops) and stops[-1][1] > 0.6 * stops[-1][0]


def test_keep_first_keeps_one_of_repeated_rows(spark):
    df = odd_docs(spark).withColumns({c: F.lit(c) for c in ("rid", "_rid", "row", "_doc", "gone", "col")})
    left = minhash.keep_first(df, 5)
    assert left.columns == df.columns
    left = left.collect()
    assert all(r["rid"] == "rid" and r["row"] == "row" for r in left)
    assert sum(r["text"] == "a b c d e f" for r in left) == 1 and {3, 4, 5, 6, 7} <= {r["doc_id"] for r in left}


def test_packages_with_zip64_directories():
    name, data = warc.RECORDS.encode(), b"stored bytes"
    local = warc.LOCAL + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, 0, warc.FULL32, warc.FULL32, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, len(data), len(data))
    extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), 0)
    entry = warc.ENTRY + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, 0, warc.FULL32, warc.FULL32, len(name), len(extra), 0, 0, 0, 0, warc.FULL32) + name + extra
    at = len(local) + len(data)
    end64 = warc.END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(entry), at)
    locator = warc.LOCATOR + struct.pack("<IQI", 0, at + len(entry), 1)
    end = warc.END + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, warc.FULL32, warc.FULL32, 3) + b"end"
    whole = io.BytesIO(local + data + entry + end64 + locator + end)
    first, length = warc.stored(whole, warc.directory(whole)[warc.RECORDS])
    whole.seek(first)
    assert whole.read(length) == data


def test_packages_reject_what_is_packed():
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", "x" * 1000)
    with pytest.raises(ValueError):
        warc.stored(b, warc.directory(b)["a"])
    with pytest.raises(ValueError):
        warc.directory(io.BytesIO(b"no package"))


def test_comments_that_hold_the_end_records_signature():
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_STORED) as z:
        z.writestr("a", "bytes")
        z.comment = b"x" + warc.END + b"\x00" * 30
    first, length = warc.stored(b, warc.directory(b)["a"])
    assert b.getvalue()[first : first + length] == b"bytes"


def test_warc_contract_by_brute_force(spark):
    rng = np.random.default_rng(6)
    pages = [(int(i), f"http://h/{i}", [None, "", "a", "bb", "é" * 40, f"own{i}"][rng.integers(6)]) for i in rng.permutation(80)]
    payload = {i: (h or "").encode() for i, _, h in pages}
    for least in (0, 3):
        expected = {}
        for i, data in payload.items():
            last = max(j for j, other in payload.items() if other == data)
            revisit = last != i and len(data) >= least
            expected[i] = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", last if revisit else None)
        got = warc.round_trip(spark, spark.createDataFrame(pages, "page_id long, url string, html string"), least).collect()
        assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got} == expected


def test_warc_round_trip(spark):
    pages = [(1, "http://a/", "x"), (2, None, "x"), (3, "http://b/ \n", "é"), (4, "u", None), (5, "u", ""), (None, "u", "x")]
    got = warc.round_trip(spark, spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == 6 and by[2]["record_type"] == "response" and by[1]["refers_to"] == 2 and by[None]["refers_to"] == 2 and by[4]["refers_to"] == 5
    assert by[3]["payload_digest"] == base64.b32encode(hashlib.sha1("é".encode()).digest()).decode() and by[1]["payload_bytes"] == 1
    assert warc.round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_audio_carries_bytes_and_resynchronises():
    data = bytes(range(256)) * 40
    media = mpegaudio.encode(data)
    p = mpegaudio.probe(media)
    assert p["payload"] == data and p["bad"] == 0 and p["skipped"] == 0 and p["samples"] == 1152 * p["table"]["frames"] and p["checked"] == len(p["offsets"])
    cut = p["offsets"][2]
    broken = mpegaudio.probe(media[:cut] + b"noise" + media[cut:])
    assert broken["skipped"] == 5 and len(broken["offsets"]) == len(p["offsets"])
    flipped = bytearray(media)
    flipped[p["offsets"][1] + 8] ^= 1
    assert mpegaudio.probe(bytes(flipped))["bad"] == 1


def test_payloads_that_look_like_tags_or_frames_come_back():
    frame = mpegaudio._head(14, False)
    for data in (b"TAG" + b"x" * 125, b"a" * 64 + b"TAG" + b"y" * 125, b"ID3\x03\x00\x00\x00\x00\x00\x7f" * 64, frame * 256, b"Xing" * 64, bytes(64), b"\xff" * 4096):
        media = mpegaudio.encode(data)
        p = mpegaudio.probe(media)
        assert p["payload"] == data and p["bad"] == p["skipped"] == 0
        assert all(media[a] == 0xFF for a in p["offsets"]) and p["duration_s"] == p["samples"] / 48000


def test_layer_one_checksums():
    """Three mono frames of layer I at 32 kHz, the last with a wrong checksum."""
    head = bytes((0xFF, 0xFE, 1 << 4 | 2 << 2, 0xC0))
    length = mpegaudio.parse_header(head + bytes(100), 0)["length"]
    side = bytes(range(16))
    frame = head + struct.pack(">H", mpegaudio.crc16(head[2:] + side)) + side
    frame += bytes(length - len(frame))
    p = mpegaudio.probe(frame * 2 + frame[:6] + b"\xff" + frame[7:])
    assert (len(p["offsets"]), p["checked"], p["bad"], p["samples"]) == (3, 3, 1, 3 * 384)


def test_audio_contract_by_brute_force(spark):
    texts = ["", None, "a", "x" * 63, "y" * 64, "é中" * 500, "z" * 20000]
    df = odd_docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    got = {r["doc_id"]: r for r in mpegaudio.features(mpegaudio.store(df)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        data = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        media = mpegaudio.encode(data)
        assert (r["media_bytes"], r["media_sha256"], r["n_frames"]) == (len(media), hashlib.sha256(media).hexdigest(), len(r["seek_offsets"]))


def test_audio_of_odd_rows(spark):
    got = mpegaudio.features(mpegaudio.store(odd_docs(spark))).collect()
    assert len(got) == 9
    for r in got:
        assert r["payload_bytes"] % 64 == 0 and r["payload_bytes"] > 0
        if r["doc_id"] in (3, 4):
            assert r["payload_sha256"] == hashlib.sha256(bytes(64)).hexdigest() and r["n_bytes"] == 0


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    e, moves = rng.normal(size=(1, 6)), rng.normal(size=(2, 2))
    weight = {}
    for path in itertools.product((0, 1), repeat=6):
        weight[path] = np.exp(sum(x * y for x, y in zip(path, e[0], strict=True)) + sum(moves[a, b] for a, b in itertools.pairwise(path)))
    total = sum(weight.values())
    expected = [sum(w for p, w in weight.items() if p[t]) / total for t in range(6)]
    assert np.allclose(crf.odds(e[0], [6], moves)[2], expected)


def plain_marginals(e, moves):
    """Sums in logarithms, token by token."""
    n = len(e)
    score = np.stack([np.zeros(n), e], axis=1)
    ahead, back = np.zeros((n, 2)), np.zeros((n, 2))
    ahead[0] = score[0]
    for t in range(1, n):
        ahead[t] = score[t] + np.logaddexp(ahead[t - 1, 0] + moves[0], ahead[t - 1, 1] + moves[1])
    for t in range(n - 2, -1, -1):
        back[t] = np.logaddexp(moves[:, 0] + score[t + 1, 0] + back[t + 1, 0], moves[:, 1] + score[t + 1, 1] + back[t + 1, 1])
    both = ahead + back
    return 1 / (1 + np.exp(both[:, 0] - both[:, 1]))


@pytest.mark.parametrize("scale", [0.3, 2, 8])
def test_marginals_of_whole_documents_equal_plain_sums(scale):
    """Documents of all lengths around the blocks' edges, and one of 20,000 tokens."""
    rng = np.random.default_rng(3)
    moves = np.array([[0, -2], [-1, 2]]) * scale / 2
    chains = [rng.normal(-1, scale, n).clip(-30, 30) for n in (1, 0, 63, 64, 65, 127, 128, 129, 200, 2, 20_000, 640)]
    got = crf.split_marginals(chains, moves)
    assert all(np.allclose(g, plain_marginals(e, moves), atol=1e-9) if len(e) else not len(g) for g, e in zip(got, chains, strict=True))


def test_toxicity_learns_and_scores_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        words = [f"w{x}" for x in rng.integers(0, 300, 40)]
        if i % 4 == 0:
            words[5] = words[20] = "vile"
        rows.append((i, " ".join(words), "en", "s"))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in crf.tag(odd_docs(spark, rows), labels, F.col("doc_id") % 5 != 0).collect()}
    assert all((got[i] >= 0.3) == (i % 4 == 0) for i in range(0, 400, 5))
    assert len(crf.tag(odd_docs(spark), labels, F.col("doc_id") >= 0).collect()) == 9


def test_language_identification(spark):
    rows = [(i, " ".join(("the of and to" if i % 2 else "der die und das").split()[(i + j) % 4] for j in range(30)), "en" if i % 2 else "de", "s") for i in range(200)]
    got = {r["doc_id"]: r for r in langid.identify(odd_docs(spark, rows), F.col("doc_id") % 5 != 0).collect()}
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "de") and got[i]["held_out"] for i in range(0, 200, 5))
    odd = langid.identify(odd_docs(spark), F.col("doc_id") < 0).collect()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in odd)
    signs = langid.identify(odd_docs(spark, rows + [(1000 + i, t, None, "s") for i, t in enumerate(["½ ²", "①②", "12 _ --", None, "", "ª"])]), F.col("doc_id") < 1000).collect()
    assert [next(r for r in signs if r["doc_id"] == 1000 + i)["lang_pred"] == "und" for i in range(6)] == [True] * 5 + [False]
    assert langid.identify(odd_docs(spark, []), F.col("doc_id") > 0).count() == 0


def test_no_language_is_left_out(spark):
    """More languages than any list of the commonest would hold, one of them with three texts."""
    rng = np.random.default_rng(9)
    words = {f"l{k}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(4)] for k in range(300)}
    rows = [(k * 20 + i, " ".join(rng.choice(words[f"l{k}"], 30)), f"l{k}", "s") for k in range(300) for i in range(20 if k else 3)]
    texts, names = langid.sample(odd_docs(spark, rows), F.col("doc_id") >= 0, 2000, 20, 32_000_000)
    assert set(names) == set(words) and len(texts) == len(rows)
    assert {names.count(x) for x in langid.sample(odd_docs(spark, rows), F.col("doc_id") >= 0, 2000, 2, 32_000_000)[1]} == {3, 20}
    few = langid.sample(odd_docs(spark, rows), F.col("doc_id") >= 0, 2000, 2, 1)
    assert sorted(few[1]) == sorted(words)


def test_repeated_words_equal_counting(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 6, n)) for n in (0, 1, 2, 3, 10, 60, 200)]

    def plain(t):
        w = t.split()
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        return len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)})

    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", linefreq.repeated_words(linefreq.words_of(F.col("text"))).alias("n"))
    assert all(r["n"] == plain(r["text"]) for r in df.collect())


def test_frequent_lines_go_but_for_the_first_document(spark):
    own = lambda i: " ".join(f"own{i}x{j}" for j in range(60))
    menu = " ".join(f"menu{j}" for j in range(30))
    rows = [(i, f"{menu}\n{own(i)}", "en", "h") for i in range(40)] + [(100 + i, f"{menu} \n" * 2 + " ".join(f"m{i}y{j}" for j in range(20)), "en", "h") for i in range(3)] + [(200, f"{menu}\n{own(200)}", "en", "other")]
    got = {r["doc_id"]: r for r in linefreq.verdicts(odd_docs(spark, rows), 30, 1, 30).collect()}
    assert got[0]["removed"] == 0 and got[1]["removed"] == 30 and got[200]["removed"] == 0 and got[1]["kept"] and not got[100]["kept"] and got[100]["removed"] == 60
    texts = {r["doc_id"]: r["text"] for r in linefreq.remove_lines(odd_docs(spark, rows), 30).collect()}
    assert texts[1] == own(1) and texts[0].startswith("menu0")
    assert {r["doc_id"] for r in linefreq.keep_good(odd_docs(spark, rows), 30, 1, 30).collect()} == {d for d, r in got.items() if r["kept"]}
    assert len(linefreq.verdicts(odd_docs(spark)).collect()) == 9


def test_depleted_documents_are_rejected(spark):
    """The default limits: a line goes with over five documents and over a hundredth of the host's; documents that lose over a quarter of their words are rejected, but for the first that has the lines."""
    own = lambda i, n: " ".join(f"own{chr(97 + i // 26)}{chr(97 + i % 26)}{'x' * j}" for j in range(n))
    menu = " ".join(f"menu{'x' * j}" for j in range(20))
    rows = [(i, f"{menu}\n{own(i, 40 if i < 6 else 80)}", "en", "h") for i in range(12)] + [(100 + i, f"{menu}\n{own(300 + i, 40)}", "en", "few") for i in range(5)]
    got = {r["doc_id"]: r for r in linefreq.verdicts(odd_docs(spark, rows)).collect()}
    assert [got[i]["removed"] for i in range(12)] == [0] + [20] * 11 and all(not r["base_failed"] for r in got.values())
    assert sorted(i for i in got if not got[i]["kept"]) == [1, 2, 3, 4, 5]
    assert {r["doc_id"] for r in linefreq.keep_good(odd_docs(spark, rows)).collect()} == {i for i in got if got[i]["kept"]}
    assert linefreq.keep_good(odd_docs(spark, [])).count() == linefreq.verdicts(odd_docs(spark, [])).count() == 0


def test_interleaved_shards(spark):
    rows = [(i, f"t{i}", "en", f"s{i % 3 if i % 2 else 0}") for i in range(800)]
    got = shards.interleave(odd_docs(spark, rows), 8).collect()
    for s in range(8):
        mine = [r for r in got if r["shard"] == s]
        assert len(mine) == 100 and sorted(r["slot"] for r in mine) == list(range(100))
        for source in range(3):
            share = sum(x[3] == f"s{source}" for x in rows) / 8
            assert abs(sum(rows[r["doc_id"]][3] == f"s{source}" for r in mine) - share) <= 2
    assert len(shards.interleave(odd_docs(spark), 8).collect()) == 9 and shards.interleave(odd_docs(spark, []), 8).count() == 0


def test_interleaving_equals_plain_ranks(spark):
    """Shard, slot, size and checksum of each row, by sorting lists; also with null ids, null sources, equal rows and a hot source."""
    rng = np.random.default_rng(8)
    rows = [(int(rng.integers(0, 250)), f"é{rng.integers(3)}", "en", ["a", "a", "a", "b", None][rng.integers(5)]) for _ in range(300)] + [(None, None, "en", "a"), (None, "", "en", None)]
    digest = lambda x: hashlib.md5(x.encode()).hexdigest()
    ranked = []
    for source in ("a", "b", None):
        mine = sorted((r for r in rows if r[3] == source), key=lambda r: digest(f"17:{'null' if r[0] is None else r[0]}:{digest(r[1] or '')}"))
        ranked += [((2 * k + 1) / (2 * len(mine)), source is None, source or "", k, r) for k, r in enumerate(mine)]
    ranked.sort(key=lambda x: x[:4])
    n, expected = len(rows), []
    for at, (*_, r) in enumerate(ranked):
        shard = at * 8 // n
        text = (r[1] or "").encode()
        expected.append((r[0], len(text) + 1, zlib.crc32(text), shard, at - -(-shard * n // 8)))
    order = lambda x: tuple((v is None, v or 0) for v in x)
    got = [tuple(r[c] for c in ("doc_id", "size", "text_crc32", "shard", "slot")) for r in shards.interleave(odd_docs(spark, rows), 8).collect()]
    assert sorted(got, key=order) == sorted(expected, key=order)


@pytest.mark.parametrize("name", ["near_duplicates", "keep_first", "audio", "crf", "keep_clean", "mixture", "pack", "pages", "shards"])
def test_empty_tables_give_empty_results(spark, name):
    docs, labels = odd_docs(spark, []), spark.createDataFrame([], "doc_id long, toxic int")
    run = {
        "near_duplicates": lambda: minhash.near_duplicates(docs), "keep_first": lambda: minhash.keep_first(docs), "audio": lambda: mpegaudio.features(mpegaudio.store(docs)), "crf": lambda: crf.tag(docs, labels, F.col("doc_id") > 0),
        "keep_clean": lambda: crf.keep_clean(docs, labels, F.col("doc_id") > 0), "mixture": lambda: mixture.mix(docs, word_count(F.col("text"))), "pack": lambda: packing.pack(docs, tokenizer_path()),
        "pages": lambda: wrappers.main_texts(spark.createDataFrame([], "page_id long, url string, html string")), "shards": lambda: shards.interleave(docs),
    }
    assert run[name]().count() == 0


def test_near_duplicates_of_odd_rows(spark):
    got = minhash.near_duplicates(odd_docs(spark), 2).collect()
    assert len(got) == 9
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add((r["n_shingles"], r["component_id"], r["kept"]))
    assert by[1] == {(5, 1, True)} and by[2] == {(5, 1, False)} and by[3] == {(0, 3, True)} and by[4] == {(0, 4, True)} and by[None] == {(1, None, True)} and by[6] == {(1, 6, True)}


def write_tables(spark, folder, docs, labels):
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_whole_pipeline(spark, tmp_path):
    """Each stage on what the one before kept: toxic, short and depleted documents and copies go, frequent lines too, and the rest is mixed and packed whole."""
    import corpus_pipeline

    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 6))
    body = lambda n: " ".join(word() for _ in range(n))
    menu = "home news sport weather contact"
    rows = [(i, f"{menu}\n{body(80)}", "en", f"s{i % 2}") for i in range(120)]
    rows += [(1000 + i, f"{body(40)} vilest vilest {body(40)}", "en", "s0") for i in range(60)]
    rows += [(2000 + i, rows[3][1], "en", "s1") for i in range(4)] + [(2010, rows[5][1].rsplit(" ", 2)[0], "en", "s1")]
    rows += [(3000, "short text", "en", "s0"), (3001, None, "en", None), (3002, "", "en", "s0"), (3003, "again and so " * 50, "en", "s0")]
    labels = spark.createDataFrame([(r[0], int(1000 <= r[0] < 1060)) for r in rows], "doc_id long, toxic int")
    folder = write_tables(spark, tmp_path, odd_docs(spark, rows), labels)
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        docs = materialize(out, name)
        seen[name] = docs.collect()
    ids = {k: {r["doc_id"] for r in v} for k, v in seen.items()}
    everyone = {r[0] for r in rows}
    assert everyone - ids["toxicity"] == set(range(1000, 1060))
    good = linefreq.verdicts(odd_docs(spark, [r for r in rows if r[0] in ids["toxicity"]])).collect()
    assert ids["quality_rules"] == {r["doc_id"] for r in good if r["kept"]} == ids["toxicity"] - {3000, 3001, 3002, 3003}
    assert sum(menu in r["text"] for r in seen["quality_rules"]) == 2  # the first document of each host keeps its lines
    left = brute_components({r["doc_id"]: r["text"] for r in seen["quality_rules"]}, 5)
    assert ids["near_dedup"] == {i for i, (_, c) in left.items() if c == i} and not ids["near_dedup"] & {2000, 2001, 2002, 2003, 2010}
    texts = {r["doc_id"]: r["text"] for r in seen["near_dedup"]}
    words = {i: len(t.split()) for i, t in texts.items()}
    copies = Counter(r["doc_id"] for r in seen["mixing"])
    assert all(r["text"] == texts[r["doc_id"]] for r in seen["mixing"]) and max(copies.values()) <= 2
    assert abs(sum(n * words[i] for i, n in copies.items()) - 1.5 * sum(words.values())) < 0.03 * sum(words.values())
    packed = Counter(r["doc_id"] for r in seen["best_fit_packing"] if r["piece"] == 0)
    assert packed == copies
    assert sum(r["length"] for r in seen["best_fit_packing"]) == sum(n * (len(WHOLE.encode(texts[i], add_special_tokens=False).ids) + 1) for i, n in copies.items())


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    df = odd_docs(spark).withColumns({c: F.lit(c) for c in ("_rid", "_doc", "gone")})
    folder = write_tables(spark, tmp_path, df, spark.createDataFrame([], "doc_id long, toxic int"))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == df.columns and out.count() <= 2 * df.count()


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    folder = write_tables(spark, tmp_path, odd_docs(spark, []), spark.createDataFrame([], "doc_id long, toxic int"))
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_mixture_meets_its_targets(spark):
    rows = [(i, "w " * (1 + i % 50), "en", "abcd"[min(3, i % 7)]) for i in range(2000)]
    got = mixture.mix(odd_docs(spark, rows), word_count(F.col("text")), keep=("source",)).collect()
    total = sum(r["size"] for r in got)
    targets = {r["source"]: r["target"] for r in got}
    assert abs(sum(targets.values()) - 1.5 * total) < 1e-6 * total
    for s, t in targets.items():
        mine = [r for r in got if r["source"] == s]
        assert t <= 2 * mine[0]["source_size"] + 1e-9 and abs(sum(r["taken"] for r in mine) - t) <= 0.02 * t and all(r["taken"] <= 2 * r["size"] for r in mine)
    assert len(mixture.mix(odd_docs(spark), word_count(F.col("text"))).collect()) == 9


def test_whole_sets_stay_where_they_lie(spark):
    """Pairs go to the sets, which are dealt by class once: verifying pairs moves no row of the dealt table. Its entry in the catalogue goes with its files."""
    scratch = common.Scratch(spark, "sets-test")
    words = [(i, np.array([1, 2, 3, 4, 5 + i // 2], np.uint64).tobytes()) for i in range(8)]
    sets = scratch.deal(spark.createDataFrame(words, "cid long, words binary"), "sets", "cid", 6)
    name = scratch.dealt[0]
    pairs = spark.createDataFrame([(i, i + 1) for i in range(7)], "a long, b long")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = minhash.verify(pairs, sets, 80)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("hashpartitioning(cid") == 1 and "6 out of 6" in plan
        assert sorted(map(tuple, found.collect())) == [(0, 1), (2, 3), (4, 5), (6, 7)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        scratch.clear()
    assert not spark.catalog.tableExists(name)


def test_near_dedup_deals_texts_once(spark):
    """Neither the whole sets nor the rows that stay move a text again, even where nothing is small enough to be broadcast."""
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*words[i % 5 :], f"x{i}"]), "en", "s") for i in range(30)] + [(90, "a b c d e f", "en", "s")] * 2
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = minhash.keep_first(odd_docs(spark, rows))
        plan = left._jdf.queryExecution().executedPlan().toString()
        moved = [x for x in plan.split("\n") if "Exchange" in x and "hashpartitioning" in x]
        assert "Bucketed: true" in plan and "text#" in plan and len(left.collect()) < 31
        texts = left.sparkSession.table(next(t.name for t in spark.catalog.listTables() if t.name.startswith("rows_")))
        wanted = texts.selectExpr("monotonically_increasing_id() cid", "rid", "rid2", "cast(null as binary) fp")
        sets = minhash.whole_sets(texts, minhash.materialize(wanted, "wanted"), 5)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    # only keys are dealt: one exchange a join, on its side of keys
    assert sets.count("hashpartitioning(rid") == 1
    assert len(moved) == plan.count("SortMergeJoin")
    assert Counter(r["doc_id"] for r in left.collect())[90] == 1


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(), st.text("ab'sdZ .,!?)\n\t\r\x0b\x1c\x85\xa0\u2003\u20281é中\u0301<|>"), st.sampled_from(["<|endoftext|>", " ", "  ", "don't", "\n\n"]))))
def test_ids_of_parts_are_those_of_whole_texts(parts):
    text = "".join(parts).encode("utf-8", "replace").decode()
    assert "".join(packing.PART.findall(text)) == text
    assert packing.encoder(tokenizer_path())([text])[0].tolist() == WHOLE.encode(text, add_special_tokens=False).ids


def test_ids_of_odd_texts():
    texts = ["Hello  world's 12 ab\n\n  x\t", "Ça été – «naïve» ß ñ", "<|endoftext|>a", "中文 emoji 🎉", "a b\x00\x85", "x" * 5000, ""]
    assert [x.tolist() for x in packing.encoder(tokenizer_path())(texts)] == [WHOLE.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_that_come_again_are_encoded_once(monkeypatch):
    """Words that come in every batch are encoded once, however many others fill the memory meanwhile, and many new words are one text for the tokenizer."""
    import tokenizers

    seen = []

    class Spy:
        def __init__(self, path):
            self.real = Tokenizer.from_file(path)

        def __getattr__(self, name):
            return getattr(self.real, name)

        def encode_batch_fast(self, texts, **more):
            seen.extend(texts)
            return self.real.encode_batch_fast(texts, **more)

    Spy.from_file = Spy
    Tokenizer = tokenizers.Tokenizer
    monkeypatch.setattr(tokenizers, "Tokenizer", Spy)
    monkeypatch.setattr(packing, "REMEMBERED", 60)
    encode = packing.encoder.__wrapped__(tokenizer_path())
    for i in range(20):
        text = "a whale, " + " ".join(f"w{i}x{k}" for k in range(20)) + "  harpoon's\n end"
        assert encode([text])[0].tolist() == WHOLE.encode(text, add_special_tokens=False).ids
    assert sum("whale" in x for x in seen) == 1 and len(seen) < 20 * 4


def test_a_word_is_encoded_once_for_all_marks_after_it(monkeypatch):
    import tokenizers

    seen = []

    class Spy:
        def __init__(self, path):
            self.real = Tokenizer.from_file(path)

        def __getattr__(self, name):
            return getattr(self.real, name)

        def encode_batch_fast(self, texts, **more):
            seen.extend(texts)
            return self.real.encode_batch_fast(texts, **more)

    Spy.from_file = Spy
    Tokenizer = tokenizers.Tokenizer
    monkeypatch.setattr(tokenizers, "Tokenizer", Spy)
    encode = packing.encoder.__wrapped__(tokenizer_path())
    texts = ["a whale, whale whale. (a whale! señor señor;", "one señor? whale", "a whale$$$ señor."]
    for some in (texts, texts[:1], ["the end: whale... señor!"]):
        assert [x.tolist() for x in encode(some)] == [WHOLE.encode(t, add_special_tokens=False).ids for t in some]
    assert sum(x.count("whale") for x in seen) == sum(x.count("señor") for x in seen) == 1


def test_ids_of_words_with_marks():
    ends = [*map(chr, range(33, 127)), "''", "'s,", "n't.", ",'", "<|", "<|endoftext|>", "|>", "×", "÷", "\u0301", "\u0301.", ".\n", ".\nThe", ",,,,", "__", "ʼ."]
    words = ["a", "Whale", "señor", "Àÿ", "Ɂɏ", "ɐ", "中", "x1", "don't", "<|endoftext|>", ""]
    texts = ["of " + " ".join(w + e for e in ends) for w in words] + [f"the {w}{e}" for w in words for e in ends]
    assert [x.tolist() for x in packing.encoder.__wrapped__(tokenizer_path())(texts)] == [WHOLE.encode(t, add_special_tokens=False).ids for t in texts]


def test_texts_are_cut_in_bounded_runs(monkeypatch):
    monkeypatch.setattr(packing, "TEXTS", 3)
    monkeypatch.setattr(packing, "CHARS", 10)
    assert list(packing._runs([1, 2, 3, 4, 50, 9, 1, 1])) == [(0, 3), (3, 4), (4, 5), (5, 7), (7, 8)] and not list(packing._runs([]))


def plain_sum_of_squares(lengths, most):
    """Bins with gaps in a list; each possible place is tried and the sum of squared counts counted anew."""
    gaps, where = [], []
    for s in lengths:
        best = None
        for b, g in [*enumerate(gaps), (len(gaps), most)]:
            if g >= s:
                after = [*gaps, most] if b == len(gaps) else list(gaps)
                after[b] -= s
                counts = Counter(x for x in after if 0 < x < most)
                cost = (sum(n * n for n in counts.values()), b == len(gaps), g)
                best = min(best, (cost, -b)) if best else (cost, -b)
        b = -best[1]
        gaps = [*gaps, most] if b == len(gaps) else gaps
        where.append((most - gaps[b], gaps[b]))
        gaps[b] -= s
    return where, len(gaps)


@pytest.mark.parametrize("most", [7, 20, 64])
def test_sum_of_squares_equals_trying_each_place(most):
    """Equal offsets of all pieces and equally many bins; bins with one gap are exchangeable."""
    rng = np.random.default_rng(most)
    for _ in range(4):
        lengths = rng.integers(1, most + 1, 70)
        where, offset = packing.sum_of_squares(lengths, most)
        plain, bins = plain_sum_of_squares(lengths.tolist(), most)
        assert offset.tolist() == [at for at, _ in plain] and where.max() + 1 == bins


def test_packing_wastes_little(spark):
    """Against the bound of all ids over the length of a sequence."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 900, int(rng.lognormal(5, 1)))), "en", "s") for i in range(600)]
    got = packing.pack(odd_docs(spark, rows), tokenizer_path()).collect()
    bound = -(-sum(r["length"] for r in got) // 1024)
    assert bound <= len({r["sequence_id"] for r in got}) <= 1.02 * bound
    ids = {i: [*WHOLE.encode(t, add_special_tokens=False).ids, 2] for i, t, *_ in rows}
    for r in got:
        piece = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert r["ids_crc32"] == zlib.crc32(piece.tobytes()) and (len(ids[r["doc_id"]]) > 1024 or r["piece"] == 0)
    assert packing.pack(odd_docs(spark, []), tokenizer_path()).count() == 0


def test_packing(spark):
    got = packing.pack(odd_docs(spark), tokenizer_path(), most=64).collect()
    assert sum(r["piece"] == 0 for r in got) == 9
    for s in {r["sequence_id"] for r in got}:
        at = 0
        for r in sorted((r for r in got if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    long = sorted((r for r in got if r["doc_id"] == 6), key=lambda r: r["piece"])
    assert all(r["length"] == 64 for r in long[1:]) and all(b["start"] == a["start"] + a["length"] for a, b in itertools.pairwise(long))


def test_wrappers_read_articles(spark):
    page = lambda i, n: f"<html><head><title>t</title></head><body><nav><ul>{'<li><a href=x>l</a>' * n}</ul></nav><article><h1>T{i} &amp; u</h1>{'<p>p <b>q</b>r' * n}</article><div class='comments'><p>no</p></div><footer>f</footer>"
    rows = [(i, f"http://h{i % 2}/x", page(i, 1 + i % 4)) for i in range(8)] + [(8, None, None), (9, "u", ""), (10, "http://h0/", "<p>a <br")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in wrappers.main_texts(df).collect()}
    assert all(got[i] == "\n\n".join([f"T{i} & u"] + ["p qr"] * (1 + i % 4)) for i in range(8)) and got[8] == got[9] == ""
    tree = json.loads(next(r["wrapper"] for r in wrappers.wrappers(df).collect() if r["host"] == "h1"))
    assert ")+" in wrappers.expression(tree) and "#PCDATA" in wrappers.expression(tree)


def test_class_words_do_not_drop_article_texts(spark):
    body = "<p class='menu'>one</p><p class='side'>two <math><mi>x</mi><mo>=</mo><mn>1</mn></math> end</p><div class='share'>no</div><blockquote class='legal'>three</blockquote>"
    rows = [(i, "http://h/", f"<body><p class='menu'>no</p><article><h1>T{i}</h1>{body}</article>") for i in range(2)] + [(9, "http://bare/", "<body><p class='copyright'>no</p><p>yes</p></body>")]
    got = {r["page_id"]: r["text"] for r in wrappers.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{i: f"T{i}\n\none\n\ntwo x=1 end\n\nthree" for i in range(2)}, 9: "yes"}


def test_keys_that_return_keep_their_texts(spark):
    page = lambda i: f"<body><article><div><p>text{i} <a href=x>link{i}</a></p></div><h2>head{i}</h2><div><p><img src=x></p></div></article>"
    df = spark.createDataFrame([(i, "http://h/", page(i)) for i in range(4)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in wrappers.main_texts(df).collect()}
    assert got == {i: f"text{i} link{i}\n\nhead{i}" for i in range(4)}


def test_quality_stage_removes_the_lines_of_what_it_keeps(spark):
    from corpus_pipeline import quality_rules

    own = lambda i: " ".join(f"own{chr(97 + i // 26)}{chr(97 + i % 26)}{'x' * j}" for j in range(60))
    last = lambda i: f"last of {chr(97 + i // 26)}{chr(97 + i % 26)}"
    rows = [(i, f"{own(i)}\nShare this page\n{last(i)}", "en", "h") for i in range(40)] + [(100, "Share this page\n" * 40, "en", "h"), (101, None, "en", "h")]
    got = {r["doc_id"]: r for r in quality_rules(spark, odd_docs(spark, rows), "").collect()}
    assert set(got) == set(range(40)) and got[0]["text"] == rows[0][1] and got[7]["key"] == "clash"
    assert all(got[i]["text"] == f"{own(i)}\n{last(i)}" for i in range(1, 40))


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<div class=content>{}</div>", "{}"])
def test_texts_that_a_host_repeats_are_no_article(spark, wrap):
    notice = "This notice of our house stands on every page of the host, word by word, and is longer than eighty characters."
    inner = lambda i: f"<h1>T{i}</h1><p>Share this</p><p>own{i} <b>Note</b> <i>it</i></p><p>{notice}</p><p>seen on two</p><div>Sponsored</div>".replace("seen on two", "seen on two" if i < 2 else f"own too{i}")
    rows = [(i, "http://h/", f"<body>{wrap.format(inner(i))}") for i in range(4)] + [(10 + i, "http://copies/", "<body>" + wrap.format("<p>one</p><p>and the same</p>")) for i in range(5)]
    got = {r["page_id"]: r["text"] for r in wrappers.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"T{i}\n\nown{i} Note it\n\n" + ("seen on two" if i < 2 else f"own too{i}") for i in range(4))
    assert all(got[10 + i] == "one\n\nand the same" for i in range(5))


def test_constants_are_tokens_of_the_expression(spark):
    """A host's expression holds its constants and drops them; that of one page alone cannot know them."""
    page = lambda i: f"<body><article><h1>T{i}</h1>{f'<h2>part{i}</h2>' * (i % 2)}<p>own{i}</p><p>Read our <i>terms</i></p></article>"
    df = spark.createDataFrame([(i, "http://h/", page(i)) for i in range(6)], "page_id long, url string, html string")
    tree = json.loads(wrappers.wrappers(df).collect()[0]["wrapper"])
    said = wrappers.expression(tree)
    assert "Read our" in said and "terms" in said and "#PCDATA" in said and "</h2>)?" in said
    whole, alone = wrappers.nested(tree), wrappers.infer(wrappers.parse(page(0)))
    texts = [wrappers.extract(wrappers.parse(page(0)), *wrappers.slots(w, 0)) for w in (whole, alone)]
    assert texts == ["T0\n\nown0", "T0\n\nown0\n\nRead our terms"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=40), st.lists(st.sampled_from("abcd"), max_size=40), st.sampled_from([1 << 29, 4]))
def test_aligned_rows_have_a_longest_common_subsequence(a, b, bits):
    with pytest.MonkeyPatch.context() as m:
        m.setattr(wrappers, "TABLE_BITS", bits)
        pairs = wrappers._common(a, b)
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    assert len(pairs) == best[-1][-1] and all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(pairs))


def test_groups_of_any_length_are_found():
    keys = [f"k{i}" for i in range(7)]
    for times in (2, 40):
        row = [{"k": k, "q": "1", "c": []} for k in keys * times]
        found = wrappers._run(wrappers._fold(row))
        assert len(found) == 1 and found[0]["q"] == "+" and [x["k"] for x in found[0]["c"]] == keys


@pytest.mark.parametrize("source", ["<a " + "x" * 40 + '"', "<p " * 400_000, '<a ">"' * 150_000, "<a '" * 250_000 + ">", '<a href="x' * 100_000, "<![CDATA[" * 100_000, "<script" * 150_000, "</" * 500_000, "a < b " * 200_000, "<b><i>" * 100_000 + "x"], ids=range(10))
def test_broken_pages_are_read_in_one_go(source):
    began = time.monotonic()
    page = wrappers.parse("<body><article>" + source)
    wrappers.blocks(page)
    assert time.monotonic() - began < 20


def test_tags_with_open_quotes_end_at_their_sign():
    page = wrappers.parse("<article><p title='a > b'>one</p><p title=\"x>two</p><p>three</p></article>")
    assert [text for _, text, _ in wrappers.blocks(page)] == ["one", "two", "three"]


@pytest.mark.parametrize(("start", "end"), [("<div>", "</div>"), ("<b>", ""), ("<ul><li>", "</li></ul>")])
def test_pages_of_thousands_of_nested_elements(spark, start, end):
    deep = lambda i, n: f"<body><article><h1>T{i}</h1>{start * n}deep{i}{end * n}</article>"
    rows = [(i, "http://h/", deep(i, 4000 + i)) for i in range(3)] + [(i, "http://flat/", f"<body>{start * 3000}x{i}{end * 3000}") for i in (3, 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = {r["page_id"]: r["text"] for r in wrappers.main_texts(df).collect()}
    assert all(got[i] == f"T{i}\n\ndeep{i}" for i in range(3)) and got[3] == "x3" and got[4] == "x4"
    assert all("#PCDATA" in wrappers.expression(json.loads(r["wrapper"])) for r in wrappers.wrappers(df).collect())

"""Line dedup, collocations and ranked search against brute force and odd rows; mended samples, offsets and dealing."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import collocations, crf, langid, lexsearch, linededup, minhash, packing, shards
from spanloom.llm.queries import tokenizer_path

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, row string, gone string, lines string, a long, node string"


def docs(spark, rows):
    """Rows (doc_id, text, lang) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, g, "s", "row", "gone", "lines", 1, "node") for i, t, g in rows], DOCS)


# Line dedup


def brute_lines(rows, enough=5, least=40):
    def key(x):
        return x.strip(" \t\n\x0b\x0c\r").translate(LOWER)

    held = defaultdict(set)
    for i, t, _ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                held[key(x)].add(i)
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held[key(x)]) >= enough and i != max(held[key(x)], key=lambda d: (d is not None, d)))]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def line_rows():
    rng = random.Random(3)
    shared = [f"{c * 4} shared line number {n} that is long enough" for n, c in enumerate("aBcDéÉ")]
    rows = []
    for i in range(60):
        lines = [f"own line {i} {k} " + "x" * rng.randrange(60) for k in range(rng.randrange(4))]
        for s in rng.sample(shared, rng.randrange(4)):
            lines += [rng.choice(["", " ", "\t\r"]) + (s.upper() if rng.random() < 0.3 and s.isascii() else s) + rng.choice(["", " ", "\x0b"])] * rng.randrange(1, 3)
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), "en"))
    edge = "e" * 39
    rows += [(100 + i, edge + "\n" + edge + "f", None) for i in range(5)]  # 39 and 40 code points
    rows += [(200 + i, "z" * 50, None) for i in range(4)]  # four documents only
    rows += [(300, "y" * 45, None)] * 7  # one document, repeated
    return rows + [(400, None, None), (401, "", None), (402, "\n\n", None), (None, shared[0], None), (None, "y" * 45, None), (500, "w" * 100_000 + "\n" + shared[1], None)]


def test_lines_equal_brute_force(spark):
    rows = line_rows()
    got = sorted((tuple(r) for r in linededup.report(docs(spark, rows)).collect()), key=str)
    assert got == brute_lines(rows) and sum(r[2] for r in got) > 50


@pytest.mark.parametrize("batches", [1, 5])
def test_runs_do_not_depend_on_batches(spark, batches):
    rows = line_rows()
    got = sorted((tuple(r) for r in linededup.report(docs(spark, rows).repartition(3), batches=batches, enough=3, least_chars=10).collect()), key=str)
    assert got == brute_lines(rows, 3, 10)


def test_runs_are_merged_where_they_lie(spark):
    before = {t.name for t in spark.catalog.listTables()}
    runs = linededup.LineRuns(spark, enough=5)
    for n in (3, 3, 3):
        runs.add(spark.createDataFrame([(i, -i) for i in range(50) for _ in range(n)], "a long, b long"))
    x, y = (spark.table(n) for n in runs._runs())
    plan = x.join(y.hint("merge"), ["a", "b"], "full")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    # after two batches all hashes have six uses, so the third adds none
    assert y.count() + x.count() == 50 and runs.often().count() == 50
    runs.clear()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_documents_without_their_lines(spark):
    rows = [(i, f"mine {i}\n" + "s" * 44, "en") for i in range(5)] + [(9, None, None), (10, "", None)]
    left = linededup.dedup(docs(spark, rows)).collect()
    assert {r["doc_id"]: r["text"] for r in left} == {**{i: f"mine {i}" for i in range(4)}, 4: "mine 4\n" + "s" * 44, 9: None, 10: ""}
    assert {(r["row"], r["gone"], r["lines"], r["a"]) for r in left} == {("row", "gone", "lines", 1)}
    assert linededup.report(docs(spark, [])).collect() == [] and linededup.dedup(docs(spark, [])).columns == [c.split()[0] for c in DOCS.split(", ")]


# Collocations


def brute_phrases(rows, least=10, cover=50, most=2000):
    f, n = defaultdict(Counter), Counter()
    for _, t, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (t or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        scored = []
        for g, a in found.items():
            score, cut = min((10**6 * a * a // (c[g[:k]] * c[g[k:]]), k) for k in range(1, len(g)))
            if not any(len(h) > len(g) and 100 * b >= cover * a and any(h[i : i + len(g)] == g for i in range(len(h))) for h, b in found.items()):
                scored.append((-score, -a, " ".join(g).encode(), c[g[:cut]], c[g[cut:]]))
        for r, (s, a, g, left, right) in enumerate(sorted(scored)[:most], 1):
            out.append((lang, r, g.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def phrase_rows():
    rng = random.Random(4)
    words = ["The", "cat", "sat", "on", "mat", "é", "São", "x#1", "of", "a"]
    rows = []
    for i in range(150):
        text = []
        for _ in range(rng.randrange(6)):
            text.append(rng.choice(["new york city hall", "the cat sat", "a b c d e f g", "of of of of", "ring one two ring one two"]) if rng.random() < 0.6 else " ".join(rng.choices(words, k=rng.randrange(1, 7))))
        rows.append((i, rng.choice([". ", "\n", ", ", " ", "\t"]).join(text), rng.choice(["en", "en", "fr", None, "a\nb"])))
    rows += [(900 + i, "long " + " ".join(f"u{k}" for k in range(40)) + " tail", "en") for i in range(12)]
    return rows + [(1, None, "en"), (2, "", None), (3, "...\n;", "de"), (4, "one", "de"), (5, "\x00 \x1f \x85 \xa0", "de")] + [(6, "same row here", "de")] * 11


@pytest.mark.parametrize("most", [2000, 5])
def test_phrases_equal_brute_force(spark, monkeypatch, most):
    rows = phrase_rows()
    monkeypatch.setattr(collocations, "CHUNK", 100)
    got = sorted(tuple(r) for r in collocations.phrases(docs(spark, rows).repartition(3), most=most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == brute_phrases(rows, most=most) and len(got) >= 20


def test_unary_paths_are_compacted(spark):
    long = "long " + " ".join(f"u{k}" for k in range(40)) + " tail"
    found = {" ".join(r["words"]): r["n"] for r in collocations.long_phrases(docs(spark, phrase_rows())).where("lang = 'en'").collect()}
    assert found[long] == 12  # 40 edges, one row
    loop = [(i, "p q r p q r p q r p q r", "en") for i in range(10)]
    ring = collocations.long_phrases(docs(spark, loop)).collect()
    assert {tuple(r["words"]): r["n"] for r in ring} == {("p", "q", "r"): 40, ("q", "r", "p", "q"): 30}


def test_flows_give_the_counts_of_shorter_phrases(spark):
    rows = phrase_rows()
    g = collocations.graph(docs(spark, rows), 1)
    want = defaultdict(Counter)
    for _, t, lang in rows:
        for piece in re.split("[.,;:!?\n-\r]", (t or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            want["und" if lang is None else lang].update(" ".join(w[i : i + 2]) for i in range(len(w) - 1))
    flows = {(r["lang"], r["node"]): r["flow"] for r in g.where("is_node and instr(node, ' ') > 0").collect()}
    assert flows == {(lang, p): n for lang, c in want.items() for p, n in c.items()}


def test_exact_scores_beyond_64_bits(spark):
    a, l, r = 3 * 10**14, 4 * 10**14, 5 * 10**14
    row = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(collocations._score(F.col("a"), F.col("l"), F.col("r"))).first()[0]
    assert row == 10**6 * a * a // (l * r)


def test_vocabularies_too_large_for_packed_numbers(monkeypatch):
    ids = np.array([1, 2, 1, 2, 0, 3, 0, 0, 1])
    words = [b"\n", b"a", b"b", b"c"]
    plain = collocations._grams("x", words, ids).to_pydict()
    monkeypatch.setattr(collocations, "PACK_BITS", 1)
    assert collocations._grams("x", words, ids).to_pydict() == plain
    assert set(zip(plain["node"], plain["last"], plain["n"], strict=True)) == {("a b", "a", 1), ("b a", "b", 1), ("a b", None, 1), ("c", None, 1), ("a", None, 1)}


def test_phrases_of_an_empty_table(spark):
    assert collocations.phrases(docs(spark, [])).collect() == []


# Ranked search


def brute_search(rows, items, k=10):
    def terms(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))

    held = [(i, Counter(terms(t))) for i, t, _ in rows]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    total, df = sum(n for _, _, n in held), Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in set(items):
        found = []
        for i, c, n in held:
            m = 100 - 75 + 75 * n * len(held) // total
            s = sum(math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if s > 0:
                found.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def search_rows():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)] + ["É", "straße", "中文", "A1"]
    p = 1 / np.arange(1, len(words) + 1)
    rows = [(int(i), " ".join(rng.choice(words, rng.integers(1, 60), p=p / p.sum())) + rng.choice(["", "!", "\x00x"]), "en") for i in range(700)]
    rows += [(1000, "w1 w2", "en")] * 3 + [(None, "w1 w2", None), (1001, None, None), (1002, "", None), (1003, "--", None), (1004, "w3 " * 30_000, None)] + [(2000 + i, "tie tie", None) for i in range(30)]
    items = [(i, " ".join(rng.choice(words, rng.integers(1, 20)))) for i in range(40)] + [(50, "tie"), (51, None), (52, ""), (53, "unknown"), (54, "W1 w1 w1"), (55, "w5"), (55, "w6"), (56, "w7"), (56, "w7"), (57, "-")]
    return rows, items


@pytest.mark.parametrize("sizes", [(32, 16, 8, 4096, 512), (2, 2, 2, 50, 7)])
def test_ranks_equal_brute_force(spark, monkeypatch, sizes):
    for name, value in zip(("LEAF", "BRANCH", "GROUP", "SLICE", "BLOCK"), sizes, strict=True):
        monkeypatch.setattr(lexsearch, name, value)
    rows, items = search_rows()
    table = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, score int")
    got = sorted((tuple(r) for r in lexsearch.rank(docs(spark, rows).repartition(3), table).select("item_id", "rank", "doc_id", "score").collect()), key=str)
    want = brute_search(rows, [x for x in items if x[1] is not None])
    assert got == want


def test_trees_leave_out_most_documents():
    rng = np.random.default_rng(6)
    n, n_terms = 4096, 500
    topics = rng.integers(0, 50, n)
    term = np.array([t * 10 + k for t in topics for k in rng.permutation(10)[:4]])
    ptr, value = np.arange(n + 1) * 4, rng.integers(1, 1000, 4 * n)
    items = lexsearch.Items()
    for i in range(5):
        items.vectors.append([(i * 10 + k, 1) for k in range(10)])
    items.vocabulary = {str(i).encode(): i for i in range(n_terms)}
    best = lexsearch.Best(5, 10)
    compared = lexsearch.search_slice(best, items.tree(np.full(n_terms, 3)), np.arange(n), np.zeros(n, bool), ptr, term, value, n_terms)
    assert compared < n / 5 and len(best.doc) == 50
    for i in range(5):
        scores = {d: 3 * value[ptr[d] : ptr[d + 1]][term[ptr[d] : ptr[d + 1]] // 10 == i].sum() for d in range(n)}
        assert [int(d) for d in best.doc[best.item == i]] == sorted(scores, key=lambda d: (-scores[d], d))[:10]


def test_sums_are_exact_beyond_doubles():
    at, values = np.array([0, 1, 0, 1]), np.array([2**61 + 1, 5, 2**60 + 1, 7])
    assert lexsearch.exact_sums(at, values, 2).tolist() == [2**61 + 2**60 + 2, 12]


def test_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a")], "item_id long, text string")
    full = docs(spark, [(1, "a", None)])
    assert lexsearch.rank(full, none).collect() == [] and lexsearch.rank(docs(spark, []), some).collect() == [] and [tuple(r)[1:3] for r in lexsearch.rank(full, some).collect()] == [(1, 1)]


# Samples, offsets, dealing


def test_languages_of_one_repeated_text_are_learnt(spark):
    languages = [f"l{i}" for i in range(12)]
    rows = spark.range(24_000).selectExpr("id doc_id", "concat('text of language ', id % 12) text", "concat('l', id % 12) lang")
    texts, names = langid.sample(rows, F.lit(True), 240, 20, 32_000_000)
    assert sorted(names) == sorted(languages) and len(set(texts)) == 12


def test_large_texts_come_last_in_a_language(spark):
    rows = [(i, f"short {i}", "a") for i in range(5)] + [(9, "long " * 1000, "a"), (10, "only " * 1000, "b")]
    texts, names = langid.sample(docs(spark, rows), F.lit(True), 100, 20, 400)
    assert sorted((n, len(t)) for t, n in zip(texts, names, strict=True)) == [("a", 7)] * 5 + [("b", 5000)]


def naive_scores(model, text):
    """Averaged embeddings of all subwords, one at a time."""
    total, n = np.zeros(len(model.languages)), 0
    codes = [32 if c == 32 or 9 <= c <= 13 else c for c in map(ord, text.lower())]
    for start in range(len(codes)):
        h = 0
        for size in (1, 2, 3, 4):
            if start + size > len(codes):
                break
            h = (h ^ codes[start + size - 1]) * 0x9E3779B1 & 0xFFFFFFFF
            h ^= h >> 15
            bucket = ((h + (size * 0x85EBCA6B & 0xFFFFFFFF)) * 0xC2B2AE35 & 0xFFFFFFFF) >> 32 - langid.BUCKET_BITS
            total += model.table[:, bucket]
            n += 1
    return (total / max(n, 1) + model.bias) / model.temperature


def test_scores_equal_a_naive_softmax():
    texts = [f"the cat {i} sat" for i in range(30)] + [f"le chat {i} était" for i in range(30)]
    model = langid.train(texts, ["en"] * 30 + ["fr"] * 30)
    for text in ("the dog", "été", "x", "a\tb"):
        assert np.allclose(langid.scores(model, [text])[0], naive_scores(model, text), atol=1e-3)


def test_offsets_where_lower_case_is_longer():
    text = "İstanbul İ idiot here"
    words = crf.tokens(text)
    p = np.array([0.9 if w == "idiot" else 0.0 for w in words])
    assert len(words) == 4 and [text[a:b] for a, b in crf.spans(text, p)] == ["idiot"]


def test_one_large_text_does_not_cost_its_class(spark):
    rows = [(i, f"clean {i}", None) for i in range(20)] + [(100 + i, f"idiot {i}", None) for i in range(20)] + [(50, "big " * 2000, None)]
    labels = spark.createDataFrame([(i, int(100 <= i)) for i, _, _ in rows], "doc_id long, toxic int")
    texts, toxic, _ = crf.sample(docs(spark, rows), labels, F.lit(True), 100, 2000)
    assert Counter(toxic) == {0: 20, 1: 20} and max(map(len, texts)) < 20
    texts, toxic, _ = crf.sample(docs(spark, [r for r in rows if r[0] >= 50]), labels, F.lit(True), 100, 2000)
    assert Counter(toxic) == {0: 1, 1: 20}


def test_repeated_rows_are_packed_in_many_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "PER_GROUP", 1000)
    rows = spark.range(20_000).selectExpr("cast(1 as bigint) doc_id", "'a b' text").coalesce(2)
    groups = packing.pack(rows, tokenizer_path()).groupBy(F.floor(F.col("sequence_id") / F.lit(2.0**32)).alias("g")).agg(F.count("*").alias("n")).collect()
    assert len(groups) == 20 and max(r["n"] for r in groups) < 1400


def test_rows_without_ids_spread_over_buckets(spark, monkeypatch):
    seen = []
    plain = shards.ranked
    monkeypatch.setattr(shards, "ranked", lambda rows, by, bucket, *more: (seen.append(rows.select(bucket).distinct().count()), plain(rows, by, bucket, *more))[1])
    rows = spark.range(2000).selectExpr("cast(null as bigint) doc_id", "concat('t', id) text", "'s' source")
    out = shards.interleave(rows, 4).collect()
    assert seen[0] > 40 and Counter(r["shard"] for r in out) == dict.fromkeys(range(4), 500)


def test_kept_rows_need_both_keys(spark):
    left = minhash.keep_first(docs(spark, [(1, "a b c d e f", None), (2, "a b c d e f", None), (2, "a b c d e f", None), (3, "x y z u v w", None), (3, "x y z u v w", None)]))
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 3]

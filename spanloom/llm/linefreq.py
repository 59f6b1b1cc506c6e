"""Quality rules from cross-document line frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize, row_keys

SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once a row however often body names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Array of the words of a text; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), 0)


def repeated_words(words: Column, window: int = 3) -> Column:
    """How many words lie in windows of `window` words that the text has twice or more. Windows are hashed and sorted with their places; equal neighbours give the places of repeated windows, each of which covers the words up to the next place, `window` at most."""

    def hashes(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - window)
        return F.transform(at, lambda i: F.struct(F.xxhash64(*(F.get(w, i + k) for k in range(window))).alias("h"), i.alias("i")))

    def places(s: Column) -> Column:
        same = lambda x, i, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, i, i - 1) | same(x, i, i + 1)), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        each = F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - x, F.lit(window))))
        return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)

    full = let(F.sort_array(hashes(words)), lambda s: let(places(s), covered))
    return F.when(F.size(words) < window, F.lit(0).cast("long")).otherwise(full)


def base_metrics(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text; all 0 for null."""
    text = F.coalesce(text, F.lit(""))
    full_lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    measured = let(
        words_of(text),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")),
    )
    lines = let(full_lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    return {
        "measured": measured,
        "word_chars": F.length(F.regexp_replace(text, SPACE, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": lines,
    }


def normalised(line: Column) -> Column:
    """A line in lower case, digits as 0, runs of white space as one space, trimmed."""
    spaced = F.regexp_replace(F.lower(line), SPACE, " ")
    return F.trim(F.regexp_replace(spaced, "[0-9]", "0"))


def host_lines(docs: DataFrame, **more: Column) -> DataFrame:
    """A written table with a row for each row of docs (doc_id, text, source): its keys row_a and row_b, doc_id, source, doc (two keys of the document), the columns in `more`, and lines: for each line with a word the two keys of its host and normalised form, its number from 0 and its words. All counts read this table, so texts are read once."""
    numbered = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("pos")))
    full = F.filter(numbered, lambda l: l["x"].rlike(WORD))

    def keys(x: Column) -> Column:
        return F.struct(F.xxhash64("source", x).alias("a"), F.xxhash64(x, "source").alias("b"))

    counted = F.transform(full, lambda l: F.struct(keys(normalised(l["x"])).alias("key"), l["pos"].alias("pos"), F.regexp_count(l["x"], F.lit(WORD)).alias("words")))
    a, b = row_keys("doc_id", "source", "text")
    doc = F.when(F.col("doc_id").isNull(), F.struct(a.alias("a"), b.alias("b"))).otherwise(F.struct(F.col("doc_id").cast("long").alias("a"), F.lit(0).cast("long").alias("b")))
    rows = docs.select(a.alias("row_a"), b.alias("row_b"), F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), doc.alias("doc"), *[c.alias(k) for k, c in more.items()], counted.alias("lines"))
    return materialize(rows, "host-lines")


def removed_lines(lined: DataFrame, most_docs: int, most_percent: int) -> DataFrame:
    """row_a, row_b, removed (words), gone (numbers of lines) of each row of host_lines' table that loses lines.

    A line goes if more than most_docs documents of its host have it, and more than most_percent percent of the host's documents; the
    host's document with the least doc_id keeps it, so that of a group of copies, however large, one stays whole. Lines are
    first counted as often as they occur, which only preselects, with partial sums; the few that remain are counted by
    document. Null hosts are one host.
    """
    lines = lined.select("row_a", "row_b", "doc", "source", F.explode("lines").alias("l")).select("row_a", "row_b", "doc", "source", "l.*")
    often = materialize(lines.groupBy("key").agg(F.count("*").alias("uses")).where(F.col("uses") > most_docs).select("key"), "often")
    held = materialize(lines.join(often, "key").dropDuplicates(["row_a", "row_b", "pos"]), "held")
    hosts = lined.groupBy(F.col("source").alias("host")).agg(F.count_distinct("doc").alias("all_docs"))
    counts = held.groupBy("key").agg(F.count_distinct("doc").alias("docs"), F.min("doc").alias("first"), F.first("source").alias("source"))
    many = counts.where(F.col("docs") > most_docs).join(hosts, F.col("source").eqNullSafe(F.col("host"))).where(100 * F.col("docs") > most_percent * F.col("all_docs"))
    frequent = materialize(many.select("key", "first"), "frequent")
    gone = held.join(frequent, "key").where(F.col("doc") != F.col("first"))
    return gone.groupBy("row_a", "row_b").agg(F.sum("words").alias("removed"), F.array_sort(F.collect_set("pos")).alias("gone"))


def verdicts(docs: DataFrame, most_docs: int = 5, most_percent: int = 1, least_left: int = 75) -> DataFrame:
    """Per row of docs (doc_id, text, source): doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed, kept.

    base_failed: fewer than 50 words, or over half of them in windows of three words that the text repeats. Else a
    document is rejected if under least_left percent of its words remain once its host's frequent lines are gone (see
    removed_lines). Null and empty texts have no words and fail. A null doc_id stands for a document of its own. Repeated rows count as
    one document and get equal results. Other columns are ignored. An empty table gives an empty result.
    """
    lined = host_lines(docs, **base_metrics(F.col("text")))
    lost = materialize(removed_lines(lined, most_docs, most_percent).select("row_a", "row_b", "removed"), "lost")
    base = lined.select("row_a", "row_b", "doc_id", "measured.n_words", "word_chars", "n_symbols", "n_dup_lines", "measured.n_repeat_words")
    out = base.join(lost, ["row_a", "row_b"], "left").withColumn("removed", F.coalesce("removed", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~failed & (100 * (F.col("n_words") - F.col("removed")) >= least_left * F.col("n_words")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed", "kept")


def _without_lines(docs: DataFrame, known: DataFrame, how: str) -> DataFrame:
    """docs joined with known (row_a, row_b, gone: numbers of the lines to take out, or null), and those lines taken out. Texts are dealt by their rows' keys once, whatever the size of `known`, which no bound holds."""
    a, b = row_keys("doc_id", "source", "text")
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.col("text").alias("text"), a.alias("row_a"), b.alias("row_b"))
    found = rows.join(known.hint("merge"), ["row_a", "row_b"], how)
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(left)
    return found.select(*(text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


def keep_good(docs: DataFrame, most_docs: int = 5, most_percent: int = 1, least_left: int = 75) -> DataFrame:
    """The rows of docs that verdicts keeps, with all their columns, their hosts' frequent lines taken out of the texts. Null, empty and short texts go, as verdicts says; of repeated rows all are kept or none; an empty table gives an empty result."""
    measured = let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    lined = host_lines(docs, measured=measured)
    lost = materialize(removed_lines(lined, most_docs, most_percent), "lost")
    good = lined.where("measured.n_words >= 50 and 100 * measured.n_repeat_words <= 50 * measured.n_words").select("row_a", "row_b", "measured.n_words").dropDuplicates(["row_a", "row_b"])
    known = good.join(lost, ["row_a", "row_b"], "left").where(100 * (F.col("n_words") - F.coalesce("removed", F.lit(0))) >= least_left * F.col("n_words"))
    return _without_lines(docs, materialize(known.select("row_a", "row_b", "gone"), "good"), "inner")


def remove_lines(docs: DataFrame, most_docs: int = 5, most_percent: int = 1) -> DataFrame:
    """docs with their hosts' frequent lines taken out of the texts; see removed_lines. Null texts stay null."""
    return _without_lines(docs, materialize(removed_lines(host_lines(docs), most_docs, most_percent), "lost"), "left")

"""The numbered corpus queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, crf, langid, lexsearch, linededup, linefreq, minhash, mixture, mpegaudio, packing, shards, warc, wrappers
from .common import documents, word_count


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def crc_mod(n: int) -> Column:
    """crc32 of doc_id as text, mod n; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records in ZIP packages and read back by ranges."""
    return warc.round_trip(spark, pages(spark, sf_dir)).drop("url")


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of all documents by two-word shingles at a similarity of 0.8."""
    return minhash.near_duplicates(documents(spark, sf_dir), size=2, percent=80).drop("rid", "rid2")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learnt from those whose checksum mod 5 is not 0."""
    return langid.identify(documents(spark, sf_dir), crc_mod(5) != 0)


def op4_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality metrics and verdicts of all documents; their source is the host."""
    return linefreq.verdicts(documents(spark, sf_dir)).drop("removed")


def op5_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts carried by audio frames and read back."""
    return mpegaudio.features(mpegaudio.store(documents(spark, sf_dir)))


def op6_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all pages by their hosts' wrappers."""
    return wrappers.main_texts(pages(spark, sf_dir))


def op7_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from labels of those whose checksum mod 4 is not 2."""
    out = crf.tag(documents(spark, sf_dir), labels(spark, sf_dir), crc_mod(4) != 2)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "spans")


def op8_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of the same mixture; the law is `rows`."""
    out = shards.interleave(documents(spark, sf_dir), 8)
    return out.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def op9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the weights 3, 1, 2 of their sources, 150 % of all words."""
    return mixture.mix(documents(spark, sf_dir), word_count(F.col("text"))).drop("copies")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that five or more of them share, but in the last of them."""
    return linededup.report(documents(spark, sf_dir))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-k by contract: each language's 2000 best phrases of all documents."""
    return collocations.phrases(documents(spark, sf_dir))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-k by contract: the ten best documents of each benchmark item."""
    return lexsearch.rank(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_warc_zip, op2_minhash_dedup, op3_language_id, op4_line_frequency, op5_mpeg_audio, op6_wrapper_extraction, op7_crf_toxicity, op8_interleaved_shards, op9_mixture, op10_best_fit_packing, op11_line_dedup, op12_collocations, op13_lexical_search)
    return {f.__name__: f for f in found}


_OP4 = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, string_split(text, chr(10)) AS l FROM d),
g AS (SELECT *, list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2])) AS g,
        list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS full_lines FROM w),
pos AS (SELECT doc_id, unnest(g) AS g, unnest(range(1, len(g) + 1)) AS i FROM g),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM pos) WHERE c > 1),
rep AS (SELECT doc_id, sum(least(3, coalesce(nxt - i, 3)))::BIGINT AS n_repeat_words FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY doc_id),
base AS (SELECT g.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(full_lines) - len(list_distinct(full_lines)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM g LEFT JOIN rep USING (doc_id)),
lines AS (SELECT doc_id, source, unnest(full_lines) AS x FROM g),
norm AS (SELECT doc_id, source, trim(regexp_replace(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]', '0', 'g'), ' ') AS x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n FROM lines),
hosts AS (SELECT source, count(DISTINCT doc_id) AS docs FROM documents GROUP BY source),
many AS (SELECT source, x, min(doc_id) AS first, count(DISTINCT doc_id) AS docs FROM norm GROUP BY source, x HAVING count(DISTINCT doc_id) > 5),
often AS (SELECT m.source, x, first FROM many m JOIN hosts h ON m.source IS NOT DISTINCT FROM h.source WHERE 100 * m.docs > h.docs),
lost AS (SELECT n.doc_id, sum(n.n) AS removed FROM norm n JOIN often o ON n.x = o.x AND n.source IS NOT DISTINCT FROM o.source WHERE n.doc_id <> o.first GROUP BY n.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT f.*, NOT base_failed AND 100 * (n_words - coalesce(removed, 0)) >= 75 * n_words AS kept FROM f LEFT JOIN lost USING (doc_id)
"""

#: Five hexadecimal digits are four characters of base 32.
_OP1 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
r AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, array_to_string(list_transform(range(8), lambda k: list_reduce(list_transform([15, 10, 5, 0],
    lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 1 + 5 * k, 5))::BIGINT >> b) & 31)::INT + 1, 1)), lambda x, y: x || y)), '') AS payload_digest, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM r
"""

#: All pairs with a shingle in common: for a small table.
_OP2 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id)
SELECT id AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(root) AS component_id, id = min(root) AS kept FROM r LEFT JOIN n ON n.doc_id = id GROUP BY id
"""

_DRAWS = ", ".join(f"('0x' || substr(md5('17:{i}:' || coalesce(doc_id::VARCHAR, 'null')), {1 + 8 * j}, 8))::BIGINT" for i in range(8) for j in range(4))

_OP9 = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS position FROM s),
c AS (SELECT *, (CASE position % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM p),
b AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        sum(weight) OVER (ORDER BY cap / weight, position ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(source_size) OVER () AS total FROM c),
l AS (SELECT *, total::DOUBLE * 1.5::DOUBLE - before AS left_ FROM b),
e AS (SELECT *, left_ * weight >= cap * rest AS filled FROM l),
v AS (SELECT left_ AS level_left, rest AS level_rest FROM e WHERE NOT filled ORDER BY cap / weight, position LIMIT 1),
t AS (SELECT source, source_size, position, CASE WHEN filled THEN cap ELSE (SELECT level_left FROM v) * weight / (SELECT level_rest FROM v) END AS target FROM e),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
k AS (SELECT doc_id, size, source_size, target, position, floor(rate)::BIGINT AS whole, floor((rate - floor(rate)) * 4294967296)::BIGINT AS below, [{_DRAWS}] AS draws
        FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
u AS (SELECT position, unnest(range(1, 33)) AS i, unnest(draws) AS draw, size, below, whole, source_size, target FROM k),
m AS (SELECT position, i, abs(any_value(whole) * any_value(source_size) + sum(CASE WHEN draw < below THEN size ELSE 0 END) - any_value(target)) AS off FROM u GROUP BY position, i),
q AS (SELECT position, arg_min(i, (off, i)) AS pick FROM m GROUP BY position)
SELECT doc_id, size, source_size, target, ((whole + CASE WHEN draws[pick] < below THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM k JOIN q USING (position)
"""

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_OP11 = rf"""
WITH x AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), {_LOWER}) AS key FROM x),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count_if(coalesce(doc_id <> last, false))::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT coalesce(doc_id <> last, false)), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY doc_id
"""

_OP12 = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {_LOWER}), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, 1 AS k, unnest(w) AS g FROM w UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w
    UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w),
f AS (SELECT lang, k, g, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT *, split_part(g, ' ', 1) AS x, split_part(g, ' ', 2) AS y, split_part(g, ' ', 3) AS z FROM f WHERE k > 1 AND f >= 10),
parts AS (SELECT lang, g, f, k, 1 AS cut, x AS l, CASE k WHEN 2 THEN y ELSE y || ' ' || z END AS r FROM c UNION ALL SELECT lang, g, f, k, 2, x || ' ' || y, z FROM c WHERE k = 3),
s AS (SELECT p.lang, p.g, p.f, p.k, p.cut, a.f AS l, b.f AS r, ((1000000::HUGEINT * p.f * p.f) // (a.f::HUGEINT * b.f))::BIGINT AS score FROM parts p JOIN f a ON a.lang = p.lang AND a.g = p.l AND a.k = p.cut JOIN f b ON b.lang = p.lang AND b.g = p.r AND b.k = p.k - p.cut),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
big AS (SELECT lang, g, max(f) AS f FROM (SELECT lang, x || ' ' || y AS g, f FROM c WHERE k = 3 UNION ALL SELECT lang, y || ' ' || z, f FROM c WHERE k = 3) GROUP BY 1, 2),
free AS (SELECT b.* FROM best b LEFT JOIN big USING (lang, g) WHERE b.k = 3 OR big.f IS NULL OR 100 * big.f < 50 * b.f)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, g) AS rank, g AS phrase, f AS a, l, r, n, score FROM free JOIN n USING (lang) QUALIFY rank <= 2000
"""

_OP13 = rf"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
dl AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY 1),
g AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM dl),
w AS (SELECT term, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, g GROUP BY term),
q AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))))::BIGINT AS score FROM q JOIN w USING (term) JOIN tf USING (term) JOIN dl USING (doc_id), g GROUP BY item_id, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_zip": _OP1, "op2_minhash_dedup": _OP2, "op4_line_frequency": _OP4, "op9_mixture": _OP9, "op11_line_dedup": _OP11, "op12_collocations": _OP12, "op13_lexical_search": _OP13}

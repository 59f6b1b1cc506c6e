"""Main text of web pages by wrappers: union-free regular expressions inferred from a host's pages.

A page is a sequence of tags and texts. Its elements nest, so an expression is kept as a tree: an element's content is a
row of parts, each an element, a text or a group of parts, and each required, optional or repeated. Two pages' rows are
aligned; what matches is merged, a mismatch of tags makes an optional part, and equal parts in a row one repeated part. A block
of text that most of a host's pages have equally often at one place (the path of keys to its element) is a token of the host's
template, however long, and stands in the expression as a constant; all other texts are slots, as they mismatch from page to
page. Pages are read by the expression alone: an article is the texts at the slots of the elements that belong to it, and what
matches a constant is dropped.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Generator, Iterator
from functools import lru_cache
from hashlib import blake2b
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

# Fixed values of HTML: elements without content, elements whose content is not markup, elements that end others left open, and
# elements that stand within a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg select object".split())
CLOSES = {
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"},
    **{t: {"p"} for t in "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()},
}
#: An element whose open tags stop the search for what to close.
SCOPES = frozenset("ul ol dl table article section div body td th nav aside main header footer form blockquote".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr #text math semantics mi mn mo ms mtext mspace mrow mfrac msqrt mroot msup msub msubsup munder mover munderover mstyle mtable mtr mtd".split())

#: Elements that hold texts of their own: inside a marked article their class says nothing about what they are.
TEXTS = INLINE | frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th caption figcaption".split())
#: Elements, and words in class, id or role, that are no part of an article; and those that hold one.
OUTSIDE = frozenset("head nav header footer aside form script style noscript template iframe svg button select textarea input object dialog menu title annotation annotation-xml".split())
OUTSIDE_WORDS = frozenset("ad ads advert advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup sidebar side menu nav navbar navigation breadcrumb breadcrumbs pager pagination toolbar header footer copyright legal share sharing social related recommended recommendations trending tags widget comment comments disqus replies reply respond discussion login search hidden skip".split())
ARTICLE, ARTICLE_WORDS = ("article", "main"), frozenset("article content post entry story body text".split())


def _tokens(attributes: str) -> re.Pattern[str]:
    """A token of a page; no character is tried twice, whatever stands open."""
    return re.compile(
        r"([^<]++)"  # a text
        rf"|<(?:(/?)(?!(?:{'|'.join(sorted(RAW))})\b)([a-zA-Z][^\s/>]*+)({attributes})>"  # a tag
        rf"|({'|'.join(sorted(RAW))})\b[^>]*+>.*?(?:</\5\s*+>|\Z)"  # an element without markup inside, whole
        r"|!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?/][^>]*+>?|[a-zA-Z][^>]*+\Z|(?![a-zA-Z!?/])())",  # what is skipped, else a bare sign
        re.S | re.I,
    )


#: Attributes may quote the sign that ends a tag. A page with a tag for which that leads to no end is read by the second from there on.
TOKEN, PLAIN_TOKEN = _tokens(r"(?>[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"), _tokens(r"[^>]*+")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPACE = re.compile(r"[\x20\x09-\x0D\xA0]+")
#: Constants of more characters are written as their hashes in an expression; they are compared by hashes at any length.
SHOWN = 80
#: Bits of one table by which rows are aligned; longer rows are aligned by halves.
TABLE_BITS = 1 << 29


def _hash(start: int, text: str) -> int:
    return int.from_bytes(blake2b(b"%d " % start + text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


#: The hash of a path of keys, from that of its parent (0 for a page) and the last key.
_path = lru_cache(1 << 17)(_hash)


class Node:
    """An element of a page, or a text (tag #text; its key is that of its constant, if it is one)."""

    __slots__ = ("key", "kids", "tag", "text")

    def __init__(self, tag: str, key: str = "", text: str = ""):
        self.tag, self.key, self.text, self.kids = tag, key or tag, text, []


def parse(source: str) -> Node:
    """The tree of a page, however broken: open elements end where their parents do or where HTML implies it."""
    root = Node("#root")
    stack, token, at = [root], TOKEN, 0
    while at < len(source):
        m = token.match(source, at)
        if m is None:
            token = PLAIN_TOKEN
            continue
        at = m.end()
        text, closing, name, attributes, raw, bare = m.groups()
        if text is not None or bare is not None:
            text = text or "<"
            kids = stack[-1].kids
            if text.isspace():
                if kids:
                    kids.append(Node("#space", text=" "))
            elif kids and kids[-1].tag == "#text":
                kids[-1].text += text
            else:
                kids.append(Node("#text", text=text))
            continue
        if raw is not None:
            stack[-1].kids.append(Node(raw.lower()))
            continue
        if name is None:
            continue
        tag = name.lower()
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in CLOSES:
            ends = CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    del stack[i:]
                    break
                if stack[i].tag in SCOPES:
                    break
        node = Node(tag, _key(tag, attributes) if attributes else tag)
        stack[-1].kids.append(node)
        if tag not in VOID and not attributes.endswith("/"):
            stack.append(node)
    return root


def _key(tag: str, attributes: str) -> str:
    """The tag with what of its class, id and role says where it belongs."""
    if not attributes or tag in OUTSIDE:
        return tag
    words: set[str] = set()
    for name, *values in ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        if name.lower() == "hidden" or name.lower() == "aria-hidden" and value == "true":
            words.add("hidden")
        words |= set(re.split(r"[^a-z]+", value)) & (OUTSIDE_WORDS | ARTICLE_WORDS)
    return ".".join([tag, *sorted(words)])


def mark(page: Node, constants: frozenset[int]) -> Node:
    """The page, its texts that are part of a host's constant block keyed by it."""
    if constants:
        found = blocks(page)
        lines = _counted([(path, text) for path, text, _ in found])
        for path, text, nodes in found:
            if lines[path, text] in constants:
                for node in nodes:
                    node.key = _constant(lines[path, text])
    return page


def _constant(line: int) -> str:
    return f"#={line & (1 << 64) - 1:016x}"


def infer(page: Node) -> dict:
    """A page as an expression of its own: k key, q one of 1 ? + *, c content of elements and groups, t the text of a constant, or its hash (null: a slot)."""
    stack: list[tuple[Node, Iterator[Node], list[dict]]] = [(page, iter(page.kids), [])]
    while True:
        node, kids, parts = stack[-1]
        for kid in kids:
            if kid.tag == "#text":
                text = SPACE.sub(" ", kid.text).strip() if kid.key != "#text" else None
                parts.append({"k": kid.key, "q": "1", "t": text if text is None or len(text) <= SHOWN else f"#CONSTANT {_hash(0, text):x}"})
            elif kid.tag != "#space":
                stack.append((kid, iter(kid.kids), []))
                break
        else:
            whole = {"k": node.key, "q": "1", "c": _run(_fold(parts))}
            stack.pop()
            if not stack:
                return whole
            stack[-1][2].append(whole)


def _run(step: Generator) -> Any:
    """The result of a generator that yields others and is sent their results: recursion to any depth, on a stack of its own."""
    stack, value = [step], None
    while stack:
        try:
            asked = stack[-1].send(value)
        except StopIteration as end:
            stack.pop()
            value = end.value
        else:
            stack.append(asked)
            value = None
    return value


def _repeat(a: str, b: str, joined: bool = False) -> str:
    """The quantifier of parts with quantifiers a and b that are aligned, or that follow each other."""
    many, none = joined or "+" in a + b or "*" in a + b, (a in "?*") and (b in "?*") if joined else (a in "?*") or (b in "?*")
    return {(False, False): "1", (False, True): "?", (True, False): "+", (True, True): "*"}[many, none]


def merge(a: dict, b: dict) -> dict:
    """Two wrappers of one host as one."""
    return _run(_merge(a, b))


def _merge(a: dict, b: dict, joined: bool = False) -> Generator:
    """Two parts of one key as one. joined: they stand in one row, and become a repeated part."""
    out = {"k": a["k"], "q": _repeat(a["q"], b["q"], joined)}
    if "t" in a:
        return out | {"t": min(a["t"], b["t"]) if a["t"] is not None and b["t"] is not None else None}
    return out | {"c": (yield _align(a["c"], b["c"]))}


def _returns(row: list[str], period: int) -> bool:
    """Whether a run of `period` keys is followed by the same keys somewhere in the row."""
    if len(row) < 64:
        return any(row[i : i + period] == row[i + period : i + 2 * period] for i in range(len(row) - 2 * period + 1))
    number = {k: i for i, k in enumerate(dict.fromkeys(row))}
    codes = np.array([number[k] for k in row])
    differ = np.flatnonzero(codes[:-period] != codes[period:])
    return int(np.diff(differ, prepend=-1, append=len(row) - period).max()) > period


def _fold(parts: list[dict]) -> Generator:
    """Equal runs of parts that follow each other become one repeated part, or a repeated group of parts, however many."""
    period = 1
    while 2 * period <= len(parts):
        row = [x["k"] for x in parts]
        if len(set(row)) == len(row):
            break
        if not _returns(row, period):
            period += 1
            continue
        out, at = [], 0
        while at < len(parts):
            run = parts[at : at + period]
            keys, end = row[at : at + period], at + period
            if len(run) == period and (period == 1 or len(set(keys)) > 1):
                while row[end : end + period] == keys and (period > 1 or keys[0][0] != "#"):
                    both, run = zip(run, parts[end : end + period], strict=True), []
                    for x, y in both:
                        run.append((yield _merge(x, y, joined=period == 1)))
                    end += period
            if end == at + period or period == 1:
                out += run if end > at + period else parts[at : at + 1]
                at = end if end > at + period else at + 1
            else:
                out.append({"k": "(" + " ".join(keys) + ")", "q": "+", "c": run})
                at = end
        parts = out
        period += 1
    return parts


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places (i, j) of a longest common subsequence of two rows. A bit of rows[j] is 0 where one more key of a makes that of a and b[: j + 1] longer; each key of b takes one step over all bits."""
    if len(a) * len(b) > TABLE_BITS and len(b) > 1:
        half = len(b) // 2
        ahead, back = _lengths(a, b[:half]), _lengths(a[::-1], b[half:][::-1])
        at = int((ahead + back[::-1]).argmax())
        return _common(a[:at], b[:half]) + [(i + at, j + half) for i, j in _common(a[at:], b[half:])]
    rows = list(_steps(a, b))
    i, j, out = len(a) - 1, len(b) - 1, []
    while i >= 0 and j >= 0:
        if rows[j] >> i & 1:
            i -= 1
        elif j and not rows[j - 1] >> i & 1:
            j -= 1
        else:
            out.append((i, j))
            i, j = i - 1, j - 1
    return out[::-1]


def _steps(a: list[str], b: list[str]) -> Iterator[int]:
    where: dict[str, int] = {}
    for i, k in enumerate(a):
        where[k] = where.get(k, 0) | 1 << i
    full = bits = (1 << len(a)) - 1
    for k in b:
        u = bits & where.get(k, 0)
        bits = (bits + u | bits - u) & full
        yield bits


def _lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of a[:i] and b, for i from 0 on."""
    bits = (1 << len(a)) - 1
    for bits in _steps(a, b):  # noqa: B007
        pass
    ones = np.unpackbits(np.frombuffer(bits.to_bytes(-(-len(a) // 8), "little"), np.uint8), count=len(a), bitorder="little")
    return np.concatenate([[0], np.cumsum(1 - ones.astype(np.int64))])


def _align(a: list[dict], b: list[dict]) -> Generator:
    """Two rows as one: the longest common run of keys is merged, and other parts become optional."""
    x, y = [p["k"] for p in a], [p["k"] for p in b]
    out, i, j = [], 0, 0
    for m, n in [*(zip(range(len(x)), range(len(y)), strict=True) if x == y else _common(x, y)), (len(a), len(b))]:
        out += [p | {"q": _repeat(p["q"], "?")} for p in [*a[i:m], *b[j:n]]]
        if m < len(a):
            out.append((yield _merge(a[m], b[n])))
        i, j = m + 1, n + 1
    return out if x == y else (yield _fold(out))


def flat(wrapper: dict) -> list[dict]:
    """A wrapper as a list of its parts, each before those that its c names by their places: JSON of one depth."""
    parts, at = [wrapper], 0
    while at < len(parts):
        if "c" in parts[at]:
            kids = parts[at]["c"]
            parts[at] = parts[at] | {"c": list(range(len(parts), len(parts) + len(kids)))}
            parts += kids
        at += 1
    return parts


def nested(parts: list[dict]) -> dict:
    """The wrapper of a flat list."""
    whole: list[dict] = [dict(x) for x in parts]
    for x in whole:
        if "c" in x:
            x["c"] = [whole[i] for i in x["c"]]
    return whole[0]


def expression(parts: list[dict]) -> str:
    """A flat wrapper as a regular expression over tags, constants and #PCDATA slots."""
    said: list[str] = [""] * len(parts)
    for at in range(len(parts) - 1, -1, -1):
        x = parts[at]
        if "t" in x:
            inner = "#PCDATA" if x["t"] is None else x["t"]
        else:
            inner = " ".join(said[i] for i in x["c"])
            inner = inner if x["k"][0] in "(#" else f"<{x['k']}>{' ' + inner + ' ' if inner else ''}</{x['k'].split('.')[0]}>"
        said[at] = inner if x["q"] == "1" else f"({inner}){x['q']}"
    return said[0]


@lru_cache(1 << 16)
def _outside(key: str, inside: bool = False) -> bool:
    """Whether an element is no part of an article by its tag or the words of its class. Inside a marked article words count for elements that hold others only."""
    tag, *words = key.split(".")
    return tag in OUTSIDE or (bool(set(words) & OUTSIDE_WORDS) and not (inside and tag in TEXTS))


def _holds(key: str, level: int) -> bool:
    tag, *words = key.split(".")
    return tag == ARTICLE[level] if level < 2 else tag in ("div", "section", "td") and bool(set(words) & ARTICLE_WORDS)


def _has(wrapper: dict, level: int) -> bool:
    todo = [wrapper]
    while todo:
        x = todo.pop()
        if x["k"][0] == "(" or not _outside(x["k"]):
            if x["k"][0] != "(" and _holds(x["k"], level):
                return True
            todo += x.get("c", ())
    return False


def article_level(wrapper: dict) -> int:
    """What marks the host's articles: 0 <article>, 1 <main>, 2 a class or id, 3 nothing, so all of the body but links' lists and what stands outside."""
    return next((level for level in range(3) if _has(wrapper, level)), 3)


def slots(wrapper: dict, level: int) -> tuple[dict[int, bool], frozenset[str]]:
    """The wrapper by paths of keys: for each element that is not outside, whether texts at its slots are the article's; and the keys of the constants."""
    reading: dict[int, bool] = {}
    constants: set[str] = set()
    todo = [(wrapper, 0, level == 3 and not _has_body(wrapper))]
    while todo:
        node, path, inside = todo.pop()
        reading[path] = inside or reading.get(path, False)
        rows = list(node["c"])
        while rows:
            x = rows.pop()
            if x["k"][0] == "(":
                rows += x["c"]
            elif "t" in x:
                constants |= {x["k"]} - {"#text"}
            elif not _outside(x["k"], inside and level < 3):
                linked = level == 3 and x["k"].split(".")[0] in ("li", "ul", "ol") and _only_links(x)
                todo.append((x, _path(path, x["k"]), not linked and (inside or _holds(x["k"], level) if level < 3 else inside or x["k"] == "body")))
    return reading, frozenset(constants)


def _has_body(wrapper: dict) -> bool:
    todo = [wrapper]
    while todo:
        for x in todo.pop().get("c", ()):
            if x["k"].split(".")[0] == "body":
                return True
            todo.append(x)
    return False


def _only_links(node: dict) -> bool:
    todo = [node]
    while todo:
        kids = todo.pop()["c"]
        if not kids or any("t" in x for x in kids):
            return False
        todo += [x for x in kids if x["k"].split(".")[0] != "a"]
    return True


def blocks(page: Node, reading: dict[int, bool] | None = None) -> list[tuple[int, str, list[Node]]]:
    """The page's blocks of text, each with the path of its element and its texts: those at the wrapper's slots, or all that are not outside."""
    found: list[tuple[int, str, list[Node]]] = []
    line: list[Node] = []

    def end(path: int) -> None:
        text = SPACE.sub(" ", html.unescape("".join(x.text for x in line))).strip(" ")
        if text:
            found.append((path, text, [x for x in line if x.tag == "#text"]))
        line.clear()

    stack = [(iter(page.kids), 0, reading is None or reading.get(0, False), 0, True)]
    while stack:
        kids, path, keep, block, closes = stack[-1]
        for kid in kids:
            if kid.tag in ("#text", "#space"):
                if keep:
                    line.append(kid)
            elif kid.tag == "br":
                line.append(BREAK)
            else:
                at = _path(path, kid.key)
                # the wrapper's paths leave out what is outside
                inner = (None if _outside(kid.key, True) else True) if reading is None else reading.get(at)
                if inner is None:
                    continue
                closes = kid.tag not in INLINE
                if closes:
                    end(block)
                stack.append((iter(kid.kids), at, inner, at if closes else block, closes))
                break
        else:
            stack.pop()
            if closes:
                end(block)
    return found


BREAK = Node("#space", text=" ")


def extract(page: Node, reading: dict[int, bool], constants: frozenset[str] = frozenset()) -> str:
    """The page's article: the blocks at the wrapper's slots that match none of its constants."""
    found = [(path, text) for path, text, _ in blocks(page, reading)]
    if constants:
        dropped = {block for block, line in _counted(found).items() if _constant(line) in constants}
        found = [block for block in found if block not in dropped]
    return "\n\n".join(text for _, text in found)


def _counted(found: list[tuple[int, str]]) -> dict[tuple[int, str], int]:
    """A hash of each block's path, text and number on the page."""
    return {(path, text): _hash(path, f"{times} {text}") for (path, text), times in Counter(found).items()}


def host(url: Column) -> Column:
    """The host of an address in lower case; empty for null and for what has none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    found: dict[str, dict] = {}
    known: dict[str, frozenset[int]] = {}
    for pdf in batches:
        for name, source, constants in zip(pdf["host"], pdf["html"], pdf["constants"], strict=True):
            if isinstance(source, str) and source:
                if name not in known:
                    known[name] = frozenset(() if constants is None else map(int, constants))
                one = infer(mark(parse(source), known[name]))
                found[name] = merge(found[name], one) if name in found else one
        if len(found) > 5000:
            yield _rows(found)
            found, known = {}, {}
    yield _rows(found)


def _rows(found: dict[str, dict]) -> pd.DataFrame:
    return pd.DataFrame({"host": list(found), "wrapper": [json.dumps(flat(w)) for w in found.values()]}, columns=["host", "wrapper"], dtype=object)


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    whole = None
    for text in sorted(pdf["wrapper"]):
        one = nested(json.loads(text))
        whole = one if whole is None else merge(whole, one)
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [json.dumps(flat(whole))]})


def wrappers(pages: DataFrame, fan_in: int = 256) -> DataFrame:
    """host, wrapper (flat, as JSON) for each host of pages (url, html), as a written table. Each task merges its pages to one wrapper a host; those are merged in two rounds, so that a host with very many pages is never in one task whole."""
    rows = pages.select(host(F.col("url")).alias("host"), "html").join(host_constants(pages), "host", "left").select("host", "html", "constants")
    parts = rows.mapInPandas(_partial, "host string, wrapper string")
    some = parts.groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(fan_in)).alias("part")).applyInPandas(_merged, "host string, wrapper string")
    return materialize(some.groupBy("host").applyInPandas(_merged, "host string, wrapper string"), "wrappers")


def _placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for name, source in zip(pdf["host"], pdf["html"], strict=True):
            if isinstance(source, str) and source:
                found, page = [(path, text) for path, text, _ in blocks(parse(source))], _hash(0, source)
                rows += [(name, page, path, None) for path in {path for path, _ in found}]
                rows += [(name, page, path, line) for (path, _), line in _counted(found).items()]
        columns = zip(*rows, strict=True) if rows else ((),) * 4
        yield pd.DataFrame({k: pd.Series(v, dtype=t) for (k, t), v in zip({"host": object, "page": "int64", "path": "int64", "line": "Int64"}.items(), columns, strict=True)})


def host_constants(pages: DataFrame, least: int = 3) -> DataFrame:
    """host, constants (hashes of path, number and text): the blocks that at least `least` pages of a host have equally often at one path, and more than half of its pages with blocks there. Equal pages count once."""
    placed = pages.select(host(F.col("url")).alias("host"), "html").mapInPandas(_placed, "host string, page long, path long, line long")
    counts = materialize(placed.groupBy("host", "path", "line").agg(F.count_distinct("page").alias("pages")).where(F.col("pages") >= least), "counts")
    have = counts.where("line is null").select("host", "path", F.col("pages").alias("all_pages"))
    shared = counts.where("line is not null").join(have, ["host", "path"]).where(2 * F.col("pages") > F.col("all_pages"))
    return materialize(shared.groupBy("host").agg(F.collect_list("line").alias("constants")), "constants")


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[str, tuple] = {}
    for pdf in batches:
        texts = []
        for name, wrapper, source in zip(pdf["host"], pdf["wrapper"], pdf["html"], strict=True):
            if not isinstance(source, str) or not source or not isinstance(wrapper, str):
                texts.append("")
                continue
            if name not in known:
                if len(known) > 1000:
                    known.clear()
                tree = nested(json.loads(wrapper))
                known[name] = slots(tree, article_level(tree))
            texts.append(extract(parse(source), *known[name]))
        yield pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"].tolist(), "text": texts, "n_chars": [len(t) for t in texts]})


def main_texts(pages: DataFrame) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text (blocks joined by two newlines), n_chars.

    Pages without a host share one wrapper. Null and empty html, and pages of which nothing belongs to an article, give an
    empty text. Repeated rows get equal results. Other columns are ignored. An empty table gives an empty result.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host(F.col("url")).alias("host"))
    return rows.join(wrappers(pages), "host", "left").select("page_id", "url", "html", "host", "wrapper").mapInPandas(_extract, "page_id long, url string, text string, n_chars long")

"""Main text of web pages, by structure and by the suffixes that a host's pages share.

1. Each page becomes a stream of blocks with a zone: content (inside an article or main element), named (inside one that
   its class or id calls content), chrome (menus, headers, footers, sidebars, notices, adverts, forms, comments; inside
   content too) or open (none of these). Script, style, markup comments and titles are never text.
2. The token streams of each host's pages are cut into suffixes. Suffixes that agree on their first RUN tokens would be
   neighbours in a suffix array of the host; here they are a group of a shuffle by these tokens, so no task gets a host.
   A group of suffixes from distinct pages is a substring of RUN or more tokens that repeats, and covers its tokens.
3. Repetition and structure decide together. Only what stands outside content and named zones counts as a repeat, as
   articles share passages with each other, and only on VOTES or more distinct pages, so that a page and its print version
   keep their text. A page with neither zone keeps the unique runs of its open blocks; where next to nothing is unique, it
   is a copy of other pages, not made of boilerplate, and keeps them all. A named
   zone is only a guess, so its blocks go that are boilerplate elsewhere: whose every token is covered by runs that stand
   outside the zones on VOTES or more pages of the host, and whose beginning begins named blocks on fewer pages than
   that. An article or main element is kept whole: adverts and footers quote lines of articles too, so repetition there
   would cut articles.

Runs are told apart by 128-bit hashes of host and tokens, pages by 128 bits of host and html; among 10^11 of them two
different ones agree with a probability below 10^-15.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import materialise, named_apart
from lodestone.llm.words import mix

#: Tokens of the shortest repeated substring, and pages on which a run must stand outside the zones to outvote a named one.
RUN, VOTES = 8, 3
#: A page without zones of which so small a part or less is unique is a copy of others.
COPY = 1 / 16
#: Zones of blocks.
CONTENT, NAMED, OPEN, CHROME = 3, 2, 1, 0
#: Kinds of marked suffixes: outside content, on a page with a content zone or an open page; at the beginning of a named block.
VOTE, ASK, START = 0, 1, 2
#: By so many parts the groups of a frequent run are dealt.
SALTS = 16
_BASE = np.uint64(0x9E3779B97F4A7C15)

# Element and attribute names of HTML pages.
_RAW = "script|style|title|textarea|noscript|template|iframe|object|svg|math|canvas|audio|video|xmp"
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
_CHROME_TAGS = frozenset("nav footer aside form button select dialog menu head".split())
_CHROME_NAMES = frozenset("nav navbar navigation menu footer sidebar aside ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal newsletter subscribe subscription comment comments disqus share sharing social related recommended breadcrumb breadcrumbs pagination pager widget login signup toolbar masthead complementary contentinfo search dialog alert".split())
# Of these, names that components of articles have as well; inside articles they say nothing.
_COMPONENT_NAMES = frozenset("navigation menu aside banner notices popup modal widget toolbar search dialog alert social related complementary login".split())
_TEXT_TAGS = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd td th caption figcaption blockquote pre".split())
_COMMENT_NAMES = frozenset("comment comments disqus".split())
_STATE_NAMES = frozenset("has no with without is format hide".split())
_CONTENT_NAMES = frozenset("article content main post entry story body articlebody".split())
# A tag, comment or raw element that never ends goes on to the end of the page, so every match begins where the one before ended.
_INSIDE = r"(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^'\">])*+"
_END = r"(?:>|\Z)"


def _rule(inside: str) -> re.Pattern:
    return re.compile(
        rf"<!--.*?(?:-->|\Z)|<(?:svg|math)(?=[\s/]){inside}(?<=/)>|<({_RAW})(?=[\s/>]){inside}{_END}.*?(?:</\1(?=[\s/>])[^>]*{_END}|\Z)|<[!?][^>]*{_END}|<(/?)([a-z][^\s/>]*)({inside})(>|\Z)", re.I | re.S
    )


_TOKEN, _PLAIN = _rule(_INSIDE), _rule(r"[^>]*+")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


def _tokens(html: str):
    """Matches of tags, comments and raw elements. After a tag whose quotes never close, tags end at their first >."""
    at, rule = 0, _TOKEN
    while m := rule.search(html, at):
        if rule is _TOKEN and m[5] == "" and html.find(">", m.start()) >= 0:
            rule = _PLAIN
            m = rule.match(html, m.start())
        yield m
        at = m.end()


def _marks(tag: str, attributes: str, inside: bool) -> tuple[int, int]:
    """How an element is chrome (0 not, 1 by its names, 2 by its tag, as comments or as hidden), and its rank as a content element (0 none, 1 by its name, 2 main, 3 article).

    Names don't make an article or main element chrome, unless of comments, nor an inline one. Ids name elements outside
    articles only, as those inside are made from headings' texts, and never headings, paragraphs and their like; but an
    element whose whole id is that of comments holds comments. Names that components of articles have don't count inside.
    """
    rank = {"article": 3, "main": 2}.get(tag, 0)
    chrome = 2 if tag in _CHROME_TAGS or (tag == "header" and not inside) else 0
    if attributes and tag not in ("body", "html"):
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values).lower()
            if name in ("class", "id", "role"):
                words = {w for token in value.split() if not _STATE_NAMES & set(parts := re.split(r"[_-]+", token)) for w in parts}
                if name == "id" and (inside or tag in _TEXT_TAGS):
                    words = {value} & _COMMENT_NAMES
                if tag not in _INLINE:
                    if words & _COMMENT_NAMES and tag != "main":
                        chrome = 2
                    elif not rank > 1 and (words & _CHROME_NAMES - (_COMPONENT_NAMES if inside else set()) or ("header" in words and not inside and tag != "h1")):
                        chrome = max(chrome, 1)
                if tag in ("div", "section", "td") and words & _CONTENT_NAMES:
                    rank = max(rank, 1)
                if name == "role" and value in ("main", "article"):
                    rank = max(rank, 2)
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                chrome = 2
    return chrome, rank


class _Forms:
    """Which forms of a page hold its content: those around an article or main element, or around more paragraphs than fields."""

    _MARK = re.compile(r"<(?:(/form)|(article|main)|(p)|(input|select|textarea|button))(?=[\s/>])", re.I)

    def __init__(self, html: str) -> None:
        self.html = html
        self.places: list[list[int]] | None = None

    def around_content(self, at: int) -> bool:
        if self.places is None:
            self.places = [[], [], [], []]
            for m in self._MARK.finditer(self.html):
                self.places[m.lastindex - 1].append(m.start())
        ends = self.places[0]
        i = bisect_left(ends, at)
        end = ends[i] if i < len(ends) else len(self.html)
        content, paragraphs, fields = (bisect_left(p, end) - bisect_left(p, at) for p in self.places[1:])
        return bool(content) or (paragraphs >= 3 and paragraphs > fields)


def page_blocks(html: str) -> tuple[list[int], list[str]]:
    """Zone and text of each block of a page, in page order; blocks without text are left out.

    Content zones are all content elements but those around one of higher rank (main around article). If every article
    or main element lies in one that is chrome by its names alone, these names don't count.
    """
    texts: list[str] = []
    zones: list[tuple[int, int]] = []  # chrome (as in _marks), content element
    held: list[str] = []
    stack: list[tuple[str, int, int]] = [("", 0, 0)]  # tag, chrome, content element
    elements: list[tuple[int, int]] = [(0, 0)]  # rank of each content element and the one around it
    around: set[int] = set()  # content elements around one of higher rank
    opened: Counter[str] = Counter()
    forms = _Forms(html)

    def close() -> None:
        if held:
            if text := " ".join("".join(held).split()):
                zones.append(stack[-1][1:])
                texts.append(text)
            held.clear()

    def pop() -> None:
        opened[stack.pop()[0]] -= 1

    at = 0
    for m in _tokens(html):
        if m.start() > at:
            held.append(unescape(html[at : m.start()]))
        at = m.end()
        if m[3] is None:
            continue
        tag = m[3].lower()
        if tag in _INLINE and not (m[4] and not m[2] and _marks(tag, m[4], True)[0]) and not (m[2] and stack[-1][0] == tag):
            continue
        close()
        if tag in _VOID:
            continue
        if m[2]:
            while opened[tag]:
                pop()
        else:
            top = stack[-1][0]
            if (tag != "li" and top == "p" and tag not in _INLINE) or (top == tag and tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option")):
                pop()  # its end tag may be left out
            _, chrome, element = stack[-1]
            own, rank = _marks(tag, m[4], elements[element][0] >= 2)
            if tag == "form" and forms.around_content(m.end()):
                own = 0
            if own == 1 and elements[element][0]:
                own = 2
            chrome = max(chrome, own)
            if rank > elements[element][0] or (rank and rank == elements[element][0] and not chrome):
                outer = element
                while outer and chrome < 2 and outer not in around and elements[outer][0] < rank:
                    around.add(outer)
                    outer = elements[outer][1]
                elements.append((rank, element))
                element = len(elements) - 1
            stack.append((tag, chrome, element))
            opened[tag] += 1
    if at < len(html):
        held.append(unescape(html[at:]))
    close()
    least = 1 if not any(c == 0 and elements[e][0] for c, e in zones) and any(c == 1 and elements[e][0] > 1 for c, e in zones) else 0
    return [CHROME if c > least or (c and not elements[e][0]) else OPEN if not e or e in around else CONTENT if elements[e][0] > 1 else NAMED for c, e in zones], texts


def _seed(host: str) -> np.ndarray:
    import xxhash

    return np.frombuffer(xxhash.xxh3_128_digest(host.encode("utf-8", "replace")), np.uint64)


def runs(tokens: list[str], host: str) -> np.ndarray:
    """128-bit hash of host and the first RUN tokens of each suffix that has so many, as two columns."""
    import xxhash

    n = max(0, len(tokens) - RUN + 1)
    acc = np.tile(_seed(host), (n, 1))
    if n:
        h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(t.encode("utf-8", "replace")) for t in tokens), np.uint64).reshape(-1, 2)
        for j in range(RUN):
            acc = mix(acc * _BASE + h[j : n + j])
    return acc.view(np.int64)


def _outside(zones: list[int], blocks: list[list[str]]) -> list[list[str]]:
    """The token streams between blocks of content and named zones."""
    streams: list[list[str]] = [[]]
    for z, b in zip(zones, blocks, strict=True):
        if z >= NAMED:
            streams.append([])
        else:
            streams[-1] += b
    return streams


def _tiles(n: int) -> list[int]:
    """Places of runs that cover n tokens."""
    return [*range(0, n - RUN, RUN), n - RUN]


def marked(html: str, host: str) -> list[tuple[int, np.ndarray]]:
    """Kind and distinct runs of a page's marked suffixes."""
    zones, texts = page_blocks(html)
    blocks = [t.split(" ") for t in texts]
    outside = [runs(s, host) for s in _outside(zones, blocks) if len(s) >= RUN]
    starts = [runs(b[:RUN], host) for z, b in zip(zones, blocks, strict=True) if z == NAMED and len(b) >= RUN]
    kind = VOTE if max(zones, default=OPEN) >= NAMED else ASK
    return [(k, np.unique(np.concatenate(r), axis=0)) for k, r in ((kind, outside), (START, starts)) if r]


def tiled(html: str, host: str) -> list[tuple[int, np.ndarray]]:
    """The runs that cover the named blocks of a page."""
    zones, texts = page_blocks(html)
    found = [runs(b, host)[_tiles(len(b))] for b in (t.split(" ") for z, t in zip(zones, texts, strict=True) if z == NAMED) if len(b) >= RUN]
    return [(VOTE, np.unique(np.concatenate(found), axis=0))] if found else []


def kept_text(html: str, host: str, repeats: set[tuple[int, int]], starts: set[tuple[int, int]]) -> tuple[str, int]:
    """Text of a page and how many of its tokens repetition removed: of an open page the tokens covered by `repeats` (none of a copy); of one with zones the named blocks that begin with one of `starts` and are covered by `repeats`."""
    zones, texts = page_blocks(html)
    least = NAMED if max(zones, default=OPEN) >= NAMED else OPEN
    if not repeats:
        return " ".join(t for z, t in zip(zones, texts, strict=True) if z >= least), 0
    kept, removed = [], 0
    if least == NAMED:
        for z, t in zip(zones, texts, strict=True):
            if z == CONTENT:
                kept.append(t)
            elif z == NAMED:
                own = list(map(tuple, runs(b := t.split(" "), host).tolist()))
                if own and own[0] in starts and all(own[i] in repeats for i in _tiles(len(b))):
                    removed += len(b)
                else:
                    kept.append(t)
        return " ".join(kept), removed
    blocks = [t.split(" ") for t in texts]
    stream = [w for b in blocks for w in b]
    edge = np.zeros(len(stream) + 1, np.int64)
    for i, r in enumerate(map(tuple, runs(stream, host).tolist())):
        if r in repeats:
            edge[i] += 1
            edge[i + RUN] -= 1
    covered, place = np.cumsum(edge) > 0, 0
    is_open = np.repeat(np.array(zones) == OPEN, [len(b) for b in blocks])
    if (is_open & ~covered[:-1]).sum() <= COPY * is_open.sum():
        return " ".join(t for z, t in zip(zones, texts, strict=True) if z == OPEN), 0
    for z, b in zip(zones, blocks, strict=True):
        if z == OPEN:
            unique = [w for w, c in zip(b, covered[place : place + len(b)].tolist(), strict=True) if not c]
            removed += len(b) - len(unique)
            if unique:
                kept.append(" ".join(unique))
        place += len(b)
    return " ".join(kept), removed


def _suffixes(pages: DataFrame, found) -> DataFrame:
    """k1, k2, kind and run (r1, r2), a row for each that found(html, host) gives for a page."""

    def run(batches):
        for batch in batches:
            html, host, k1, k2 = (batch.column(c).to_pylist() for c in ("html", "host", "k1", "k2"))
            for i, h in enumerate(html):
                for kind, r in found(h, host[i]):
                    n = len(r)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k1[i])), pa.array(np.full(n, k2[i])), pa.array(np.full(n, kind, np.int32)), pa.array(r[:, 0].copy()), pa.array(r[:, 1].copy())], names=["k1", "k2", "kind", "r1", "r2"])

    return pages.select("html", "host", "k1", "k2").mapInArrow(run, "k1 long, k2 long, kind int, r1 long, r2 long")


def _meeting(asked: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of asked whose run is among the chosen; the rows of a frequent run are dealt to SALTS tasks."""
    salted = asked.withColumn("salt", F.pmod(F.xxhash64("k1", "k2"), F.lit(SALTS)))
    return salted.join(chosen.select("r1", "r2", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])).alias("salt")), ["r1", "r2", "salt"], "left_semi").drop("salt")


def _answers(pages: DataFrame) -> DataFrame:
    """k1, k2, repeats and starts: what kept_text needs to know of each page, without rows for pages that lose nothing."""
    marks = materialise(_suffixes(pages, marked), "suffixes")
    by_page = marks.where(F.col("kind") != START).groupBy("r1", "r2", "k1", "k2").agg(F.lit(1).alias("one"))  # equal pages count once
    repeats = materialise(by_page.groupBy("r1", "r2").agg(F.count("*").alias("n")).where(F.col("n") >= VOTES), "repeats")
    asks = _meeting(marks.where(F.col("kind") == ASK), repeats)
    begun = materialise(_meeting(marks.where(F.col("kind") == START).distinct(), repeats), "starts")
    if begun.limit(1).count():
        inside = begun.groupBy("r1", "r2").agg(F.count("*").alias("inside"))
        outvoted = repeats.join(inside, ["r1", "r2"]).where("n > inside")
        starts = materialise(_meeting(begun, outvoted), "starts")
        asks = asks.union(starts).union(_meeting(_suffixes(pages.join(starts.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi"), tiled), repeats))
    run = F.struct("r1", "r2")
    return materialise(asks.groupBy("k1", "k2").agg(F.collect_set(F.when(F.col("kind") != START, run)).alias("repeats"), F.collect_set(F.when(F.col("kind") == START, run)).alias("starts")), "answers")


def main_text(pages: DataFrame) -> DataFrame:
    """pages without html, with text, n_chars (code points) and n_removed (tokens outside chrome that repetition removed).

    Null and empty html have an empty text; null and malformed urls form a host of their own; equal pages count as one
    page, so they don't repeat each other; columns named as a result are replaced; an empty table gives no rows.
    """
    keep = named_apart(pages, ["html", "text", "n_chars", "n_removed"])
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("_"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"://([^/?#]*)", 1))
    own = pages.select(row.alias("row"), host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    own = own.withColumns({"k1": F.xxhash64("html", "host"), "k2": F.xxhash64(F.lit("second"), "html", "host")})
    answers = _answers(own)

    def extract(batches):
        for batch in batches:
            html, hosts, repeats, starts = (batch.column(c).to_pylist() for c in ("html", "host", "repeats", "starts"))
            told = [{(r["r1"], r["r2"]) for r in x or ()} for x in repeats], [{(r["r1"], r["r2"]) for r in x or ()} for x in starts]
            done = [kept_text(*x) for x in zip(html, hosts, *told, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([t for t, _ in done], pa.string()), pa.array([len(t) for t, _ in done], pa.int64()), pa.array([n for _, n in done], pa.int64())], names=["row", "text", "n_chars", "n_removed"])

    joined = own.join(answers, ["k1", "k2"], "left").select("row", "host", "html", "repeats", "starts")
    shape = T.StructType([T.StructField("row", joined.schema["row"].dataType), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_removed", T.LongType())])
    return joined.mapInArrow(extract, shape).select(*[F.col(f"row.`{c}`").alias(c) for c in keep], "text", "n_chars", "n_removed")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.common import table

    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars", "n_removed")

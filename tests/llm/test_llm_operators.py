import collections
import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from lodestone.llm import bagminhash, bpe, decontaminate, html_text, language_id, license_scan, media, near_dedup, quality, shard, url_filter
from lodestone.llm import queries as llm_queries
from lodestone.llm.words import shingles, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [(1, None), (2, ""), (3, "one two"), (4, "\u00c4B\u00df 9x \u6f22\u5b57 \U0001f642"), (None, "one two"), (5, "word " * 30000), (3, "one two"), (6, "!!! ... ???"), (7, "a\x00b\u00a0c")]
DOCS = "doc_id long, text string"


def split(text):
    return WORD.findall((text or "").translate(LOWER))


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def binary(texts):
    return pa.array([t.encode() for t in texts], pa.large_binary())


def test_words_and_shingles_match_the_pattern():
    texts = [t or "" for _, t in ODD] + ["Trailing9", "A,b", "x"]
    w = words(binary(texts))
    assert [[b.decode() for b in w.bytes_of(a, b - a)] for a, b in zip(w.first[:-1], w.first[1:], strict=True)] == [split(t) for t in texts]
    same = collections.defaultdict(set)
    h, valid = shingles(w, 2)
    flat = [x for t in texts for x in split(t)]
    for i in np.flatnonzero(valid):
        same[h[i]].add((flat[i], flat[i + 1]))
    assert all(len(v) == 1 for v in same.values()) and len(same) == len(set().union(*same.values()))
    assert words(binary([])).count().tolist() == []


# 1 ---------------------------------------------------------------------------------------------------------------


def test_html_zones():
    zones, texts = html_text.page_blocks("<header>H</header><div class='cookie-notice'>C</div><p>open <b>bo</b>ld &lt;&nbsp;t<form>f</form><script>x<p></script><!-- c --><footer>F")
    assert [t for z, t in zip(zones, texts, strict=True) if z == html_text.OPEN] == ["open bold < t"]
    zones, texts = html_text.page_blocks("<main>a<article><h1>T</h1>x<br>y<aside>no</aside><div class=ad>no</div>z<section id='comments'><article>c</article></section></article></main>")
    assert [t for z, t in zip(zones, texts, strict=True) if z == html_text.CONTENT] == ["T", "x", "y", "z"]
    assert html_text.page_blocks("") == ([], [])
    assert html_text.page_blocks("a < b & c")[1] == ["a < b & c"]


def content(html):
    return [t for z, t in zip(*html_text.page_blocks(html), strict=True) if z >= html_text.NAMED]


@pytest.mark.parametrize(
    ("html", "wanted"),
    [
        ('<div class="content-with-sidebar"><article>a</article></div>', ["a"]),
        ('<main class="has-sidebar">a</main>', ["a"]),
        ('<div id="page" class="no-banner"><article>a</article></div>', ["a"]),
        ('<article class="post format-share">a</article>', ["a"]),
        ('<article>Article about <span class="search">search</span> engines</article>', ["Article about search engines"]),
        ('<article class="teaser">t</article><div class="content">body</div>', ["t", "body"]),
        ('<article><h2 id="search-algorithms">a</h2><h2 id="social-history">b</h2><section id="related-work">c</section><h3 id="comments-on-it">d</h3></article>', ["a", "b", "c", "d"]),
        ('<article><div class="elementor-widget">a</div><pre class="code-widget">b</pre><div class="dialog">c</div><div class="ad-slot">no</div><div id=comments>no</div></article>', ["a", "b", "c"]),
        ('<form id="aspnetForm"><input type=hidden><nav>n</nav><main>a<p>b</p></main></form>', ["a", "b"]),
        ("<main>a<form><p>name <input></p><p>mail <input></p><p><button>send</button></p></form></main>", ["a"]),
        ("<div class=sidebar><article>a</article></div>", ["a"]),
        ("<div class=sidebar><article>other</article></div><main>m<article>a</article></main>", ["a"]),
        ("<article>a<svg/>b<svg>x</svg>c</article>", ["abc"]),
        ('<article>a<p title="class=ad" data-class="ad">b</p></article>', ["a", "b"]),
        ('<article>a</article><p>b <a href="never closed>c</p>', ["a"]),
        ("<article>a <a href='it>b</p>c</article>", ["a b", "c"]),
    ],
)
def test_html_content_zones(html, wanted):
    assert content(html) == wanted


@pytest.mark.parametrize("piece", ["<a ", '<a href="x ', "<div></p>", "<div>", "<!x", "<!--", "<script ", "<p>", "<a b='", "&", "</script ", "x<b>", "='\""])
def test_html_of_a_million_bytes_takes_linear_time(piece):
    import time

    html = "<p>" + piece * (1_000_000 // len(piece))
    began = time.process_time()
    html_text.page_blocks(html + ">")
    html_text.page_blocks(html)
    assert time.process_time() - began < 8


def brute_texts(rows, run=html_text.RUN, votes=html_text.VOTES):
    """page_id and text by comparing token tuples of all pages of a host."""
    parts = []
    for i, url, html in rows:
        zones, texts = html_text.page_blocks(html or "")
        parts.append((i, re.search("://([^/?#]*)|$", url or "")[1] or "", zones, [t.split() for t in texts]))
    outside, begins = collections.defaultdict(set), collections.defaultdict(set)
    for n, (_, host, zones, blocks) in enumerate(parts):
        n = next(k for k, p in enumerate(parts) if (p[1], rows[k][2]) == (host, rows[n][2]))  # equal pages are one
        stream = [w if z < html_text.NAMED else None for z, b in zip(zones, blocks, strict=True) for w in b]
        for k in range(len(stream) - run + 1):
            if None not in stream[k : k + run]:
                outside[host, tuple(stream[k : k + run])].add(n)
        for z, b in zip(zones, blocks, strict=True):
            if z == html_text.NAMED and len(b) >= run:
                begins[host, tuple(b[:run])].add(n)
    out = []
    for i, host, zones, blocks in parts:
        has, kept, place = max(zones, default=0) >= html_text.NAMED, [], 0
        stream = [w for b in blocks for w in b]
        covered = {k + j for k in range(len(stream) - run + 1) if len(outside[host, tuple(stream[k : k + run])]) >= votes for j in range(run)}
        at = [j for j, z in enumerate(z for z, b in zip(zones, blocks, strict=True) for _ in b) if z == html_text.OPEN]
        copy = len(set(at) - covered) <= html_text.COPY * len(at)
        for z, b in zip(zones, blocks, strict=True):
            hit = {k + j for k in range(len(b) - run + 1) if len(outside[host, tuple(b[k : k + run])]) >= votes for j in range(run)} if has else set() if copy else covered
            if z == html_text.CONTENT:
                kept += b
            elif z == html_text.NAMED:
                first = (host, tuple(b[:run]))
                if not (len(hit) == len(b) and len(outside[first]) > len(begins[first])):
                    kept += b
            elif not has and z == html_text.OPEN:
                kept += [w for j, w in enumerate(b, place) if j not in hit]
            place += len(b)
        out.append((i, " ".join(kept)))
    return sorted(out, key=str)


def test_html_repeats_match_brute_force(spark):
    rng = np.random.default_rng(0)
    say = lambda n, v=10**6: " ".join(f"t{x}" for x in rng.integers(0, v, n))
    notices, passages, rows = [say(9), say(20), say(8)], [say(12) for _ in range(6)], []
    for i in range(120):
        host, shape = f"h{i % 3}.example", i % 4
        odd = [notices[int(rng.integers(0, 3))], passages[int(rng.integers(0, 6))], say(int(rng.integers(1, 12))), say(9, 2)]
        rng.shuffle(odd)
        body = "".join(f"<p>{x}</p>" for x in odd)
        zone = ("article", "section class=entry")[i // 4 % 2]
        html = {0: f"<div>{notices[0]}</div>{body}", 1: f"<nav>{notices[1]}</nav><{zone}>{body}</{zone[:7]}>", 2: f"<div id=story>{body}</div><div class=notice>{notices[i % 3]}</div>", 3: f"<div>{body}</div><footer>{notices[2]}</footer>"}[shape]
        rows.append((i, f"http://{host}/{i}", html))
    rows += [(200, None, None), (201, "nothing", ""), (202, "http://h0.example/a", rows[1][2]), (202, "http://h0.example/a", rows[1][2])]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("TEXT", F.lit(1)))
    assert sorted(((r.page_id, r.text) for r in got.collect()), key=str) == brute_texts(rows)
    lost = {r.page_id for r in got.where("n_removed > 0").collect()}
    assert lost & {i for i in range(120) if i % 4 in (1, 2)} and lost & {i for i in range(120) if i % 4 in (0, 3)} and "TEXT" not in got.columns


def test_html_extraction_on_pages(spark, sf):
    from html import unescape

    got = llm_queries.QUERIES["op1_html_extraction"](spark, sf).toPandas().set_index("page_id")
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(unescape(x).split()) for x in re.split(r"</?(?:p|h1|br)>", re.sub(r"</?b>", "", inner))]
        assert got.text[r.page_id] == " ".join(b for b in blocks if b) and got.n_chars[r.page_id] == len(got.text[r.page_id])


def test_html_open_pages_lose_what_their_host_repeats(spark):
    shared = "these eight words stand on every page here"
    pages = spark.createDataFrame([(i, f"http://h.example/{i}", f"<div>{shared}</div><p>own{i} text</p>", "x") for i in range(3)] + [(9, None, None, "x"), (8, "http://h.example/8", "", "x")], "page_id long, url string, html string, Text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.main_text(pages).collect()}
    assert got == {0: ("own0 text", 9), 1: ("own1 text", 9), 2: ("own2 text", 9), 9: ("", 0), 8: ("", 0)}
    assert html_text.main_text(pages.limit(0)).count() == 0


def test_html_copies_of_a_page_keep_their_text(spark):
    """Equal pages, print versions of one or two other urls, and a page that stands in the table many times."""
    body = " ".join(f"word{i}" for i in range(60))
    rows = [(i, "http://h.example/a", f"<div>{body}</div>") for i in range(5)] + [(10, "http://h.example/print", f"<p>{body}</p><div>Print this</div>"), (11, "http://h.example/amp", f"<b>{body}</b>")]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == dict.fromkeys(range(5), body) | {10: f"{body} Print this", 11: body}


def test_html_notice_in_a_named_zone_goes_if_other_pages_have_it_outside(spark):
    notice, passage = "we use small files to remember what you read here", "a passage of more than eight words that articles of this host share"
    rows = [(i, f"http://h.example/{i}", f"<div class=notice>{notice}</div><article><p>own{i}</p><p>{passage}</p></article>") for i in range(4)] + [(8, "http://h.example/8", f"<article><p>own8</p><p>{notice}</p></article>")] + [(9, "http://h.example/9", f"<div class=post><p>own9</p><p>{notice}</p><p>{passage}</p></div>")]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"own{i} {passage}" for i in (0, 1, 2, 3, 9)} | {8: f"own8 {notice}"}


# 2 ---------------------------------------------------------------------------------------------------------------


def brute_licenses(text):
    """Names whose wording is the nearest in some window of the text's words, found without anchors or compression."""
    s = license_scan.scanner(tuple(license_scan.TEMPLATES.items()))
    w, out = [x.encode() for x in split(text)], set()
    for length in {len(own) for own in s.wordings}:
        for i in range(len(w)):
            here = w[max(0, i - length // 4) : i + length + length // 4]
            have = set(here)
            near = {s.names[t]: len(d[0]) + len(d[1]) for t, own in enumerate(s.wordings) if sum(x in have for x in own) >= 0.8 * len(own) and (d := s.differences(here, t)) is not None}
            out |= {n for n, d in near.items() if d == min(near.values())}
    return out


def test_license_scan(spark, documents, odd, empty):
    cases = {
        "Intro. Released under the MIT License.\nmore": {"MIT"},
        "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0": {"Apache-2.0"},
        "This work is licensed under the GNU General Public License, version 2.": {"GPL-2.0"},
        "This work is licensed under the GNU General Public License, version 4.": set(),
        "All rights reserved. Licensed under CC BY-NC 4.0.": {"reserved", "CC-BY-NC-4.0"},
        "Licensed under CC BY 4.0.": {"CC-BY-4.0"},
        "released under the XYZ license": set(),
        "Permission is hereby granted, free of charge, to any person getting a copy of this software and its associated documentation files (the Software), to deal in the Software without restriction": {"MIT-permission"},
    }
    docs = spark.createDataFrame(list(enumerate(cases)), DOCS)
    got = {r.text: {x.name for x in r.licenses} for r in license_scan.license_scan(docs.withColumn("LICENSE", F.lit(1))).collect()}
    assert got == cases
    for r in license_scan.license_scan(documents.where("text ILIKE '%licen%' OR text ILIKE '%reserved%' OR doc_id < 20").select("doc_id", F.substring_index("text", "\n", -3).alias("text"))).collect():
        assert {x.name for x in r.licenses} == brute_licenses(r.text)
    assert license_scan.license_scan(odd).where("license IS NOT NULL").count() == 0
    assert license_scan.license_scan(empty).count() == 0
    changed = next(x for r in license_scan.license_scan(docs).collect() for x in r.licenses if x.name == "MIT-permission")
    assert (changed.lacking, changed.added) == ("obtaining", "getting its") and changed.saved > 50


def test_license_scan_openings_are_not_exact(spark, tmp_path):
    texts = [license_scan.TEMPLATES["ISC-permission"] + ".", license_scan.TEMPLATES["MIT"]]
    spark.createDataFrame(list(enumerate(texts)), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.license, r.exact) for r in license_scan.op2_license_scan(spark, str(tmp_path)).collect()}
    assert got == {0: ("ISC-permission", False), 1: ("MIT", True)}


def test_license_scan_tells_whole_licenses_apart(spark):
    """Each whole text, wrapped as a comment amid prose, is named as itself; with some words altered that all permissive ones share, it is named still. The Apache notice holds the short one."""
    whole = {n: t for n, t in license_scan.TEMPLATES.items() if len(split(t)) > 28 and n not in license_scan.OPENINGS}
    assert {"0BSD", "ISC", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-or-later", "GPL-3.0-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later", "MIT-text"} <= set(whole)

    def comment(t):
        parts = t.split()
        return "int main of the tool\n/*\n" + "\n".join(" * " + " ".join(parts[i : i + 9]) for i in range(0, len(parts), 9)) + "\n */\nvoid run the tool"

    def altered(t):
        shared = set.intersection(*(set(split(x)) for n, x in whole.items() if n[:3] in ("MIT", "BSD", "ISC", "0BS")))
        return " ".join("zzz" if i % 25 == 7 and split(x) and split(x)[0] in shared else x for i, x in enumerate(t.split()))

    cases = [(n, comment(t)) for n, t in whole.items()] + [(n, altered(t)) for n, t in whole.items()]
    both = comment(whole["BSD-2-Clause"]) + " " + comment(whole["BSD-3-Clause"]) + " " + comment(whole["ISC"])
    body_altered = whole["MIT-text"].replace("sublicense", "").split(" THE SOFTWARE IS")[0] + " No other terms hold."
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)] + [(900, both), (901, body_altered)], DOCS)
    got = {r.doc_id: [x.name for x in r.licenses] for r in license_scan.license_scan(docs).collect()}
    assert {i: got[i] for i in range(len(cases))} == {i: ["Apache-2.0", n] if n == "Apache-2.0-notice" else [n] for i, (n, _) in enumerate(cases)}
    assert "zzz" in altered(whole["BSD-3-Clause"]) and "zzz" in altered(whole["0BSD"])
    assert got[900] == ["BSD-2-Clause", "BSD-3-Clause", "ISC"] and got[901] == ["MIT-permission"]


def test_license_scan_goes_on_down_the_ranking(spark):
    """Siblings that differ in one number save about as many bytes as the notice that stands."""
    line = "Distributed under the terms of the example public license edition {} by its authors"
    templates = {f"e{y}": line.format(y) for y in (11, 12, 13, 14, 15, 16)}
    docs = spark.createDataFrame(list(enumerate(templates.values())), DOCS)
    got = {r.doc_id: r.license for r in license_scan.license_scan(docs, templates).collect()}
    assert got == dict(enumerate(templates))


def test_license_scan_of_license_like_prose():
    """Long prose of the templates' own words makes no blocks but where enough of a template's words stand."""
    import time

    rng = np.random.default_rng(2)
    pool = sorted({x for t in license_scan.TEMPLATES.values() for x in split(t)} | {f"w{i}" for i in range(400)})
    text = " ".join(rng.choice(pool, 100_000)) + " " + license_scan.TEMPLATES["MIT-permission"]
    s, began = license_scan.scanner(tuple(license_scan.TEMPLATES.items())), time.process_time()
    assert len(s.candidates(words(binary([text])))) < 200 and time.process_time() - began < 20


def test_license_scan_counts_repeated_lines(spark):
    lines = {"Licensed under CC BY 4.0.": 6, "All rights reserved.": 3, "Released under MIT License.": 4, license_scan.TEMPLATES["MIT-permission"] + ".": 29}
    cases = [(f"{' '.join([line] * k)} End.", n, k) for line, n in lines.items() for k in (1, 2, 3, 5)]
    docs = spark.createDataFrame([(i, text) for i, (text, _, _) in enumerate(cases)], DOCS)
    got = {r.doc_id: [(x.first, x.last) for x in r.licenses] for r in license_scan.license_scan(docs).collect()}
    for i, (text, n, k) in enumerate(cases):
        assert got[i] == [(j * n, j * n + n - 1) for j in range(k)], text


# 3 ---------------------------------------------------------------------------------------------------------------


def brute_hits(docs, items):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add("null" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[x]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return pd.DataFrame(out, columns=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def hits_frame(hits):
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated").toPandas()


def test_decontamination_query_equals_sql(spark, duck, sf):
    name = "op3_benchmark_decontamination"
    assert rows_of(llm_queries.QUERIES[name](spark, sf).toPandas()) == rows_of(duck.sql(llm_queries.SQL[name]).df())


@pytest.mark.parametrize(("block", "piece"), [(1 << 20, 1 << 14), (40, 1 << 14), (300, 70)])
def test_decontamination_brute_force(spark, odd, monkeypatch, block, piece):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontaminate, "PIECE_BYTES", piece)
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma"], n))
    items = [(1, text(25)), (2, text(10)), (None, text(4)), (2, text(12)), (3, ""), (4, None), (5, "One, TWO!"), (10, text(11))]
    docs = ODD + [(100 + i, text(int(rng.integers(1, 400)))) for i in range(20)] + [(200, "x " + items[0][1] + " y")]
    got = decontaminate.benchmark_hits(spark.createDataFrame(docs, DOCS).withColumn("Items", F.lit(1)), spark.createDataFrame(items, "item_id long, text string"))
    assert rows_of(hits_frame(got)) == rows_of(brute_hits(docs, items))
    spans = {r.doc_id: r.spans for r in got.collect()}
    assert any((s.first, s.last) == (1, 26) or (s.first <= 1 and s.last >= 26) for s in spans[200])
    if piece < 1 << 14:
        long = spark.createDataFrame([(7, text(500)), (7, text(9))] + [(8, text(40))] * 30, "item_id string, text string")
        pieces = [(r.item_id, bytes(r.text).split()) for r in decontaminate._pieces(long, 10).collect()]
        of = lambda rows: {(i, tuple(w[k : k + 10])) for i, w in rows for k in range(max(1, len(w) - 9))}
        assert of(pieces) == of([(r.item_id, r.text.encode().split()) for r in long.collect()])
        assert all(len(b" ".join(w)) <= piece or len(w) == 10 for _, w in pieces) and len(pieces) < 200
    none = decontaminate.benchmark_hits(odd, spark.createDataFrame([], "item_id long, text string"))
    assert none.where("contaminated").count() == 0 and none.count() == len(ODD)


# 4 ---------------------------------------------------------------------------------------------------------------


def test_sharding_is_balanced_and_whole(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", F.substring("text", 1, 900).alias("text"), "lang", "source")
    got = shard.with_slots(shard.kd_shards(docs, 24)).toPandas()
    wanted = {r.doc_id: (len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect()}
    assert {d: (s, c) for d, s, c in zip(got.doc_id, got["size"], got.text_crc32, strict=True)} == wanted
    sums = got.groupby("shard")["size"].sum()
    assert sorted(sums.index) == list(range(24)) and sums.max() - sums.min() < 4 * 908
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))


def test_sharding_of_ties_and_odd_rows(spark, odd, empty):
    same = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the same text").alias("text"), F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"))
    sums = shard.kd_shards(same, 24).groupBy("shard").agg(F.sum("size").alias("s")).toPandas()
    assert len(sums) == 24 and sums.s.max() <= 1.05 * sums.s.mean()
    assert shard.kd_shards(empty).count() == 0
    got = shard.with_slots(shard.kd_shards(odd, 3)).toPandas()
    assert len(got) == len(ODD) and all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))


def test_sharding_of_text_ids_and_clashing_columns(spark):
    rows = spark.range(200).select(F.concat(F.lit("d"), "id").alias("doc_id"), F.repeat(F.lit("x"), F.col("id").cast("int")).alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"), F.lit(1).alias("Shard"))
    sums = shard.kd_shards(rows, 4).groupBy("shard").agg(F.sum("size").alias("s")).toPandas()
    assert len(sums) == 4 and sums.s.max() - sums.s.min() <= 2 * 208


def test_sharding_splits_a_repeated_row(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("the same text").alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"))
    dealt = shard.kd_shards(rows, 24)
    got = shard.with_slots(dealt).toPandas()
    sums = got.groupby("shard")["size"].sum()
    assert len(got) == 3000 and len(sums) == 24 and sums.max() <= 1.1 * sums.mean() and sums.min() >= 0.9 * sums.mean()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert shard._dealt(dealt, 8).groupBy("block").count().toPandas()["count"].max() < 600


# 5 ---------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as f:
        raw = f.read()
    codec = bpe.Codec(raw, public_tokenizers.PATTERN)
    return codec, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


@pytest.mark.parametrize("every", [1, 7, 4096])
def test_bpe_equals_tiktoken(tokenizer, monkeypatch, every):
    monkeypatch.setattr(bpe, "WRITE_EVERY", every)
    codec, theirs = tokenizer
    codec.pieces.clear()
    rng = np.random.default_rng(every)
    parts = ["a", "b", " ", "aa", "  ", "\n", "\u00e9", "\u6f22\u5b57", "\U0001f642", "!", "1", "the", "ing", "'s", "\x00", "x" * 37, " " * 61, "=" * 83, "haha"]
    texts = ["".join(rng.choice(parts, int(rng.integers(0, 14)))) for _ in range(1500)] + [" " * 20001, "ab" * 5000, "the" * 3000, "\u00e9\u6f22" * 2000]
    for t in texts:
        ids = codec.encode(t).tolist()
        assert ids == theirs.encode_ordinary(t)
        assert "".join(codec.decode_stream([i] for i in ids)) == t


def test_bpe_of_bytes_that_are_no_utf8(spark, tokenizer):
    docs = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF62' AS STRING) AS text, 'x' AS Token_Ids")
    row = bpe.bpe_round_trip(docs).first()
    assert row.token_ids == tokenizer[1].encode_ordinary("a\ufffdb") and "Token_Ids" not in bpe.bpe_round_trip(docs).columns


def test_bpe_query_round_trip(spark, documents, odd, empty, tokenizer):
    for docs in (documents.select("doc_id", "text"), odd):
        for r in bpe.bpe_round_trip(docs.withColumn("raw", F.col("text"))).collect():
            ids = tokenizer[1].encode_ordinary(r.raw or "")
            assert r.token_ids == ids and r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256((r.raw or "").encode()).hexdigest()
    assert bpe.bpe_round_trip(empty).count() == 0


# 6 ---------------------------------------------------------------------------------------------------------------


def bag(text):
    w = split(text)
    return collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else collections.Counter()


def brute_groups(docs):
    by = collections.defaultdict(list)
    for d, t in docs:
        by[t or ""].append(d)
    texts = list(by)
    bags, group = [bag(t) for t in texts], list(range(len(texts)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            if both and both >= 0.8 * (sum(bags[i].values()) + sum(bags[j].values()) - both):
                group[root(i)] = root(j)
    least = lambda xs: min((x for x in xs if x is not None), default=None)
    members = collections.defaultdict(list)
    for i, t in enumerate(texts):
        members[root(i)] += by[t]
    return sorted(((d, least(members[root(i)]), least(by[t])) for i, t in enumerate(texts) for d in by[t]), key=str), sum(1 for i in range(len(texts)) if root(i) == i)


def near_copies(seed=5):
    rng = np.random.default_rng(seed)
    docs, n = list(ODD), 1000
    for size, edits in ((2, 1), (40, 4), (25, 1)):
        base = [f"w{rng.integers(0, 500)}" for _ in range(120)]
        for _ in range(size):
            t = list(base)
            for _ in range(int(rng.integers(0, edits + 1))):
                t[int(rng.integers(0, len(t)))] = f"e{rng.integers(0, 10**6)}"
            docs.append((n := n + 1, " ".join(t)))
    docs += [(n + 1 + i, " ".join(f"u{rng.integers(0, 10**6)}" for _ in range(50))) for i in range(30)]
    docs += [(n + 100, "go stop " * 40), (n + 101, "go stop " * 41), (n + 102, "go stop " * 90)]
    return docs


def test_bagminhash_is_unbiased():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(40):
        e, w1 = rng.integers(0, 2**62, 40).astype(np.uint64), rng.integers(0, 9, 40)
        w2 = np.where(rng.random(40) < 0.6, w1, rng.integers(0, 20, 40))
        a, b = w1 > 0, w2 > 0
        s = bagminhash.signatures(np.repeat([0, 1], [a.sum(), b.sum()]), np.concatenate([e[a], e[b]]), np.concatenate([w1[a], w2[b]]), 2, 480)
        errors.append((s[0] == s[1]).mean() - np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum())
    assert abs(np.mean(errors)) < 0.012 and np.std(errors) < 0.035


@pytest.mark.parametrize("block", [256, 3])
def test_near_duplicates_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    docs = near_copies()
    df = spark.createDataFrame(docs, DOCS).withColumns({"key": F.lit(1), "Own_Key": F.lit(2), "kept_id": F.lit(3)})
    wanted, groups = brute_groups(docs)
    assert sorted((tuple(r) for r in near_dedup.near_duplicates(df).collect()), key=str) == wanted
    kept = near_dedup.one_of_each_group(df).toPandas()
    assert len(kept) == groups and set(kept.columns) == {"doc_id", "text", "key", "Own_Key", "kept_id"}


def test_near_duplicates_of_text_ids(spark):
    docs = [(None if d is None else f"d{d}", t) for d, t in near_copies()]
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id string, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_groups(docs)[0]


def test_blocks_lose_no_pair_of_the_threshold():
    """Every pair of sets of similarity 0.8 or more is linked, and no other."""
    rng = np.random.default_rng(6)
    base, sets = rng.integers(-(2**62), 2**62, 200), []
    for _ in range(60):
        n = int(rng.integers(1, 40))
        kept = base[: int(rng.integers(1, 60))]
        sets.append(np.unique(np.concatenate([kept, rng.integers(-(2**62), 2**62, n // 8)])))
    arrays = {"root": pa.array([list(range(60))]), "members": pa.array([[x.tolist() for x in sets]])}
    batch = pa.RecordBatch.from_pydict({f"{side}_{c}": v for side in "xy" for c, v in arrays.items()})
    got = {(r["a"], r["b"]) for b in near_dedup._compare(iter([batch])) for r in b.to_pylist()}
    both = {(i, j): len(np.intersect1d(sets[i], sets[j])) for i in range(60) for j in range(i + 1, 60)}
    assert got == {(i, j) for (i, j), k in both.items() if k >= 0.8 * (len(sets[i]) + len(sets[j]) - k)} and len(got) > 20


def test_near_duplicates_of_documents(spark, documents, empty):
    docs = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in near_dedup.near_duplicates(documents).collect()), key=str) == brute_groups(docs)[0]
    assert near_dedup.near_duplicates(empty).count() == 0


def test_components_of_a_long_chain(spark):
    from lodestone.llm.graph import components

    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    assert {tuple(r) for r in components(links).collect()} == {(i, 0) for i in range(1, 61)} | {(101, 100)}


# 7 ---------------------------------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark, sf):
    big = sf.replace("0.001", "0.01")
    got = llm_queries.QUERIES["op7_language_id"](spark, big).toPandas().merge(spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang").toPandas())
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.98 and got.score.between(0, 1).all()


def test_language_of_odd_texts(spark, documents, odd, empty):
    model = language_id.train(documents)
    got = {(r.doc_id, r.text): r for r in language_id.identify(odd, model).collect()}
    assert all(got[d, t].lang_pred == "und" and got[d, t].rejected and got[d, t].score == 0 for d, t in ((1, None), (2, ""), (6, "!!! ... ???")))
    assert got[5, ODD[5][1]].lang_pred in model.languages
    alien = spark.createDataFrame([(1, "\u6f22\u5b57\u8a9e " * 50), (2, "\u041f\u0440\u0438\u0432\u0435\u0442 \u043c\u0438\u0440")], DOCS)
    assert all(r.rejected for r in language_id.identify(alien, model).collect())
    short = documents.select("doc_id", F.regexp_extract("text", r"^\p{L}{3,12} \p{L}{2,12} \p{L}{2,12}", 0).alias("text")).where("text != ''")
    assert short.count() > 50 and language_id.identify(short, model).where("rejected").count() <= 0.02 * short.count()
    assert language_id.identify(empty, model).count() == 0
    assert language_id.train(documents.limit(0)) is None
    assert language_id.identify(odd, None).where("rejected").count() == len(ODD)


def test_language_of_letters_of_all_planes(spark, documents):
    model = language_id.train(documents)
    texts = ["\U00030001", "\U0001e900\U0001e921 " * 40, "\u0928\u092e\u0938\u094d\u0924\u0947", "\u0301\u0301", "A\u0301b \U0001f642"]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(list(enumerate(texts)), DOCS), model).collect()}
    assert [got[i].lang_pred == "und" for i in range(5)] == [False, False, False, True, False] and got[1].rejected
    codes, _, n = language_id.letters(binary(texts), model.number)
    assert n.tolist() == [1, 80, 4, 0, 2] and (codes == 0).sum() == 10 + 39  # marks don't part a word


def test_language_rejects_a_language_that_it_has_not_learned(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    for foreign in ("de", "es"):
        model = language_id.train(docs.where(F.col("lang") != foreign))
        got = language_id.identify(docs.withColumn("long", F.length("text") > 100), model).groupBy((F.col("lang") == foreign).alias("foreign"), "long").agg(F.avg(F.col("rejected").cast("int")).alias("share")).toPandas()
        share = {(bool(r.foreign), bool(r.long)): r.share for r in got.itertuples() if r.foreign is not None and r.long is not None}
        assert share[True, True] > 0.95 and share[False, True] < 0.005, (foreign, share)


def test_language_clashing_columns(spark, documents):
    got = language_id.identify(documents.withColumns({"SCORE": F.lit("x"), "Rejected": F.lit(1)}), language_id.train(documents))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "lang_pred", "score", "cross_entropy", "rejected"]


def test_kneser_ney_sums_to_one():
    texts = pa.array(["abab abba", "baab"], pa.large_binary())
    number = language_id.numbering(np.array([ord("b"), ord("a")]))
    key, n = np.unique(language_id.grams(*language_id.letters(texts, number)[:2])[0], return_counts=True)
    codes = np.unique(key & np.uint64(0xFFFF))
    model = language_id.KneserNey(key, n, len(codes))
    for context in np.unique(key >> np.uint64(16)):
        assert np.isclose(np.exp(model.log_probability((context << np.uint64(16)) | codes)).sum(), 1.0)


class PlainKneserNey:
    """The same model from dictionaries of strings, with begin marks, letter by letter."""

    def __init__(self, texts, alphabet):
        order, self.alphabet = language_id.ORDER, alphabet
        grams = collections.Counter(g for t in texts for g in self.grams(t))
        self.levels = {}
        for n in range(order, 0, -1):
            ones, twos = (sum(1 for c in grams.values() if c == k) for k in (1, 2))
            total, kinds = collections.Counter(), collections.Counter()
            for g, c in grams.items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
            self.levels[n] = (grams, total, kinds, ones / (ones + 2 * twos) if ones and twos else 0.5)
            grams = collections.Counter(g[1:] for g in grams)

    @staticmethod
    def plain(text):
        return " ".join("".join(c.lower() if c.isalpha() else " " for c in text).split())

    def grams(self, text):
        t = " " * (language_id.ORDER - 1) + (f"{self.plain(text)} " if self.plain(text) else "")
        return [t[i : i + language_id.ORDER] for i in range(len(t) - language_id.ORDER + 1)]

    def probability(self, gram):
        p = 1 / self.alphabet
        for n in range(1, language_id.ORDER + 1):
            counts, total, kinds, discount = self.levels[n]
            g = gram[-n:]
            if total[g[:-1]]:
                p = max(counts[g] - discount, 0) / total[g[:-1]] * (counts[g] > 0) + discount * kinds[g[:-1]] / total[g[:-1]] * p
        return p

    def cross_entropy(self, text):
        grams = self.grams(text)
        return -sum(np.log(self.probability(g)) for g in grams) / len(grams)


def test_language_models_match_dictionaries(spark, documents):
    """Cross-entropies of whole texts and of texts of one to three letters, for every language; each letter counts."""
    few = documents.where("lang IS NOT NULL AND length(text) BETWEEN 1 AND 2000").select("doc_id", "text", "lang")
    model = language_id.train(few, sample=12)
    share = {r.lang: min(language_id.MOST_FITTED, 12 / r.n) for r in few.where(~language_id.held_out()).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    rows = few.where(~language_id.held_out()).withColumn("h", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000))).collect()
    asked = ["a", "zz", "ein", "the", *[r.text for r in rows[:6]], "  \u6f22 a "]
    got, _, n = model.cross_entropy(binary(asked))
    for i, lang in enumerate(model.languages):
        plain = PlainKneserNey([r.text for r in rows if r.lang == lang and r.h < share[lang] * 1_000_000], model.parts[i].alphabet)
        assert np.allclose(got[:, i], [plain.cross_entropy(t) for t in asked])
    assert n[:3].tolist() == [2, 3, 4]
    assert len(set(got[0].tolist())) == len(model.languages)


def test_letters_beyond_those_with_a_code_of_their_own(monkeypatch):
    monkeypatch.setattr(language_id, "DIRECT", 3)
    number = language_id.numbering(np.array([ord(c) for c in "abcdef"] + [0x1F600]))
    codes, text, n = language_id.letters(binary(["abd", "dé", "e" * 3, ""]), number)
    first, second = language_id.FIRST, language_id.SECOND
    assert codes[text == 0].tolist() == [0, 1, 2, first, second, 0] and codes[text == 1].tolist() == [0, first, second, language_id.UNSEEN, 0]
    assert codes[text == 2].tolist() == [0, *[first, second + 1] * 3, 0] and n.tolist() == [3, 2, 3, 0]


# 8 ---------------------------------------------------------------------------------------------------------------


def test_media_round_trip(spark, documents, odd, empty):
    docs = documents.select("doc_id", "text").unionByName(odd)
    got = media.media_round_trip(docs).toPandas()
    assert len(got) == docs.count()
    seen = collections.Counter(zip(got.doc_id.astype(object).where(got.doc_id.notna(), None), got.payload_sha256, strict=True))
    wanted = collections.Counter((r.doc_id, hashlib.sha256(media.payload_of((r.text or "").encode())).hexdigest()) for r in docs.collect())
    assert seen == wanted
    assert (got.payload_bytes % 576 == 0).all() and (got.payload_bytes >= got.n_bytes).all() and (got.payload_bytes > 0).all()
    assert got.groupby("payload_sha256").media_sha256.nunique().max() == 1 == got.groupby("payload_sha256").feature.nunique().max()
    assert media.media_round_trip(empty).count() == 0


def test_media_of_ids_that_are_no_whole_numbers(spark):
    docs = spark.createDataFrame([("a-1", "one", 1), (None, "two", 2), ("", None, 3), ("a-1", "one", 4)], "doc_id string, text string, MEDIA int")
    got = media.media_round_trip(docs)
    assert got.schema["doc_id"].dataType.simpleString() == "string"
    assert sorted(((r.doc_id, r.n_bytes) for r in got.collect()), key=str) == [("", 0), ("a-1", 3), ("a-1", 3), (None, 3)]
    dated = docs.selectExpr("DATE'2024-01-02' AS doc_id", "text")
    assert media.media_round_trip(dated).select("doc_id").distinct().collect()[0].doc_id.isoformat() == "2024-01-02"


def test_quality_of_ids_that_are_no_whole_numbers(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", "word " * (i + 1), f"s{i}") for i in range(40)], "doc_id string, text string, Score string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(f"d{i}", int(i > 20)) for i in range(40)], "doc_id string, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = llm_queries.QUERIES["op9_quality_classifier"](spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {f"d{i}" for i in range(40)} and all(0 <= r.score <= 1 for r in got)


def test_media_ranges_and_archives(spark, documents, monkeypatch, tmp_path):
    media.store(documents, f"file://{tmp_path}/a")
    reader = media.ArchiveReader(f"file://{tmp_path}/a")
    monkeypatch.setattr(media, "RANGE_BYTES", 10_000)
    parts = reader.partitions()
    ids = [x for p in parts for b in reader.read(p) for x in b.column("doc_id").to_pylist()]
    assert len(parts) > 5 and sorted(ids) == sorted(r.doc_id for r in documents.select("doc_id").collect())
    tries = []

    class Flaky:
        def open_input_file(self, path):
            tries.append(path)
            if len(tries) < 3:
                raise OSError("gone for now")
            return media._open(f"{tmp_path}/a/{parts[0].archive}")[0].open_input_file(f"{tmp_path}/a/{parts[0].archive}")

    first = next(iter(next(iter(reader.read(parts[0]))).column("media"))).as_py()
    assert media.ArchiveReader._member(Flaky(), "x", 0, len(first), zlib.crc32(first)) == first
    with pytest.raises(ValueError, match="damaged"):
        media.ArchiveReader._member(media._open(f"{tmp_path}/a")[0], f"{tmp_path}/a/{parts[0].archive}", 0, len(first), 1)


def test_media_appends_add_up(spark, documents, tmp_path):
    a, b = documents.where("doc_id < 50"), documents.where("doc_id BETWEEN 50 AND 80")
    media.store(a, f"file://{tmp_path}/m")
    media.store(b, f"file://{tmp_path}/m")
    read = spark.read.format("media_archive").load(f"file://{tmp_path}/m")
    assert sorted(r.doc_id for r in read.select("doc_id").collect()) == sorted(r.doc_id for r in a.union(b).select("doc_id").collect())
    read.where("doc_id < 10").write.format("media_archive").mode("overwrite").save(f"file://{tmp_path}/m")
    assert spark.read.format("media_archive").load(f"file://{tmp_path}/m").count() == documents.where("doc_id < 10").count()


def test_media_do_not_pass_through_spark(spark, documents, tmp_path):
    """Tasks that write encode texts, tasks that read measure members: one Python worker a task, and the same rows as of media read as rows."""
    media.store(documents, f"file://{tmp_path}/m")
    got = media.media_round_trip(documents)
    assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString() and "media" not in got.columns
    stored = media.features(spark.read.format("media_archive").load(f"file://{tmp_path}/m"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stored.select(got.columns).collect()))


def test_media_feature():
    """Against sums over single samples."""
    rng = np.random.default_rng(8)
    for n in (576, 1152, 576 * 7):
        x = rng.integers(0, 256, n).tolist()
        mean = sum(x) * 1000 // n
        spread = int((sum(v * v for v in x) / n - (sum(x) / n) ** 2) ** 0.5 * 1000)
        bands = [sum(v >> 4 == b for v in x) * 1000 // n for b in range(16)]
        rows = [x[i : i + 24] for i in range(0, n, 24)]
        edges = [i * len(rows) // 8 for i in range(9)]
        areas = [sum(v for r in rows[a:b] for v in r[c : c + 3]) * 8 // (b - a) for a, b in zip(edges[:-1], edges[1:], strict=True) for c in range(0, 24, 3)]
        bits = int("".join("1" if a > sum(areas) / 64 else "0" for a in areas), 2)
        assert media.feature(bytes(x)) == f"mean={mean};spread={spread};bands={','.join(map(str, bands))};areas={bits:016x}"


def test_png_is_lossless_and_checked():
    payload = media.payload_of(bytes(range(256)) * 9)
    image = media.to_png(payload)
    assert media.from_png(image) == payload
    with pytest.raises(ValueError):
        media.from_png(image[:60] + b"\x00" + image[61:])


# 9 ---------------------------------------------------------------------------------------------------------------


def test_quality_held_out(spark, sf):
    big = sf.replace("0.001", "0.01")
    got = llm_queries.QUERIES["op9_quality_classifier"](spark, big).toPandas().merge(spark.read.parquet(f"{big}/labels.parquet").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.95
    assert ((got.score >= 0.7) == (got.predicted == 1)).all() and got.score.between(0, 1).all()


def test_quality_moments_match_numpy(spark, documents, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model, measured = quality.fit(documents, labels)
    rows = measured.join(labels, "doc_id").toPandas()
    rows = rows[[zlib.crc32(str(d).encode()) % 4 != 2 for d in rows.doc_id]]
    x, y = np.stack(rows.statistics), rows.quality.to_numpy()
    mean = np.stack([(x[y == c].mean(axis=0) - x.mean(axis=0)) / model.scale for c in (0, 1)])
    assert np.allclose(model.mean, mean, atol=1e-6) and np.allclose(model.scale, np.maximum(x.std(axis=0), 1e-6), atol=1e-6)
    z = (x - model.centre) / model.scale
    logs = []
    for c in (0, 1):
        precision = model.factor[c].T @ model.factor[c]
        logs.append(np.log((y == c).mean()) + 0.5 * np.linalg.slogdet(precision)[1] - 0.5 * np.einsum("ij,jk,ik->i", z - model.mean[c], precision, z - model.mean[c]))
    assert np.allclose(model.difference(x), np.clip(logs[1] - logs[0], -quality.WIDEST, quality.WIDEST))


def test_quality_of_odd_texts(spark, documents, odd, empty, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.score_quality(odd.unionByName(documents.select("doc_id", "text")), labels)
    assert got.where("score IS NULL OR isnan(score)").count() == 0 and got.columns == ["doc_id", "text", "score", "predicted"]
    assert quality.score_quality(odd, labels.limit(0)).where("score = 0.5 AND predicted = 0").count() == len(ODD)
    assert quality.score_quality(empty, labels).count() == 0


# 10 --------------------------------------------------------------------------------------------------------------


def test_url_rules_and_parts(spark):
    urls = ["http://A.Example.COM/en/12?x=1", "https://example.com/en/7/a", "http://x.net/de/", "http://sub.example.net/de/80#t", "http://y.org/es/1", "http://y.org/ES/1", "nothing", None, "http://best-poker-casino.example/xxx/porn", "http://www.newspaper.example/about", "com://com", "http://notexample.com/en/7", "http://\n/x"]
    got = {r.url: (r.host, r.path, r["rule"], r.verdict) for r in url_filter.judge_urls(spark.createDataFrame([(u, 1) for u in urls], "url string, RULE int")).collect()}
    assert got == {
        urls[0]: ("a.example.com", "/en/12", "com/en/", "block"),
        urls[1]: ("example.com", "/en/7/a", "example.com/en/7", "allow"),
        urls[2]: ("x.net", "/de/", "net/de/", "allow"),
        urls[3]: ("sub.example.net", "/de/80", "example.net/de/8", "block"),
        urls[4]: ("y.org", "/es/1", "org/es/", "block"),
        urls[5]: ("y.org", "/ES/1", None, "allow"),
        urls[6]: ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        urls[8]: ("best-poker-casino.example", "/xxx/porn", None, "block"),
        urls[9]: ("www.newspaper.example", "/about", None, "allow"),
        urls[10]: ("com", "", None, "allow"),
        urls[11]: ("notexample.com", "/en/7", "com/en/", "block"),
        urls[12]: ("\n", "/x", None, "allow"),
    }


@pytest.fixture(scope="module")
def url_model(spark):
    return url_filter.train(url_filter.labelled_urls(spark).where("NOT held_out"))


def test_url_model_on_held_out_urls(spark, url_model):
    got = url_filter.judge_urls(url_filter.labelled_urls(spark).where("held_out"), (), url_model).toPandas()
    bad, blocked = got.label == 1, got.verdict == "block"
    assert (bad & blocked).sum() / bad.sum() > 0.8 and (~bad & blocked).sum() / (~bad).sum() < 0.01
    hosts = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("url").collect()
    assert not {re.split("[/?#]", r.url.split("://")[1])[0] for r in hosts} & {u.split("/")[2] for u, _, _ in url_filter.labelled_rows()}


def test_url_model_on_held_out_words(spark):
    """Words, not rows, held out: what it then knows of a bad host is its path and what it shares with other words."""
    held = [w for w in url_filter.BAD if zlib.crc32(w.encode()) % 5 == 0]
    shape = "url string, label double, held_out boolean"
    model = url_filter.train(spark.createDataFrame(url_filter.labelled_rows(bad_words=[w for w in url_filter.BAD if w not in held]), shape).coalesce(1))
    got = url_filter.judge_urls(spark.createDataFrame(url_filter.labelled_rows(bad_words=held), shape), (), model).toPandas()
    bad, blocked = got.label == 1, got.verdict == "block"
    assert (bad & blocked).sum() / bad.sum() > 0.15 and (~bad & blocked).sum() / (~bad).sum() < 0.01


def test_url_pages_about_bad_things_are_not_bad(spark, url_model):
    good = ["www.pillsbury.co.uk/", "stackoverflow.com/questions/123/tracking-id", "en.wikipedia.org/wiki/Gambling", "docs.python.org/3/library/torrent.html", "www.nytimes.com/2021/05/03/technology/spam.html", "www.essex.ac.uk/courses", "github.com/apache/spark", "www.bbc.co.uk/news/health-123", "www.scunthorpe.gov.uk/", "www.winchester.ac.uk/"]
    bad = ["kaufen-tabletten.de/", "best-casino-bonus.info/en/1", "cheap-viagra.net/buy", "torrent-keygen.org/", "payday-loans-24.com/"]
    got = {r.url: r.verdict for r in url_filter.judge_urls(spark.createDataFrame([(f"https://{u}",) for u in good + bad], "url string"), (), url_model).collect()}
    assert [got[f"https://{u}"] for u in good + bad] == ["allow"] * len(good) + ["block"] * len(bad)


def test_url_model_is_the_least_of_its_loss(spark, url_model):
    """Hashed n-grams counted anew; the loss is convex, so its least point is where the gradient is zero."""
    rows = url_filter.labelled_urls(spark).where("NOT held_out")
    full = url_model.transform(url_filter._framed(url_filter.with_host_and_path(rows))).select("own_host", "own_path", "label", "hashed", "probability").collect()
    for r in full[:50]:
        for part, text in enumerate((r.own_host, r.own_path)):
            for k, n in enumerate(url_filter.LENGTHS):
                block = r.hashed.indices // url_filter.DIMENSIONS == part * len(url_filter.LENGTHS) + k
                assert r.hashed.values[block].sum() == max(0, len(text) - n + 1)
    w, b = url_model.stages[-1].coefficients.toArray(), url_model.stages[-1].intercept
    gradient, slope = url_filter.RIDGE * w, 0.0
    for r in full:
        at, x = r.hashed.indices, r.hashed.values
        p = 1 / (1 + np.exp(-(w[at] @ x + b)))
        assert abs(p - r.probability[1]) < 1e-9
        gradient[at] += (p - r.label) * x / len(full)
        slope += (p - r.label) / len(full)
    assert np.abs(gradient).max() < 1e-3 and abs(slope) < 1e-3


def test_url_query_blocks_spam_hosts(spark, sf):
    big = sf.replace("0.001", "0.1")
    got = llm_queries.QUERIES["op10_url_filter"](spark, big).toPandas()
    assert len(got) == spark.read.parquet(f"{big}/pages.parquet").count()
    own = got[got["rule"].isna()]
    bad = own.host.str.contains("casino|bets|pills|adult|ads|spam")
    assert bad.sum() > 30 and (own[bad].verdict == "block").mean() > 0.8 and (own[~bad].verdict == "block").mean() < 0.02


def test_url_of_odd_urls(spark, url_model):
    rows = [(1, None, 1), (2, "http://x.example/" + "a" * 200_000, 1), (2, "http://x.example/" + "a" * 200_000, 1), (None, "://", 1), (4, "http://\u6f22.example/\U0001f642", 1)]
    got = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, HOST int"), model=url_model).toPandas()
    assert len(got) == 5 and "HOST" not in got.columns and got.block_probability.between(0, 1).all()
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string"), model=url_model).count() == 0

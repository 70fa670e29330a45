import hashlib
import zlib

import numpy as np
import pytest
from conftest import rows_of

from lodestone.llm import conversation_trie, hard_negatives, mixing
from lodestone.llm import queries as llm_queries


@pytest.mark.parametrize("name", ["op11_conversation_trie", "op12_mixing", "op13_hard_negatives"])
def test_matches_sql(spark, sf, duck, name):
    assert rows_of(llm_queries.QUERIES[name](spark, sf).toPandas()) == rows_of(duck.sql(llm_queries.SQL[name]).df())


def answers(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# 11 --------------------------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"
NODE = conversation_trie.NODES.names


def brute_trie(sequences):
    """sequences: id to a list of (role, text)."""
    nodes, below = {}, {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for g in nodes:
        if g:
            children.setdefault(g[:-1], []).append(g)
    for g in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[g]) - 1) * len(g[-1][1].encode()) if g else 0
        parts = [below[x] for x in children.get(g, [])]
        below[g] = (sum(p[0] for p in parts) or 1, own + sum(p[1] for p in parts))
    out = []
    for g, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(sequences[c]) == len(g))
        out.append((min(members), len(g), min(nodes[g[:-1]]) if g else None, len(members), len(children.get(g, [])), *below[g], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def plain_sequences(rows):
    out = {}
    for c, turn, role, text in rows:
        if c is not None:
            key = hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()
            out.setdefault(c, []).append(((turn is not None, turn or 0), key, (role or "", text or "")))
    return {c: [t[2] for t in sorted(v)] for c, v in out.items()}


@pytest.mark.parametrize("seed", range(4))
def test_tries_over_many_blocks(spark, monkeypatch, seed):
    """Few different turns, so that conversations share long prefixes, over blocks of a few conversations."""
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(conversation_trie, "BLOCK_TURNS", 14)
    monkeypatch.setattr(conversation_trie, "PIECE", 12)
    rows, hot = [], [("user", "ab"[int(x)] * 3) for x in rng.integers(0, 2, 9)]
    for c in range(150):
        turns = hot[: rng.integers(0, 10)] if c % 3 else []
        turns = turns + [("user", "abc"[int(x)]) for x in rng.integers(0, 1 + seed % 3, rng.integers(0 if turns else 1, 5))]
        rows += [(c, i, *t) for i, t in enumerate(turns)]
    found = conversation_trie.prefix_trie(conversation_trie.sequences(spark.createDataFrame(rows, TURNS)))
    assert answers(found, NODE) == brute_trie(plain_sequences(rows))


def test_one_sequence_over_all_blocks(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "BLOCK_TURNS", 10)
    rows = [(c, i, "user", "ä" * (i + 1)) for c in range(60) for i in range(3)] + [(c, i, "user", "ä" * (i + 1)) for c in range(100, 130) for i in range(c - 97)]
    found = conversation_trie.prefix_trie(conversation_trie.sequences(spark.createDataFrame(rows, TURNS)))
    assert answers(found, NODE) == brute_trie(plain_sequences(rows))


def test_odd_conversations(spark, tmp_path):
    """Null turns, roles, texts and ids; equal turn numbers; repeated rows; absent bases; clashing columns; rebuilt ones without turns."""
    rows = [(0, None, None, None), (0, 1, "user", "x" * 50_000), (0, 1, "user", "b"), (0, 1, "user", "b"), (None, 0, "user", "z"), (7, 5, "user", ""), (7, None, "assistant", "q"), (12, 0, "u", "\U0001f642"), (-3, 2, "u", "v")]
    rows += [(c, i, "u", f"{c % 5}{i}") for c in range(20, 40) for i in range(c % 12)]
    df = spark.createDataFrame(rows, TURNS)
    clashing = df.selectExpr("*", "'other' AS d", "1 AS n", "2 AS depth", "'group' AS `group`")
    clashing.write.parquet(f"{tmp_path}/conversations.parquet")
    plain = plain_sequences(rows)
    rebuilt = {}
    for c, turns in plain.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        rebuilt[c] = plain.get(base, [])[:h] + turns[h:]
    assert any(not turns for turns in rebuilt.values())
    assert answers(llm_queries.QUERIES["op11_conversation_trie"](spark, str(tmp_path)), NODE) == brute_trie(rebuilt)


def test_no_conversations(spark):
    empty = conversation_trie.prefix_trie(conversation_trie.sequences(spark.createDataFrame([], TURNS)))
    assert empty.columns == NODE and empty.count() == 0


# 12 --------------------------------------------------------------------------------------------------------------

SOURCES = "doc_id long, text string, source string"


def test_mix_meets_targets(spark):
    """Odd texts, null sources and ids; one source holds a third of all rows, one only copies, one nothing but empty texts."""
    rows = [(i, "word " * (i % 37 + 1), "big" if i % 3 == 0 else f"s{i % 4}") for i in range(3000)]
    rows += [(None, "same words here", "copies")] * 500 + [(i, "x", None) for i in range(9000, 9100)] + [(9500, None, "none"), (9501, "", "none"), (9502, " \t\n", "none"), (None, "long " * 40_000, "s1")]
    docs = spark.createDataFrame(rows, SOURCES).selectExpr("*", "'mine' AS Size", "1 AS h", "2 AS cut")
    out = mixing.mix(docs).toPandas()
    assert len(out) == len(rows) and out.columns.tolist() == ["doc_id", "text", "source", "h", "cut", "size", "source_size", "target", "taken"] and set(out.h) == {1}
    assert (out["size"] == [len((t or "").split()) for t in out.text]).all() and (out.taken <= 2 * out["size"]).all() and (out.taken >= 0).all()
    by = out.groupby("source", dropna=False).agg(target=("target", "first"), taken=("taken", "sum"), size=("size", "sum"), source_size=("source_size", "first"), largest=("size", "max"))
    assert (by["size"] == by.source_size).all() and (by.target <= 2 * by["size"]).all() and abs(by.target.sum() - 1.5 * by["size"].sum()) < 1e-6 * by["size"].sum()
    off = (by.taken - by.target).abs()
    assert (off <= by.largest / 2 + 1).drop(index="copies").all() and off["copies"] <= 500
    again = mixing.mix(docs.repartition(13), keep_text=False).toPandas()
    assert sorted(zip(again["size"], again.taken, strict=True)) == sorted(zip(out["size"], out.taken, strict=True))


def test_stopped_sources_share_again(spark):
    """Limits stop one source after the other, the last only once the others have handed theirs on."""
    rows = [(i, "w " * 10, "a") for i in range(10)] + [(i, "w " * 10, "b") for i in range(100)] + [(i, "w " * 10, "c") for i in range(400)]
    found = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, SOURCES).selectExpr("source", "20L div 2 AS size")).collect()}
    assert found == {"a": 200.0, "b": 2000.0, "c": 1.5 * 5100 - 2200}


def test_nothing_to_mix(spark):
    assert mixing.mix(spark.createDataFrame([], SOURCES)).count() == 0
    out = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, "", None)], SOURCES)).collect()
    assert [(r.size, r.target, r.taken) for r in out] == [(0, 0.0, 0)] * 2


# 13 --------------------------------------------------------------------------------------------------------------

EMBEDDINGS = "vec_id long, embedding array<float>, label int"


def brute_negatives(rows, is_anchor, positives=5, negatives=10):
    width = max((len(v) for _, v, _ in rows), default=0)
    m = np.array([list(v) + [0] * (width - len(v)) for _, v, _ in rows]).reshape(len(rows), width)
    ids, labels, out = np.array([r[0] for r in rows]), np.array([r[2] for r in rows]), []
    for i in range(len(rows)):
        if not is_anchor(ids[i]):
            continue
        s = (m @ m[i]).astype(int)
        order = np.lexsort((ids, -s))
        for p in [j for j in order if labels[j] == labels[i] and ids[j] != ids[i]][:positives]:
            fine = [j for j in order if labels[j] != labels[i] and 30 * s[p] <= 100 * s[j] <= 90 * s[p]][:negatives]
            out += [(ids[i], ids[p], r, ids[j], s[p], s[j]) for r, j in enumerate(fine, 1)]
    return sorted(tuple(int(x) for x in r) for r in out)


def vectors(rng, n, width, spread, hot=0):
    centres = rng.normal(size=(6, width))
    v = centres[rng.integers(0, 6, n)] + spread * rng.normal(size=(n, width))
    v[:hot] = v[0]
    return v / np.linalg.norm(v, axis=1)[:, None]


@pytest.mark.parametrize(("spread", "hot"), [(0.2, 0), (3.0, 400)])
def test_negatives_against_all_pairs(spark, monkeypatch, spread, hot):
    """Tight groups, where bounds rule lists out, and vectors without any, a third of them equal; several blocks of queries."""
    rng = np.random.default_rng(5)
    monkeypatch.setattr(hard_negatives, "QUERY_BYTES", 2000)
    monkeypatch.setattr(hard_negatives, "STEP_QUERIES", 7)
    monkeypatch.setattr(hard_negatives, "PIECE_ROWS", 20)
    rows = [(i, np.floor(256 * v).tolist(), i % 3) for i, v in enumerate(vectors(rng, 1200, 12, spread, hot))]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>, label int")
    found = hard_negatives.hard_negatives(df, df.vec_id % 25 == 0)
    assert sorted(tuple(r) for r in found.collect()) == brute_negatives(rows, lambda i: i % 25 == 0)


def test_bounds_rule_lists_out():
    """Every candidate of the first k is found although most pieces are never multiplied."""
    rng = np.random.default_rng(1)
    x = np.floor(256 * vectors(rng, 600, 12, 0.05))
    near = np.argmax(x @ x[:6].T, axis=1)
    visited = []

    class Seen(np.ndarray):
        @property
        def T(self):
            visited.append(len(self))
            return np.asarray(self).T

    pieces = []
    for j in range(6):
        rows = x[near == j]
        if len(rows):
            centre = rows.mean(0)
            pieces.append({"label": "a", "ids": np.flatnonzero(near == j), "rows": rows.view(Seen), "centre": centre, "radius": np.sqrt(((rows - centre) ** 2).sum(1).max())})
    one = np.full((1, 1), np.inf)
    q = hard_negatives.Queries(np.array([0]), np.array(["a"], dtype=object), x[:1], -one, one, -one)
    found = hard_negatives._visit(pieces, q, np.ones((1, len(pieces)), bool), 5, True)
    scores = x @ x[0]
    scores[0] = -1
    assert found[2].tolist() == sorted(scores.astype(int), reverse=True)[:5] and sum(visited) < 600


def test_odd_embeddings(spark, tmp_path):
    """Null and non-finite components, nulls, repeated ids, short and empty vectors, ties, clashing columns; then an empty table."""
    rng = np.random.default_rng(2)
    good = [(i, rng.normal(size=4).round(1).tolist(), i % 2) for i in range(240)]
    odd = [(1000, None, 1), (1001, [1.0, None, 0.0, 0.0], 1), (1002, [float("nan")] * 4, 0), (1003, [float("inf"), 0.0, 0.0, 0.0], 0), (1004, [1.0] * 4, None), (None, [1.0] * 4, 1), (1005, [], 1), (1100, [0.5], 0), (1100, [0.5], 0), (5, good[5][1], 1), (300, [0.0] * 4, 1), (500, [-1.0] * 4, 0)]
    df = spark.createDataFrame(good + odd, EMBEDDINGS).selectExpr("*", "1 AS v", "2 AS list", "3 AS slot")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    kept = [(i, np.floor(256 * np.float32(v).astype(float)).tolist(), (c + 1) % 10 if i % 7 == 0 else c) for i, v, c in good + odd if i is not None and c is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    found = llm_queries.QUERIES["op13_hard_negatives"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in found.collect()) == brute_negatives(kept, lambda i: i % 100 == 0)
    df.limit(0).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert llm_queries.QUERIES["op13_hard_negatives"](spark, f"{tmp_path}/none").count() == 0

"""Benchmark decontamination: an exact, prefix-filtered set join of item windows with whole documents.

A window is `window` consecutive words of a benchmark item (all words of a shorter item) and, for the join, the set
of its `shingle`-word shingles. A document contains the window only if it contains every shingle, so with containment
1 the necessary prefix is one shingle: the rarest, by counts over all documents. Documents join the windows on that
shingle alone; the shingle's place in the window bounds where the window can begin and end in the document (the
positional and the length bound), and the words are then compared byte by byte.

Scale: the documents are never shuffled. A benchmark of more than BLOCK_BYTES is cut into pieces of at most PIECE_BYTES
(or one window, if that is longer), which overlap by a window less a word, so that each window stands whole in one piece;
the distinct pieces are dealt by hash into blocks of half of BLOCK_BYTES on average, 64 pieces or more, each of which is
broadcast. With more than one block the documents pass once for each, and hits add up row by row. Neither a long item nor
rows that repeat make a block larger.

Nulls and odd inputs: a null or wordless text has no words and no hits; null item ids count as the text `null`; equal
item ids count once; an item without words has no window; empty tables give no rows or no hits; repeated documents
are judged row by row.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import map_texts, text_chunks
from lodestone.llm.words import Words, shingles, words
from lodestone.storage import materialise

#: Benchmark text that is broadcast at once.
BLOCK_BYTES = 2 << 20
#: Text of an item that goes into one block.
PIECE_BYTES = 16 << 10
WINDOW, SHINGLE = 10, 5


class Windows:
    """The distinct windows of a block of items, their shingles, and the items that have each."""

    def __init__(self, items: list[tuple[str, bytes]], window: int, shingle: int):
        self.shingle = shingle
        found: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        if items:
            w = words(pa.array([t for _, t in items], pa.large_binary()))
            for (item, _), first, last in zip(items, w.first[:-1], w.first[1:], strict=True):
                ws = w.bytes_of(first, last - first)
                for i in range(max(1, len(ws) - window + 1) if ws else 0):
                    found[tuple(ws[i : i + window])].add(item)
        self.words = sorted(found)
        self.items = [sorted(found[x]) for x in self.words]
        self.length = np.array([len(x) for x in self.words], np.int64)
        lines = words(pa.array([b" ".join(x) for x in self.words], pa.large_binary()))
        #: by shingle length (shorter than usual only for windows of fewer words): hash, window, place in the window
        self.shingles: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in sorted({min(shingle, n) for n in self.length.tolist()}):
            h, valid = shingles(lines, k)
            of = lines.text_of()
            at = np.flatnonzero(valid & (np.minimum(self.length, shingle)[of] == k))
            self.shingles[k] = (h[at], of[at], at - lines.first[of[at]])
        self.prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def order_by_rarity(self, counts: dict[tuple[int, int], int]) -> None:
        """Keep each window's necessary prefix: its rarest shingle; of equally rare ones the first."""
        for k, (h, of, place) in self.shingles.items():
            seen = np.array([counts.get((k, x), 0) for x in h.view(np.int64).tolist()], np.int64)
            order = np.lexsort((place, seen, of))
            first = np.ones(len(order), bool)
            first[1:] = of[order][1:] != of[order][:-1]
            chosen = order[first]
            chosen = chosen[np.argsort(h[chosen], kind="stable")]
            self.prefix[k] = (h[chosen], of[chosen], place[chosen])

    def candidates(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """First word and window of each place where a prefix shingle stands and the window fits into its text."""
        starts, ids = [], []
        for k, (keys, of, place) in self.prefix.items():
            h, valid = shingles(w, k)
            at = np.flatnonzero(valid)
            lo = np.searchsorted(keys, h[at])
            near = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == h[at])
            at, lo = at[near], lo[near]
            n = np.searchsorted(keys, h[at], "right") - lo
            row = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            begin, window, text = np.repeat(at, n) - place[row], of[row], np.repeat(np.searchsorted(w.first, at, "right") - 1, n)
            fits = (begin >= w.first[text]) & (begin + self.length[window] <= w.first[text + 1])
            starts.append(begin[fits])
            ids.append(window[fits])
        return (np.concatenate(starts), np.concatenate(ids)) if starts else (np.zeros(0, np.int64),) * 2

    def occurrences(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """First word and window of each true occurrence."""
        begin, window = self.candidates(w)
        same = np.fromiter((tuple(w.bytes_of(b, len(self.words[x]))) == self.words[x] for b, x in zip(begin, window, strict=True)), bool, len(begin))
        return begin[same], window[same]


def _pieces(items: DataFrame, window: int) -> DataFrame:
    """The distinct pieces of the items, kept in the shared folder: item_id, text."""
    most = PIECE_BYTES

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_chunks(batch):
                w, ids, out = words(texts), rows.column("item_id").to_pylist(), {"item_id": [], "text": []}
                for item, first, last in zip(ids, w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
                    while first < last:
                        end = min(last, max(first + window, int(np.searchsorted(w.end[:last], w.start[first] + most, "right"))))
                        out["item_id"].append(item)
                        out["text"].append(w.data[w.start[first] : w.end[end - 1]].tobytes())
                        first = last if end == last else end - window + 1
                yield pa.RecordBatch.from_pydict({"item_id": pa.array(out["item_id"], pa.string()), "text": pa.array(out["text"], pa.binary())})

    return materialise(items.mapInArrow(cut, "item_id string, text binary").distinct(), "pieces")


def _shingle_counts(docs: DataFrame, windows: Windows) -> dict[tuple[int, int], int]:
    """How often each shingle of the block occurs in all documents; at most as many rows as the block has shingles."""
    keys = {k: np.unique(h) for k, (h, _, _) in windows.shingles.items()}
    shared = docs.sparkSession.sparkContext.broadcast(keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {k: np.zeros(len(h), np.int64) for k, h in shared.value.items()}
        for batch in batches:
            for _, texts in text_chunks(batch):
                w = words(texts)
                for k, h in shared.value.items():
                    found, valid = shingles(w, k)
                    found = found[valid]
                    at = np.minimum(np.searchsorted(h, found), len(h) - 1)
                    totals[k] += np.bincount(at[h[at] == found], minlength=len(h))
        for k, h in shared.value.items():
            some = np.flatnonzero(totals[k])
            yield pa.RecordBatch.from_pydict({"k": pa.array(np.full(len(some), k), pa.int32()), "h": h[some].view(np.int64), "n": totals[k][some]})

    rows = docs.select("text").mapInArrow(count, "k int, h long, n long").groupBy("k", "h").agg(F.sum("n").alias("n")).collect()
    shared.unpersist()
    return {(r.k, r.h): r.n for r in rows}


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, keep_text: bool = True) -> DataFrame:
    """docs with n_words, n_hit, spans (runs of hit words, last excluded), items (sorted ids with an occurring window) and contaminated."""
    results = "n_words long, n_hit long, spans array<struct<first:long,last:long>>, items array<string>, contaminated boolean"
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = lambda df: df.agg(F.sum((F.octet_length("text") + F.octet_length("item_id")).cast("long"))).first()[0] or 0
    blocks = 1
    if size(items) > BLOCK_BYTES:
        items = _pieces(items, window)
        blocks = max(1, ceil(2 * size(items) / BLOCK_BYTES))
    out = docs
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        windows = Windows([(r.item_id, bytes(r.text)) for r in part.select("item_id", F.col("text").cast("binary").alias("text")).collect()], window, shingle)
        windows.order_by_rarity(_shingle_counts(docs, windows) if windows.words else {})
        shared = spark.sparkContext.broadcast(windows)
        carried = ("spans", "items") if block else ()

        def judge(texts: pa.Array, batch: pa.RecordBatch, shared=shared, carried=carried) -> list:
            windows, w = shared.value, words(texts)
            begin, which = windows.occurrences(w)
            count = w.count()
            spans_before, items_before = ([batch.column(batch.schema.get_field_index(f"in_{c}")).to_pylist() for c in carried] if carried else ([], []))
            edge = np.zeros(len(w.start) + 1, np.int64)
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + windows.length[which], -1)
            for text, spans in enumerate(spans_before):
                for s in spans:
                    edge[w.first[text] + s["first"]] += 1
                    edge[w.first[text] + s["last"]] -= 1
            hit = np.cumsum(edge)[:-1] > 0
            total = np.concatenate([[0], np.cumsum(hit)])
            n_hit = total[w.first[1:]] - total[w.first[:-1]]
            spans: list[list[dict]] = [[] for _ in count]
            items: list[set] = [set() for _ in count] if not items_before else [set(x) for x in items_before]
            for text, win in {*zip((np.searchsorted(w.first, begin, "right") - 1).tolist(), which.tolist(), strict=True)}:
                items[text].update(windows.items[win])
            for text in np.flatnonzero(n_hit):
                first, last = w.first[text], w.first[text + 1]
                step = np.diff(np.concatenate([[False], hit[first:last], [False]]).astype(np.int8))
                spans[text] = [{"first": a, "last": b} for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True)]
            return [count, n_hit, spans, [sorted(x) for x in items], n_hit > 0]

        out = map_texts(out, judge, results, needs=carried, keep_text=keep_text or block + 1 < blocks)
    return out


def op3_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    from lodestone.llm.common import table

    hits = benchmark_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep_text=False)
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")

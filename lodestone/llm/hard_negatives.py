"""Hard negatives from inverted lists with exact bounds: for each anchor its nearest rows of the same label, and for each of those the
best rows of other labels whose score lies in a window below the positive's.

Rows are dealt to their nearest k-means centroid and packed, by list and label, into pieces that keep their own centroid c
and radius r, so that every row x of a piece has q.c - |q| r <= q.x <= q.c + |q| r (Cauchy-Schwarz). A query visits pieces by
falling upper bound, skips those whose bounds miss its window, and stops when the bound falls strictly below its kth score,
so the result is exact whatever the lists are. It runs in two passes over the lists: the first visits each query's first
few lists and gives every query its kth score so far; with it the second rules out or visits all the others. Only rows that
reach that score leave a task.

Queries go to the tasks in broadcast blocks of at most QUERY_BYTES, however many there are; lists are never shuffled after
they are packed. Vectors are integers, so sums are exact and ties are real: they go to the smaller id.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from lodestone.llm.common import materialise, shared_dir, table

#: Distinct vectors, at about, that the centroids are fitted on. Every row is in the lists, and results do not depend on it.
SAMPLE = 20_000
MOST_LISTS = 1024
PIECE_ROWS = 1024
#: Bytes of the queries that are broadcast at once, and queries that one step of a task works on.
QUERY_BYTES, STEP_QUERIES = 16 << 20, 1024
#: Share of the lists that the first pass visits.
FIRST_SHARE = 0.05

_PIECES = pa.schema([("list", pa.int32()), ("label", pa.string()), ("ids", pa.binary()), ("rows", pa.binary()), ("centre", pa.binary()), ("radius", pa.float64())])
_FOUND = pa.schema([("q", pa.int64()), ("slot", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64())])
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def integer_vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, v) of the rows that take part, with components floor(scale * x) as doubles.

    Rows with a null vec_id or label, a null vector, or a component that is null or not finite take no part.
    """
    x = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall(x, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = embeddings.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(fine)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.transform(x, lambda x: F.floor(x * scale).cast("double")).alias("v"))


@dataclass
class Lists:
    """The packed inverted lists, and what all tasks know of them: centroids, and the type that holds scores exactly."""

    pieces: DataFrame
    centroids: np.ndarray
    dtype: str


def _matrix(column: pa.Array, width: int, dtype: str = "float64") -> np.ndarray:
    """An array of lists as rows; shorter ones end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    lengths = np.asarray(column.value_lengths())
    flat = np.asarray(column.flatten(), dtype)
    if n and (lengths == width).all():
        return flat.reshape(n, width)
    out = np.zeros((n, width), dtype)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def build_lists(vectors: DataFrame) -> Lists | None:
    """Inverted lists of all rows of a written table (vec_id, label, v); none of an empty one."""
    spark = vectors.sparkSession
    n, width, largest = vectors.agg(F.count("*"), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x))))).first()
    if not n:
        return None
    width = max(1, width)
    dtype = "float32" if width * (largest or 0) ** 2 < 1 << 24 else "float64"
    step = max(1, n // SAMPLE)
    padded = F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v")))
    sample = materialise(vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(step)) == 0).select(padded.alias("v")).dropDuplicates().select("v"), "sample")
    k = min(MOST_LISTS, max(1, int(n**0.5 / 2)), max(1, sample.count()))
    if k > 1:
        model = KMeans(k=k, maxIter=8, seed=7, initMode="random", featuresCol="x").fit(sample.select(array_to_vector("v").alias("x")))
        centroids = np.array(model.clusterCenters())
    else:
        centroids = np.zeros((1, width))
    half = (centroids**2).sum(1) / 2

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(2), width)
            nearest = np.concatenate([np.argmax(v[i : i + 4096] @ centroids.T - half, axis=1) for i in range(0, len(v), 4096)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype(np.int32))], names=["vec_id", "label", "v", "list"])

    def piece(ids: list, rows: list, key: tuple) -> tuple:
        x = np.array(rows)
        centre = x.mean(0)
        return *key, np.array(ids, np.int64).tobytes(), x.astype(dtype).tobytes(), centre.tobytes(), float(np.sqrt(((x - centre) ** 2).sum(1).max()))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, rows = None, [], []
        for batch in batches:
            made, v = [], _matrix(batch.column(2), width)
            for i, key in enumerate(zip(batch.column(3).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if ids and (key != now or len(ids) >= PIECE_ROWS):
                    made.append(piece(ids, rows, now))
                    ids, rows = [], []
                now = key
                ids.append(batch.column(0)[i].as_py())
                rows.append(v[i])
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), _PIECES, strict=True)], schema=_PIECES)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(piece(ids, rows, now), _PIECES, strict=True)], schema=_PIECES)

    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), "v")
    assigned = materialise(rows.mapInArrow(assign, "vec_id long, label string, v array<double>, list int"), "assigned")
    parts = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * width // (8 << 20)))
    order = ("list", "label", "vec_id")
    packed = assigned.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(pack, from_arrow_schema(_PIECES))
    return Lists(materialise(packed, "lists"), centroids, dtype)


@dataclass
class Queries:
    """A block of queries: vectors, ids, labels; for each and each slot a window of scores (low, high), and the kth score known so far."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    high: np.ndarray
    least: np.ndarray


def _first(found: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Of candidates (query, slot, score, id) the first k of each query and slot."""
    q, slot, score, ids = found
    order = np.lexsort((ids, -score, slot, q))
    q, slot, score, ids = (a[order] for a in found)
    if not len(q):
        return [q, slot, score, ids]
    starts = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (slot[1:] != slot[:-1])])
    place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    return [a[place < k] for a in (q, slot, score, ids)]


def _visit(pieces: list[dict], queries: Queries, chosen: np.ndarray, k: int, same_label: bool) -> list[np.ndarray]:
    """The first k candidates of each query and slot in the pieces that `chosen` allows, but for those that cannot be among the first k of all."""
    centres, radii = np.array([p["centre"] for p in pieces]), np.array([p["radius"] for p in pieces])
    exact = queries.vectors.astype(np.float64)
    middle, reach = exact @ centres.T, np.sqrt((exact**2).sum(1))[:, None] * radii * (1 + 1e-9) + 1e-3
    labels = np.array([p["label"] for p in pieces], dtype=object)
    allowed = chosen & ((queries.labels[:, None] == labels) == same_label) & (middle - reach <= queries.high.max(1)[:, None])
    upper = np.where(allowed, middle + reach, -np.inf)
    place = np.argsort(np.argsort(-upper, axis=1, kind="stable"), axis=1, kind="stable")
    least = np.maximum(queries.low, queries.least)
    best = [np.zeros(0, np.int64) for _ in range(4)]
    begin, width = 0, 1
    while begin < len(pieces):
        wanted = allowed & (place >= begin) & (place < begin + width) & (upper >= least.min(1)[:, None])
        found = [best]
        for j in np.flatnonzero(wanted.any(0)):
            rows, ids = pieces[j]["rows"], pieces[j]["ids"]
            at = np.flatnonzero(wanted[:, j])
            scores = queries.vectors[at] @ rows.T
            if same_label:
                scores[queries.ids[at][:, None] == ids] = -np.inf
            for slot in range(least.shape[1]):
                high, low = queries.high[at, slot], least[at, slot]
                inside = (scores >= low[:, None]) & (scores <= high[:, None]) & (scores > -np.inf)
                if inside.sum() > 4 * k * len(at) and len(ids) > k:
                    kth = np.partition(np.where(inside, scores, -np.inf), len(ids) - k, axis=1)[:, len(ids) - k]
                    inside &= scores >= kth[:, None]
                a, b = np.nonzero(inside)
                found.append([at[a], np.full(len(a), slot), scores[a, b].astype(np.int64), ids[b]])
        best = _first([np.concatenate(c) for c in zip(*found, strict=True)], k)
        key = best[0] * least.shape[1] + best[1]
        full = np.flatnonzero(np.bincount(key, minlength=least.size) == k)
        last = np.searchsorted(key, full, side="right") - 1
        least.reshape(-1)[full] = np.maximum(least.reshape(-1)[full], best[2][last])
        begin, width = begin + width, 2 * width if begin else 1
    return best


def _pass(lists: Lists, queries: Queries, k: int, same_label: bool, first: bool) -> DataFrame:
    """Candidates (q, slot, score, vec_id) of each query's first lists, or of all the others."""
    spark = lists.pieces.sparkSession
    shared = spark.sparkContext.broadcast((queries, lists.centroids))
    dtype, m = lists.dtype, max(1, round(FIRST_SHARE * len(lists.centroids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        everything, centroids = shared.value
        pieces = []
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                pieces.append(row | {"ids": ids, "rows": np.frombuffer(row["rows"], dtype).reshape(len(ids), -1), "centre": np.frombuffer(row["centre"])})
        if not pieces:
            return
        of = np.array([p["list"] for p in pieces])
        for i in range(0, len(everything.ids), STEP_QUERIES):
            part = Queries(*(getattr(everything, f)[i : i + STEP_QUERIES] for f in Queries.__dataclass_fields__))
            near = part.vectors @ centroids.T.astype(part.vectors.dtype)
            early = np.zeros(near.shape, bool)
            np.put_along_axis(early, np.argsort(-near, axis=1, kind="stable")[:, :m], True, axis=1)
            q, slot, score, ids = _visit(pieces, part, early[:, of] == first, k, same_label)
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(q + i, pa.int64()), pa.array(slot, pa.int32()), pa.array(score, pa.int64()), pa.array(ids, pa.int64())], schema=_FOUND)

    return lists.pieces.mapInArrow(run, from_arrow_schema(_FOUND))


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q", "slot").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(lists: Lists, queries: Queries, k: int, same_label: bool) -> DataFrame:
    """(q, slot, rank, score, vec_id): for each query and slot the first k rows whose score is in its window, of the query's label (but not of its id) or of others.

    queries is a bounded block; q is a place in it. Exact: see the module.
    """
    near = materialise(_top(_pass(lists, queries, k, same_label, True), k), "near")
    kth = near.where(F.col("rank") == k).select("q", "slot", "score").toArrow()
    least = queries.least.copy()
    least[np.asarray(kth["q"]), np.asarray(kth["slot"])] = np.asarray(kth["score"])
    rest = Queries(queries.ids, queries.labels, queries.vectors, queries.low, queries.high, least)
    return _top(near.drop("rank").unionByName(_pass(lists, rest, k, same_label, False)), k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, window: tuple[int, int, int] = (30, 90, 100)) -> DataFrame:
    """For each anchor row and each of its first `positives` other rows of its label, the first `negatives` rows of other labels in its window.

    vectors: (vec_id, label, v) without nulls, v whole numbers. A score is the inner product; higher ones come first, ties
    by smaller vec_id. A negative's score times window[2] lies between the positive's score times window[0] and times
    window[1], so a negative positive score has none. Other rows are rows of another vec_id; repeated rows count as often
    as they stand, and repeated anchors are answered each. Shorter vectors count as ending in zeros. An anchor without
    positives, and a positive without rows in its window, give no rows; nor does an empty table.
    """
    spark = vectors.sparkSession
    vectors = materialise(vectors.select("vec_id", "label", "v", is_anchor.alias("is_anchor")), "vectors")
    lists = build_lists(vectors)
    if lists is None:
        return spark.createDataFrame([], RESULT)
    width = lists.centroids.shape[1]
    found = vectors.where("is_anchor").select("vec_id", F.col("label").cast("string").alias("label"), "v", F.monotonically_increasing_id().alias("row"))
    anchors = materialise(found, "anchors")
    blocks = -(-anchors.count() * width * np.dtype(lists.dtype).itemsize // QUERY_BYTES)
    folder = f"{shared_dir(spark)}/negatives-{uuid.uuid4().hex}"
    spark.createDataFrame([], RESULT).write.parquet(folder)
    low, high, unit = window
    for block in range(blocks):
        part = anchors.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).toArrow()
        n = part.num_rows
        if not n:
            continue
        ids, rows = np.asarray(part["vec_id"]), _matrix(part["v"], width).astype(lists.dtype)
        labels = np.array(part["label"].to_pylist(), dtype=object)
        everything = np.full((n, 1), np.inf)
        queries = Queries(ids, labels, rows, -everything, everything, -everything)
        near = materialise(search(lists, queries, positives, True), "positives")
        got = near.select("q", "rank", "score").toArrow()
        q, slot, score = np.asarray(got["q"]), np.asarray(got["rank"]) - 1, np.asarray(got["score"])
        lows, highs = np.full((n, positives), np.inf), np.full((n, positives), -np.inf)
        lows[q, slot], highs[q, slot] = -(-score * low // unit), score * high // unit
        windows = Queries(ids, labels, rows, lows, highs, np.full((n, positives), -np.inf))
        far = search(lists, windows, negatives, False)
        names = spark.createDataFrame(pa.table({"q": pa.array(np.arange(n), pa.int64()), "anchor_id": pa.array(ids, pa.int64())}))
        pairs = near.select("q", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).join(names, "q")
        joined = far.join(pairs, ["q", "slot"])
        joined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(folder)
    return spark.read.schema(RESULT).parquet(folder)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every row whose vec_id is divisible by 100, against all rows; the label of every seventh id is moved on by one first."""
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)

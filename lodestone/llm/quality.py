"""Quality classifier: regularised quadratic discriminant analysis of transformed document statistics.

Each class has a mean and a covariance of the statistics, the covariance shrunk towards the pooled one and its
diagonal. The score comes from the difference of the two log-densities, by Mahalanobis distances with cached Cholesky
factors, mapped to a probability by a logistic curve fitted to the learning rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import held_out, map_texts, materialise, named_apart
from lodestone.llm.words import words

POOLED, DIAGONAL = 0.3, 0.1  # shares of the pooled covariance and of the diagonal
BINS, WIDEST = 400, 40.0  # of log-density differences, for the logistic curve
THRESHOLD = 0.7
STATISTICS = ("log_words", "mean_word", "upper", "symbols", "digits", "stops", "lines", "distinct", "repeats", "adjacent", "packed", "short")
_CLASS = np.zeros(256, np.int8)  # 1 upper, 2 symbol, 3 digit, 4 stop, 5 line end
for _chars, _kind in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"!\"#$%&'*+-/<=>@[\\]^_`{|}~", 2), (b"0123456789", 3), (b".,;:?()", 4), (b"\n", 5)):
    _CLASS[list(_chars)] = _kind


def statistics(texts: pa.Array) -> np.ndarray:
    """[text, statistic], each transformed to a limited range; a text without words has zeros."""
    w = words(texts)
    n = w.count()
    one = np.maximum(n, 1)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    size = np.diff(offsets)
    owner = np.repeat(np.arange(len(texts)), size)
    kinds = np.bincount(owner * 6 + _CLASS[raw], minlength=6 * len(texts)).reshape(-1, 6)
    share = kinds / np.maximum(size, 1)[:, None]
    of = w.text_of()
    length = (w.end - w.start).astype(float)
    order = np.lexsort((w.hash, of))
    new = np.ones(len(of), bool)
    new[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (of[order][1:] != of[order][:-1])
    distinct = np.bincount(of[order][new], minlength=len(n))
    begin = np.flatnonzero(new)
    runs = np.diff(np.append(begin, len(of)))
    squares = np.bincount(of[order][begin], runs.astype(float) ** 2, len(n))
    same = (w.hash[1:] == w.hash[:-1]) & (of[1:] == of[:-1])
    adjacent = np.bincount(of[1:][same], minlength=len(n))
    packed = np.array([len(zlib.compress(t, 1)) / (len(t) + 20) for t in texts.to_pylist()])
    x = np.stack([np.log1p(n), np.log1p(np.bincount(of, length, len(n)) / one), np.sqrt(share[:, 1]), np.sqrt(share[:, 2]), np.sqrt(share[:, 3]), np.sqrt(share[:, 4]), np.sqrt(kinds[:, 5] / one), np.log1p(distinct) / np.log1p(one), np.sqrt(squares) / one, np.sqrt(adjacent / one), packed, 1.0 / (1.0 + n)], axis=1)
    x[n == 0] = 0.0
    return x


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    mean: np.ndarray  # [2, d]
    factor: np.ndarray  # inverse Cholesky factors, [2, d, d]
    constant: np.ndarray
    slope: float = 1.0
    intercept: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0."""
        z = (x - self.centre) / self.scale
        log = [self.constant[c] - 0.5 * (((z - self.mean[c]) @ self.factor[c].T) ** 2).sum(axis=1) for c in (0, 1)]
        return np.clip(log[1] - log[0], -WIDEST, WIDEST)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-(self.slope * self.difference(x) + self.intercept)))


def _discriminant(n: np.ndarray, sums: np.ndarray, products: np.ndarray) -> Model:
    """From counts, sums and sums of products of both classes."""
    total = n.sum()
    centre = sums.sum(axis=0) / total
    scale = np.sqrt(np.maximum(np.diag(products.sum(axis=0)) / total - centre**2, 1e-12))
    mean = (sums / n[:, None] - centre) / scale
    covariance = np.stack([(products[c] / n[c] - np.outer(sums[c], sums[c]) / n[c] ** 2) / np.outer(scale, scale) for c in (0, 1)])
    pooled = (covariance * n[:, None, None]).sum(axis=0) / total
    factor, constant = [], []
    for c in (0, 1):
        s = (1 - POOLED) * covariance[c] + POOLED * pooled
        s = (1 - DIAGONAL) * s + DIAGONAL * np.diag(np.maximum(np.diag(s), 1e-3))
        low = np.linalg.cholesky(s + 1e-6 * np.eye(len(s)))
        factor.append(np.linalg.inv(low))
        constant.append(np.log(n[c] / total) - np.log(np.diag(low)).sum())
    return Model(centre, scale, mean, np.stack(factor), np.array(constant))


def _logistic(x: np.ndarray, positive: np.ndarray, total: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve through binned counts, by Newton steps with a light ridge."""
    a = np.array([0.5, 0.0])
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(design @ a, -500, 500)))
        gradient = design.T @ (positive - total * p) - np.array([1e-2, 1e-2]) * a
        hessian = (design * (total * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        a = a + np.clip(step, -1.0, 1.0)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(a[0], 1e-3)), float(a[1])


def with_statistics(docs: DataFrame) -> DataFrame:
    def measure(texts: pa.Array, _: pa.RecordBatch) -> list:
        x = statistics(texts)
        return [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))]

    return map_texts(docs, measure, "statistics array<double>", keep_text=False)


def train(measured: DataFrame, labels: DataFrame) -> Model | None:
    """A model from the statistics and labels of rows outside the held-out fold; None unless both labels occur.

    Only moments (two rows) and binned counts reach the driver. A doc_id with several labels learns from each.
    """
    rows = measured.where(~held_out()).select("doc_id", "statistics").join(labels.where("quality in (0, 1)").select("doc_id", F.col("quality").alias("y")), "doc_id").select("y", "statistics")
    d = len(STATISTICS)
    sums = [F.sum(F.col("statistics")[i]).alias(f"s{i}") for i in range(d)]
    products = [F.sum(F.col("statistics")[i] * F.col("statistics")[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i + 1)]
    found = {r.y: r for r in rows.groupBy("y").agg(F.count("*").alias("n"), *sums, *products).collect()}
    if len(found) < 2:
        return None
    full = np.array([[[found[c][f"p{max(i, j)}_{min(i, j)}"] for j in range(d)] for i in range(d)] for c in (0, 1)], float)
    model = _discriminant(np.array([found[c].n for c in (0, 1)], float), np.array([[found[c][f"s{i}"] for i in range(d)] for c in (0, 1)], float), full)

    def binned(batches):
        counts = np.zeros((2, BINS + 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(1).flatten()).reshape(-1, d)
                at = np.rint((model.difference(x) + WIDEST) * (BINS / (2 * WIDEST))).astype(int)
                np.add.at(counts, (batch.column(0).to_numpy(), at), 1)
        y, at = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({"y": pa.array(y, pa.int32()), "at": pa.array(at, pa.int32()), "n": counts[y, at]})

    counts = np.zeros((2, BINS + 1))
    for r in rows.mapInArrow(binned, "y int, at int, n long").groupBy("y", "at").agg(F.sum("n").alias("n")).collect():
        counts[r.y, r.at] = r.n
    model.slope, model.intercept = _logistic(np.arange(BINS + 1) * (2 * WIDEST / BINS) - WIDEST, counts[1], counts.sum(axis=0))
    return model


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Model | None, DataFrame]:
    """The model, and doc_id and statistics of all documents in a table of the shared folder."""
    measured = materialise(with_statistics(docs.select("doc_id", "text")).select("doc_id", "statistics"), "statistics")
    return train(measured, labels), measured


def _scores(x: np.ndarray, model: Model | None) -> np.ndarray:
    return model.score(x) if model else np.full(len(x), 0.5)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= THRESHOLD).

    Null, empty and wordless texts have zero statistics and are scored with these; without both labels to learn from
    every score is 0.5. Labels of ids that are no document, and labels other than 0 and 1, don't count.
    """
    model, _ = fit(docs, labels)
    scored = map_texts(docs, lambda texts, _: [_scores(statistics(texts), model)], "score double")
    return scored.select(*[F.col(f"`{c}`") for c in named_apart(scored, ["predicted"])], (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    from lodestone.llm.common import table

    model, measured = fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

    def judge(batches):
        for batch in batches:
            x = np.array(batch.column(1).flatten()).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(x, model))], names=["doc_id", "score"])

    shape = T.StructType([measured.schema["doc_id"], T.StructField("score", T.DoubleType())])
    scored = measured.mapInArrow(judge, shape)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

"""Labelled documents, all of them or a bounded sample, and a logistic calibration."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written


#: Labelled ids that are broadcast, some 10 MB
FEW_IDS = 200_000


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids have none."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int | None, seed: int) -> tuple[DataFrame, dict[int, int]]:
    """``doc_id, text, label, fold`` of at most ``rows`` documents per class, or of all with None, and all labelled documents by class.

    ``labels`` has ``doc_id`` and the column ``label`` (0 or 1; rows with nulls or anything else are left out, and of
    rows with one id the larger label counts). Only labels of documents that are here count. The ids with the smallest
    seeded hashes are taken, an id once: of rows that share it, the one whose text has the smallest hash. Each text counts
    once in a class, under its smallest id; ``fold`` halves them. The same tables give the same sample.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    here = docs.select("doc_id").distinct().join(known, "doc_id")
    sizes = {r[0]: r[1] for r in here.groupBy("label").count().collect()}
    mark = F.xxhash64(F.lit(seed), "doc_id")
    if rows is not None:
        parts = [here.where(F.col("label") == c).orderBy(mark, "doc_id").limit(rows) for c in (0, 1)]
        here = parts[0].union(parts[1])
    chosen = here.select("doc_id", "label", F.pmod(mark, F.lit(2)).cast("int").alias("fold"))
    few = sum(n if rows is None else min(n, rows) for n in sizes.values()) <= FEW_IDS
    found = docs.select("doc_id", "text").join(F.broadcast(chosen) if few else chosen, "doc_id")
    text_order = F.struct(F.col("text").isNull(), F.xxhash64(F.lit(seed), "text"), "text")  # label and fold are the id's
    of_id = found.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("fold").alias("fold"), F.min(text_order).alias("row")).select("doc_id", "label", "fold", "row.text")
    once = of_id.groupBy("label", "text").agg(F.min(F.struct("doc_id", "fold")).alias("row"))
    return written(once.select("row.doc_id", "text", "label", "row.fold"), "sample"), sizes


def _newton(steps: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], width: int, n: int, ridge: float = 0.01) -> np.ndarray:
    """Weights at which the gradient, with the ridge, is zero; ``steps`` gives gradient and curvature at a point."""
    w, pull = np.zeros(width), np.eye(width) * ridge * max(1.0, n / 100)
    for _ in range(60):
        gradient, curvature = steps(w)
        step = np.linalg.solve(curvature + pull, gradient + pull @ w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Logistic:
    """Ridge logistic regression on standardised features, fitted by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.01):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z, weight = self._prepared(x), weight / weight.mean()

        def steps(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            p = self._sigmoid(z @ w)
            return z.T @ (weight * (p - y)), (z * (weight * p * (1 - p))[:, None]).T @ z

        self.w = _newton(steps, z.shape[1], len(y), ridge)

    @classmethod
    def of(cls, mean: np.ndarray, scale: np.ndarray, w: np.ndarray) -> Logistic:
        out = cls.__new__(cls)
        out.mean, out.scale, out.w = mean, scale, w
        return out

    def _prepared(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.clip((x - self.mean) / self.scale, -30, 30), np.ones(len(x))])

    @staticmethod
    def _sigmoid(v: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(v, -500, 500)))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._sigmoid(self._prepared(x) @ self.w)


def _sums(table: DataFrame, fn: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``fn(x, label)``, a short vector, over the batches of ``label, x``; one vector from each task."""

    def run(batches):
        total = 0
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column("x").flatten(), float).reshape(batch.num_rows, -1)
                total = total + fn(x, np.array(batch.column("label"), int))
        if isinstance(total, np.ndarray):
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["v"])

    return np.sum([r[0] for r in table.mapInArrow(run, "v array<double>").collect()], axis=0)


def fitted_over(table: DataFrame, sizes: dict[int, int]) -> Logistic | Share:
    """:func:`fitted` over a table ``label, x`` of any length: each Newton step is one pass that sums gradient and curvature."""
    taken = {r[0]: r[1] for r in table.groupBy("label").count().collect()}
    if len(taken) < 2:
        return Share(sizes)
    n = sum(taken.values())
    mean = _sums(table, lambda x, y: x.sum(axis=0)) / n
    scale = np.sqrt(_sums(table, lambda x, y: ((x - mean) ** 2).sum(axis=0)) / n) + 1e-9
    each = np.array([sizes[c] / taken[c] for c in (0, 1)]) * n / sum(sizes.values())

    def steps(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        model = Logistic.of(mean, scale, w)

        def part(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            z, weight = model._prepared(x), each[y]
            p = model._sigmoid(z @ w)
            return np.concatenate([z.T @ (weight * (p - y)), ((z * (weight * p * (1 - p))[:, None]).T @ z).ravel()])

        both = _sums(table, part)
        return both[: len(w)], both[len(w) :].reshape(len(w), len(w))

    return Logistic.of(mean, scale, _newton(steps, len(mean) + 1, n))


class Share:
    """Stands in where labels of a class are missing: the smoothed share of label 1."""

    def __init__(self, sizes: dict[int, int]):
        self.p = (sizes.get(1, 0) + 0.4) / (sum(sizes.values()) + 1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.p)


def fitted(x: np.ndarray, y: np.ndarray, sizes: dict[int, int]) -> Logistic | Share:
    """Calibrate to the shares that the classes have among all labelled rows, whatever the sample took of each."""
    taken = np.bincount(y, minlength=2)
    if min(taken) == 0:
        return Share(sizes)
    return Logistic(x, y.astype(float), np.array([sizes[c] / taken[c] for c in (0, 1)])[y])

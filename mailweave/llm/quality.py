"""Quality classifier: how much better zstandard dictionaries of good and of bad text compress a document."""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .calibrate import Logistic, Share, fitted, labelled_sample, remainder
from .common import load, map_slices, plain, raw_texts

ROWS = 4000
EXCERPT = 2000
DICTIONARY = 112_640
CHUNK = 1024
LEVEL = 3
SEED = 10
FOLDS, HELD_OUT = 3, 1


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    calibration: Logistic | Share

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "measure"}

    @cached_property
    def measure(self) -> _Sizes:
        """Compressors cannot travel; each worker makes its own."""
        return _Sizes(self)


class _Sizes:
    """Compressed sizes under both dictionaries."""

    def __init__(self, model: QualityModel):
        self.both = [self._compressor(d).compress if d else None for d in (model.good, model.bad)]

    @staticmethod
    def _compressor(data: bytes) -> zstandard.ZstdCompressor:
        known = zstandard.ZstdCompressionDict(data)
        known.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=known, write_content_size=False, write_dict_id=False)

    def features(self, text: bytes) -> tuple[float, float, float, float]:
        """The difference per raw byte and per compressed byte, the good ratio and the length; all 0 for no text."""
        if not text or None in self.both:
            return 0.0, 0.0, 0.0, 0.0
        chunks = [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]
        good, bad = (sum(map(len, map(f, chunks))) for f in self.both)
        return (bad - good) / len(text), (bad - good) / (bad + good), good / len(text), float(np.log1p(len(text)))


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; with too few samples to train one, the samples themselves."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY:]


def train_quality(docs: DataFrame, labels: DataFrame, rows: int = ROWS, seed: int = SEED) -> QualityModel:
    """Learn from at most ``rows`` labelled documents per class (``labels``: doc_id, quality).

    One half of the sample gives the dictionaries, from one excerpt of at most ``EXCERPT`` characters per document at
    a hashed place; the other half is scored whole, as any document is, and calibrates the difference.
    """
    sample, sizes = labelled_sample(docs, labels, "quality", rows, seed)
    room = F.greatest(F.lit(1), F.length("text") - EXCERPT + 1)
    excerpt = F.substring(F.col("text"), (F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), room) + 1).cast("int"), F.lit(EXCERPT))
    parts: dict[int, list[bytes]] = {0: [], 1: []}
    for label, text in sample.where("fold = 0 AND text IS NOT NULL").select("label", excerpt.alias("text")).orderBy("doc_id").collect():
        parts[label].append(text.encode())
    model = QualityModel(_dictionary(parts[1]), _dictionary(parts[0]), Share(sizes))
    if model.good and model.bad:
        held = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of bounded size

        def run(rows):
            return pa.RecordBatch.from_arrays([rows.column("label"), pa.array(_measured(held, rows).tolist(), pa.list_(pa.float64()))], names=["label", "x"])

        found = map_slices(sample.where("fold = 1").select("label", "text"), run, "label int, x array<double>").collect()
        if found:
            model.calibration = fitted(np.array([r[1] for r in found], float), np.array([r[0] for r in found], int), sizes)
    return model


def _measured(held, rows: pa.RecordBatch) -> np.ndarray:
    return np.array([held.value.measure.features(t) for t in raw_texts(rows)], float).reshape(-1, 4)


def quality_scores(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``doc_id, score`` (0 to 1, higher: better) of each whole text, in chunks of ``CHUNK`` bytes so that length does not dilute the dictionaries.

    Null and empty texts get the score of an empty text; texts of any length are read whole; repeated rows are scored each; an empty table gives no rows;
    no other column is read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows):
        score = held.value.calibration(_measured(held, rows))
        return pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(score)], names=["doc_id", "score"])

    return map_slices(plain(docs, "doc_id", "text"), run, "doc_id long, score double")


def good_documents(docs: DataFrame, model: QualityModel, least: float = 0.5) -> DataFrame:
    """The documents that score ``least`` or more, with all their columns.

    Where the model knows no labels of one class, it cannot tell documents apart: all are kept, with a warning. Null
    and empty texts are judged as empty ones, texts of any length whole, repeated rows each; an empty table stays empty.
    """
    if isinstance(model.calibration, Share):
        warnings.warn("no labelled documents of both classes: none is rejected", stacklevel=2)
        return docs
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows):
        score = held.value.calibration(_measured(held, rows))
        return rows.filter(pa.array(score >= least))

    return map_slices(docs, run, docs.schema)


def open_labels(labels: DataFrame) -> DataFrame:
    """The labels that may be learned from."""
    return labels.where(remainder(F.col("doc_id"), FOLDS) != HELD_OUT)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = train_quality(docs, open_labels(load(spark, sf_dir, "labels")))
    held_out = F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return quality_scores(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

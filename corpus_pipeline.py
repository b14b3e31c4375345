"""A training corpus from ``documents`` in five stages, each an operator for training data.

Each stage takes null and empty texts, texts of any length, repeated rows, null ids, other columns and an empty table; what
it does with them is said below or in its operator. All but the last return the columns they were given.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mailweave.llm.common import load, run_folder
from mailweave.llm.decontam import decontaminated
from mailweave.llm.packing import harmonic_pack
from mailweave.llm.pii import without_personal_data
from mailweave.llm.quality import good_documents, open_labels, train_quality
from mailweave.llm.simhash import one_row_of_each_group
from mailweave.llm.tokens import default_path
from mailweave.session import ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts; it learns from the labels of documents that are here.

    Null and empty texts are judged as the empty text, repeated rows each by itself. Without labels of both classes all stay, with a warning.
    """
    return good_documents(docs, train_quality(docs, open_labels(load(ship_package(spark), sf_dir, "labels"))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group: the smallest id, null ids last, and of rows that share it the first by number. Texts without words are one group."""
    return one_row_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of ``benchmark`` occurs; those without words stay, and all where ``benchmark`` has no words."""
    return decontaminated(docs, load(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked; null texts stay null."""
    return without_personal_data(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences; a null or empty text is a piece of its end id alone, repeated rows are packed each."""
    return harmonic_pack(docs, default_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("packing", packing),
]

#: No SQL: the quality classifier is trained, and tokens come from a tokenizer. The tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet to the shared folder and read by the next."""
    docs = load(ship_package(spark), sf_dir, "documents")
    for _, stage in STAGES:
        path = run_folder(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

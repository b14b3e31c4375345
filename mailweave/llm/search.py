"""Ranked lexical search: documents whose bags of query words are equal are scored once."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, plain, raw_texts, slices, text_bytes, written
from .decontam import FOLD

TOP = 20
#: Query texts whose vocabulary is sent to the tasks at a time
BLOCK_BYTES = 4 << 20
_PART = 1 << 20


def count_words(text: bytes, counts: Counter, known=None) -> int:
    """Add the words of ``text`` to ``counts``, as ``known`` maps them; the number of words. Long texts go in parts."""
    n, start, text = 0, 0, text.translate(FOLD)
    while start < len(text):
        end = text.find(b" ", start + _PART) if len(text) - start > _PART else -1
        end = len(text) if end < 0 else end
        words = text[start:end].split()
        counts.update(words if known is None else map(known, words))
        n, start = n + len(words), end
    return n


class QueryBlock:
    """Some items: their ids, their words numbered, and each item's words as {number: how often}."""

    def __init__(self, rows: list[tuple]):
        self.numbers: dict[bytes, int] = {}
        self.ids, self.items = [], []
        for item, text in rows:
            counts: Counter = Counter()
            count_words(text.encode(), counts)
            self.ids.append(item)
            self.items.append({self.numbers.setdefault(w, len(self.numbers)): n for w, n in counts.items()})


def _blocks(items: DataFrame, block_bytes: int) -> list[QueryBlock]:
    """The items, each different row once, in blocks of about ``block_bytes``."""
    rows = plain(items, "item_id", "text").where("text IS NOT NULL").distinct()
    n = max(1, math.ceil((rows.agg(F.sum(text_bytes())).first()[0] or 0) / block_bytes))
    for i in range(n):
        yield QueryBlock([tuple(r) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()])


def bags(docs: DataFrame, block: QueryBlock) -> DataFrame:
    """Each document's number of words and its bag, restricted to the block's vocabulary: ``doc_id, n, terms, tfs``."""
    sent = docs.sparkSession.sparkContext.broadcast(block.numbers)

    def run(batches):
        for batch in batches:
            for rows in slices(batch):
                lengths, terms, tfs = [], [], []
                for text in raw_texts(rows):
                    counts: Counter = Counter()
                    lengths.append(count_words(text, counts, sent.value.get))
                    counts.pop(None, None)
                    bag = sorted(counts.items())
                    terms.append([t for t, _ in bag])
                    tfs.append([n for _, n in bag])
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id").cast(pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(terms, pa.list_(pa.int32())),
                        pa.array(tfs, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n", "terms", "tfs"],
                )

    return plain(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


def bag_classes(found: DataFrame, n_docs: int, n_words: int, top: int) -> DataFrame:
    """Classes of documents with the same bag and length norm ``m``, with their ``top`` smallest ids.

    The hash stands first in the key, so that sorting rarely looks further; the vector and ``m`` behind it verify
    that members are equal. Tasks cut a class to its ``top`` smallest ids before they send it.
    """
    keyed = (
        found.where(F.size("terms") > 0)
        .withColumn("m", F.expr(f"75L + (25L * n * {n_docs}L) div {max(n_words, 1)}L"))
        .withColumn("h", F.xxhash64("m", "terms", "tfs"))
    )
    same = Window.partitionBy("h", "m", "terms", "tfs").orderBy(F.col("doc_id").asc_nulls_last())
    member = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    return (
        keyed.withColumn("place", F.row_number().over(same))
        .where(F.col("place") <= top)
        .groupBy("h", "m", "terms", "tfs")
        .agg(F.array_sort(F.collect_list(member)).alias("members"))
    )


def _best(scores: np.ndarray, first: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` highest scores above 0, equal ones by the smallest first member."""
    place = np.flatnonzero(scores > 0)
    if len(place) > top:
        least = np.partition(scores[place], -top)[-top]
        place = place[scores[place] >= least]
    return place[np.lexsort((first[place], -scores[place]))][:top]


def score_classes(classes: DataFrame, block: QueryBlock, weights: np.ndarray, top: int, id_type: str) -> DataFrame:
    """Score each class once for every item that shares a word with it: ``item, item_id, doc_id, score``.

    A batch of classes is turned to postings by word; an item adds up the postings of its words. Each batch gives an
    item its ``top`` best documents, so that what is sent on is bounded.
    """
    sent = classes.sparkSession.sparkContext.broadcast((block.ids, block.items, weights))
    last = np.iinfo(np.int64).max

    def run(batches):
        ids, items, weight = sent.value
        for batch in batches:
            terms, tfs = batch.column("terms"), batch.column("tfs")
            size = np.diff(terms.offsets.to_numpy())
            which = np.repeat(np.arange(batch.num_rows), size)
            term = terms.flatten().to_numpy()
            tf, m = tfs.flatten().to_numpy(), batch.column("m").to_numpy()[which]
            value = weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m))
            order = np.argsort(term, kind="stable")
            which, value = which[order], value[order]
            ends = np.cumsum(np.bincount(term, minlength=len(weight)))
            starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            members = [[x["doc_id"] for x in row] for row in batch.column("members").to_pylist()]
            first = np.array([last if row[0] is None else row[0] for row in members], np.int64)
            out = []
            for i, item in enumerate(items):
                scores = np.zeros(batch.num_rows, np.int64)
                for t, n in item.items():
                    scores[which[starts[t] : ends[t]]] += value[starts[t] : ends[t]] * n
                found = [(-int(scores[c]), d is None, d) for c in _best(scores, first, top) for d in members[c]]
                found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
                out += [(i, ids[i], d, -s) for s, _, d in found[:top]]
            if out:
                item, item_id, doc_id, score = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(item, pa.int32()), pa.array(item_id), pa.array(doc_id, pa.int64()), pa.array(score, pa.int64())],
                    names=["item", "item_id", "doc_id", "score"],
                )

    return classes.mapInArrow(run, f"item int, item_id {id_type}, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``top`` best documents of each item: ``item_id, rank, doc_id, score``.

    Words are runs of digits, letters and everything beyond ASCII, with only A-Z lower-cased. With N documents that
    have words, L words in all, n of a document, df documents holding a word and tf its occurrences:
    w = floor(1000 ln((2N+2)/(2df+1))), m = 75 + 25nN div L, score = sum of w (10^9 tf div (1000 tf + 12 m)) over the
    item's words, repeats included.

    Bag deduplication: documents are restricted to the items' vocabulary, those with the same word counts and m form
    a class (by hash, verified by the counts themselves), a class is scored once, and its members follow in order
    of their ids. Items come in blocks of bounded text, whose vocabulary is broadcast; a block is one pass over the
    documents, so any number of items goes.

    Null or wordless documents are found by nothing and do not count in N. Items with null or wordless text have no
    rows; a repeated item row is one item, rows that share an id but not the text are ranked apart, a null item_id is an id like others. Documents are
    rows: a repeated doc_id is ranked once a row, a null one comes last among equal scores. Texts of any length are
    read whole, in parts. Empty tables give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    id_type = items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")
    for block in _blocks(items, block_bytes):
        if not block.numbers:
            continue
        found = written(bags(docs, block), "bags")
        n_docs, n_words = found.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        # one row for each word of the block, at most
        held = found.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
        weights = np.zeros(len(block.numbers), np.int64)
        for term, df in held:
            weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        classes = written(bag_classes(found, n_docs, n_words, top), "bag-classes")
        scored = score_classes(classes, block, weights, top, id_type)
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
        ranked = scored.withColumn("rank", place).where(F.col("rank") <= top)
        out = out.unionByName(ranked.select("item_id", "rank", "doc_id", "score"))
    return out


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))

"""Harmonic packing of token sequences into fixed-length rows."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, plain, slices, texts, written
from .tokens import default_path, word_cache

CAPACITY = 2048
END_ID = 1
#: A piece may leave this part of its share of a bin empty; longer rests are cut again.
SLACK = 32


def cut(n: int, capacity: int = CAPACITY, slack: int = SLACK) -> list[tuple[int, int, int]]:
    """Cut ``n`` tokens into pieces ``(start, length, class)``; class k is filled k pieces to a bin.

    Full bins first. A rest longer than ``capacity / (k + 1)`` and at most ``capacity / k`` belongs to
    class k. It stays whole if k of its length leave at most one part in ``slack`` empty, else a piece of
    exactly the next share goes off and the rule is asked again.
    """
    full, rest = divmod(n, capacity)
    out = [(i * capacity, capacity, 1) for i in range(full)]
    start = full * capacity
    while rest:
        k = capacity // rest
        length = rest if k * rest * slack >= capacity * (slack - 1) else capacity // (k + 1)
        out.append((start, length, capacity // length))
        start += length
        rest -= length
    return out


def fit_rest(pieces: list[tuple[int, int, int]], capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """Best-fit decreasing of ``(class, index, length)`` -> ``(class, index, bin, offset)``."""
    rooms: list[tuple[int, int]] = []
    out, bins = [], 0
    for k, i, n in sorted(pieces, key=lambda p: (-p[2], p[0], p[1])):
        at = bisect_left(rooms, (n, -1))
        room, b = rooms.pop(at) if at < len(rooms) else (capacity, bins)
        bins += b == bins
        out.append((k, i, b, capacity - room))
        insort(rooms, (room - n, b))
    return out


def harmonic_pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, slack: int = SLACK) -> DataFrame:
    """Pack all documents (``doc_id, text``) into sequences of at most ``capacity`` tokens.

    Each worker cuts its documents into pieces and numbers them within their class. Adding the numbers that
    earlier workers used in that class gives every piece its bin: index // class. Counts travel, pieces do not
    wait for each other, and each class has one unfinished bin at most, however many workers there are. The pieces
    of those (fewer than k for each class k, so a bounded number) are fitted into common bins by one task.

    One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, klass``. Null
    texts are empty and hold the end id alone; texts of any length are tokenised whole and cut to pieces; repeated rows are packed each; an empty table gives no rows; other
    columns are not read. A null doc_id stays null.
    """

    def pieces(batches):
        from pyspark import TaskContext

        cache, part, used = word_cache(tokenizer), TaskContext.get().partitionId(), {}
        for batch in batches:
            for rows in slices(batch):
                out = []
                for doc, text in zip(rows.column("doc_id").to_pylist(), texts(rows)):
                    ids = cache.ids(text) + end_id.to_bytes(4, "little")
                    n = len(ids) // 4
                    for start, length, k in cut(n, capacity, slack):
                        used[k] = i = used.get(k, -1) + 1
                        out.append((doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, k, part, i))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "klass", "part", "nth"]
    types = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.int64()]
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, klass int, part int, nth long"
    cuts = written(plain(docs, "doc_id", "text").mapInArrow(pieces, schema), "pieces")

    before = Window.partitionBy("klass").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    used = cuts.groupBy("part", "klass").count()
    first = used.select("part", "klass", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    totals = {r[0]: r[1] for r in used.groupBy("klass").agg(F.sum("count")).collect()}  # a row for each class: about 2 * sqrt(capacity)
    table, base = [], 0
    for k in sorted(totals):
        table.append((k, totals[k] // k, base))
        base += totals[k] // k
    classes = docs.sparkSession.createDataFrame(table, "klass int, bins long, base long")

    placed = cuts.join(first, ["part", "klass"]).join(F.broadcast(classes), "klass").withColumn("index", F.col("first") + F.col("nth"))
    placed = placed.withColumn("bin", F.expr("index DIV klass"))
    so_far = Window.partitionBy("klass", "bin").orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "klass"]
    full = placed.where("bin < bins").withColumn("offset", F.coalesce(F.sum("length").over(so_far), F.lit(0))).withColumn("sequence_id", F.col("base") + F.col("bin")).select(*columns)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        fitted = pd.DataFrame(fit_rest(list(zip(pdf["klass"], pdf["index"], pdf["length"])), capacity), columns=["klass", "index", "b", "offset"])
        pdf = pdf.merge(fitted, on=["klass", "index"])
        return pdf.assign(sequence_id=base + pdf["b"])[columns]

    last = placed.where("bin >= bins").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "klass", "index", F.lit(0).alias("one"))
    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, klass int"
    return full.union(last.groupBy("one").applyInPandas(fit, kinds))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonic_pack(load(spark, sf_dir, "documents"), default_path())

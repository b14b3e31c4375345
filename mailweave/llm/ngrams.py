"""Stupid-backoff language model scores, computed relationally over token bigrams."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, plain, slices, text_bytes, texts, written
from .tokens import default_path, drop_caches, word_cache

BACKOFF = 0.4
BUCKETS = 16
GROUP_BYTES = 16 << 20
#: Words and parts that a worker keeps here, where joins follow that need memory too.
CACHES = 100_000, 300_000
#: Bytes of token ids taken at a time, two for each token.
SLICE = 1 << 20
#: Bigrams that a task counts before it hands them on, and those looked up at a time.
MOST_HELD, MOST_LOOKED_UP = 500_000, 250_000
#: Size of the tokenizer's vocabulary and its id for the start of a text.
VOCABULARY, START = 49_408, 49_406
_FACTOR = 2_654_435_761


def bucket_of(key: Column, buckets: int) -> Column:
    """Hash bucket of a bigram ``before * VOCABULARY + token``; the same as :func:`_buckets`."""
    return F.pmod(F.shiftright(key * F.lit(_FACTOR), 16).bitwiseAND(F.lit(0xFFFF)), F.lit(buckets)).cast("int")


def _buckets(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys * _FACTOR) >> 16 & 0xFFFF) % buckets


def token_rows(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``row, doc_id, ids``: every document's tokens, two bytes each, and a number of its own. Written once, so both passes see the same."""

    def run(batches):
        from pyspark import TaskContext

        cache, row = word_cache(tokenizer, *CACHES), TaskContext.get().partitionId() << 33
        for batch in batches:
            for rows in slices(batch):
                ids = [np.frombuffer(cache.ids(t), "<u4").astype("<u2").tobytes() for t in texts(rows)]
                numbers = pa.array(np.arange(row, row + len(ids)))
                row += len(ids)
                yield pa.RecordBatch.from_arrays([numbers, rows.column("doc_id").cast(pa.int64()), pa.array(ids, pa.binary())], names=["row", "doc_id", "ids"])
        drop_caches()  # an idle worker keeps its memory, and later stages need it

    return written(plain(docs, "doc_id", "text").mapInArrow(run, "row long, doc_id long, ids binary"), "tokens")


def _bigrams(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The bigrams of a slice of documents, and each one's number of tokens."""
    ids = rows.column("ids").to_pylist()
    size = np.array([len(i) // 2 for i in ids])
    tokens = np.frombuffer(b"".join(ids), "<u2").astype(np.int64)
    before = np.concatenate([[0], tokens[:-1]]) if len(tokens) else tokens
    before[(np.cumsum(size) - size)[size > 0]] = START
    return before * VOCABULARY + tokens, size


def bigram_counts(tokens: DataFrame) -> DataFrame:
    """``key, n`` for every bigram of all documents, counted in each task first."""

    def rows(keys, n):
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

    def run(batches):
        drop_caches()
        keys = n = np.zeros(0, np.int64)
        for batch in batches:
            for part in slices(batch, "ids", SLICE):
                new, times = np.unique(_bigrams(part)[0], return_counts=True)
                keys, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
                n = np.bincount(at, np.concatenate([n, times]), len(keys)).astype(np.int64)
                if len(keys) > MOST_HELD:
                    yield rows(keys, n)
                    keys = n = np.zeros(0, np.int64)
        yield rows(keys, n)

    return tokens.select("ids").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _exploded(tokens: DataFrame, buckets: int, salts: int) -> DataFrame:
    """The distinct bigrams of each document and how often it has them, as one row for each document and hash bucket."""

    def run(batches):
        drop_caches()
        for batch in batches:
            for part in slices(batch, "ids", SLICE):
                keys, size = _bigrams(part)
                line = np.repeat(np.arange(len(size)), size)
                code, times = np.unique(((line * buckets + _buckets(keys, buckets)) << 32) + keys, return_counts=True)  # sorted by document and bucket
                held = code >> 32
                first = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]])) if len(held) else np.zeros(0, np.int64)
                line, bucket = np.divmod(held[first], buckets)
                bare = np.flatnonzero(size == 0)  # a text without tokens keeps a row
                line, bucket = np.concatenate([line, bare]), np.concatenate([bucket, bare % buckets])
                ends = pa.array(np.concatenate([first, np.full(len(bare) + 1, len(code))]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(c.astype(np.uint32).view(np.int32))) for c in (code & 0xFFFFFFFF, times)]
                own = part.take(pa.array(line))
                row = np.asarray(own.column("row"))
                heads = [pa.array(bucket, pa.int32()), pa.array(row % salts, pa.int32()), own.column("row"), own.column("doc_id"), pa.array(size[line], pa.int64())]
                yield pa.RecordBatch.from_arrays([*heads, *lists], names=["bucket", "salt", "row", "doc_id", "tokens", "keys", "times"])

    schema = "bucket int, salt int, row long, doc_id long, tokens long, keys array<int>, times array<int>"
    return tokens.mapInArrow(run, schema)


def _joined(grams: pa.Table, counts: pa.Table) -> pa.Table:
    """One hash bucket: each document's bigrams meet their counts; the sum of their logarithms for each document."""
    drop_caches()
    keys, times = (grams.column(c).combine_chunks() for c in ("keys", "times"))
    size = np.diff(np.asarray(keys.offsets)) if len(keys) else np.zeros(0, np.int64)
    key, k = (np.asarray(c.flatten()) for c in (keys, times))
    known = np.asarray(counts.column("key"))
    order = np.argsort(known)
    known = known[order]
    n, context, back = (np.asarray(counts.column(c))[order] for c in ("n", "log_context", "log_back"))
    part, ends = np.zeros(len(size)), np.cumsum(size)
    first = 0
    while first < len(size):  # whole documents, about so many bigrams at a time
        start = ends[first] - size[first]
        last = max(first + 1, int(np.searchsorted(ends, start + MOST_LOOKED_UP, "right")))
        some = slice(int(start), int(ends[last - 1]))
        at = np.searchsorted(known, key[some].view(np.uint32).astype(np.int64))
        others = n[at] - k[some]
        value = np.where(others > 0, np.log(np.maximum(others, 1)) - context[at], back[at]) * k[some]
        so_far = np.concatenate([[0.0], np.cumsum(value)])
        here = ends[first:last] - start
        part[first:last] = so_far[here] - so_far[here - size[first:last]]
        first = last
    return pa.table({"row": grams.column("row"), "doc_id": grams.column("doc_id"), "tokens": grams.column("tokens"), "part": pa.array(part)})


def stupid_backoff(docs: DataFrame, tokenizer: str, backoff: float = BACKOFF, buckets: int = BUCKETS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Score whole texts (``doc_id, text``) by a bigram model of all of them: ``doc_id, n_tokens, log_score, mean_log_score``.

    A token is as likely after the one before as the bigram's count in *other* documents over the count of the one
    before; if no other document has the bigram, as ``backoff`` times the token's share of all tokens. The first token follows a start mark.
    Logarithms are natural and summed for each document; ``mean_log_score`` is for each token.

    The count table is partitioned by a hash of the bigram; documents are exploded into their distinct bigrams, which
    travel to the bucket of their hash, and what the buckets find is summed for each document. Documents share a bucket only within
    a salt, as many salts as keep a group near ``group_bytes`` of text, and each salt has a copy of the bucket's counts. So a bigram that
    most documents have adds at most one entry for each document of a group. The tokenizer's vocabulary bounds
    the only tables that are broadcast (token counts).

    Null and empty texts have no tokens and score 0; texts of any length are read whole, one task a text; repeated rows are scored each; an empty table gives no rows; other
    columns are not read.
    """
    total = docs.agg(F.sum(text_bytes())).first()[0] or 0
    salts = max(1, math.ceil(total / buckets / group_bytes))
    ids = token_rows(docs, tokenizer)
    table = written(bigram_counts(ids), "bigrams")
    before = table.groupBy(F.expr(f"key DIV {VOCABULARY}").alias("v")).agg(F.sum("n").alias("context"))
    token = table.groupBy((F.col("key") % VOCABULARY).alias("w")).agg(F.sum("n").alias("own"))
    tokens = table.agg(F.sum("n")).first()[0] or 1
    counts = (
        table.withColumns({"v": F.expr(f"key DIV {VOCABULARY}"), "w": F.col("key") % VOCABULARY})
        .join(F.broadcast(before), "v")  # at most VOCABULARY rows each
        .join(F.broadcast(token), "w")
        .select(
            bucket_of(F.col("key"), buckets).alias("b"),
            F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("s"),
            "key",
            "n",
            F.log("context").alias("log_context"),
            F.log(F.col("own") * F.lit(backoff / tokens)).alias("log_back"),
        )
    )
    grams = _exploded(ids, buckets, salts)
    parts = grams.groupBy("bucket", "salt").cogroup(counts.groupBy("b", "s")).applyInArrow(_joined, "row long, doc_id long, tokens long, part double")
    sums = parts.groupBy("row", "doc_id", "tokens").agg(F.sum("part").alias("log_score"))
    return sums.select("doc_id", F.col("tokens").alias("n_tokens"), "log_score", (F.col("log_score") / F.greatest("tokens", F.lit(1))).alias("mean_log_score"))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stupid_backoff(load(spark, sf_dir, "documents"), default_path())

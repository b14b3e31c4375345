"""Benchmark decontamination by suffix arrays over shards of the training text."""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, plain, raw_texts, slices, text_bytes

WINDOW = 10
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 8 << 20

#: Words are runs of digits, letters a-z and everything beyond ASCII; A-Z are lower-cased.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class TestSuffixes:
    """The suffixes of one block of benchmark items, cut to the window, in the form that a search needs."""

    __test__ = False

    def __init__(self, items: list[tuple[int | None, bytes]], window: int = WINDOW):
        vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], dict[int, list[int]]] = {}
        for number, (_, text) in enumerate(items):
            ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]
            for start in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[start : start + window]), {}).setdefault(number, []).append(start)
        self.window = window
        self.vocabulary = vocabulary
        self.windows = list(found)
        self.names = [item for item, _ in items]
        self.held = list(found.values())  # the texts that hold a window, and where
        self.items = [list({items[n][0]: None for n in v}) for v in found.values()]
        self.lengths = np.array([len(w) for w in self.windows], np.int64)
        low = np.zeros((len(found), window), ">u4")
        high = np.full((len(found), window), 0xFFFFFFFF, ">u4")
        for i, w in enumerate(self.windows):
            low[i, : len(w)] = high[i, : len(w)] = w
        self.low, self.high = _records(low), _records(high)
        pair = len(vocabulary) + 1
        self.pairs = np.unique(np.array([w[0] * pair + w[1] for w in self.windows if len(w) > 1], np.int64))
        self.begins = np.zeros(pair, bool)
        self.alone = np.zeros(pair, bool)
        for w in self.windows:
            (self.begins if len(w) > 1 else self.alone)[w[0]] = True

    def suffix_array(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted suffixes of a shard and their places. Suffixes whose first words begin no test suffix are left out."""
        padded = np.concatenate([ids, np.zeros(self.window, np.int32)])
        place = np.flatnonzero(self.begins[ids] | self.alone[ids])
        if len(place) and len(self.pairs):
            code = padded[place].astype(np.int64) * len(self.begins) + padded[place + 1]
            at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            place = place[(self.pairs[at] == code) | self.alone[padded[place]]]
        keys = _records(padded[place[:, None] + np.arange(self.window)].astype(">u4"))
        order = np.argsort(keys, kind="stable")
        return keys[order], place[order]

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Binary-search every test suffix: places in the shard and the number of the window found there."""
        keys, place = self.suffix_array(ids)
        first = np.searchsorted(keys, self.low, "left")
        count = np.searchsorted(keys, self.high, "right") - first
        which = np.repeat(np.arange(len(count)), count)
        at = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        return place[at], which


def _longest(test: TestSuffixes, hits: list[tuple[int, int]]) -> list[tuple]:
    """Verbatim matches as (item, first word in the item, first word in the document, words), from a document's hits in order.

    A match grows while the next word's window follows in the same item; a window that an item holds at several places
    goes on with the match it continues, or begins one at the first of them, so a word begins one match of an item at most.
    """
    out, going = [], {}
    for place, which in hits:
        still = {}
        for text, starts in test.held[which].items():
            first, at, words, last = going.get(text, (place, starts[0], 0, None))
            if last == place - 1 and at + place - first in starts:
                still[text] = (first, at, words + 1, place)
            else:
                still[text] = (place, starts[0], int(test.lengths[which]), place)
                if last is not None:
                    out.append((test.names[text], at, first, words))
        for text, (first, at, words, _) in going.items():
            if text not in still:
                out.append((test.names[text], at, first, words))
        going = still
    return out + [(test.names[text], at, first, words) for text, (first, at, words, _) in going.items()]


def _records(rows: np.ndarray) -> np.ndarray:
    """Rows of big-endian numbers as byte strings, which compare as the rows do."""
    rows = np.ascontiguousarray(rows)
    return rows.view(f"S{rows.shape[1] * 4}").ravel() if len(rows) else np.zeros(0, f"S{rows.shape[1] * 4}")


def _blocks(benchmark: DataFrame, window: int, block_bytes: int) -> list:
    """The benchmark in blocks of about ``block_bytes`` of text, each fetched, indexed and broadcast on its own."""
    spark = benchmark.sparkSession
    items = plain(benchmark, "item_id", "text").where("text IS NOT NULL").distinct()
    n = max(1, math.ceil((items.agg(F.sum(text_bytes())).first()[0] or 0) / block_bytes))
    out = []
    for i in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()
        out.append(spark.sparkContext.broadcast(TestSuffixes([(r[0], r[1].encode()) for r in rows], window)))
    return out


def _each(blocks: list):
    """The blocks one after another; of several, a worker holds one at a time and reads the next from its own disk."""
    for block in blocks:
        yield block.value
        if len(blocks) > 1:
            vars(block).pop("_value", None)


def _examine(texts: list[bytes], blocks: list, with_matches: bool = False) -> list[tuple[int, int, list, list[tuple[int, int]], list[tuple]]]:
    """For each text of a shard: words, words hit, items found, the hit runs as (first word, words), and the matches."""
    split = [words_of(t) for t in texts]
    size = np.array([len(w) for w in split], np.int64)
    first = np.cumsum(size + 1) - size - 1
    end = first + size
    covered = np.zeros(int((size + 1).sum()) + 1, np.int64)
    items: list[dict] = [{} for _ in texts]
    matches: list[list[tuple]] = [[] for _ in texts]
    for test in _each(blocks):
        if not test.windows:
            continue
        ids = np.zeros(int((size + 1).sum()), np.int32)
        for words, a, b in zip(split, first, end):
            ids[a:b] = np.fromiter(map(test.vocabulary.get, words, repeat(0)), np.int32, len(words))
        place, which = test.search(ids)
        np.add.at(covered, place, 1)
        np.add.at(covered, place + test.lengths[which], -1)
        doc = np.searchsorted(first, place, "right") - 1
        for pair in np.unique(doc * len(test.windows) + which):
            items[pair // len(test.windows)].update(dict.fromkeys(test.items[pair % len(test.windows)]))
        if with_matches and len(place):
            order = np.argsort(place, kind="stable")
            cuts = np.flatnonzero(np.diff(doc[order])) + 1
            for some in np.split(order, cuts):
                i = int(doc[some[0]])
                matches[i] += _longest(test, list(zip((place[some] - first[i]).tolist(), which[some].tolist())))
    hit = np.cumsum(covered) > 0
    out = []
    for i, (a, b) in enumerate(zip(first, end)):
        runs = []
        if items[i]:
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b], [0]]).astype(np.int8)))
            runs = list(zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist()))
        out.append((int(size[i]), sum(n for _, n in runs), [x for x in items[i] if x is not None], runs, sorted(matches[i], key=lambda m: (m[2], -m[3], str(m[0])))))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each document: ``doc_id, n_words, n_hit, n_items, items, runs, matches, longest, contaminated``.

    A shard of the training text (about 8 MB of a partition) gets a suffix array over its word ids. Every test
    suffix is binary-searched in it; the range found holds all verbatim places of that window, also where it is
    repeated. Windows of one item that follow each other are one of the ``matches``, the longest verbatim ones: the item, the
    first word in it and in the document, and the words; ``longest`` is the longest match. Words hit, next to each other, make up the ``runs`` (first word, words).
    Suffixes are sorted to the window's depth, since shorter matches don't count and longer ones are chains of windows. The
    benchmark is fetched and broadcast in blocks of bounded size, of which a worker holds one at a time, however large it is.

    Null or wordless documents have no words and no hits. Benchmark rows with null text, or without words, have no
    window; a null item_id marks hits but is not counted among the items. Repeated benchmark rows are one; documents
    are treated row by row. Empty tables give no hits or no rows. Other columns are not read.
    """
    blocks = _blocks(benchmark, window, block_bytes)
    schema = "doc_id long, n_words long, n_hit long, n_items long, items array<string>, runs array<struct<first:long,words:long>>, matches array<struct<item:string,at:long,first:long,words:long>>, longest long, contaminated boolean"
    match_type = pa.list_(pa.struct([("item", pa.string()), ("at", pa.int64()), ("first", pa.int64()), ("words", pa.int64())]))
    run_type = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))

    def run(batches):
        for batch in batches:
            for rows in slices(batch, most=SHARD_BYTES):
                found = _examine(raw_texts(rows), blocks, True)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id").cast(pa.int64()),
                        pa.array([x[0] for x in found], pa.int64()),
                        pa.array([x[1] for x in found], pa.int64()),
                        pa.array([len(x[2]) for x in found], pa.int64()),
                        pa.array([sorted(map(str, x[2])) for x in found], pa.list_(pa.string())),
                        pa.array([[{"first": a, "words": n} for a, n in x[3]] for x in found], run_type),
                        pa.array([[dict(zip(("item", "at", "first", "words"), (None if m[0] is None else str(m[0]), *m[1:]))) for m in x[4]] for x in found], match_type),
                        pa.array([max((m[3] for m in x[4]), default=0) for x in found], pa.int64()),
                        pa.array([x[1] > 0 for x in found], pa.bool_()),
                    ],
                    names=["doc_id", "n_words", "n_hit", "n_items", "items", "runs", "matches", "longest", "contaminated"],
                )

    return plain(docs, "doc_id", "text").mapInArrow(run, schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with all their columns; same rules as :func:`contamination`."""
    blocks = _blocks(benchmark, window, block_bytes)

    def run(batches):
        for batch in batches:
            for rows in slices(batch, most=SHARD_BYTES):
                yield rows.filter(pa.array([x[1] == 0 for x in _examine(raw_texts(rows), blocks)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)



def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")

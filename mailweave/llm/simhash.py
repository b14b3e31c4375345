"""SimHash near-duplicates: tiles of fingerprints compared exactly, by exclusive-or and bit counts."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, map_slices, plain, raw_texts, written
from .components import connected_components, local_roots

SHINGLE = 3
RADIUS = 2
HASH_SEED = 42
TILE = 4096
BLOCK = 1 << 21
QUARTERS = 4


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = HASH_SEED) -> int:
    """64 bits; a bit is set where over half of the shingles' hashes have it. No words: 0."""
    words = text.lower().split()  # on bytes: A-Z only, and the six ASCII spaces
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    digest = xxhash.xxh64_intdigest
    counts, n, step = np.zeros(64, np.int64), len(words) - shingle + 1, 1 << 15
    for start in range(0, n, step):
        some = words[start : start + step + shingle - 1]
        hashes = np.array([digest(s, seed) for s in map(b" ".join, zip(*(some[i:] for i in range(shingle))))], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, key: str = "doc_id") -> DataFrame:
    """``doc_id`` (or another key), ``fp`` (the 64 bits as a signed long) for each document."""

    def run(rows):
        prints = np.array([fingerprint(t, shingle) for t in raw_texts(rows)], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([rows.column(key).cast(pa.int64()), pa.array(prints)], names=[key, "fp"])

    return map_slices(plain(docs, key, "text"), run, f"{key} long, fp long")


def _cell(fp: Column) -> Column:
    """Population counts of the four 16-bit quarters, five bits each, 2 added so that a step of 2 never borrows."""
    return sum(F.shiftleft(F.bit_count(F.shiftrightunsigned(fp, 16 * q).bitwiseAND(F.lit(0xFFFF))) + 2, 5 * q) for q in range(QUARTERS)).cast("int")


def _steps(radius: int) -> list[int]:
    """Cell differences within the radius, one of each pair of opposites."""
    near = [d for d in product(range(-radius, radius + 1), repeat=QUARTERS) if sum(map(abs, d)) <= radius]
    return sorted({s for d in near if (s := sum(x << (5 * q) for q, x in enumerate(d))) >= 0})


def near_links(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Star links that join what pairs of ``a`` and ``b`` within ``radius`` bits join: fewer than there are points. ``same``: both are one list."""
    points, shift = (a, 0) if same else (np.concatenate([a, b]), len(a))
    ua, ub = a.view(np.uint64), b.view(np.uint64)
    own = root = np.arange(len(points))
    step = max(1, BLOCK // max(1, len(b)))
    for start in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(ua[start : start + step, None] ^ ub[None, :]) <= radius)
        if len(i):
            root = local_roots(len(points), np.concatenate([own, i + start]), np.concatenate([root, j + shift]))
    linked = np.flatnonzero(root != own)
    u, v = points[linked], points[root[linked]]
    return u[u != v], v[u != v]


def fingerprint_components(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``prints(fp long)``, distinct -> ``(node, root)`` for fingerprints linked within ``radius`` bits.

    Fingerprints are tiled by the population counts of their four quarters: two that differ in at most ``radius``
    bits have counts that differ by no more in all, so tile pairs further apart are skipped without loss. A cell
    with many fingerprints is split into tiles of about ``tile`` by hash, so no task meets an unbounded group. Each
    remaining pair of tiles is compared whole, and gives links that are a forest: never more than the tiles' rows.
    """
    cells = prints.select("fp", _cell(F.col("fp")).alias("cell"))
    sizes = cells.groupBy("cell").agg(F.ceil(F.count("*") / tile).alias("n"))  # at most 17 ** 4 rows
    tiles = cells.join(F.broadcast(sizes), "cell").groupBy("cell", F.pmod(F.xxhash64("fp"), F.col("n")).alias("no")).agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    tiles = written(tiles, "tiles")
    left = tiles.select(F.col("no").alias("a_no"), F.col("fps").alias("a"), "cell", F.explode(F.array(*map(F.lit, _steps(radius)))).alias("step"))
    pairs = left.withColumn("other", F.col("cell") + F.col("step")).join(tiles.select(F.col("cell").alias("other"), F.col("no").alias("b_no"), F.col("fps").alias("b")), "other")
    pairs = pairs.where("step <> 0 OR a_no <= b_no").select("a", "b", F.expr("step = 0 AND a_no = b_no").alias("same"))

    def compare(batches):
        for batch in batches:
            u, v = [], []
            for i in range(batch.num_rows):
                a, b = (np.asarray(batch.column(c)[i].values) for c in ("a", "b"))
                x, y = near_links(a, b, radius, batch.column("same")[i].as_py())
                u.append(x)
                v.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])

    return connected_components(pairs.mapInArrow(compare, "u long, v long"))


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``doc_id, fp, component_id`` for each document (``doc_id, text``).

    Texts with equal fingerprints are one point before anything is compared, so copies cost nothing. Null, empty
    and wordless texts have fingerprint 0 and link like any other; texts of any length are read whole. ``component_id`` is the smallest doc_id reachable;
    a null doc_id takes part but names no component (null if there is no other). Repeated rows stay; an empty
    table gives no rows; other columns are not read.
    """
    prints = written(fingerprints(docs, shingle), "fingerprints")
    points = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = fingerprint_components(points.select("fp"), radius, tile)
    points = points.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    names = points.groupBy("root").agg(F.min("low").alias("component_id"))
    named = written(points.join(names, "root").select("fp", "component_id"), "components")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def one_of_each_group(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The documents with the smallest doc_id of their group, with all their columns.

    Where ids repeat, all rows of a kept id stay; rows with a null id stay, since nothing tells them apart.
    """
    kept = simhash_groups(docs, shingle, radius).where("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, F.col("doc_id") == F.col("_kept"), "left_semi").union(docs.where("doc_id IS NULL"))


def one_row_of_each_group(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """One row of each group, with all its columns: the smallest doc_id, nulls last, and of its rows the first by number.

    Rows are numbered once and written, so repeated rows, other texts under a kept id and null ids are told apart.
    """
    numbered = written(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("record"), F.monotonically_increasing_id().alias("row")), "numbered")
    prints = written(fingerprints(numbered.select("row", F.col("record.text").alias("text")), shingle, "row"), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("first")
    points = written(prints.join(numbered.select("row", F.col("record.doc_id").alias("doc_id")), "row").groupBy("fp").agg(first), "points")
    roots = fingerprint_components(points.select("fp"), radius, tile)
    points = points.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
    kept = points.groupBy(F.coalesce("root", "fp")).agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    return numbered.join(kept, "row", "left_semi").select("record.*")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_groups(load(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""Embedding near-duplicates: a robustly pruned flat graph built on overlapping cluster shards."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graphs
from .common import load, written
from .components import connected_components, local_roots

COSINE = 0.95
SHARD_ROWS = 1500
OVERLAP, PROBES = 2, 3
MOST_CLUSTERS = 4096
SAMPLE = 20_000
AUDIT = 1000
RECALL = 0.97
FEW = 64
FEW_LINKED = 8
ENTRIES = 24


def usable(v: Column) -> Column:
    """Not null, not empty, every component finite, not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def unit_rows(rows) -> np.ndarray:
    """Vectors of one length, in double precision, scaled to length 1; scaled down first, so that squares stay finite."""
    x = np.array(rows, float)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _centroids(x: np.ndarray, k: int, steps: int = 8) -> np.ndarray:
    """Spherical k-means on the sample."""
    rng = np.random.default_rng(k)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(steps):
        near = np.concatenate([(x[i : i + 2000] @ c.T).argmax(axis=1) for i in range(0, len(x), 2000)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-300), c)
    return c


def _fit(classes: DataFrame, shard_rows: int) -> dict[int, tuple[int, np.ndarray]]:
    """By dimension: number of the first cluster, and centroids fitted on the vectors with the ``SAMPLE`` smallest hashes."""
    sizes = {r[0]: r[1] for r in classes.groupBy(F.size("embedding")).count().collect()}
    sample: dict[int, list] = {}
    for (v,) in classes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("embedding").collect():
        sample.setdefault(len(v), []).append(v)
    out, first = {}, 0
    for d in sorted(sample):
        k = max(1, min(MOST_CLUSTERS, math.ceil(sizes[d] / shard_rows), len(sample[d]) // 4))
        out[d] = first, _centroids(unit_rows(sample[d]), k)
        first += k
    return out


def _placed(classes: DataFrame, centroids, overlap: int, probes: int) -> DataFrame:
    """``node, embedding, weight, clusters, probes``: the clusters that hold a vector, its nearest ones, and those it is searched in. A dimension that the sample lacks is a cluster of its own (negative)."""

    def run(batches):
        for batch in batches:
            by: dict[int, list[int]] = {}
            vectors = batch.column("embedding").to_pylist()
            for i, v in enumerate(vectors):
                by.setdefault(len(v), []).append(i)
            for d, rows in by.items():
                unit = unit_rows([vectors[i] for i in rows])
                if d in centroids.value:
                    first, c = centroids.value[d]
                    n = min(max(probes, overlap), len(c))
                    cosine = unit @ c.T
                    near = np.argpartition(-cosine, n - 1, axis=1)[:, :n]
                    near = first + np.take_along_axis(near, np.argsort(-np.take_along_axis(cosine, near, 1), axis=1, kind="stable"), 1)
                else:
                    near = np.full((len(rows), 1), -d)
                some = batch.take(pa.array(rows))
                lists = [pa.array(np.sort(n, axis=1).tolist(), pa.list_(pa.int32())) for n in (near[:, :overlap], near)]
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("node", "embedding", "weight")), *lists], names=["node", "embedding", "weight", "clusters", "probes"])

    kind = classes.schema["embedding"].dataType.simpleString()
    return classes.select("node", "weight", "embedding").mapInArrow(run, f"node long, embedding {kind}, weight long, clusters array<int>, probes array<int>")


def _build(least: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        adj = graphs.build(unit_rows(np.stack(pdf["embedding"].to_numpy())), least)
        node = pdf["node"].to_numpy()
        return pd.DataFrame({"node": node, "neighbours": [node[a[a >= 0]] for a in adj]})

    return run


def _search(least: float):
    def run(key, index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(queries):
            return pd.DataFrame({c: pd.Series([], dtype="int64" if c in ("node", "links", "root", "cluster") else object) for c in ("node", "links", "root", "cluster", "shared", "others", "weights")})
        nodes, asked = index["node"].to_numpy(), queries["node"].to_numpy()
        by = np.argsort(nodes)

        def place(some: np.ndarray) -> np.ndarray:
            at = by[np.minimum(np.searchsorted(nodes, some, sorter=by), len(nodes) - 1)]
            return np.where(nodes[at] == some, at, -1)

        size = [len(n) for n in index["neighbours"]]
        adj = np.full((len(nodes), max(max(size), 1)), -1)
        line = np.repeat(np.arange(len(nodes)), size)
        adj[line, np.arange(len(line)) - np.repeat(np.cumsum(size) - size, size)] = place(np.concatenate(index["neighbours"].to_list()).astype("int64"))
        x, q = (unit_rows(np.stack(p["embedding"].to_numpy())) for p in (index, queries))
        known = [len(n) for n in queries["neighbours"]]
        hints = np.concatenate([np.arange(len(asked)), np.repeat(np.arange(len(asked)), known)]), place(np.concatenate([asked, *queries["neighbours"]]).astype("int64"))
        a, b = graphs.in_range(x, adj, q, graphs.medoids(x, ENTRIES), least, hints)
        a, b = a[asked[a] != nodes[b]], b[asked[a] != nodes[b]]
        sure = np.einsum("ij,ij->i", q[a], x[b]) >= least
        a, b = a[sure], b[sure]
        ours, theirs = np.stack(queries["probes"].to_numpy())[a], np.stack(index["clusters"].to_numpy())[b]
        meet = (ours[:, :, None] == theirs[:, None, :]).any(axis=1)  # the clusters that hold the one and are searched for the other
        weight = index["weight"].to_numpy()
        alone = meet.sum(axis=1) == 1
        links = np.bincount(a[alone], weight[b[alone]], len(asked)).astype("int64")
        points, where = np.unique(np.concatenate([asked, nodes]), return_inverse=True)
        root = points[local_roots(len(points), where[a], where[len(asked) + b])]
        total = np.bincount(where[: len(asked)], links, len(points)).astype("int64")
        keep = (root != points) | (total > 0)
        none = pd.Series([[]] * keep.sum(), dtype=object)
        out = pd.DataFrame({"node": points[keep], "links": total[keep], "root": root[keep], "cluster": key[0], "shared": none, "others": none, "weights": none})
        a, b, meet = a[~alone], b[~alone], np.where(meet, theirs, -1)[~alone]
        if not len(a):
            return out
        kinds, kind = np.unique(np.column_stack([a, meet]), axis=0, return_inverse=True)
        kind = kind.reshape(-1)
        order = np.argsort(kind, kind="stable")
        parts = np.split(b[order], np.cumsum(np.bincount(kind))[:-1])
        who = asked[kinds[:, 0]]
        listed = [p if len(p) <= FEW else p[:0] for p in parts]
        more = pd.DataFrame({"node": who, "links": [int(weight[p].sum()) for p in parts], "root": who, "cluster": key[0], "shared": [k[k >= 0] for k in kinds[:, 1:]], "others": [nodes[p] for p in listed], "weights": [weight[p] for p in listed]})
        return pd.concat([out, more]) if len(out) else more

    return run


def _in_blocks(placed: DataFrame, clusters: str, shard_rows: int) -> tuple[DataFrame, DataFrame]:
    """Each row once for each of its clusters, with a block of about ``shard_rows``; and the clusters' numbers of blocks."""
    each = placed.withColumn("cluster", F.explode(clusters))
    sizes = each.groupBy("cluster").count().collect()  # a row for each cluster
    blocks = placed.sparkSession.createDataFrame([(r[0], max(1, math.ceil(r[1] / shard_rows))) for r in sizes], "cluster int, blocks int")
    blocks = F.broadcast(blocks)
    return each.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("node", "cluster"), F.col("blocks")).cast("int")).drop("blocks"), blocks


def _graph(placed: DataFrame, least: float, shard_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every vector in its clusters' blocks with its united adjacency list, written; the lists alone; and the clusters' numbers of blocks."""
    members, blocks = _in_blocks(placed.select("node", "embedding", "weight", "clusters"), "clusters", shard_rows)
    members = written(members, "members")
    edges = members.select("cluster", "block", "node", "embedding").groupBy("cluster", "block").applyInPandas(_build(least), "node long, neighbours array<long>")
    union = edges.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours"))
    union = written(union, "adjacency")
    return written(members.join(union, "node"), "graph"), union, blocks


def _links(graph: DataFrame, union: DataFrame, held: DataFrame, placed: DataFrame, least: float, shard_rows: int) -> DataFrame:
    """``node, links, root`` rows and a forest of the links found in each block: links that one cluster alone can find, and the others
    by ``cluster`` and the clusters they are ``shared`` by, with the points themselves where a block has no more than ``FEW`` of them.

    A query brings its neighbours: those that another block holds are where its search there begins, besides the medoids.
    """
    queries, asking = _in_blocks(placed.select("node", "embedding", "probes").join(union, "node"), "probes", shard_rows)

    def against(rows: DataFrame, others: DataFrame, name: str) -> DataFrame:
        return rows.join(others, "cluster").withColumn(name, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    index = against(graph.withColumnRenamed("block", "i"), asking, "q")
    asked = against(queries.withColumnRenamed("block", "q"), held, "i")
    asked = asked.select(F.col("cluster").alias("c"), F.col("i").alias("ci"), F.col("q").alias("cq"), *(F.col(n).alias(n) for n in ("node", "embedding", "probes", "neighbours")))
    return index.groupBy("cluster", "i", "q").cogroup(asked.groupBy("c", "ci", "cq")).applyInPandas(_search(least), "node long, links long, root long, cluster long, shared array<long>, others array<long>, weights array<long>")


def _counted(found: DataFrame) -> DataFrame:
    """``node, links``: each pair once, whichever of its shared clusters found it. Lists are united; where a block found too many to list, at least the largest cluster's count holds."""
    alone = found.where("size(shared) = 0").select("node", "links")
    listed = F.flatten(F.collect_list(F.arrays_zip("others", "weights")))
    shared = found.where("size(shared) > 0").groupBy("node", "shared", "cluster").agg(F.sum("links").alias("links"), listed.alias("pairs"))
    shared = shared.groupBy("node", "shared").agg(F.max("links").alias("links"), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"))
    united = F.aggregate("pairs", F.lit(0).cast("long"), lambda n, p: n + p["weights"])
    return alone.union(shared.select("node", F.greatest("links", united))).groupBy("node").agg(F.sum("links").alias("links"))


def least_recall(counts: list[tuple[int, int, int]]) -> float:
    """The least of: links found over links there are; its mean over points with links; and over those linked with at most ``FEW_LINKED`` points. ``(found, there, points)`` for each."""
    linked = [(min(ours, there) / there, points) for ours, there, points in counts if there]
    few = [r for r, points in linked if points <= FEW_LINKED]
    if not linked:
        return 1.0
    whole = sum(min(ours, there) for ours, there, _ in counts) / sum(there for _, there, _ in counts)
    return min(whole, sum(r for r, _ in linked) / len(linked), sum(few) / len(few) if few else 1.0)


def _recall(placed: DataFrame, links: DataFrame, least: float) -> float:
    """:func:`least_recall` of the ``AUDIT`` vectors with the smallest hashes, by brute force against all."""
    asked = placed.orderBy(F.xxhash64("node", F.lit(1)), "node").limit(AUDIT).select("node", "embedding").collect()
    held = placed.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in asked])

    def run(batches):
        by: dict[int, list] = {}
        for node, v in held.value:
            by.setdefault(len(v), []).append((node, v))
        by = {d: (np.array([n for n, _ in rows]), unit_rows([v for _, v in rows])) for d, rows in by.items()}
        for batch in batches:
            vectors, node, weight = (batch.column(c).to_pylist() for c in ("embedding", "node", "weight"))
            for d, (ids, q) in by.items():
                rows = [i for i, v in enumerate(vectors) if len(v) == d]
                if rows:
                    near = (unit_rows([vectors[i] for i in rows]) @ q.T >= least) & (np.array([node[i] for i in rows])[:, None] != ids)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array((near * np.array([weight[i] for i in rows])[:, None]).sum(axis=0)), pa.array(near.sum(axis=0))], names=["node", "n", "points"])

    there = {r[0]: r[1:] for r in placed.select("node", "embedding", "weight").mapInArrow(run, "node long, n long, points long").groupBy("node").agg(F.sum("n"), F.sum("points")).collect()}
    ids = placed.sparkSession.createDataFrame([(n,) for n in there], "node long")
    ours = {r[0]: r[1] for r in links.join(F.broadcast(ids), "node").select("node", "links").collect()} if there else {}
    return least_recall([(ours.get(n, 0), *t) for n, t in there.items()])


def near_duplicate_vectors(vectors: DataFrame, least: float = COSINE, shard_rows: int = SHARD_ROWS, overlap: int = OVERLAP, probes: int = PROBES, recall: float = RECALL) -> DataFrame:
    """``vec_id, n_links, component_id, kept, audited_recall`` for each row of ``vectors`` (``vec_id, embedding``).

    Equal vectors are one point with a weight. Points go to their ``overlap`` nearest clusters (centroids from a bounded sample, every
    point is indexed); a cluster beyond ``shard_rows`` is split into blocks by hash. Each block gets a graph; the
    adjacency lists that a point has in its shards are united. Every point is then searched in every block of its
    ``probes`` nearest clusters, block of queries by block of index, so no task holds more than two blocks: greedy from medoids, then on from
    all neighbours in range. Cosines are taken in double precision. Tasks give counts and forests, never lists of pairs.
    The recall is audited by brute force, over links, over points and over points with few links; while the least of the three is below ``recall`` the probes are doubled, until every cluster is searched.

    Null, empty or zero vectors, and those with null or non-finite components, link with nothing; nor do vectors of different
    lengths. Where vec_ids repeat, each row counts; a null vec_id names no component unless it is alone. An empty
    table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    v = vectors.select("vec_id", F.col("embedding").cast(kind).alias("embedding"))
    good = v.where(usable(F.col("embedding")))
    classes = good.groupBy("embedding").agg(F.min("vec_id").alias("low"), F.count("*").alias("weight"))
    classes = written(classes.withColumn("node", F.xxhash64("embedding")), "vectors")
    fit = _fit(classes, shard_rows)
    centroids = spark.sparkContext.broadcast(fit)  # at most MOST_CLUSTERS rows
    most = max((len(c) for _, c in fit.values()), default=1)
    graph = union = held = None
    while True:
        placed = written(_placed(classes, centroids, overlap, probes), "placed")
        if graph is None:
            graph, union, held = _graph(placed, least, shard_rows)
        found = written(_links(graph, union, held, placed, least, shard_rows), "links")
        links = written(_counted(found), "counted")
        reached = _recall(placed, links, least)
        if reached >= recall or probes >= most:
            break
        probes *= 2
    roots = connected_components(found.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    points = classes.select("node", "low", "weight").join(links, "node", "left").join(roots, "node", "left")
    points = points.select("node", "low", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    names = points.groupBy("root").agg(F.min("low").alias("component"))
    named = written(points.join(names, "root").select("node", "n_links", "component"), "named")
    own = v.select("vec_id", F.when(usable(F.col("embedding")), F.xxhash64("embedding")).alias("node"))
    out = own.join(named, "node", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumns({"kept": F.col("vec_id").eqNullSafe(F.col("component_id")), "audited_recall": F.lit(reached)})


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(load(spark, sf_dir, "embeddings"))

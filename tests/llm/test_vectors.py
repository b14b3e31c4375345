"""Embedding near-duplicates against all pairs."""

import numpy as np
import pytest

from mailweave.llm import graphs
from mailweave.llm.vectors import _counted, least_recall, near_duplicate_vectors, op5_embeddings


def brute(vectors, least=0.95):
    def ok(v):
        return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    ids = [i for i, v in vectors if ok(v)]
    unit = [np.array(v, float) / np.linalg.norm(v) for _, v in vectors if ok(v)]
    links = {i: set() for i, _ in vectors}
    for a in range(len(ids)):
        for b in range(a):
            if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least:
                links[ids[a]].add(ids[b])
                links[ids[b]].add(ids[a])
    root = {}
    for i in sorted(links):
        todo = [i] if i not in root else []
        while todo:
            n = todo.pop()
            if n not in root:
                root[n] = i
                todo += links[n]
    return {i: (len(s), root[i], root[i] == i) for i, s in links.items()}


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(1)
    rows = [v for c in rng.normal(size=(60, 16)) for v in (c, c + rng.normal(size=16) * 0.1, c * 2, c + rng.normal(size=16) * 0.3)]
    rows += list(rng.normal(size=16) + rng.normal(size=(200, 16)) * 0.1)  # a tight group of nearly half of all rows
    rows += [rows[3]] * 30
    rows = [r.astype(np.float32).tolist() for r in rows]
    rows += [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], [1e30] * 16, [1e-30] * 16]
    return [(7 * i % 1009, r) for i, r in enumerate(rows)]


@pytest.mark.parametrize("shard_rows", [1500, 60])
def test_against_all_pairs(spark, vectors, shard_rows):
    df = spark.createDataFrame([(i, v, 0) for i, v in vectors], "vec_id long, embedding array<float>, n_links int")
    rows = near_duplicate_vectors(df, shard_rows=shard_rows).collect()
    want, got = brute(vectors), {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rows}
    assert got.keys() == want.keys()
    assert all(got[i][0] <= want[i][0] for i in want)  # never a link below the threshold
    assert sum(g[0] for g in got.values()) >= 0.97 * sum(w[0] for w in want.values())
    assert sum(got[i][1:] == want[i][1:] for i in want) >= 0.98 * len(want)
    assert rows[0].audited_recall >= 0.97


def test_graph_reaches_what_brute_force_finds():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(300, 24)), rng.normal(size=24) + rng.normal(size=(150, 24)) * 0.1])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    adj = graphs.build(x, 0.95)
    assert ((adj >= 0).sum(axis=1) > 0).all() and (adj < len(x)).all()
    a, b = graphs.in_range(x, adj, x, graphs.medoids(x, 4), 0.95, (np.arange(len(x)), np.arange(len(x))))
    near = x @ x.T >= 0.95
    assert near[a, b].all() and len(a) >= 0.98 * near.sum()
    assert len(graphs.build(x[:1])) == 1


def test_a_hot_group_does_not_hide_lost_pairs():
    hot, pairs = [(3000, 3000, 3000)] * 330, [(1, 1, 1)] * 60
    assert least_recall(hot + pairs + [(0, 0, 0)] * 600) == 1
    assert least_recall(hot + pairs[:40] + [(0, 1, 1)] * 20) == pytest.approx(40 / 60)
    assert least_recall([(2900, 3000, 3000)] * 330 + pairs) == pytest.approx(sum([2900] * 330 + [1] * 60) / sum([3000] * 330 + [1] * 60))
    assert least_recall([(0, 0, 0)]) == least_recall([]) == 1


def test_pairs_count_whichever_cluster_found_them(spark):
    schema = "node long, links long, root long, cluster long, shared array<long>, others array<long>, weights array<long>"
    rows = [(1, 5, 1, 0, [], [], []), (1, 2, 1, 3, [3, 4], [7], [2]), (1, 4, 1, 4, [3, 4], [7, 8, 9], [2, 1, 1]), (2, 1, 2, 4, [3, 4], [8], [1]), (2, 1, 2, 3, [3, 4], [9], [1]), (5, 1, 5, 4, [3, 4], [6], [1])]
    assert {tuple(r) for r in _counted(spark.createDataFrame(rows, schema)).collect()} == {(1, 9), (2, 2), (5, 1)}


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (None, None)], "vec_id long, embedding array<double>")
    got = sorted(map(repr, (tuple(r)[:4] for r in near_duplicate_vectors(df).collect())))
    assert got == sorted(map(repr, [(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 0, None, True)]))
    assert near_duplicate_vectors(df.limit(0)).count() == 0


def test_given_embeddings(spark):
    sf = "/root/testdata/sf0.01"
    want = brute([tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()])
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op5_embeddings(spark, sf).collect()} == want

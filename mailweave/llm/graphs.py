"""A flat, robustly pruned neighbour graph over one bounded shard of unit vectors, in numpy."""

from __future__ import annotations

import numpy as np

from .components import local_roots

DEGREE = 20
BEAM = 32
ALPHA = 1.2
EXPAND = 50_000


def medoids(x: np.ndarray, parts: int = 1) -> np.ndarray:
    """The point nearest to the mean; with more parts, also those farthest from the ones before."""
    first = int(np.argmax(x @ x.mean(axis=0)))
    out, near = [first], x @ x[first]
    while len(out) < min(parts, len(x)):
        far = int(np.argmin(near))
        out.append(far)
        near = np.maximum(near, x @ x[far])
    return np.unique(out)


class _Walk:
    """What a batch of queries has seen of a shard."""

    def __init__(self, x: np.ndarray, adj: np.ndarray, q: np.ndarray):
        self.x, self.adj, self.q = x, adj, q
        self.seen = np.zeros((len(q), len(x)), bool)

    def fresh(self, rows: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unseen (row, node) pairs, each once; they count as seen from now on."""
        keep = nodes >= 0
        rows, nodes = rows[keep], nodes[keep]
        keep = ~self.seen[rows, nodes]
        code = np.unique(rows[keep] * len(self.x) + nodes[keep])
        rows, nodes = np.divmod(code, len(self.x))
        self.seen[rows, nodes] = True
        return rows, nodes

    def cosines(self, rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", self.q[rows], self.x[nodes])


def greedy(x: np.ndarray, adj: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int = BEAM, least: float = np.inf, hints=None):
    """Greedy search of all queries at once from the ``entry`` points, and from ``hints``: (query, node) pairs.

    Returned: each query's best nodes (-1: none), the (query, node) pairs met with a cosine of ``least`` or more, and what was seen.
    """
    walk = _Walk(x, adj, q)
    ids = np.full((len(q), beam), -1)
    cos = np.full((len(q), beam), -np.inf)
    unread = np.zeros((len(q), beam), bool)
    met = []
    rows, nodes = np.repeat(np.arange(len(q)), len(entry)), np.tile(entry, len(q))
    if hints is not None:
        rows, nodes = np.concatenate([rows, hints[0]]), np.concatenate([nodes, hints[1]])
    rows, nodes = walk.fresh(rows, nodes)
    while True:
        if len(rows):  # sorted by query
            value = walk.cosines(rows, nodes)
            met.append((rows[value >= least], nodes[value >= least]))
            active, start, count = np.unique(rows, return_index=True, return_counts=True)
            line, place = np.repeat(np.arange(len(active)), count), np.arange(len(rows)) - np.repeat(start, count)
            new, new_cos = np.full((len(active), count.max()), -1), np.full((len(active), count.max()), -np.inf)
            new[line, place], new_cos[line, place] = nodes, value
            best = np.argsort(-np.concatenate([cos[active], new_cos], axis=1), axis=1, kind="stable")[:, :beam]
            for old, more in ((ids, new), (cos, new_cos), (unread, new >= 0)):
                old[active] = np.take_along_axis(np.concatenate([old[active], more], axis=1), best, 1)
        rows = np.flatnonzero(unread.any(axis=1))
        if not len(rows):
            return ids, tuple(np.concatenate(c) for c in zip(*met)), walk
        first = unread[rows].argmax(axis=1)  # best first, so the first unread one is the best
        unread[rows, first] = False
        rows, nodes = walk.fresh(np.repeat(rows, adj.shape[1]), adj[ids[rows, first]].ravel())


def in_range(x: np.ndarray, adj: np.ndarray, q: np.ndarray, entry: np.ndarray, least: float, hints=None, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Range-expanding search: (query, node) pairs with cosine of ``least`` or more.

    After the greedy search, neighbours of every node in range are looked at until no new one is in range. ``hints``:
    (query, node) pairs to start from as well, such as a query's own place and its neighbours elsewhere; -1 is no node.
    """
    _, met, walk = greedy(x, adj, q, entry, beam, least, hints)
    found = np.zeros_like(walk.seen)
    found[met] = True
    rows, nodes = np.nonzero(found)
    while len(rows):
        grown = []
        for start in range(0, len(rows), EXPAND):
            r, n = rows[start : start + EXPAND], nodes[start : start + EXPAND]
            r, n = walk.fresh(np.repeat(r, adj.shape[1]), adj[n].ravel())
            hit = walk.cosines(r, n) >= least
            grown.append((r[hit], n[hit]))
        rows, nodes = (np.concatenate(c) for c in zip(*grown))
        found[rows, nodes] = True
    return np.nonzero(found)


def _pruned(x: np.ndarray, points: np.ndarray, pool: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Robust pruning: keep the nearest candidate, drop those ``alpha`` times nearer to it than to the point, repeat."""
    safe = np.maximum(pool, 0)
    far = 1 - np.einsum("bd,bcd->bc", x[points], x[safe])
    far[(pool < 0) | (pool == points[:, None])] = np.inf
    order = np.argsort(pool, axis=1, kind="stable")  # a node counts once
    ordered = np.take_along_axis(pool, order, 1)
    twice = np.zeros_like(pool, bool)
    np.put_along_axis(twice, order[:, 1:], ordered[:, 1:] == ordered[:, :-1], 1)
    far[twice] = np.inf
    between = 1 - np.matmul(x[safe], x[safe].transpose(0, 2, 1))
    out = np.full((len(points), degree), -1)
    line = np.arange(len(points))
    left = far.copy()
    for k in range(degree):
        best = left.argmin(axis=1)
        alive = np.isfinite(left[line, best])
        if not alive.any():
            break
        out[alive, k] = pool[line, best][alive]
        near = between[line, best]
        left[(alpha * near <= far) & alive[:, None]] = np.inf
        left[line, best] = np.inf
    return out


def build(x: np.ndarray, least: float | None = None, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, batch: int = 512) -> np.ndarray:
    """Adjacency (``len(x)`` x ``degree``, -1: none): points come in doubling batches, then all once more with ``alpha``.

    A point's candidates are what a greedy search from the medoid meets; robust pruning picks among them. Chosen
    neighbours get the link back, and are pruned again with it. At the end every point can be met from the medoid and,
    with ``least``, from all points that links of that cosine join it to.
    """
    n = len(x)
    adj = np.full((n, degree), -1)
    entry = medoids(x)
    rng = np.random.default_rng(n)
    order = np.concatenate([entry, rng.permutation(np.setdiff1d(np.arange(n), entry))])
    done, size = 1, 1
    steps = []
    while done < n:
        size = min(size * 2, batch)
        steps.append((order[done : done + size], 1.0))
        done += size
    steps += [(order[i : i + batch], alpha) for i in range(0, n, batch)]
    for points, a in steps:
        ids, _, _ = greedy(x, adj, x[points], entry, beam)
        adj[points] = _pruned(x, points, np.concatenate([ids, adj[points]], axis=1), a, degree)
        source = np.repeat(points, degree)
        target = adj[points].ravel()
        source, target = source[target >= 0], target[target >= 0]
        keep = ~(adj[target] == source[:, None]).any(axis=1)
        source, target = source[keep], target[keep]
        if not len(target):
            continue
        by = np.lexsort((-np.einsum("ij,ij->i", x[source], x[target]), target))
        source, target = source[by], target[by]
        hubs, start, count = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(start, count)
        near = place < 2 * degree
        back = np.full((len(hubs), min(int(count.max()), 2 * degree)), -1)
        back[np.repeat(np.arange(len(hubs)), count)[near], place[near]] = source[near]
        free = (adj[hubs] >= 0).sum(axis=1) + count <= degree
        pool = np.concatenate([adj[hubs], back], axis=1)
        simple = np.flatnonzero(free)
        if len(simple):
            packed = np.sort(-pool[simple], axis=1)  # links first, blanks (1 when negated) last
            adj[hubs[simple]] = -packed[:, :degree]
        full = np.flatnonzero(~free)
        for i in range(0, len(full), batch):
            some = full[i : i + batch]
            adj[hubs[some]] = _pruned(x, hubs[some], pool[some], a, degree)
    if least is not None:
        close = np.einsum("nd,nkd->nk", x, x[np.maximum(adj, 0)]) >= least
        inside = np.where(close & (adj >= 0), adj, -1)
        line, place = np.nonzero(inside >= 0)
        group = local_roots(n, line, inside[line, place])
        busy = np.bincount(inside[line, place], minlength=n)
        by = np.lexsort((-busy, group))  # of each group the point with the most links
        first = by[np.concatenate([[True], group[by][1:] != group[by][:-1]])]
        adj = _widened(adj, _missing(x, inside, first))
    return _widened(adj, _missing(x, adj, entry))


def _missing(x: np.ndarray, adj: np.ndarray, entry: np.ndarray, among: int = 8) -> dict[int, list[int]]:
    """Links to add, so that walks from ``entry`` meet every point: pruning may drop all links to one, most of all in a tight group.

    Each point that is not met gets a link from one of its ``among`` nearest points that are met, the one with the fewest such
    links, so lists grow by few.
    """
    met = np.zeros(len(x), bool)
    met[entry] = True
    front = entry
    while len(front):
        front = np.unique(adj[front])
        front = front[front >= 0]
        front = front[~met[front]]
        met[front] = True
    lost, there = np.flatnonzero(~met), np.flatnonzero(met)
    extra: dict[int, list[int]] = {}
    for start in range(0, len(lost), 512):
        some = lost[start : start + 512]
        cosine = x[some] @ x[there].T
        near = there[np.argpartition(-cosine, min(among, len(there)) - 1, axis=1)[:, :among]]
        for point, hosts in zip(some.tolist(), near.tolist()):
            extra.setdefault(min(hosts, key=lambda h: len(extra.get(h, ()))), []).append(point)
    return extra


def _widened(adj: np.ndarray, extra: dict[int, list[int]]) -> np.ndarray:
    more = np.full((len(adj), max(map(len, extra.values()), default=0)), -1)
    for host, points in extra.items():
        more[host, : len(points)] = points
    return np.concatenate([adj, more], axis=1)

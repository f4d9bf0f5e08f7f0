"""Clustering of one group's vectors: average linkage, sweeps, silhouettes, stability, density, topics.

Up to ``MOST`` vectors are clustered as they are. More are first dealt to ``MOST`` micro-clusters,
each of the vectors nearest to one of as many leaders; these are clustered with their weights, and
every vector takes its micro-cluster's label. The mean cosine distance between two sets of unit
vectors is 1 less the product of their mean vectors, so linkage between micro-clusters is exact.
"""

from __future__ import annotations

import sys

import numpy as np

MOST = 6_000
#: Vectors up to which distances are held in double precision.
_DOUBLE = 4_000
#: Distances computed at once where not all are held.
_BLOCK = 4_000_000


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _distances(u: np.ndarray) -> np.ndarray:
    d = u @ u.T
    np.subtract(1, d, out=d)
    np.clip(d, 0, 2, out=d)
    np.fill_diagonal(d, 0)
    return d


def cosine_distances(x: np.ndarray) -> np.ndarray:
    return _distances(unit_rows(x))


def micro_clusters(u: np.ndarray, most: int | None = None, seed: int = 0) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
    """(micro-cluster of each unit vector or None if each is its own, mean vectors, weights)."""
    most = most or MOST
    if len(u) <= most:
        return None, u, np.ones(len(u))
    leaders = u[np.sort(np.random.default_rng(seed).choice(len(u), most, replace=False))]
    step = max(1, _BLOCK // most)
    own = np.concatenate([(u[at : at + step] @ leaders.T).argmax(axis=1) for at in range(0, len(u), step)])
    _, own, weights = np.unique(own, return_inverse=True, return_counts=True)
    return own, _sums(u, own, len(weights)) / weights[:, None], weights.astype(float)


def _sums(x: np.ndarray, labels: np.ndarray, n: int) -> np.ndarray:
    """The sum of each label's rows; labels 0 .. n - 1 all have some."""
    order = np.argsort(labels, kind="stable")
    starts = np.searchsorted(labels[order], np.arange(n))
    return np.add.reduceat(x[order], starts, axis=0)


def _merges(means: np.ndarray, weights: np.ndarray, threshold: float) -> list[tuple[float, int, int]]:
    """(height, kept, gone) of each merge up to ``threshold``, by average linkage.

    Nearest-neighbour chains with Lance-Williams updates: quadratic.
    """
    d = _distances(means.astype(np.float64 if len(means) <= _DOUBLE else np.float32))
    n = len(d)
    np.fill_diagonal(d, np.inf)
    size, alive = weights.astype(float), np.ones(n, dtype=bool)
    chain: list[int] = []
    out: list[tuple[float, int, int]] = []
    while alive.sum() > 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            at = chain[-1]
            row = np.where(alive, d[at], np.inf)
            near = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[near]:
                near = chain[-2]
            if len(chain) > 1 and near == chain[-2]:
                break
            if row[near] > threshold:
                # Nothing will come nearer to this cluster: average linkage never shrinks distances below the least.
                alive[at] = False
                chain.pop()
                near = -1
                break
            chain.append(near)
        if near < 0:
            continue
        a, b = chain.pop(), chain.pop()
        if d[a, b] > threshold:
            alive[a] = alive[b] = False
            continue
        keep, gone = min(a, b), max(a, b)
        out.append((float(d[a, b]), keep, gone))
        merged = (size[keep] * d[keep] + size[gone] * d[gone]) / (size[keep] + size[gone])
        d[keep], d[:, keep] = merged, merged
        d[keep, keep] = np.inf
        size[keep] += size[gone]
        alive[gone] = False
    return out


def _numbered(labels: np.ndarray) -> np.ndarray:
    """Labels numbered by the first member."""
    _, first, own = np.unique(labels, return_index=True, return_inverse=True)
    place = np.empty(len(first), dtype=int)
    place[np.argsort(first)] = np.arange(len(first))
    return place[own]


def linkage_labels(x: np.ndarray, thresholds: list[float]) -> list[np.ndarray]:
    """Labels from agglomeration by mean cosine distance, up to each of some thresholds."""
    if not len(x):
        return [np.zeros(0, dtype=int) for _ in thresholds]
    own, means, weights = micro_clusters(unit_rows(x))
    merges, found = _merges(means, weights, max(thresholds)), []
    for t in thresholds:
        up = np.arange(len(means))
        for height, keep, gone in merges:
            if height <= t:
                up[gone] = keep
        while not np.array_equal(up, up[up]):
            up = up[up]
        found.append(_numbered(up if own is None else up[own]))
    return found


def average_linkage(x: np.ndarray, threshold: float) -> np.ndarray:
    """Labels from agglomeration by mean cosine distance, up to ``threshold``, numbered by the
    first member."""
    return linkage_labels(x, [threshold])[0]


def silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette by cosine distance; a lone member has 0; 0 for fewer than two clusters.

    Distances to a cluster add up to its size less the product with its sum of unit vectors, so
    it is exact for any number of vectors.
    """
    kinds, own, sizes = np.unique(labels, return_inverse=True, return_counts=True)
    if len(kinds) < 2 or len(kinds) >= len(x):
        return 0.0
    u = unit_rows(np.asarray(x, dtype=float))
    sums, total, step = _sums(u, own, len(kinds)), 0.0, max(1, _BLOCK // len(kinds))
    for at in range(0, len(u), step):
        part, mine = u[at : at + step], own[at : at + step]
        rows, held = np.arange(len(part)), sizes[mine]
        far = sizes - part @ sums.T
        # Of its own distances, that to itself is none, whatever the vector's length.
        a = np.maximum(far[rows, mine] - (1 - (part * part).sum(axis=1)), 0) / np.maximum(held - 1, 1)
        far /= sizes
        far[rows, mine] = np.inf
        b = np.maximum(far.min(axis=1), 0)
        total += float(np.where(held > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-12), 0).sum())
    return total / len(u)


def sweep(x: np.ndarray, thresholds: list[float]) -> list[tuple[float, int, float]]:
    """(threshold, clusters, silhouette) for each threshold."""
    return [(t, int(labels.max()) + 1 if len(labels) else 0, silhouette(x, labels)) for t, labels in zip(thresholds, linkage_labels(x, thresholds), strict=True)]


def adjusted_rand(a: np.ndarray, b: np.ndarray) -> float:
    """Agreement of two labelings beyond chance, from their contingency table."""
    table = np.zeros((a.max() + 1, b.max() + 1))
    np.add.at(table, (a, b), 1)
    pairs = lambda v: (v * (v - 1) / 2).sum()
    both, x, y, n = pairs(table), pairs(table.sum(axis=1)), pairs(table.sum(axis=0)), len(a)
    expected, most = x * y / max(n * (n - 1) / 2, 1), (x + y) / 2
    return 1.0 if most == expected else float((both - expected) / (most - expected))


def split_stability(x: np.ndarray, threshold: float, repeats: int = 12, share: float = 0.8, seed: int = 0) -> float:
    """Mean agreement of clusterings of random four fifths with that of all; 1 for fewer than
    three vectors, which have no proper part."""
    if len(x) < 3:
        return 1.0
    whole = average_linkage(x, threshold)
    rng, scores = np.random.default_rng(seed), []
    for _ in range(repeats):
        own = np.sort(rng.choice(len(x), max(2, int(share * len(x))), replace=False))
        scores.append(adjusted_rand(whole[own], average_linkage(x[own], threshold)))
    return float(np.mean(scores))


def bootstrap_p10(values: np.ndarray, repeats: int = 200, share: float = 0.8, seed: int = 0) -> float:
    """The tenth percentile of means of samples with replacement."""
    rng = np.random.default_rng(seed)
    n = max(1, int(share * len(values)))
    return float(np.percentile([values[rng.integers(0, len(values), n)].mean() for _ in range(repeats)], 10))


def hierarchy(x: np.ndarray, threshold: float, levels: int = 3, step: float = 0.1) -> list[np.ndarray]:
    """Labels of each level: clusters' centroids are clustered again, looser each time."""
    out = [average_linkage(x, threshold)]
    for k in range(1, levels):
        labels = out[-1]
        n = labels.max() + 1
        if n < 2:
            break
        centers = _sums(x, labels, n) / np.bincount(labels)[:, None]
        above = average_linkage(centers, threshold + k * step)
        if above.max() + 1 == n:
            break
        out.append(above[labels])
    return out


def density_clusters(x: np.ndarray, least: int = 5, neighbours: int = 5) -> np.ndarray:
    """HDBSCAN with excess of mass on cosine distances; noise is -1."""
    if len(x) < 2 * least:
        return np.full(len(x), -1)
    own, means, weights = micro_clusters(unit_rows(x))
    d = cosine_distances(means.astype(np.float64 if len(means) <= _DOUBLE else np.float32))
    n = len(d)
    # Where a row has met itself and its neighbours, by weight.
    core = np.empty(n)
    for i in range(n):
        order = np.argsort(d[i], kind="stable")
        core[i] = d[i, order[min(int(np.searchsorted(np.cumsum(weights[order]), neighbours + 1)), n - 1)]]
    # Minimum spanning tree (Prim), then single linkage from short to long edges.
    inside, best, link = np.zeros(n, dtype=bool), np.full(n, np.inf), np.zeros(n, dtype=int)
    edges, at = [], 0
    inside[0] = True
    for _ in range(n - 1):
        reach = np.maximum(d[at], np.maximum(core[at], core))
        closer = ~inside & (reach < best)
        best[closer], link[closer] = reach[closer], at
        at = int(np.where(inside, np.inf, best).argmin())
        edges.append((best[at], link[at], at))
        inside[at] = True
    edges.sort()
    up, node_of = list(range(n)), list(range(n))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    kids: dict[int, tuple[int, int, float]] = {}
    sizes = dict(enumerate(weights.astype(int).tolist()))
    for k, (w, a, b) in enumerate(edges):
        ra, rb = root(a), root(b)
        node = n + k
        kids[node] = (node_of[ra], node_of[rb], w)
        sizes[node] = sizes[node_of[ra]] + sizes[node_of[rb]]
        up[rb] = ra
        node_of[ra] = node

    # Clusters may be split off one at a time, so condensing may go as deep as there are any.
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 2 * n + 1_000))

    def leaves(node: int) -> list[int]:
        out, todo = [], [node]
        while todo:
            v = todo.pop()
            if v < n:
                out.append(v)
            else:
                todo.extend(kids[v][:2])
        return out

    def condense(node: int, birth: float) -> tuple[float, list[int]]:
        """(stability, chosen nodes) of the cluster that begins at a node with density 1/birth."""
        start, stability = node, 0.0
        lam0 = 1 / max(birth, 1e-12)
        while node >= n:
            a, b, w = kids[node]
            lam = 1 / max(w, 1e-12)
            big = [c for c in (a, b) if sizes[c] >= least]
            if len(big) == 2:
                stability += sizes[node] * (lam - lam0)
                parts = [condense(c, w) for c in big]
                below = sum(p[0] for p in parts)
                return (stability, [start]) if stability >= below else (below, [c for p in parts for c in p[1]])
            stability += sum(sizes[c] for c in (a, b) if sizes[c] < least) * (lam - lam0)
            if not big:
                return stability, [start]
            node = big[0]
        return stability, [start]

    top = n + len(edges) - 1
    chosen, todo = [], [(top, np.inf)]
    while todo:  # the root itself is never a cluster
        node, _ = todo.pop()
        if node < n:
            continue
        a, b, w = kids[node]
        big = [c for c in (a, b) if sizes[c] >= least]
        if len(big) == 2:
            for c in big:
                chosen += condense(c, w)[1]
        else:
            todo.extend((c, w) for c in big)
    labels = np.full(n, -1)
    for k, node in enumerate(sorted(chosen, key=lambda c: min(leaves(c)))):
        labels[leaves(node)] = k
    return labels if own is None else labels[own]


def nmf(v: np.ndarray, k: int, rounds: int = 200, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative factors (w, h) of v by multiplicative updates from a deterministic start."""
    rng = np.random.default_rng(seed)
    scale = np.sqrt(max(v.mean(), 1e-12) / k)
    w, h = np.abs(rng.normal(0, scale, (v.shape[0], k))) + 1e-6, np.abs(rng.normal(0, scale, (k, v.shape[1]))) + 1e-6
    for _ in range(rounds):
        h *= (w.T @ v) / (w.T @ w @ h + 1e-12)
        w *= (v @ h.T) / (w @ h @ h.T + 1e-12)
    return w, h


def sparse_nmf(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, shape: tuple[int, int], k: int, rounds: int = 200, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """As ``nmf``, of a matrix given by the places and values that aren't zero."""
    rng = np.random.default_rng(seed)
    scale = np.sqrt(max(values.sum() / max(shape[0] * shape[1], 1), 1e-12) / k)
    w, h = np.abs(rng.normal(0, scale, (shape[0], k))) + 1e-6, np.abs(rng.normal(0, scale, (k, shape[1]))) + 1e-6
    for _ in range(rounds):
        h *= np.stack([np.bincount(cols, values * w[rows, j], shape[1]) for j in range(k)]) / (w.T @ w @ h + 1e-12)
        w *= np.stack([np.bincount(rows, values * h[j, cols], shape[0]) for j in range(k)], axis=1) / (w @ (h @ h.T) + 1e-12)
    return w, h

"""Splitting groups, grounding them in names, and arranging them: searches over one group's vectors.

The searches take one group's unit vectors, clustered as in ``clustering`` (whole up to its bound,
by micro-clusters beyond it). Scores over members and names are relational where they can be.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import clustering as c
from . import vectors


def trimmed_centroid(x: np.ndarray, worst: float = 0.2, least: int = 3) -> np.ndarray:
    """The unit mean without the share of members that fit it worst; ``least`` stay."""
    u = c.unit_rows(x)
    mean = c.unit_rows(u.mean(axis=0)[None, :])[0]
    keep = max(min(least, len(u)), len(u) - int(worst * len(u)))
    best = np.argsort(-(u @ mean), kind="stable")[:keep]
    return c.unit_rows(u[best].mean(axis=0)[None, :])[0]


def mean_pair(u: np.ndarray) -> float:
    """Mean cosine over pairs of unit vectors, from their sum; 1 for fewer than two."""
    n = len(u)
    if n < 2:
        return 1.0
    total = u.sum(axis=0)
    return float((total @ total - (u * u).sum()) / (n * (n - 1)))


def distinctness(groups: list[list[list[str]]], most: int = 8) -> float:
    """How far groups' commonest terms differ: one less the mean Jaccard of pairs of groups.
    ``groups``: by group, by member, its terms."""
    tops = []
    for group in groups:
        counts = Counter(t for terms in group for t in set(terms))
        tops.append({t for t, _ in sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:most]})
    pairs = [(a, b) for i, a in enumerate(tops) for b in tops[i + 1 :]]
    return 1 - float(np.mean([len(a & b) / len(a | b) if a | b else 0.0 for a, b in pairs])) if pairs else 0.0


@dataclass
class Gates:
    """What a split must reach."""

    gain: float = 0.03
    silhouette: float = 0.10
    stability: float = 0.55
    distinct: float = 0.30
    coverage: float = 0.60
    least: int = 3
    repeats: int = 12


@dataclass
class Split:
    threshold: float
    accepted: bool
    score: float
    coverage: float
    gain: float
    silhouette: float
    stability: float
    distinct: float
    groups: list[np.ndarray] = field(repr=False)
    rest: np.ndarray = field(repr=False)


def try_split(x: np.ndarray, labels: np.ndarray, threshold: float, terms: list[list[str]] | None, gates: Gates) -> Split | None:
    """What a labeling is worth as a split; None if fewer than two groups are large enough or they
    hold too little. Without terms names don't count against it."""
    u = c.unit_rows(x)
    groups = [np.flatnonzero(labels == k) for k in range(labels.max() + 1)]
    groups = sorted((g for g in groups if len(g) >= gates.least), key=lambda g: (-len(g), g[0]))
    held = np.concatenate(groups) if groups else np.zeros(0, dtype=int)
    coverage = len(held) / len(x)
    if len(groups) < 2 or coverage < gates.coverage:
        return None
    gain = sum(len(g) * mean_pair(u[g]) for g in groups) / len(held) - mean_pair(u)
    own = np.concatenate([np.full(len(g), k) for k, g in enumerate(groups)])
    silhouette = c.silhouette(x[held], own)
    stability = c.split_stability(x, threshold, gates.repeats)
    apart = 1.0 if terms is None else distinctness([[terms[i] for i in g] for g in groups])
    accepted = gain >= gates.gain and silhouette >= gates.silhouette and stability >= gates.stability and apart >= gates.distinct
    # How much each measure counts.
    score = gain + 0.15 * silhouette + 0.10 * stability + 0.05 * apart + 0.05 * coverage
    return Split(threshold, accepted, score, coverage, gain, silhouette, stability, apart, groups, np.setdiff1d(np.arange(len(x)), held))


def best_split(x: np.ndarray, thresholds: list[float], terms: list[list[str]] | None = None, gates: Gates | None = None) -> Split | None:
    """The accepted split of the highest score; of equal scores that of the least threshold."""
    gates = gates or Gates()
    found = [try_split(x, labels, t, terms, gates) for t, labels in zip(thresholds, c.linkage_labels(x, thresholds), strict=True)]
    kept = [s for s in found if s is not None and s.accepted]
    return max(kept, key=lambda s: (s.score, -s.threshold)) if kept else None


def split_tree(x: np.ndarray, thresholds: list[float], terms: list[list[str]] | None = None, gates: Gates | None = None, deepest: int = 4) -> list[tuple[str, str, int, int, float]]:
    """(node, parent, depth, members, score of its own split, 0 if it has none), by splitting groups
    as long as a split is accepted. Nodes are named by their places: r, r.0, r.0.1."""
    gates = gates or Gates()
    out, todo = [], [("r", "", 0, np.arange(len(x)))]
    while todo:
        name, parent, depth, own = todo.pop(0)
        split = None
        if depth < deepest and len(own) >= 2 * gates.least:
            split = best_split(x[own], thresholds, None if terms is None else [terms[i] for i in own], gates)
        out.append((name, parent, depth, len(own), split.score if split else 0.0))
        if split:
            todo += [(f"{name}.{k}", name, depth + 1, own[g]) for k, g in enumerate(split.groups)]
    return out


def partitions(x: np.ndarray, *, lowest: float = 0.14, highest: float = 0.50, step: float = 0.01, least: int = 3, core: float = 0.60, silhouette: float = 0.10, stability: float = 0.55, repeats: int = 12) -> list[tuple[float, int, float, float, float, float, bool, float]]:
    """Partitions into two or three groups, best first: (threshold, groups, share held by them,
    silhouette, stability, balance, accepted, score)."""
    thresholds = [round(lowest + step * k, 6) for k in range(int(round((highest - lowest) / step)) + 1)]
    out, known = [], {}
    for t, labels in zip(thresholds, c.linkage_labels(x, thresholds), strict=True):
        sizes = np.bincount(labels) if len(labels) else np.zeros(0, dtype=int)
        large = np.flatnonzero(sizes >= least)
        inside = np.isin(labels, large)
        if not 2 <= len(large) <= 3 or inside.mean() < core:
            continue
        key = labels.tobytes()
        if key not in known:  # many thresholds give the same labels
            known[key] = (c.silhouette(x[inside], labels[inside]), c.split_stability(x, t, repeats) if len(x) >= 5 else 0.0)
        s, a = known[key]
        balance = float(sizes[large].min() / sizes[large].max())
        score = s + 0.35 * a + 0.10 * balance + float(inside.mean())
        out.append((t, len(large), float(inside.mean()), s, a, balance, s >= silhouette and a >= stability, score))
    return sorted(out, key=lambda p: (not p[6], -p[7], p[0]))


def density_sweep(x: np.ndarray, leasts: tuple[int, ...] = (3, 5, 8, 12), neighbours: tuple[int, ...] = (1, 3, 5)) -> list[tuple[int, int, int, float, float, float]]:
    """(least, neighbours, clusters, coverage, silhouette, score) of density clusterings, best first:
    silhouette, less for a coverage away from three fifths and for more than twenty clusters."""
    out = []
    for least in leasts:
        for near in neighbours:
            labels = c.density_clusters(x, least, near)
            held = labels >= 0
            k, coverage = int(labels.max()) + 1 if len(labels) else 0, float(held.mean()) if len(labels) else 0.0
            s = c.silhouette(x[held], labels[held]) if k >= 2 else 0.0
            out.append((least, near, k, coverage, s, s - 0.2 * abs(coverage - 0.6) - 0.01 * max(0, k - 20)))
    return sorted(out, key=lambda p: (-p[5], p[0], p[1]))


def gap_clusters(x: np.ndarray, names: list, threshold: float, least: int = 2) -> list[tuple]:
    """(name of the medoid, members) of the groups among what nothing else covers; the medoid is the
    member of the highest mean similarity, the first of equal ones."""
    u, labels = c.unit_rows(x), c.average_linkage(x, threshold)
    out = []
    for k in range(labels.max() + 1 if len(labels) else 0):
        own = np.flatnonzero(labels == k)
        if len(own) >= least:
            fit = u[own] @ u[own].sum(axis=0)
            out.append((names[own[int(np.argmax(np.round(fit, 9)))]], len(own)))
    return out


def hierarchy_with_secondary(x: np.ndarray, threshold: float, *, margin: float = 0.03, quantile: float = 0.20, most: int = 2) -> list[tuple[int, int, float, str]]:
    """(child, parent, fit, kind): groups of two or more children are parents, and each child's own
    is its primary one. Up to ``most`` further parents are secondary: their fit is within ``margin``
    of the primary's and reaches the parent's own quantile of fits. A child alone has none of its own."""
    u, labels = c.unit_rows(x), c.average_linkage(x, threshold)
    kinds = [k for k in range(labels.max() + 1 if len(labels) else 0) if (labels == k).sum() >= 2]
    if not kinds:
        return []
    centers = np.stack([c.unit_rows(u[labels == k].mean(axis=0)[None, :])[0] for k in kinds])
    fits = np.round(u @ centers.T, 9)
    floors = np.array([np.quantile(fits[labels == k, j], quantile) for j, k in enumerate(kinds)])
    out = []
    for i in range(len(x)):
        own = kinds.index(labels[i]) if labels[i] in kinds else None
        if own is not None:
            out.append((i, own, float(fits[i, own]), "primary"))
        limit = fits[i, own] - margin if own is not None else -np.inf
        others = [j for j in np.argsort(-fits[i], kind="stable").tolist() if j != own and fits[i, j] >= floors[j] and fits[i, j] >= limit]
        out += [(i, j, float(fits[i, j]), "secondary") for j in others[:most]]
    return out


# ---- relational scores -------------------------------------------------------------------------


def score_names(members: DataFrame, names: DataFrame) -> DataFrame:
    """How well each group's own name fits its members, among all names: group, support,
    alignment (of the name with the members' centroid), mean and least fit, blend (half of each),
    votes (share of members whose best name it is), mean and least margin to the next name.

    members: group, id, v (unit vectors); names: group, v. Names are few (``vectors.small``).
    """
    named = vectors.small(names.select(F.col("group").alias("name"), F.col("v").alias("c")))
    fits = members.join(named).select("group", "id", "name", F.round(vectors.dot("v", "c"), 9).alias("fit"))
    own = fits.where(F.col("name") == F.col("group")).select("group", "id", "fit")
    other = fits.where(F.col("name") != F.col("group")).groupBy("group", "id").agg(F.max("fit").alias("next"))
    judged = own.join(other, ["group", "id"], "left").withColumn("margin", F.col("fit") - F.coalesce("next", F.lit(0.0)))
    won = F.avg((F.col("fit") >= F.coalesce("next", F.lit(-2.0))).cast("double"))
    by = judged.groupBy("group").agg(F.count("*").alias("support"), F.avg("fit").alias("mean_fit"), F.min("fit").alias("least_fit"), won.alias("votes"), F.avg("margin").alias("mean_margin"), F.min("margin").alias("least_margin"))
    centers = vectors.centroids(members.select(F.col("group").alias("label"), "v"), "label").select(F.col("label").alias("group"), F.col("c").alias("center"))
    aligned = centers.join(names.withColumnRenamed("v", "own"), "group").select("group", F.round(vectors.dot("own", "center"), 9).alias("alignment"))
    return by.join(aligned, "group").withColumn("blend", 0.5 * F.col("mean_fit") + 0.5 * F.col("alignment"))


def bootstrap_alignment(u: np.ndarray, repeats: int = 200, share: float = 1.0, seed: int = 0) -> tuple[float, float]:
    """Mean and tenth percentile of the cosine between a group's centroid and those of samples with
    replacement: what its name rests on."""
    rng = np.random.default_rng(seed)
    center = c.unit_rows(u.mean(axis=0)[None, :])[0]
    n = max(1, int(share * len(u)))
    found = [float(c.unit_rows(u[rng.integers(0, len(u), n)].mean(axis=0)[None, :])[0] @ center) for _ in range(repeats)]
    return float(np.mean(found)), float(np.percentile(found, 10))


def expand_rounds(members: DataFrame, pool: DataFrame, *, rounds: int = 3, slack: float = 0.05, most: int = 12) -> DataFrame:
    """(group, id, round): what joins each group as its centroid moves. In every round the floor
    is the least fit of the group's members less ``slack``; the ``most`` best of the pool that reach
    it, and that no group has, join the group they fit best. Both tables: (group,) id, v."""
    from ..storage import materialise

    found, held = None, materialise(members.select("group", "id", "v", F.lit(0).alias("round")))
    for k in range(1, rounds + 1):
        centers = vectors.centroids(held.select(F.col("group").alias("label"), "v"), "label").select(F.col("label").alias("group"), "c")
        floors = held.join(vectors.small(centers), "group").groupBy("group").agg((F.min(F.round(vectors.dot("v", "c"), 9)) - slack).alias("floor"))
        free = pool.join(held.select("id"), "id", "left_anti")
        fits = free.join(vectors.small(centers.join(floors, "group"))).select("id", "v", "group", "floor", F.round(vectors.dot("v", "c"), 9).alias("fit"))
        best = fits.groupBy("id").agg(F.max(F.struct("fit", F.negative(F.hash("group")).alias("_t"), "group", "floor", "v")).alias("b")).select("id", "b.*").where("fit >= floor")
        place = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("fit"), "id"))
        new = materialise(best.withColumn("_place", place).where(F.col("_place") <= most).select("group", "id", "v", F.lit(k).alias("round")))
        if new.isEmpty():
            break
        found = new if found is None else found.unionByName(new)
        held = materialise(held.unionByName(new))
    return (found if found is not None else held.where("1 = 0")).select("group", "id", "round")

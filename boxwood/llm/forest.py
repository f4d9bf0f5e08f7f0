"""Near-duplicate embeddings by a forest of random-projection trees.

Each tree splits the vectors again and again by a random projection and a bound; vectors close
to the bound go to both sides. A tree has one direction for each depth, made from a seed, so that
it is held as one bound a node. Its top is grown on a sample of all vectors; then every leaf that
is still too large is grown further on a sample of its own, on the executors, until none is: how
large leaves are does not depend on how many vectors there are. Within a leaf all vectors are compared by blocks of
a matrix product, and pairs at or above the threshold are links. A pair may meet in several
leaves: it counts in the first of them only, which both know because every vector carries the
numbers of all its leaves. So links are counted without being listed: a leaf passes on a count
for each vector and one edge that joins it to its group.

Equal vectors are collapsed first. A leaf too large for one task, such as a group of near copies
that projections can't split, is dealt to cells, and every pair of cells is compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graphs import components as connected_components
from .common import materialise, table
from .simhash import Joined

TREES = 6
LEAF = 1_024
#: Leaves of one tree, about; beyond, leaves grow with the vectors. Bounds the table of nodes that
#: goes to the executors, 24 bytes each.
LEAVES = 1 << 18
#: Vectors that the trees' tops are grown on, and those of one leaf that it is grown further on.
#: All vectors are dealt and compared.
SAMPLE, OWN = 16_384, 4_096
#: Directions of one tree, levels that a leaf grows at once, and vectors that a split is made on.
DEPTH, LEVELS, FEWEST = 48, 10, 32
#: Vectors at home in one cell of a leaf.
CELL = 4_096
#: Share of the link radius within which a vector goes to both sides of a split.
SPILL = 0.03
_BLOCK = 1_024
_SEED = 20_240_601


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, v (null unless the vector can link: no null or non-finite component, not zero)."""
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("v", lambda x: x != 0)
    return own.select("vec_id", F.when(~F.coalesce(bad, F.lit(True)) & F.coalesce(some, F.lit(False)), F.col("v")).alias("v"))


def units(column: pa.Array) -> np.ndarray:
    """Rows of unit length in double precision; scaled first, so that no square overflows."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def grow(p: np.ndarray, levels: int, spill: float) -> tuple[list[float], list[int], list[int]]:
    """A subtree on vectors' projections (a column for each level): bounds, left and right
    children. A child is a node's position, or -1 - the number of a leaf. Without a node, what
    was to be split stays a leaf.

    Of several quantiles the bound with the fewest vectors near it is taken, so that dense groups
    stay whole. A projection that is dense at all of them is passed over by a node that sends
    everything to the right; on the next one outer quantiles count too, which part a dense group
    from what is around it.
    """
    bounds: list[float] = []
    children: list[list[int]] = []
    leaves = 0

    def node(bound: float) -> int:
        bounds.append(bound)
        children.append([0, 0])
        return len(bounds) - 1

    def leaf() -> int:
        nonlocal leaves
        leaves += 1
        return -leaves

    def split(own: np.ndarray, depth: int, levels: int) -> int:
        if levels <= 0 or len(own) < 2 * FEWEST:
            return leaf()
        for over, (lo, hi) in enumerate([(0.3, 0.7), (0.05, 0.95), (0.05, 0.95)][: p.shape[1] - depth]):
            v = np.sort(p[own, depth + over])
            at = v[(np.linspace(lo, hi, 33) * (len(v) - 1)).astype(int)]
            near = np.searchsorted(v, at + spill) - np.searchsorted(v, at - spill)
            if near.min() <= lo * len(v):
                chain = [node(-np.inf) for _ in range(over)] + [node(float(at[near.argmin()]))]
                empty = [leaf() for _ in range(over)]
                for a, b, none in zip(chain, chain[1:], empty, strict=False):
                    children[a] = [none, b]
                side = p[own, depth + over] < bounds[chain[-1]]
                children[chain[-1]] = [split(own[side], depth + over + 1, levels - 1), split(own[~side], depth + over + 1, levels - 1)]
                return chain[0]
        return leaf()

    split(np.arange(len(p)), 0, levels)
    return bounds, [c[0] for c in children], [c[1] for c in children]


class Forest:
    """Trees in flat arrays: bounds and children of nodes, and by leaf where it hangs."""

    def __init__(self, dims: int, trees: int, spill: float):
        rng = [np.random.default_rng(_SEED + t) for t in range(trees)]
        w = np.stack([r.standard_normal((DEPTH, dims)) for r in rng])
        self.directions = w / np.linalg.norm(w, axis=2, keepdims=True)
        self.spill, self.deepest = spill, 0
        self.bounds, self.children = np.zeros(0), np.zeros((0, 2), dtype=np.int64)
        self.roots = -1 - np.arange(trees)
        #: By leaf: tree, depth, and the node and side that it hangs from (-1 for a root).
        self.leaf = np.array([(t, 0, -1, t) for t in range(trees)], dtype=np.int64)

    def replace(self, grown: list[tuple[int, list[float], list[int], list[int]]]) -> None:
        """Put subtrees in the place of leaves; a leaf that did not grow stays."""
        for at, bounds, left, right in grown:
            if not bounds:
                continue
            tree, depth, above, side = self.leaf[at].tolist()
            base, first = len(self.bounds), len(self.leaf)
            own = np.stack([left, right], axis=1).astype(np.int64)
            depths = np.zeros(len(own), dtype=np.int64)
            for k in range(len(own)):  # a node comes before its children
                depths[own[k][own[k] >= 0]] = depths[k] + 1
            node, which = np.nonzero(own < 0)
            made = np.stack([np.full(len(node), tree), depth + depths[node] + 1, base + node, which], axis=1)
            moved = np.where(own >= 0, own + base, own)
            moved[node, which] = -1 - (first + np.arange(len(node)))
            self.bounds, self.children, self.leaf = np.concatenate([self.bounds, bounds]), np.concatenate([self.children, moved]), np.concatenate([self.leaf, made])
            self.deepest = max(self.deepest, int(made[:, 1].max()))
            if above < 0:
                self.roots[tree] = base
            else:
                self.children[above, side] = base

    def project(self, x: np.ndarray, tree: int, lo: int, hi: int) -> np.ndarray:
        return x @ self.directions[tree, lo:hi].T

    def reach(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of x and the leaves that they lie in, those that spill over included."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for tree, root in enumerate(self.roots.tolist()):
            p = self.project(x, tree, 0, self.deepest)
            rows, at = np.arange(len(x)), np.full(len(x), root)
            for depth in range(self.deepest + 1):
                there = at < 0
                out.append((rows[there], -1 - at[there]))
                rows, at = rows[~there], at[~there]
                if not len(rows):
                    break
                v, bound = p[rows, depth], self.bounds[at]
                low, high = v < bound + self.spill, v >= bound - self.spill
                rows, at = np.concatenate([rows[low], rows[high]]), np.concatenate([self.children[at[low], 0], self.children[at[high], 1]])
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


class _Rows:
    """Vectors of a cell: nodes, how many rows each stands for, units, and their leaves."""

    def __init__(self, node: np.ndarray, many: np.ndarray, x: np.ndarray, signs: list[np.ndarray]):
        self.node, self.many, self.x, self.signs = node, many, x, signs

    def __len__(self) -> int:
        return len(self.node)

    @classmethod
    def joined(cls, parts: list[_Rows]) -> _Rows:
        return cls(np.concatenate([p.node for p in parts]), np.concatenate([p.many for p in parts]), np.concatenate([p.x for p in parts]), [s for p in parts for s in p.signs])


def _new(near: np.ndarray, rows: list[np.ndarray], cols: list[np.ndarray], leaf: int) -> np.ndarray:
    """Of the near pairs those that share no leaf before this one."""
    rows, cols = [s[s < leaf] for s in rows], [s[s < leaf] for s in cols]
    every = np.unique(np.concatenate([*rows, *cols]))
    if not len(every):
        return near
    marks = []
    for signs in (rows, cols):
        m = np.zeros((len(signs), len(every)), dtype=np.float32)
        m[np.repeat(np.arange(len(signs)), [len(s) for s in signs]), np.searchsorted(every, np.concatenate(signs))] = 1
        marks.append(m)
    return near & (marks[0] @ marks[1].T == 0)


def cell_links(leaf: int, home: _Rows, visits: _Rows | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, links, another node of its group) for every vector with a link that counts here:
    of those at home among each other, or of visitors with those at home."""
    same = visits is None
    own = home if same else visits
    base = 0 if same else len(home)
    counts = np.zeros(base + len(own), dtype=np.int64)
    sets = Joined(len(counts))
    for a in range(0, len(own), _BLOCK):
        for b in range(0, len(home), _BLOCK):
            near = own.x[a : a + _BLOCK] @ home.x[b : b + _BLOCK].T >= threshold
            if same and a == b:
                np.fill_diagonal(near, False)
            r, c = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
            if not len(r):
                continue
            near = _new(near[np.ix_(r, c)], [own.signs[a + i] for i in r], [home.signs[b + i] for i in c], leaf)
            r, c = r + a, c + b
            counts[base + r] += near @ home.many[c]
            if not same:
                counts[c] += near.T @ own.many[r]
            sets.link(near, base + r, c)
    node = home.node if same else np.concatenate([home.node, own.node])
    some = np.flatnonzero(counts)
    return node[some], counts[some], node[sets.roots(some)] if len(some) else node[some]


LINKS = "node long, n long, other long"


def _links(rows: DataFrame, threshold: float) -> DataFrame:
    """Counts and edges of all cells, whose rows come home first in a sorted partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        home: _Rows | None = None
        held: list[_Rows] = []

        def close() -> pa.RecordBatch | None:
            """Work on what is held: first those at home, then visitors."""
            nonlocal home, held
            if not held or at is None:
                return None
            found = None
            own = _Rows.joined(held)
            held = []
            if at[2]:
                home = own
                found = cell_links(at[0], home, None, threshold)
            elif home is not None:
                found = cell_links(at[0], home, own, threshold)
            if found is None or not len(found[0]):
                return None
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["node", "n", "other"])

        for batch in batches:
            if not batch.num_rows:
                continue
            leaf, cell, inside = batch.column("leaf").to_numpy(), batch.column("cell").to_numpy(), batch.column("home").to_numpy(zero_copy_only=False)
            node, many, x = batch.column("node").to_numpy(), batch.column("many").to_numpy(), units(batch.column("v"))
            signs = [np.array(s, dtype=np.int64) for s in batch.column("leaves").to_pylist()]
            cuts = (np.flatnonzero((np.diff(leaf) != 0) | (np.diff(cell) != 0) | (np.diff(inside.astype(np.int8)) != 0)) + 1).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, len(leaf)], strict=True):
                key = (int(leaf[lo]), int(cell[lo]), bool(inside[lo]))
                if key != at:
                    if (out := close()) is not None:
                        yield out
                    if at is None or key[:2] != at[:2]:
                        home = None
                    at = key
                held.append(_Rows(node[lo:hi], many[lo:hi], x[lo:hi], signs[lo:hi]))
                if not key[2] and sum(map(len, held)) >= CELL:
                    if (out := close()) is not None:
                        yield out
        if (out := close()) is not None:
            yield out

    dealt = rows.select("leaf", "cell", "home", "node", "many", "leaves", "v").repartition("leaf", "cell")
    return dealt.sortWithinPartitions("leaf", "cell", F.desc("home"), "node").mapInArrow(run, LINKS)


def link_vectors(vectors: DataFrame, *, threshold: float = 0.95, trees: int = TREES, leaf: int = LEAF, cell: int = CELL, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (least vec_id reachable by
    links, itself included) and kept (vec_id is the component_id), one row per input row.

    Links are pairs with a cosine of at least ``threshold`` in double precision that meet in a
    leaf of one of the trees; none below it is linked. Vectors that are null, empty, zero or
    hold a null or non-finite component link with nothing, nor do vectors of different lengths.
    Equal vectors are always linked; rows with equal ids stay rows of their own; a null id takes
    no part in the minimum, and its component_id is that of its group, or null, and kept is
    false. An empty table has no rows; other columns are left unread.
    """
    spark = vectors.sparkSession
    own = usable(vectors, id_col, vec_col)
    sound = own.where(F.col("v").isNotNull())
    alike = sound.groupBy("v").agg(F.count("*").alias("many"), F.min("vec_id").alias("low"))
    reps = materialise(alike.withColumn("node", F.monotonically_increasing_id()).withColumn("dims", F.size("v")))
    results = []
    for dims, n in sorted((r["dims"], r["count"]) for r in reps.groupBy("dims").count().collect()):
        results.append(_link_alike(reps.where(F.col("dims") == dims), n, threshold, trees, leaf, cell))
    empty = spark.createDataFrame([], LINKS)
    found = empty
    for r in results:
        found = found.unionByName(r)
    found = materialise(found)
    counts = materialise(found.groupBy("node").agg(F.sum("n").alias("n")))
    groups = connected_components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    linked = materialise(reps.select("node", "low", "many").join(groups, "node", "left").join(counts, "node", "left").withColumn("component", F.coalesce("component", "node")))
    lows = materialise(linked.groupBy("component").agg(F.min("low").alias("least")))
    told = linked.join(lows, "component").select("node", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), "least")
    told = materialise(reps.select("node", "v").join(told, "node").select("v", "n_links", "least"))
    out = sound.join(told, "v").select("vec_id", "n_links", F.col("least").alias("component_id"))
    rest = own.where(F.col("v").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def plant(reps: DataFrame, n: int, leaf: int, trees: int, spill: float) -> Forest:
    """Trees over the vectors ``v`` of ``reps`` whose leaves hold about ``leaf`` of them, or are
    dense. The sample of the tops and the bounds of nodes come to the driver."""
    sample = units(reps.orderBy(F.xxhash64("node")).limit(SAMPLE).select("v").toArrow().column("v").combine_chunks())
    forest = Forest(sample.shape[1], trees, spill)
    levels = int(np.ceil(np.log2(max(1, n / leaf))))
    forest.replace([(t, *grow(forest.project(sample, t, 0, min(DEPTH, levels + 2)), levels, spill)) for t in range(trees)])
    dense: set[int] = set()
    while n > SAMPLE:

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    which, many = np.unique(forest.reach(units(batch.column("v")))[1], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(many)], names=["leaf", "n"])

        sizes = reps.select("v").mapInArrow(count, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).where(F.col("n") > 2 * leaf)
        large = {r["leaf"]: r["n"] for r in sizes.collect() if r["leaf"] not in dense and forest.leaf[r["leaf"], 1] + 3 < DEPTH}
        if not large:
            break
        rate = np.zeros(len(forest.leaf))
        rate[list(large)] = [min(1.0, OWN / many) for many in large.values()]

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Of every large leaf some vectors, by a hash, as their next projections."""
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, mark = units(batch.column("v")), batch.column("mark").to_numpy() / (1 << 20)
                rows, leaves = forest.reach(x)
                keep = mark[rows] < rate[leaves]
                rows, leaves = rows[keep], leaves[keep]
                places = forest.leaf[leaves, 0] * DEPTH + forest.leaf[leaves, 1]
                for at in np.unique(places).tolist():
                    own, (tree, depth) = places == at, divmod(at, DEPTH)
                    p = forest.project(x[rows[own]], tree, depth, min(DEPTH, depth + LEVELS + 2))
                    flat = pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), p.shape[1]).cast(pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([pa.array(leaves[own]), flat], names=["leaf", "p"])

        def further(key: tuple, table: pa.Table) -> pa.Table:
            """A leaf's sample has OWN vectors, about."""
            which = key[0].as_py()
            p = table.column("p").combine_chunks()
            p = p.flatten().to_numpy().reshape(len(p), -1)
            bounds, left, right = grow(p[np.lexsort(p.T)], min(LEVELS, int(np.ceil(np.log2(large[which] / leaf)))), spill)
            return pa.table({"leaf": pa.array([which]), "bounds": pa.array([bounds], pa.list_(pa.float64())), "left": pa.array([left], pa.list_(pa.int64())), "right": pa.array([right], pa.list_(pa.int64()))})

        marked = reps.select("v", F.pmod(F.xxhash64(F.lit(len(forest.leaf)), "node"), F.lit(1 << 20)).alias("mark"))
        drawn = marked.mapInArrow(draw, "leaf long, p array<double>")
        grown = drawn.groupBy("leaf").applyInArrow(further, "leaf long, bounds array<double>, `left` array<long>, `right` array<long>")
        found = sorted((r["leaf"], r["bounds"], r["left"], r["right"]) for r in grown.collect())
        dense |= set(large) - {k for k, bounds, _, _ in found if bounds}
        forest.replace(found)
    return forest


def _link_alike(reps: DataFrame, n: int, threshold: float, trees: int, leaf: int, cell: int) -> DataFrame:
    """Counts and edges among distinct vectors of one length."""
    spill = SPILL * float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    forest = plant(reps, n, max(leaf, n // LEAVES), trees, spill)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = units(batch.column("v"))
            rows, leaves = forest.reach(x)
            order = np.lexsort((leaves, rows))
            rows, leaves = rows[order], leaves[order]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(x)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("many"), batch.column("v"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(leaves))], names=["node", "many", "v", "leaves"])

    kind = reps.schema["v"].dataType.simpleString()
    signed = reps.select("node", "many", "v").mapInArrow(run, f"node long, many long, v {kind}, leaves array<long>")
    rows = signed.withColumn("leaf", F.explode("leaves"))
    large = materialise(signed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().where(F.col("count") > cell).select("leaf", F.ceil(F.col("count") / cell).cast("int").alias("cells")))
    if large.isEmpty():
        rows = rows.withColumn("cell", F.lit(0)).withColumn("home", F.lit(True))
    else:
        # A row for each large leaf; their number has the bound that LEAVES gives.
        rows = rows.join(F.broadcast(large), "leaf", "left").withColumn("cells", F.coalesce("cells", F.lit(1)))
        rows = rows.withColumn("own", F.pmod(F.xxhash64("node", "leaf"), F.col("cells")).cast("int"))
        rows = rows.withColumn("cell", F.explode(F.sequence("own", F.col("cells") - 1))).withColumn("home", F.col("cell") == F.col("own"))
    return _links(rows, threshold)


def op10_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings linked at a cosine of 0.95 or more."""
    return link_vectors(table(spark, sf_dir, "embeddings"))

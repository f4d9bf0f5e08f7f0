"""Near-duplicates by SimHash, linked with vantage-point trees.

Fingerprints are first collapsed to the distinct ones. A vantage-point tree, built on a bounded
sample, deals them into shards by Hamming distance: a fingerprint has one home shard and visits
every other shard that may hold one within the radius, by the triangle inequality. In each shard
a second tree over the fingerprints at home answers the visitors, pruned by the same bounds. The
links found are all links; only those that join something are passed on to the connected
components, so a group of copies is never expanded into its pairs.

With a wide radius those bounds prune nothing, because unrelated fingerprints all lie at about
half the bits from each other. Then (``keys > 0``) the shards are formed by the least hashes of
the documents' shingles under several permutations: documents of similarity s share at least one
of k keys with probability 1 - (1 - s)^k, and the trees work within these shards. ``keep_one``
takes the links found there as candidates only, and decides by the sets of shingles themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graphs import components as connected_components
from .common import bytes_of, frugal, materialise, slices, table

SEED = 42
#: Fingerprints at home in a shard, about, and sampled for each shard of the dealing tree. Shards
#: grow in number with the fingerprints, so that each fits one task.
SHARD, SAMPLE = 65_536, 8
#: Fingerprints at home in one cell of a shard; more are dealt to several cells, each visited.
CELL = 262_144
#: The same for shards that are formed by keys, whose trees prune nothing.
KEY_CELL = 32_768
LEAF = 96
_CHUNK = 65_536
#: Fingerprint words compared at once, which bounds memory.
_BLOCK = 4_000_000
#: Shingles at home in one cell of a group of candidates, and of visitors held at once.
SETS = 1 << 21


def _odd(k: int) -> np.uint64:
    """The k-th odd multiplier, from 1: SplitMix64 of k with its lowest bit set."""
    z = k * 0x9E3779B97F4A7C15
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = ((z ^ (z & (1 << 64) - 1) >> shift) * factor) & (1 << 64) - 1
    return np.uint64(z ^ z >> 31 | 1)


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every word shingle of a text, repeats included.

    A-Z become lower case; words are runs without ASCII white space; fewer words than a shingle
    has are one shingle; no word gives none.
    """
    from xxhash import xxh64_intdigest

    found = text.lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[: len(found) - words + 1]
    ends = ends[words - 1 :] - 1
    out = np.empty(len(starts), dtype=np.uint64)
    for at in range(0, len(starts), _CHUNK):
        out[at : at + _CHUNK] = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[at : at + _CHUNK].tolist(), ends[at : at + _CHUNK].tolist(), strict=True)]
    return out


def fingerprint(hashes: np.ndarray, width: int = 1) -> np.ndarray:
    """``width`` words of 64 bits; a bit is 1 if set in over half the hashes.

    Words after the first take their bits from the hash multiplied by odd constants.
    """
    out = np.zeros(width, dtype=np.uint64)
    for w in range(width):
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(hashes), _CHUNK):
            part = hashes[at : at + _CHUNK]
            if w:
                part = part * _odd(2 * w)
                part ^= part >> np.uint64(29)
                part = part * _odd(2 * w + 1)
                part ^= part >> np.uint64(32)
            bits = np.unpackbits(part.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.uint32)
        out[w] = np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]
    return out


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances between rows of two (n, width) arrays that broadcast against each other."""
    if a.shape[-1] == 1:
        return np.bitwise_count(a[..., 0] ^ b[..., 0])
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.uint16)


class VantageTree:
    """Vantage-point tree over fingerprints; leaves hold positions.

    Inner node: vantage fingerprint, bound, inside (distance <= bound) and outside children.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF, leaves: int | None = None):
        self.points = points
        self.vantages: list[np.ndarray] = []
        self.bounds: list[int] = []
        self.children: list[list[int]] = []  # a leaf is -1 - its number
        self.leaves: list[np.ndarray] = []
        self.root = self._build(leaf, leaves)

    def _split(self, own: np.ndarray) -> tuple[np.ndarray, int, np.ndarray] | None:
        """Of a few vantage points, that whose distances vary most; None if nothing is split."""
        best = None
        for at in (0, len(own) // 2, len(own) - 1):
            d = distance(self.points[own], self.points[own[at]][None, :]).astype(np.int32)
            if best is None or d.std() > best[0]:
                best = (d.std(), self.points[own[at]], d)
        _, vantage, d = best
        bound = int(np.median(d))
        inside = d <= bound
        if inside.all():
            bound = int(d.max()) - 1
            inside = d <= bound
        return None if inside.all() or not inside.any() else (vantage, bound, inside)

    def _build(self, leaf: int, leaves: int | None) -> int:
        depth_cap = None if leaves is None else max(0, (leaves - 1).bit_length())

        def grow(own: np.ndarray, depth: int) -> int:
            split = self._split(own) if len(own) > leaf and depth != depth_cap else None
            if split is None:
                self.leaves.append(own)
                return -len(self.leaves)
            vantage, bound, inside = split
            k = len(self.bounds)
            self.vantages.append(vantage)
            self.bounds.append(bound)
            self.children.append([0, 0])
            self.children[k][0] = grow(own[inside], depth + 1)
            self.children[k][1] = grow(own[~inside], depth + 1)
            return k

        return grow(np.arange(len(self.points)), 0)

    def reach(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, positions of queries) for each leaf that may hold a point within the radius."""
        todo = [(self.root, np.arange(len(queries)))]
        while todo:
            node, own = todo.pop()
            if not len(own):
                continue
            if node < 0:
                yield -1 - node, own
                continue
            d = distance(queries[own], self.vantages[node][None, :]).astype(np.int32)
            todo.append((self.children[node][0], own[d - radius <= self.bounds[node]]))
            todo.append((self.children[node][1], own[d + radius > self.bounds[node]]))


class Joined:
    """Union-find over positions; ``first`` labels are least positions."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, own: np.ndarray) -> np.ndarray:
        up = self.up
        r = up[own]
        while True:
            above = up[r]
            if np.array_equal(above, r):
                up[own] = r
                return r
            r = above

    def union(self, a: int, b: int) -> None:
        up = self.up
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        while up[b] != b:
            up[b] = up[up[b]]
            b = up[b]
        if a != b:
            up[max(a, b)] = min(a, b)

    def link(self, near: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> None:
        """Join rows and columns where ``near`` holds. Pairs already joined cost no step of
        their own: each pass joins one new pair a row until none is left."""
        hit = near.any(axis=1)
        near, rows = near[hit], rows[hit]
        while len(rows):
            apart = near & (self.roots(rows)[:, None] != self.roots(cols)[None, :])
            hit = apart.any(axis=1)
            if not hit.any():
                return
            near, rows = near[hit], rows[hit]
            for a, b in zip(rows.tolist(), cols[apart[hit].argmax(axis=1)].tolist(), strict=True):
                self.union(a, b)


class Cell:
    """Fingerprints at home in a cell: one tree and one set of groups, however many visit.

    Links are pairs (fingerprints, fingerprints) that join all linked ones: of those at home
    among each other (``within``), and of each batch of visitors with those at home (``visit``).
    A group that a visitor joins stays joined, so that no later batch finds it again.
    """

    def __init__(self, home: np.ndarray, radius: int):
        self.home, self.radius = home, radius
        self.tree, self.sets = VantageTree(home), Joined(len(home))

    def _join(self, queries: np.ndarray, base: int, sets: Joined) -> None:
        for leaf, own in self.tree.reach(queries, self.radius):
            cols = self.tree.leaves[leaf]
            step = max(1, _BLOCK // (len(cols) * self.home.shape[1]))
            for at in range(0, len(own), step):
                rows = own[at : at + step]
                # Once a leaf is one group, who belongs to it already has nothing to find there.
                group = sets.roots(cols)
                if (group == group[0]).all():
                    rows = rows[sets.roots(rows + base) != group[0]]
                if len(rows):
                    sets.link(distance(queries[rows][:, None, :], self.home[cols][None, :, :]) <= self.radius, rows + base, cols)

    @staticmethod
    def _edges(points: np.ndarray, sets: Joined, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        roots = sets.roots(np.arange(len(points)))
        moved = np.flatnonzero(roots != before)
        return points[moved], points[roots[moved]]

    def within(self) -> tuple[np.ndarray, np.ndarray]:
        self._join(self.home, 0, self.sets)
        return self._edges(self.home, self.sets, np.arange(len(self.home)))

    def visit(self, batch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.home)
        sets = Joined(n + len(batch))
        sets.up[:n] = self.sets.roots(np.arange(n))
        before = sets.up.copy()
        self._join(batch, n, sets)
        found = self._edges(np.concatenate([self.home, batch]), sets, before)
        # Least positions are roots, so those at home have roots at home.
        self.sets.up[:] = sets.roots(np.arange(n))
        return found


def _pack(points: np.ndarray) -> pa.Array:
    width = 8 * points.shape[1]
    raw = points.astype(">u8").tobytes()
    return pa.array([raw[at : at + width] for at in range(0, len(raw), width)], pa.binary())


def _unpack(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=">u8").astype(np.uint64).reshape(-1, width)


def fingerprints(docs: DataFrame, *, shingle: int = 3, width: int = 1, keys: int = 0, distinct: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (binary, highest bit first) and, for ``keys > 0``, keys (array of long) for
    every row. A text without a word, or null, has fingerprint zero. ``distinct``: a shingle
    counts once, however often it is repeated; then also digest (16 bytes) and size (long) of
    the set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            for part in slices(batch, 1024):
                points = np.zeros((part.num_rows, width), dtype=np.uint64)
                least, digests, sizes = [], [], []
                for i, text in enumerate(bytes_of(part.column(1))):
                    hashes = shingle_hashes(text or b"", shingle)
                    if distinct:
                        hashes = np.unique(hashes)
                        digests.append(xxh3_128_digest(hashes.astype("<u8", copy=False).tobytes()))
                        sizes.append(len(hashes))
                    points[i] = fingerprint(hashes, width)
                    if keys:
                        mixed = [int((x ^ x >> np.uint64(31)).min()) if len(hashes) else 0 for x in (hashes * _odd(k) for k in range(101, 101 + keys))]
                        least.append([(x ^ k) - (1 << 63) for k, x in enumerate(mixed)])
                columns = {"doc_id": part.column(0), "fp": _pack(points)}
                if keys:
                    columns["keys"] = pa.array(least, pa.list_(pa.int64()))
                if distinct:
                    columns |= {"digest": pa.array(digests, pa.binary()), "size": pa.array(sizes, pa.int64())}
                yield pa.RecordBatch.from_pydict(columns)

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(frugal(run), "doc_id long, fp binary" + (", keys array<long>" if keys else "") + (", digest binary, size long" if distinct else ""))


def _deal_by_tree(points: DataFrame, n: int, radius: int, width: int) -> DataFrame:
    """(shard, home, fp): one row at home and one for each shard visited."""
    shards = max(32, 1 << (n // SHARD).bit_length())
    sample = points.orderBy(F.xxhash64("fp")).limit(max(8_192, SAMPLE * shards)).select("fp").toArrow().column("fp")
    router = VantageTree(_unpack(sample.combine_chunks(), width), leaf=1, leaves=shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 8192):
                own = _unpack(part.column(0), width)
                at_home = np.zeros(len(own), dtype=np.int32)
                for leaf, rows in router.reach(own, 0):
                    at_home[rows] = leaf
                for leaf, rows in router.reach(own, radius):
                    # Of two shards that a pair lies in, the visitor comes from the lower one.
                    rows = rows[at_home[rows] <= leaf]
                    if len(rows):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), leaf, dtype=np.int64)), pa.array(at_home[rows] == leaf), part.column(0).take(pa.array(rows))], names=["shard", "home", "fp"])

    return points.select("fp").mapInArrow(frugal(run), "shard long, home boolean, fp binary")


def _deal_cells(rows: DataFrame, cell: int) -> DataFrame:
    """Add ``cell``: a shard with more at home than one task should hold has several, each with
    its share at home; who is at home in a cell visits those after it, a visitor visits all."""
    large = rows.where("home").groupBy("shard").count().where(F.col("count") > cell).select("shard", F.ceil(F.col("count") / cell).cast("int").alias("cells"))
    large = materialise(large)
    if large.isEmpty():
        return rows.withColumn("cell", F.lit(0))
    dealt = rows.join(large, "shard", "left").withColumn("cells", F.coalesce("cells", F.lit(1)))
    own = F.when(F.col("home"), F.pmod(F.xxhash64("fp"), F.col("cells")).cast("int")).otherwise(F.lit(0))
    dealt = dealt.withColumn("own", own).withColumn("cell", F.explode(F.sequence("own", F.col("cells") - 1)))
    return dealt.select("shard", (F.col("home") & (F.col("cell") == F.col("own"))).alias("home"), "fp", "cell")


def _edges(rows: DataFrame, radius: int, width: int) -> DataFrame:
    """Edges (a, b) within every cell, whose rows come home first in a sorted partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        home: list[np.ndarray] = []
        visits: list[np.ndarray] = []
        waiting, held = 0, None
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def work() -> None:
            """Those at home among each other once, then the visitors that wait."""
            nonlocal waiting, visits, held, home
            if home:
                held, home = Cell(np.concatenate(home), radius), []
                found.append(held.within())
            if held is not None and visits:
                found.append(held.visit(np.concatenate(visits)))
            visits, waiting = [], 0

        def emit() -> pa.RecordBatch:
            nonlocal found
            a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            found = []
            return pa.RecordBatch.from_arrays([_pack(a), _pack(b)], names=["a", "b"])

        for batch in batches:
            shard, cell = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(cell) != 0)) + 1
            points, is_home = _unpack(batch.column(3), width), batch.column(2).to_numpy(zero_copy_only=False)
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard)], strict=True):
                if hi <= lo:
                    continue
                if (shard[lo], cell[lo]) != at:
                    work()
                    at, held = (shard[lo], cell[lo]), None
                inside = is_home[lo:hi]
                if inside.any():
                    home.append(points[lo:hi][inside])
                if not inside.all():
                    visits.append(points[lo:hi][~inside])
                    waiting += len(visits[-1])
                    if waiting >= _CHUNK:
                        work()
            if sum(len(f[0]) for f in found) > 100_000:
                yield emit()
        work()
        if found:
            yield emit()

    dealt = rows.select("shard", "cell", "home", "fp").repartition("shard", "cell")
    return dealt.sortWithinPartitions("shard", "cell", F.desc("home"), "fp").mapInArrow(frugal(run), "a binary, b binary")


def link_fingerprints(fps: DataFrame, *, radius: int = 3, width: int = 1, keys: int = 0, cell: int | None = None) -> DataFrame:
    """(fp, component, low): for every distinct fingerprint a least fingerprint of its component
    and the least doc_id there. ``fps`` is a written table as ``fingerprints`` makes it."""
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("low"), *([F.min("keys").alias("keys")] if keys else [])))
    if keys:
        rows = distinct.select("fp", F.explode(F.array_distinct("keys")).alias("shard")).withColumn("home", F.lit(True))
    else:
        if not (n := distinct.count()):
            return distinct.select("fp", F.col("fp").alias("component"), "low")
        rows = materialise(_deal_by_tree(distinct, n, radius, width))
    found = connected_components(_edges(_deal_cells(rows, cell or (KEY_CELL if keys else CELL)), radius, width))
    linked = materialise(distinct.select("fp", "low").join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    lows = materialise(linked.groupBy("component").agg(F.min("low").alias("low")))
    return materialise(linked.select("fp", "component").join(lows, "component").select("fp", "component", "low"))


def near_duplicates(docs: DataFrame, *, shingle: int = 3, radius: int = 3, width: int = 1, keys: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (hex) and component_id (least doc_id reachable) for every row.

    A null or wordless text has fingerprint zero and is linked like any other; repeated rows
    and equal ids stay rows of their own; a null id takes no part in the minimum, and is the
    component only of a group without another id; other columns are left unread; an empty
    table has no rows.
    """
    fps = materialise(fingerprints(docs, shingle=shingle, width=width, keys=keys, id_col=id_col, text_col=text_col))
    linked = link_fingerprints(fps, radius=radius, width=width, keys=keys)
    return fps.select("doc_id", "fp").join(linked, "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), F.col("low").alias("component_id"))


class Sets:
    """Sets of hashes at home in a cell, whose overlaps with one other set are counted at once."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets])
        self.known, codes = np.unique(np.concatenate(sets), return_inverse=True)
        self.codes = codes.astype(np.int32)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.mark = np.zeros(len(self.known), dtype=bool)

    def similar(self, hashes: np.ndarray, cols: np.ndarray, similarity: float) -> np.ndarray:
        """Whether the exact Jaccard similarity to each of some sets is ``similarity`` or more."""
        at = np.searchsorted(self.known, hashes)
        at = at[self.known[np.minimum(at, len(self.known) - 1)] == hashes]
        self.mark[at] = True
        sizes = self.sizes[cols]
        before = np.cumsum(sizes) - sizes
        hit = self.mark[self.codes[np.repeat(self.starts[cols] - before, sizes) + np.arange(sizes.sum())]]
        both = np.add.reduceat(hit, before, dtype=np.int64)
        self.mark[at] = False
        # A quotient of whole numbers, so that 4 of 5 is 0.8 and not a hair less.
        return both / (sizes + len(hashes) - both) >= similarity


def similar_within(home: tuple[np.ndarray, list[np.ndarray]], visits: Iterator[tuple[np.ndarray, list[np.ndarray]]], radius: int, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of a cell of (fingerprints, sets), as positions among those at home and then one
    batch of visitors: joined by them are all pairs that are within the radius and similar.

    No set is empty. Pairs that are joined already aren't compared, whatever their similarity.
    """
    points, own = home
    sets = Sets(own)
    joined = Joined(len(own))

    def link(queries: np.ndarray, hashes: list[np.ndarray], base: int, joined: Joined) -> None:
        sizes = np.array([len(x) for x in hashes])
        step = max(1, _BLOCK // (len(own) * points.shape[1]))
        for at in range(0, len(hashes), step):
            rows = np.arange(at, min(at + step, len(hashes)))
            near = distance(queries[rows][:, None, :], points[None, :, :]) <= radius
            near &= np.minimum(sizes[rows][:, None], sets.sizes) >= similarity * (1 - 1e-9) * np.maximum(sizes[rows][:, None], sets.sizes)
            if not base:
                near &= rows[:, None] > np.arange(len(own))[None, :]
            for row, cols in zip(rows.tolist(), map(np.flatnonzero, near), strict=True):
                # One of each group first: mostly that joins the rest of it.
                for one in (True, False):
                    roots = joined.roots(cols)
                    keep = roots != joined.roots(np.array([row + base]))[0]
                    cols, roots = cols[keep], roots[keep]
                    if not len(cols):
                        break
                    tried = cols[np.unique(roots, return_index=True)[1]] if one else cols
                    for col in tried[sets.similar(hashes[row], tried, similarity)].tolist():
                        joined.union(row + base, col)

    def moved(joined: Joined, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        roots = joined.roots(np.arange(len(before)))
        at = np.flatnonzero(roots != before)
        return at, roots[at]

    link(points, own, 0, joined)
    yield moved(joined, np.arange(len(own)))
    known = joined.roots(np.arange(len(own)))
    for queries, hashes in visits:
        both = Joined(len(own) + len(hashes))
        both.up[: len(own)] = known
        before = both.up.copy()
        link(queries, hashes, len(own), both)
        yield moved(both, before)


def _similar_edges(rows: DataFrame, shingle: int, radius: int, width: int, similarity: float) -> DataFrame:
    """Edges (a, b) between ids of similar texts of one shard. ``rows``: shard, cell, home, id,
    fp, text; as for fingerprints, who isn't at home in a cell visits it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {True: ([], [], []), False: ([], [], [])}
        waiting, found = 0, []

        def work() -> None:
            """Those at home among each other once, and the visitors that wait."""
            nonlocal held, waiting
            ids, points, sets = held[True]
            there, others = (held[False][0], (np.concatenate(held[False][1]), held[False][2])) if held[False][0] else ([], None)
            if sets:
                names = np.array(ids + there, dtype=np.int64)
                for a, b in similar_within((np.concatenate(points), sets), iter([others] if others else []), radius, similarity):
                    found.append((names[a], names[b]))
            held[False], waiting = ([], [], []), 0

        def emit() -> pa.RecordBatch:
            nonlocal found
            a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
            found = []
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            for part in slices(batch, 256):
                points = _unpack(part.column(4), width)
                for i, (shard, cell, home, name, text) in enumerate(zip(*(part.column(k).to_pylist() for k in range(4)), bytes_of(part.column(5)), strict=True)):
                    if (shard, cell) != at:
                        work()
                        at, held = (shard, cell), {True: ([], [], []), False: ([], [], [])}
                    hashes = np.unique(shingle_hashes(text or b"", shingle))
                    for column, x in zip(held[home], (name, points[i : i + 1], hashes), strict=True):
                        column.append(x)
                    waiting += 0 if home else len(hashes)
                    if waiting >= SETS:
                        work()
            yield emit()
        work()
        yield emit()

    dealt = rows.select("shard", "cell", "home", "id", "fp", "text").repartition("shard", "cell")
    return dealt.sortWithinPartitions("shard", "cell", F.desc("home"), "id").mapInArrow(frugal(run), "a long, b long")


def keep_one(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", cell: int = SETS) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the row with the least id.

    A group is linked by pairs whose sets of word shingles have a Jaccard similarity of
    ``similarity`` or more, counted exactly. Candidates are those that share one of eight least
    hashes and whose fingerprints of 1,024 bits are near: sets with the cosine c differ in
    arccos(c) / pi of the bits, 155 at similarity 0.8; sets of 4 and 5 shingles, the worst case
    there, in 192, as even counts round ties to 0. The radius lies six standard deviations above
    that. Groups of candidates are found first, then the texts of each meet once and are
    compared; ``cell`` is the number of shingles at home in one place of a large one.

    Rows with equal or null ids are told apart; texts without a word are one group; all columns
    are kept.
    """
    width, keys = 16, 8
    apart = max(float(np.arccos(2 * similarity / (1 + similarity)) / np.pi), 3 / 16)
    radius = int(64 * width * apart + 6 * (64 * width * apart * (1 - apart)) ** 0.5)
    rid = "_boxwood_row"
    rows = materialise(docs.withColumn(rid, F.monotonically_increasing_id()))
    fps = materialise(fingerprints(rows, shingle=shingle, width=width, keys=keys, distinct=True, id_col=rid, text_col=text_col))
    near = link_fingerprints(fps, radius=radius, width=width, keys=keys).select("fp", F.col("low").alias("shard"))
    # Equal sets are one; of those that have candidates the first one's text is read.
    sets = materialise(fps.join(near, "fp").groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("fp").alias("fp"), F.first("shard").alias("shard"), F.first("size").alias("size")))
    shards = sets.where("size > 0").groupBy("shard").agg(F.count("*").alias("n"), F.ceil(F.sum("size") / cell).cast("int").alias("cells")).where("n > 1").drop("n")
    dealt = sets.join(shards, "shard").withColumn("own", F.pmod(F.xxhash64("id"), F.col("cells")).cast("int")).withColumn("cell", F.explode(F.sequence("own", F.col("cells") - 1)))
    dealt = dealt.select("shard", "cell", (F.col("cell") == F.col("own")).alias("home"), "id", "fp")
    texts = rows.select(F.col(rid).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = connected_components(_similar_edges(dealt.join(texts, "id"), shingle, radius, width, similarity)).withColumnRenamed("node", "id")
    owners = sets.select("digest", "id").join(found, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    names = rows.select(F.col(rid).alias("doc_id"), F.col(id_col).alias("name"))
    groups = fps.select("doc_id", "digest").join(owners, "digest").join(names, "doc_id")
    kept = groups.groupBy("component").agg(F.min(F.struct(F.col("name").isNull().alias("none"), "name", "doc_id")).alias("least")).select(F.col("least.doc_id").alias(rid))
    return rows.join(kept, rid, "left_semi").drop(rid)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles over all documents, linked at 3 or fewer bits."""
    return near_duplicates(table(spark, sf_dir, "documents"))

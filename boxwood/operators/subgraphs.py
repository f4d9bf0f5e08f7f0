"""Frequent connected subgraphs of labelled directed graphs, grown edge by edge.

An embedding is a set of edges of one graph. It grows by an edge at one of its vertices, where the
graph lies; embeddings of a pattern that too few graphs hold don't grow. Each round grows them anew
from the graphs and hands on counts of codes alone, so no embedding is ever written or shuffled. A
pattern is named by a canonical code, the least over the orders of its few vertices, worked out once
for each shape that a worker meets.

Branches that look alike and hang at one vertex are twins. A pattern of n edges meets at most n of
them, so the others are left out, and an embedding meets a later twin only after the one before it:
every pattern that a graph holds keeps such an embedding, and so does every step by which one
pattern grows from another, as twins can be exchanged. A vertex with hundreds of equal branches
then has a handful of embeddings in place of all choices among them.
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict, deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations, product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..partitions import deal
from ..storage import materialise

Shape = tuple[tuple[str, ...], tuple[tuple[int, int, str], ...]]


@lru_cache(maxsize=1 << 16)
def canonical(shape: Shape) -> str:
    """The code of a pattern: labels and edges under the vertex order that makes them least.

    Vertices are first told apart by label and degrees, so that only alike ones are permuted.
    """
    labels, edges = shape
    kind = [(labels[v], sum(a == v for a, _, _ in edges), sum(b == v for _, b, _ in edges)) for v in range(len(labels))]
    groups = [[v for v in range(len(labels)) if kind[v] == k] for k in sorted(set(kind))]
    best = None
    for parts in product(*(permutations(g) for g in groups)):
        place = {v: i for i, v in enumerate(v for g in parts for v in g)}
        found = sorted((place[a], place[b], x) for a, b, x in edges)
        if best is None or found < best:
            best = found
    names = [labels[v] for g in groups for v in g]
    return f"{' | '.join(names)} ; {' , '.join(f'{a}-{x}->{b}' for a, b, x in best)}"


def shape_of(edges: list[dict]) -> Shape:
    """Vertices numbered as edges, sorted, mention them."""
    order: dict = {}
    labels: list[str] = []
    for e in sorted(edges, key=lambda e: (e["sl"], e["by"], e["dl"], e["src"], e["dst"])):
        for v, label in ((e["src"], e["sl"]), (e["dst"], e["dl"])):
            if v not in order:
                order[v] = len(order)
                labels.append(label)
    return tuple(labels), tuple(sorted((order[e["src"]], order[e["dst"]], e["by"]) for e in edges))


def twins(edges: list[tuple[int, int, str, str, str]], most: int) -> list[tuple[int, list[int], list[int]]]:
    """(edge, needs, inside) for the edges (from, to, label, label of from, label of to) of a graph,
    without loops, that are kept: all but those of twins beyond the first ``most`` of their kind.

    inside: the twins that hold the edge, one in another, each named by its nearest vertex. needs:
    the twins before these. Branches are told by stripping vertices with one neighbour.
    """
    bundle: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
    label: dict[int, str] = {}
    for a, b, by, la, lb in edges:
        label[a], label[b] = la, lb
        bundle[a][b].append((0, by))
        bundle[b][a].append((1, by))
    left = {v: len(own) for v, own in bundle.items()}
    above: dict[int, int] = {}
    kinds: dict[tuple, int] = {}
    hung: dict[int, list[tuple[int, int]]] = defaultdict(list)
    order: list[int] = []
    todo = deque(v for v in sorted(left) if left[v] == 1)  # in rounds, so that a tree ends at its middle
    while todo:
        v = todo.popleft()
        if left[v] != 1:  # the last of a tree
            continue
        w = next(w for w in bundle[v] if w not in above)
        # Twins that are left out don't tell branches apart.
        below = tuple((k, min(n, most)) for k, n in sorted(Counter(k for k, _ in hung[v]).items()))
        kind = (label[v], tuple(sorted(bundle[v][w])), below)
        hung[w].append((kinds.setdefault(kind, len(kinds)), v))
        above[v] = w
        order.append(v)
        left[v] = 0
        left[w] -= 1
        if left[w] == 1:
            todo.append(w)
    before: dict[int, int] = {}
    told: set[int] = set()
    gone: set[int] = set()
    for own in hung.values():
        sizes, last = Counter(k for k, _ in own), {}
        for at, (kind, v) in enumerate(sorted(own)):
            if sizes[kind] > 1:
                told.add(v)
                n, prior = last.get(kind, (0, None))
                if n >= most:
                    gone.add(v)
                elif prior is not None:
                    before[v] = prior
                last[kind] = (n + 1, v)
    inside: dict[int, list[int]] = {}
    for v in reversed(order):  # what a branch hangs at comes before it
        w = above[v]
        if w in gone:
            gone.add(v)
        inside[v] = inside.get(w, []) + ([v] if v in told else [])
    out = []
    for i, (a, b, *_) in enumerate(edges):
        v = a if above.get(a) == b else b if above.get(b) == a else None
        if v is None:
            out.append((i, [], []))
        elif v not in gone:
            out.append((i, [before[x] for x in inside[v] if x in before], inside[v]))
    return out


def _numbered(step: DataFrame, most: int) -> DataFrame:
    """A row for each graph: its edges with numbers for vertices, and their twins, as JSON. One task
    holds a graph's edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                place: dict = {}
                own = [(place.setdefault(e["src"], len(place)), place.setdefault(e["dst"], len(place)), e["by"], e["sl"], e["dl"]) for e in batch.column(0)[i].as_py()]
                rows.append(json.dumps([(*own[k][:2], own[k][3], own[k][2], own[k][4], needs, inside) for k, needs, inside in twins(own, most)]))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["edges"])

    whole = step.groupBy("graph").agg(F.array_sort(F.collect_list(F.struct("src", "dst", "by", "sl", "dl"))).alias("es")).select("es")
    return whole.mapInArrow(run, "edges string")


def grown(edges: list, frequent: list[set[str]], most_vertices: int) -> set[tuple[str | None, str, int]]:
    """(parent's code, code, vertices) of a graph's embeddings of one edge more than ``frequent`` has
    levels, grown from those whose code is frequent at each level before; the parent is None for one
    edge. edges: (from, to, label of from, label, label of to, needs, inside), as ``_numbered`` has them."""
    near: dict[int, list[int]] = defaultdict(list)
    for i, (a, b, *_) in enumerate(edges):
        near[a].append(i)
        near[b].append(i)

    def code(eids: tuple[int, ...]) -> str:
        order: dict[int, int] = {}
        labels: list[str] = []
        own = sorted([(edges[i][2], edges[i][3], edges[i][4], edges[i][0], edges[i][1]) for i in eids])
        for sl, _, dl, a, b in own:
            for v, label in ((a, sl), (b, dl)):
                if v not in order:
                    order[v] = len(order)
                    labels.append(label)
        return canonical((tuple(labels), tuple(sorted([(order[a], order[b], by) for _, by, _, a, b in own]))))

    level = {(i,): (frozenset(e[:2]), frozenset(e[6])) for i, e in enumerate(edges) if not e[5]}
    found: set[tuple[str | None, str, int]] = set()
    if not frequent:
        return {(None, code(eids), len(verts)) for eids, (verts, _) in level.items()}
    for k, kept in enumerate(frequent):
        more: dict[tuple[int, ...], tuple[frozenset[int], frozenset[int]]] = {}
        codes: dict[tuple[int, ...], str] = {}
        for eids, (verts, met) in level.items():
            if (parent := code(eids)) not in kept:
                continue
            for i in sorted({i for v in verts for i in near[v]}.difference(eids)):
                a, b, *_, needs, inside = edges[i]
                wider = verts if a in verts and b in verts else verts | {a, b}
                if len(wider) > most_vertices or not (met.issuperset(needs) or met.union(inside).issuperset(needs)):
                    continue
                key = tuple(sorted((*eids, i)))
                if k + 1 < len(frequent):
                    if key not in more:
                        more[key] = wider, met.union(inside)
                else:  # an edge set is reached from each of its connected parts: all its parents count
                    if key not in codes:
                        codes[key] = code(key)
                    found.add((parent, codes[key], len(wider)))
        level = more
    return found


#: Codes that a task counts before it hands on what it has.
MOST_CODES = 50_000


def _counted(graphs: DataFrame, frequent: list[set[str]], most_vertices: int) -> DataFrame:
    """(parent, code, vertices, n): n graphs hold the code where the parent is null; other rows say
    that the code grew from the parent. Counts of one code may come in several rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def told() -> pa.RecordBatch:
            rows = [(*k, n) for k, n in counts.items()]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.int64()))], names=["parent", "code", "vertices", "n"])

        for batch in batches:
            for i in range(batch.num_rows):
                found = grown(json.loads(batch.column(0)[i].as_py()), frequent, most_vertices)
                counts.update({(None, code, n) for _, code, n in found})
                counts.update({x for x in found if x[0] is not None})
                if len(counts) >= MOST_CODES:
                    yield told()
        if counts:
            yield told()

    return graphs.mapInArrow(run, "parent string, code string, vertices int, n long").groupBy("parent", "code", "vertices").agg(F.sum("n").alias("n"))


def frequent_subgraphs(vertices: DataFrame, edges: DataFrame, least: int, *, most_edges: int = 3, most_vertices: int = 6) -> tuple[DataFrame, DataFrame]:
    """Patterns (code, edges, vertices, support) that at least ``least`` graphs hold, and
    (parent, code) pairs of patterns of which the second grew from the first.

    vertices: graph, id, label; edges: graph, src, dst, label. Repeated edges count once, loops
    are left out; a graph holds a pattern if one of its subgraphs is that pattern (vertices are
    told apart). Codes of frequent patterns go to the driver and to all executors.
    """
    v = vertices.select("graph", "id", "label").distinct()
    step = edges.where("src <> dst").select("graph", "src", "dst", F.col("label").alias("by")).distinct()
    step = step.join(v.select("graph", F.col("id").alias("src"), F.col("label").alias("sl")), ["graph", "src"]).join(v.select("graph", F.col("id").alias("dst"), F.col("label").alias("dl")), ["graph", "dst"])
    graphs = materialise(_numbered(step, most_edges))
    frequent: list[set[str]] = []
    patterns = pairs = None
    for n in range(1, most_edges + 1):
        counted = materialise(_counted(deal(graphs), frequent, most_vertices))
        support = counted.where("parent IS NULL").select("code", F.lit(n).alias("edges"), "vertices", F.col("n").alias("support")).where(F.col("support") >= least)
        patterns = support if patterns is None else patterns.unionByName(support)
        if n > 1:
            own = counted.where("parent IS NOT NULL").select("parent", "code").join(support.select("code"), "code", "left_semi").select("parent", "code")
            pairs = own if pairs is None else pairs.unionByName(own)
        frequent.append({r["code"] for r in support.select("code").collect()})
        if not frequent[-1]:
            break
    empty = patterns.select(F.col("code").alias("parent"), "code").where("1 = 0")
    return patterns, pairs.distinct() if pairs is not None else empty


def closed_subgraphs(patterns: DataFrame, grown: DataFrame) -> DataFrame:
    """Patterns without a pattern that grew from them and has the same support, which is to say
    the same graphs."""
    above = grown.join(patterns.select("code", F.col("support").alias("above")), "code").groupBy(F.col("parent").alias("code")).agg(F.max("above").alias("above"))
    return patterns.join(above, "code", "left").where("above IS NULL OR above < support").select("code", "edges", "vertices", "support")

"""Patterns and the changes that hold them, clusters of like trees, universes and left-out positives."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..partitions import deal
from ..storage import materialise
from . import changes, graphs

#: Patterns that are held against every graph at once; they go to the executors.
MOST_PATTERNS = 1_000
#: Parts that the trees of one size are dealt to.
PARTS = 16
Pattern = tuple[str, list[tuple[int, str]], list[tuple[int, int, str]]]


def hosts_of(scripts: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """(pattern, doc_id, constraint, exact): of every change and pattern whether some action meets
    the pattern's constraints, and whether the change graph holds the pattern (vertices told apart);
    pairs with neither are left out. scripts: doc_id, actions as JSON."""
    if len(patterns) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns")
    wanted = [(name, changes.constraints(v), (v, e)) for name, v, e in patterns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                actions = json.loads(body)
                graph = changes.change_graph(actions)
                for name, (acts, kinds), pattern in wanted:
                    met, held = bool(changes.satisfies(actions, acts, kinds)), changes.contains(graph, pattern)
                    if met or held:
                        rows.append((name, doc, met, held))
            types = [pa.string(), pa.int64(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["pattern", "doc_id", "constraint", "exact"])

    return deal(scripts.select("doc_id", "actions")).mapInArrow(run, "pattern string, doc_id long, constraint boolean, exact boolean")


def retrieval_quality(found: DataFrame, group: str, retrieved: str, truth: str) -> DataFrame:
    """(group, retrieved, relevant, both, precision, recall); 0 where there is nothing to divide by."""
    by = found.groupBy(group).agg(F.count_if(F.col(retrieved)).alias("retrieved"), F.count_if(F.col(truth)).alias("relevant"), F.count_if(F.col(retrieved) & F.col(truth)).alias("both"))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), 6)
    return by.select(group, "retrieved", "relevant", "both", share("both", "retrieved").alias("precision"), share("both", "relevant").alias("recall"))


def nested(subtree: list) -> tuple:
    """A subtree's rows (place, parent, kind, label), parents first, as a tree of kinds."""
    kids: dict[int, list[int]] = {}
    for i, above, *_ in subtree[1:]:
        kids.setdefault(above, []).append(i)
    made: dict[int, tuple] = {}
    for i, _, kind, _ in reversed(subtree):
        made[i] = (kind, tuple(made[k] for k in kids.get(i, ())))
    return made[subtree[0][0]]


def tree_of(text: str) -> tuple:
    """A tree from nested lists: [label, [children]]."""
    build = lambda x: (x[0], tuple(map(build, x[1])))
    return build(json.loads(text))


@lru_cache(maxsize=1 << 14)
def _read(text: str) -> tuple:
    tree = tree_of(text)
    return tree, changes.size_of(tree), changes.label_profile(tree)


def tree_clusters(trees: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(tree, cluster, support): distinct trees (JSON of nested lists) linked by a similarity of
    ``threshold`` or more in proportion to the larger one; the cluster is its least tree.

    Only trees whose sizes allow it meet (an equi-join on size, each tree going to all sizes within
    the threshold of its own), and of those whose labels allow it the distance is worked out.
    """
    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [changes.size_of(tree_of(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64())], names=["tree", "support", "size"])

    own = materialise(trees.groupBy("tree").agg(F.count("*").alias("support")).mapInArrow(sized, "tree string, support long, size long"))
    reach = own.select(F.col("tree").alias("a"), F.col("size").alias("own"), F.explode(F.sequence(F.ceil(F.col("size") * threshold), F.col("size"))).alias("size"))
    # Few sizes hold most trees, so the smaller side of each size is dealt to parts and the larger goes to all.
    reach = reach.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    dealt = own.select(F.col("tree").alias("b"), "size", F.pmod(F.hash("tree"), F.lit(PARTS)).alias("part"))
    pairs = reach.join(dealt, ["size", "part"]).where("own > size OR a < b").select("a", "b")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (x, nx, px), (y, ny, py) = _read(a), _read(b)
                possible = 1 - changes.least_distance(px, py) / max(nx, ny) >= threshold
                keep.append(possible and changes.larger_similarity(x, y) >= threshold)
            yield batch.filter(pa.array(keep, pa.bool_()))

    found = graphs.components(pairs.mapInArrow(alike, "a string, b string")).withColumnRenamed("node", "tree")
    return own.join(found, "tree", "left").select("tree", F.coalesce("component", "tree").alias("cluster"), "support")


def language_universe(samples: DataFrame, group: str, most: float = 0.9) -> DataFrame:
    """The samples that each group is judged on: all of them, but where its positives are in one
    language to ``most`` or more, only negatives in that language. samples: group, id, lang,
    positive."""
    counts = samples.where("positive").groupBy(group, "lang").agg(F.count("*").alias("n"))
    by = counts.groupBy(group).agg(F.sum("n").alias("all"), F.max(F.struct("n", "lang")).alias("top"))
    own = by.select(group, F.when(F.col("top.n") / F.col("all") >= most, F.col("top.lang")).alias("_only"))
    return samples.join(own, group, "left").where(F.col("positive") | F.col("_only").isNull() | (F.col("lang") == F.col("_only"))).drop("_only")


def leave_one_out(features: DataFrame, truth: DataFrame, *, least: int = 2, precision: float = 0.5) -> DataFrame:
    """(sample, recalled): whether each positive sample is still found by the atoms that all other
    samples vouch for: ``least`` other positives or more, with that precision. No loop: a sample's
    own vote is taken off its atoms' counts. features: sample, atom (distinct); truth: sample, positive."""
    both = features.join(truth, "sample")
    counts = both.groupBy("atom").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n"))
    p = F.col("p") - 1
    good = (p >= least) & (F.coalesce(F.try_divide(p, p + F.col("n")), F.lit(0.0)) >= precision)
    own = both.where("positive").join(counts, "atom").groupBy("sample").agg(F.max(good).alias("recalled"))
    return truth.where("positive").select("sample").join(own, "sample", "left").select("sample", F.coalesce("recalled", F.lit(False)).alias("recalled"))

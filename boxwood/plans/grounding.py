"""Splits, partitions, density sweeps, hierarchies and names over the embeddings of each label."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clustering, grounding, vectors
from ..registry import query, table
from .vectors import _U, _per_label, _unpack


def _rows(label: int, rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.table({"label": pa.array([label] * len(rows), pa.int32())} | {n: pa.array(c, t) for n, c, t in zip(names, columns, types, strict=True)})


@query("recursive_splits")
def recursive_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label split again and again, as long as a split passes the gates."""

    def run(t: pa.Table) -> pa.Table:
        label, _, x = _unpack(t)
        found = [(a, b, d, n, round(s, 6)) for a, b, d, n, s in grounding.split_tree(x, [0.5, 0.6, 0.7, 0.8, 0.9], gates=grounding.Gates(repeats=3, stability=0.2, silhouette=0.02, coverage=0.4))]
        return _rows(label, found, ["node", "parent", "depth", "members", "score"], [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64()])

    return _per_label(spark, sf_dir, run, "label int, node string, parent string, depth long, members long, score double")


@query("partition_sweep")
def partition_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions of each label into two or three groups over many thresholds, scored."""

    def run(t: pa.Table) -> pa.Table:
        label, _, x = _unpack(t)
        found = [(a, k, round(b, 6), round(s, 6), round(c, 6), round(d, 6), e, round(f, 6)) for a, k, b, s, c, d, e, f in grounding.partitions(x, lowest=0.5, highest=1.0, step=0.02, repeats=3)]
        return _rows(label, found, ["threshold", "groups", "core", "silhouette", "stability", "balance", "accepted", "score"], [pa.float64(), pa.int64(), *[pa.float64()] * 4, pa.bool_(), pa.float64()])

    return _per_label(spark, sf_dir, run, "label int, threshold double, groups long, core double, silhouette double, stability double, balance double, accepted boolean, score double")


@query("density_sweep")
def density_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density clusterings of each label over a grid of parameters, scored."""

    def run(t: pa.Table) -> pa.Table:
        label, _, x = _unpack(t)
        found = [(a, b, k, round(c, 6), round(s, 6), round(v, 6)) for a, b, k, c, s, v in grounding.density_sweep(x)]
        return _rows(label, found, ["least", "neighbours", "clusters", "coverage", "silhouette", "score"], [pa.int64()] * 3 + [pa.float64()] * 3)

    return _per_label(spark, sf_dir, run, "label int, least long, neighbours long, clusters long, coverage double, silhouette double, score double")


@query("gap_clusters")
def gap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups among each label's members that fit it worst, named by their medoids."""

    def run(t: pa.Table) -> pa.Table:
        label, ids, x = _unpack(t)
        u = clustering.unit_rows(x)
        fit = u @ grounding.trimmed_centroid(x)
        gap = fit <= np.quantile(fit, 0.25)
        found = [(int(m), n) for m, n in grounding.gap_clusters(x[gap], ids[gap].tolist(), 0.8)]
        return _rows(label, found, ["medoid", "members"], [pa.int64(), pa.int64()])

    return _per_label(spark, sf_dir, run, "label int, medoid long, members long")


@query("category_hierarchy")
def category_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary and secondary parents of each label's clusters."""

    def run(t: pa.Table) -> pa.Table:
        label, _, x = _unpack(t)
        own = clustering.average_linkage(x, 0.5)
        centers = np.stack([x[own == k].mean(axis=0) for k in range(own.max() + 1)])
        found = [(c, p, round(f, 6), k) for c, p, f, k in grounding.hierarchy_with_secondary(centers, 0.7)]
        return _rows(label, found, ["child", "parent", "fit", "kind"], [pa.int64(), pa.int64(), pa.float64(), pa.string()])

    return _per_label(spark, sf_dir, run, "label int, child long, parent long, fit double, kind string")


@query("bootstrap_alignment")
def bootstrap_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(t: pa.Table) -> pa.Table:
        label, _, x = _unpack(t)
        return _rows(label, [tuple(round(v, 6) for v in grounding.bootstrap_alignment(clustering.unit_rows(x), share=0.8))], ["mean", "p10"], [pa.float64()] * 2)

    return _per_label(spark, sf_dir, run, "label int, mean double, p10 double")


@query(
    "name_scores",
    _U
    + """, nm AS (SELECT label, arg_min(v, vec_id) AS v FROM u GROUP BY label), g AS (SELECT u.vec_id, u.label AS own, nm.label AS name, round(list_dot_product(u.v, nm.v), 9) AS fit FROM u, nm),
    j AS (SELECT own, vec_id, max(fit) FILTER (WHERE name = own) AS fit, max(fit) FILTER (WHERE name <> own) AS next FROM g GROUP BY own, vec_id),
    a AS (SELECT c.label, round(list_dot_product(nm.v, c.c), 9) AS alignment FROM c JOIN nm ON nm.label = c.label)
    SELECT j.own AS "group", count(*) AS support, round(max(a.alignment), 6) AS alignment, round(avg(fit), 6) AS mean_fit, round(min(fit), 6) AS least_fit, round(0.5 * avg(fit) + 0.5 * max(a.alignment), 6) AS blend,
    round(avg(CASE WHEN fit >= next THEN 1.0 ELSE 0.0 END), 6) AS votes, round(avg(fit - next), 6) AS mean_margin, round(min(fit - next), 6) AS least_margin FROM j JOIN a ON a.label = j.own GROUP BY j.own""",
)
def name_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the first vector of each label would do as its name."""
    rows = vectors.units(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").select(F.col("label").alias("group"), F.col("vec_id").alias("id"), "v")
    names = rows.groupBy("group").agg(F.min_by("v", "id").alias("v"))
    found = grounding.score_names(rows, names)
    return found.select("group", "support", *(F.round(c, 6).alias(c) for c in ("alignment", "mean_fit", "least_fit", "blend", "votes", "mean_margin", "least_margin")))


@query("expansion_rounds")
def expansion_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What joins each label in three rounds, from seeds that are a third of it."""
    rows = vectors.units(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").select(F.col("label").alias("group"), F.col("vec_id").alias("id"), "v")
    return grounding.expand_rounds(rows.where("id % 3 = 0"), rows.where("id % 3 <> 0").drop("group"))


@query("recall_at_three", _U + ", k AS (SELECT vec_id, own, label, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS place FROM f) SELECT own AS label, count(*) AS members, round(count(*) FILTER (WHERE place <= 3) / count(*), 6) AS recall_at_3, round(count(*) FILTER (WHERE place = 1) / count(*), 6) AS recall_at_1 FROM k WHERE own = label GROUP BY own")
def recall_at_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a vector's own label is the nearest, or among the three nearest."""
    rows = vectors.units(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    near = vectors.nearest(rows, "vec_id", vectors.centroids(rows, "label"), "label", 3).select("vec_id", F.col("label").alias("near"), "place")
    hits = near.join(rows.select("vec_id", "label"), "vec_id").where("near = label").select("vec_id", "place")
    share = lambda k: F.round(F.count_if(F.coalesce(F.col("place") <= k, F.lit(False))) / F.count("*"), 6)
    return rows.select("vec_id", "label").join(hits, "vec_id", "left").groupBy("label").agg(F.count("*").alias("members"), share(3).alias("recall_at_3"), share(1).alias("recall_at_1"))

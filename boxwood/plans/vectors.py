"""Vector queries over embeddings: centroids, votes, medoids, membership, clustering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clustering, vectors
from ..registry import query, table

_U = """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e),
p AS (SELECT label, unnest(generate_series(1, 64)) AS i, unnest(v) AS x FROM u), s AS (SELECT label, i, sum(x) AS x FROM p GROUP BY label, i), r AS (SELECT label, list(x ORDER BY i) AS c FROM s GROUP BY label),
c AS (SELECT label, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS c FROM r), f AS (SELECT u.vec_id, u.label AS own, c.label AS label, round(list_dot_product(u.v, c.c), 9) AS s FROM u, c)
"""


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = vectors.units(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return rows, vectors.centroids(rows, "label")


@query("cosine_knn", _U + "SELECT vec_id, label, round(s, 6) AS similarity, CAST(place AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS place FROM f) t WHERE place <= 3")
def cosine_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centers = _parts(spark, sf_dir)
    return vectors.nearest(rows, "vec_id", centers, "label", 3).withColumn("similarity", F.round("similarity", 6))


@query(
    "centroid_votes",
    _U
    + """, b AS (SELECT vec_id, own, max(s) FILTER (WHERE label = own) AS fit, max(s) FILTER (WHERE label <> own) AS rival, arg_max(label, s) AS best FROM f GROUP BY vec_id, own)
    SELECT own AS label, count(*) AS members, count(*) FILTER (WHERE best = own) AS votes, round(avg(fit), 6) AS mean_fit, round(avg(fit - rival), 6) AS mean_margin FROM b GROUP BY own""",
)
def centroid_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well members fit their own label's centroid against the nearest other label."""
    rows, centers = _parts(spark, sf_dir)
    ranked = vectors.nearest(rows, "vec_id", centers, "label", vectors.SMALL).join(rows.select("vec_id", F.col("label").alias("own")), "vec_id")
    by = ranked.groupBy("vec_id", "own").agg(F.max(F.when(F.col("label") == F.col("own"), F.col("similarity"))).alias("fit"), F.max(F.when(F.col("label") != F.col("own"), F.col("similarity"))).alias("rival"), F.min_by("label", "place").alias("best"))
    return by.groupBy(F.col("own").alias("label")).agg(F.count("*").alias("members"), F.count_if(F.col("best") == F.col("own")).alias("votes"), F.round(F.avg("fit"), 6).alias("mean_fit"), F.round(F.avg(F.col("fit") - F.col("rival")), 6).alias("mean_margin"))


@query("medoids", _U + "SELECT own AS label, vec_id AS medoid, round(s, 6) AS fit FROM (SELECT *, row_number() OVER (PARTITION BY own ORDER BY s DESC, vec_id) AS r FROM f WHERE own = label) t WHERE r = 1")
def medoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centers = _parts(spark, sf_dir)
    return vectors.medoids(rows, "vec_id", "label", centers)


@query(
    "cluster_cohesion",
    _U
    + """, q AS (SELECT label, sum(x * x) AS q FROM s GROUP BY label), g AS (SELECT own AS label, count(*) AS support, avg(s) AS mean_fit, min(s) AS low_fit, quantile_cont(s, 0.05) AS floor FROM f WHERE own = label GROUP BY own)
    SELECT g.label, support, round((q.q - support) / (support * (support - 1)), 6) AS mean_pair, round(mean_fit, 6) AS mean_fit, round(low_fit, 6) AS low_fit FROM g JOIN q ON q.label = g.label""",
)
def cluster_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centers = _parts(spark, sf_dir)
    found = vectors.cohesion(rows, "label", centers.drop("n"))
    return found.select("label", "support", F.round("mean_pair", 6).alias("mean_pair"), F.round("mean_fit", 6).alias("mean_fit"), F.round("low_fit", 6).alias("low_fit"))


@query(
    "soft_membership",
    _U
    + """, k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS place, max(s) OVER (PARTITION BY vec_id) AS best FROM f)
    SELECT vec_id, label, round(s, 6) AS similarity, CAST(place AS BIGINT) AS place FROM k WHERE s >= best - 0.03 AND s >= 0.1 AND place <= 2""",
)
def soft_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centers = _parts(spark, sf_dir)
    ranked = vectors.nearest(rows, "vec_id", centers, "label", 3)
    return vectors.soft_membership(ranked, "vec_id", "label", 0.03, 0.1, 2).withColumn("similarity", F.round("similarity", 6))


@query(
    "expansion_audit",
    _U
    + """, floors AS (SELECT own AS label, quantile_cont(s, 0.05) AS floor FROM f WHERE own = label GROUP BY own)
    SELECT f.label, count(*) AS candidates, count(*) FILTER (WHERE f.s >= floors.floor) AS expand FROM f JOIN floors ON floors.label = f.label WHERE f.own <> f.label GROUP BY f.label""",
)
def expansion_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of other labels that reach the fifth percentile of a label's own members."""
    rows, centers = _parts(spark, sf_dir)
    ranked = vectors.nearest(rows, "vec_id", centers, "label", vectors.SMALL).join(rows.select("vec_id", F.col("label").alias("own")), "vec_id")
    floors = ranked.where("own = label").groupBy("label").agg(F.percentile("similarity", F.lit(0.05)).alias("floor"))
    return ranked.where("own <> label").join(vectors.small(floors), "label").groupBy("label").agg(F.count("*").alias("candidates"), F.count_if(F.col("similarity") >= F.col("floor")).alias("expand"))


def _per_label(spark: SparkSession, sf_dir: str, f, schema: str) -> DataFrame:
    """Run a function on all vectors of every label: one task holds a label's, and clustering
    bounds the distances that it holds."""
    rows = vectors.units(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return rows.groupBy("label").applyInArrow(f, schema)


def _unpack(t: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    order = np.argsort(t.column("vec_id").to_numpy())
    v = t.column("v").combine_chunks()
    x = v.flatten().to_numpy().reshape(len(v), -1)[order]
    return t.column("label")[0].as_py(), t.column("vec_id").to_numpy()[order], x


@query("agglomerative")
def agglomerative(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(t: pa.Table) -> pa.Table:
        label, ids, x = _unpack(t)
        return pa.table({"label": pa.array([label] * len(ids), pa.int32()), "vec_id": ids, "cluster": clustering.average_linkage(x, 0.35).astype(np.int64)})

    return _per_label(spark, sf_dir, run, "label int, vec_id long, cluster long")


@query("threshold_sweep")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(t: pa.Table) -> pa.Table:
        label, _, x = _unpack(t)
        found = clustering.sweep(x, [0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5])
        return pa.table({"label": pa.array([label] * len(found), pa.int32()), "threshold": [f[0] for f in found], "clusters": [f[1] for f in found], "silhouette": [round(f[2], 6) for f in found]})

    return _per_label(spark, sf_dir, run, "label int, threshold double, clusters long, silhouette double")


@query("cluster_hierarchy")
def cluster_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(t: pa.Table) -> pa.Table:
        label, ids, x = _unpack(t)
        rows = [(label, int(i), k, int(c)) for k, level in enumerate(clustering.hierarchy(x, 0.6)) for i, c in zip(ids, level, strict=True)]
        cols = list(zip(*rows, strict=True))
        return pa.table({"label": pa.array(cols[0], pa.int32()), "vec_id": pa.array(cols[1]), "level": pa.array(cols[2], pa.int32()), "cluster": pa.array(cols[3])})

    return _per_label(spark, sf_dir, run, "label int, vec_id long, level int, cluster long")


@query("split_stability")
def split_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(t: pa.Table) -> pa.Table:
        label, _, x = _unpack(t)
        return pa.table({"label": pa.array([label], pa.int32()), "stability": [round(clustering.split_stability(x, 0.6, repeats=4), 6)], "bootstrap_p10": [round(clustering.bootstrap_p10(x @ x.mean(axis=0)), 6)]})

    return _per_label(spark, sf_dir, run, "label int, stability double, bootstrap_p10 double")


@query("density_clusters")
def density_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(t: pa.Table) -> pa.Table:
        label, ids, x = _unpack(t)
        return pa.table({"label": pa.array([label] * len(ids), pa.int32()), "vec_id": ids, "cluster": clustering.density_clusters(x).astype(np.int64)})

    return _per_label(spark, sf_dir, run, "label int, vec_id long, cluster long")


@query("topic_factors")
def topic_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft topics of sources: non-negative factors of their term weights, share 0.2 or more.

    The matrix has a row for each source and a column for each term that two sources have, held
    by its entries: 24 bytes for each (source, term), and the terms' names."""
    from ..functions import text
    from ..operators import lines

    docs = table(spark, sf_dir, "documents")
    words = docs.select("source", F.explode(text.split_words(F.col("text"))).alias("term"))
    weights = lines.tf_idf(words, "source", "term", docs.select("source").distinct(), min_df=2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        found = pa.Table.from_batches(held)
        names, rows = _ranked(found.column("source"))
        terms, cols = _ranked(found.column("term"))
        w, _ = clustering.sparse_nmf(rows, cols, found.column("weight").to_numpy(), (len(names), len(terms)), min(4, len(names)))
        share = w / np.maximum(w.sum(axis=1, keepdims=True), 1e-12)
        hits = [(names[i], int(k), round(float(share[i, k]), 6)) for i in range(len(names)) for k in range(share.shape[1]) if share[i, k] >= 0.2]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*hits, strict=True), [pa.string(), pa.int64(), pa.float64()], strict=True)], names=["source", "topic", "share"])

    # One task factors the entries; what they are counted from stays distributed. In order, so that sums are the same on each run.
    return weights.select("source", "term", "weight").repartition(1).sortWithinPartitions("source", "term").mapInArrow(run, "source string, topic long, share double")


def _ranked(column: pa.ChunkedArray) -> tuple[list[str | None], np.ndarray]:
    """The distinct values of a column in order, and each row's place among them."""
    coded = column.combine_chunks().dictionary_encode()
    values = coded.dictionary.to_pylist()
    order = sorted(range(len(values)), key=values.__getitem__)
    place = np.empty(len(values), dtype=np.int64)
    place[order] = np.arange(len(values))
    return [values[i] for i in order], place[coded.indices.to_numpy()]

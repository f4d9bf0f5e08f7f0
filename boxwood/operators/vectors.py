"""Vectors: cosines, nearest rows of a small table, centroids, votes, medoids, membership.

The searched side is a table of centroids or labels, checked to be small before it is broadcast;
vectors of one corpus are never paired with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise

#: Rows of a searched side that may be broadcast.
SMALL = 10_000


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(v: str) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm))


def units(rows: DataFrame, key: str, vec: str) -> DataFrame:
    """(key, v) of unit length; zero and null vectors are left out."""
    return rows.select(key, unit(vec).alias("v"), *[c for c in rows.columns if c not in (key, vec)]).where("v IS NOT NULL")


def centroids(rows: DataFrame, label: str) -> DataFrame:
    """(label, c, n): unit centroid of each label's unit vectors, added up component by component
    before the shuffle."""
    parts = rows.select(label, F.posexplode("v").alias("i", "x")).groupBy(label, "i").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    whole = parts.groupBy(label).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    return whole.select(label, unit("c").alias("c"), "n")


def small(table: DataFrame, most: int = SMALL) -> DataFrame:
    """The table with a broadcast hint if it is as small as it must be, else without."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def nearest(rows: DataFrame, key: str, targets: DataFrame, label: str, k: int) -> DataFrame:
    """(key, label, similarity, place): the k most similar targets of each row, ties to the lesser
    label. Few targets are held in one array, so there is no shuffle; more of them go out in blocks
    of about ``SMALL``, one after the other, and each row's best of all blocks are put together."""
    n = targets.count()
    blocks = 1 if n <= SMALL else -(-2 * n // SMALL)  # half full on average, so that none is much above
    dealt = materialise(targets.withColumn("_block", F.pmod(F.xxhash64(label), F.lit(blocks)))) if blocks > 1 else targets
    scored = F.transform("_t", lambda t: F.struct((-F.round(dot(F.col("v"), t["c"]), 9)).alias("s"), t[label].alias("l")))
    best = None
    for b in range(blocks):
        own = dealt.where(F.col("_block") == b) if blocks > 1 else dealt
        every = own.agg(F.collect_list(F.struct(F.col(label), F.col("c"))).alias("_t"))
        tops = rows.join(F.broadcast(every)).select(key, F.slice(F.array_sort(scored), 1, k).alias("_top"))
        best = tops if best is None else best.unionByName(tops)
    if blocks > 1:
        best = best.groupBy(key).agg(F.slice(F.array_sort(F.flatten(F.collect_list("_top"))), 1, k).alias("_top"))
    top = best.select(key, F.posexplode("_top").alias("p", "t"))
    return top.select(key, F.col("t.l").alias(label), (-F.col("t.s")).alias("similarity"), (F.col("p") + 1).cast("long").alias("place"))


def cohesion(rows: DataFrame, label: str, centers: DataFrame) -> DataFrame:
    """(label, support, mean pairwise cosine, mean and least similarity to the centroid).

    The mean over pairs follows from the length of the sum, without pairing vectors.
    """
    fit = rows.join(small(centers), label).withColumn("fit", dot("v", "c"))
    stats = fit.groupBy(label).agg(F.count("*").alias("support"), F.avg("fit").alias("mean_fit"), F.min("fit").alias("low_fit"))
    parts = rows.select(label, F.posexplode("v").alias("i", "x")).groupBy(label, "i").agg(F.sum("x").alias("x")).groupBy(label).agg(F.sum(F.col("x") * F.col("x")).alias("q"))
    n = F.col("support")
    return stats.join(parts, label).select(label, "support", F.when(n > 1, (F.col("q") - n) / (n * (n - 1))).alias("mean_pair"), "mean_fit", "low_fit")


def medoids(rows: DataFrame, key: str, label: str, centers: DataFrame) -> DataFrame:
    """The member most similar to all members of its label: the one nearest to their sum."""
    fit = rows.join(small(centers), label).select(label, key, F.round(dot("v", "c"), 9).alias("fit"))
    best = fit.groupBy(label).agg(F.max(F.struct("fit", (-F.col(key)).alias("k"))).alias("b"))
    return best.select(label, (-F.col("b.k")).alias("medoid"), F.round("b.fit", 6).alias("fit"))


def soft_membership(ranked: DataFrame, key: str, label: str, margin: float = 0.03, floor: float = 0.0, most: int = 2) -> DataFrame:
    """Of ranked targets those within ``margin`` of the best and at ``floor`` or above, at most two."""
    best = F.max("similarity").over(Window.partitionBy(key))
    return ranked.withColumn("_best", best).where((F.col("similarity") >= F.col("_best") - margin) & (F.col("similarity") >= floor) & (F.col("place") <= most)).drop("_best")

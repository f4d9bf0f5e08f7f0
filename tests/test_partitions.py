"""Small tables go to all cores, larger ones stay; nearest targets in one block or in many."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from boxwood import partitions
from boxwood.operators import vectors


def test_spread_moves_small_tables_alone(spark, monkeypatch):
    rows = spark.range(0, 1000, 1, 1).select("id", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise("same").alias("text"))
    dealt = partitions.spread(rows)
    assert sorted(map(tuple, dealt.collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)
    assert dealt.select(F.spark_partition_id()).distinct().count() > 1 or spark.sparkContext.defaultParallelism == 1
    monkeypatch.setattr(partitions, "SMALL_SHARE", 0)
    assert partitions.spread(rows) is rows
    assert partitions.spread(rows.limit(0)).count() == 0


def test_nearest_in_blocks(spark, monkeypatch):
    r = random.Random(3)
    vecs = [[r.gauss(0, 1) for _ in range(4)] for _ in range(60)]
    vecs[41] = vecs[7]  # a tie, which goes to the lesser label
    rows = vectors.units(spark.createDataFrame(list(enumerate(vecs)), "k long, x array<double>"), "k", "x")
    targets = rows.select(F.col("k").alias("label"), F.col("v").alias("c"))
    one = sorted(map(tuple, vectors.nearest(rows, "k", targets, "label", 5).collect()))
    monkeypatch.setattr(vectors, "SMALL", 20)
    many = sorted(map(tuple, vectors.nearest(rows, "k", targets, "label", 5).collect()))
    assert one == many and len(one) == 300
    assert [x[1] for x in one if x[0] == 41 and x[3] == 1] == [7]
    assert vectors.nearest(rows, "k", targets.limit(0), "label", 5).count() == 0

"""Rankings, first occurrences, running caps and visibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise


def latest(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The last n rows of each key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    return rows.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def first_by(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key: a minimum of structs, which combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    ranked = rows.groupBy(*keys).agg(F.min(F.struct(*[F.col(o).alias(f"_o{i}") if isinstance(o, str) else o.alias(f"_o{i}") for i, o in enumerate(order)], *rest)).alias("_first"))
    return ranked.select(*keys, *(F.col(f"_first.{c}").alias(c) for c in rest))


def bottom_hash_sample(rows: DataFrame, keys: list[str], hash_col: str, n: int) -> DataFrame:
    """The n rows of each key with the least hash, whatever the order they come in."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(hash_col))
    return rows.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def running_cap(rows: DataFrame, order: str, size: str, cap: int, buckets: int = 256) -> DataFrame:
    """Rows in order up to, and without, the first that would exceed the cap (no later one either).

    The order is cut into ranges, which are written once, as sampling again could cut elsewhere;
    their sums are added up first, so that no task sees all rows. Rows of equal order go by a
    hash of the rest; a null size counts as 0.
    """
    spark = rows.sparkSession
    parts = min(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = materialise(rows.repartitionByRange(parts, order).withColumn("_range", F.spark_partition_id()))
    spent = F.coalesce(F.col(size), F.lit(0))
    sums = ranged.groupBy("_range").agg(F.sum(spent).alias("_sum"))  # one row a range
    before = sums.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    total = F.sum(spent).over(Window.partitionBy("_range").orderBy(order, F.xxhash64(*rows.columns)).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # At most ``buckets`` rows of two numbers.
    return ranged.join(F.broadcast(before), "_range").withColumn("_total", total + F.col("_before")).where(F.col("_total") <= cap).drop("_range", "_before", "_total")


def place_over(rows: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """Every row's place (from 1) in a total order, without a task that sees all rows: ranges
    of the order are written once and numbered on their own, then moved by the counts before."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))  # one row a range
    before = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.join(F.broadcast(before), "_range").withColumn(name, (own + F.col("_before")).cast("long")).drop("_range", "_before")


def lru(rows: DataFrame, key: str, ts: str, cap: int, exempt: Column | None = None) -> DataFrame:
    """(key, evicted, place): the least recently used beyond the cap. Keys with a row that is
    ``exempt`` (active now, say, or uploaded) are never evicted, and take no place of another's."""
    free = F.lit(False) if exempt is None else F.coalesce(exempt, F.lit(False))
    used = rows.groupBy(key).agg(F.max(ts).alias("_used"), F.max(free).alias("_exempt"))
    placed = place_over(used, F.col("_exempt").asc(), F.col("_used").desc(), F.col(key).asc())
    return placed.select(key, ((F.col("place") > cap) & ~F.col("_exempt")).alias("evicted"), "place")


def context_visible(changed: Column, order: Window, k: int) -> Column:
    """True for rows within k rows of a changed one."""
    near = order.rowsBetween(-k, k)
    return F.max(changed.cast("int")).over(near) == 1


def cap_with_side_coverage(rows: DataFrame, keys: list[str], side: str, order: list[Column], cap: int) -> DataFrame:
    """The best of each side first, then the best of the rest, up to ``cap`` rows a key."""
    by_side = F.row_number().over(Window.partitionBy(*keys, side).orderBy(*order))
    ranked = rows.withColumn("_side", by_side)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy((F.col("_side") > 1).cast("int"), *order))
    return ranked.withColumn("_place", place).where(F.col("_place") <= cap).drop("_side", "_place")

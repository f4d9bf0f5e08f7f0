"""Metrics, intervals, code lengths and gates, as aggregates and expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, 0 where b is 0."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def f_beta(precision: Column, recall: Column, beta: float = 1.0) -> Column:
    return F.coalesce(F.try_divide((1 + beta * beta) * precision * recall, beta * beta * precision + recall), F.lit(0.0))


def confusion(rows: DataFrame, keys: list[str], pred: str, truth: str) -> DataFrame:
    """tp, fp, fn, tn, precision, recall and f1 by ``keys``; undefined ones are 0."""
    p, t = F.col(pred), F.col(truth)
    counts = rows.groupBy(*keys).agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(*keys, "tp", "fp", "fn", "tn", F.round(ratio(tp, tp + fp), 6).alias("precision"), F.round(ratio(tp, tp + fn), 6).alias("recall"), F.round(ratio(2 * tp, 2 * tp + fp + fn), 6).alias("f1"))


def micro_average(rows: DataFrame, fold: str, pred: str, truth: str) -> DataFrame:
    """One row: counts summed over folds, then precision and recall."""
    p, t = F.col(pred), F.col(truth)
    sums = rows.agg(F.count_distinct(fold).alias("folds"), F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"))
    tp = F.col("tp")
    return sums.select("folds", "tp", "fp", "fn", F.round(ratio(tp, tp + F.col("fp")), 6).alias("precision"), F.round(ratio(tp, tp + F.col("fn")), 6).alias("recall"))


def stable_folds(rows: DataFrame, key: str, k: int) -> DataFrame:
    """Add ``fold``: place by (SHA-256 of the key, key), modulo k.

    The place comes from counts by hash prefix and a rank within each, so no task sorts all rows.
    """
    hashed = rows.withColumn("_hash", F.sha2(F.col(key).cast("string"), 256)).withColumn("_prefix", F.substring("_hash", 1, 2))
    before = Window.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    counts = hashed.groupBy("_prefix").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")  # 256 rows
    place = F.row_number().over(Window.partitionBy("_prefix").orderBy("_hash", key)) - 1 + F.col("_before")
    return hashed.join(F.broadcast(counts), "_prefix").withColumn("fold", (place % k).cast("long")).drop("_hash", "_prefix", "_before")


def percentiles(rows: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(group, and a column for each share): exact percentiles, interpolated between neighbours, of
    the values that aren't null. Rows are placed by ranges of (group, value), so neither a group
    nor its distinct values are ever held in one place."""
    from .windows import place_over

    own = rows.where(F.col(value).isNotNull()).select(group, F.col(value).cast("double").alias("_v"))
    placed = place_over(own, F.col(group).asc_nulls_first(), F.col("_v").asc())
    # One row a group.
    sizes = materialise(placed.groupBy(F.col(group).alias("_g")).agg(F.min("place").alias("_first"), F.count("*").alias("_n")))
    at = placed.join(sizes, F.col(group).eqNullSafe(F.col("_g"))).withColumn("_at", F.col("place") - F.col("_first"))
    out = []
    for name, share in shares.items():
        where = share * (F.col("_n") - 1)
        low, part = F.floor(where), where - F.floor(where)
        weight = F.when(F.col("_at") == low, 1 - part).when(F.col("_at") == low + 1, part).otherwise(0.0)
        out.append(F.sum(weight * F.col("_v")).alias(name))
    return at.groupBy(group).agg(*out)


def state_summary(rows: DataFrame, state: str, value: str, base: str) -> DataFrame:
    """Exact interpolated p50 and p95 by state, and the median's reduction against ``base``."""
    by = percentiles(rows, state, value, {"p50": 0.5, "p95": 0.95}).withColumnRenamed(state, "state")
    reference = by.where(F.col("state") == base).select(F.col("p50").alias("ref"))  # one row
    return by.join(F.broadcast(reference)).select("state", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), F.round(100 * (1 - F.col("p50") / F.col("ref")), 3).alias("reduction_pct"))


def percentile_rank(value: Column, rows: str) -> Column:
    """Share of an array's values at or below one."""
    return ratio(F.size(F.filter(rows, lambda x: x <= value)), F.size(rows))


def wilson(k: str, n: str, z: float = 1.959964) -> tuple[Column, Column]:
    """The Wilson score interval of k of n."""
    p, m = F.col(k) / F.col(n), F.col(n)
    middle, half = p + z * z / (2 * m), z * F.sqrt(p * (1 - p) / m + z * z / (4.0 * m * m))
    return (middle - half) / (1 + z * z / m), (middle + half) / (1 + z * z / m)


def launch_gate(coverage: Column, precision: Column, drop: Column, complete: Column) -> Column:
    """Coverage of a fifth, strict precision of four fifths, a drop within five points, complete."""
    return (coverage >= 0.20) & (precision >= 0.80) & (drop <= 0.05) & complete


def event_bits(k: str, n: str) -> Column:
    """Bits of n events of which k happen, coded with their own rate."""
    a, m = F.col(k).cast("double"), F.col(n).cast("double")
    return F.when((a == 0) | (a == m), 0.0).otherwise(-a * F.log2(a / m) - (m - a) * F.log2((m - a) / m))


def log_gamma(x: Column) -> Column:
    """ln gamma for x >= 1 by Stirling's series after moving x above 8, JVM-side."""
    lift = F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0.0), lambda s, i: s + F.log(x + i))
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5))
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - lift


def enumerative_bits(k: str, n: str) -> Column:
    """log2 of n over k, and of the n + 1 values that k can take."""
    a, m = F.col(k).cast("double"), F.col(n).cast("double")
    return (log_gamma(m + 1) - log_gamma(a + 1) - log_gamma(m - a + 1)) / F.log(F.lit(2.0)) + F.log2(m + 1)


def rule_bits(atoms: Column, vocabulary: Column) -> Column:
    """Storage of a clause: its length, and each atom out of the vocabulary."""
    return F.log2(atoms + 1.0) + atoms * F.log2(F.greatest(vocabulary, F.lit(2)).cast("double"))


def atom_score(precision: Column, count: Column, lift: Column) -> Column:
    return precision * F.log1p(count) * F.log1p(lift)


def smoothed_lift(pos: Column, n_pos: Column, neg: Column, n_neg: Column) -> Column:
    return ((pos + 1.0) / (n_pos + 2.0)) / ((neg + 1.0) / (n_neg + 2.0))


def confidence_tier(fit: Column, margin: Column) -> Column:
    return F.when((fit >= 0.8) & (margin >= 0.02), "high").when(fit >= 0.62, "medium").when(fit >= 0.4, "low").otherwise("abstain")


def expansion_decision(entails: Column, related: Column, fit: Column, floor: Column) -> Column:
    return F.when(entails & (fit >= floor), "expand").when(entails | related, "review").otherwise("reject")


def queue_sign(added: Column, removed: Column, total: Column) -> Column:
    return F.when(ratio(added, total) >= 0.5, "add").when(ratio(removed, total) > 0.5, "remove").otherwise("neutral")


def rule_status(precision: Column, recall: Column, support: Column) -> Column:
    return F.when((precision >= 0.75) & (recall >= 0.3) & (support >= 5), "strong").when((precision >= 0.5) & (support >= 2), "weak").otherwise("insufficient")


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))

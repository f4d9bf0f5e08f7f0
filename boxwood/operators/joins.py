"""Joins with a rule of their own: strict lookups, as-of, exact before contained, bundles, closures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(rows: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """The records that rows name. A key without a record fails the query, rather than drop the row."""
    found = rows.join(records.withColumn("_there", F.lit(True)), key, "left")
    missing = F.raise_error(F.concat(F.lit(f"no record for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return found.where(F.when(F.col("_there"), True).otherwise(missing.cast("boolean"))).drop("_there")


def by_row(samples: DataFrame, corpus: DataFrame, group: str, order: str) -> DataFrame:
    """Samples with the row of the corpus that they name by group and place in it (from 0)."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    return samples.join(corpus.withColumn("row_index", place.cast("long")), [group, "row_index"])


def in_both(before: DataFrame, after: DataFrame, verified: DataFrame, key: str) -> DataFrame:
    """Keys that hold before and after and are verified."""
    return before.select(key).distinct().join(after.select(key), key, "left_semi").join(verified.select(key), key, "left_semi")


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, values: list[str], within: Column | None = None) -> DataFrame:
    """Each left row with the values of the last right row of its key at or before it; null if there
    is none, or ``within`` (over ``at`` and ``_right_at``) doesn't hold.

    One union and one window: no pairs are made. A right row at the same time counts as before; of
    several the greatest values. A right row's nulls are values, not gaps.
    """
    kept = F.struct(F.col(at).alias("_right_at"), *values)
    both = left.withColumn("_side", F.lit(1)).withColumn("_right", F.lit(None).cast(right.select(kept.alias("s")).schema["s"].dataType)).unionByName(
        right.select(*by, at, F.lit(0).alias("_side"), kept.alias("_right")), allowMissingColumns=True
    )
    order = [F.col(at), F.col("_side"), *(F.col("_right")[v].asc_nulls_first() for v in values)]
    last = F.last("_right", ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = both.withColumn("_right", last).where("_side = 1").withColumn("_right_at", F.col("_right._right_at"))
    there = F.lit(True) if within is None else F.coalesce(within, F.lit(False))
    return found.select(*left.columns, *(F.when(there, F.col(f"_right.{v}")).alias(v) for v in values))


def best_container(spans: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """For each span (key, at, upto, kind) the box (key, id, start, end, kind, depth) that holds it:
    one of exactly its extent first, then one of its kind, then the shortest, then the deepest."""
    b = boxes.select(key, "id", "start", "end", F.col("kind").alias("box_kind"), "depth")
    held = spans.join(b, key).where((F.col("start") <= F.col("at")) & (F.col("end") >= F.col("upto")))
    order = F.struct(
        ((F.col("start") != F.col("at")) | (F.col("end") != F.col("upto"))).alias("inexact"), (~F.col("kind").eqNullSafe(F.col("box_kind"))).alias("other"),
        (F.col("end") - F.col("start")).alias("span"), (-F.col("depth")).alias("up"), F.col("id").alias("id"),
    )
    return held.groupBy(key, "at", "upto", "kind").agg(F.min(order).alias("b")).select(key, "at", "upto", "kind", "b.id", (~F.col("b.inexact")).alias("exact"), (~F.col("b.other")).alias("same_kind"))


def drill_bundle(records: DataFrame, claims: DataFrame, candidates: DataFrame, record: str, claim: str, order: list[str], most: int = 24) -> DataFrame:
    """(record, claims): each record's claims in order, each with its candidates in order, the first
    ``most`` of them, and how many there are; a record without claims has none, a claim without
    candidates stays unresolved.

    claims: record, claim; candidates: claim, candidate and the columns of ``order``.
    """
    w = Window.partitionBy(claim)
    ranked = candidates.withColumn("place", F.row_number().over(w.orderBy(*order))).withColumn("_all", F.count("*").over(w)).where(F.col("place") <= most)
    by = ranked.groupBy(claim).agg(F.max("_all").alias("n"), F.array_sort(F.collect_list(F.struct("place", "candidate"))).alias("c"))
    told = claims.join(by, claim, "left").select(record, claim, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("c.candidate"), F.array().cast("array<string>")).alias("candidates"))
    own = told.groupBy(record).agg(F.array_sort(F.collect_list(F.struct(claim, "n", "candidates"))).alias("claims"))
    return records.select(record).join(own, record, "left").select(record, F.coalesce("claims", F.array().cast(own.schema["claims"].dataType)).alias("claims"))


def ranks_for_audit(rows: DataFrame, group: str, scores: dict[str, list[Column]]) -> DataFrame:
    """Places from 0 under each order, kept beside the rows for later audit."""
    out = rows
    for name, order in scores.items():
        out = out.withColumn(name, (F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1).cast("long"))
    return out


def next_active(sessions: DataFrame, removed: DataFrame, key: str, used: str, active: str) -> DataFrame:
    """What is left when some are removed, the most recently used first: (key, place, active). The
    active one stays so unless it is removed; then the most recently used takes its place."""
    left = sessions.join(removed.select(key), key, "left_anti")
    kept = left.agg(F.max(F.when(F.col(active), F.col(key))).alias("_a"), F.max(F.struct(used, key)).alias("_m"))  # one row
    chosen = F.coalesce(F.col("_a"), F.col("_m")[key])
    place = F.row_number().over(Window.orderBy(F.desc(used), F.desc(key)))  # a registry: one row a session
    return left.join(F.broadcast(kept)).select(key, place.cast("long").alias("place"), (F.col(key) == chosen).alias("active"))


def invalidation_keys(namespaces: DataFrame, hashes: DataFrame) -> DataFrame:
    """Every key that content could have been stored under: each hash alone, and under each
    namespace. Namespaces are few."""
    under = hashes.select("hash").distinct().join(F.broadcast(namespaces.select("namespace").distinct()))
    return hashes.select(F.col("hash").alias("key")).distinct().unionByName(under.select(F.concat_ws(":", "namespace", "hash").alias("key")))


def invalidate(cache: DataFrame, keys: DataFrame, session_only: Column | None = None) -> DataFrame:
    """The cache without those keys; with ``session_only`` just such rows among them go."""
    marked = cache.join(keys.select("key").distinct().withColumn("_gone", F.lit(True)), "key", "left")
    gone = F.coalesce("_gone", F.lit(False)) if session_only is None else F.coalesce("_gone", F.lit(False)) & F.coalesce(session_only, F.lit(False))
    return marked.where(~gone).drop("_gone")


def relation_patterns(rows: DataFrame, group: str, key: str, facets: dict[str, str]) -> DataFrame:
    """(group, kind, left, right, support, first): pairs of facet values of one record, counted
    once a record, for every two facets, with the least record that has them.

    ``facets``: name to array column; two facets of a record are paired, not records.
    """
    names, out = list(facets), None
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            left = rows.select(group, key, F.explode(F.array_distinct(facets[a])).alias("left"), F.col(facets[b]).alias("_b"))
            pairs = left.select(group, key, F.lit(f"{a}↔{b}").alias("kind"), "left", F.explode(F.array_distinct("_b")).alias("right"))
            one = pairs.groupBy(group, "kind", "left", "right").agg(F.count_distinct(key).alias("support"), F.min(key).alias("first"))
            out = one if out is None else out.unionByName(one)
    return out

"""Window and state queries over events, as batches; the same functions run on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query, table
from ..streaming import windows


@query("tumbling_counts", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.tumbling(table(spark, sf_dir, "events"))


@query(
    "sliding_counts",
    "SELECT time_bucket(INTERVAL '2 hours', ts) - k * INTERVAL '2 hours' AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, (VALUES (0), (1), (2)) AS v(k) GROUP BY 1, 2",
)
def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sliding(table(spark, sf_dir, "events"))


@query(
    "session_counts",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sessions(table(spark, sf_dir, "events"))


@query(
    "rolling_limit",
    "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1 day' PRECEDING AND CURRENT ROW) AS recent, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1 day' PRECEDING AND CURRENT ROW) <= 3 AS allowed FROM events",
)
def rolling_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.rolling_limit(table(spark, sf_dir, "events"), 3, 86_400).select("event_id", "recent", "allowed")


@query("cache_compaction", "SELECT user_id AS k, arg_max(value, struct_pack(t := ts, i := event_id)) AS v, arg_max(event_type, struct_pack(t := ts, i := event_id)) AS kind FROM events WHERE event_type <> 'error' GROUP BY user_id")
def cache_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").where("event_type <> 'error'").select(F.col("user_id").alias("k"), F.col("value").alias("v"), F.col("event_type").alias("kind"), F.struct("ts", "event_id").alias("seq"))
    return windows.last_write_wins(log, "k", "seq").select("k", "v", "kind")


@query(
    "cache_invalidation",
    "SELECT e.event_type, count(*) AS kept FROM events e WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.toxic = 1 AND l.doc_id = e.user_id) GROUP BY e.event_type",
)
def cache_invalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    stale = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("user_id"))
    return table(spark, sf_dir, "events").join(stale, "user_id", "left_anti").groupBy("event_type").agg(F.count("*").alias("kept"))


@query(
    "upsert_latest",
    "SELECT o_custkey AS k, min(o_orderdate) AS created_at, max(o_orderdate) AS updated_at, arg_max(o_orderstatus, struct_pack(d := o_orderdate, k := o_orderkey)) AS status FROM orders GROUP BY o_custkey",
)
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    return rows.groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderdate").alias("created_at"), F.max("o_orderdate").alias("updated_at"), F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"))

"""Event-time windows, sessions and state over a stream of events, or a batch of them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, size: str = "1 hour", late: str | None = "2 hours") -> DataFrame:
    """(start, event_type, n, total) by windows of event time; a stream drops what is later."""
    return _windowed(events, F.window("ts", size), late)


def sliding(events: DataFrame, size: str = "6 hours", slide: str = "2 hours", late: str | None = "2 hours") -> DataFrame:
    return _windowed(events, F.window("ts", size, slide), late)


def _watermarked(events: DataFrame, late: str | None) -> DataFrame:
    if not events.isStreaming:
        return events
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late or "0 seconds")


def _windowed(events: DataFrame, window, late: str | None) -> DataFrame:
    found = _watermarked(events, late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return found.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str | None = "2 hours") -> DataFrame:
    """(user_id, start, n): runs of a user's events with no gap as long as ``gap``."""
    found = _watermarked(events, late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").alias("start"), "n")


def rolling_limit(events: DataFrame, most: int, seconds: int) -> DataFrame:
    """Events with whether a limit of ``most`` in the last ``seconds`` lets them through, counting
    all of a user's events."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("recent", F.count("*").over(w)).withColumn("allowed", F.col("recent") <= most)


def ttl_sessions(events: DataFrame, ttl_ms: int) -> DataFrame:
    """A stream of (user_id, first_ms, last_ms, n): a user's state goes, and is told, once event
    time is ``ttl_ms`` past its last event."""

    def step(key: tuple, frames, state: GroupState):
        first, last, n = state.get if state.exists else (None, None, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "first_ms": [first], "last_ms": [last], "n": [n]})
            return
        for frame in frames:
            ms = frame["ms"]
            first = int(ms.min()) if first is None else min(first, int(ms.min()))
            last = int(ms.max()) if last is None else max(last, int(ms.max()))
            n += len(frame)
        state.update((first, last, n))
        state.setTimeoutTimestamp(max(last + ttl_ms, state.getCurrentWatermarkMs() + 1))

    rows = _watermarked(events, "0 seconds").withColumn("ms", F.unix_millis("ts"))
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, first_ms long, last_ms long, n long", "first_ms long, last_ms long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def last_write_wins(log: DataFrame, key: str, seq: str) -> DataFrame:
    """The last row of each key of an append-only log."""
    rest = [c for c in log.columns if c != key]
    last = log.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("r"))
    return last.select(key, *(F.col(f"r.{c}").alias(c) for c in rest))


def upsert_to(path: str, key: str, seq: str):
    """A ``foreachBatch`` function: each batch is merged into the table at ``path`` and replaces
    it by a folder of its own, so a batch that is tried again gives the same table. The folders
    are listed once a batch, and those before the last one are deleted: at most two are there."""

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        before = sorted(e for n in names if n.startswith("epoch=") and (e := int(n[6:])) < epoch)
        rows = batch
        if before:
            rows = spark.read.parquet(f"{path}/epoch={max(before)}").unionByName(batch)
        last_write_wins(rows, key, seq).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        for e in before[:-1]:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/epoch={e}"), True)

    return merge

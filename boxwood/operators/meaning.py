"""Summaries folded up, down and across, and what stands between them and a provider."""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Callable, Hashable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise


def windowed(docs: DataFrame, key: str, text: str, size: int, bare: Callable[[Column], Column], combine: Callable[[Column], Column]) -> DataFrame:
    """(key, windows, summary): every window of ``size`` characters summed up on its own, then the
    summaries in order combined. All of a text is in some window."""
    n = F.ceil(F.length(text) / size)
    parts = docs.select(key, F.posexplode(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)).cast("int")), lambda i: F.substr(F.col(text), (i * size + 1).cast("int"), F.lit(size)))).alias("at", "part"))
    told = parts.select(key, "at", bare(F.col("part")).alias("s"))
    return told.groupBy(key).agg(F.count("*").alias("windows"), F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda x: x["s"]).alias("_s")).select(key, "windows", combine(F.col("_s")).alias("summary"))


def folder_summaries(files: DataFrame, path: str, bare: str, combine: Callable[[Column], Column]) -> DataFrame:
    """(folder, depth, summary): what a folder's children say, combined in the order of their names,
    from the deepest folders up; one round a level, written so that none is done again."""
    level = files.select(F.col(path).alias("node"), F.col(bare).alias("summary"), F.size(F.split(path, "/")).alias("depth"))
    deepest = level.agg(F.max("depth")).first()[0] or 0
    out, waiting = None, level
    for d in range(deepest, 1, -1):
        own = waiting.where(F.col("depth") == d).withColumn("parent", F.regexp_replace("node", "/[^/]*$", ""))
        made = own.groupBy("parent").agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "summary"))), lambda x: x["summary"]).alias("_s"))
        made = materialise(made.select(F.col("parent").alias("node"), combine(F.col("_s")).alias("summary"), F.lit(d - 1).alias("depth")))
        out = made if out is None else out.unionByName(made)
        waiting = waiting.where(F.col("depth") < d).unionByName(made)
    return (out if out is not None else level.where("1 = 0")).select(F.col("node").alias("folder"), (F.col("depth")).cast("long").alias("depth"), "summary")


def peers_fold(units: DataFrame, group: str, key: str, bare: str, fold: Callable[[Column, Column], Column]) -> DataFrame:
    """(group, key, signature, summary): each unit folded with what its peers say, in the order of
    their keys. The signature names the set of units, so that a fold is known by what it saw. A
    group is one frontier or conversation, whose units fit one row."""
    whole = Window.partitionBy(group)
    peers = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(bare).alias("s"))).over(whole))
    rows = units.withColumn("_peers", peers)
    others = F.transform(F.filter("_peers", lambda p: p["k"] != F.col(key)), lambda p: p["s"])
    signature = F.substring(F.sha1(F.array_join(F.transform("_peers", lambda p: p["k"].cast("string")), "|")), 1, 16)
    return rows.select(group, key, signature.alias("signature"), fold(F.col(bare), others).alias("summary"))


def live_marks(events: DataFrame, session: str, mark: str, ts: str, ttl: str, cap: int, added: Column, now: str | None = None) -> DataFrame:
    """(session, mark, last): the marks of each session that are still set: the last word on a mark
    is that it was added, the session was in use within ``ttl`` before ``now`` (the latest of all
    events unless it is given), and the mark is among the session's ``cap`` latest."""
    at = F.to_timestamp(F.lit(now)) if now else F.col("_now")
    latest = events.agg(F.max(ts).alias("_now"))  # one row
    last = events.groupBy(session, mark).agg(F.max(F.struct(F.col(ts).alias("at"), added.cast("int").alias("on"))).alias("b"))
    used = events.groupBy(session).agg(F.max(ts).alias("_used"))
    alive = used.join(F.broadcast(latest)).where(F.col("_used") >= at - F.expr(f"INTERVAL {ttl}")).select(session)
    set_ = last.where("b.on = 1").join(alive, session, "left_semi").select(session, mark, F.col("b.at").alias("last"))
    place = F.row_number().over(Window.partitionBy(session).orderBy(F.desc("last"), mark))
    return set_.withColumn("_place", place).where(F.col("_place") <= cap).drop("_place")


class Gate:
    """At most ``n`` callers inside; the rest wait in the order in which they came."""

    def __init__(self, n: int = 8):
        self._free, self._lock, self._line = n, threading.Lock(), deque()

    def __enter__(self) -> Gate:
        with self._lock:
            if self._free:
                self._free -= 1
                return self
            turn = threading.Event()
            self._line.append(turn)
        turn.wait()
        return self

    def __exit__(self, *_: Any) -> None:
        with self._lock:
            if self._line:
                self._line.popleft().set()  # the place passes on
            else:
                self._free += 1


class Flights:
    """Calls for the same key that overlap are one call, whose result or error all of them get.
    Nothing is kept once it has landed."""

    def __init__(self):
        self._lock, self._flying = threading.Lock(), {}

    def call(self, key: Hashable, make: Callable[[], Any]) -> Any:
        with self._lock:
            flight = self._flying.get(key)
            mine = flight is None
            if mine:
                flight = self._flying[key] = {"done": threading.Event()}
        if not mine:
            flight["done"].wait()
        else:
            try:
                flight["value"] = make()
            except BaseException as e:
                flight["error"] = e
            finally:
                with self._lock:
                    del self._flying[key]
                flight["done"].set()
        if "error" in flight:
            raise flight["error"]
        return flight["value"]

"""Evidence operators against loops over small rows."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from boxwood.operators import evidence
from test_trees import tree_rows


def test_highlight_marks(spark):
    spans = [(1, 1, 3), (1, 3, 6), (1, 9, 12), (1, 12, 13), (1, 12, 16), (1, 10, 10)]
    df = spark.createDataFrame(spans, "doc long, at long, upto long")
    got = {}
    for r in evidence.highlight_marks(tree_rows(spark), df, "doc").collect():
        got.setdefault((r["at"], r["upto"]), set()).add(r["id"])
    # The last two: y is synthetic and below the root, so what it holds and the span touches.
    assert got == {(1, 3): {"p"}, (3, 6): {"x"}, (9, 12): {"x", "s"}, (12, 13): {"s"}, (12, 16): {"s", "t"}, (10, 10): {"x"}}


def test_frontier_chunks_tile_the_text(spark):
    body = "abcd,efgh)---ijk;lmn"
    marks = spark.createDataFrame([(1, "p")], "doc long, id string")
    spans = spark.createDataFrame([(1, 12, 13)], "doc long, at long, upto long")
    rows = evidence.frontier_chunks(tree_rows(spark), marks, spans, spark.createDataFrame([(1, body)], "doc long, body string"), "doc", "body").orderBy("start").collect()
    assert [r["id"] for r in rows] == ["p", "q", "s", "t"] and rows[0]["start"] == 0 and rows[-1]["end"] == 20
    assert all(a["end"] == b["start"] for a, b in zip(rows, rows[1:], strict=False))
    assert [r["id"] for r in rows if r["target"]] == ["s"]


def test_outermost(spark):
    picked = spark.createDataFrame([(1, "x"), (1, "p"), (1, "t")], "doc long, id string")
    assert {r["id"] for r in evidence.outermost(tree_rows(spark), picked, "doc").collect()} == {"x", "t"}


def test_greedy_clauses_equal_the_loop(spark):
    r = random.Random(4)
    members = [(f"c{r.randrange(3)}", m) for m in range(120)]
    hosts = sorted({(f"k{r.randrange(12)}", r.randrange(120)) for _ in range(500)})
    want = set()
    for cluster in {c for c, _ in members}:
        own = {m for c, m in members if c == cluster}
        by = {k: {m for x, m in hosts if x == k} for k, _ in hosts}
        ranked = sorted(by, key=lambda k: (-round(2 * len(by[k] & own) / (len(own) + len(by[k])), 9), -len(by[k] & own), k))
        covered, place = set(), 0
        for k in ranked:
            hit = by[k] & own
            if not hit or len(hit) / len(by[k]) < 0.3 or not hit - covered or place == 4:
                continue
            covered |= hit
            place += 1
            want.add((cluster, k, place))
    got = evidence.greedy_clauses(spark.createDataFrame(members, "cluster string, member int"), spark.createDataFrame(hosts, "clause string, member int"), purity=0.3, most=4)
    assert {(x["cluster"], x["clause"], x["place"]) for x in got.collect()} == want


def test_closest_names(spark):
    paths = spark.createDataFrame([("a/b/x",), ("a/c/x",), ("d/x",), ("top",)], "path string")
    got = {r["name"]: (r["kind"], r["path"], r["score"]) for r in evidence.closest_names(paths, "a/c").collect()}
    assert got == {"x": ("file", "a/c/x", 2), "top": ("file", "top", 0), "a": ("folder", "a", 1), "b": ("folder", "a/b", 1), "c": ("folder", "a/c", 2), "d": ("folder", "d", 0)}
    assert evidence.closest_names(paths, "").where("score > 0").count() == 0


def test_split_segments(spark):
    rows = spark.createDataFrame([(1, 0, 10, 3, 5), (2, 0, 10, 10, 12), (3, 0, 10, -1, 20), (4, 0, 10, 0, 4)], "k int, s int, e int, lo int, hi int")
    got = {}
    for r in evidence.split_segments(rows, "s", "e", "lo", "hi").orderBy("start").collect():
        got.setdefault(r["k"], []).append((r["start"], r["end"], r["marked"]))
    assert got == {1: [(0, 3, False), (3, 5, True), (5, 10, False)], 2: [(0, 10, False)], 3: [(0, 10, True)], 4: [(0, 4, True), (4, 10, False)]}


def test_context_fold(spark):
    digest = lambda s: hashlib.sha1(s.encode()).hexdigest()[:16]
    got = spark.range(1).select(evidence.fold_context(F.array(F.lit("a"), F.lit("a/b")), F.lit("bare")).alias("x")).first()["x"]
    assert got == digest("bare:" + digest("a/b:" + digest("a:")))


def test_capped_hits(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(20)], "k int, v int")
    got = evidence.capped_hits(rows, ["k"], 5).collect()
    assert sorted(r["k"] for r in got) == list(range(5)) and all(r["truncated"] for r in got)
    assert not any(r["truncated"] for r in evidence.capped_hits(rows, ["k"], 20).collect())

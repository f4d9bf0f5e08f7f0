"""Edits, patterns, clustering, rules and set relations against direct computations."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from boxwood.operators import changes, clustering, graphs, rules, sets, vectors, windows

BODY = st.text(alphabet="ab(){};,\n x", max_size=80)


@settings(max_examples=80, deadline=None)
@given(BODY, BODY)
def test_edit_scripts(old, new):
    assert changes.edit_script(old, old) == []
    actions = changes.edit_script(old, new)
    c = changes.churn(actions)
    assert c["net"] == c["added"] - c["removed"] and (c["ratio"] is None) == (c["added"] == 0)
    assert sum(len(x["actions"]) for x in changes.components(actions)) == len(actions)
    vertices, edges = changes.change_graph(actions)
    assert all(0 <= a < len(vertices) and 0 <= b < len(vertices) for a, b, _ in edges)


def test_churn_counts_trees_whole():
    def act(action, size):
        return {"action": action, "size": size, "side": "after", "kind": "leaf", "start": 0, "end": 1, "ancestors": []}

    got = changes.churn([act("insert-tree", 4), act("delete-node", 1), act("update-node", 1), act("move-tree", 3)])
    assert got == {"added": 5, "removed": 2, "moved": 1, "net": 3, "ratio": 0.4}


def test_components_follow_containers():
    def act(start, group):
        return {"action": "insert-node", "size": 1, "side": "after", "kind": "leaf", "start": start, "end": start + 1, "ancestors": [{"kind": "group", "start": group, "end": group + 9}]}

    assert len(changes.components([act(1, 0), act(3, 0)])) == 1
    assert len(changes.components([act(1, 0), act(13, 10)])) == 2


def test_diff_stats():
    assert changes.diff_stats("same\nold\ngone1\nx\ngone2", "same\nnew\nx\nmore") == {"added": 0, "removed": 1, "modified": 2}
    assert changes.diff_stats("a\nb", "a\nb\nc\nd") == {"added": 2, "removed": 0, "modified": 0}


@settings(max_examples=60, deadline=None)
@given(BODY, BODY)
def test_char_diff_rebuilds_both_sides(old, new):
    runs = changes.char_diff(old, new)
    assert "".join(t for k, t in runs if k != "added") == old and "".join(t for k, t in runs if k != "removed") == new


def test_context_rows():
    rows = [("same", str(i), str(i)) for i in range(20)]
    rows[10] = ("modified", "a", "b")
    assert [r[0] for r in changes.context_rows(rows, 2)] == ["skip", "same", "same", "modified", "same", "same", "skip"]


def test_monomorphism():
    host = ([(0, "a"), (1, "b"), (2, "a")], [(0, 1, "e"), (1, 2, "e")])
    assert changes.contains(host, ([(0, "b"), (1, "a")], [(0, 1, "e")]))
    assert not changes.contains(host, ([(0, "a"), (1, "a")], [(0, 1, "e")]))
    v, e = changes.reify(*host)
    assert len(v) == 5 and len(e) == 4
    assert not changes.is_complete(v, e)


def test_tree_distance():
    a, b = ("r", (("x", ()), ("y", (("z", ()),)))), ("r", (("x", ()),))
    assert changes.tree_distance(a, a) == 0 and changes.tree_distance(a, b) == 2 and changes.tree_similarity(a, a) == 1


def brute_linkage(x, threshold):
    d, groups = clustering.cosine_distances(x), [[i] for i in range(len(x))]
    while len(groups) > 1:
        best = min(((np.mean([d[i, j] for i in a for j in b]), k, m) for (k, a), (m, b) in itertools.combinations(enumerate(groups), 2)), key=lambda t: t[0])
        if best[0] > threshold:
            break
        groups[best[1]] += groups[best[2]]
        del groups[best[2]]
    labels = np.empty(len(x), dtype=int)
    for k, g in enumerate(sorted(map(sorted, groups))):
        labels[g] = k
    return labels


@pytest.mark.parametrize("seed", range(6))
def test_average_linkage(seed):
    x = np.random.default_rng(seed).normal(size=(25, 4))
    for threshold in (0.1, 0.4, 0.8, 2.0):
        assert clustering.average_linkage(x, threshold).tolist() == brute_linkage(x, threshold).tolist()


def test_silhouette_and_rand():
    x = np.array([[1, 0], [1, 0.01], [0, 1], [0.01, 1]], dtype=float)
    assert clustering.silhouette(x, np.array([0, 0, 1, 1])) > 0.95 and clustering.silhouette(x, np.zeros(4, dtype=int)) == 0
    assert clustering.adjusted_rand(np.array([0, 0, 1, 1]), np.array([1, 1, 0, 0])) == 1
    assert clustering.split_stability(x[:1], 0.5) == 1


def test_density_clusters_find_two_groups_and_noise():
    rng = np.random.default_rng(0)
    a, b = rng.normal([5, 0, 0], 0.05, (20, 3)), rng.normal([0, 5, 0], 0.05, (20, 3))
    labels = clustering.density_clusters(np.concatenate([a, b, [[-1, -1, 9]]]))
    assert set(labels[:20]) == {0} and set(labels[20:40]) == {1} and labels[40] == -1


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in graphs.components(edges).collect()}
    assert {got[i] for i in range(41)} == {0} and got[102] == 100


def test_share_a_name(spark):
    rows = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"]), (3, ["b"]), (4, ["c"]), (5, [])], "k long, names array<string>")
    assert {r["k"]: r["component"] for r in graphs.share_a_name(rows, "k", "names").collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_frequent_paths(spark):
    v = spark.createDataFrame([(g, i, label) for g in (1, 2) for i, label in enumerate("abc")] + [(3, 0, "a"), (3, 1, "b")], "graph long, id long, label string")
    e = spark.createDataFrame([(g, i, i + 1, "e") for g in (1, 2) for i in range(2)] + [(3, 0, 1, "e")], "graph long, src long, dst long, label string")
    found = {r["pattern"]: r["support"] for r in graphs.frequent_paths(v, e, 2).collect()}
    assert found == {"a -e-> b": 3, "b -e-> c": 2, "a -e-> b -e-> c": 2}
    assert {r["pattern"] for r in graphs.closed(graphs.frequent_paths(v, e, 2)).collect()} == {"a -e-> b", "a -e-> b -e-> c"}


def test_hierarchy_checks(spark):
    nodes = spark.createDataFrame([("r", None, 0), ("x", "r", 1), ("y", "r", 3), ("z", "gone", 1)], "id string, parent string, depth int")
    members = spark.createDataFrame([("r", 1), ("r", 2), ("x", 1), ("y", 1), ("y", 9)], "id string, member int")
    assert {r["check"]: r["broken"] for r in graphs.check_hierarchy(nodes, members).collect()} == {"reachable": 1, "parent_exists": 1, "depth": 1, "containment": 1, "disjoint_siblings": 1}


def test_rules_find_the_planted_clause(spark):
    rows = [(i, a) for i in range(60) for a in ("p", "q", "r", "s") if (i >> "pqrs".index(a)) & 1]
    features = spark.createDataFrame(rows, "sample long, atom string")
    truth = spark.createDataFrame([(i, bool(i & 1 and i & 4)) for i in range(60)], "sample long, positive boolean")
    found = rules.clauses(features, truth, rules.rank_atoms(features, truth))
    best = found.where("precision = 1").collect()
    assert ["p", "r"] in [list(r["clause"]) for r in best]
    assert list(rules.greedy(found, features, truth)[0][0]) == ["p", "r"]
    for r in found.collect():
        own = [i for i in range(60) if all((i >> "pqrs".index(a)) & 1 for a in r["clause"])]
        assert r["tp"] == sum(bool(i & 1 and i & 4) for i in own) and r["tp"] + r["fp"] == len(own)


def test_set_relations(spark):
    members = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 1), ("d", 2), ("d", 3), ("e", 9)], "id string, member int")
    got = {(r["a"], r["b"]): r["relation"] for r in sets.set_relations(members).collect()}
    assert got == {("a", "b"): "equal", ("a", "c"): "superset", ("a", "d"): "partial", ("b", "c"): "superset", ("b", "d"): "partial"}


def test_multisets(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(1,), (2,), (2,)], "y int")
    r = sets.multiset_difference(a, b).first()
    assert (r["only_left"], r["only_right"], r["same"]) == (1, 1, False)
    assert sets.multiset_difference(a, a).first()["same"]
    with pytest.raises(ValueError):
        sets.multiset_difference(a, b.withColumn("z", b["y"]))


def test_verify_index(spark):
    index = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "name string, hash string")
    found = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "name string, hash string")
    assert {r["name"]: r["status"] for r in sets.verify_index(index, found).collect()} == {"a": "verified", "b": "hash_mismatch", "c": "missing", "d": "unindexed"}


def test_bottom_hash_sample_ignores_order(spark):
    for order in ("cab", "bca"):
        rows = spark.createDataFrame([("k", x) for x in order], "g string, h string")
        assert sorted(r["h"] for r in windows.bottom_hash_sample(rows, ["g"], "h", 2).collect()) == ["a", "b"]


def test_running_cap_stops_for_good(spark):
    rows = spark.createDataFrame([(1, 40), (2, 50), (3, 20), (4, 1)], "k int, n int")
    assert sorted(r["k"] for r in windows.running_cap(rows, "k", "n", 100).collect()) == [1, 2]


def test_running_cap_over_many_rows(spark):
    """Three million rows of size 1 with a text that is read: the cap holds to the row."""
    rows = spark.range(3_000_000, numPartitions=2).select((F.col("id") * 7919 % 3_000_000).alias("k"), F.lit(1).alias("n"), F.sha1(F.col("id").cast("string")).alias("text"))
    got = windows.running_cap(rows, "k", "n", 2_000_000).agg(F.count("*").alias("n"), F.max("k").alias("most"), F.count("text").alias("texts")).first()
    assert tuple(got) == (2_000_000, 1_999_999, 2_000_000)


def test_lru_exempts(spark):
    rows = spark.createDataFrame([("a", 9, False), ("b", 8, True), ("c", 7, False), ("d", 6, False), ("c", 1, False)], "k string, t int, busy boolean")
    got = {r["k"]: (r["evicted"], r["place"]) for r in windows.lru(rows, "k", "t", 1, F.col("busy")).collect()}
    assert got == {"a": (False, 1), "c": (True, 2), "d": (True, 3), "b": (False, 4)}
    assert [r["k"] for r in windows.place_over(rows, F.col("t").asc()).orderBy("place").collect()] == ["c", "d", "c", "b", "a"]


def test_side_coverage(spark):
    rows = spark.createDataFrame([(1, "before", 9), (1, "before", 8), (1, "before", 7), (1, "after", 1)], "k int, side string, s int")
    got = windows.cap_with_side_coverage(rows, ["k"], "side", [rows["s"].desc()], 3).collect()
    assert sorted((r["side"], r["s"]) for r in got) == [("after", 1), ("before", 8), ("before", 9)]


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [3.0, 0.0], "a"), (2, [0.0, 0.0], "a"), (3, None, "a"), (4, [0.0, 2.0], "b"), (5, [1.0, 0.1], "a")], "k long, e array<double>, label string")
    units = vectors.units(rows, "k", "e")
    assert sorted(r["k"] for r in units.collect()) == [1, 4, 5]
    near = vectors.nearest(units, "k", vectors.centroids(units, "label"), "label", 1)
    assert {r["k"]: r["label"] for r in near.collect()} == {1: "a", 4: "b", 5: "a"}


def test_labels_are_clustered_whole(spark, small):
    """The queries' clusters are those of a label's whole matrix, as brute force finds them."""
    from collections import defaultdict

    from boxwood.plans import vectors as plans
    from boxwood.registry import table

    whole = defaultdict(list)
    for r in sorted(table(spark, small, "embeddings").collect(), key=lambda r: r["vec_id"]):
        whole[r["label"]].append((r["vec_id"], r["embedding"]))
    got = {r["vec_id"]: r["cluster"] for r in plans.agglomerative(spark, small).collect()}
    dense = {r["vec_id"]: r["cluster"] for r in plans.density_clusters(spark, small).collect()}
    swept = {(r["label"], r["threshold"]): r["clusters"] for r in plans.threshold_sweep(spark, small).collect()}
    stable = plans.split_stability(spark, small).collect()
    assert sorted(r["label"] for r in stable) == sorted(whole)
    for label, rows in whole.items():
        x = np.array([v for _, v in rows], dtype=float)
        assert [got[i] for i, _ in rows] == brute_linkage(x, 0.35).tolist()
        assert [dense[i] for i, _ in rows] == clustering.density_clusters(x).tolist()
        assert swept[label, 0.5] == brute_linkage(x, 0.5).max() + 1


def test_large_groups_are_clustered_through_micro_clusters(monkeypatch):
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(12, 16))
    kinds = rng.integers(0, 12, 900)
    x = centers[kinds] + rng.normal(scale=0.15, size=(900, 16))
    whole, dense, swept = clustering.average_linkage(x, 0.3), clustering.density_clusters(x), clustering.sweep(x, [0.2, 0.3])
    assert clustering.adjusted_rand(whole, kinds) == 1
    monkeypatch.setattr(clustering, "MOST", 200)
    assert clustering.average_linkage(x, 0.3).tolist() == whole.tolist()
    assert clustering.sweep(x, [0.2, 0.3])[1] == swept[1]
    assert clustering.adjusted_rand(clustering.density_clusters(x) + 1, dense + 1) > 0.9
    assert len(clustering.hierarchy(x, 0.3)[0]) == 900 and clustering.split_stability(x, 0.3, repeats=2) == 1


def test_topics_keep_rare_terms(spark, tmp_path):
    """Terms of two sources each tell these apart, though hundreds of commoner ones are shared by all."""
    from boxwood.plans import vectors as plans

    common = " ".join(f"common{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]}{'abcdefghij'[i // 100]}" for i in range(320))
    rows = []
    for i in range(8):
        rare = " ".join(f"pair{'abcd'[i // 2]}{'abcdefghij'[j % 10]}{'abcdefghij'[j // 10 % 10]}{'abcdefghij'[j // 100]}" for j in range(900))
        rows += [(10 * i + k, f"s{i}", common) for k in range(5)] + [(10 * i + 9, f"s{i}", rare)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    best = {}
    for r in plans.topic_factors(spark, str(tmp_path)).collect():
        best[r["source"]] = max(best.get(r["source"], (0, 0)), (r["share"], r["topic"]))
    topics = [best[f"s{i}"][1] for i in range(8)]
    assert all(topics[i] == topics[i + 1] for i in range(0, 8, 2)) and len(set(topics)) == 4


def test_sparse_factors_are_those_of_the_matrix():
    v = np.random.default_rng(0).random((7, 40)) * (np.random.default_rng(1).random((7, 40)) < 0.4)
    rows, cols = np.nonzero(v)
    for a, b in zip(clustering.nmf(v, 3), clustering.sparse_nmf(rows, cols, v[rows, cols], v.shape, 3), strict=True):
        assert np.allclose(a, b, rtol=1e-4, atol=1e-8)

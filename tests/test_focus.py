"""Selections, references, folders, joins with rules, grounding and folds, on small rows."""

from __future__ import annotations

import threading
import time

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from boxwood.operators import clustering, evidence, focus, grounding, joins, meaning, sets
from boxwood.operators.trees import parse

SOURCE = "import os\nfrom a import load\n\ndef run(path):\n    text = load(path)\n    # load nothing else\n    return 'load', text\n\nclass Box:\n    def load(self):\n        return self.load\n"


def test_references_by_syntax():
    got = focus.syntactic_references(SOURCE, "load")
    assert got == [(2, 15, "import"), (5, 12, "call"), (10, 9, "definition"), (11, 21, "reference")]
    assert all(SOURCE.split("\n")[line - 1][col - 1 :].startswith("load") for line, col, _ in got)
    assert focus.syntactic_references(SOURCE, "l") == [] and focus.syntactic_references("def (", "load") is None
    assert focus.syntactic_references(SOURCE.replace("\n", "\r\n"), "load") == got and focus.syntactic_references("(" * 50_000, "load") is None
    box = parse("x = 1\r\ny = load(2)\r\n", "python").children[1]
    assert (box.start, box.end, box.kind) == (7, 18, "assignment") and parse("(" * 50_000, "python").kind == ""


def test_references_fall_back_to_lines(spark):
    docs = spark.createDataFrame([(1, SOURCE), (2, "load ( it"), (3, None)], "k long, t string")
    got = focus.references(docs, "k", "t", "load")
    assert sorted((r["k"], r["line"]) for r in got.collect()) == [(1, 2), (1, 5), (1, 10), (1, 11), (2, 1)]
    assert [(r["k"], r["uses"]) for r in focus.by_file(got, "k", 2).orderBy("place").collect()] == [(2, 1), (1, 4)]


def test_selection_context():
    root = parse(SOURCE, "python")
    got = focus.selection_context(SOURCE, root, (5, 5), (5, 22), selected="text = load(path)")
    assert got["highlight"]["source"] == "text = load(path)" and [u["label"].split(":")[0] for u in got["focus"]] == ["Assign"]
    assert got["ancestors"][-1]["heading"] == "def run(path):" and got["imports"] == ["import os", "from a import load"] and len(got["fingerprint"]) == 64
    assert len(focus.selection_context(SOURCE, root, (1, 1), (4, 4))["focus"]) == 3  # a highlight over several units
    for start, end, selected, why in [((5, 5), (5, 5), None, "empty"), ((99, 1), (99, 2), None, "line"), ((1, 50), (1, 51), None, "column"), ((5, 5), (5, 9), "gone", "stale")]:
        with pytest.raises(ValueError, match=why):
            focus.selection_context(SOURCE, root, start, end, selected=selected)
    small = focus.selection_context(SOURCE, root, (4, 1), (7, 10), budget=40)
    assert small["used"] <= 40 and small["highlight"]["truncated"]


def test_overview_shares_its_budget():
    got = focus.overview([("a.py", SOURCE, parse(SOURCE, "python"))] * 14, 1_200)
    assert got["files_omitted"] == 2 and len(got["files"]) == 12 and got["used"] <= 1_200
    assert max(len(u["source"]) for f in got["files"] for u in f["units"]) <= 1_200 // 12 // 4


def test_directory(spark):
    rows = spark.createDataFrame([(p,) for p in ("z.py", "a/x.py", "a/b/y.py", "a/a.py", "b/c.py")], "path string")
    got = [(r["node"], r["last"]) for r in focus.directory(rows, "path").orderBy("place").collect()]
    assert got == [("a", False), ("a/b", False), ("a/b/y.py", True), ("a/a.py", False), ("a/x.py", True), ("b", False), ("b/c.py", True), ("z.py", True)]


def test_strict_lookup_fails(spark):
    rows, known = spark.createDataFrame([(1,), (9,)], "k int"), spark.createDataFrame([(1, "a")], "k int, v string")
    assert joins.lookup(rows.where("k = 1"), known, "k").first()["v"] == "a"
    with pytest.raises(PySparkException, match="no record for k 9"):
        joins.lookup(rows, known, "k").collect()


def test_as_of_keeps_nulls_and_ties(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 5), (None, 5)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 1.0), ("a", 5, 7.0), ("a", 5, None), ("b", 6, 2.0), (None, 1, 3.0)], "k string, t int, v double")
    got = {(r["k"], r["t"]): r["v"] for r in joins.as_of(left, right, ["k"], "t", ["v"]).collect()}
    assert got == {("a", 5): 7.0, ("a", 1): None, ("b", 5): None, (None, 5): 3.0}


def test_closure(spark):
    sets_ = {"a": "123", "b": "23", "c": "234", "d": "9", "e": "34", "f": "31"}
    rows = spark.createDataFrame([(k, m) for k, v in sets_.items() for m in v], "id string, member string")
    got = {(r["a"], r["b"]): (r["relation"], r["closure"]) for r in sets.closure(rows).collect()}
    assert len(got) == 15
    for (a, b), (_, status) in got.items():
        both = set(sets_[a]) & set(sets_[b])
        assert status == ("no_overlap" if not both else "closed" if both in map(set, sets_.values()) else "open"), (a, b)
    assert got["a", "c"] == ("partial", "closed") and got["a", "b"] == ("superset", "closed")


def test_cluster_reviews(spark):
    def errors(**over):
        row = {"who": "r1", "verdict": "accept", "inc": ["a", "b"], "exc": ["c"], "mem": ["a", "b", "c"], "name": "boxes"} | over
        df = spark.createDataFrame([tuple(row.values())], "who string, verdict string, inc array<string>, exc array<string>, mem array<string>, name string")
        return df.select(evidence.cluster_review_errors(*map(F.col, row)).alias("e")).first()["e"]

    assert errors() == [] and errors(verdict="maybe") == ["verdict"] and errors(who="-x") == ["reviewer_id"]
    assert errors(exc=["b", "c"]) == ["overlap"] and errors(exc=[]) == ["not_reviewed"] and errors(inc=["a", "b", "z"]) == ["not_members"]
    assert errors(inc=["a"], exc=["b", "c"]) == ["too_few"] and errors(name=None) == ["name"] and errors(inc=None, exc=None, verdict="reject") == ["not_reviewed"]


def groups(seed=0, n=30, spread=0.05):
    rng = np.random.default_rng(seed)
    centers = np.linalg.qr(rng.normal(size=(8, 8)))[0][:3]
    return np.concatenate([c + rng.normal(scale=spread, size=(n, 8)) for c in centers]), np.repeat(np.arange(3), n)


def test_splits_are_found_and_gated():
    x, truth = groups()
    terms = [[f"t{k}", "all"] for k in truth]
    split = grounding.best_split(x, [0.2, 0.4], terms)
    assert split.accepted and [len(g) for g in split.groups] == [30, 30, 30] and split.gain > 0.5 and split.stability > 0.9
    assert all(len(set(truth[g])) == 1 for g in split.groups) and len(split.rest) == 0
    assert grounding.best_split(x, [0.2], [["same"]] * 90) is None  # names don't tell the groups apart
    assert grounding.best_split(x, [0.2], gates=grounding.Gates(least=40)) is None
    tree = grounding.split_tree(x, [0.2, 0.4], terms)
    assert [t[:4] for t in tree] == [("r", "", 0, 90), ("r.0", "r", 1, 30), ("r.1", "r", 1, 30), ("r.2", "r", 1, 30)]


def test_partitions_and_sweeps():
    x, truth = groups()
    best = grounding.partitions(x, repeats=3)[0]
    assert best[1] == 3 and best[6] and best[2] == 1.0 and best[5] == 1.0
    assert grounding.density_sweep(x)[0][2] == 3 and len(grounding.density_sweep(x)) == 12
    assert grounding.partitions(x[:2]) == [] and grounding.gap_clusters(x[:0], [], 0.3) == []
    got = grounding.gap_clusters(x, list(range(90)), 0.3)
    assert [n for _, n in got] == [30, 30, 30] and [truth[m] for m, _ in got] == [0, 1, 2]


def test_secondary_parents():
    a, b = np.eye(4)[0], np.eye(4)[1]
    x = np.stack([a, a + 0.1 * np.eye(4)[2], b, b + 0.1 * np.eye(4)[2], np.eye(4)[3], a + b])
    rows = grounding.hierarchy_with_secondary(x, 0.2, margin=0.5)
    kinds = {(c, k) for c, _, _, k in rows}
    assert {(0, "primary"), (1, "primary"), (2, "primary"), (3, "primary")} <= kinds and (5, "primary") not in kinds and not any(k == "secondary" and c < 4 for c, k in kinds)


def test_trimmed_centroid_and_pairs():
    x, _ = groups(n=10)
    own = np.concatenate([x[:10], -x[:1]])
    u = clustering.unit_rows(x[:10])
    assert grounding.trimmed_centroid(own, 0.1) @ clustering.unit_rows(u.mean(axis=0)[None, :])[0] > 0.999
    direct = np.mean([(u[i] @ u[j]) for i in range(10) for j in range(10) if i != j])
    assert grounding.mean_pair(u) == pytest.approx(direct)
    mean, p10 = grounding.bootstrap_alignment(u)
    assert 0.9 < p10 <= mean <= 1


def test_expansion_moves_the_centroid(spark):
    rows = [("a", i, [float(np.cos(i / 8)), float(np.sin(i / 8))]) for i in range(3)]
    pool = [(i, [float(np.cos(i / 8)), float(np.sin(i / 8))]) for i in range(3, 12)]
    got = grounding.expand_rounds(spark.createDataFrame(rows, "group string, id int, v array<double>"), spark.createDataFrame(pool, "id int, v array<double>"), slack=0.05)
    by = {r["id"]: r["round"] for r in got.collect()}
    assert by and set(by.values()) >= {1, 2} and sorted(by) == list(range(3, 3 + len(by))) and [by[i] for i in sorted(by)] == sorted(by.values())


def test_windows_hold_whole_texts(spark):
    rows = spark.createDataFrame([(1, "abcdefg"), (2, ""), (3, "xyz")], "k int, t string")
    got = {r["k"]: (r["windows"], r["summary"]) for r in meaning.windowed(rows, "k", "t", 3, lambda c: c, lambda s: F.array_join(s, "|")).collect()}
    assert got == {1: (3, "abc|def|g"), 2: (1, ""), 3: (1, "xyz")}


def test_folders_sum_up_their_children(spark):
    rows = spark.createDataFrame([("a/x", "1"), ("a/b/y", "2"), ("a/b/z", "3"), ("w", "4")], "path string, bare string")
    got = {r["folder"]: r["summary"] for r in meaning.folder_summaries(rows, "path", "bare", lambda s: F.concat(F.lit("("), F.array_join(s, ","), F.lit(")"))).collect()}
    assert got == {"a": "((2,3),1)", "a/b": "(2,3)"}


def test_gate_lets_in_by_turn():
    gate, inside, order, most = meaning.Gate(2), [0], [], [0]

    def work(k):
        with gate:
            inside[0] += 1
            most[0] = max(most[0], inside[0])
            order.append(k)
            time.sleep(0.02)
            inside[0] -= 1

    threads = [threading.Thread(target=work, args=(k,)) for k in range(8)]
    for t in threads:
        t.start()
        time.sleep(0.002)
    for t in threads:
        t.join(5)
    assert most[0] == 2 and order == list(range(8))


def test_overlapping_calls_are_one():
    flights, made, got = meaning.Flights(), [], []

    def make():
        time.sleep(0.05)
        made.append(1)
        return len(made)

    threads = [threading.Thread(target=lambda: got.append(flights.call("k", make))) for _ in range(5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(5)
    assert got == [1] * 5 and flights.call("k", make) == 2
    with pytest.raises(ZeroDivisionError):
        flights.call("x", lambda: 1 / 0)
    assert flights.call("x", lambda: 3) == 3


def test_trees_cluster_as_pairs_do(spark):
    from boxwood.operators import changes, retrieval

    rng = np.random.default_rng(3)

    def tree(depth):
        return [str(rng.integers(0, 2)), [tree(depth - 1) for _ in range(rng.integers(0, 4))] if depth else []]

    import json

    texts = [json.dumps(tree(2)) for _ in range(60)]
    got = {r["tree"]: (r["cluster"], r["support"]) for r in retrieval.tree_clusters(spark.createDataFrame([(t,) for t in texts], "tree string"), 0.75).collect()}
    distinct = sorted(set(texts))
    low = {t: t for t in distinct}
    near = [(a, b) for a in distinct for b in distinct if a < b and changes.larger_similarity(retrieval.tree_of(a), retrieval.tree_of(b)) >= 0.75]
    while moved := [(a, b) for a, b in near if low[a] != low[b]]:
        for a, b in moved:
            low[a] = low[b] = min(low[a], low[b])
    assert got == {t: (low[t], texts.count(t)) for t in distinct} and len(set(low.values())) < len(distinct)


def test_patterns_find_their_hosts(spark):
    import json

    from boxwood.operators import changes, retrieval

    versions = {1: ("f(x)\n", "f(x)\ng(y)\n"), 2: ("f(x)\n", "h(x)\n"), 3: ("f(x)\ng(y)\n", "f(x)\n")}
    rows = [(k, json.dumps(changes.edit_script(a, b, "python"))) for k, (a, b) in versions.items()]
    pattern = [("added", [(0, "action:insert-tree"), (1, "after:expression_statement"), (2, "after:call")], [(0, 1, "affects"), (1, 2, "child")])]
    found = retrieval.hosts_of(spark.createDataFrame(rows, "doc_id long, actions string"), pattern)
    assert [(r["doc_id"], r["constraint"], r["exact"]) for r in found.collect()] == [(1, True, True)]
    with pytest.raises(ValueError):
        retrieval.hosts_of(found, pattern * 1_001)


def test_hierarchies_without_a_way_down_are_told(spark):
    from boxwood.operators import graphs

    nodes = spark.createDataFrame([("r", None, 0), ("a", "r", 1), ("b", "c", 2), ("c", "b", 1)], "id string, parent string, depth int")
    got = {r["check"]: r["broken"] for r in graphs.check_hierarchy(nodes, spark.createDataFrame([], "id string, member int")).collect()}
    assert got["reachable"] == 2 and got["parent_exists"] == 0 and got["depth"] == 1

"""Frequent subgraphs against enumeration of all connected edge sets."""

from __future__ import annotations

import itertools
import random
from collections import defaultdict

from boxwood.operators import changes, subgraphs


def test_codes_tell_isomorphism():
    r = random.Random(0)
    for _ in range(200):
        n = r.randint(2, 5)
        labels = [r.choice("ab") for _ in range(n)]
        edges = sorted({(a, b, "e") for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(5)) if a != b})
        p = list(range(n))
        r.shuffle(p)
        moved = [None] * n
        for i, x in enumerate(p):
            moved[x] = labels[i]
        again = tuple(sorted((p[a], p[b], x) for a, b, x in edges))
        assert subgraphs.canonical((tuple(labels), tuple(edges))) == subgraphs.canonical((tuple(moved), again))
        other = ["b" if i == 0 and x == "a" else x for i, x in enumerate(labels)]
        same = changes.contains((list(enumerate(labels)), edges), (list(enumerate(other)), edges))
        assert (subgraphs.canonical((tuple(labels), tuple(edges))) == subgraphs.canonical((tuple(other), tuple(edges)))) == same


def brute(graphs, most):
    """code: (graphs, edges) over all connected edge sets of up to ``most`` edges."""
    hosts, size = defaultdict(set), {}
    for g, (labels, edges) in graphs.items():
        for n in range(1, most + 1):
            for own in itertools.combinations(edges, n):
                seen, todo = {own[0][0]}, True
                while todo:
                    todo = {v for a, b, _ in own for v in (a, b) if (a in seen) != (b in seen)} - seen
                    seen |= todo
                if all(a in seen for a, _, _ in own):
                    code = subgraphs.canonical(subgraphs.shape_of([{"src": a, "dst": b, "by": x, "sl": labels[a], "dl": labels[b]} for a, b, x in own]))
                    hosts[code].add(g)
                    size[code] = n
    return hosts, size


def test_all_frequent_patterns_are_found(spark):
    r = random.Random(7)
    graphs = {}
    for g in range(8):
        labels = [r.choice("aab") for _ in range(6)]
        edges = sorted({(a, b, r.choice("xy")) for a, b in ((r.randrange(6), r.randrange(6)) for _ in range(7)) if a != b})
        graphs[g] = (labels, edges)
    v = spark.createDataFrame([(g, i, x) for g, (labels, _) in graphs.items() for i, x in enumerate(labels)], "graph long, id long, label string")
    e = spark.createDataFrame([(g, a, b, x) for g, (_, edges) in graphs.items() for a, b, x in edges] + [(0, 1, 1, "loop")], "graph long, src long, dst long, label string")
    patterns, grown = subgraphs.frequent_subgraphs(v, e, 3, most_edges=3)
    hosts, size = brute(graphs, 3)
    want = {c: len(h) for c, h in hosts.items() if len(h) >= 3}
    assert {x["code"]: x["support"] for x in patterns.collect()} == want
    closed = {x["code"] for x in subgraphs.closed_subgraphs(patterns, grown).collect()}
    pairs = {(x["parent"], x["code"]) for x in grown.collect()}
    assert closed == {c for c in want if not any(p == c and want[q] == want[c] for p, q in pairs)}
    assert all(size[q] == size[p] + 1 for p, q in pairs)


def test_twins_change_no_pattern(spark):
    """Graphs full of equal branches, some of them in others: the same patterns, supports and growth
    as over all connected edge sets."""
    r = random.Random(11)
    graphs = {}
    for g in range(6):
        labels, edges = ["a"], []

        def hang(at, depth):
            for _ in range(r.randint(1, 3)):
                labels.append(r.choice("ab"))
                v = len(labels) - 1
                edges.append((at, v, "x") if r.random() < 0.8 else (v, at, "x"))
                if depth < 2 and len(labels) < 9 and r.random() < 0.6:
                    hang(v, depth + 1)

        hang(0, 0)
        if g % 2:
            edges.append((1, len(labels) - 1, "y"))
        graphs[g] = (labels, sorted({e for e in edges if e[0] != e[1]}))
    v = spark.createDataFrame([(g, i, x) for g, (labels, _) in graphs.items() for i, x in enumerate(labels)], "graph long, id long, label string")
    e = spark.createDataFrame([(g, a, b, x) for g, (_, edges) in graphs.items() for a, b, x in edges], "graph long, src long, dst long, label string")
    hosts, _ = brute(graphs, 4)
    patterns, grown = subgraphs.frequent_subgraphs(v, e, 2, most_edges=4)
    want = {c: len(h) for c, h in hosts.items() if len(h) >= 2 and c.split(" ; ")[0].count("|") < 6}
    assert {x["code"]: x["support"] for x in patterns.collect()} == want
    pairs = {(x["parent"], x["code"]) for x in grown.collect()}
    steps = {(c, d) for c, d in growth(graphs, 4) if c in want and d in want}
    assert pairs == steps


def growth(graphs, most):
    """(parent, code) of all connected edge sets less one edge that are still connected."""
    out = set()
    for labels, edges in graphs.values():
        def code(own):
            return subgraphs.canonical(subgraphs.shape_of([{"src": a, "dst": b, "by": x, "sl": labels[a], "dl": labels[b]} for a, b, x in own]))

        def whole(own):
            seen, before = {own[0][0]}, 0
            while len(seen) > before:
                before = len(seen)
                seen |= {v for a, b, _ in own if a in seen or b in seen for v in (a, b)}
            return all(a in seen for a, _, _ in own)

        for n in range(2, most + 1):
            for own in itertools.combinations(edges, n):
                if whole(own):
                    parts = [own[:i] + own[i + 1 :] for i in range(n)]
                    out |= {(code(p), code(own)) for p in parts if whole(p)}
    return out


def test_a_star_has_few_embeddings():
    star = [(0, i, "x", "a", "b") for i in range(1, 1001)]
    assert [i for i, _, _ in subgraphs.twins(star, 3)] == [0, 1, 2]
    assert subgraphs.twins(star, 3)[2] == (2, [2], [3])

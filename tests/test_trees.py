"""Structure trees: parsers, cuts, tilings, frontiers, folders."""

from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from boxwood.operators import trees

TEXTS = st.text(alphabet="ab {}[]();,:\n\t\"'/*1é", max_size=200)


def nodes(root):
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo.extend(n.children)
    return out


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 12), st.sampled_from([None, 0, 2]))
def test_cuts_tile_the_text(body, granularity, spread):
    root = trees.build(body, trees.parse(body, None))
    for n in nodes(root):
        assert 0 <= n.start <= n.end <= len(body)
        assert len(n.children) <= 2 or n is root
        assert all(n.start <= c.start and c.end <= n.end for c in n.children)
    frontier = trees.cut(root, granularity, spread)
    assert len(frontier) <= max(1, granularity) + 1
    spans = trees.cover(body, root, frontier)
    assert spans[0][0] == 0 and spans[-1][1] == len(body)
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_more_granularity_never_gives_fewer_boxes():
    body = "\n".join("  " * random.Random(i).randint(0, 3) + f"line {i} (a, b);" for i in range(60))
    root = trees.build(body, trees.parse(body, None))
    sizes = [len(trees.cut(root, g, 0)) for g in range(1, 40)]
    assert sizes == sorted(sizes) and sizes[0] == 1


def test_json_boxes_have_ranks_and_paths():
    body = '{"a": 1, /* note */ "b": {"c": [1, 2,],}}'
    root = trees.json_tree(body)
    a, b = root.children
    assert (a.rank, a.label) == (2, "a") and (b.rank, b.label) == (1, "b")
    inner = [n for n in nodes(root) if n.label == "b ▸ c"]
    assert inner and body[inner[0].start : inner[0].end].startswith('"c"')


def test_unparsable_text_falls_through():
    assert trees.parse('{"a": ', "json").label == "(file)"
    assert trees.parse("def f(:\n  pass", "python").label == "(file)"
    assert any(n.label.startswith("FunctionDef") for n in nodes(trees.parse("def f(x):\n    return x\n", "python")))


def test_node_table(spark):
    docs = spark.createDataFrame([(1, "a\n  b\n  c\nd(e, f)"), (2, None), (3, "")], "doc_id long, text string")
    rows = trees.node_table(docs, "doc_id", "text").collect()
    assert {r["doc_id"] for r in rows} == {1, 3}
    ids = {(r["doc_id"], r["id"]): r for r in rows}
    assert all(r["parent"] is None or (r["doc_id"], r["parent"]) in ids for r in rows)
    assert all(len(r["path"]) == r["depth"] for r in rows)


def tree_rows(spark):
    """r over x (0-10: p 0-4, q 5-9) and y (11-20: s 11-14, t 15-19), y synthetic."""
    rows = [("r", None, 0, 20, 0, True, []), ("x", "r", 0, 10, 1, True, ["r"]), ("y", "r", 11, 20, 1, False, ["r"])]
    rows += [("p", "x", 0, 4, 2, True, ["r", "x"]), ("q", "x", 5, 9, 2, True, ["r", "x"]), ("s", "y", 11, 14, 2, True, ["r", "y"]), ("t", "y", 15, 19, 2, True, ["r", "y"])]
    return spark.createDataFrame([(1, *r) for r in rows], "doc long, id string, parent string, start long, end long, depth int, semantic boolean, path array<string>")


def frontier(spark, *marks):
    m = spark.createDataFrame([(1, x) for x in marks], "doc long, id string")
    return sorted(r["id"] for r in trees.minimal_frontier(tree_rows(spark), m, "doc").collect())


def test_minimal_frontier(spark):
    assert frontier(spark) == ["r"]
    assert frontier(spark, "r") == ["r"]
    assert frontier(spark, "x") == ["x", "y"]
    assert frontier(spark, "p") == ["p", "q", "y"]
    assert frontier(spark, "p", "x") == ["p", "q", "y"]  # a mark above another gives way
    assert frontier(spark, "gone") == ["r"]
    assert frontier(spark, "y") == ["r"]  # synthetic: its nearest real ancestor
    assert frontier(spark, "p", "t") == ["p", "q", "s", "t"]


def test_tightest_and_lowest_common(spark):
    spans = spark.createDataFrame([(1, 1, 3), (1, 3, 6), (1, 9, 12), (1, 5, 5)], "doc long, at long, upto long")
    got = {(r["at"], r["upto"]): r["id"] for r in trees.tightest(tree_rows(spark), spans, "doc").collect()}
    assert got == {(1, 3): "p", (3, 6): "x", (9, 12): "r", (5, 5): "q"}
    for picked, want in ((("p", "q"), "x"), (("p",), "p"), (("p", "s"), "r"), (("p", "x"), "x")):
        m = spark.createDataFrame([(1, x) for x in picked], "doc long, id string")
        assert trees.lowest_common_ancestor(tree_rows(spark), m, "doc").first()["id"] == want


def test_semantic_children_skip_synthetic_nodes(spark):
    rows = trees.semantic_children(tree_rows(spark), "doc", 2).collect()
    assert sorted((r["parent"], r["id"]) for r in rows) == [("r", "s"), ("r", "x"), ("x", "p"), ("x", "q")]
    assert all(r["truncated"] == (r["parent"] == "r") for r in rows)


def test_split_windows_cover():
    body = "".join("x" * (i % 90) + "\n" for i in range(200))
    spans = trees.split_windows(body, 500)
    assert spans[0][0] == 0 and spans[-1][1] == len(body) and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert trees.split_windows("", 500) == [(0, 0)]


def test_folder_hash_follows_content(spark):
    def top(h):
        files = spark.createDataFrame([("a/b/x", "1"), ("a/b/y", h), ("a/z", "3")], "path string, hash string")
        return {r["folder"]: (r["hash"], r["files"]) for r in trees.folders(files, "path", "hash").collect()}

    one, two = top("2"), top("4")
    assert one["a"][1] == 3 and one["a/b"][1] == 2
    assert one["a"][0] != two["a"][0] and one == top("2")


def test_coverage_matches_the_loop(spark):
    body = "a(b) ;  c, d]}  e"
    frontier_rows = spark.createDataFrame([(1, "n0", 0, 1, 0, len(body)), (1, "n1", 8, 9, 0, len(body)), (1, "n2", 16, 17, 0, len(body))], "doc long, id string, start long, end long, lo long, hi long")
    got = [(r["start"], r["end"]) for r in trees.coverage(frontier_rows, spark.createDataFrame([(1, body)], "doc long, body string"), "doc", "body").orderBy("start").collect()]
    root = trees.Box(0, len(body), "")
    assert got == trees.cover(body, root, [trees.Box(0, 1, ""), trees.Box(8, 9, ""), trees.Box(16, 17, "")])


def test_folder_chain(spark):
    rows = trees.folder_chain(spark.createDataFrame([("a/b/c",), ("x",)], "path string"), "path").orderBy("level").collect()
    assert [(r["level"], r["folder"]) for r in rows] == [(0, "a"), (1, "a/b")]

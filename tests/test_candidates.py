"""Token diffs, boundaries, atoms, candidates and static features, by small cases and brute force."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest

from boxwood.operators import candidates, changes
from boxwood.operators.trees import parse

OLD = "def f(x):\n    if x:\n        run(x, 'a')\n        stop(1)\n    return x\n"
NEW = "def f(x):\n    if x:\n        go(x, 'a')\n        stop(1)\n        log(x)\n    return x\n"


def test_token_diff_isolates_what_changed():
    assert changes.token_diff("return oldValue;", "return newValue;") == ([("same", "return "), ("removed", "oldValue"), ("same", ";")], [("same", "return "), ("added", "newValue"), ("same", ";")])
    assert changes.token_diff("", "a b") == ([], [("added", "a b")]) and changes.token_diff("a", "a") == ([("same", "a")], [("same", "a")])


def test_token_diff_is_a_longest_common_subsequence():
    rng = np.random.default_rng(0)
    for _ in range(60):
        a, b = (" ".join(rng.choice(list("xyz"), int(rng.integers(0, 7)))) for _ in range(2))
        before, after = changes.token_diff(a, b)
        assert "".join(t for _, t in before) == a and "".join(t for _, t in after) == b
        same = "".join(t for k, t in before if k == "same")
        assert same == "".join(t for k, t in after if k == "same")
        x, y = changes._WORD.findall(a), changes._WORD.findall(b)
        most = max(n for n in range(len(x) + 1) for c in {tuple(x[i] for i in at) for at in combinations(range(len(x)), n)} if _inside(c, y))
        assert len(changes._WORD.findall(same)) >= most or len(same) >= most


def _inside(c, y):
    it = iter(y)
    return all(any(t == u for u in it) for t in c)


def test_side_by_side():
    rows, stats = changes.side_by_side("const timeout = 1000;\nrun();\ncleanup();", "const timeout = 5000;\nlog('start');\nrun();", None)
    assert stats == {"added": 2, "removed": 2, "modified": 1} and [r["kind"] for r in rows] == ["modified", "added", "same", "removed"]
    assert ("removed", "1000") in rows[0]["before"] and ("added", "5000") in rows[0]["after"]
    rows, _ = changes.side_by_side("\n".join("abcz") + "\nold\n" + "\n".join("defg"), "\n".join("abcz") + "\nnew\n" + "\n".join("defg"), 1)
    assert [r["kind"] for r in rows] == ["skip", "same", "modified", "same", "skip"]


def test_boundaries():
    up = lambda *kinds: {"side": "after", "kind": "leaf", "start": 9, "end": 10, "ancestors": [{"kind": k, "start": i, "end": 20 - i} for i, k in enumerate(kinds)]}
    assert changes.anchor(up("argument_list", "call", "return_statement", "module"))["kind"] == "return_statement"
    assert changes.anchor(up("call", "module"))["kind"] == "call" and changes.anchor(up("module"))["kind"] == "module" and changes.anchor(up())["kind"] == "leaf"
    parts = changes.components(changes.edit_script(OLD, NEW, "python"))
    assert {p["kind"] for p in parts} <= {"expression_statement", "if_statement", "function_definition"} and sum(len(p["actions"]) for p in parts) == len(changes.edit_script(OLD, NEW, "python"))


def test_atoms_do_not_depend_on_names():
    actions = changes.edit_script(OLD, NEW, "python")
    plain = changes.atoms(actions)
    assert any(a.startswith("node:insert-tree>call") for a in plain) and any(a.startswith("frame:") for a in plain) and not any(a.startswith("anchor:") for a in plain)
    assert sum(a.startswith("component_count:") for a in plain) == 1
    assert changes.invariance(actions, set(plain)) == (True, True)
    named = changes.atoms(actions, anchors=True)
    assert "anchor:identifier=log" in named and changes.invariance(actions, {"anchor:identifier=log"}, True) == (True, False)
    assert "context_anchor:log" in changes.atoms(actions, evidence="log(x)")
    assert changes.satisfies(actions, {"insert-tree"}, {"call"}) and not changes.satisfies(actions, {"insert-tree"}, {"class_definition"})


def test_excerpts_show_both_sides():
    found = changes.excerpts(changes.edit_script(OLD, NEW, "python"), OLD, NEW, pad=0)
    assert "log(x)" in found["after"] and "run" in found["before"]


def test_distance_bound():
    rng = np.random.default_rng(1)

    def tree(depth):
        return (str(rng.integers(0, 3)), tuple(tree(depth - 1) for _ in range(rng.integers(0, 3))) if depth else ())

    for _ in range(100):
        a, b = tree(3), tree(3)
        assert changes.least_distance(changes.label_profile(a), changes.label_profile(b)) <= changes.tree_distance(a, b)
        assert changes.larger_similarity(a, a) == 1.0


@pytest.mark.parametrize("n", range(8))
def test_meeting_places_are_those_of_all_subsets(n):
    rng = np.random.default_rng(n)
    side = candidates._Side(OLD + NEW.replace("f(", f"g{n}("), "python")
    picked = {int(i) for i in rng.choice(np.arange(1, len(side.nodes)), 5, replace=False)}

    def meet(own):
        common = set.intersection(*({i, *side.above(i)} for i in own))
        return max(common, key=lambda i: side.depths[i])

    lowest, some = side.meets(picked)
    assert lowest == meet(picked)
    assert some == {meet(own) for k in range(2, 6) for own in combinations(picked, k)}


def test_candidate_universe():
    found = candidates.candidate_universe(OLD, NEW, "python")
    assert [c["rank"] for c in found] == list(range(len(found))) and found[0]["roles"][0] == "direct_edit"
    new = [c for c in found if c["side"] == "after" and "log" in NEW[c["start"] : c["end"]] and "direct_edit" in c["roles"]]
    assert new and new[0]["sign"] == "add" and new[0]["add"] == 1
    one = candidates.candidate_universe(OLD, OLD.replace("stop(1)", "stop(2)"), "python")
    assert {r for c in one for r in c["roles"]} <= {"direct_edit", "path", "single_edit_ancestor"} and all(c["sign"] == "neutral" for c in one)
    assert candidates.candidate_universe(OLD, OLD, "python") == []


def test_static_features():
    got = candidates.static_features(OLD, parse(OLD, "python"), ("run", "stop", "split"))
    assert {"role:function", "role:call", "edge:conditional>call", "path:function>conditional>call", "count:call:2+", "string_api:run", "string_api:stop"} <= set(got)
    assert "count:call:5+" not in got and "string_api:split" not in got

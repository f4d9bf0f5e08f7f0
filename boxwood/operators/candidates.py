"""What a change may be about: candidate nodes with their roles and signs, and roles in a source."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

from ..functions.text import ROLES
from .changes import edit_script
from .trees import Box, parse

_ROLE = [(name, re.compile(pattern)) for name, pattern in ROLES]


def role_of(kind: str) -> str | None:
    """The role that a node type has in any language, or none."""
    return next((name for name, pattern in _ROLE if pattern.search(kind)), None)


def static_features(text: str, root: Box, apis: tuple[str, ...] = ()) -> list[str]:
    """Features of a source's structure: the roles in it, with the one and the two nearest roles
    above, string functions that are called, and whether a role occurs twice or five times."""
    counts: Counter = Counter()
    found: set[str] = set()
    todo: list[tuple[Box, tuple[str, ...]]] = [(root, ())]
    while todo:
        box, above = todo.pop()
        role = role_of(box.kind)
        if role:
            counts[role] += 1
            found.add(f"role:{role}")
            chain = (*above, role)[-3:]
            if len(chain) > 1:
                found.add(f"edge:{chain[-2]}>{role}")
            if len(chain) > 2:
                found.add("path:" + ">".join(chain))
            if role == "call" and apis:
                head = text[box.start : min(box.end, box.start + 220)].lower()
                found |= {f"string_api:{a}" for a in apis if re.search(rf"(?:\.|\b){re.escape(a)}\s*\(", head)}
            above = chain
        todo.extend((c, above) for c in box.children)
    return sorted(found | {f"count:{r}:{n}+" for r, k in counts.items() for n in (2, 5) if k >= n})


class _Side:
    """The nodes of one version in preorder, with parents and depths."""

    def __init__(self, text: str, language: str | None, root: Box | None = None):
        self.nodes: list[tuple[int, int, str]] = []
        self.parents: list[int] = []
        self.depths: list[int] = []
        todo: list[tuple[Box, int, int]] = [(root or parse(text, language), -1, 0)]
        while todo:
            box, parent, depth = todo.pop()
            kind = box.kind or ("file" if parent < 0 else "group" if box.children else "leaf")
            at = len(self.nodes)
            self.nodes.append((box.start, box.end, kind))
            self.parents.append(parent)
            self.depths.append(depth)
            todo.extend((c, at, depth + 1) for c in reversed(box.children))
        self.at = {}
        for i, n in enumerate(self.nodes):
            self.at.setdefault(n, i)

    def above(self, at: int) -> list[int]:
        out = []
        while (at := self.parents[at]) >= 0:
            out.append(at)
        return out

    def meets(self, picked: set[int]) -> tuple[int, set[int]]:
        """The lowest common ancestor of all picked nodes, and those of some of them: nodes where
        two picked ones meet, that are picked themselves or are reached from two children."""
        branches: Counter = Counter()
        below = [i in picked for i in range(len(self.nodes))]
        held = Counter({i: 1 for i in picked})
        for i in range(len(self.nodes) - 1, 0, -1):  # children come after their parents
            if below[i]:
                p = self.parents[i]
                below[p] = True
                branches[p] += 1
                held[p] += held[i]
        lowest = max((i for i in range(len(self.nodes)) if held[i] == len(picked)), key=lambda i: self.depths[i])
        return lowest, {i for i, n in branches.items() if n + (i in picked) > 1}


def sign(counts: Counter) -> str:
    """add from a half of the edits on, remove above a half, else neutral."""
    total = sum(counts.values())
    return "add" if total and 2 * counts["add"] >= total else "remove" if total and 2 * counts["remove"] > total else "neutral"


def candidate_universe(old: str, new: str, language: str | None = None, actions: list[dict] | None = None) -> list[dict]:
    """Nodes of both versions that a change could be said to be about, in rank order: side, kind,
    start, end, depth, rank, roles, sign, and how many edits below add, remove or neither.

    Roles: ``direct_edit`` for what an action touches; with one such node its ancestors are
    ``single_edit_ancestor``; else on each side the ``overall_lca``, every ``subset_lca`` (where
    some of the edits meet; these are found by counting branches, so none is left out), and what
    lies on the ``path`` between.
    """
    boxes = parse(old, language), parse(new, language)
    sides = {"before": _Side(old, language, boxes[0]), "after": _Side(new, language, boxes[1])}
    seen: dict[tuple, tuple[str, int, str]] = {}
    for x in actions if actions is not None else edit_script(old, new, language, boxes):
        op = "add" if x["action"].startswith("insert") else "remove" if x["action"].startswith("delete") else "neutral"
        places = [(x["side"], x["start"], x["end"], x["kind"])]
        if op == "neutral" and x["mapped"]:
            m = x["mapped"]
            places.append(("after" if x["side"] == "before" else "before", m["start"], m["end"], m["kind"]))
        for side, *node in places:
            at = sides[side].at.get(tuple(node))
            if at is not None:
                seen[side, at, x["action"]] = (side, at, op)
    observed = list(seen.values())
    direct = {(side, at) for side, at, _ in observed}
    found: dict[tuple[str, int], tuple[tuple, set[str]]] = {}

    def add(side: str, at: int, role: str, order: tuple) -> None:
        best, roles = found.get((side, at), (order, set()))
        found[side, at] = (min(best, order), roles | {role})

    for side, at in direct:
        start, end, _ = sides[side].nodes[at]
        add(side, at, "direct_edit", (0, 0, side, start, end))
    for side, own in sides.items():
        picked = {at for s, at in direct if s == side}
        if not picked:
            continue
        if len(picked) == 1:
            (at,) = picked
            alone = len(direct) == 1
            for up, node in enumerate(own.above(at), 1):
                add(side, node, "single_edit_ancestor" if alone else "path", (1 if alone else 3, up, side, *own.nodes[node][:2]))
            continue
        lowest, some = own.meets(picked)
        add(side, lowest, "overall_lca", (1, 0, side, *own.nodes[lowest][:2]))
        for node in some - picked - {lowest}:
            add(side, node, "subset_lca", (2, own.depths[node], side, *own.nodes[node][:2]))
        nearest: dict[int, int] = {}
        for at in picked:
            for up, node in enumerate(own.above(at), 1):
                if own.depths[node] < own.depths[lowest]:
                    break
                nearest[node] = min(nearest.get(node, up), up)
        for node, up in nearest.items():
            if node not in picked:
                add(side, node, "path", (3, up, side, *own.nodes[node][:2]))
    out = []
    spans = {s: np.array([(*sides[s].nodes[i][:2], ("add", "remove", "neutral").index(op)) for t, i, op in observed if t == s], dtype=np.int64).reshape(-1, 3) for s in sides}
    for rank, ((side, at), (_, roles)) in enumerate(sorted(found.items(), key=lambda kv: kv[1][0])):
        start, end, kind = sides[side].nodes[at]
        below = spans[side]
        inside = np.bincount(below[(below[:, 0] >= start) & (below[:, 1] <= end), 2], minlength=3).tolist()
        counts = Counter(dict(zip(("add", "remove", "neutral"), inside, strict=True)))
        out.append({"side": side, "kind": kind, "start": start, "end": end, "depth": sides[side].depths[at], "rank": rank, "roles": sorted(roles), "sign": sign(counts), **{k: counts[k] for k in ("add", "remove", "neutral")}})
    return out

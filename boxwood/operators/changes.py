"""Edits between two versions of a text: matching, actions, churn, components, atoms, diffs.

The matcher is a published scheme made small: equal subtrees are matched from the top down, then
containers from the bottom up by the share of matched descendants; what is left is inserted,
deleted, updated or moved.
"""

from __future__ import annotations

import difflib
import hashlib
import re
from collections import Counter, defaultdict, deque
from functools import lru_cache
from itertools import groupby

import numpy as np

from .trees import Box, parse

#: Tokens of a line: names and numbers, runs of white space, single marks.
_WORD = re.compile(r"[\w$]+|\s+|[^\w\s$]")
#: Nodes of one action's subtree that are kept with it.
MOST_NODES = 48
#: Containers that edits are grouped by, besides statements, declarations and definitions.
BOUNDARIES = ("group", "pair", "keyword_argument", "default_parameter", "except_clause", "elif_clause", "lambda", "arrow_function", "class_body", "object", "dictionary")
_BOUNDARY = re.compile(r"(?:_statement|_declaration|_definition)$")
#: Types that say nothing: roots, and what every tree is full of.
ROOTS, GENERIC = ("file", "module", "program"), ("file", "module", "program", "leaf", "group", "block", "identifier", "expression_statement", "load", "store")
_ANCHOR = re.compile(r"[a-z_$][a-z0-9_$.-]{1,47}")
_NO_ANCHOR = ("self", "this", "true", "false", "none", "null", "undefined")


class _Node:
    """A node whose ``hash`` numbers what is equal: leaves by text, others by their children. ``all``
    is the tree in preorder, so a subtree is a slice of it; only leaves have their text."""

    __slots__ = ("all", "at", "box", "children", "hash", "height", "kind", "parent", "size", "text")

    def __init__(self, box: Box, text: str, parent: _Node | None, known: dict, order: list[_Node]):
        self.box, self.parent, self.all, self.at = box, parent, order, len(order)
        order.append(self)
        if box.children:
            self.text = ""
            self.children = [_Node(c, text, self, known, order) for c in box.children]
            self.height = 1 + max([c.height for c in self.children])
            self.hash = known.setdefault(tuple([c.hash for c in self.children]), len(known))
        else:
            self.text, self.children, self.height = text[box.start : box.end], [], 1
            self.hash = known.setdefault(self.text, len(known))
        self.size = len(order) - self.at
        self.kind = box.kind or ("file" if parent is None else "group" if self.children else "leaf")

    def walk(self) -> list[_Node]:
        return self.all[self.at : self.at + self.size]


def edit_script(old: str, new: str, language: str | None = None, boxes: tuple[Box, Box] | None = None) -> list[dict]:
    """Actions that turn ``old`` into ``new``: action, side, kind, label, start, end, size, and
    the kinds of the ancestors, nearest first. ``boxes``: both texts as they were parsed."""
    known_parts: dict = {}
    before, after = boxes or (parse(old, language), parse(new, language))
    a, b = _Node(before, old, None, known_parts, []), _Node(after, new, None, known_parts, [])
    match: dict[int, _Node] = {}
    back: dict[int, _Node] = {}

    def pair(x: _Node, y: _Node) -> None:
        match[id(x)], back[id(y)] = y, x

    same: dict[int, list[_Node]] = defaultdict(list)
    for y in b.walk():
        same[y.hash].append(y)
    for x in sorted(a.walk(), key=lambda n: (-n.height, n.box.start)):
        if id(x) in match:
            continue
        free = [y for y in same.get(x.hash, ()) if id(y) not in back]
        if free:
            y = min(free, key=lambda y: abs(y.box.start - x.box.start))
            for p, q in zip(x.walk(), y.walk(), strict=True):
                if id(p) not in match and id(q) not in back:
                    pair(p, q)
    for x in sorted(a.walk(), key=lambda n: n.height):
        if id(x) in match or not x.children:
            continue
        votes: dict[int, list] = {}
        for d in x.walk()[1:]:
            y = match[id(d)].parent if id(d) in match else None
            if y is not None and id(y) not in back:
                votes.setdefault(id(y), [0, y])[0] += 1
        if votes:
            n, y = max(votes.values(), key=lambda v: v[0])
            if 2 * n >= min(len(x.children), 4) and y.kind == x.kind:
                pair(x, y)
    if id(a) not in match and id(b) not in back:
        pair(a, b)
    peers: dict[int, deque[_Node]] = {}
    for x in a.walk():  # leaves in the same place of matched containers were updated
        if id(x) not in match and not x.children and x.parent is not None and id(x.parent) in match:
            above = match[id(x.parent)]
            if id(above) not in peers:
                peers[id(above)] = deque(y for y in above.children if not y.children)
            free = peers[id(above)]
            while free and id(free[0]) in back:
                free.popleft()
            if free:
                pair(x, free.popleft())
    out: list[dict] = []

    def note(action: str, side: str, n: _Node) -> None:
        up, p = [], n.parent
        while p is not None:
            up.append({"kind": p.kind, "start": p.box.start, "end": p.box.end})
            p = p.parent
        inside = n.all[n.at : n.at + min(n.size, MOST_NODES)] if action.endswith("-tree") else [n]
        place = {id(d): i for i, d in enumerate(inside)}
        subtree = [(i, place.get(id(d.parent), -1) if i else -1, d.kind, d.text[:48] if not d.children else "") for i, d in enumerate(inside)]
        other = (match if side == "before" else back).get(id(n))
        mapped = None if other is None else {"kind": other.kind, "start": other.box.start, "end": other.box.end}
        out.append({"action": action, "side": side, "kind": n.kind, "label": n.text[:40] if not n.children else "", "start": n.box.start, "end": n.box.end, "size": n.size, "ancestors": up, "subtree": subtree, "mapped": mapped})

    for side, tree, known in (("before", a, match), ("after", b, back)):
        word = "delete" if side == "before" else "insert"
        lost = {}  # whether nothing in a subtree is known, children before parents
        for n in reversed(tree.walk()):
            lost[id(n)] = id(n) not in known and all(lost[id(c)] for c in n.children)
        todo = [tree]
        while todo:
            n = todo.pop()
            if id(n) not in known:
                note(f"{word}-tree" if lost[id(n)] and n.children else f"{word}-node", side, n)
                if lost[id(n)]:
                    continue
            todo.extend(reversed(n.children))
    for x in a.walk():
        y = match.get(id(x))
        if y is None:
            continue
        if not x.children and x.text != new[y.box.start : y.box.end]:
            note("update-node", "before", x)
        if x.parent is not None and y.parent is not None and match.get(id(x.parent)) is not y.parent and id(x.parent) in match:
            note("move-tree", "before", x)
    return out


def churn(actions: list[dict]) -> dict:
    """Nodes added and removed (a tree counts whole, an update once each way), moves apart."""
    added = removed = moved = 0
    for x in actions:
        weight = x["size"] if x["action"].endswith("-tree") else 1
        added += weight if x["action"].startswith("insert") else x["action"].startswith("update")
        removed += weight if x["action"].startswith("delete") else x["action"].startswith("update")
        moved += x["action"].startswith("move")
    return {"added": int(added), "removed": int(removed), "moved": moved, "net": int(added - removed), "ratio": removed / added if added else None}


def boundary(kind: str) -> bool:
    return kind in BOUNDARIES or bool(_BOUNDARY.search(kind))


def anchor(action: dict) -> dict:
    """What an action belongs to: its nearest ancestor that is a boundary; else the nearest that is
    no root, the nearest at all, or itself."""
    up = action["ancestors"]
    found = next((u for u in up if boundary(u["kind"])), None) or next((u for u in up if u["kind"] not in ROOTS), up[0] if up else action)
    return {"side": action["side"], "kind": found["kind"], "start": found["start"], "end": found["end"]}


def components(actions: list[dict]) -> list[dict]:
    """Actions by what they belong to, in order of side and place."""
    groups: dict[tuple, list[int]] = defaultdict(list)
    for i, x in enumerate(actions):
        at = anchor(x)
        groups[at["side"], at["start"], at["end"], at["kind"]].append(i)
    return [{"side": s, "start": a, "end": b, "kind": k, "actions": ids} for (s, a, b, k), ids in sorted(groups.items())]


def signature(actions: list[dict]) -> str:
    """SHA-256 of the sorted tokens of the sorted components: equal shapes of change meet."""
    parts = [",".join(sorted(f"{actions[i]['action']}:{actions[i]['kind']}" for i in c["actions"])) for c in components(actions)]
    return hashlib.sha256("|".join(sorted(parts)).encode()).hexdigest()


def name_anchor(kind: str, label: str) -> str | None:
    """An atom for a leaf that is a name, by its lower-case text."""
    name = label.strip().strip("'\"").lower()
    return f"anchor:{kind}={name}" if _ANCHOR.fullmatch(name) and name not in _NO_ANCHOR else None


def atoms(actions: list[dict], *, anchors: bool = False, evidence: str | None = None) -> list[str]:
    """Structural atoms of a change: what was done to which types, under which ancestors, what the
    subtrees hold (types and edges that aren't generic), the frames around it up to the third
    ancestor, the components, and how many of these, up to three.

    ``anchors`` adds the names in subtrees, ``evidence`` the words of an excerpt. Without either
    the atoms do not depend on names.
    """
    found: set[str] = set()
    for x in actions:
        act, root = x["action"], x["kind"]
        found |= {f"action:{act}", f"root:{root}", f"edit:{act}>{root}"}
        if x["ancestors"]:
            found.add(f"context:{act}>{root}@{x['ancestors'][0]['kind']}")
        found |= {f"ancestor:{root}@{u['kind']}" for u in x["ancestors"] if u["kind"] != root}
        frames = [u["kind"] for u in x["ancestors"][:3]]
        found |= {f"frame:{act}>{f}" for f in frames}
        types = [t for _, _, t, _ in x["subtree"]]
        for _, above, kind, label in x["subtree"]:
            if anchors and label and (name := name_anchor(kind, label)):
                found |= {name} | {f"frame_{name}:{act}>{f}" for f in frames}
            if kind in GENERIC:
                continue
            found.add(f"node:{act}>{kind}")
            found |= {f"frame_node:{act}>{f}>{kind}" for f in frames}
            if above >= 0 and types[above] not in GENERIC:
                found.add(f"edge:{act}>{types[above]}>{kind}")
                found |= {f"frame_edge:{act}>{f}>{types[above]}>{kind}" for f in frames}
    parts = components(actions)
    found |= {f"component:{c['kind']}" for c in parts if c["kind"] not in GENERIC}
    if evidence is not None:
        found |= {f"context_anchor:{w.lower()}" for w in re.findall(r"[A-Za-z_$][A-Za-z0-9_$]{2,47}", evidence)}
    return sorted(found | {f"component_count:{min(len(parts), 3)}"})


def excerpt_spans(actions: list[dict], most: int = 4) -> dict[str, list[tuple[int, int]]]:
    """By side the first spans of what actions touch, distinct, in order: their nodes, and what
    these are matched with or, for what is new, their parents."""
    spans: dict[str, set[tuple[int, int]]] = {"before": set(), "after": set()}
    for x in actions:
        spans[x["side"]].add((x["start"], x["end"]))
        other = "after" if x["side"] == "before" else "before"
        if x["side"] == "before" and x["mapped"]:
            spans[other].add((x["mapped"]["start"], x["mapped"]["end"]))
    return {side: sorted(own)[:most] for side, own in spans.items()}


def excerpts(actions: list[dict], old: str, new: str, pad: int = 100, most: int = 1_200) -> dict[str, str]:
    """The texts around those spans, joined by a line of dashes."""

    def cut(text: str, a: int, b: int) -> str:
        part = text[max(0, a - pad) : b + pad]
        return part if len(part) <= most else part[:most] + "…"

    spans = excerpt_spans(actions)
    return {side: "\n---\n".join(cut(text, a, b) for a, b in spans[side]) for side, text in (("before", old), ("after", new))}


def satisfies(actions: list[dict], wanted: set[str], kinds: set[str]) -> list[int]:
    """Actions of a wanted name (any, if none is named) that touch a wanted type (likewise): in
    the subtree, the node or its ancestors."""
    out = []
    for i, x in enumerate(actions):
        types = {x["kind"], *(t for _, _, t, _ in x["subtree"]), *(u["kind"] for u in x["ancestors"])}
        if (not wanted or x["action"] in wanted) and (not kinds or kinds & types):
            out.append(i)
    return out


def constraints(vertices: list[tuple[int, str]]) -> tuple[set[str], set[str]]:
    """The actions and types that a pattern's vertices name."""
    labels = [label for _, label in vertices]
    acts = {x.split(":", 1)[1] for x in labels if x.startswith("action:")}
    return acts, {t for x in labels if x.startswith(("before:", "after:")) for t in [x.split(":", 1)[1]] if t and t not in (",", ";", ":")}


def renamed(actions: list[dict]) -> list[dict]:
    """The same change with every name and literal replaced: atoms without anchors must not move."""
    codes: dict[str, str] = {}

    def other(label: str) -> str:
        return codes.setdefault(label, f"renamed_{len(codes)}") if label else label

    return [x | {"label": other(x["label"]), "subtree": [(i, p, k, other(t)) for i, p, k, t in x["subtree"]]} for x in actions]


def invariance(actions: list[dict], clause: set[str], anchors: bool = False) -> tuple[bool, bool]:
    """Whether a clause's atoms hold for a change, and still do once its names are replaced."""
    return clause <= set(atoms(actions, anchors=anchors)), clause <= set(atoms(renamed(actions), anchors=anchors))


def change_graph(actions: list[dict]) -> tuple[list[tuple[int, str]], list[tuple[int, int, str]]]:
    """Vertices (id, label) and edges (from, to, label): actions, what they affect, the two nearest
    ancestors, and below it the children of an action's own subtree that say something."""
    vertices: list[tuple[int, str]] = []
    edges: dict[tuple[int, int, str], None] = {}
    places: dict[tuple, int] = {}

    def vertex(label: str, key: tuple | None = None) -> int:
        if key is not None and key in places:
            return places[key]
        vertices.append((len(vertices), label))
        if key is not None:
            places[key] = len(vertices) - 1
        return len(vertices) - 1

    for x in actions:
        act = vertex(f"action:{x['action']}")
        node = vertex(f"{x['side']}:{x['kind']}", (x["side"], x["start"], x["end"], x["kind"]))
        edges[act, node, "affects"] = None
        below = node
        for u in x["ancestors"][:2]:
            above = vertex(f"{x['side']}:{u['kind']}", (x["side"], u["start"], u["end"], u["kind"]))
            if above != below:
                edges[above, below, "parent"] = None
            below = above
        own = {0: node}
        for i, above, kind, _ in x["subtree"][1:]:
            if above in own and kind not in GENERIC:
                own[i] = vertex(f"{x['side']}:{kind}")
                edges[own[above], own[i], "child"] = None
    return vertices, list(edges)


def reify(vertices: list[tuple[int, str]], edges: list[tuple[int, int, str]]) -> tuple[list[tuple[int, str]], list[tuple[int, int, str]]]:
    """Directed edges as vertices of their own, with a source and a target edge each."""
    out_v, out_e = list(vertices), []
    for a, b, label in edges:
        r = len(out_v)
        out_v.append((r, f"relation:{label}"))
        out_e += [(r, a, "source"), (r, b, "target")]
    return out_v, out_e


def is_complete(vertices: list[tuple[int, str]], edges: list[tuple[int, int, str]]) -> bool:
    """A fragment with an action, something acted on, and only whole relations."""
    labels = dict(vertices)
    ends: dict[int, list[str]] = defaultdict(list)
    for a, b, label in edges:
        for v in (a, b):
            if labels[v].startswith("relation:"):
                ends[v].append(label)
    relations = [v for v, label in vertices if label.startswith("relation:")]
    return any(x.startswith("action:") for x in labels.values()) and any(x.startswith(("before:", "after:")) for x in labels.values()) and all(sorted(ends[v]) == ["source", "target"] for v in relations)


def contains(host: tuple[list, list], pattern: tuple[list, list]) -> bool:
    """Whether the pattern's labelled graph is a subgraph of the host's (monomorphism)."""
    hv, he = dict(host[0]), host[1]
    pv, pe = dict(pattern[0]), pattern[1]
    if Counter(pv.values()) - Counter(hv.values()):
        return False
    edges = {(a, b, x) for a, b, x in he}
    near: dict[int, list[tuple[int, int, str]]] = defaultdict(list)
    for a, b, x in pe:
        near[a].append((a, b, x))
        near[b].append((a, b, x))
    order = sorted(pv, key=lambda v: (-len(near[v]), v))
    by_label: dict[str, list[int]] = defaultdict(list)
    for v, label in hv.items():
        by_label[label].append(v)

    def extend(k: int, to: dict[int, int]) -> bool:
        if k == len(order):
            return True
        v = order[k]
        for w in by_label[pv[v]]:
            if w in to.values():
                continue
            to[v] = w
            if all((to[a], to[b], x) in edges for a, b, x in near[v] if a in to and b in to) and extend(k + 1, to):
                return True
            del to[v]
        return False

    return extend(0, {})


def tree_distance(a: tuple, b: tuple) -> int:
    """Edits between ordered trees of (label, children): children are aligned as sequences, an
    unmatched child costs its size."""

    @lru_cache(maxsize=None)
    def size(t: tuple) -> int:
        return 1 + sum(map(size, t[1]))

    @lru_cache(maxsize=None)
    def apart(x: tuple, y: tuple) -> int:
        row = [0]
        for c in y[1]:
            row.append(row[-1] + size(c))
        for p in x[1]:
            before, row = row, [row[0] + size(p)]
            for j, q in enumerate(y[1]):
                row.append(min(before[j + 1] + size(p), row[j] + size(q), before[j] + apart(p, q)))
        return (x[0] != y[0]) + row[-1]

    return apart(a, b)


def size_of(t: tuple) -> int:
    return 1 + sum(map(size_of, t[1]))


def label_profile(t: tuple) -> Counter:
    out, todo = Counter(), [t]
    while todo:
        label, children = todo.pop()
        out[label] += 1
        todo.extend(children)
    return out


def least_distance(a: Counter, b: Counter) -> int:
    """A bound below the distance of trees with these labels: what one has and the other lacks."""
    return max((a - b).total(), (b - a).total())


def tree_similarity(a: tuple, b: tuple) -> float:
    return 1 - tree_distance(a, b) / max(size_of(a) + size_of(b), 1)


def larger_similarity(a: tuple, b: tuple) -> float:
    """As ``tree_similarity``, in proportion to the larger tree; 0 at least."""
    return max(0.0, 1 - tree_distance(a, b) / max(size_of(a), size_of(b)))


def line_diff(old: str, new: str) -> list[tuple[str, str | None, str | None]]:
    """Side-by-side rows (kind, old line, new line): same, modified, added, removed."""
    a, b, out = old.split("\n"), new.split("\n"), []
    for tag, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if tag == "equal":
            out += [("same", x, x) for x in a[i:j]]
            continue
        n = min(j - i, m - k)
        out += [("modified", a[i + t], b[k + t]) for t in range(n)]
        out += [("removed", x, None) for x in a[i + n : j]] + [("added", None, x) for x in b[k + n : m]]
    return out


def token_diff(old: str, new: str, cells: int = 4_000_000) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """Two lines as runs of (kind, text): same and removed on the old side, same and added on the
    new one. Tokens are aligned by a longest common subsequence; beyond ``cells`` of its table what
    is between the common ends is replaced whole."""
    a, b = _WORD.findall(old), _WORD.findall(new)
    lo = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    hi = next((i for i, (x, y) in enumerate(zip(reversed(a[lo:]), reversed(b[lo:]), strict=False)) if x != y), min(len(a), len(b)) - lo)
    own, other = a[lo : len(a) - hi], b[lo : len(b) - hi]
    kept: set[int] = set()
    met: set[int] = set()
    if own and other and len(own) * len(other) <= cells:
        # Lengths of common subsequences of what begins at each pair of places: a row is the running
        # maximum, from its end, of what the row below and a pair of equal tokens give.
        codes: dict[str, int] = {}
        x, y = (np.array([codes.setdefault(t, len(codes)) for t in side], dtype=np.int32) for side in (own, other))
        rest = np.zeros((len(own) + 1, len(other) + 1), dtype=np.int32)
        for i in range(len(own) - 1, -1, -1):
            below = rest[i + 1]
            rest[i, :-1] = np.maximum.accumulate(np.maximum(below[:-1], below[1:] + (y == x[i]))[::-1])[::-1]
        i = j = 0
        while i < len(own) and j < len(other):
            if own[i] == other[j]:
                kept.add(lo + i)
                met.add(lo + j)
                i, j = i + 1, j + 1
            elif rest[i + 1, j] >= rest[i, j + 1]:
                i += 1
            else:
                j += 1

    def runs(tokens: list[str], same: set[int], word: str) -> list[tuple[str, str]]:
        kinds = ["same" if i < lo or i >= len(tokens) - hi or i in same else word for i in range(len(tokens))]
        return [(kind, "".join(t for _, t in part)) for kind, part in groupby(zip(kinds, tokens, strict=True), key=lambda x: x[0])]

    return runs(a, kept, "removed"), runs(b, met, "added")


def side_by_side(old: str, new: str, context: int | None = 3) -> tuple[list[dict], dict[str, int]]:
    """Rows with token runs where a line was modified, equal runs beyond ``context`` rows of a
    change collapsed (None: none is), and how many lines were added, removed and modified; a
    modified line is an added and a removed one too."""
    rows = []
    for kind, x, y in line_diff(old, new):
        before, after = token_diff(x, y) if kind == "modified" else ([(kind, x)] if x is not None else [], [(kind, y)] if y is not None else [])
        rows.append((kind, before, after))
    n = Counter(k for k, *_ in rows)
    shown = rows if context is None else context_rows(rows, context)
    return [{"kind": k, "before": x, "after": y} for k, x, y in shown], {"added": n["added"] + n["modified"], "removed": n["removed"] + n["modified"], "modified": n["modified"]}


def diff_stats(old: str, new: str) -> dict[str, int]:
    kinds = Counter(r[0] for r in line_diff(old, new))
    return {k: kinds[k] for k in ("added", "removed", "modified")}


def char_diff(old: str, new: str, cells: int = 4_000_000) -> list[tuple[str, str]]:
    """Runs (same, removed, added) of characters, after common ends; beyond ``cells`` of table
    the middles are replaced whole."""
    lo = 0
    while lo < min(len(old), len(new)) and old[lo] == new[lo]:
        lo += 1
    hi = 0
    while hi < min(len(old), len(new)) - lo and old[-1 - hi] == new[-1 - hi]:
        hi += 1
    a, b = old[lo : len(old) - hi], new[lo : len(new) - hi]
    out = [("same", old[:lo])] if lo else []
    if len(a) * len(b) > cells or not a or not b:
        out += [("removed", a)] * bool(a) + [("added", b)] * bool(b)
    else:
        for tag, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
            if tag == "equal":
                out.append(("same", a[i:j]))
            else:
                out += [("removed", a[i:j])] * (j > i) + [("added", b[k:m])] * (m > k)
    return out + ([("same", old[len(old) - hi :])] if hi else [])


def context_rows(rows: list[tuple], k: int = 3) -> list[tuple]:
    """Rows within k of a change; longer equal runs become one (skip, n)."""
    near = [any(r[0] != "same" for r in rows[max(0, i - k) : i + k + 1]) for i in range(len(rows))]
    out, gone = [], 0
    for row, shown in zip(rows, near, strict=True):
        if shown:
            if gone:
                out.append(("skip", gone, None))
                gone = 0
            out.append(row)
        else:
            gone += 1
    return out + ([("skip", gone, None)] if gone else [])


def s_expression(box: Box, most: int = 300) -> str:
    """A tree in brackets, before its children, cut after ``most`` nodes."""
    n = 0

    def render(b: Box) -> str:
        nonlocal n
        n += 1
        if n > most:
            return "…"
        inner = [render(c) for c in b.children if n <= most]
        return f"({b.label.split(':')[0][:20]}{''.join(' ' + x for x in inner)})"

    return render(box)

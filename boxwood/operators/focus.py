"""Evidence for a question about a place in a source: references, a selection's context, outlines.

What reads one source runs per document in Arrow batches; what compares nodes, folders and marks is
relational.
"""

from __future__ import annotations

import ast
import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..partitions import spread
from . import lines, trees
from .trees import Box
from .windows import place_over

#: Bounds of one context: nodes of a tree, units in focus, ancestors, neighbours and imports shown.
MOST_NODES, MOST_SHOWN = 20_000, 8
#: Shares of the budget for the highlight and for the units in focus, and characters of a heading
#: and of an import.
SHARE, HEADING, IMPORT = 0.4, 180, 250
MOST_FILES, MOST_UNITS = 12, 12


# ---- references --------------------------------------------------------------------------------


def syntactic_references(source: str, name: str) -> list[tuple[int, int, str]] | None:
    """(line, column, kind) of every place where Python syntax uses a name, in order; strings and
    comments hold none. None if it can't be parsed. A name of one letter has no references."""
    if len(name) < 2:
        return []
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):  # the last where nesting is too deep for the parser
        return None
    rows, found = re.split(r"\r\n|\r|\n", source), set()

    def at(line: int, byte: int) -> int:
        return len(rows[line - 1].encode()[:byte].decode(errors="ignore")) + 1

    def after(line: int, byte: int) -> int:
        """Where the name stands at or after a place on a line."""
        return rows[line - 1].find(name, at(line, byte) - 1) + 1

    called = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
    for n in ast.walk(tree):
        if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) and n.name == name:
            found.add((n.lineno, after(n.lineno, n.col_offset), "definition"))
        elif isinstance(n, ast.Name) and n.id == name:
            found.add((n.lineno, at(n.lineno, n.col_offset), "definition" if isinstance(n.ctx, ast.Store) else "call" if id(n) in called else "reference"))
        elif isinstance(n, ast.Attribute) and n.attr == name:
            found.add((n.end_lineno, at(n.end_lineno, n.end_col_offset) - len(name), "call" if id(n) in called else "reference"))
        elif isinstance(n, ast.arg) and n.arg == name:
            found.add((n.lineno, at(n.lineno, n.col_offset), "definition"))
        elif isinstance(n, ast.keyword) and n.arg == name:
            found.add((n.lineno, at(n.lineno, n.col_offset), "reference"))
        elif isinstance(n, ast.alias) and name in (n.asname, *n.name.split(".")):
            found.add((n.lineno, at(n.lineno, n.col_offset), "import"))
    return sorted(found)


def references(docs: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """(key, line, column, kind) of a name's uses: by syntax where a source is Python, else by lines
    of text, whose column is null. Null texts have none."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for k, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hits = syntactic_references(body or "", name)
                hits = [(None, None, "unparsed")] if hits is None else hits
                keys += [k] * len(hits)
                rows += hits
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string())))], names=[key, "line", "column", "kind"])

    own = docs.select(key, F.col(text).cast("string"))
    told = spread(own).mapInArrow(run, f"{key} {kind}, line long, `column` long, kind string")
    unread = docs.join(told.where("kind = 'unparsed'").select(key), key, "left_semi")
    plain = lines.references(unread, key, text, name).select(key, F.col("line").cast("long").alias("line"), F.lit(None).cast("long").alias("column"), "kind")
    return told.where("kind <> 'unparsed'").unionByName(plain)


def by_file(hits: DataFrame, key: str, origin) -> DataFrame:
    """(key, uses, definitions, first_line, place): files by their uses, the origin first."""
    files = hits.groupBy(key).agg(F.count("*").alias("uses"), F.count_if(F.col("kind") == "definition").alias("definitions"), F.min("line").alias("first_line"))
    return place_over(files, (F.col(key) != F.lit(origin)).asc(), F.col("uses").desc(), F.col(key).asc())


# ---- a selection -------------------------------------------------------------------------------


class _Text:
    """A source with its lines, and a budget of characters that excerpts are paid from."""

    def __init__(self, text: str, budget: int):
        self.text, self.left, self.budget = text, budget, budget
        self.starts = [0]
        for row in text.split("\n")[:-1]:
            self.starts.append(self.starts[-1] + len(row) + 1)

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def offset(self, line: int, column: int) -> int:
        """Lines and columns count from 1; a column may stand behind the last character."""
        if not 1 <= line <= len(self.starts):
            raise ValueError("line outside the text")
        start = self.starts[line - 1]
        stop = self.starts[line] - 1 if line < len(self.starts) else len(self.text)
        if not 0 <= column - 1 <= stop - start:
            raise ValueError("column outside the line")
        return start + column - 1

    def pay(self, a: int, b: int, most: int) -> str:
        piece = self.text[a : min(b, a + max(0, min(most, self.left)))]
        self.left -= len(piece)
        return piece

    def window(self, a: int, b: int, most: int, at: int) -> dict:
        """An excerpt of [a, b) that keeps a place in view, a quarter of it before that."""
        size = max(0, min(b - a, most, self.left))
        lo = min(max(a, max(a, at - size // 4)), b - size)
        source = self.pay(lo, lo + size, size)
        return {"first_line": self.line(lo), "last_line": self.line(max(lo, lo + len(source) - 1)), "start": lo, "end": lo + len(source), "source": source, "truncated": len(source) < b - a}

    def heading(self, box: Box) -> str:
        end = self.text.find("\n", box.start, box.end)
        return self.pay(box.start, box.end if end < 0 else end, HEADING)


def selection_context(text: str, root: Box, start: tuple[int, int], end: tuple[int, int], *, selected: str | None = None, budget: int = 12_000) -> dict:
    """What shows a selection ((line, column) up to, without, (line, column)): itself, the units it
    touches, their ancestors, neighbours and the source's imports, within a budget of characters.

    ValueError: a place outside the text, an empty range, a text that isn't ``selected`` any more
    (the selection is stale), or a tree too large to look through.
    """
    own = _Text(text, budget)
    lo, hi = own.offset(*start), own.offset(*end)
    if hi <= lo:
        raise ValueError("the selection is empty")
    if selected is not None and text[lo:hi] != selected:
        raise ValueError("the selection is stale")
    seen, todo = 0, [root]
    while todo:
        seen += 1
        todo.extend(todo.pop().children)
    if seen > MOST_NODES:
        raise ValueError("the tree is too large")
    path = [root]  # from the root to the tightest box
    while (inner := next((b for b in path[-1].children if b.start <= lo and hi <= b.end), None)) is not None:
        path.append(inner)
    touched = [b for b in root.children if b.end > lo and b.start < hi] if len(path) == 1 else []
    focus = touched or [path[-1]]
    shown = focus[:MOST_SHOWN]
    highlight = own.window(lo, hi, int(budget * SHARE), lo)
    units = [own.window(b.start, b.end, int(budget * SHARE / len(shown)), lo) | {"label": b.label} for b in shown]
    above = [{"label": b.label, "first_line": own.line(b.start), "heading": own.heading(b)} for b in reversed(path[:-1][-MOST_SHOWN:])]
    around = path[-2] if len(path) > 1 else root
    beside = [b for b in around.children if not any(b is f for f in shown)][:MOST_SHOWN]
    peers = [{"label": b.label, "first_line": own.line(b.start), "heading": own.heading(b)} for b in beside]
    imports = [own.pay(b.start, b.end, IMPORT) for b in root.children if "import" in (b.kind or b.label.split(":")[0].lower())][:MOST_SHOWN]
    return {
        "highlight": highlight, "focus": units, "ancestors": above[::-1], "peers": peers, "imports": imports, "fingerprint": hashlib.sha256(text.encode()).hexdigest(),
        "used": budget - own.left, "focus_omitted": len(focus) - len(shown),
    }


def overview(files: list[tuple[str, str, Box]], budget: int = 12_000) -> dict:
    """The first units of the first files (path, text, tree), each with an even allowance."""
    shown, left, out, omitted = files[:MOST_FILES], budget, [], 0
    for path, text, root in shown:
        units = []
        few = root.children[:MOST_UNITS]
        omitted += len(root.children) - len(few)
        for b in few:
            size = min(left, budget // len(shown) // len(few))
            source = text[b.start : min(b.end, b.start + size)]
            left -= len(source)
            units.append({"label": b.label, "first_line": text.count("\n", 0, b.start) + 1, "source": source, "truncated": len(source) < b.end - b.start})
        out.append({"path": path, "units": units})
    return {"files": out, "used": budget - left, "files_omitted": len(files) - len(shown), "units_omitted": omitted}


# ---- trees and folders -------------------------------------------------------------------------


def drill(nodes: DataFrame, from_: DataFrame, key: str, levels: int, fan_out: int = 24) -> DataFrame:
    """(key, top, id, level, truncated): real descendants of picked nodes (key, id), a level at a
    time, the first ``fan_out`` of each parent; truncated tells that a parent has more."""
    from ..storage import materialise

    kids = materialise(trees.semantic_children(nodes, key, fan_out))
    at = from_.select(key, F.col("id").alias("top"), "id")
    out = at.select(key, "top", "id", F.lit(0).alias("level"), F.lit(False).alias("truncated"))
    for level in range(1, levels + 1):
        below = at.withColumnRenamed("id", "parent").join(kids, [key, "parent"])
        out = out.unionByName(below.select(key, "top", "id", F.lit(level).alias("level"), "truncated"))
        at = below.select(key, "top", "id")
    return out


def frontier_view(nodes: DataFrame, marks: DataFrame, key: str) -> DataFrame:
    """(key, id, shown): the marks that are still nodes, and the frontier that they give."""
    live = marks.join(nodes.select(key, "id"), [key, "id"], "left_semi").distinct()
    return live.select(key, "id", F.lit("mark").alias("shown")).unionByName(trees.minimal_frontier(nodes, live, key).select(key, "id", F.lit("frontier").alias("shown")))


def directory(paths: DataFrame, path: str) -> DataFrame:
    """(node, kind, depth, place, last): a folder tree as it is drawn, depth first, folders before
    files, then by name; ``last`` of its siblings."""
    parts = F.split(path, "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    folders = paths.where(F.size(parts) > 1).select(F.explode(up).alias("node"), F.lit("folder").alias("kind"))
    every = folders.unionByName(paths.select(F.col(path).alias("node"), F.lit("file").alias("kind"))).distinct()
    names, n = F.split("node", "/"), F.size(F.split("node", "/"))
    # A folder's segment sorts before a file's at the same depth.
    order = F.transform(names, lambda s, i: F.concat(F.when((i == n - 1) & (F.col("kind") == "file"), "1").otherwise("0"), s))
    rows = every.withColumn("_order", F.array_join(order, "\u0001")).withColumn("_up", F.array_join(F.slice(names, 1, n - 1), "/"))
    last = F.col("_order") == F.max("_order").over(Window.partitionBy("_up"))
    placed = place_over(rows.withColumn("last", last), F.col("_order").asc())
    return placed.select("node", "kind", F.size(F.split("node", "/")).cast("long").alias("depth"), "place", "last")

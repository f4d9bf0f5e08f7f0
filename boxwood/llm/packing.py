"""Packing token sequences into windows of fixed length: best-fit decreasing.

Overlong documents are first cut into full windows. What remains of each document, shorter than
a window, is placed by best-fit decreasing: a segment tree indexed by remaining capacity finds
the tightest open window in O(log capacity).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, spans, table
from .tokens import BPE, encoder

CAPACITY = 1024
#: Remainders placed together at most, which bounds memory: 16,384 x 1,024 ids of 4 bytes, 64 MB.
POOL = 16_384
#: Bytes of text encoded at once.
_SPAN = 12 << 20
#: Windows of one task: its number times 2**33 and onwards.
TASK_BITS = 33

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())])


class OpenWindows:
    """Segment tree over remaining capacities 0..capacity; a leaf stacks the windows that have it."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.full = [0] * (2 * self.size)
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, remaining: int, window: int) -> None:
        self.stacks[remaining].append(window)
        node, full = remaining + self.size, self.full
        while node:
            full[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The window with the least remaining capacity that is at least ``need``, removed."""
        node, full = need + self.size, self.full
        if not full[node]:
            while node > 1 and (node & 1 or not full[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node *= 2
                if not full[node]:
                    node += 1
        remaining = node - self.size
        window = self.stacks[remaining].pop()
        while node:
            full[node] -= 1
            node >>= 1
        return remaining, window


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int], int]:
    """For each length its window and offset there; then how many windows there are.

    Ties go by position, so the result is the same on every run.
    """
    windows, offsets, n = [0] * len(lengths), [0] * len(lengths), 0
    tree = OpenWindows(capacity)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        if (found := tree.take(lengths[i])) is None:
            remaining, window = capacity, n
            n += 1
        else:
            remaining, window = found
        windows[i], offsets[i] = window, capacity - remaining
        if remaining > lengths[i]:
            tree.put(remaining - lengths[i], window)
    return windows, offsets, n


def pack(docs: DataFrame, *, capacity: int = CAPACITY, tokenizer: str = BPE, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", pool: int = POOL) -> DataFrame:
    """Pieces of all documents, each with its place in a window and its ids.

    Returns doc_id, start (ids of the document before the piece), length, doc_tokens (with the
    end id), sequence_id, offset (gapless from 0 in each window) and ids (binary, little-endian
    unsigned 32-bit). A window that isn't full is to be padded to ``capacity`` by its reader.

    No shuffle: every task packs its own rows in pools of at most ``pool`` remainders, and
    window ids are the task's number times 2**33 and onwards, so they are unique and the same
    on a retry. A null or empty text is the end id alone; a null id stays null; repeated rows
    are documents of their own; an empty table has no rows; other columns are left unread.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, task = encoder(tokenizer), np.array([end_id], dtype="<u4"), TaskContext.get().partitionId()
        sequence = task << TASK_BITS
        ready: list[tuple] = []
        rest: list[tuple] = []
        held = 0

        def emit() -> pa.RecordBatch:
            nonlocal ready, held
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ready, strict=True), _ARROW.types, strict=True)], schema=_ARROW)
            ready, held = [], 0
            return out

        def place() -> None:
            nonlocal rest, sequence
            windows, offsets, n = best_fit_decreasing([x[2] for x in rest], capacity)
            ready.extend((d, s, k, total, sequence + w, o, ids) for (d, s, k, total, ids), w, o in zip(rest, windows, offsets, strict=True))
            sequence += n
            rest = []

        for batch in batches:
            for part in spans(batch, 1, size=_SPAN):
                for doc, ids in zip(part.column(0).to_pylist(), enc.ids(part.column(1)), strict=True):
                    ids = np.concatenate([ids.astype("<u4"), end])
                    total = len(ids)
                    whole = total - total % capacity
                    for at in range(0, whole, capacity):
                        ready.append((doc, at, capacity, total, sequence, 0, ids[at : at + capacity].tobytes()))
                        sequence += 1
                    if whole < total:
                        rest.append((doc, whole, total - whole, total, ids[whole:].tobytes()))
                    held += total
                if len(rest) >= pool:
                    place()
                if ready and held >= 2_000_000:
                    yield emit()
        if rest:
            place()
        if ready:
            yield emit()

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(frugal(run), SCHEMA)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 1,024 ids."""
    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

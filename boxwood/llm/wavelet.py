"""Token ids in a binary file format: one wavelet matrix per shard.

A shard holds the ids of consecutive documents. Its bit planes, from the highest bit down, are
each permuted stably by the planes above it, cut into blocks of 65,536 bits, and compressed block
by block; the file holds the ones before every block. So token access, counting and occurrence
lookup inflate one block a plane (rank) or the blocks that hold the answers (select), and never
decode the shard.

File layout (little-endian): magic ``BXWM2``, then

- header, 7 unsigned 64-bit: documents, documents with null id (they come first), tokens, bits,
  ids before this shard in its part, bytes of the compressed documents' table, blocks of a plane
- documents' table, a zstd frame: ids (signed 64-bit), lengths (unsigned 64-bit)
- by plane, highest bit first: ones before each block and in all (unsigned 64-bit)
- by plane: where each block begins in the file, and where the last one ends (unsigned 64-bit)
- the blocks, a zstd frame each
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, spans, table
from .tokens import BPE, encoder

MAGIC = b"BXWM2"
#: A shard is closed once it holds so many tokens; a document is never split over two.
SHARD_TOKENS = 1 << 20
#: Bits of a block: what one access inflates of a plane.
BLOCK = 1 << 16
_HEAD = 7

SHARDS = "part int, seq int, n_docs long, n_tokens long, payload binary"
_SHARDS = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())])
DOCS = "doc_id long, start long, n_tokens long, ids binary"
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


class Plane:
    """Bits in packed blocks, with the ones before each block and in all."""

    def __init__(self, blocks: list[np.ndarray]):
        self._blocks = blocks
        self.ranks = np.concatenate([[0], np.cumsum([np.bitwise_count(b).sum(dtype=np.int64) for b in blocks])]).astype(np.int64)

    def block(self, at: int) -> np.ndarray:
        return self._blocks[at]

    def packed(self) -> np.ndarray:
        return np.concatenate([self.block(i) for i in range(len(self.ranks) - 1)]) if len(self.ranks) > 1 else np.zeros(0, np.uint8)

    def ones(self, at: int) -> int:
        """Ones among the first ``at`` bits."""
        which, rest = divmod(at, BLOCK)
        found = int(self.ranks[which])
        if rest:
            p = self.block(which)
            found += int(np.bitwise_count(p[: rest // 8]).sum(dtype=np.int64))
            if rest % 8:
                found += (int(p[rest // 8]) & ((1 << rest % 8) - 1)).bit_count()
        return found

    def places(self, bit: int, ks: np.ndarray) -> np.ndarray:
        """Where the k-th ones (or zeros) are, for ascending k from 0."""
        before = self.ranks if bit else np.arange(len(self.ranks)) * BLOCK - self.ranks
        which = np.searchsorted(before, ks, side="right") - 1
        out = np.empty(len(ks), dtype=np.int64)
        for b in np.unique(which).tolist():
            own = which == b
            bits = np.unpackbits(self.block(b), bitorder="little")
            out[own] = b * BLOCK + np.flatnonzero(bits == bit)[ks[own] - before[b]]
        return out


class StoredPlane(Plane):
    """A plane in a file: blocks are inflated as they are asked for, the last ones kept."""

    def __init__(self, file: memoryview, ranks: np.ndarray, begins: np.ndarray):
        self.ranks = ranks
        self.block = lru_cache(maxsize=16)(lambda at: np.frombuffer(zstandard.ZstdDecompressor().decompress(file[int(begins[at]) : int(begins[at + 1])]), np.uint8))


class WaveletMatrix:
    """Rank, select and access over a sequence of unsigned ids, on its bit planes."""

    def __init__(self, n: int, planes: list[Plane], zeros: list[int]):
        self.n, self.planes, self.zeros, self.bits = n, planes, zeros, len(planes)

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        n = len(ids)
        kind = np.uint16 if n == 0 or int(ids.max()) < 1 << 16 else np.uint32
        current = ids.astype(kind)
        bits = max(1, int(current.max()).bit_length()) if n else 1
        planes, zeros = [], []
        for k in range(bits - 1, -1, -1):
            ones = (current & kind(1 << k)).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            planes.append(Plane([packed[at : at + BLOCK // 8] for at in range(0, len(packed), BLOCK // 8)]))
            low = current.compress(~ones)
            zeros.append(len(low))
            current = np.concatenate([low, current.compress(ones)])
        return cls(n, planes, zeros)

    def decode(self) -> np.ndarray:
        """All ids in order: the planes undone from the lowest bit up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        current = np.zeros(self.n, kind)
        for k in range(self.bits):
            plane, zeros = self.planes[self.bits - 1 - k], self.zeros[self.bits - 1 - k]
            ones = np.unpackbits(plane.packed(), count=self.n, bitorder="little").view(bool)
            above = np.empty(self.n, kind)
            above[np.flatnonzero(~ones)] = current[:zeros]
            above[np.flatnonzero(ones)] = current[zeros:] | kind(1 << k)
            current = above
        return current

    def access(self, at: int) -> int:
        """The id at a position."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for plane, zeros in zip(self.planes, self.zeros, strict=True):
            before = plane.ones(at)
            one = plane.ones(at + 1) - before
            value = value << 1 | one
            at = zeros + before if one else at - before
        return value

    def _run(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the occurrences of an id in [lo, hi) end up below the lowest plane."""
        for k, (plane, zeros) in enumerate(zip(self.planes, self.zeros, strict=True)):
            a, b = plane.ones(lo), plane.ones(hi)
            lo, hi = (zeros + a, zeros + b) if value >> (self.bits - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, value: int, end: int, start: int = 0) -> int:
        """Occurrences of an id in [start, end)."""
        lo, hi = max(0, start), min(end, self.n)
        if value < 0 or value >> self.bits or hi <= lo:
            return 0
        lo, hi = self._run(value, lo, hi)
        return hi - lo

    def _up(self, value: int, at: np.ndarray) -> np.ndarray:
        """Positions of occurrences, given their places below the lowest plane."""
        for k in range(self.bits):
            plane, zeros = self.planes[self.bits - 1 - k], self.zeros[self.bits - 1 - k]
            bit = value >> k & 1
            at = plane.places(bit, at - zeros if bit else at)
        return at

    def select(self, value: int, k: int) -> int | None:
        """Position of the k-th occurrence (from 0) of an id, or None."""
        if k < 0 or value < 0 or value >> self.bits or not self.n:
            return None
        lo, hi = self._run(value, 0, self.n)
        return int(self._up(value, np.array([lo + k]))[0]) if lo + k < hi else None

    def occurrences(self, value: int) -> list[int]:
        """All positions of an id, ascending."""
        if value < 0 or value >> self.bits or not self.n:
            return []
        lo, hi = self._run(value, 0, self.n)
        return self._up(value, np.arange(lo, hi)).tolist()


def write_shard(doc_ids: list[int | None], docs: list[np.ndarray], before: int = 0) -> bytes:
    """One file: documents with a null id first, as sorted input has them."""
    nulls = sum(x is None for x in doc_ids)
    if any(x is None for x in doc_ids[nulls:]):
        raise ValueError("documents with a null id must come first")
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint16)
    matrix, zip_ = WaveletMatrix.build(ids), zstandard.ZstdCompressor(level=1)
    names = zip_.compress(np.array([x or 0 for x in doc_ids], dtype="<i8").tobytes() + np.array([len(x) for x in docs], dtype="<u8").tobytes())
    blocks = [[zip_.compress(b.tobytes()) for b in p._blocks] for p in matrix.planes]
    each = len(blocks[0])
    begins = len(MAGIC) + 8 * _HEAD + len(names) + 8 * matrix.bits * 2 * (each + 1)
    places = np.cumsum([0, *(len(b) for own in blocks for b in own)]) + begins
    places = np.stack([places[k * each : (k + 1) * each + 1] for k in range(matrix.bits)])
    head = np.array([len(docs), nulls, len(ids), matrix.bits, before, len(names), each], dtype="<u8")
    ranks = np.stack([p.ranks for p in matrix.planes])
    return b"".join([MAGIC, head.tobytes(), names, ranks.astype("<u8").tobytes(), places.astype("<u8").tobytes(), *(b for own in blocks for b in own)])


class Shard:
    """A file read back; planes are inflated block by block as they are needed."""

    def __init__(self, payload: bytes):
        if payload[: len(MAGIC)] != MAGIC:
            raise ValueError("not a shard")
        file, at = memoryview(payload), len(MAGIC)
        n, nulls, tokens, bits, self.before, size, each = map(int, np.frombuffer(file, "<u8", _HEAD, at))
        at += 8 * _HEAD
        names = zstandard.ZstdDecompressor().decompress(file[at : at + size])
        at += size
        self.doc_ids: list[int | None] = [None] * nulls + np.frombuffer(names, "<i8", n).tolist()[nulls:]
        self.lengths = np.frombuffer(names, "<u8", n, 8 * n).astype(np.int64)
        ranks, places = np.frombuffer(file, "<u8", 2 * bits * (each + 1), at).astype(np.int64).reshape(2, bits, each + 1)
        self.matrix = WaveletMatrix(tokens, [StoredPlane(file, r, b) for r, b in zip(ranks, places, strict=True)], (tokens - ranks[:, -1]).tolist())


def write_tokens(docs: DataFrame, *, tokenizer: str = BPE, end_id: int = 0, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents as shard files, written to the shared folder in ascending id order.

    Rows: part and seq (the order of shards), n_docs, n_tokens, payload (the file). Documents
    are dealt by ranges of their id, so a part holds consecutive documents. Equal ids go by
    their text; a null id comes first; a null or empty text is the end id alone. Other columns
    are left unread; an empty table gives no shard. One row, hence one task's memory, holds
    ``shard_tokens`` ids or one longer document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], dtype=enc.dtype)
        names: list[int | None] = []
        held: list[np.ndarray] = []
        tokens = before = seq = 0

        def flush() -> pa.RecordBatch:
            nonlocal names, held, tokens, before, seq
            out = pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "n_docs": [len(held)], "n_tokens": [tokens], "payload": [write_shard(names, held, before)]}, schema=_SHARDS)
            names, held, before, tokens, seq = [], [], before + tokens, 0, seq + 1
            return out

        for batch in batches:
            for piece in spans(batch, 1):
                for doc, ids in zip(piece.column(0).to_pylist(), enc.ids(piece.column(1)), strict=True):
                    names.append(doc)
                    held.append(np.concatenate([ids, end]))
                    tokens += len(ids) + 1
                    if tokens >= shard_tokens:
                        yield flush()
        if held:
            yield flush()

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # Equal ids, should very many be equal, are dealt by how their texts begin.
    dealt = own.repartitionByRange("doc_id", F.substring("text", 1, 16)).sortWithinPartitions("doc_id", "text")
    return materialise(dealt.mapInArrow(run, SHARDS))


def read_tokens(shards: DataFrame) -> DataFrame:
    """Documents decoded from shard files: doc_id, start (ids of all documents before it),
    n_tokens, ids (binary, little-endian unsigned 32-bit).

    Only the totals of parts come to the driver, one number for each partition of the write.
    """
    totals = sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    starts: dict[int, int] = {}
    total = 0
    for part, n in totals:
        starts[part] = total
        total += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard(payload.as_py())
                ids = shard.matrix.decode().astype("<u4")
                ends = np.cumsum(shard.lengths)
                first = ends - shard.lengths
                data = memoryview(ids).cast("B")
                for at in range(0, len(ends), 512):
                    a, b, k = first[at : at + 512].tolist(), ends[at : at + 512].tolist(), shard.doc_ids[at : at + 512]
                    yield pa.RecordBatch.from_pydict({"doc_id": k, "start": [x + shard.before + starts[part] for x in a], "n_tokens": [y - x for x, y in zip(a, b, strict=True)], "ids": [bytes(data[4 * x : 4 * y]) for x, y in zip(a, b, strict=True)]}, schema=_DOCS)

    return shards.select("part", "payload").mapInArrow(run, DOCS)


def op3_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as wavelet-matrix shards and read back from them."""
    docs = read_tokens(write_tokens(table(spark, sf_dir, "documents")))
    return docs.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

"""Quality classifier: a convolutional network over bytes, in numpy.

Filters of eight bytes move over the text byte by byte. Chunks of 256 windows, each overlapping
the next by half, cover the whole text; in each chunk a filter keeps its maximum. The mean,
maximum and minimum over chunks of every filter, and how much a text falls short of one chunk,
go into one probability.

A filter over bytes is a sum of one table entry for each place, so the network is applied by
table lookups; two places share a table of byte pairs. Learning covers all chunks of every text
of the sample, as scoring does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, frugal, held_out, slices, table
from .labelled import Sample, labelled_sample

#: Labelled texts of each label to learn from, at most; whole texts.
PER_CLASS = 1_500
THRESHOLD = 0.3
TAPS, FILTERS, HALF = 8, 32, 128
#: Passes over the sample, or so many steps if those are more.
EPOCHS, BATCH, STEPS = 12, 64, 750
#: Bytes of a piece to learn short texts from, least and most.
PIECE = (12, 300)
_SPAN = 1 << 18
#: Runs looked up at once, so that what they need stays in the cache.
_RUNS = 16
_LAG = TAPS - 1


def _padded(text: bytes) -> bytes:
    """At least one window."""
    return text if len(text) >= TAPS else text + b" " * (TAPS - len(text))


def _shortness(sizes: list[int]) -> np.ndarray:
    """0 from the length of a chunk on, else the log of the ratio: filters had less to match."""
    return np.log(2 * HALF / np.clip(np.array(sizes), TAPS, 2 * HALF))


def _codes(raw: np.ndarray) -> np.ndarray:
    """Every byte with the next one."""
    return raw[:-1].astype(np.int32) << 8 | raw[1:]


def _run_cuts(sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of HALF windows begin in texts put end to end, and how many each text has. What
    follows a text's last run, windows that reach into the next text, is a run that doesn't count."""
    cuts, runs, at = [], [], 0
    for size in sizes:
        own = range(at, at + size - _LAG, HALF)
        cuts.extend(own)
        cuts.append(at + size - _LAG)
        runs.append(len(own))
        at += size
    return np.array(cuts[:-1]), np.array(runs)


def _windows(tables: np.ndarray, code: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Filters' sums for the windows that begin in [lo, hi)."""
    out = tables[0].take(code[lo:hi], axis=0)
    for k in range(1, len(tables)):
        out += tables[k].take(code[lo + 2 * k : hi + 2 * k], axis=0)
    return out


class ByteNet:
    """tables (taps, 256, filters), bias (filters), weights (mean, maximum, minimum
    of each filter, shortness)."""

    def __init__(self, tables: np.ndarray, bias: np.ndarray, weights: np.ndarray, offset: float):
        self.tables, self.bias, self.weights, self.offset = tables, bias, weights, offset
        self._pairs: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_pairs": None}

    def pairs(self) -> np.ndarray:
        """(taps / 2, 65536, filters): tables of two bytes, built once in each process."""
        if self._pairs is None:
            t = self.tables.astype(np.float32)
            self._pairs = np.stack([(t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65_536, -1) for k in range(0, TAPS, 2)])
        return self._pairs

    def _halves(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Maxima of each filter over runs of HALF windows, and how many runs each text has."""
        padded = [_padded(t) for t in texts]
        raw = np.frombuffer(b"".join(padded), dtype=np.uint8)
        code, pairs = _codes(raw), self.pairs()
        cuts, runs = _run_cuts([len(p) for p in padded])
        top = np.empty((len(cuts), self.tables.shape[2]), dtype=np.float32)
        ends = np.append(cuts[_RUNS::_RUNS], len(raw) - _LAG)
        for g, hi in zip(range(0, len(cuts), _RUNS), ends.tolist(), strict=True):
            lo = int(cuts[g])
            top[g : g + _RUNS] = np.maximum.reduceat(_windows(pairs, code, lo, hi), cuts[g : g + _RUNS] - lo, axis=0)
        return np.delete(top, np.cumsum(runs + 1)[:-1] - 1, axis=0), runs

    def features(self, texts: list[bytes]) -> np.ndarray:
        """For each text the mean, maximum and minimum over its chunks, and its shortness."""
        out = np.empty((len(texts), 3 * self.tables.shape[2] + 1))
        out[:, -1] = _shortness([len(t) for t in texts])
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= _SPAN):
                size += len(texts[end])
                end += 1
            if size > 2 * _SPAN:  # one long text: runs are found piece by piece, windows overlap the next
                text = texts[at]
                halves = np.concatenate([self._halves([text[a : a + _SPAN + _LAG]])[0] for a in range(0, len(text) - _LAG, _SPAN)])
                runs = np.array([len(halves)])
            else:
                halves, runs = self._halves(texts[at:end])
            out[at:end, :-1] = _pool(np.maximum(halves + self.bias, 0), runs)[0]
            at = end
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        logit = self.features(texts) @ self.weights + self.offset
        return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def _pool(halves: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mean, maximum and minimum over each text's chunks; the chunks' maxima, the run that each
    chunk begins with, and how many chunks each text has. A chunk is a run and the next of the
    same text; a lone run is a chunk."""
    n = np.maximum(runs - 1, 1)
    first = np.cumsum(n) - n
    begin = np.arange(n.sum()) + np.repeat(np.cumsum(runs) - runs - first, n)
    after = begin + np.repeat(runs > 1, n)
    chunk = np.maximum(halves[begin], halves[after])
    mean = np.add.reduceat(chunk, first, axis=0, dtype=np.float64) / n[:, None]
    return np.concatenate([mean, np.maximum.reduceat(chunk, first, axis=0), np.minimum.reduceat(chunk, first, axis=0)], axis=1), chunk, np.stack([begin, after]), n


class _Adam:
    def __init__(self, values: list[np.ndarray], rate: float):
        self.values, self.rate, self.step = values, rate, 0
        self.m, self.v = [np.zeros_like(x) for x in values], [np.zeros_like(x) for x in values]

    def move(self, grads: list[np.ndarray]) -> None:
        self.step += 1
        for x, g, m, v in zip(self.values, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.99**self.step)) + 1e-8)


def fit(sample: Sample, seed: int = 7) -> ByteNet:
    """Train on labelled texts by Adam; deterministic. Scores are probabilities as if both labels
    were equally common, so that the threshold means the same whatever the labels' mix. Without
    both labels every text scores the rate of label 1 (half, if there is none).

    Every text is learned whole. One in three of each label also gives a piece of random length
    with its label, so that short texts are judged by what they hold.
    """
    rng = np.random.default_rng(seed)
    tables = rng.normal(0, 0.3, (TAPS, 256, FILTERS))
    bias, weights, offset = np.zeros(FILTERS), rng.normal(0, 0.1, 3 * FILTERS + 1), np.zeros(1)
    y = sample.labels.astype(np.float64)
    if not len(y) or y.min() == y.max():
        rate = min(max(sample.rate, 1e-3), 1 - 1e-3)
        return ByteNet(tables, bias, np.zeros(3 * FILTERS + 1), float(np.log(rate / (1 - rate))))
    texts = [t.encode("utf-8", "replace") for t in sample.texts]
    for i in rng.permutation(len(texts))[::3].tolist():
        size = int(np.exp(rng.uniform(*np.log(PIECE))))
        at = int(rng.integers(0, max(1, len(texts[i]) - size)))
        texts.append(texts[i][at : at + size])
        y = np.append(y, y[i])
    short = _shortness([len(t) for t in texts])
    raws = [np.frombuffer(_padded(t), dtype=np.uint8) for t in texts]
    # Byte pairs of the sample, so that a step's tables hold those alone; pairs across two texts are looked up, and don't count.
    seen = np.zeros(65_536, dtype=bool)
    seen[0] = True
    for r in raws:
        seen[_codes(r)] = True
    known = np.flatnonzero(seen)
    place = np.zeros(65_536, dtype=np.int32)
    place[known] = np.arange(len(known))
    opt = _Adam([tables, bias, weights, offset], 0.01)
    # Labels weigh the same in every step.
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    epochs = max(EPOCHS, STEPS // -(-len(texts) // BATCH))
    for epoch in range(epochs):
        opt.rate = 0.01 * (1 - epoch / epochs) + 0.0005
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            opt.move(_gradient(tables, bias, weights, offset, [raws[i] for i in own], short[own], y[own], weight[own], known, place))
    return ByteNet(tables.astype(np.float32), bias.astype(np.float32), weights, float(offset[0]))


def _gradient(tables: np.ndarray, bias: np.ndarray, weights: np.ndarray, offset: np.ndarray, raws: list[np.ndarray], short: np.ndarray, y: np.ndarray, weight: np.ndarray, known: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    flat = tables.astype(np.float32)
    pairs = np.stack([flat[k][known >> 8] + flat[k + 1][known & 255] for k in range(0, TAPS, 2)])
    raw = np.concatenate(raws)
    code = place[_codes(raw)]
    cuts, runs = _run_cuts([len(r) for r in raws])
    ends = np.append(cuts[1:], len(raw) - _LAG)
    keep = np.ones(len(cuts), dtype=bool)
    keep[np.cumsum(runs + 1)[:-1] - 1] = False
    cuts, ends = cuts[keep], ends[keep]
    top, where = np.empty((len(cuts), FILTERS), dtype=np.float32), np.empty((len(cuts), FILTERS), dtype=np.int64)
    for i, (lo, hi) in enumerate(zip(cuts.tolist(), ends.tolist(), strict=True)):
        own = np.ascontiguousarray(_windows(pairs, code, lo, hi).T)
        best = own.argmax(axis=1)
        top[i], where[i] = own[np.arange(FILTERS), best], best + lo
    pooled, chunk, both, n = _pool(np.maximum(top + bias, 0), runs)
    doc = np.repeat(np.arange(len(raws)), n)
    x = np.concatenate([pooled, short[:, None]], axis=1)
    p = 1 / (1 + np.exp(-np.clip(x @ weights + offset[0], -60, 60)))
    miss = weight * (p - y) / len(raws)
    w, (_, high, low) = weights[:-1].reshape(3, FILTERS), np.split(pooled, 3, axis=1)
    # Neighbouring chunks often share the run with their maximum: such ties share what flows back.
    first = np.cumsum(n) - n
    top_at, low_at = (chunk == high[doc]).astype(np.float32), (chunk == low[doc]).astype(np.float32)
    share = top_at / np.add.reduceat(top_at, first)[doc] * w[1] + low_at / np.add.reduceat(low_at, first)[doc] * w[2] + w[0] / n[doc][:, None]
    back = miss[doc][:, None] * share * (chunk > 0)
    # Of a chunk's two runs the one that holds its maximum.
    begin, after = both
    won = np.where(top[begin] >= top[after], where[begin], where[after])
    taps = np.arange(TAPS)[:, None, None]
    at = (taps * 256 + raw[won[None, :, :] + taps].astype(np.int64)) * FILTERS + np.arange(FILTERS)
    g = np.bincount(at.ravel(), weights=np.broadcast_to(back, at.shape).ravel(), minlength=tables.size)
    return [g.reshape(tables.shape) + 1e-5 * tables, back.sum(axis=0), x.T @ miss + 1e-4 * weights, np.array([miss.sum()])]


def score_quality(docs: DataFrame, net: ByteNet, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from ``threshold``) for every row.

    All bytes of a text are covered. A null or empty text is scored as a window of spaces. Null
    and repeated ids stay rows of their own; other columns are never read; an empty table has
    no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                score = net.score([t or b"" for t in bytes_of(part.column(1))])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(frugal(run), "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, net: ByteNet, *, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns kept, whose score reaches ``threshold``.

    A null or empty text is judged as a window of spaces; repeated rows and ids are judged each on
    its own; texts of any length are read whole; an empty table stays empty; other columns pass as
    they are, whatever their names.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(net.score([t or b"" for t in bytes_of(part.column(at))]) >= threshold))

    return docs.mapInArrow(frugal(run), docs.schema)


def op9_byte_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document."""
    docs = table(spark, sf_dir, "documents")
    net = fit(labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", PER_CLASS))
    return score_quality(docs, net).select("doc_id", held_out().alias("held_out"), "score", "predicted")

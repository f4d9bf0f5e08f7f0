"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of variable order, up to four bytes, holds how often
each byte followed. Long contexts are nodes only where they were seen often enough. A byte costs
its code length in the longest context that is a node and has it, after an escape for every
longer node that doesn't (escape method C), and 8 bits where no context has it. The statistics
are frozen after training, so a byte's cost depends on the five bytes that end there only: each
distinct run of five bytes in a batch is coded once. A text's language is the one with the
shortest code.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, held_out, slices, table

#: Training texts of one language, about; whole texts. Scoring covers every row.
PER_LANGUAGE = 600
#: Bytes of the longest context, and how often one of three bytes or more is seen to be a node.
ORDER, SEEN = 4, 4
UNKNOWN = "und"
_LETTER = re.compile(rb"[A-Za-z]")
_LOWER = bytes(range(256)).lower()
_HEAD = b" " * ORDER
#: Bytes coded at once.
_SPAN = 1 << 20


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    return bool(_LETTER.search(text)) or (not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace")))


def _grams(parts: list[bytes]) -> np.ndarray:
    """Every byte with the ORDER bytes before it, the latest lowest; each part begins with that
    many bytes of context. Where a part ends, ORDER entries reach into the next one."""
    x = np.frombuffer(b"".join(parts).translate(_LOWER), dtype=np.uint8)
    out = x[: len(x) - ORDER].astype(np.int64)
    for k in range(1, ORDER + 1):
        out <<= 8
        out |= x[k : len(x) - ORDER + k]
    return out


def count_contexts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(lang, code, n): how often five bytes, A-Z as a-z, end a position; a text begins after
    four spaces. Counted on the executors, as many rows as there are distinct runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 512):
                grouped: dict[str, list[np.ndarray]] = {}
                for lang, text in zip(part.column(0).to_pylist(), bytes_of(part.column(1)), strict=True):
                    grouped.setdefault(lang, []).append(_grams([_HEAD + text]))
                for lang, codes in grouped.items():
                    code, n = np.unique(np.concatenate(codes), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code, pa.int64()), pa.array(n, pa.int64())], names=["lang", "code", "n"])

    counted = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(run, "lang string, code long, n long")
    return counted.groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _among(keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is among the sorted known ones, and where."""
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return known[at] == keys, at


class ContextTree:
    """One language's frozen tree, an order at a time: its nodes with the bits of an escape, and
    what followed them with the bits of that byte."""

    def __init__(self, code: np.ndarray, n: np.ndarray, seen: int = SEEN):
        self.orders: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for k in range(ORDER + 1):
            # The last k + 1 of the bytes: a context of k and what followed.
            pairs, which = np.unique(code & (1 << 8 * (k + 1)) - 1, return_inverse=True)
            times = np.bincount(which, weights=n)
            nodes, owner, kinds = np.unique(pairs >> 8, return_inverse=True, return_counts=True)
            total = np.bincount(owner, weights=times)
            own = np.log2(total + kinds)[owner] - np.log2(times)
            escape = np.log2(total + kinds) - np.log2(kinds)
            kept = (total >= seen) | (k < 3)
            self.orders.append((nodes[kept], escape[kept], pairs[kept[owner]], own[kept[owner]]))

    def bits(self, code: np.ndarray) -> np.ndarray:
        """The exact code length of each run's last byte after the ones before it."""
        out = np.zeros(len(code))
        left = np.arange(len(code))
        for k in range(ORDER, -1, -1):
            nodes, escape, pairs, own = self.orders[k]
            if not len(nodes) or not len(left):
                continue
            pair = code[left] & (1 << 8 * (k + 1)) - 1
            hit, at = _among(pair, pairs)
            out[left[hit]] += own[at[hit]]
            left, pair = left[~hit], pair[~hit]
            node, at = _among(pair >> 8, nodes)
            out[left[node]] += escape[at[node]]
        out[left] += 8
        return out


class ContextTrees:
    """Frozen trees of all languages; each holds only what its language has."""

    def __init__(self, languages: list[str], codes: list[np.ndarray], counts: list[np.ndarray]):
        self.languages = languages
        self.trees = [ContextTree(c, n) for c, n in zip(codes, counts, strict=True)]

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language; every byte of it counts."""
        out = np.zeros((len(texts), len(self.languages)))
        for i, text in enumerate(texts):
            if len(text) > _SPAN:
                for at in range(0, len(text), _SPAN):
                    head = _HEAD if not at else text[at - ORDER : at]
                    out[i] += self._sum([head + text[at : at + _SPAN]])[0]
        short = [i for i, text in enumerate(texts) if 0 < len(text) <= _SPAN]
        at = 0
        while at < len(short):
            end, size = at, 0
            while end < len(short) and (end == at or size + len(texts[short[end]]) <= _SPAN):
                size += len(texts[short[end]])
                end += 1
            out[short[at:end]] = self._sum([_HEAD + texts[i] for i in short[at:end]])
            at = end
        return out

    def _sum(self, parts: list[bytes]) -> np.ndarray:
        """Each part begins with ORDER bytes that are context only."""
        code, which = np.unique(_grams(parts), return_inverse=True)
        ends = np.cumsum([len(p) for p in parts])
        starts = ends - [len(p) for p in parts]
        # A part's entries, then those that reach into the next part; the last part has none of these.
        cuts = np.stack([starts, ends - ORDER], axis=1).ravel()[:-1]
        return np.stack([np.add.reduceat(tree.bits(code)[which], cuts)[::2] for tree in self.trees], axis=1)


def train(docs: DataFrame, *, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ContextTrees | None:
    """Trees from about ``per_language`` texts of each language outside the held-out fold; None
    if there are none. Which texts is told by a hash of id and text."""
    rows = docs.where(~held_out(id_col) & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[lang_col]: r["count"] for r in rows.groupBy(lang_col).count().collect()}
    if not sizes:
        return None
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / n))))[F.col(lang_col)]
    few = rows.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < F.ceil(share * (1 << 20)))
    found = count_contexts(few, lang_col, text_col).toArrow().to_pandas()
    languages = sorted(found["lang"].unique())
    if not languages:
        return None
    by = {lang: g.sort_values("code") for lang, g in found.groupby("lang")}
    return ContextTrees(languages, [by[x]["code"].to_numpy() for x in languages], [by[x]["n"].to_numpy() for x in languages])


def identify(docs: DataFrame, trees: ContextTrees | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (0 to 1: the language's share when each has the probability
    of its code) for every row.

    Whole texts count, of any length. ``und`` with score 0: a null text, one without a letter,
    or no language learned. Equal codes go to the first language by name. Null and repeated ids
    stay rows of their own; other columns are never read; an empty table has no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = [x if has_letter(x) else b"" for x in bytes_of(part.column(1))]
                pred, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
                some = [i for i, x in enumerate(texts) if x]
                if trees is not None and some:
                    bits = trees.code_lengths([texts[i] for i in some])
                    best = bits.argmin(axis=1)
                    share = 1 / np.exp2(np.maximum(-1000, bits.min(axis=1, keepdims=True) - bits)).sum(axis=1)
                    for i, j, s in zip(some, best.tolist(), share.tolist(), strict=True):
                        pred[i], score[i] = trees.languages[j], s
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, lang_pred string, score double")


def op4_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: lower case, homoglyphs and full-width letters to Latin ones, digits and
signs that stand for letters to those letters, invisible characters removed, everything else
between words to one space. Entries are stems that begin a word. They, their weights and
exception phrases are learned from labelled texts; the score is a logistic function of the
weight found, as such and in proportion to the length.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, held_out, slices, table, texts_of
from .labelled import Sample, labelled_sample

#: Labelled texts of each label to learn from, at most.
PER_CLASS = 1_500
#: An entry is in so many texts of label 1 at least, and its log ratio and log-likelihood ratio
#: against chance are so high; of the texts of label 0 it is in this share of that share at most.
SUPPORT, RATIO, EVIDENCE, PURITY = 4, 2.0, 15.0, 0.04
STEM = range(3, 17)
_LOOKALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ғ": "f", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o",
    "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ц": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "α": "a", "β": "b", "ϲ": "c", "δ": "d",
    "ε": "e", "ϝ": "f", "η": "n", "ι": "i", "κ": "k", "μ": "m", "ν": "v", "ο": "o", "ρ": "p", "ѓ": "r", "σ": "s", "τ": "t", "υ": "u", "ω": "w",
    "χ": "x", "γ": "y", "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ո": "n", "օ": "o", "ս": "u", "հ": "h", "ց": "g", "ʟ": "l", "ᴏ": "o",
}
_SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e", "£": "l"}
_GONE = "​‌‍⁠﻿­᠎"


def _folding() -> dict[int, str | None]:
    to: dict[int, str | None] = {i: " " for i in range(128) if not chr(i).isalnum()}
    to |= {i: " " for i in range(0x80, 0x3000) if unicodedata.category(chr(i))[0] in "PSZ"}
    for first in (0xFF21, 0xFF41):  # full width
        to |= {first + i: chr(97 + i) for i in range(26)}
    for i in range(0x1D400, 0x1D6A4):  # mathematical letters
        if len(plain := unicodedata.normalize("NFKC", chr(i)).lower()) == 1:
            to[i] = plain
    to |= {ord(k): v for k, v in (_LOOKALIKE | _SIGNS).items()} | {ord(k.upper()): v for k, v in _LOOKALIKE.items() if len(k.upper()) == 1}
    return to | {ord(c): None for c in _GONE}


_FOLD = _folding()
_ASCII = bytes(ord(_FOLD.get(i, chr(i).lower())) if i < 128 else i for i in range(256))


_ONE_AS_L = _FOLD | {ord("1"): "l"}


def fold(text: str, table: dict[int, str | None] = _FOLD) -> str:
    """A text as the automaton reads it: words of folded letters, a space before each and after
    the last. Letters that aren't Latin look-alikes stay as they are."""
    if text.isascii() and table is _FOLD:
        return " " + " ".join(text.encode().translate(_ASCII).decode().split()) + " "
    return " " + " ".join(text.lower().translate(table).split()) + " "


def _outside(hits: list[tuple[int, int, float]], spared: list[tuple[int, int]]) -> float:
    """The weight of hits that lie in no spared span: one sweep, as the span that ends last of
    those that begin before a hit holds it if any does."""
    spared, total, at, reach = sorted(spared), [], 0, -1
    for start, end, weight in sorted(hits):
        while at < len(spared) and spared[at][0] <= start:
            reach = max(reach, spared[at][1])
            at += 1
        if end > reach:
            total.append(weight)
    return math.fsum(total)


class Lexicon:
    """Entries with weights, exception phrases, and the logistic coefficients of a score."""

    def __init__(self, weights: dict[str, float], exceptions: list[str], coefficients: list[float]):
        self.weights, self.exceptions, self.coefficients = weights, exceptions, coefficients
        self._automaton = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    def _matcher(self):
        """Built once in each process. An entry or phrase matches from the start of a word."""
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for stem, weight in self.weights.items():
                self._automaton.add_word(" " + stem, (len(stem) + 1, weight))
            for phrase in self.exceptions:
                self._automaton.add_word(f" {phrase} ", (len(phrase) + 2, None))
            if self.weights:
                self._automaton.make_automaton()
        return self._automaton

    def measure(self, text: str | None) -> tuple[float, int]:
        """(weight of the hits outside exception phrases, words) of a whole text."""
        if not text or not self.weights:
            return 0.0, 0
        folded = fold(text)
        hits, spared = set(), set()
        # A 1 may stand for an i or an l; both readings have the same places.
        for form in (folded, fold(text, _ONE_AS_L)) if "1" in text else (folded,):
            for end, (length, weight) in self._matcher().iter(form):
                if weight is None:
                    spared.add((end - length + 1, end))
                else:
                    hits.add((end - length + 1, end, weight))
        return _outside(list(hits), list(spared)), folded.count(" ") - 1

    def features(self, text: str | None) -> tuple[float, float]:
        weight, words = self.measure(text)
        return math.log1p(weight), math.log1p(1000 * weight / max(words, 1))

    def score(self, text: str | None) -> float:
        bias, whole, dense = self.coefficients
        a, b = self.features(text)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, bias + whole * a + dense * b))))


def _stems(text: str) -> set[str]:
    return {w[:n] for w in set(fold(text).split()) for n in STEM if n <= len(w)}


def _apart(sample: Sample) -> Sample:
    """One text of each group of near copies with the same label, which would otherwise vote for
    every word that they share. Texts that share one of four least shingle hashes are a group."""
    from xxhash import xxh64_intdigest

    first: dict[tuple, int] = {}
    kept = []
    for i, (text, label) in enumerate(zip(sample.texts, sample.labels, strict=True)):
        words = fold(text).split()
        shingles = {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
        keys = [(int(label), seed, min(xxh64_intdigest(s, seed) for s in shingles)) for seed in range(4)]
        if not any(k in first for k in keys):
            kept.append(i)
        for k in keys:
            first.setdefault(k, i)
    return Sample([sample.texts[i] for i in kept], sample.labels[kept], sample.rate)


def _evidence(a: int, b: int, share: float) -> float:
    """Log-likelihood ratio of a hits among label 1 and b among label 0, against ``share``."""
    n = a + b
    return 2 * (a * math.log(a / (n * share)) + (b * math.log(b / (n * (1 - share))) if b else 0))


def _entries(sample: Sample) -> dict[str, float]:
    """Stems far commoner in texts of label 1, with the log of the ratio as their weights.

    A stem qualifies by its ratio, its evidence and how pure it is. Of stems that begin with
    each other the shortest that qualifies is taken, then made longer as long as that loses
    little, so that an entry is as long as what its words share.
    """
    toxic, clean = Counter(), Counter()
    ones, zeros = int(sample.labels.sum()), int((1 - sample.labels).sum())
    for text, label in zip(sample.texts, sample.labels, strict=True):
        if label:
            toxic.update(_stems(text))
    toxic = Counter({s: n for s, n in toxic.items() if n >= SUPPORT})
    for text, label in zip(sample.texts, sample.labels, strict=True):
        if not label:
            clean.update(_stems(text) & toxic.keys())
    longer = defaultdict(list)
    for stem in toxic:
        longer[stem[:-1]].append(stem)
    share = ones / (ones + zeros)
    weights: dict[str, float] = {}
    for stem in sorted(toxic, key=lambda s: (len(s), s)):
        a, b = toxic[stem], clean[stem]
        if any(stem[:n] in weights for n in STEM if n < len(stem)):
            continue
        weight = math.log((a + 0.5) / (ones + 1)) - math.log((b + 0.5) / (zeros + 1))
        if weight >= RATIO and b / zeros <= PURITY * a / ones and _evidence(a, b, share) >= EVIDENCE:
            weights[stem] = weight
    out = {}
    for stem, weight in weights.items():
        while more := [s for s in longer[stem] if toxic[s] >= 0.9 * toxic[stem]]:
            stem = more[0]
        out[stem] = weight
    return out


def _exceptions(sample: Sample, weights: dict[str, float]) -> list[str]:
    """Two-word phrases that hold an entry and occur in three or more texts of label 0, and
    there in at least four of five texts that have them."""
    seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for text, label in zip(sample.texts, sample.labels, strict=True):
        words = fold(text).split()
        found = set()
        for i, w in enumerate(words):
            if any(w[:n] in weights for n in STEM if n <= len(w)):
                found.update(" ".join(p) for p in (words[i - 1 : i + 1] if i else [], words[i : i + 2]) if len(p) == 2)
        for phrase in found:
            seen[phrase][int(label)] += 1
    return sorted(p for p, (no, yes) in seen.items() if no >= 3 and no >= 4 * yes)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method, with a ridge on all but the bias."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    beta, penalty = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge * len(x) / 100] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -60, 60)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(beta)), x.T @ (y - p) - penalty @ beta)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def learn(sample: Sample) -> Lexicon:
    """A lexicon from labelled texts. Without both labels nothing is toxic (score about 0)."""
    if not len(sample.labels) or sample.labels.min() == sample.labels.max():
        return Lexicon({}, [], [-10.0, 0.0, 0.0])
    sample = _apart(sample)
    weights = _entries(sample)
    found = Lexicon(weights, _exceptions(sample, weights), [0.0, 0.0, 0.0])
    beta = _logistic(np.array([found.features(t) for t in sample.texts]), sample.labels)
    found.coefficients = [float(beta[0]) + sample.shift, float(beta[1]), float(beta[2])]
    return found


def score_toxicity(docs: DataFrame, lexicon: Lexicon, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from 0.5) for every row.

    Whole texts are matched. A null, empty or wordless text has no hit and the score of that.
    Null and repeated ids stay rows of their own; other columns are never read; an empty table
    has no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                score = [lexicon.score(t) for t in texts_of(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32())], names=["doc_id", "score", "predicted"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(frugal(run), "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, lexicon: Lexicon, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns kept, whose score is below 0.5.

    A null, empty or wordless text has no hit; repeated rows and ids are judged each on its own;
    texts of any length are matched whole; an empty table stays empty; other columns pass as they
    are, whatever their names.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array([lexicon.score(t) < 0.5 for t in texts_of(part.column(at))], pa.bool_()))

    return docs.mapInArrow(frugal(run), docs.schema)


def op7_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    docs = table(spark, sf_dir, "documents")
    lexicon = learn(labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", PER_CLASS))
    return score_toxicity(docs, lexicon).select("doc_id", held_out().alias("held_out"), "score", "predicted")

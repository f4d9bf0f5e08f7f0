"""Expensive functions of a text: once for each distinct content, remembered by hash.

The function is a provider: Arrow batches of (hash, text) to (hash, out). Any model can stand
behind it; the defaults here are deterministic.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Provider = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def annotate(rows: DataFrame, key: str, text: str, provider: Provider, cache: DataFrame | None = None, *, offline: bool = False) -> DataFrame:
    """(key, hash, out) of every row. ``cache``: known (hash, out), which aren't asked again. With
    ``offline`` the provider is never asked: content that the cache lacks is an error."""
    own = rows.select(key, F.substring(F.sha1(text), 1, 16).alias("hash"), F.col(text).alias("_text")).where("_text IS NOT NULL")
    asked = own.groupBy("hash").agg(F.min("_text").alias("text"))
    if cache is not None:
        asked = asked.join(cache.select("hash"), "hash", "left_anti")
    if offline and not (lacking := asked.limit(1)).isEmpty():
        raise LookupError(f"not in the cache: {lacking.first()['hash']}")
    found = asked.mapInArrow(provider, "hash string, out string")
    if cache is not None:
        found = found.unionByName(cache.select("hash", "out"))
    return own.drop("_text").join(found, "hash")


def classify_intent(question: str) -> str:
    """``deepen`` for a question that stays with what was asked before, else ``new``."""
    return "deepen" if re.search(r"\b(?:more|deeper|detail|why|how exactly|elaborate|expand|continue|go on)\b", question, re.I) else "new"


def answer_prompt(question: str, context: list[tuple[str, str]], transcript: list[tuple[str, str]], most: int = 12_000) -> str:
    """The text that a model would be given: question, named context parts within a budget, and
    the last four turns. A part that doesn't fit is cut, and later ones are left out."""
    parts, room = [f"Question: {question.strip()}"], most
    for name, body in context:
        if room <= 0:
            break
        cut = body[:room]
        parts.append(f"[{name}]\n{cut}" + ("\n..." if len(cut) < len(body) else ""))
        room -= len(cut)
    parts += [f"{role}: {text}" for role, text in transcript[-4:]]
    return "\n\n".join(parts)


def edit_prompt(request: str, path: str, source: str, start: int, end: int, context: list[tuple[str, str]], most: int = 12_000) -> str:
    """What a model would be given to change [start, end) of a source: the request, the part to
    change between marks, what is around it, and named context, within a budget. The part itself is
    never cut."""
    if not 0 <= start <= end <= len(source):
        raise ValueError("the range lies outside the source")
    part = source[start:end]
    room = max(0, most - len(part))
    before, after = source[:start][-(room // 3) :] if room >= 3 else "", source[end:][: room // 3]
    told = answer_prompt(request, context, [], room - len(before) - len(after))
    return f"{told}\n\n[{path}]\n{before}<<<\n{part}\n>>>{after}"


def folder_prompt(question: str, folder: str, summary: str, members: list[tuple[str, str]], most: int = 12_000) -> str:
    """What a model would be given about a folder: its summary, then its members in order, each with
    an even share of what is left of the budget."""
    room = max(0, most - len(summary))
    share = room // max(1, len(members))
    return answer_prompt(question, [(folder, summary), *((name, text[:share]) for name, text in members)], [], most)


def batches_of(ids: list[str], size: int) -> list[list[str]]:
    return [ids[at : at + size] for at in range(0, len(ids), size)]


def asked_in_batches(ids: list[str], ask: Callable[[list[str]], dict[str, float]], size: int = 16) -> dict[str, float]:
    """Answers to all ids, asked a batch at a time; each batch must answer just what it was asked."""
    out: dict[str, float] = {}
    for batch in batches_of(ids, size):
        out |= checked_answers(batch, ask(batch))
    return out


def extracted_claims(record: str, answer: list[dict], most: int = 8) -> list[dict]:
    """The claims that a model found in a record, as rows: id, text, confidence. Blank and repeated
    texts go, confidences are cut to 0 to 1, the first ``most`` stay."""
    out, seen = [], set()
    for claim in answer:
        text = " ".join(str(claim.get("text", "")).split())
        if text and text.lower() not in seen and len(out) < most:
            seen.add(text.lower())
            out.append({"id": f"{record}:{len(out)}", "text": text, "confidence": min(1.0, max(0.0, float(claim.get("confidence", 0.0))))})
    return out


def cluster_prompt(members: list[tuple[str, str]], most: int = 12, each: int = 240) -> str:
    """What a model would be given to name a group: its members in order, each cut to a length."""
    return "\n".join(f"- {name}: {' '.join(text.split())[:each]}" for name, text in members[:most]) + (f"\n({len(members) - most} more)" if len(members) > most else "")


def checked_answers(asked: list[str], answers: dict[str, float]) -> dict[str, float]:
    """Answers to a batch, whose ids must be those asked; confidences are cut to 0 to 1."""
    if set(asked) != set(answers):
        raise ValueError(f"answers differ from what was asked: {sorted(set(asked) ^ set(answers))[:5]}")
    return {k: min(1.0, max(0.0, v)) for k, v in answers.items()}


def hashed_terms(text: str, dims: int = 512) -> list[float]:
    """A deterministic embedding: signed hashing of words, unit length."""
    import hashlib
    import math

    v = [0.0] * dims
    for w in re.findall(r"\w+", text.lower()):
        h = int.from_bytes(hashlib.sha1(w.encode()).digest()[:8], "big")
        v[h % dims] += 1.0 if h >> 63 else -1.0
    norm = math.sqrt(sum(x * x for x in v))
    return [x / norm for x in v] if norm else v

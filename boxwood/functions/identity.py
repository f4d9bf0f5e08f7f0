"""Content-addressed identities, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUL = F.chr if hasattr(F, "chr") else F.char


def nul() -> Column:
    return _NUL(F.lit(0))


def short_sha1(text: Column, n: int) -> Column:
    return F.substring(F.sha1(text), 1, n)


def box_id(parent: Column, start: Column, end: Column) -> Column:
    """Path identity of a node; the root's parent is the empty string."""
    return short_sha1(F.concat_ws(":", F.coalesce(parent, F.lit("")), start.cast("string"), end.cast("string")), 12)


def content_hash(text: Column) -> Column:
    return short_sha1(text, 16)


def span_hash(text: Column, start: Column, end: Column) -> Column:
    return content_hash(F.substr(text, (start + 1).cast("int"), (end - start).cast("int")))


def parse_key(language: Column, content: Column) -> Column:
    return F.sha1(F.concat(language, nul(), content))


def folder_hash(children: Column) -> Column:
    """Of child hashes in path order."""
    return short_sha1(F.array_join(children, "|"), 16)


def frontier_signature(ids: Column) -> Column:
    return short_sha1(F.array_join(ids, "|"), 16)


def context_namespace(chain_keys: Column, file_hash: Column) -> Column:
    return short_sha1(F.concat(frontier_signature(chain_keys), F.lit(":"), file_hash), 16)


def patch_hash(old: Column, new: Column) -> Column:
    return F.sha2(F.concat(old, nul(), new), 256)


def sample_key(lang: Column, commit: Column, patch: Column, seed: str | None = None) -> Column:
    return F.sha2(F.concat_ws(":", *([F.lit(seed)] if seed is not None else []), lang, commit, patch), 256)


def stable_audit_id(prefix: str, *parts: Column) -> Column:
    """Prefix and 24 hex digits of the SHA-256 of the parts as a compact JSON array."""
    json = F.concat(F.lit("["), F.array_join(F.array(*(F.to_json(F.array(p)) for p in parts)), ","), F.lit("]"))
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.regexp_replace(json, r"\[(\"(?:[^\"\\]|\\.)*\"|[^\[\]]*)\]", "$1"), 256), 1, 24))


def holdout_id(lang: Column, repo: Column, commit: Column, path: Column) -> Column:
    digest = F.sha2(F.concat(lang, nul(), repo, nul(), commit, nul(), path), 256)
    return F.concat(F.lit("STATIC_"), F.upper(lang), F.lit("_"), F.upper(F.substring(digest, 1, 12)))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "^-+|-+$", "") if text is None else F.regexp_replace(F.lower(F.regexp_replace(text, "[^a-zA-Z0-9]+", "-")), "^-+|-+$", "")


def project_id(base: Column, path: Column) -> Column:
    return F.concat(slug(base), F.lit("-"), short_sha1(path, 8))


def file_id(path: Column) -> Column:
    """Runs of other characters to one dash, lower case; two paths may meet, the later row then stands."""
    return F.lower(F.regexp_replace(path, "[^a-zA-Z0-9]+", "-"))

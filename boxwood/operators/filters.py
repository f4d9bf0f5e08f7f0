"""Ordered exclusion and eligibility rules: one CASE, the first rule that holds gives the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LOCKFILES, NOISY_DIRS

# The reasons, their order, and the patterns and bounds in the rules below.
_EXTENSIONS = {"python": r"\.py$", "javascript": r"\.(?:js|mjs|cjs|jsx)$"}


def _longest(text: Column) -> Column:
    return F.array_max(F.transform(F.split(text, "\n"), F.length))


def cheap_exclusion(path: Column, old: Column, new: Column, language: Column) -> Column:
    """Why a changed file is left out, or null."""
    base = F.lower(F.element_at(F.split(path, "/"), -1))
    wrong = F.when(F.lit(False), F.lit(False))
    for name, pattern in _EXTENSIONS.items():
        wrong = wrong.when(language == name, ~F.rlike(base, F.lit(pattern)))
    return (
        F.when(F.coalesce(old, F.lit("")) == "", "file_addition")
        .when(F.coalesce(new, F.lit("")) == "", "file_deletion")
        .when(old == new, "unchanged")
        .when(base.isin(*LOCKFILES), "lockfile")
        .when(F.exists(F.split(F.lower(path), "/"), lambda s: s.isin(*NOISY_DIRS)), "noisy_path")
        .when(F.rlike(base, F.lit(r"\.(?:min|bundle)(?:\.[a-f0-9]{6,})?\.js$")), "minified_or_bundle")
        .when(F.rlike(base, F.lit(r"(?:^|[._-])(?:generated|gen)(?:[._-]|$)")), "generated_name")
        .when(F.rlike(F.substring(new, 1, 800), F.lit(r"(?i)auto[- ]?generated|generated (?:file|code)|do not edit|machine generated")), "generated_header")
        .when(wrong.otherwise(False), "wrong_extension")
        .when((F.length(new) > 2000) & (F.size(F.split(new, "\n")) < 5) & (_longest(new) > 1000), "minified_content")
    )


def extended_exclusion(path: Column, old: Column, new: Column, message: Column) -> Column:
    """As above for message studies: additions and deletions stay; formatting and set-up go."""
    squeeze = lambda c: F.regexp_replace(c, r"\s", "")
    return (
        F.when(F.trim(F.coalesce(message, F.lit(""))) == "", "missing_message")
        .when((F.coalesce(old, F.lit("")) == "") & (F.coalesce(new, F.lit("")) == ""), "empty_change")
        .when(squeeze(F.coalesce(old, F.lit(""))) == squeeze(F.coalesce(new, F.lit(""))), "formatting_only")
        .when(F.rlike(F.lower(path), F.lit(r"(?:^|/)(?:conftest\.py|setup\.py|jest\.config\.[a-z]+|test[-_]?setup\.[a-z]+)$")), "test_setup_boilerplate")
        .otherwise(cheap_exclusion(path, F.when(F.coalesce(old, F.lit("")) == "", F.lit(" ")).otherwise(old), F.when(F.coalesce(new, F.lit("")) == "", F.lit("  ")).otherwise(new), F.lit(None).cast("string")))
    )


def eligible_source(text: Column, least: int = 300, most: int = 50_000, lines: int = 5, longest: int = 1000) -> Column:
    return F.length(text).between(least, most) & (F.size(F.split(text, "\n")) >= lines) & (_longest(text) <= longest)


def excluded_path(path: Column) -> Column:
    return F.rlike(F.lower(path), F.lit(r"(?:^|/)(?:tests?|__tests__|spec|vendor|node_modules|build|dist|migrations)/|\.min\.js$|(?:^|/)(?:package-lock\.json|yarn\.lock|pnpm-lock\.yaml)$"))


def addition_dominant(added: Column, ratio: Column) -> Column:
    return F.coalesce((added >= 2) & (ratio <= 0.25), F.lit(False))


def atomic_eligibility(error: Column, parse_errors: Column, actions: Column, components: Column, most: int) -> Column:
    return F.when(error.isNotNull(), "gumtree_error").when(parse_errors > 0, "parse_error_nodes").when(actions == 0, "no_ast_actions").when(components > most, "too_many_components").otherwise("eligible")


def clause_match(features: Column, clauses: Column) -> Column:
    """True if for one of the clauses (arrays of atoms) every atom is among the features."""
    return F.exists(clauses, lambda c: F.size(F.array_except(c, features)) == 0)


def funnel(rows: DataFrame, keys: list[str], reason: str) -> DataFrame:
    """Counts by reason (``kept`` where null), for each key and in total (null key)."""
    return rows.withColumn(reason, F.coalesce(reason, F.lit("kept"))).groupingSets([[*map(F.col, keys), F.col(reason)], [F.col(reason)]], *keys, reason).agg(F.count("*").alias("n"))

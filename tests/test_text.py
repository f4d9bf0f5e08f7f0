"""String, identity, exclusion and metric expressions on small rows."""

from __future__ import annotations

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from boxwood.functions import identity, text
from boxwood.operators import evaluation, filters, lines


def one(spark, column, **values):
    """The value of an expression over one row of string, number or null columns."""
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("path", "old", "new", "reason"),
    [
        ("a/b.py", "", "x", "file_addition"),
        ("a/b.py", None, "x", "file_addition"),
        ("a/b.py", "x", "", "file_deletion"),
        ("a/b.py", "x", "x", "unchanged"),
        ("a/yarn.lock", "x", "y", "lockfile"),
        ("a/node_modules/b.py", "x", "y", "noisy_path"),
        ("src/generated_api.py", "x", "y", "generated_name"),
        ("app.min.js", "x", "y", "minified_or_bundle"),
        ("a/b.py", "x", "# Do not edit\ny", "generated_header"),
        ("a/b.txt", "x", "y", "wrong_extension"),
        ("a/b.py", "x", "y" * 2500, "minified_content"),
        ("a/b.py", "x", "y", None),
    ],
)
def test_cheap_exclusion_takes_the_first_rule(spark, path, old, new, reason):
    language = "javascript" if path.endswith(".js") else "python"
    got = one(spark, filters.cheap_exclusion(F.col("p"), F.col("o").cast("string"), F.col("n"), F.col("l")), p=path, o=old, n=new, l=language)
    assert got == reason


@pytest.mark.parametrize(
    ("old", "new", "message", "reason"),
    [("a", "b", "", "missing_message"), ("", "", "m", "empty_change"), ("a b", "a  b\n", "m", "formatting_only"), ("", "b", "m", None), ("a", "", "m", None)],
)
def test_extended_exclusion_keeps_additions_and_deletions(spark, old, new, message, reason):
    assert one(spark, filters.extended_exclusion(F.lit("a/b.py"), F.col("o"), F.col("n"), F.col("m")), o=old, n=new, m=message) == reason


@pytest.mark.parametrize(("added", "ratio", "want"), [(4, 0.25, True), (4, 0.26, False), (1, 0.0, False), (4, None, False)])
def test_addition_dominance(spark, added, ratio, want):
    assert one(spark, filters.addition_dominant(F.col("a"), F.col("r").cast("double")), a=added, r=ratio) is want


def test_atomic_eligibility_order(spark):
    e = lambda *v: one(spark, filters.atomic_eligibility(*(F.col(c).cast(t) for c, t in zip("abcd", ("string", "int", "int", "int"), strict=True)), 2), **dict(zip("abcd", v, strict=True)))
    assert [e("x", 1, 0, 9), e(None, 1, 0, 9), e(None, 0, 0, 9), e(None, 0, 1, 3), e(None, 0, 1, 2)] == ["gumtree_error", "parse_error_nodes", "no_ast_actions", "too_many_components", "eligible"]


def test_clause_match(spark):
    rows = spark.createDataFrame([(["a", "b", "c"], [["a", "x"], ["b", "c"]]), (["a"], [["a", "b"]])], "f array<string>, c array<array<string>>")
    assert [r["m"] for r in rows.select(filters.clause_match(F.col("f"), F.col("c")).alias("m")).collect()] == [True, False]


def test_patch_hash_follows_code_alone(spark):
    a = one(spark, identity.patch_hash(F.col("o"), F.col("n")), o="x", n="y")
    assert a == hashlib.sha256(b"x\0y").hexdigest()
    assert a != one(spark, identity.patch_hash(F.col("o"), F.col("n")), o="x", n="z")


def test_identities(spark):
    assert one(spark, identity.box_id(F.lit(None).cast("string"), F.lit(0), F.lit(9))) == hashlib.sha1(b":0:9").hexdigest()[:12]
    assert one(spark, identity.folder_hash(F.array(F.lit("a"), F.lit("b")))) == hashlib.sha1(b"a|b").hexdigest()[:16]
    assert one(spark, identity.file_id(F.lit("Src/a b.PY"))) == "src-a-b-py"
    assert one(spark, identity.stable_audit_id("c", F.lit("x"), F.lit(1))).startswith("c_")


def test_words(spark):
    assert one(spark, text.split_words(F.lit("getUserName 12 x, fooBar_9z"))) == ["get", "user", "name", "foo", "bar", "9z"]
    assert one(spark, text.useful_tokens(text.split_words(F.lit("get the userName userName")))) == ["name", "user"]
    tokens = one(spark, text.concept_tokens(F.array(F.lit("parseTree")), F.lit("lib/treeCut.js"), F.lit("Fix parse of trees")))
    assert list(tokens["changed_code"]) == ["parse", "tree"] and list(tokens["file_path"]) == ["cut", "tree"] and list(tokens["subject"] if "subject" in tokens else tokens[2]) == ["parse", "trees"]


def test_clip_and_excerpts(spark):
    assert one(spark, text.clip(F.lit("abcdef"), 3)) == "abc\n... first 3 of 6 characters"
    assert one(spark, text.clip(F.lit("abc"), 3)) == "abc"
    assert one(spark, text.head_tail(F.lit("a" * 50 + "b" * 60), 100)).endswith("b" * 28)
    assert one(spark, text.compact_excerpt(F.lit("a  b\n---\nc\n---\na b"))) == "a b\n---\nc"
    assert one(spark, text.strip_fences(F.lit("```py\nx = 1\n```"))) == "x = 1"


def test_line_labels(spark):
    body = F.lit("alpha\nbeta\ngamma")

    def label(a, b):
        return one(spark, text.line_range(lines.line_at(body, F.lit(a)), lines.line_at(body, F.lit(max(a, b - 1)))))

    assert [label(6, 10), label(2, 9), label(0, 6)] == ["Line 2", "Lines 1–2", "Line 1"]


def test_references(spark):
    docs = spark.createDataFrame([(1, "import foo\ndef foo(x):\n  foo(1) + foo\nfoobar $foo")], "doc long, body string")
    found = [(r["line"], r["kind"], r["hits"]) for r in lines.references(docs, "doc", "body", "foo").orderBy("line").collect()]
    assert found == [(1, "import", 1), (2, "definition", 1), (3, "call", 2)]
    assert lines.references(docs, "doc", "body", "f").count() == 0


def test_mentions_and_labels(spark):
    assert one(spark, text.mentions(F.lit("See Foo.Bar and foo, then Foo"), ["foo", "foo.bar"])) == ["foo.bar", "foo"]
    assert one(spark, text.repositories(F.lit(" b/x, a/y,,b/x "))) == ["a/y", "b/x"]
    assert one(spark, text.anchor(F.lit("'MyName'"))) == "myname"
    assert one(spark, text.clean_type(F.lit("if statement"))) == "if_statement"
    assert one(spark, text.normalised_label(F.lit("identifier"), F.lit("x"))) == "$ID"


def test_wilson_reproduces_published_intervals(spark):
    want = {(24, 35): (0.520202, 0.814492), (14, 18): (0.547854, 0.909991), (5, 9): (0.266651, 0.811221)}
    low, high = evaluation.wilson("k", "n")
    for r in spark.createDataFrame(list(want), "k int, n int").select("k", "n", F.round(low, 6).alias("a"), F.round(high, 6).alias("b")).collect():
        assert (r["a"], r["b"]) == want[r["k"], r["n"]]


def test_code_lengths(spark):
    got = spark.createDataFrame([(3, 10), (0, 5), (5, 5)], "k int, n int").select(evaluation.event_bits("k", "n").alias("e"), evaluation.enumerative_bits("k", "n").alias("m")).collect()
    assert got[0]["e"] == pytest.approx(-3 * math.log2(0.3) - 7 * math.log2(0.7))
    assert got[0]["m"] == pytest.approx(math.log2(math.comb(10, 3)) + math.log2(11), abs=1e-7)
    assert got[1]["e"] == got[2]["e"] == 0


def test_gates(spark):
    assert one(spark, evaluation.launch_gate(F.lit(0.2), F.lit(0.8), F.lit(0.05), F.lit(True))) is True
    assert one(spark, evaluation.launch_gate(F.lit(0.2), F.lit(0.79), F.lit(0.05), F.lit(True))) is False
    assert one(spark, evaluation.expansion_decision(F.lit(True), F.lit(False), F.lit(0.4), F.lit(0.5))) == "review"
    assert one(spark, evaluation.f_beta(F.lit(0.0), F.lit(0.0))) == 0
    assert one(spark, evaluation.clamp(F.lit(5.0), 0, 1)) == 1


def test_percentile_interpolates(spark):
    r = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 10.0)], "s string, v double")
    got = evaluation.state_summary(r, "s", "v", "a").first()
    assert (got["p50"], got["p95"], got["reduction_pct"]) == (2.0, 9.2, 0.0)

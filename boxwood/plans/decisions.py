"""Gates, verdicts, ranks and rules, one query for each decision; retrieval of changes by patterns."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import candidates, changes, evaluation, filters, retrieval, rules, trees, windows
from ..registry import query, table
from ..storage import materialise
from .changes import _ATOMS, _each, _features, _over, scripts, sources

_RATES = """WITH c AS (SELECT d.source, count(*) AS n, count(l.doc_id) AS labelled, count(*) FILTER (WHERE l.quality = 1) AS good, count(*) FILTER (WHERE l.toxic = 1) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source),
    r AS (SELECT source, labelled / n AS coverage, CASE WHEN labelled = 0 THEN 0 ELSE good / labelled END AS precision, CASE WHEN labelled = 0 THEN 0 ELSE toxic / labelled END AS rate, labelled >= 2 AS complete FROM c)"""


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    by = rows.groupBy("source").agg(F.count("*").alias("n"), F.count("quality").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"))
    share = lambda k: F.coalesce(F.try_divide(F.col(k), F.col("labelled")), F.lit(0.0))
    return by.select("source", (F.col("labelled") / F.col("n")).alias("coverage"), share("good").alias("precision"), share("toxic").alias("rate"), (F.col("labelled") >= 2).alias("complete"))


@query("launch_gate", _RATES + " SELECT source, round(coverage, 6) AS coverage, round(precision, 6) AS precision, coverage >= 0.2 AND precision >= 0.8 AND rate <= 0.05 AND complete AS ships FROM r")
def launch_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sources would pass the gate, with the share of toxic ones as the drop."""
    gate = evaluation.launch_gate(F.col("coverage"), F.col("precision"), F.col("rate"), F.col("complete"))
    return _rates(spark, sf_dir).select("source", F.round("coverage", 6).alias("coverage"), F.round("precision", 6).alias("precision"), gate.alias("ships"))


@query(
    "rule_verdicts",
    _RATES
    + """ SELECT source, CASE WHEN precision >= 0.75 AND coverage >= 0.3 AND CAST(round(rate * 100) AS INTEGER) >= 5 THEN 'strong' WHEN precision >= 0.5 AND CAST(round(rate * 100) AS INTEGER) >= 2 THEN 'weak' ELSE 'insufficient' END AS status,
    CASE WHEN complete AND precision >= 0.8 THEN 'expand' WHEN complete OR rate > 0.1 THEN 'review' ELSE 'reject' END AS decision, CASE WHEN precision >= 0.5 THEN 'add' WHEN coverage > 0.5 THEN 'remove' ELSE 'neutral' END AS sign,
    round(least(greatest(coverage * 3, 0.2), 1.0), 6) AS clamped, round(((precision * 10 + 1) / 12) / ((rate * 10 + 1) / 12), 6) AS lift FROM r""",
)
def rule_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, expansion, sign, clamped coverage and smoothed lift from each source's rates."""
    c, p, r, ok = (F.col(x) for x in ("coverage", "precision", "rate", "complete"))
    ten = F.lit(10.0)
    return _rates(spark, sf_dir).select(
        "source", evaluation.rule_status(p, c, F.round(r * 100).cast("int")).alias("status"), evaluation.expansion_decision(ok, r > 0.1, p, F.lit(0.8)).alias("decision"), evaluation.queue_sign(p, c, F.lit(1.0)).alias("sign"),
        F.round(evaluation.clamp(c * 3, 0.2, 1.0), 6).alias("clamped"), F.round(evaluation.smoothed_lift(p * 10, ten, r * 10, ten), 6).alias("lift"),
    )


@query(
    "change_eligibility",
    """WITH d AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'tests/a.py' WHEN 1 THEN 'lib/' || source || '.min.js' WHEN 2 THEN 'app/build/x.js' ELSE 'app/' || source || '.py' END AS path, doc_id % 4 AS added, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE (doc_id % 3) / (doc_id % 4 * 1.0) END AS ratio,
    CASE WHEN doc_id % 11 = 0 THEN 'broken' END AS error, CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS bad, doc_id % 3 AS actions, doc_id % 6 AS parts FROM documents)
    SELECT doc_id, regexp_matches(lower(path), '(?:^|/)(?:tests?|__tests__|spec|vendor|node_modules|build|dist|migrations)/|\\.min\\.js$|(?:^|/)(?:package-lock\\.json|yarn\\.lock|pnpm-lock\\.yaml)$') AS excluded, coalesce(added >= 2 AND ratio <= 0.25, FALSE) AS addition,
    CASE WHEN error IS NOT NULL THEN 'gumtree_error' WHEN bad > 0 THEN 'parse_error_nodes' WHEN actions = 0 THEN 'no_ast_actions' WHEN parts > 3 THEN 'too_many_components' ELSE 'eligible' END AS eligibility FROM d""",
)
def change_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excluded paths, changes that mostly add, and the eligibility cascade."""
    i = F.col("doc_id")
    path = F.when(i % 5 == 0, "tests/a.py").when(i % 5 == 1, F.concat(F.lit("lib/"), "source", F.lit(".min.js"))).when(i % 5 == 2, "app/build/x.js").otherwise(F.concat(F.lit("app/"), "source", F.lit(".py")))
    ratio = F.try_divide(i % 3, i % 4)
    state = filters.atomic_eligibility(F.when(i % 11 == 0, "broken"), F.when(i % 7 == 0, 1).otherwise(0), i % 3, i % 6, 3)
    return table(spark, sf_dir, "documents").select("doc_id", filters.excluded_path(path).alias("excluded"), filters.addition_dominant(i % 4, ratio).alias("addition"), state.alias("eligibility"))


@query(
    "clause_matches",
    """WITH d AS (SELECT doc_id, list_distinct(string_split_regex(lower(text), '[^a-z]+')) AS w FROM documents) SELECT doc_id, list_has_all(w, ['the', 'of']) OR list_has_all(w, ['der', 'und']) OR list_contains(w, 'que') AS hit FROM d""",
)
def clause_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that one of three AND-clauses of words describes."""
    clauses = F.array(F.array(F.lit("the"), F.lit("of")), F.array(F.lit("der"), F.lit("und")), F.array(F.lit("que")))
    return table(spark, sf_dir, "documents").select("doc_id", filters.clause_match(F.array_distinct(F.split(F.lower("text"), "[^a-z]+")), clauses).alias("hit"))


@query("percentile_ranks", "SELECT source, round(count(*) FILTER (WHERE n_chars <= 1500) / count(*), 6) AS rank FROM documents GROUP BY source")
def percentile_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each source's documents that are no longer than 1,500 characters."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.round(F.count_if(F.col("n_chars") <= 1500) / F.count("*"), 6).alias("rank"))


@query(
    "context_lines",
    """WITH l AS (SELECT doc_id, unnest(generate_series(1, len(string_split(text, chr(10))))) AS n, unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT doc_id, CAST(n AS BIGINT) AS line, max(CASE WHEN contains(line, 'the') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 1 AS shown FROM l""",
)
def context_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines within two of one that holds a word."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "body"))
    shown = windows.context_visible(F.contains("body", F.lit("the")), Window.partitionBy("doc_id").orderBy("pos"), 2)
    return rows.select("doc_id", (F.col("pos") + 1).cast("long").alias("line"), shown.alias("shown"))


@query(
    "side_coverage",
    """WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS s FROM orders)
    SELECT o_custkey AS custkey, o_orderkey AS orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN s > 1 THEN 1 ELSE 0 END, o_totalprice DESC, o_orderkey) AS p FROM r) t WHERE p <= 4""",
)
def side_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four orders a customer: the dearest of each status first."""
    kept = windows.cap_with_side_coverage(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus", [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()], 4)
    return kept.select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"))


@query(
    "language_universe",
    """WITH s AS (SELECT d.source, d.doc_id, CASE WHEN d.source IN ('src1', 'src2') AND l.toxic = 1 THEN 'en' ELSE d.lang END AS lang, l.toxic = 1 AS positive FROM documents d JOIN labels l USING (doc_id)), c AS (SELECT source, lang, count(*) AS n FROM s WHERE positive GROUP BY 1, 2),
    t AS (SELECT source, sum(n) AS total, max(struct_pack(n := n, lang := lang)) AS top FROM c GROUP BY source), o AS (SELECT source, CASE WHEN top.n / total >= 0.9 THEN top.lang END AS own FROM t)
    SELECT s.source, count(*) AS n, count(*) FILTER (WHERE s.positive) AS positives FROM s LEFT JOIN o ON o.source = s.source WHERE s.positive OR o.own IS NULL OR s.lang = o.own GROUP BY s.source""",
)
def language_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source's toxic documents are held against."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    lang = F.when(F.col("source").isin("src1", "src2") & (F.col("toxic") == 1), "en").otherwise(F.col("lang"))
    found = retrieval.language_universe(rows.select("source", "doc_id", lang.alias("lang"), (F.col("toxic") == 1).alias("positive")), "source")
    return found.groupBy("source").agg(F.count("*").alias("n"), F.count_if("positive").alias("positives"))


@query(
    "left_out_positives",
    _ATOMS
    + """, k AS (SELECT f.sample, bool_or(c.tp - 1 >= 2 AND (c.tp - 1) / (c.tp - 1 + c.fp) >= 0.5) AS hit FROM f JOIN t ON t.sample = f.sample JOIN c ON c.atom = f.atom WHERE t.positive GROUP BY f.sample)
    SELECT t.sample, coalesce(k.hit, FALSE) AS recalled FROM t LEFT JOIN k ON k.sample = t.sample WHERE t.positive""",
)
def left_out_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which toxic documents the words of the others would find."""
    return retrieval.leave_one_out(*_features(spark, sf_dir))


@query("clause_mdl")
def clause_mdl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each clause costs to write down, and saves on the labels that it decides."""
    features, truth = _features(spark, sf_dir)
    ranked = materialise(rules.rank_atoms(features, truth, 16))
    found = rules.clauses(features, truth, ranked, precision=0.0, longest=2)
    rows = found.select(F.array_join("clause", " & ").alias("clause"), "size", (F.col("tp") + F.col("fp")).alias("n"), "tp")
    bits = evaluation.rule_bits(F.col("size"), F.lit(16))
    return rows.select("clause", "n", "tp", F.round(bits, 4).alias("rule_bits"), F.round(evaluation.event_bits("tp", "n"), 4).alias("label_bits"), F.round(F.col("n") - evaluation.event_bits("tp", "n") - bits, 4).alias("saved"))


@query("static_rules")
def static_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses of structural features that tell sources with an added call from others."""

    def one(doc, old, new):
        return [(doc, x) for x in candidates.static_features(new, trees.parse(new, "python"))]

    features = materialise(_each(sources(spark, sf_dir), one, "sample long, atom string", [pa.int64(), pa.string()]))
    truth = materialise(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample"), (F.col("doc_id") % 4 == 1).alias("positive")))
    found = materialise(rules.clauses(features, truth, rules.rank_atoms(features, truth, 36)))
    chosen = rules.greedy(found, features, truth, most=4, beta=1.0)
    return spark.createDataFrame([(i, " AND ".join(c), s) for i, (c, s) in enumerate(chosen)], "place int, clause string, score double")


PATTERNS = [
    ("new_call", [(0, "action:insert-tree"), (1, "after:expression_statement"), (2, "after:call")], [(0, 1, "affects"), (1, 2, "child")]),
    ("renamed_call", [(0, "action:update-node"), (1, "before:identifier"), (2, "before:call")], [(0, 1, "affects"), (2, 1, "parent")]),
    ("dropped_statement", [(0, "action:delete-tree"), (1, "before:expression_statement"), (2, "before:function_definition")], [(0, 1, "affects"), (2, 1, "parent")]),
]


@query("pattern_hosts")
def pattern_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well a pattern's constraints alone find the changes whose graph holds it."""
    found = retrieval.hosts_of(scripts(spark, sf_dir, True), PATTERNS)
    return retrieval.retrieval_quality(found, "pattern", "constraint", "exact")


@query("tree_clusters")
def tree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserted and deleted subtrees, clustered by similarity."""

    def one(doc, actions):
        return [(json.dumps(retrieval.nested(x["subtree"])),) for x in actions if x["action"].endswith("-tree") and x["action"] != "move-tree"]

    return retrieval.tree_clusters(_over(scripts(spark, sf_dir, True), one, "tree string", [pa.string()]))


@query("complete_fragments")
def complete_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change graphs with their edges as vertices: how large they are, and whether each is a
    complete fragment."""

    def one(doc, actions):
        v, e = changes.reify(*changes.change_graph(actions))
        return [(doc, len(v), len(e), changes.is_complete(v, e))]

    return _over(scripts(spark, sf_dir, True), one, "doc_id long, vertices long, edges long, complete boolean", [pa.int64(), pa.int64(), pa.int64(), pa.bool_()])

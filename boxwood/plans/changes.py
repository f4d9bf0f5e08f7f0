"""Edits between versions of documents, their shapes, graphs, patterns and rules."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import candidates, changes, graphs, rules, trees
from ..partitions import deal
from ..registry import query, table
from ..storage import materialise_once


#: Characters of texts that are worked on before their rows are handed on.
SLICE = 4 << 20


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and texts, dealt to tasks before anything is made of them."""
    return deal(table(spark, sf_dir, "documents").select("doc_id", "text"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document before and after a made-up edit that follows from its id and text."""
    t, n = F.col("text"), F.col("doc_id") % 4
    new = F.when(n == 0, F.regexp_replace(t, r"^(\S+) (\S+)", "$2 $1")).when(n == 1, F.concat(t, F.lit("\nadded(first, second);\nadded(third);"))).when(n == 2, F.regexp_replace(t, "\n[^\n]*$", "")).otherwise(F.replace(t, F.lit("the"), F.lit("this")))
    return _documents(spark, sf_dir).select("doc_id", t.alias("old"), new.alias("new"))


def _each(rows: DataFrame, f, schema: str, types: list[pa.DataType]) -> DataFrame:
    """Rows of ``f(key, old, new)`` for each pair of versions. Rows are made and handed on a few
    megabytes of texts at a time, whatever the size of a batch."""
    names = [c.split()[0].strip("`") for c in schema.split(", ")]

    def made(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for i in range(batch.num_rows):
                d, a, b = (batch.column(k)[i].as_py() for k in range(3))
                out += f(d, a or "", b or "")
                held += len(a or "") + len(b or "")
                if held >= SLICE and out:
                    yield made(out)
                    out, held = [], 0
            if out:
                yield made(out)

    return rows.mapInArrow(run, schema)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python source made of each whole document, a call for each of its lines, before and
    after an edit that follows from its id: a name changed, a call added or dropped, another result."""
    words = F.transform(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) > 1), lambda w: F.concat(F.lit("w_"), w))
    calls = F.transform(F.split("text", "\n", -1), lambda t: F.filter(F.split(F.lower(t), "[^a-z]+"), lambda w: F.length(w) > 1))
    calls = F.transform(F.filter(calls, lambda ws: F.size(ws) > 0), lambda ws: F.concat(F.lit("        w_"), ws[0], F.lit("(x, '"), F.array_join(F.slice(ws, 2, F.size(ws)), " "), F.lit("')")))
    rows = _documents(spark, sf_dir).select("doc_id", calls.alias("calls"), F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit("w_none")).alias("last"))
    name = F.concat(F.lit("f_"), F.abs("doc_id").cast("string"))

    def source(body: Column, result: Column) -> Column:
        return F.concat(F.lit("def "), name, F.lit("(x):\n    if x > 1:\n        pass\n"), F.array_join(body, "\n"), F.lit("\n    return "), result, F.lit("\n"))

    n, calls = F.col("doc_id") % 4, F.col("calls")
    edited = F.when(n == 0, F.transform(calls, lambda c: F.regexp_replace(c, "^( *)w_the\\(", "$1w_this("))).when(n == 1, F.concat(calls, F.array(F.lit("        added(x, y=[2, 3])")))).when(n == 2, F.slice(calls, 1, F.greatest(F.size(calls) - 1, F.lit(0)))).otherwise(calls)
    result = F.when(n == 3, F.concat("last", F.lit("(x)"))).otherwise(F.lit("x"))
    return rows.select("doc_id", source(calls, F.lit("x")).alias("old"), source(edited, result).alias("new"))


def scripts(spark: SparkSession, sf_dir: str, code: bool = False) -> DataFrame:
    """(doc_id, actions as JSON): the edit scripts of all versions, worked out once."""

    def make() -> DataFrame:
        language = "python" if code else None

        def one(doc, old, new):
            return [(doc, json.dumps(changes.edit_script(old, new, language)))]

        rows = sources(spark, sf_dir) if code else versions(spark, sf_dir)
        return _each(rows, one, "doc_id long, actions string", [pa.int64(), pa.string()])

    return materialise_once(spark, f"scripts {code} {sf_dir}", make)


def _over(rows: DataFrame, f, schema: str, types: list[pa.DataType]) -> DataFrame:
    """Rows of ``f(key, actions)`` for each edit script."""
    return _each(deal(rows.select("doc_id", "actions")).withColumn("_", F.lit("")), lambda d, actions, _: f(d, json.loads(actions)), schema, types)


@query("edit_churn")
def edit_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(doc, actions):
        c = changes.churn(actions)
        return [(doc, len(actions), c["added"], c["removed"], c["moved"], c["net"], c["ratio"])]

    return _over(scripts(spark, sf_dir), one, "doc_id long, actions long, added long, removed long, moved long, net long, ratio double", [pa.int64()] * 6 + [pa.float64()])


@query("edit_components")
def edit_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(doc, actions):
        return [(doc, c["side"], c["kind"], c["start"], c["end"], len(c["actions"])) for c in changes.components(actions)]

    return _over(scripts(spark, sf_dir, True), one, "doc_id long, side string, kind string, start long, `end` long, actions long", [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()])


@query("edit_signatures")
def edit_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of the same shape, with their support and first examples."""
    signed = _over(scripts(spark, sf_dir), lambda d, a: [(d, changes.signature(a))], "doc_id long, signature string", [pa.int64(), pa.string()])
    ranked = signed.withColumn("place", F.row_number().over(Window.partitionBy("signature").orderBy("doc_id")))
    return ranked.groupBy("signature").agg(F.count("*").alias("support"), F.array_sort(F.collect_list(F.when(F.col("place") <= 5, F.col("doc_id")))).alias("examples"))


@query("edit_atoms")
def edit_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _over(scripts(spark, sf_dir, True), lambda d, a: [(d, x) for x in changes.atoms(a)], "doc_id long, atom string", [pa.int64(), pa.string()])
    return found.groupBy("atom").agg(F.count("*").alias("support"))


@query("edit_excerpts")
def edit_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence of each change: what its actions touch on both sides."""

    def one(doc, old, new):
        found = changes.excerpts(changes.edit_script(old, new, "python"), old, new)
        return [(doc, side, text) for side, text in found.items()]

    return _each(sources(spark, sf_dir), one, "doc_id long, side string, excerpt string", [pa.int64(), pa.string(), pa.string()])


@query("name_invariance")
def name_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the atoms of each change outlive the renaming of everything in it: without anchors
    they must, with anchors they need not."""

    def one(doc, actions):
        plain, named = set(changes.atoms(actions)), set(changes.atoms(actions, anchors=True))
        return [(doc, *changes.invariance(actions, plain), *changes.invariance(actions, named, True))]

    return _over(scripts(spark, sf_dir, True), one, "doc_id long, plain boolean, plain_renamed boolean, named boolean, named_renamed boolean", [pa.int64()] + [pa.bool_()] * 4)


@query("constrained_actions")
def constrained_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes with an insertion that touches a call, how many such actions and components."""

    def one(doc, actions):
        hit = changes.satisfies(actions, {"insert-tree", "insert-node"}, {"call"})
        parts = sum(bool(set(hit) & set(c["actions"])) for c in changes.components(actions))
        return [(doc, len(hit), parts)] if hit else []

    return _over(scripts(spark, sf_dir, True), one, "doc_id long, actions long, components long", [pa.int64()] * 3)


@query("candidate_universe")
def candidate_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes that each change may be about."""

    def one(doc, old, new):
        return [(doc, *(c[k] for k in ("side", "kind", "start", "end", "rank", "roles", "sign", "add", "remove", "neutral"))) for c in candidates.candidate_universe(old, new, "python")]

    schema = "doc_id long, side string, kind string, start long, `end` long, rank long, roles array<string>, sign string, add long, remove long, neutral long"
    return _each(sources(spark, sf_dir), one, schema, [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.int64(), pa.int64(), pa.int64()])


@query("static_features")
def static_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sources have each structural feature."""

    def one(doc, old, new):
        return [(doc, x) for x in candidates.static_features(old, trees.parse(old, "python"))]

    return _each(sources(spark, sf_dir), one, "doc_id long, feature string", [pa.int64(), pa.string()]).groupBy("feature").agg(F.count("*").alias("support"))


@query("token_diffs")
def token_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each pair of versions how many lines changed, and the characters of changed tokens."""

    def one(doc, old, new):
        rows, stats = changes.side_by_side(old, new)
        told = lambda side, kind: sum(len(t) for r in rows if r["kind"] == "modified" for k, t in r[side] if k == kind)
        return [(doc, stats["added"], stats["removed"], stats["modified"], told("before", "removed"), told("after", "added"), sum(r["kind"] == "skip" for r in rows))]

    return _each(versions(spark, sf_dir), one, "doc_id long, added long, removed long, modified long, chars_removed long, chars_added long, skips long", [pa.int64()] * 7)


@query("diff_stats")
def diff_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(doc, old, new):
        s = changes.diff_stats(old, new)
        return [(doc, s["added"], s["removed"], s["modified"])]

    return _each(versions(spark, sf_dir), one, "doc_id long, added long, removed long, modified long", [pa.int64()] * 4)


def _graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of all change graphs, written once in one pass over the edit scripts."""

    def parts(doc, actions):
        v, e = changes.change_graph(actions)
        return [(doc, i, None, label) for i, label in v] + [(doc, a, b, label) for a, b, label in e]

    def make() -> DataFrame:
        return _over(scripts(spark, sf_dir), parts, "graph long, a long, b long, label string", [pa.int64(), pa.int64(), pa.int64(), pa.string()])

    rows = materialise_once(spark, f"graphs {sf_dir}", make)
    return rows.where("b IS NULL").select("graph", F.col("a").alias("id"), "label"), rows.where("b IS NOT NULL").select("graph", F.col("a").alias("src"), F.col("b").alias("dst"), "label")


@query("frequent_patterns")
def frequent_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed frequent paths of the change graphs, in a hundredth of them or more."""
    v, e = _graphs(spark, sf_dir)
    least = max(2, v.select("graph").distinct().count() // 100)
    return graphs.closed(graphs.frequent_paths(v, e, least))


_FACETS = """WITH k AS (SELECT DISTINCT p_type AS p, p_brand AS b FROM part), t AS (SELECT DISTINCT CASE ascii(b[7:7]) % 5 WHEN 0 THEN 'if_statement' WHEN 1 THEN 'call_expression' WHEN 2 THEN 'method_definition' WHEN 3 THEN 'pair' ELSE lower(string_split(p, ' ')[1]) || '_statement' END AS kind FROM k
    UNION SELECT unnest(['string', 'identifier', 'for_statement', 'import_statement', 'comment', 'class_declaration', ';', 'variable_declarator', 'lambda', 'list', 'regex', 'try_statement', 'attribute', 'return_statement', 'binary_expression', 'object'])),
    e AS (SELECT kind, CASE WHEN kind = 'if_statement' THEN 'conditional_guard' WHEN kind = 'call_expression' THEN 'function_call' WHEN kind = 'method_definition' THEN 'function' WHEN kind = 'pair' THEN 'object_property' WHEN kind = 'string' THEN 'literal' WHEN kind = 'identifier' THEN 'identifier'
    WHEN kind = 'for_statement' THEN 'loop' WHEN kind = 'import_statement' THEN 'import' WHEN kind = 'comment' THEN 'comment' WHEN kind = 'class_declaration' THEN 'class' WHEN kind = ';' THEN 'delimiter' WHEN kind = 'variable_declarator' THEN 'assignment' WHEN kind = 'return_statement' THEN 'return_value' ELSE 'unknown_construct' END AS entity FROM t)
    SELECT kind, entity, CASE entity WHEN 'conditional_guard' THEN 100 WHEN 'function' THEN 90 WHEN 'class' THEN 90 WHEN 'object_property' THEN 80 WHEN 'function_call' THEN 75 WHEN 'import' THEN 70 WHEN 'assignment' THEN 65 WHEN 'return_value' THEN 60 WHEN 'loop' THEN 55 WHEN 'comment' THEN 30 WHEN 'literal' THEN 15 WHEN 'identifier' THEN 10 WHEN 'delimiter' THEN 0 ELSE 5 END AS rank,
    CASE WHEN kind = 'call_expression' THEN 'function_call' WHEN kind IN ('object', 'pair') THEN 'object_property' WHEN kind = 'if_statement' THEN 'conditional_guard' WHEN kind = 'method_definition' THEN 'function' WHEN kind = 'class_declaration' THEN 'class' WHEN kind = 'for_statement' THEN 'loop' END AS container,
    CASE kind WHEN 'method_definition' THEN 'function' WHEN 'class_declaration' THEN 'class' WHEN 'call_expression' THEN 'call' WHEN 'string' THEN 'string' WHEN 'return_statement' THEN 'return' WHEN 'if_statement' THEN 'conditional' WHEN 'for_statement' THEN 'iteration' WHEN 'pair' THEN 'assignment' WHEN 'attribute' THEN 'access'
    WHEN 'binary_expression' THEN 'operator' WHEN 'list' THEN 'sequence' WHEN 'object' THEN 'mapping' WHEN 'regex' THEN 'regex' WHEN 'try_statement' THEN 'error_flow' WHEN 'lambda' THEN 'lambda' WHEN 'import_statement' THEN 'import' END AS role FROM e"""


@query("facet_classes", _FACETS)
def facet_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities, containers, roles and ranks of node types, some of which follow from parts."""
    n = F.ascii(F.substring("p_brand", 7, 1)) % 5
    own = F.when(n == 0, "if_statement").when(n == 1, "call_expression").when(n == 2, "method_definition").when(n == 3, "pair").otherwise(F.concat(F.lower(F.split("p_type", " ")[0]), F.lit("_statement")))
    more = ["string", "identifier", "for_statement", "import_statement", "comment", "class_declaration", ";", "variable_declarator", "lambda", "list", "regex", "try_statement", "attribute", "return_statement", "binary_expression", "object"]
    kinds = table(spark, sf_dir, "part").select(own.alias("kind")).unionByName(spark.range(1).select(F.explode(F.array(*map(F.lit, more))).alias("kind"))).distinct()
    entity = text.entity(F.col("kind"), F.array("kind"))
    return kinds.select("kind", entity.alias("entity"), text.container(F.col("kind")).alias("container"), text.role(F.col("kind")).alias("role"), text.rank_of(entity).alias("rank"))


_COMPONENTS = r"""WITH RECURSIVE o AS (SELECT page_id AS k, unnest(list_distinct([split_part(regexp_replace(url, '^https?://', ''), '/', 1), 'n' || regexp_extract(url, '/(\d+)', 1)])) AS name FROM pages),
e AS (SELECT DISTINCT a.k AS a, b.k AS b FROM o a JOIN o b ON a.name = b.name), w(a, b) AS (SELECT a, b FROM e UNION SELECT w.a, e.b FROM w JOIN e ON e.a = w.b)
SELECT a AS k, min(b) AS component FROM w GROUP BY a"""


@query("provenance_components", _COMPONENTS)
def provenance_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of pages that share a host or a number in their address."""
    host = F.substring_index(F.regexp_replace("url", "^https?://", ""), "/", 1)
    names = F.array(host, F.concat(F.lit("n"), F.regexp_extract("url", r"/(\d+)", 1)))
    return graphs.share_a_name(table(spark, sf_dir, "pages").select(F.col("page_id").alias("k"), names.alias("names")), "k", "names")


_ATOMS = """WITH f AS (SELECT DISTINCT d.doc_id AS sample, w AS atom FROM (SELECT doc_id, unnest(list_distinct(string_split_regex(lower(text), '[^a-z]+'))) AS w FROM documents) d JOIN labels l ON l.doc_id = d.doc_id WHERE length(w) >= 4),
t AS (SELECT doc_id AS sample, toxic = 1 AS positive FROM labels), n AS (SELECT count(*) AS n, count(*) FILTER (WHERE positive) AS p FROM t),
c AS (SELECT atom, count(*) FILTER (WHERE positive) AS tp, count(*) FILTER (WHERE NOT positive) AS fp FROM f JOIN t USING (sample) GROUP BY atom),
s AS (SELECT atom, tp, fp, tp / (tp + fp) AS precision, (tp / (tp + fp)) / (p / n) AS lift FROM c, n WHERE tp > 0)
"""


def _features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    labels = table(spark, sf_dir, "labels")
    words = table(spark, sf_dir, "documents").join(labels.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("sample"), F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("atom"))
    return words.where(F.length("atom") >= 4), labels.select(F.col("doc_id").alias("sample"), (F.col("toxic") == 1).alias("positive"))


@query("rule_atoms", _ATOMS + "SELECT atom, tp, fp, round(precision, 6) AS precision, round(lift, 6) AS lift, round(precision * ln(1 + tp) * ln(1 + lift), 6) AS score FROM s ORDER BY round(precision * ln(1 + tp) * ln(1 + lift), 9) DESC, atom LIMIT 48")
def rule_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    features, truth = _features(spark, sf_dir)
    ranked = rules.rank_atoms(features, truth)
    return ranked.select("atom", "tp", "fp", *(F.round(c, 6).alias(c) for c in ("precision", "lift", "score")))


@query("rule_clauses")
def rule_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    features, truth = _features(spark, sf_dir)
    return rules.clauses(features, truth, rules.rank_atoms(features, truth))


@query("rule_induction")
def rule_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..storage import materialise

    features, truth = _features(spark, sf_dir)
    features, truth = materialise(features), materialise(truth)
    found = materialise(rules.clauses(features, truth, rules.rank_atoms(features, truth)))
    chosen = rules.greedy(found, features, truth)
    return spark.createDataFrame([(i, " AND ".join(c), s) for i, (c, s) in enumerate(chosen)], "place int, clause string, score double")


@query("tree_similarity")
def tree_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of each document's tree (cut to twelve boxes) before and after its edit."""
    def shape(body: str) -> tuple:
        root = trees.build(body, trees.parse(body, None))
        return ("file", tuple((" ".join(b.label.split()[:2]), ()) for b in trees.cut(root, 12, 1)))

    return _each(versions(spark, sf_dir), lambda d, a, b: [(d, changes.tree_distance(shape(a), shape(b)), round(changes.tree_similarity(shape(a), shape(b)), 6))], "doc_id long, distance long, similarity double", [pa.int64(), pa.int64(), pa.float64()])


@query("frequent_subgraphs")
def frequent_subgraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed frequent subgraphs of the change graphs, of up to five edges and so six vertices, in a
    twentieth of them or more."""
    from ..operators import subgraphs

    v, e = _graphs(spark, sf_dir)
    least = max(2, v.select("graph").distinct().count() // 20)
    return subgraphs.closed_subgraphs(*subgraphs.frequent_subgraphs(v, e, least, most_edges=5))

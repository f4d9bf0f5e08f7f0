"""Reviews, bundles, bounded picks, alignments, marks and contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, evidence, graphs, lines, trees, vectors
from ..registry import query, sql_query, table
from ..storage import materialise
from .trees import _LINE_TREE, line_tree
from .vectors import _U


@query(
    "review_validation",
    """WITH r AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '-' || source ELSE source END AS reviewer, CASE doc_id % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN ' uncertain ' ELSE 'maybe' END AS intent,
    substr(text, 1, CAST(doc_id % 5 AS INTEGER)) AS meaning, doc_id % 6 AS a, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE doc_id % 7 END AS b, (doc_id % 13) / 2 AS c FROM documents)
    SELECT doc_id, list_filter([CASE WHEN NOT regexp_matches(trim(reviewer), '^[A-Za-z0-9][A-Za-z0-9._-]{0,63}$') THEN 'reviewer_id' END, CASE WHEN trim(intent) NOT IN ('yes', 'no', 'uncertain') THEN 'shared_intent' END,
    CASE WHEN trim(intent) = 'yes' AND length(trim(meaning)) < 3 THEN 'output_meaning' END, CASE WHEN trim(intent) = 'yes' AND a NOT BETWEEN 1 AND 5 THEN 'entailment' END,
    CASE WHEN trim(intent) = 'yes' AND (b IS NULL OR b NOT BETWEEN 1 AND 5) THEN 'specificity' END, CASE WHEN c <> floor(c) OR c NOT BETWEEN 1 AND 5 THEN 'confidence' END], lambda e: e IS NOT NULL) AS errors FROM r""",
)
def review_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    reviewer = F.when(i % 7 == 0, F.concat(F.lit("-"), F.col("source"))).otherwise(F.col("source"))
    intent = F.when(i % 4 == 0, "yes").when(i % 4 == 1, "no").when(i % 4 == 2, " uncertain ").otherwise("maybe")
    errors = evidence.review_errors(reviewer, intent, F.substr("text", F.lit(1), (i % 5).cast("int")), i % 6, F.when(i % 11 != 0, i % 7), (i % 13) / 2)
    return table(spark, sf_dir, "documents").select("doc_id", errors.alias("errors"))


@query(
    "partition_check",
    """WITH m AS (SELECT doc_id FROM documents WHERE lang <> 'es'), i AS (SELECT doc_id FROM labels WHERE quality = 1), e AS (SELECT doc_id FROM labels WHERE quality = 0 OR toxic = 1)
    SELECT (SELECT count(*) FROM (SELECT doc_id FROM i INTERSECT SELECT doc_id FROM e)) AS in_both, (SELECT count(*) FROM (SELECT doc_id FROM m EXCEPT (SELECT doc_id FROM i UNION SELECT doc_id FROM e))) AS in_neither,
    (SELECT count(*) FROM ((SELECT doc_id FROM i UNION SELECT doc_id FROM e) EXCEPT SELECT doc_id FROM m)) AS not_members""",
)
def partition_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return evidence.partition_check(table(spark, sf_dir, "documents").where("lang <> 'es'"), labels.where("quality = 1"), labels.where("quality = 0 OR toxic = 1"), "doc_id")


@query("last_observation", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) t WHERE r = 1")
def last_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.last_by(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query(
    "capped_hits",
    """WITH l AS (SELECT doc_id, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS body FROM documents), h AS (SELECT doc_id, line FROM l WHERE regexp_matches(body, '(^|[^A-Za-z0-9_$])the($|[^A-Za-z0-9_$])'))
    SELECT doc_id, line, (SELECT count(*) FROM h) > 500 AS truncated FROM h ORDER BY doc_id, line LIMIT 500""",
)
def capped_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 lines that use a name, and whether there are more."""
    hits = lines.references(table(spark, sf_dir, "documents"), "doc_id", "text", "the").select("doc_id", F.col("line").cast("long").alias("line"))
    return evidence.capped_hits(hits, ["doc_id", "line"], 500)


_PATHS = r"regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')"


@query(
    "closest_names",
    f"""WITH p AS (SELECT DISTINCT {_PATHS} AS path FROM pages), here AS (SELECT split_part(min(path), '/', 1) || '/en' AS cwd FROM p), s AS (SELECT path, string_split(path, '/') AS parts FROM p),
    f AS (SELECT DISTINCT array_to_string(parts[1:n], '/') AS path FROM (SELECT parts, unnest(generate_series(1, len(parts) - 1)) AS n FROM s WHERE len(parts) > 1)),
    e AS (SELECT path, 'file' AS kind, string_split(path, '/') AS parts FROM p UNION ALL SELECT path, 'folder', string_split(path, '/') FROM f),
    x AS (SELECT e.path, kind, parts[-1] AS name, CASE WHEN parts[1:1] = string_split(cwd, '/')[1:1] THEN 1 ELSE 0 END + CASE WHEN parts[1:2] = string_split(cwd, '/') THEN 1 ELSE 0 END AS score FROM e, here)
    SELECT name, kind, path, score FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, kind, path) AS r FROM x) t WHERE r = 1""",
)
def closest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every name in the folder tree the path nearest to where the first page lies."""
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    paths = table(spark, sf_dir, "pages").select(path.alias("path")).distinct()
    first = paths.agg(F.min("path")).first()[0]
    return evidence.closest_names(paths, f"{(first or '').split('/')[0]}/en")


@query(
    "split_segments",
    """WITH s AS (SELECT event_id, CAST(floor(value) AS BIGINT) AS s, CAST(floor(value) AS BIGINT) + 10 AS e, CAST(event_id % 40 AS BIGINT) AS lo, CAST(event_id % 40 AS BIGINT) + 7 AS hi FROM events)
    SELECT event_id, s AS start, e AS "end", FALSE AS marked FROM s WHERE hi <= s OR lo >= e
    UNION ALL SELECT event_id, s, lo, FALSE FROM s WHERE hi > s AND lo < e AND lo > s
    UNION ALL SELECT event_id, greatest(s, lo), least(e, hi), TRUE FROM s WHERE hi > s AND lo < e
    UNION ALL SELECT event_id, hi, e, FALSE FROM s WHERE hi > s AND lo < e AND hi < e""",
)
def split_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.floor("value")
    rows = table(spark, sf_dir, "events").select("event_id", at.alias("s"), (at + 10).alias("e"), (F.col("event_id") % 40).alias("lo"), (F.col("event_id") % 40 + 7).alias("hi"))
    return evidence.split_segments(rows, "s", "e", "lo", "hi")


@query(
    "label_signature",
    """WITH c AS (SELECT o_custkey AS custkey, o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY custkey ORDER BY n DESC, label) AS r FROM c)
    SELECT custkey, string_agg(label || '×' || CAST(n AS VARCHAR), ' + ' ORDER BY r) AS signature FROM r WHERE r <= 8 GROUP BY custkey""",
)
def label_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.label_signature(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderpriority").alias("label")), "custkey", "label")


#: Lines of orders that one task joins and counts.
LINES = 200_000


@query(
    "drill_bundle",
    """SELECT o.o_orderkey AS record, count(DISTINCT l.l_linenumber) AS claims, count(DISTINCT p.p_brand) AS brands, round(sum(l.l_quantity), 2) AS quantity, min(c.c_mktsegment) AS segment
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey LEFT JOIN part p ON p.p_partkey = l.l_partkey GROUP BY o.o_orderkey""",
)
def drill_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each order holds. Rows are dealt to as many tasks as there are lines for, so that what a
    task sorts and counts stays the same whatever the tables' size."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // LINES))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand").repartition(n, "l_partkey")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment").repartition(n, "o_custkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").repartition(n, "o_custkey").join(customers, "o_custkey")
    held = lines.repartition(n, "l_partkey").join(parts, "l_partkey", "left").withColumnRenamed("l_orderkey", "o_orderkey")
    rows = orders.repartition(n, "o_orderkey").join(held.repartition(n, "o_orderkey"), "o_orderkey", "left")
    own = [F.count_distinct("l_linenumber").alias("claims"), F.count_distinct("p_brand").alias("brands"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.min("c_mktsegment").alias("segment")]
    return rows.groupBy(F.col("o_orderkey").alias("record")).agg(*own)


sql_query(
    "coverage_summary",
    """SELECT count(*) AS files, count(DISTINCT source) AS repositories, count(*) FILTER (WHERE quality IS NOT NULL) AS covered, round(count(*) FILTER (WHERE quality IS NOT NULL) / (count(*) * 1.0), 6) AS coverage,
    round(count(*) FILTER (WHERE quality = 1) / (count(*) * 1.0), 6) AS strong_rate, round(count(*) FILTER (WHERE quality = 0) / (count(*) * 1.0), 6) AS plausible_rate, round(count(*) FILTER (WHERE quality IS NULL) / (count(*) * 1.0), 6) AS none_rate
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
sql_query(
    "calibration_funnel",
    """SELECT 'records' AS stage, count(DISTINCT doc_id) AS n FROM documents UNION ALL SELECT 'labelled', count(DISTINCT d.doc_id) FROM documents d JOIN labels l ON l.doc_id = d.doc_id
UNION ALL SELECT 'good', count(DISTINCT d.doc_id) FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 1
UNION ALL SELECT 'clean', count(DISTINCT d.doc_id) FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 1 AND l.toxic = 0""",
)
sql_query(
    "pattern_examples",
    """SELECT t.source, t.doc_id, CAST(t.r AS BIGINT) AS place, l.quality FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) t
LEFT JOIN labels l ON l.doc_id = t.doc_id WHERE t.r <= 8""",
)
sql_query(
    "path_search",
    "SELECT page_id, url FROM pages WHERE lower(url) LIKE '%/en/%' OR contains(lower(url), '.org')",
)
sql_query(
    "review_sample",
    "SELECT doc_id, quality FROM labels ORDER BY sha2(concat(CAST(doc_id AS STRING), ':17'), 256), doc_id LIMIT 24",
    "SELECT doc_id, quality FROM labels ORDER BY sha256(CAST(doc_id AS VARCHAR) || ':17'), doc_id LIMIT 24",
)


def _fits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = vectors.units(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return rows, vectors.centroids(rows, "label").drop("n")


@query(
    "representatives",
    _U
    + """, m AS (SELECT own AS label, vec_id, s FROM f WHERE own = label), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS d, row_number() OVER (PARTITION BY label ORDER BY s, vec_id DESC) AS u FROM m)
    SELECT label, vec_id, CASE WHEN d = 1 THEN 'medoid' WHEN d <= 3 THEN 'core' ELSE 'boundary' END AS role FROM k WHERE d <= 3 OR u <= 3""",
)
def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centers = _fits(spark, sf_dir)
    fits = rows.join(vectors.small(centers), "label").select("label", "vec_id", F.round(vectors.dot("v", "c"), 9).alias("fit"))
    return evidence.representatives(fits, "label", "vec_id", 6)


_EXPAND = (
    _U
    + """, floors AS (SELECT label, min(s) - 0.05 AS floor FROM f WHERE own = label AND vec_id % 3 = 0 GROUP BY label),
    x AS (SELECT f.label, f.vec_id, f.s AS similarity, f.s >= floors.floor AS clears FROM f JOIN floors ON floors.label = f.label WHERE NOT (f.own = f.label AND f.vec_id % 3 = 0))
    SELECT label, vec_id, round(similarity, 6) AS similarity, clears FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS r FROM x WHERE {0}) t WHERE r <= 12"""
)


def _expanded(spark: SparkSession, sf_dir: str, keep_all: bool) -> DataFrame:
    rows, centers = _fits(spark, sf_dir)
    scored = vectors.nearest(rows, "vec_id", centers, "label", vectors.SMALL).join(rows.select("vec_id", F.col("label").alias("own")), "vec_id")
    scored = scored.select("label", "vec_id", "similarity", ((F.col("own") == F.col("label")) & (F.col("vec_id") % 3 == 0)).alias("seed"))
    return evidence.expand(scored, "label", "vec_id", 12, keep_all=keep_all).withColumn("similarity", F.round("similarity", 6))


@query("expand_to_floor", _EXPAND.format("clears"))
def expand_to_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best rows for each label that reach its seeds' floor."""
    return _expanded(spark, sf_dir, False)


@query("expand_with_flag", _EXPAND.format("TRUE"))
def expand_with_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many rows whatever the floor, with whether they reach it."""
    return _expanded(spark, sf_dir, True)


@query(
    "greedy_clauses",
    """WITH m AS (SELECT o_orderpriority AS cluster, o_orderkey AS member FROM orders), h AS (SELECT DISTINCT p_brand || '/' || p_type AS clause, l_orderkey AS member FROM lineitem JOIN part ON p_partkey = l_partkey),
    na AS (SELECT cluster, count(*) AS na FROM m GROUP BY 1), nb AS (SELECT clause, count(*) AS nb FROM h GROUP BY 1), x AS (SELECT m.cluster, h.clause, m.member FROM m JOIN h ON h.member = m.member),
    p AS (SELECT x.cluster, x.clause, count(*) AS shared, round(2.0 * count(*) / (na + nb), 9) AS f1 FROM x JOIN na ON na.cluster = x.cluster JOIN nb ON nb.clause = x.clause GROUP BY x.cluster, x.clause, na, nb HAVING count(*) / nb >= 0.1),
    r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY f1 DESC, shared DESC, clause) AS r FROM p), f AS (SELECT x.cluster, x.member, min(r.r) AS r FROM x JOIN r ON r.cluster = x.cluster AND r.clause = x.clause GROUP BY 1, 2),
    c AS (SELECT DISTINCT cluster, r FROM f) SELECT c.cluster, r.clause, CAST(row_number() OVER (PARTITION BY c.cluster ORDER BY c.r) AS BIGINT) AS place FROM c JOIN r ON r.cluster = c.cluster AND r.r = c.r QUALIFY place <= 6""",
)
def greedy_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clauses of part kinds that cover each order priority best."""
    members = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("cluster"), F.col("o_orderkey").alias("member"))
    kind = F.concat("p_brand", F.lit("/"), "p_type")
    hosts = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(kind.alias("clause"), F.col("l_orderkey").alias("member")).distinct()
    return evidence.greedy_clauses(members, hosts)


@query(
    "rule_cross_validation",
    """WITH t AS (SELECT doc_id AS sample, toxic = 1 AS positive, (row_number() OVER (ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) - 1) % 5 AS fold FROM labels),
    f AS (SELECT DISTINCT t.sample, w AS atom FROM (SELECT doc_id, unnest(list_distinct(string_split_regex(lower(text), '[^a-z]+'))) AS w FROM documents) d JOIN t ON t.sample = d.doc_id WHERE length(w) >= 4),
    b AS (SELECT atom, fold, count(*) FILTER (WHERE positive) AS p, count(*) FILTER (WHERE NOT positive) AS n FROM f JOIN t ON t.sample = f.sample GROUP BY 1, 2), w AS (SELECT atom, sum(p) AS p, sum(n) AS n FROM b GROUP BY 1),
    x AS (SELECT k.fold, w.atom, w.p - coalesce(b.p, 0) AS p, w.n - coalesce(b.n, 0) AS n FROM w CROSS JOIN (SELECT DISTINCT fold FROM t) k LEFT JOIN b ON b.atom = w.atom AND b.fold = k.fold),
    c AS (SELECT fold, atom FROM x WHERE p >= 2 AND p / (p + n) >= 0.5 QUALIFY row_number() OVER (PARTITION BY fold ORDER BY p DESC, n, atom) <= 8),
    h AS (SELECT DISTINCT f.sample FROM f JOIN t ON t.sample = f.sample JOIN c ON c.fold = t.fold AND c.atom = f.atom)
    SELECT CAST(t.fold AS BIGINT) AS fold, (SELECT count(*) FROM c WHERE c.fold = t.fold) AS atoms, count(*) FILTER (WHERE h.sample IS NOT NULL AND positive) AS tp, count(*) FILTER (WHERE h.sample IS NOT NULL AND NOT positive) AS fp,
    count(*) FILTER (WHERE h.sample IS NULL AND positive) AS fn FROM t LEFT JOIN h ON h.sample = t.sample GROUP BY t.fold""",
)
def rule_cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How words tell toxic documents, learned on four folds and judged on the fifth."""
    labels = table(spark, sf_dir, "labels")
    truth = evaluation.stable_folds(labels, "doc_id", 5).select(F.col("doc_id").alias("sample"), (F.col("toxic") == 1).alias("positive"), "fold")
    words = table(spark, sf_dir, "documents").join(labels.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("sample"), F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("atom"))
    return evidence.cross_validate(words.where(F.length("atom") >= 4), truth)


@query(
    "hierarchy_checks",
    """SELECT 'parent_exists' AS "check", 0 AS broken UNION ALL SELECT 'reachable', 0 UNION ALL SELECT 'depth', 0 UNION ALL SELECT 'containment', (SELECT count(*) FROM customer WHERE c_custkey % 50 = 0)
    UNION ALL SELECT 'disjoint_siblings', (SELECT count(*) FROM customer JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_nationkey = (c_nationkey + 5) % 25 WHERE c_custkey % 50 = 0 AND a.n_regionkey = b.n_regionkey)""",
)
def hierarchy_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions over nations over customers, a fiftieth of whom also sit in a nation whose region
    doesn't list them."""
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    nodes = nation.select(name("r", "n_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth")).distinct().unionByName(nation.select(name("n", "n_nationkey").alias("id"), name("r", "n_regionkey").alias("parent"), F.lit(1).alias("depth")))
    placed = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    stray = customer.where("c_custkey % 50 = 0").select(((F.col("c_nationkey") + 5) % 25).alias("k"), (F.col("c_custkey") + 10_000_000_000).alias("ghost"), "c_custkey")
    members = placed.select(name("n", "n_nationkey").alias("id"), F.col("c_custkey").alias("member")).unionByName(placed.select(name("r", "n_regionkey").alias("id"), F.col("c_custkey").alias("member")))
    extra = stray.select(name("n", "k").alias("id"), F.col("ghost").alias("member"))
    # The stray customer sits in a sibling as himself too where that nation is of the same region.
    same = stray.join(nation, F.col("k") == F.col("n_nationkey")).select("c_custkey", "k", F.col("n_regionkey").alias("rk")).join(placed.select("c_custkey", "n_regionkey"), "c_custkey").where("rk = n_regionkey")
    return graphs.check_hierarchy(nodes, members.unionByName(extra).unionByName(same.select(name("n", "k").alias("id"), F.col("c_custkey").alias("member"))))


@query(
    "literal_locator",
    _LINE_TREE
    + """, s AS (SELECT doc_id, text, substr(text, length(text) // 2, 14) AS literal FROM documents WHERE length(text) > 60), u AS (SELECT doc_id, CAST(instr(text, literal) - 1 AS BIGINT) AS "at", CAST(instr(text, literal) - 1 + length(literal) AS BIGINT) AS upto FROM s
    WHERE (length(text) - length(replace(text, literal, ''))) = length(literal))
    SELECT doc_id, "at", upto, id FROM (SELECT u.*, n.id, row_number() OVER (PARTITION BY u.doc_id ORDER BY n.depth DESC, n.id DESC) AS r FROM u JOIN nodes n ON n.doc_id = u.doc_id AND n.start <= u."at" AND n."end" >= u.upto) t WHERE r = 1""",
)
def literal_locator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a literal that occurs once lies, and the tightest box around it."""
    size, literal = F.length("text"), F.col("literal")
    docs = table(spark, sf_dir, "documents").where(size > 60).select("doc_id", "text", F.substr("text", F.floor(size / 2).cast("int"), F.lit(14)).alias("literal"))
    once = docs.where(size - F.length(F.replace("text", literal, F.lit(""))) == F.length(literal))
    at = F.instr(F.col("text"), literal).cast("long") - 1
    return trees.tightest(line_tree(spark, sf_dir), once.select("doc_id", at.alias("at"), (at + F.length(literal)).alias("upto")), "doc_id").select("doc_id", "at", "upto", "id")


_SPANS = """, s AS (SELECT doc_id, length(text) // 4 AS "at", length(text) // 2 AS upto FROM documents),
    t AS (SELECT s.*, n.id, row_number() OVER (PARTITION BY s.doc_id ORDER BY n.depth DESC, n.id DESC) AS r FROM s JOIN nodes n ON n.doc_id = s.doc_id AND n.start <= s."at" AND n."end" >= s.upto)
"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.length("text").cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", F.floor(size / 4).alias("at"), F.floor(size / 2).alias("upto"))


@query(
    "highlight_marks",
    _LINE_TREE
    + _SPANS
    + """SELECT doc_id, "at", upto, id FROM t WHERE r = 1 AND id <> 'r' UNION ALL
    SELECT t.doc_id, t."at", t.upto, g.id FROM t JOIN nodes g ON g.doc_id = t.doc_id AND g.depth = 1 AND g."end" > t."at" AND g.start < greatest(t.upto, t."at" + 1) WHERE t.r = 1 AND t.id = 'r'""",
)
def highlight_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.highlight_marks(line_tree(spark, sf_dir), _spans(spark, sf_dir), "doc_id")


@query("frontier_chunks")
def frontier_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text tiled around the third line of every seven and a highlight."""
    nodes = materialise(line_tree(spark, sf_dir))
    marks = nodes.where((F.col("depth") == 2) & (F.expr("try_cast(substr(id, 2) AS BIGINT)") % 7 == 3)).select("doc_id", "id")
    return evidence.frontier_chunks(nodes, marks, _spans(spark, sf_dir), table(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    "outermost_units",
    _LINE_TREE
    + """, p AS (SELECT doc_id, id, parent, depth FROM nodes WHERE "end" - start BETWEEN 200 AND 2000)
    SELECT doc_id, id FROM p WHERE NOT EXISTS (SELECT 1 FROM p a WHERE a.doc_id = p.doc_id AND (a.id = p.parent OR (a.id = 'r' AND p.id <> 'r')))""",
)
def outermost_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of a useful size that lie in no other."""
    nodes = line_tree(spark, sf_dir)
    return evidence.outermost(nodes, nodes.where((F.col("end") - F.col("start")).between(200, 2000)).select("doc_id", "id"), "doc_id")


@query(
    "line_context",
    """WITH l AS (SELECT doc_id, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS body, (len(string_split(text, chr(10))) + 1) // 2 AS a FROM documents),
    m AS (SELECT doc_id, count(*) AS lines, CAST(least(sum(length(body) + 1), 800) AS BIGINT) AS chars FROM l WHERE line BETWEEN a AND a + 1 GROUP BY doc_id),
    o AS (SELECT l.doc_id, length(body) + 1 AS size, sum(length(body) + 1) OVER (PARTITION BY l.doc_id ORDER BY greatest(a - line, line - a - 1), line ROWS UNBOUNDED PRECEDING) AS total, m.chars FROM l JOIN m ON m.doc_id = l.doc_id WHERE line NOT BETWEEN a AND a + 1)
    SELECT doc_id, 'highlight' AS part, lines, chars FROM m UNION ALL SELECT doc_id, 'around', count(*), CAST(sum(size) AS BIGINT) FROM o WHERE total <= 2000 - chars GROUP BY doc_id""",
)
def line_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounded evidence for a question about the two lines in the middle of each text."""
    docs = table(spark, sf_dir, "documents")
    rows = lines.line_table(docs, "doc_id", "text").join(docs.select("doc_id", F.floor((F.size(F.split("text", "\n", -1)) + 1) / 2).alias("a")), "doc_id")
    return evidence.line_context(rows.withColumn("b", F.col("a") + 1), "doc_id", "a", "b", 2_000)


@query(
    "folder_overview",
    """WITH d AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS f FROM documents), l AS (SELECT source, doc_id, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS body FROM d WHERE f <= 12)
    SELECT source, doc_id, CAST(line AS BIGINT) AS line, substr(body, 1, 41) AS excerpt FROM l WHERE line <= 12""",
)
def folder_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve files of each folder, twelve units of each, with an even allowance of text."""
    from ..operators.windows import bottom_hash_sample

    few = bottom_hash_sample(table(spark, sf_dir, "documents").select("source", "doc_id", "text"), ["source"], "doc_id", 12)
    rows = few.select("source", "doc_id", F.posexplode(F.slice(F.split("text", "\n", -1), 1, 12)).alias("pos", "body"))
    return rows.select("source", "doc_id", (F.col("pos") + 1).cast("long").alias("line"), F.substring("body", 1, 6_000 // 144).alias("excerpt"))


@query(
    "context_fold",
    f"""WITH p AS (SELECT page_id, {_PATHS} AS path, substr(sha1(html), 1, 16) AS bare FROM pages), s AS (SELECT page_id, bare, string_split(path, '/') AS parts FROM p),
    c AS (SELECT page_id, bare, list_prepend('', list_transform(generate_series(1, len(parts) - 1), lambda n: array_to_string(parts[1:n], '/'))) AS chain FROM s)
    SELECT page_id, substr(sha1(bare || ':' || list_reduce(chain, lambda a, b: substr(sha1(b || ':' || a), 1, 16))), 1, 16) AS context FROM c""",
)
def context_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's digest under its chain of folders, topmost first."""
    parts = F.split(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", ""), "/")
    chain = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "pages").select("page_id", evidence.fold_context(chain, F.substring(F.sha1("html"), 1, 16)).alias("context"))

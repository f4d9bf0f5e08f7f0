"""Aggregates, windows, set relations, alignment, evaluation and gates over plain tables."""

from __future__ import annotations

from ..registry import query, sql_query, table
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evaluation, sets, windows

sql_query(
    "telemetry_rollup",
    "SELECT event_type AS name, count(*) AS n, round(sum(value), 3) AS total, round(min(value), 3) AS low, round(max(value), 3) AS high, count(*) FILTER (WHERE value >= 50) AS hits, count(*) FILTER (WHERE value < 50) AS misses FROM events GROUP BY event_type",
)
sql_query(
    "count_by_ordered",
    "SELECT key, n, CAST(row_number() OVER (ORDER BY n DESC, key) AS BIGINT) AS place FROM (SELECT c_mktsegment AS key, count(*) AS n FROM customer GROUP BY c_mktsegment) t",
)
sql_query("corpus_scale", "SELECT count(*) AS files, CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS lines, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents")
sql_query(
    "binned_histogram",
    """SELECT CASE WHEN n <= 5 THEN CAST(n AS STRING) WHEN n <= 10 THEN '6-10' ELSE '11+' END AS bin, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS members
FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) t GROUP BY CASE WHEN n <= 5 THEN CAST(n AS STRING) WHEN n <= 10 THEN '6-10' ELSE '11+' END""",
)
# Counted by value first, so that the window runs over distinct values only.
sql_query(
    "empirical_cdf",
    "SELECT p_size, round(sum(n) OVER (ORDER BY p_size) * 1.0D / sum(n) OVER (), 6) AS share FROM (SELECT p_size, count(*) AS n FROM part GROUP BY p_size) t",
    "SELECT DISTINCT p_size, round(cume_dist() OVER (ORDER BY p_size), 6) AS share FROM part",
)
sql_query(
    "role_counts",
    "SELECT o_orderpriority AS priority, count(*) FILTER (WHERE o_orderstatus = 'O') AS open_, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_orderstatus = 'P') AS part_ FROM orders GROUP BY o_orderpriority",
)
sql_query("pool_summary", "SELECT count(*) AS total, count(*) FILTER (WHERE n <= 3) AS small, count(*) FILTER (WHERE n > 3) AS large, max(n) AS most FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) t")


@query(
    "percentile_summary",
    """SELECT event_type AS state, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95,
    round(100 * (1 - quantile_cont(value, 0.5) / (SELECT quantile_cont(value, 0.5) FROM events WHERE event_type = 'view')), 3) AS reduction_pct FROM events GROUP BY event_type""",
)
def percentile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.state_summary(table(spark, sf_dir, "events"), "event_type", "value", "view")


@query(
    "confusion_metrics",
    """WITH j AS (SELECT d.lang, l.quality AS truth, CASE WHEN d.n_chars >= 1500 THEN 1 ELSE 0 END AS pred FROM documents d JOIN labels l USING (doc_id)), c AS (
    SELECT lang, count(*) FILTER (WHERE pred = 1 AND truth = 1) AS tp, count(*) FILTER (WHERE pred = 1 AND truth = 0) AS fp, count(*) FILTER (WHERE pred = 0 AND truth = 1) AS fn, count(*) FILTER (WHERE pred = 0 AND truth = 0) AS tn FROM j GROUP BY lang)
    SELECT lang, tp, fp, fn, tn, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall,
    round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM c""",
)
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("lang", (F.col("n_chars") >= 1500).alias("pred"), (F.col("quality") == 1).alias("truth"))
    return evaluation.confusion(rows, ["lang"], "pred", "truth")


_FOLDS = """WITH f AS (SELECT doc_id, quality, toxic, (row_number() OVER (ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) - 1) % 5 AS fold FROM labels)"""


@query("cv_folds", _FOLDS + " SELECT doc_id, CAST(fold AS BIGINT) AS fold FROM f")
def cv_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.stable_folds(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", 5)


@query(
    "cv_totals",
    _FOLDS
    + """, c AS (SELECT fold, count(*) FILTER (WHERE toxic = 1 AND quality = 1) AS tp, count(*) FILTER (WHERE toxic = 1 AND quality = 0) AS fp, count(*) FILTER (WHERE toxic = 0 AND quality = 1) AS fn FROM f GROUP BY fold)
    SELECT CAST(count(*) AS BIGINT) AS folds, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(sum(tp) / (sum(tp) + sum(fp)), 6) AS precision, round(sum(tp) / (sum(tp) + sum(fn)), 6) AS recall FROM c""",
)
def cv_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    folds = evaluation.stable_folds(labels, "doc_id", 5)
    return evaluation.micro_average(folds.withColumn("pred", F.col("toxic") == 1).withColumn("truth", F.col("quality") == 1), "fold", "pred", "truth")


@query(
    "wilson_gate",
    """WITH c AS (SELECT d.source, count(*) AS n, count(*) FILTER (WHERE l.quality = 1) AS k FROM documents d JOIN labels l USING (doc_id) GROUP BY d.source), z AS (SELECT *, 1.959964 AS z FROM c)
    SELECT source, n, k, round(k / n, 6) AS rate, round((k / n + z * z / (2 * n) - z * sqrt(k / n * (1 - k / n) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 6) AS low,
    round((k / n + z * z / (2 * n) + z * sqrt(k / n * (1 - k / n) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 6) AS high, k / n >= 0.8 AND n >= 10 AS passes FROM z""",
)
def wilson_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("k"))
    low, high = evaluation.wilson("k", "n")
    return rows.select("source", "n", "k", F.round(F.col("k") / F.col("n"), 6).alias("rate"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), ((F.col("k") / F.col("n") >= 0.8) & (F.col("n") >= 10)).alias("passes"))


@query(
    "result_equivalence",
    """WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT o_custkey AS k, CAST(sum(1) AS BIGINT) AS n FROM orders GROUP BY o_custkey)
    SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS only_left, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS only_right, TRUE AS same""",
)
def result_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    a, b = orders.groupBy("o_custkey").count(), orders.groupBy("o_custkey").agg(F.sum(F.lit(1)).alias("n"))
    return sets.multiset_difference(a, b)


_SUPPLIED = "SELECT DISTINCT l_suppkey AS id, l_partkey AS member FROM lineitem"


@query(
    "set_relations",
    f"""WITH m AS ({_SUPPLIED}), s AS (SELECT id, count(*) AS n FROM m GROUP BY id), o AS (SELECT a.id AS a, b.id AS b, count(*) AS common FROM m a JOIN m b ON a.member = b.member AND a.id < b.id GROUP BY a.id, b.id)
    SELECT o.a, o.b, o.common AS shared, CASE WHEN common = x.n AND common = y.n THEN 'equal' WHEN common = x.n THEN 'subset' WHEN common = y.n THEN 'superset' ELSE 'partial' END AS relation,
    round(common / (x.n + y.n - common), 6) AS jaccard FROM o JOIN s x ON x.id = o.a JOIN s y ON y.id = o.b""",
)
def set_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("member")).distinct()
    return sets.set_relations(members)


@query(
    "cluster_overlap_alignment",
    """WITH j AS (SELECT l.doc_id AS m, d.source AS a, CASE WHEN l.quality = 1 THEN 'good' ELSE 'bad' END || '/' || CASE WHEN l.toxic = 1 THEN 'toxic' ELSE 'clean' END AS b FROM labels l JOIN documents d USING (doc_id)), n AS (SELECT count(*) AS total FROM j),
    x AS (SELECT a, count(*) AS na FROM j GROUP BY a), y AS (SELECT b, count(*) AS nb FROM j GROUP BY b), o AS (SELECT a, b, count(*) AS common FROM j GROUP BY a, b)
    SELECT o.a, o.b, common AS shared, round(common / na, 6) AS coverage, round(common / nb, 6) AS purity, round(common / (na + nb - common), 6) AS jaccard, round((common / na) / (nb / total), 6) AS lift, round(2.0 * common / (na + nb), 6) AS f1
    FROM o JOIN x ON x.a = o.a JOIN y ON y.b = o.b, n WHERE common >= 2""",
)
def cluster_overlap_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    kind = F.concat(F.when(F.col("quality") == 1, "good").otherwise("bad"), F.lit("/"), F.when(F.col("toxic") == 1, "toxic").otherwise("clean"))
    return sets.align(labels.select(F.col("source").alias("a"), F.col("doc_id").alias("member")), labels.select(kind.alias("b"), F.col("doc_id").alias("member")), least=2)


@query(
    "and_clause_proposals",
    """WITH m AS (SELECT DISTINCT l.l_orderkey AS host, p.p_brand AS atom FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey), s AS (SELECT atom, count(*) AS n FROM m GROUP BY atom),
    o AS (SELECT a.atom AS a, b.atom AS b, count(*) AS joint FROM m a JOIN m b ON a.host = b.host AND a.atom < b.atom GROUP BY a.atom, b.atom)
    SELECT o.a, o.b, joint, x.n AS n_a, y.n AS n_b FROM o JOIN s x ON x.atom = o.a JOIN s y ON y.atom = o.b WHERE joint >= 3 AND joint < least(x.n, y.n)""",
)
def and_clause_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    atoms = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("host"), F.col("p_brand").alias("atom")).distinct()
    return sets.joint_clauses(atoms, 3)


@query(
    "relationship_patterns",
    """WITH e AS (SELECT event_type AS op, json_extract_string(props, '$.k') AS entity, user_id FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL)
    SELECT op, entity, count(DISTINCT user_id) AS support, list_sort(list(DISTINCT user_id))[1:5] AS examples FROM e GROUP BY op, entity""",
)
def relationship_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("op"), F.get_json_object("props", "$.k").alias("entity"), "user_id").where("entity IS NOT NULL").distinct()
    place = F.row_number().over(Window.partitionBy("op", "entity").orderBy("user_id"))
    ranked = rows.withColumn("place", place)
    return ranked.groupBy("op", "entity").agg(F.count("*").alias("support"), F.array_sort(F.collect_list(F.when(F.col("place") <= 5, F.col("user_id")))).alias("examples"))


@query(
    "cluster_stability",
    """WITH o AS (SELECT o_custkey AS m, o_orderpriority AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
    a AS (SELECT m, c FROM o WHERE r = 1), b AS (SELECT m, c FROM o WHERE r = n AND n > 1), d AS (SELECT a.c AS source, coalesce(b.c, 'SINGLETON:' || CAST(a.m AS VARCHAR)) AS target, count(*) AS n FROM a LEFT JOIN b ON b.m = a.m GROUP BY 1, 2),
    t AS (SELECT source, CAST(sum(n) AS BIGINT) AS size FROM d GROUP BY source), k AS (SELECT d.source, d.target, d.n, t.size, row_number() OVER (PARTITION BY d.source ORDER BY d.n DESC, d.target) AS r FROM d JOIN t ON t.source = d.source)
    SELECT source, target, n AS kept, size, round(n / size, 6) AS retention, CASE WHEN starts_with(target, 'SINGLETON:') THEN 'dissolved' WHEN n / size >= 0.8 THEN CASE WHEN source = target THEN 'stable' ELSE 'label_shift' END WHEN n / size >= 0.5 THEN 'partial_split' ELSE 'split' END AS class FROM k WHERE r = 1""",
)
def cluster_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    ends = orders.groupBy("o_custkey").agg(F.min(F.struct("o_orderdate", "o_orderkey", "o_orderpriority")).alias("a"), F.max(F.struct("o_orderdate", "o_orderkey", "o_orderpriority")).alias("b"), F.count("*").alias("n"))
    first = ends.select(F.col("o_custkey").alias("member"), F.col("a.o_orderpriority").alias("cluster"))
    last = ends.where("n > 1").select(F.col("o_custkey").alias("member"), F.col("b.o_orderpriority").alias("cluster"))
    return sets.stability(first, last)


@query(
    "fk_integrity",
    """SELECT 'lineitem.l_orderkey' AS reference, count(*) AS broken FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l.l_orderkey)
    UNION ALL SELECT 'orders.o_custkey', count(*) FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o.o_custkey)
    UNION ALL SELECT 'lineitem.l_partkey', count(*) FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l.l_partkey)
    UNION ALL SELECT 'labels.doc_id', count(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)""",
)
def fk_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {n: table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "part", "labels", "documents")}
    return sets.foreign_keys([
        ("lineitem.l_orderkey", t["lineitem"], "l_orderkey", t["orders"], "o_orderkey"),
        ("orders.o_custkey", t["orders"], "o_custkey", t["customer"], "c_custkey"),
        ("lineitem.l_partkey", t["lineitem"], "l_partkey", t["part"], "p_partkey"),
        ("labels.doc_id", t["labels"], "doc_id", t["documents"], "doc_id"),
    ])


@query(
    "artifact_verification",
    """WITH i AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE lang <> 'es'), c AS (SELECT doc_id, sha256(CASE WHEN source = 'src3' THEN upper(text) ELSE text END) AS h FROM documents WHERE lang <> 'de')
    SELECT CASE WHEN c.doc_id IS NULL THEN 'missing' WHEN i.doc_id IS NULL THEN 'unindexed' WHEN i.h = c.h THEN 'verified' ELSE 'hash_mismatch' END AS status, count(*) AS n FROM i FULL OUTER JOIN c ON i.doc_id = c.doc_id GROUP BY 1""",
)
def artifact_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = docs.where("lang <> 'es'").select(F.col("doc_id").alias("name"), F.sha2("text", 256).alias("hash"))
    found = docs.where("lang <> 'de'").select(F.col("doc_id").alias("name"), F.sha2(F.when(F.col("source") == "src3", F.upper("text")).otherwise(F.col("text")), 256).alias("hash"))
    return sets.verify_index(index, found).groupBy("status").agg(F.count("*").alias("n"))


@query(
    "mdl_bits",
    """WITH c AS (SELECT l_returnflag AS rule, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE l_linestatus = 'F') AS DOUBLE) AS k FROM lineitem GROUP BY l_returnflag)
    SELECT rule, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS k, round(CASE WHEN k IN (0, n) THEN 0 ELSE -k * log2(k / n) - (n - k) * log2((n - k) / n) END, 4) AS event_bits,
    round((lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)) / ln(2) + log2(n + 1), 4) AS enumerative_bits FROM c""",
)
def mdl_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("rule")).agg(F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "F").alias("k"))
    return rows.select("rule", "n", "k", F.round(evaluation.event_bits("k", "n"), 4).alias("event_bits"), F.round(evaluation.enumerative_bits("k", "n"), 4).alias("enumerative_bits"))


@query("transcript_window", "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) t WHERE r <= 4")
def transcript_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.latest(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", 4)


@query(
    "fold_atom_jaccard",
    """WITH f AS (SELECT DISTINCT l_linenumber AS fold, l_partkey AS atom FROM lineitem), s AS (SELECT fold, count(*) AS n FROM f GROUP BY fold),
    p AS (SELECT a.fold AS fa, b.fold AS fb, count(*) AS common FROM f a JOIN f b ON a.atom = b.atom AND a.fold < b.fold GROUP BY 1, 2)
    SELECT round(avg(common / (x.n + y.n - common)), 6) AS mean_jaccard, count(*) AS pairs FROM p JOIN s x ON x.fold = p.fa JOIN s y ON y.fold = p.fb""",
)
def fold_atom_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("id"), F.col("l_partkey").alias("member")).distinct()
    return sets.mean_jaccard(members)


@query(
    "exact_composite_dedup",
    """WITH h AS (SELECT l_partkey AS base, list_sort(list(DISTINCT l_suppkey)) AS hosts FROM lineitem GROUP BY l_partkey), k AS (SELECT base, len(hosts) AS n, sha256(array_to_string(hosts, ',')) AS key FROM h)
    SELECT key, CAST(max(n) AS BIGINT) AS support, min(base) AS representative, count(*) AS merged FROM k GROUP BY key""",
)
def exact_composite_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.merge_equal_hosts(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("base"), F.col("l_suppkey").alias("host")))


@query(
    "lru_eviction",
    "SELECT user_id, r > 100 AND NOT exempt AS evicted, CAST(r AS BIGINT) AS place FROM (SELECT user_id, bool_or(event_type = 'signup' AND value > 90) AS exempt, row_number() OVER (ORDER BY bool_or(event_type = 'signup' AND value > 90), max(ts) DESC, user_id) AS r FROM events GROUP BY user_id) t",
)
def lru_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred users seen last stay, and those who are exempt."""
    return windows.lru(table(spark, sf_dir, "events"), "user_id", "ts", 100, (F.col("event_type") == "signup") & (F.col("value") > 90))


@query("fallback_selection", "SELECT event_type, arg_max(user_id, struct_pack(ts := ts, id := event_id)) AS latest_user FROM events GROUP BY event_type")
def fallback_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.max_by("user_id", F.struct("ts", "event_id")).alias("latest_user"))


@query(
    "tier_classification",
    """WITH s AS (SELECT s_suppkey AS id, s_acctbal / 10000 AS fit, lead(s_acctbal / 10000) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS next_fit FROM supplier)
    SELECT id, CASE WHEN fit >= 0.8 AND coalesce(next_fit - fit, 1) >= 0.02 THEN 'high' WHEN fit >= 0.62 THEN 'medium' WHEN fit >= 0.4 THEN 'low' ELSE 'abstain' END AS tier FROM s""",
)
def tier_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("s_nationkey").orderBy("s_acctbal", "s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 10000).alias("fit"), (F.lead(F.col("s_acctbal") / 10000).over(w)).alias("next_fit"))
    return rows.select("id", evaluation.confidence_tier(F.col("fit"), F.coalesce(F.col("next_fit") - F.col("fit"), F.lit(1.0))).alias("tier"))

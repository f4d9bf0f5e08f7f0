"""Strict lookups, as-of joins, exact containers, bundles, audits, closures and patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graphs, joins, sets
from ..registry import query, sql_query, table
from .changes import _COMPONENTS


@query("strict_lookup", "SELECT d.source, count(*) AS n, CAST(sum(l.quality) AS BIGINT) AS good FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY d.source")
def strict_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with the documents that they name, every one of which must be there."""
    found = joins.lookup(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return found.groupBy("source").agg(F.count("*").alias("n"), F.sum("quality").cast("long").alias("good"))


@query(
    "row_index_join",
    """WITH c AS (SELECT c_mktsegment AS segment, c_name AS named, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_name) - 1 AS row_index FROM customer)
    SELECT s.c_custkey AS custkey, c.segment, c.row_index, c.named FROM customer s JOIN c ON c.segment = s.c_mktsegment AND c.row_index = s.c_custkey % 20""",
)
def row_index_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    samples = customer.select(F.col("c_custkey").alias("custkey"), F.col("c_mktsegment").alias("segment"), (F.col("c_custkey") % 20).alias("row_index"))
    return joins.by_row(samples, customer.select(F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("named")), "segment", "named")


@query("before_and_after", "SELECT doc_id FROM documents WHERE contains(text, 'the') INTERSECT SELECT doc_id FROM documents WHERE contains(upper(text), 'AND') INTERSECT SELECT doc_id FROM labels WHERE quality = 1")
def before_and_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return joins.in_both(docs.where(F.contains("text", F.lit("the"))), docs.where(F.contains(F.upper("text"), F.lit("AND"))), table(spark, sf_dir, "labels").where("quality = 1"), "doc_id")


_AS_OF = """WITH p AS (SELECT l.event_id, r.value, r.ts, row_number() OVER (PARTITION BY l.event_id ORDER BY r.ts DESC NULLS LAST, r.value DESC NULLS LAST) AS k, l.ts AS asked FROM events l LEFT JOIN events r ON r.user_id = l.user_id AND r.event_type = 'view' AND r.ts <= l.ts WHERE l.event_type <> 'view')
    SELECT event_id, {0} AS last_view FROM p WHERE k = 1"""


def _views(spark: SparkSession, sf_dir: str, within=None) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    right = events.where("event_type = 'view'").select("user_id", "ts", F.col("value").alias("last_view"))
    return joins.as_of(events.where("event_type <> 'view'").select("event_id", "user_id", "ts"), right, ["user_id"], "ts", ["last_view"], within).select("event_id", "last_view")


@query("as_of_join", _AS_OF.format("value"))
def as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other event with what its user last viewed."""
    return _views(spark, sf_dir)


@query("interval_join", _AS_OF.format("CASE WHEN ts >= asked - INTERVAL 1 DAY THEN value END"))
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, of views within a day before."""
    return _views(spark, sf_dir, F.col("_right_at") >= F.col("ts") - F.expr("INTERVAL 1 DAY"))


@query(
    "exact_container",
    """WITH e AS (SELECT user_id, event_type AS kind, CAST(floor(value) AS BIGINT) AS v FROM events), b AS (SELECT user_id, kind, CAST(min(v) AS BIGINT) AS s, CAST(max(v) AS BIGINT) AS e FROM e GROUP BY user_id, kind),
    o AS (SELECT DISTINCT user_id, v AS "at", v + 3 AS upto, kind FROM e)
    SELECT user_id, "at", upto, kind, id, exact, same_kind FROM (SELECT o.*, b.kind AS id, b.s = o."at" AND b.e = o.upto AS exact, b.kind = o.kind AS same_kind,
    row_number() OVER (PARTITION BY o.user_id, o."at", o.upto, o.kind ORDER BY NOT (b.s = o."at" AND b.e = o.upto), b.kind <> o.kind, b.e - b.s, b.kind) AS r FROM o JOIN b ON b.user_id = o.user_id AND b.s <= o."at" AND b.e >= o.upto) t WHERE r = 1""",
)
def exact_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The span of the same user that holds each event's: the same extent first, then its type."""
    events = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("kind"), F.floor("value").alias("v"))
    boxes = events.groupBy("user_id", "kind").agg(F.min("v").alias("start"), F.max("v").alias("end")).withColumn("id", F.col("kind")).withColumn("depth", F.lit(0))
    return joins.best_container(events.select("user_id", F.col("v").alias("at"), (F.col("v") + 3).alias("upto"), "kind").distinct(), boxes, "user_id")


@query(
    "ordered_bundle",
    """WITH c AS (SELECT l_orderkey AS claim, CAST(l_partkey AS VARCHAR) AS candidate, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
    k AS (SELECT claim, max(n) AS n, string_agg(candidate, '+' ORDER BY r) AS cs FROM c WHERE r <= 3 GROUP BY claim),
    o AS (SELECT o_custkey AS record, o_orderkey AS claim, coalesce(n, 0) AS n, coalesce(cs, '') AS cs FROM orders LEFT JOIN k ON k.claim = o_orderkey)
    SELECT c_custkey AS record, coalesce(string_agg(CAST(o.claim AS VARCHAR) || ':' || CAST(o.n AS VARCHAR) || ':' || o.cs, ';' ORDER BY o.claim), '') AS bundle FROM customer LEFT JOIN o ON o.record = c_custkey GROUP BY c_custkey""",
)
def ordered_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders in order, each with its first three parts in order."""
    claims = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("record"), F.col("o_orderkey").alias("claim"))
    parts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim"), F.col("l_partkey").cast("string").alias("candidate"), "l_linenumber", "l_partkey", "l_suppkey")
    found = joins.drill_bundle(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record")), claims, parts, "record", "claim", ["l_linenumber", "l_partkey", "l_suppkey"], 3)
    told = F.transform("claims", lambda c: F.concat_ws(":", c["claim"].cast("string"), c["n"].cast("string"), F.array_join(c["candidates"], "+")))
    return found.select("record", F.array_join(told, ";").alias("bundle"))


@query("audit_ranks", "SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS generation_rank, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) - 1 AS size_rank FROM documents")
def audit_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return joins.ranks_for_audit(rows, "lang", {"generation_rank": [F.col("doc_id").asc()], "size_rank": [F.col("n_chars").desc(), F.col("doc_id").asc()]}).drop("n_chars")


@query(
    "removal_fallback",
    """WITH s AS (SELECT user_id, max(ts) AS used FROM events GROUP BY user_id), a AS (SELECT max(user_id) AS active FROM s), k AS (SELECT s.*, active FROM s, a WHERE user_id % 7 <> (SELECT active % 7 FROM a)),
    m AS (SELECT arg_max(user_id, struct_pack(u := used, i := user_id)) AS best, max(user_id) FILTER (WHERE user_id = active) AS still FROM k)
    SELECT user_id, row_number() OVER (ORDER BY used DESC, user_id DESC) AS place, user_id = coalesce(still, best) AS active FROM k, m""",
)
def removal_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When a seventh of the users goes, the active one with them, the last to be seen is active."""
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("used"))
    most = users.agg(F.max("user_id").alias("most"))  # one row
    marked = users.join(F.broadcast(most)).select("user_id", "used", (F.col("user_id") == F.col("most")).alias("active"), (F.col("user_id") % 7 == F.col("most") % 7).alias("goes"))
    return joins.next_active(marked.drop("goes"), marked.where("goes"), "user_id", "used", "active")


@query(
    "invalidation_closure",
    """WITH d AS (SELECT lang, source, substr(sha1(text), 1, 16) AS hash FROM documents), c AS (SELECT DISTINCT hash AS key, 'bare' AS kind FROM d UNION SELECT DISTINCT lang || ':' || hash, 'context' FROM d),
    g AS (SELECT DISTINCT hash FROM d WHERE source = 'src3'), k AS (SELECT hash AS key FROM g UNION SELECT l.lang || ':' || g.hash FROM g, (SELECT DISTINCT lang FROM d) l)
    SELECT kind, count(*) AS kept FROM c WHERE key NOT IN (SELECT key FROM k) GROUP BY kind""",
)
def invalidation_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cache keeps when a source goes: its contents go alone and under every language."""
    docs = table(spark, sf_dir, "documents").select("lang", "source", F.substring(F.sha1("text"), 1, 16).alias("hash"))
    cache = docs.select(F.col("hash").alias("key"), F.lit("bare").alias("kind")).unionByName(docs.select(F.concat_ws(":", "lang", "hash").alias("key"), F.lit("context").alias("kind"))).distinct()
    keys = joins.invalidation_keys(docs.select(F.col("lang").alias("namespace")), docs.where("source = 'src3'"))
    return joins.invalidate(cache, keys).groupBy("kind").agg(F.count("*").alias("kept"))


_FACET = "SELECT doc_id, lang, source, list_distinct([CASE WHEN n_chars < 1500 THEN 'short' ELSE 'long' END, 'n' || CAST(doc_id % 3 AS VARCHAR)]) AS entities, [CASE WHEN contains(text, chr(10)) THEN 'lines' ELSE 'line' END] AS containers FROM documents"


@query(
    "facet_patterns",
    f"""WITH f AS ({_FACET}), e AS (SELECT lang, doc_id, 'operation↔entity' AS kind, source AS "left", unnest(entities) AS "right" FROM f UNION ALL SELECT lang, doc_id, 'operation↔container', source, unnest(containers) FROM f
    UNION ALL SELECT lang, doc_id, 'entity↔container', x, unnest(containers) FROM (SELECT *, unnest(entities) AS x FROM f))
    SELECT lang, kind, "left", "right", count(DISTINCT doc_id) AS support, min(doc_id) AS first FROM e GROUP BY ALL""",
)
def facet_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of facets of documents, of all three kinds, by language."""
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", F.array("source").alias("ops"), F.array(F.when(F.col("n_chars") < 1500, "short").otherwise("long"), F.concat(F.lit("n"), (F.col("doc_id") % 3).cast("string"))).alias("ents"),
        F.array(F.when(F.contains("text", F.lit("\n")), "lines").otherwise("line")).alias("cons"),
    )
    return joins.relation_patterns(rows, "lang", "doc_id", {"operation": "ops", "entity": "ents", "container": "cons"})


sql_query(
    "exploded_roles",
    """SELECT lang, role, count(*) AS n, count(DISTINCT doc_id) AS documents FROM (SELECT d.doc_id, d.lang, explode(array(d.source, CASE WHEN l.toxic = 1 THEN 'toxic' WHEN l.toxic = 0 THEN 'clean' ELSE 'unlabelled' END, CASE WHEN l.quality = 1 THEN 'good' WHEN l.quality = 0 THEN 'bad' ELSE 'unlabelled' END)) AS role
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) t GROUP BY lang, role""",
    """SELECT lang, role, count(*) AS n, count(DISTINCT doc_id) AS documents FROM (SELECT d.doc_id, d.lang, unnest([d.source, CASE WHEN l.toxic = 1 THEN 'toxic' WHEN l.toxic = 0 THEN 'clean' ELSE 'unlabelled' END, CASE WHEN l.quality = 1 THEN 'good' WHEN l.quality = 0 THEN 'bad' ELSE 'unlabelled' END]) AS role
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) t GROUP BY lang, role""",
)


@query(
    "provenance_summary",
    _COMPONENTS.replace("SELECT a AS k, min(b) AS component FROM w GROUP BY a", ", m AS (SELECT a AS k, min(b) AS component FROM w GROUP BY a), s AS (SELECT component, count(*) AS n FROM m GROUP BY component), q AS (SELECT k, count(*) AS names FROM o GROUP BY k)").replace("GROUP BY a)\n,", "GROUP BY a),")
    + " SELECT (SELECT count(DISTINCT name) FROM o) AS names, (SELECT count(*) FROM s) AS components, (SELECT max(n) FROM s) AS largest, (SELECT count(*) FROM s WHERE n = 1) AS singletons, (SELECT max(names) FROM q) AS most_names",
)
def provenance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names, groups that share one, the largest, those of one page, and the most names of a page."""
    host = F.substring_index(F.regexp_replace("url", "^https?://", ""), "/", 1)
    names = F.array_distinct(F.array(host, F.concat(F.lit("n"), F.regexp_extract("url", r"/(\d+)", 1))))
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("k"), names.alias("names"))
    sizes = graphs.share_a_name(rows, "k", "names").groupBy("component").agg(F.count("*").alias("n"))
    told = sizes.agg(F.count("*").alias("components"), F.max("n").alias("largest"), F.count_if(F.col("n") == 1).alias("singletons"))
    distinct = rows.select(F.explode("names").alias("name")).agg(F.count_distinct("name").alias("names"))
    return distinct.join(told).join(rows.agg(F.max(F.size("names")).cast("long").alias("most_names")))  # one row each


@query(
    "cross_anchor_merge",
    """WITH h AS (SELECT p_brand AS structure, l_partkey AS base, list_sort(list(DISTINCT l_suppkey)) AS hosts FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)
    SELECT structure, sha256(structure || ':' || array_to_string(hosts, ',')) AS key, CAST(max(len(hosts)) AS BIGINT) AS support, min(base) AS representative, count(*) AS merged, count(*) > 1 AS cross_anchor FROM h GROUP BY structure, hosts""",
)
def cross_anchor_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one brand with the same suppliers, merged, and whether that joins several."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("structure"), F.col("l_partkey").alias("base"), F.col("l_suppkey").alias("host"))
    return sets.merge_equal_hosts(rows, "structure")


@query("approximate_distinct", "SELECT event_type, TRUE AS close, TRUE AS merged_close FROM events GROUP BY event_type")
def approximate_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users by sketch, in one go and as a union of each day's sketch, against the exact
    number: both within a twentieth of it."""
    events = table(spark, sf_dir, "events")
    # Apart: in one aggregation each pair of type and user would hold a sketch of its own.
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("n"))
    sketched = events.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.01).alias("a"))
    daily = events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.hll_sketch_agg("user_id", 14).alias("s"))
    merged = daily.groupBy("event_type").agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("m"))
    near = lambda c: F.abs(F.col(c) - F.col("n")) <= F.col("n") / 20
    return exact.join(sketched, "event_type").join(merged, "event_type").select("event_type", near("a").alias("close"), near("m").alias("merged_close"))


@query(
    "set_closure",
    """WITH m AS (SELECT DISTINCT l_returnflag || l_linestatus || '/' || CAST(l_linenumber AS VARCHAR) AS id, l_suppkey AS member FROM lineitem), s AS (SELECT id, count(*) AS n FROM m GROUP BY id),
    p AS (SELECT x.id AS a, y.id AS b, x.n AS na, y.n AS nb FROM s x JOIN s y ON x.id < y.id), o AS (SELECT u.id AS a, v.id AS b, count(*) AS shared FROM m u JOIN m v ON u.member = v.member AND u.id < v.id GROUP BY 1, 2)
    SELECT p.a, p.b, coalesce(o.shared, 0) AS shared, CASE WHEN coalesce(o.shared, 0) = 0 THEN 'disjoint' WHEN shared = na AND shared = nb THEN 'equal' WHEN shared = na THEN 'subset' WHEN shared = nb THEN 'superset' ELSE 'partial' END AS relation,
    CASE WHEN coalesce(o.shared, 0) = 0 THEN 'no_overlap' WHEN EXISTS (SELECT 1 FROM s z WHERE z.id NOT IN (p.a, p.b) AND z.n = o.shared AND (SELECT count(*) FROM m u JOIN m v ON v.member = u.member AND v.id = p.b JOIN m w ON w.member = u.member AND w.id = z.id WHERE u.id = p.a) = o.shared) OR o.shared IN (na, nb) THEN 'closed' ELSE 'open' END AS closure
    FROM p LEFT JOIN o ON o.a = p.a AND o.b = p.b""",
)
def set_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a few sets of suppliers: how they relate, disjoint ones too, and whether what two
    share is a set of its own."""
    name = F.concat("l_returnflag", "l_linestatus", F.lit("/"), F.col("l_linenumber").cast("string"))
    return sets.closure(table(spark, sf_dir, "lineitem").select(name.alias("id"), F.col("l_suppkey").alias("member")).distinct())

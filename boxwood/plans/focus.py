"""What a question about a place in a source needs: references, selections, outlines, folders; and
summaries folded up and across."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import focus, meaning, trees
from ..registry import query, table
from ..storage import materialise
from .changes import _each, sources
from .trees import _LINE_TREE, line_tree


@query("syntactic_references")
def syntactic_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the sources use a name: the argument ``x``'s longer companion, called or passed."""
    return focus.references(sources(spark, sf_dir).select("doc_id", F.col("new").alias("text")), "doc_id", "text", "added").unionByName(
        focus.references(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", "the")
    )


@query("reference_files")
def reference_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources by their uses of a name, the one that the question came from first."""
    hits = focus.references(sources(spark, sf_dir).select("doc_id", F.col("old").alias("text")), "doc_id", "text", "w_the")
    return focus.by_file(hits, "doc_id", 7)


@query("selection_context")
def selection_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would show the fourth line of each source; what is wrong where that can't be."""

    def one(doc, old, new):
        try:
            row = old.split("\n")[3]
            found = focus.selection_context(old, trees.parse(old, "python"), (4, 1), (4, len(row) + 1), selected=row, budget=2_000)
        except (ValueError, IndexError) as e:
            return [(doc, str(e), None, None, None, None, None)]
        return [(doc, None, len(found["highlight"]["source"]), len(found["focus"]), len(found["ancestors"]), len(found["peers"]), found["used"])]

    return _each(sources(spark, sf_dir), one, "doc_id long, error string, highlight long, focus long, ancestors long, peers long, used long", [pa.int64(), pa.string(), *[pa.int64()] * 5])


@query("unit_overview")
def unit_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first top-level units of each source, with an even allowance."""

    def one(doc, old, new):
        found = focus.overview([(str(doc), old, trees.parse(old, "python"))], 600)
        return [(doc, u["label"], u["first_line"], u["source"], u["truncated"]) for f in found["files"] for u in f["units"]]

    return _each(sources(spark, sf_dir), one, "doc_id long, label string, first_line long, source string, truncated boolean", [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_()])


@query("drill_levels", _LINE_TREE + """, k AS (SELECT doc_id, parent, id, row_number() OVER (PARTITION BY doc_id, parent ORDER BY start, id) AS r FROM nodes WHERE parent IS NOT NULL), one AS (SELECT doc_id, id FROM k WHERE parent = 'r' AND r <= 24)
    SELECT doc_id, 0 AS level, count(*) AS n FROM nodes WHERE parent IS NULL GROUP BY doc_id UNION ALL SELECT doc_id, 1, count(*) FROM one GROUP BY doc_id
    UNION ALL SELECT k.doc_id, 2, count(*) FROM k JOIN one ON one.doc_id = k.doc_id AND one.id = k.parent WHERE k.r <= 24 GROUP BY k.doc_id""")
def drill_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes two levels of drilling into each text show."""
    nodes = materialise(line_tree(spark, sf_dir))
    return focus.drill(nodes, nodes.where("parent IS NULL").select("doc_id", "id"), "doc_id", 2).groupBy("doc_id", "level").agg(F.count("*").alias("n"))


@query("frontier_view")
def frontier_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frontier that marks on every fifth line give, with the marks; stale ones are left out."""
    nodes = materialise(line_tree(spark, sf_dir))
    marks = nodes.where((F.col("depth") == 2) & (F.expr("try_cast(substr(id, 2) AS BIGINT)") % 5 == 2)).select("doc_id", "id")
    return focus.frontier_view(nodes, marks.unionByName(marks.select("doc_id", F.concat(F.lit("gone"), "id").alias("id"))), "doc_id")


_PATHS = r"regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')"
_TREE = f"""WITH p AS (SELECT DISTINCT {_PATHS} AS path FROM pages), s AS (SELECT path, string_split(path, '/') AS parts FROM p),
    f AS (SELECT DISTINCT array_to_string(parts[1:n], '/') AS node FROM (SELECT parts, unnest(generate_series(1, len(parts) - 1)) AS n FROM s WHERE len(parts) > 1)),
    e AS (SELECT node, 'folder' AS kind, string_split(node, '/') AS parts FROM f UNION ALL SELECT path, 'file', parts FROM s)"""


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"), F.substring(F.sha1("html"), 1, 8).alias("bare"))


@query(
    "directory_render",
    _TREE
    + """, o AS (SELECT node, kind, CAST(len(parts) AS BIGINT) AS depth, array_to_string(parts[1:len(parts) - 1], '/') AS up, array_to_string(list_transform(parts, lambda x, i: CASE WHEN i = len(parts) AND kind = 'file' THEN '1' ELSE '0' END || x), chr(1)) AS key FROM e)
    SELECT node, kind, depth, row_number() OVER (ORDER BY key) AS place, key = max(key) OVER (PARTITION BY up) AS last FROM o""",
)
def directory_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' folder tree as it is drawn."""
    return focus.directory(_paths(spark, sf_dir).select("path").distinct(), "path")


@query("folder_summaries")
def folder_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each folder's summary: how many children it sums up, and a digest of what they say."""
    files = _paths(spark, sf_dir).groupBy("path").agg(F.min("bare").alias("bare"))
    combine = lambda s: F.concat(F.size(s).cast("string"), F.lit(":"), F.substring(F.sha1(F.array_join(s, "|")), 1, 8))
    return meaning.folder_summaries(files, "path", "bare", combine)


@query(
    "peers_fold",
    """WITH d AS (SELECT conv_id, turn, substr(sha1(coalesce(text, '')), 1, 8) AS bare FROM conversations), w AS (SELECT *, list(struct_pack(k := turn, s := bare) ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS peers FROM d)
    SELECT conv_id, turn, substr(sha1(array_to_string(list_transform(peers, lambda p: CAST(p.k AS VARCHAR)), '|')), 1, 16) AS signature,
    substr(sha1(bare || '>' || array_to_string(list_transform(list_filter(peers, lambda p: p.k <> turn), lambda p: p.s), '|')), 1, 16) AS summary FROM w""",
)
def peers_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's digest folded with those of its conversation's other turns."""
    units = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.substring(F.sha1(F.coalesce("text", F.lit(""))), 1, 8).alias("bare"))
    fold = lambda own, others: F.substring(F.sha1(F.concat(own, F.lit(">"), F.array_join(others, "|"))), 1, 16)
    return meaning.peers_fold(units, "conv_id", "turn", "bare", fold)


@query(
    "window_digests",
    """WITH w AS (SELECT doc_id, i, substr(sha1(substr(text, CAST(i * 1200 + 1 AS BIGINT), 1200)), 1, 8) AS s FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(CAST(ceil(length(text) / 1200.0) AS BIGINT) - 1, 0))) AS i FROM documents))
    SELECT doc_id, count(*) AS windows, substr(sha1(string_agg(s, '|' ORDER BY i)), 1, 16) AS summary FROM w GROUP BY doc_id""",
)
def window_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in windows, each summed up by its digest, combined in order."""
    return meaning.windowed(table(spark, sf_dir, "documents"), "doc_id", "text", 1_200, lambda t: F.substring(F.sha1(t), 1, 8), lambda s: F.substring(F.sha1(F.array_join(s, "|")), 1, 16))


@query(
    "live_marks",
    """WITH n AS (SELECT max(ts) AS now FROM events), l AS (SELECT user_id, floor(value) AS mark, arg_max(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END, struct_pack(t := ts, o := CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END)) AS on_, max(ts) AS last FROM events GROUP BY 1, 2),
    u AS (SELECT user_id FROM events, n GROUP BY user_id, now HAVING max(ts) >= now - INTERVAL 5 DAY)
    SELECT user_id, CAST(mark AS BIGINT) AS mark, last FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last DESC, mark) AS r FROM l WHERE on_ = 1 AND user_id IN (SELECT user_id FROM u)) t WHERE r <= 8""",
)
def live_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest eight marks of users seen in the last five days, unless an error unset them."""
    events = table(spark, sf_dir, "events").withColumn("mark", F.floor("value").cast("long"))
    return meaning.live_marks(events, "user_id", "mark", "ts", "5 DAY", 8, F.col("event_type") != "error")

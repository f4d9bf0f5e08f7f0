"""Text functions one by one over all documents, each with the SQL that gives the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..registry import query, table
from .texts import _COMMON, _WORDS


@query(
    "concept_facets",
    f"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS labels, source || '/my' || upper(lang) || 'Docs/readme' || CAST(doc_id AS VARCHAR) || '.file.txt' AS path, substr(text, 1, 60) AS subject FROM documents)
    SELECT doc_id, list_sort(list_distinct(list_filter({_WORDS.format("array_to_string(labels, chr(10))")}, lambda w: w NOT IN {_COMMON}))) AS changed_code,
    list_sort(list_distinct(list_filter(list_concat({_WORDS.format("replace(path, '/', ' ')")}, {_WORDS.format("regexp_replace(string_split(path, '/')[-1], '[.][^.]+$', '')")}), lambda w: w NOT IN {_COMMON}))) AS file_path,
    list_sort(list_distinct(list_filter({_WORDS.format("subject")}, lambda w: w NOT IN {_COMMON}))) AS commit_subject FROM d""",
)
def concept_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Useful tokens of each document's lines, of a path and of a subject."""
    path = F.concat("source", F.lit("/my"), F.upper("lang"), F.lit("Docs/readme"), F.col("doc_id").cast("string"), F.lit(".file.txt"))
    rows = table(spark, sf_dir, "documents").select("doc_id", text.concept_tokens(F.split("text", "\n", -1), path, F.substring("text", 1, 60)).alias("t"))
    return rows.select("doc_id", "t.changed_code", "t.file_path", "t.commit_subject")


@query(
    "code_excerpts",
    """WITH d AS (SELECT doc_id, text, length(text) // 3 AS a, length(text) // 3 + 40 + doc_id % 7 AS b FROM documents), c AS (SELECT doc_id, substr(text, greatest(a - 100, 0) + 1, b + 100 - greatest(a - 100, 0)) AS cut FROM d)
    SELECT doc_id, CASE WHEN length(cut) > 220 THEN substr(cut, 1, 220) || '…' ELSE cut END AS excerpt FROM c""",
)
def code_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A span of each text with its surroundings, cut where that is long."""
    at = F.floor(F.length("text") / 3)
    return table(spark, sf_dir, "documents").select("doc_id", text.excerpt(F.col("text"), at, at + 40 + F.col("doc_id") % 7, 100, 220).alias("excerpt"))


@query(
    "compact_excerpts",
    r"""WITH d AS (SELECT doc_id, string_split(replace(text, chr(10), chr(10) || '---' || chr(10)), chr(10) || '---' || chr(10)) AS p FROM documents),
    t AS (SELECT doc_id, list_filter(list_transform(p, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS p FROM d)
    SELECT doc_id, substr(coalesce(array_to_string(list_filter(p, lambda x, i: list_position(p, x) = i), chr(10) || '---' || chr(10)), ''), 1, 1800) AS excerpt FROM t""",
)
def compact_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's lines as parts: white space made even, repeats left out."""
    parts = F.replace(F.col("text"), F.lit("\n"), F.lit("\n---\n"))
    return table(spark, sf_dir, "documents").select("doc_id", text.compact_excerpt(parts).alias("excerpt"))


@query(
    "text_templates",
    "SELECT doc_id, concat_ws(chr(10), 'language: ' || lang, 'from source: ' || source, 'quality: ' || CAST(l.quality AS VARCHAR), 'size: ' || CAST(n_chars AS VARCHAR)) AS filled FROM documents LEFT JOIN labels l USING (doc_id)",
)
def text_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.select("doc_id", text.template(language=F.col("lang"), from_source=F.col("source"), quality=F.col("quality").cast("string"), size=F.col("n_chars").cast("string")).alias("filled"))


@query(
    "line_shapes",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), w AS (SELECT *, repeat(' ', CAST(doc_id % 5 AS INTEGER)) || CASE WHEN doc_id % 3 = 0 THEN chr(9) ELSE '' END || line AS own FROM l)
    SELECT doc_id, CAST(sum(length(regexp_extract(own, '^[ \t]*', 0))) AS BIGINT) AS indent FROM w GROUP BY doc_id""",
)
def line_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The indentation of all lines of each text, set in by its id."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    own = F.concat(F.repeat(F.lit(" "), (F.col("doc_id") % 5).cast("int")), F.when(F.col("doc_id") % 3 == 0, "\t").otherwise(""), F.col("line"))
    return lines.groupBy("doc_id").agg(F.sum(text.indent_width(own)).cast("long").alias("indent"))


@query(
    "name_shapes",
    r"""WITH w AS (SELECT DISTINCT unnest(string_split_regex(text, '\s+')) AS w FROM documents), t AS (SELECT w, regexp_replace(trim(w, ' '), '\s+', '_', 'g') AS kind, lower(regexp_replace(trim('"' || w || '''', ' '), '^[`''"]+|[`''"]+$', '', 'g')) AS a FROM w)
    SELECT w AS word, CASE WHEN regexp_matches(kind, '[A-Za-z_]') THEN kind END AS clean, CASE WHEN regexp_matches(a, '^[a-z_$][\w$.-]*$') AND a NOT IN ('true', 'false', 'null', 'none', 'self', 'this') THEN a END AS anchor,
    CASE WHEN regexp_matches(w, '(?:identifier|name)$') THEN '$ID' WHEN regexp_matches(w, '^(?:string|string_fragment|integer|float|number)$') THEN '$LIT' ELSE w END AS normalised FROM t""",
)
def name_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct word as a node type, as a quoted anchor and as a label."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"\s+", -1)).alias("word")).distinct()
    w = F.col("word")
    return words.select("word", text.clean_type(w).alias("clean"), text.anchor(F.concat(F.lit('"'), w, F.lit("'"))).alias("anchor"), text.normalised_label(w, w).alias("normalised"))


@query(
    "fenced_texts",
    r"""SELECT doc_id, trim(regexp_replace(regexp_replace(CASE WHEN doc_id % 2 = 0 THEN '```text' || chr(10) || text || chr(10) || '```' ELSE text END, '^\s*```[\w-]*\n', ''), '\n```\s*$', ''), ' ') AS bare,
    array_to_string(string_split(source, 'r')[1:3], ' · ') AS noun FROM documents""",
)
def fenced_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts out of their code fences, and a label of the first terms."""
    t = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("```text\n"), F.col("text"), F.lit("\n```"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", text.strip_fences(t).alias("bare"), text.noun_label(F.split("source", "r", -1)).alias("noun"))


@query(
    "mentioned_sources",
    """WITH m AS (SELECT doc_id, list_transform(regexp_extract_all(' ' || replace(source || ' the ' || lang || ' SRC1, x.src2', ' ', '  ') || ' ', '(?i)[^A-Za-z0-9_$](src12|src1|src2|the)[^A-Za-z0-9_$]', 1), lambda x: lower(x)) AS n FROM documents)
    SELECT doc_id, list_filter(n, lambda x, i: list_position(n, x) = i) AS names FROM m""",
)
def mentioned_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat("source", F.lit(" the "), "lang", F.lit(" SRC1, x.src2"))
    return table(spark, sf_dir, "documents").select("doc_id", text.mentions(said, ["the", "src1", "src2", "src12"]).alias("names"))

"""Identity, tokens, labels, lines and chunks over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import identity, text
from ..operators import lines
from ..partitions import spread
from ..registry import query, table

_WORDS = r"list_filter(string_split_regex(lower(regexp_replace({0}, '([a-z\d])([A-Z])', '\1 \2', 'g')), '[^a-z\d]+'), lambda w: length(w) >= 2 AND NOT regexp_matches(w, '^\d+$'))"
_COMMON = "(" + ", ".join(f"'{w}'" for w in text.COMMON) + ")"


@query(
    "identity_keys",
    """SELECT doc_id, substr(sha1(':0:' || CAST(length(text) AS VARCHAR)), 1, 12) AS box_id, substr(sha1(text), 1, 16) AS content_hash, sha1(lang || chr(0) || text) AS parse_key,
    sha256(text || chr(0) || replace(text, ' ', '_')) AS patch, sha256('7:' || lang || ':' || source || ':' || sha256(text)) AS sample_key, lower(regexp_replace(source || '/Doc ' || CAST(doc_id AS VARCHAR) || '.txt', '[^a-zA-Z0-9]+', '-', 'g')) AS file_id,
    'STATIC_' || upper(lang) || '_' || upper(substr(sha256(lang || chr(0) || source || chr(0) || CAST(doc_id AS VARCHAR) || chr(0) || 'f'), 1, 12)) AS holdout_id FROM documents""",
)
def identity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, lang, source, name = F.col("text"), F.col("lang"), F.col("source"), F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        identity.box_id(F.lit(""), F.lit(0), F.length(t)).alias("box_id"),
        identity.content_hash(t).alias("content_hash"),
        identity.parse_key(lang, t).alias("parse_key"),
        identity.patch_hash(t, F.replace(t, F.lit(" "), F.lit("_"))).alias("patch"),
        identity.sample_key(lang, source, F.sha2(t, 256), "7").alias("sample_key"),
        identity.file_id(F.concat(source, F.lit("/Doc "), name, F.lit(".txt"))).alias("file_id"),
        identity.holdout_id(lang, source, name, F.lit("f")).alias("holdout_id"),
    )


@query("concept_tokens", f"SELECT doc_id, list_sort(list_distinct(list_filter({_WORDS.format('text')}, lambda w: w NOT IN {_COMMON}))) AS tokens FROM documents")
def concept_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.useful_tokens(text.split_words(F.col("text"))).alias("tokens"))


@query(
    "weighted_terms",
    f"""WITH w AS (SELECT source, unnest({_WORDS.format('text')}) AS term, 3 AS weight FROM documents UNION ALL SELECT source, unnest({_WORDS.format("source || '/' || lang")}), 2 FROM documents),
    s AS (SELECT source, term, CAST(sum(weight) AS BIGINT) AS weight FROM w WHERE term NOT IN {_COMMON} GROUP BY source, term)
    SELECT source, term, weight, CAST(r AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY weight DESC, term) AS r FROM s) t WHERE r <= 10""",
)
def weighted_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    words = docs.select("source", text.exploded_words(F.col("text")).alias("term"), F.lit(3).alias("weight")).unionByName(
        docs.select("source", F.explode(text.split_words(F.concat("source", F.lit("/"), "lang"))).alias("term"), F.lit(2).alias("weight"))
    )
    return lines.top_terms(words.where(F.col("term").isNotNull() & ~F.col("term").isin(*text.COMMON)), "source", 10)


@query(
    "text_labels",
    r"""SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS lines, substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 60) AS label,
    CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || chr(10) || '... first 200 of ' || CAST(length(text) AS VARCHAR) || ' characters' ELSE text END AS clipped,
    CASE WHEN length(text) > 100 THEN substr(text, 1, 72) || chr(10) || '[...]' || chr(10) || right(text, 28) ELSE text END AS excerpt FROM documents""",
)
def text_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.count_lines(t).cast("long").alias("lines"), text.label(t).alias("label"), text.clip(t, 200).alias("clipped"), text.head_tail(t, 100).alias("excerpt"))


@query(
    "content_dedup",
    """WITH h AS (SELECT doc_id, lang, sha256(text) AS h, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS r FROM documents)
    SELECT h AS patch, count(*) AS support, list_sort(list(DISTINCT lang)) AS langs, list_sort(list(doc_id))[1:5] AS examples, CAST(count(*) FILTER (WHERE r > 1) AS BIGINT) AS duplicates FROM h GROUP BY h""",
)
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("patch"))
    ranked = docs.withColumn("place", F.row_number().over(Window.partitionBy("patch").orderBy("doc_id")))
    first = F.array_sort(F.collect_list(F.when(F.col("place") <= 5, F.col("doc_id"))))
    return ranked.groupBy("patch").agg(F.count("*").alias("support"), F.array_sort(F.collect_set("lang")).alias("langs"), first.alias("examples"), (F.count("*") - 1).alias("duplicates"))


_LINES = "SELECT doc_id, unnest(generate_series(1, len(string_split(text, chr(10))))) AS n, unnest(string_split(text, chr(10))) AS line FROM documents"


@query(
    "line_offsets",
    f"WITH l AS ({_LINES}) SELECT doc_id, CAST(n AS BIGINT) AS line, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(length(line) AS BIGINT) AS size FROM l",
)
def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_table(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "line", "start", F.length("content").cast("long").alias("size"))


@query(
    "offset_to_line",
    f"""WITH l AS ({_LINES}), s AS (SELECT doc_id, n, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l),
    d AS (SELECT doc_id, length(text) // 2 AS a, length(text) * 3 // 4 + 1 AS b FROM documents)
    SELECT d.doc_id, CASE WHEN max(s.n) FILTER (WHERE s.start <= d.a) = max(s.n) FILTER (WHERE s.start <= d.b - 1) THEN 'Line ' || CAST(max(s.n) FILTER (WHERE s.start <= d.a) AS VARCHAR)
    ELSE 'Lines ' || CAST(max(s.n) FILTER (WHERE s.start <= d.a) AS VARCHAR) || '–' || CAST(max(s.n) FILTER (WHERE s.start <= d.b - 1) AS VARCHAR) END AS label FROM d JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id""",
)
def offset_to_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    first, last = lines.line_at(t, F.floor(F.length(t) / 2)), lines.line_at(t, F.floor(F.length(t) * 3 / 4))
    return table(spark, sf_dir, "documents").select("doc_id", text.line_range(first, last).alias("label"))


@query(
    "line_chunks",
    f"""WITH l AS ({_LINES}), s AS (SELECT doc_id, n, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l),
    b AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1) // 5 AS idx FROM s WHERE trim(line, ' ' || chr(9) || chr(13)) <> '')
    SELECT doc_id, CAST(idx AS BIGINT) AS idx, CAST(min(start) AS BIGINT) AS start, CAST(max(start + length(line)) AS BIGINT) AS "end", CAST(min(n) AS BIGINT) AS first_line, CAST(max(n) AS BIGINT) AS last_line FROM b GROUP BY doc_id, idx""",
)
def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.chunk_by_lines(table(spark, sf_dir, "documents"), "doc_id", "text", 5)


@query(
    "reference_hits",
    r"""WITH l AS (SELECT doc_id, unnest(generate_series(1, len(string_split(text, chr(10))))) AS n, unnest(string_split(text, chr(10))) AS line FROM documents),
    h AS (SELECT doc_id, n, len(regexp_extract_all(' ' || replace(line, ' ', '  ') || ' ', '[^A-Za-z0-9_$]the[^A-Za-z0-9_$]')) AS hits FROM l)
    SELECT doc_id, CAST(sum(hits) AS BIGINT) AS hits, CAST(count(*) AS BIGINT) AS lines, CAST(min(n) AS BIGINT) AS first_line FROM h WHERE hits > 0 GROUP BY doc_id""",
)
def reference_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.references(table(spark, sf_dir, "documents"), "doc_id", "text", "the")
    return found.groupBy("doc_id").agg(F.sum("hits").cast("long").alias("hits"), F.count("*").alias("lines"), F.min("line").cast("long").alias("first_line"))


@query(
    "reference_kinds",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT CASE WHEN regexp_matches(line, '^\s*(?:import|from|use|require|include)\b|\brequire\(') THEN 'import' WHEN regexp_matches(line, '\b(?:def|class|function|func|fn|const|let|var|type|interface)\s+en\b') THEN 'definition'
    WHEN regexp_matches(line, '(^|[^\w$])en\s*\(') THEN 'call' ELSE 'reference' END AS kind, count(*) AS n FROM l WHERE regexp_matches(line, '(^|[^\w$])en($|[^\w$])') GROUP BY 1""",
)
def reference_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.references(table(spark, sf_dir, "documents"), "doc_id", "text", "en")
    return found.groupBy("kind").agg(F.count("*").alias("n"))


@query(
    "tfidf_top_terms",
    f"""WITH w AS (SELECT doc_id, unnest({_WORDS.format('text')}) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS c FROM w GROUP BY doc_id, term), d AS (SELECT term, count(*) AS df FROM c GROUP BY term HAVING count(*) >= 2),
    n AS (SELECT count(*) AS n FROM documents), t AS (SELECT c.doc_id, c.term, (1 + ln(c.c)) * (ln((1.0 + n.n) / (1 + d.df)) + 1) AS x FROM c JOIN d ON d.term = c.term, n), z AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM t GROUP BY doc_id)
    SELECT doc_id, term, round(weight, 6) AS weight FROM (SELECT t.doc_id, t.term, t.x / z.norm AS weight, row_number() OVER (PARTITION BY t.doc_id ORDER BY round(t.x / z.norm, 9) DESC, t.term) AS r FROM t JOIN z ON z.doc_id = t.doc_id) q WHERE r <= 5""",
)
def tfidf_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", text.exploded_words(F.col("text")).alias("term")).where("term IS NOT NULL")
    weights = lines.tf_idf(docs, "doc_id", "term", table(spark, sf_dir, "documents"), min_df=2)
    return lines.top_weights(weights, "doc_id", 5)


_PATHS = "SELECT p_brand, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN '_' || p_name ELSE replace(p_name, 'e', 'é') END || '/' || CAST(p_partkey AS VARCHAR) AS path FROM part"


@query("locale_order", f"SELECT p_brand, path, row_number() OVER (PARTITION BY p_brand ORDER BY path COLLATE en_us, path) AS place FROM ({_PATHS}) p")
def locale_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up paths of parts, in the order of people's languages, by brand."""
    n, name = F.col("p_partkey") % 4, F.col("p_name")
    told = F.when(n == 0, name).when(n == 1, F.upper(name)).when(n == 2, F.concat(F.lit("_"), name)).otherwise(F.replace(name, F.lit("e"), F.lit("é")))
    paths = table(spark, sf_dir, "part").select("p_brand", F.concat(told, F.lit("/"), F.col("p_partkey").cast("string")).alias("path"))
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy(text.by_locale(F.col("path")), "path"))
    return paths.select("p_brand", "path", place.cast("long").alias("place"))


@query(
    "markdown_kinds",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT CASE WHEN starts_with(line, '```') THEN 'fence' WHEN regexp_matches(line, '^#{1,6} ') THEN 'heading' WHEN regexp_matches(line, '^\s*[-*] ') THEN 'bullet' WHEN trim(line) = '' THEN 'blank' ELSE 'text' END AS kind, count(*) AS n FROM l GROUP BY 1""",
)
def markdown_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.explode(text.fenced_blocks(F.col("text"))).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))

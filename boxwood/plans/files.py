"""Readers and writers over the tables: JSON lines with bad rows, graph text, caches by content."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import language_of
from ..operators import meaning
from ..operators.annotate import annotate
from ..registry import query, table


@query("language_routing", r"SELECT regexp_extract(lower(url), '\.([a-z0-9]+)$', 1) AS ext, count(*) AS n FROM pages GROUP BY 1")
def language_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(F.regexp_extract(F.lower("url"), r"\.([a-z0-9]+)$", 1).alias("ext")).agg(F.count("*").alias("n"))


@query("known_languages", "SELECT 'json' AS language, count(*) AS n FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 'python', count(*) FROM events WHERE event_id % 2 = 1")
def known_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("a/b"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 2 == 0, ".json").otherwise(".py"))
    return table(spark, sf_dir, "events").groupBy(language_of(path).alias("language")).agg(F.count("*").alias("n"))


@query("json_accounting", "SELECT CASE WHEN event_id % 7 = 0 THEN 'invalid_json' ELSE 'ok' END AS status, count(*) AS n FROM events GROUP BY 1")
def json_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props")).alias("value"))
    bad = F.from_json("value", "_bad string, page string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})["_bad"].isNotNull()
    return raw.groupBy(F.when(bad, "invalid_json").otherwise("ok").alias("status")).agg(F.count("*").alias("n"))


def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for i in range(b.num_rows):  # the words of one text at a time
            w = b.column(1)[i].as_py().split()
            out.append(f"{len(w)} words, {len(set(w))} distinct, from {w[0] if w else ''} to {w[-1] if w else ''}")
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["hash", "out"])


@query("summary_by_content", """WITH w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents)
    SELECT doc_id, substr(sha1(text), 1, 16) AS hash, CAST(len(w) AS VARCHAR) || ' words, ' || CAST(len(list_distinct(w)) AS VARCHAR) || ' distinct, from ' || coalesce(w[1], '') || ' to ' || coalesce(w[-1], '') AS summary FROM w""")
def summary_by_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An expensive function run once for each distinct content, then joined back."""
    return annotate(table(spark, sf_dir, "documents"), "doc_id", "text", summarise).select("doc_id", "hash", F.col("out").alias("summary"))


@query(
    "windowed_summary",
    """WITH w AS (SELECT doc_id, i, substr(text, CAST(i * 1200 + 1 AS BIGINT), 1200) AS part FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(CAST(ceil(length(text) / 1200.0) AS BIGINT) - 1, 0))) AS i FROM documents))
    SELECT doc_id, count(*) AS windows, string_agg(CAST(length(part) AS VARCHAR) || '/' || CAST(length(part) - length(replace(part, ' ', '')) AS VARCHAR), ' ' ORDER BY i) AS summary FROM w GROUP BY doc_id""",
)
def windowed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in windows, each summed up by its characters and spaces, put together in order."""
    told = lambda t: F.concat_ws("/", F.length(t).cast("string"), (F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))).cast("string"))
    return meaning.windowed(table(spark, sf_dir, "documents"), "doc_id", "text", 1_200, told, lambda s: F.array_join(s, " "))

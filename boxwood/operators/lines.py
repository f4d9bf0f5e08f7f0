"""Lines, chunks of lines, references and terms of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def _line_structs(text: Column) -> Column:
    """Lines of a text with numbers (from 1) and start offsets, within the row: no shuffle."""
    parts = F.split(text, "\n", -1)
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<line:long,start:long,content:string>>").alias("out"))

    def add(s: Column, line: Column) -> Column:
        own = F.struct((F.size(s["out"]) + 1).cast("long").alias("line"), s["at"].alias("start"), line.alias("content"))
        return F.struct((s["at"] + F.length(line) + 1).cast("long").alias("at"), F.concat(s["out"], F.array(own)).alias("out"))

    return F.aggregate(parts, zero, add, lambda s: s["out"])


def line_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, start, content): one row a line, offsets in characters.

    Lines are exploded with their place and summed per document, which stays linear in the
    length of a document.
    """
    rows = docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("pos", "content"))
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(key, (F.col("pos") + 1).cast("long").alias("line"), F.coalesce(F.sum(F.length("content") + 1).over(before), F.lit(0)).cast("long").alias("start"), "content")


def line_at(text: Column, offset: Column) -> Column:
    """The line that holds an offset: line feeds before it, plus one."""
    head = F.substr(text, F.lit(1), offset.cast("int"))
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def chunk_by_lines(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """Chunks of ``size`` lines that aren't blank, from the first to the last of them."""
    rows = line_table(docs, key, text).where(F.trim(F.translate("content", "\t\r", "")) != "")
    idx = F.floor((F.row_number().over(Window.partitionBy(key).orderBy("line")) - 1) / size)
    return rows.withColumn("idx", idx.cast("long")).groupBy(key, "idx").agg(
        F.min("start").alias("start"), F.max(F.col("start") + F.length("content")).alias("end"), F.min("line").alias("first_line"), F.max("line").alias("last_line")
    )


def references(docs: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """(key, line, content, hits, kind) of lines that use a name as a word; a name of one
    character has none."""
    rows = docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("pos", "content"))
    hits = T.word_hits(F.col("content"), name)
    found = rows.select(key, (F.col("pos") + 1).alias("line"), "content", hits.alias("hits"), T.reference_kind(F.col("content"), name).alias("kind"))
    return found.where((F.col("hits") > 0) & F.lit(len(name) >= 2))


def top_terms(words: DataFrame, key: str, n: int) -> DataFrame:
    """The heaviest terms of each key; ties go to the lesser term."""
    sums = words.groupBy(key, "term").agg(F.sum("weight").alias("weight"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("weight"), "term"))
    return sums.withColumn("place", place.cast("long")).where(F.col("place") <= n)


def tf_idf(terms: DataFrame, key: str, term: str, docs: DataFrame, min_df: int = 1) -> DataFrame:
    """(key, term, weight): sublinear tf, smooth idf, unit length."""
    counts = terms.groupBy(key, term).agg(F.count("*").alias("c"))
    # With the count kept, both uses of the counts have one plan, and the shuffle is made once.
    df = counts.groupBy(term).agg(F.count_if(F.col("c") > 0).alias("df")).where(F.col("df") >= min_df)
    n = docs.agg(F.count("*").alias("n"))  # one row
    raw = counts.join(df, term).join(F.broadcast(n)).select(key, term, ((1 + F.log("c")) * (F.log((1.0 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("x"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(key)))
    return raw.withColumn("weight", F.col("x") / norm).drop("x")


def top_weights(weights: DataFrame, key: str, n: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.round("weight", 9).desc(), "term"))
    return weights.withColumn("_place", place).where(F.col("_place") <= n).select(key, "term", F.round("weight", 6).alias("weight"))

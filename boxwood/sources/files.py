"""Readers and writers: source folders, JSON lines, examples, graph text, sealed runs."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import language_of

# Folders passed over, and the bounds of a scan.
SKIP_DIRS = ("node_modules", ".git", "dist", "build", "coverage", "vendor", "__pycache__", ".venv", "venv", "target", ".next", ".cache")
MOST_FILES, MOST_BYTES, MOST_TOTAL = 4_000, 1_000_000, 150_000_000


def fs_of(spark: SparkSession, path: str):
    """(Hadoop file system, path) of a path, whatever store it is in."""
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    return held.getFileSystem(spark._jsc.hadoopConfiguration()), held


def contained(root: str, path: str) -> bool:
    """Whether a path, its dots and links resolved, lies in a root folder (or is it)."""
    base, own = os.path.realpath(root), os.path.realpath(os.path.join(root, path))
    return own == base or own.startswith(base.rstrip("/") + "/")


def _kept(path: Column, skip: tuple[str, ...], root_dirs: tuple[str, ...], root_files: tuple[str, ...]) -> Column:
    """No folder of a path is passed over, nor its first folder or itself by the root's own lists."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    kept = ~F.exists(folders, lambda s: s.isin(*skip))
    if root_dirs:
        kept &= ~((F.size(parts) > 1) & parts[0].isin(*root_dirs))
    return kept & ~path.isin(*root_files) if root_files else kept


def _sources(rows: DataFrame, most: int, total: int) -> DataFrame:
    """The first ``most`` rows by path, up to the first that would exceed ``total`` bytes, described."""
    from ..operators.windows import running_cap

    first = rows.select("rel_path", "bytes").orderBy("rel_path").limit(most)
    kept = running_cap(first, "rel_path", "bytes", total).select("rel_path")
    text = F.col("content")
    return rows.join(kept, "rel_path").select(
        F.lower(F.regexp_replace("rel_path", "[^a-zA-Z0-9]+", "-")).alias("id"), "rel_path", "language", "content",
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("line_count"), "bytes", F.substring(F.sha1(text), 1, 16).alias("hash"),
    )


def source_files(
    spark: SparkSession, root: str, *, skip: tuple[str, ...] = SKIP_DIRS, root_dirs: tuple[str, ...] = (), root_files: tuple[str, ...] = (), most: int = MOST_FILES, largest: int = MOST_BYTES, total: int = MOST_TOTAL, tracked: bool = False
) -> DataFrame:
    """(id, rel_path, language, content, line_count, bytes, hash) of a folder's source files.

    Paths with a skipped folder, those that the root's own lists name, unknown types and large
    files are left out; then the first ``most`` by path, up to the first that would exceed
    ``total`` bytes. ``tracked``: only files that git tracks there, if it is a work tree.
    """
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*(?=/)", ""), "^" + _literal(base) + "/", "")
    rows = raw.where(F.col("length") <= largest).select(rel.alias("rel_path"), F.col("length").alias("bytes"), F.decode("content", "UTF-8").alias("content"))
    rows = rows.where(_kept(F.col("rel_path"), skip, root_dirs, root_files)).withColumn("language", language_of(F.col("rel_path"))).where("language IS NOT NULL")
    names = git_tracked(base.removeprefix("file://")) if tracked else None
    if names is not None:
        rows = rows.join(spark.createDataFrame([(n,) for n in names], "rel_path string"), "rel_path", "left_semi")
    return _sources(rows, most, total)


def _literal(text: str) -> str:
    import re

    return re.escape(text.removeprefix("file://"))


def git_tracked(root: str) -> list[str] | None:
    """Paths that git tracks below a folder, relative to it; None outside a work tree."""
    try:
        out = subprocess.run(["git", "-C", root, "ls-files", "--cached", "-z"], capture_output=True, timeout=30, check=True).stdout
    except (OSError, subprocess.SubprocessError):
        return None
    return sorted(p for p in out.decode().split("\0") if p)


def upload(spark: SparkSession, files: list[dict], *, skip: tuple[str, ...] = SKIP_DIRS, most: int = MOST_FILES, largest: int = MOST_BYTES, total: int = MOST_TOTAL) -> DataFrame:
    """The same table from files held in memory as {relPath, content}, under the same bounds."""
    rows = [(f["relPath"], f["content"], len(f["content"].encode())) for f in files]
    df = spark.createDataFrame(rows, "rel_path string, content string, bytes long").withColumn("language", language_of(F.col("rel_path")))
    return _sources(df.where(F.col("language").isNotNull() & (F.col("bytes") <= largest)).where(_kept(F.col("rel_path"), skip, (), ())), most, total)


SAMPLE_SOURCE = {"relPath": "sample/basket.py", "content": "def total(basket):\n    \"\"\"The price of everything in a basket.\"\"\"\n    return sum(item.price * item.count for item in basket)\n"}


def sample_source(spark: SparkSession) -> DataFrame:
    """One source that is always there."""
    return upload(spark, [SAMPLE_SOURCE])


def sample_shop(spark: SparkSession) -> dict[str, DataFrame]:
    """A small shop to try statements on: customers and their orders."""
    customers = spark.createDataFrame([(1, "Ada", "startup"), (2, "Brook", "enterprise"), (3, "Cleo", "startup")], "id long, name string, segment string")
    orders = spark.createDataFrame([(1, 1, 120.0, "paid"), (2, 2, 900.0, "paid"), (3, 3, 80.0, "pending"), (4, 1, 200.0, "paid")], "id long, customer_id long, amount_usd double, status string")
    return {"customers": customers, "orders": orders}


def sqlite_table(spark: SparkSession, path: str, name: str, parts: int = 8) -> DataFrame:
    """A table of a SQLite file, opened read-only by every task that reads a range of its rows; the
    file must lie where all executors see it. Columns are those that SQLite declares."""
    import sqlite3

    def connect() -> sqlite3.Connection:
        db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
        db.execute("PRAGMA query_only = ON")
        return db

    quoted = '"' + name.replace('"', '""') + '"'
    db = connect()
    try:
        columns = [(r[1], r[2].upper()) for r in db.execute(f"PRAGMA table_info({quoted})")]
        if not columns:
            raise ValueError(f"no table {name}")
        low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted}").fetchone()
    finally:
        db.close()
    kinds = [T.LongType() if "INT" in t else T.DoubleType() if any(x in t for x in ("REAL", "FLOA", "DOUB", "NUM", "DEC")) else T.BinaryType() if "BLOB" in t else T.StringType() for _, t in columns]
    schema = T.StructType([T.StructField(c, k) for (c, _), k in zip(columns, kinds, strict=True)])
    if low is None:
        return spark.createDataFrame([], schema)
    step = -(-(high - low + 1) // parts)
    ranges = spark.createDataFrame([(low + k * step, low + (k + 1) * step) for k in range(parts)], "lo long, hi long").repartition(parts)

    def read(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            for lo, hi in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                db = connect()
                try:
                    cursor = db.execute(f"SELECT * FROM {quoted} WHERE rowid >= ? AND rowid < ?", (lo, hi))
                    while rows := cursor.fetchmany(8_192):
                        yield pa.RecordBatch.from_arrays([pa.array([_as(v, k) for v in c], to_arrow_type(k)) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)
                finally:
                    db.close()

    return ranges.mapInArrow(read, schema)


def _as(value, kind: T.DataType):
    """SQLite types are of values, not of columns: a value that its column doesn't fit is text or null."""
    if value is None or isinstance(kind, T.BinaryType):
        return value.encode() if isinstance(value, str) else value
    if isinstance(kind, T.StringType):
        return value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)
    try:
        return int(value) if isinstance(kind, T.LongType) else float(value)
    except (TypeError, ValueError):
        return None


def locate(spark: SparkSession, root: str, name: str) -> str | None:
    """The first place that holds a database: a folder of tables by its name, one below that with the
    same name or ``tables``, or a SQLite file in its folder. None for a name that isn't one."""
    from ..operators.gate import DATABASE_ID

    if not DATABASE_ID.fullmatch(name):
        return None
    for place in (f"{root}/{name}/{name}.sqlite", f"{root}/{name}/tables", f"{root}/{name}/{name}", f"{root}/{name}"):
        fs, held = fs_of(spark, place)
        if fs.exists(held):
            return place
    return None


def databases(spark: SparkSession, root: str) -> dict[str, str]:
    """The databases below a root, by name: every folder with a valid name that holds one."""
    from ..operators.gate import DATABASE_ID

    fs, held = fs_of(spark, root)
    if not fs.exists(held):
        return {}
    names = sorted(s.getPath().getName() for s in fs.listStatus(held) if s.isDirectory())
    return {n: place for n in names if DATABASE_ID.fullmatch(n) and (place := locate(spark, root, n))}


def json_lines(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, counts): good rows, and a row count by ``ok`` and ``invalid_json``; strict raises."""
    if strict:
        rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
        return rows, rows.agg(F.count("*").alias("n")).select(F.lit("ok").alias("status"), "n")
    held = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    raw = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", held, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    status = F.when(F.col("r._bad").isNotNull(), "invalid_json").otherwise("ok")
    return raw.where("r._bad IS NULL").select(*(F.col(f"r.{f.name}").alias(f.name) for f in schema.fields)), raw.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def examples(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Text-to-SQL examples of JSON lines, or of one JSON array a file (``multi_line``).

    The query may be called SQL, sql or query; the id question_id or id, else it is the database
    and the place in the file. Nested evidence stays as JSON text. A file is read whole: these
    are question sets, not corpora.
    """
    raw = spark.read.text(path, wholetext=True)
    if multi_line:
        rows = raw.select(F.posexplode(F.from_json("value", "array<map<string, string>>")).alias("at", "r"))
    else:
        line = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
        rows = raw.select(F.posexplode(F.transform(line, lambda x: F.from_json(x, "map<string, string>"))).alias("at", "r"))
    get = lambda *names: F.coalesce(*(F.try_element_at("r", F.lit(n)) for n in names))
    return rows.select(
        F.coalesce(get("question_id", "id"), F.concat_ws(":", get("db_id"), F.col("at").cast("string"))).alias("example_id"), get("db_id").alias("db_id"), get("question").alias("question"),
        F.coalesce(get("evidence"), F.lit("")).alias("evidence"), get("SQL", "sql", "query").alias("gold_sql"), get("difficulty").alias("difficulty"),
    )


def write_graphs(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, text): ``t # i``, ``v id label`` and ``e from to label`` lines, labels as numbers
    from 2 in the order of their text."""
    names = vertices.select("label").unionByName(edges.select("label")).distinct()
    numbered = names.withColumn("code", F.row_number().over(_by_label()) + 1)  # one row a label
    v = vertices.join(numbered, "label").groupBy("graph").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "code"))), lambda s: F.concat_ws(" ", F.lit("v"), s["id"].cast("string"), s["code"].cast("string"))), "\n").alias("v"))
    e = edges.join(numbered, "label").groupBy("graph").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("src", "dst", "code"))), lambda s: F.concat_ws(" ", F.lit("e"), s["src"].cast("string"), s["dst"].cast("string"), s["code"].cast("string"))), "\n").alias("e"))
    return v.join(e, "graph", "left").select("graph", F.concat_ws("\n", F.concat(F.lit("t # "), F.col("graph").cast("string")), "v", "e").alias("text"))


def _by_label():
    from pyspark.sql import Window

    return Window.orderBy("label")


def read_graphs(text: str) -> list[tuple[int, list[tuple[int, int]], list[tuple[int, int, int]]]]:
    """Graphs of one text, up to ``t # -1``."""
    out: list = []
    for line in text.splitlines():
        p = line.split()
        if not p:
            continue
        if p[0] == "t":
            if p[2] == "-1":
                break
            out.append((int(p[2]), [], []))
        elif p[0] == "v":
            out[-1][1].append((int(p[1]), int(p[2])))
        elif p[0] == "e":
            out[-1][2].append((int(p[1]), int(p[2]), int(p[3])))
    return out


class SealedRun:
    """A folder of tables as JSON lines that are written once: an index of hashes seals it. Rows are
    written, hashed and counted by the executors, in any store; the driver sees one row a file."""

    def __init__(self, spark: SparkSession, root: str | os.PathLike):
        self.spark, self.root = spark, str(root).rstrip("/")

    def _sealed(self) -> bool:
        fs, held = fs_of(self.spark, f"{self.root}/index")
        return fs.exists(held)

    def write(self, name: str, rows: DataFrame) -> None:
        """RuntimeError once the run is sealed; an error if the table is there."""
        if self._sealed():
            raise RuntimeError("the run is sealed")
        rows.write.mode("errorifexists").json(f"{self.root}/data/{name}")

    def index(self) -> DataFrame:
        """(name, hash, bytes, rows) of every file."""
        raw = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(f"{self.root}/data")
        name = F.regexp_extract("path", "/data/(.*)$", 1)
        return raw.select(name.alias("name"), F.sha2("content", 256).alias("hash"), F.col("length").alias("bytes"), (F.length(F.decode("content", "ISO-8859-1")) - F.length(F.replace(F.decode("content", "ISO-8859-1"), F.lit("\n"), F.lit("")))).alias("rows"))

    def seal(self) -> DataFrame:
        if self._sealed():
            raise RuntimeError("the run is sealed")
        self.index().write.mode("errorifexists").parquet(f"{self.root}/index")
        return self.spark.read.parquet(f"{self.root}/index")

    def verify(self) -> DataFrame:
        """(name, status): verified, missing, unindexed or hash_mismatch."""
        from ..operators.sets import verify_index

        return verify_index(self.spark.read.parquet(f"{self.root}/index").select("name", "hash"), self.index().select("name", "hash"))


def append_changed(rows: DataFrame, path: str, key: str, value: str, seq: str) -> int:
    """Append the rows whose value is new for their key, or another than the last one there by
    ``seq``; how many that were."""
    spark = rows.sparkSession
    fs, held = fs_of(spark, path)
    new = rows
    if fs.exists(held):
        last = spark.read.schema(rows.schema).parquet(path).groupBy(key).agg(F.max_by(value, seq).alias("_last"), F.lit(True).alias("_there"))
        joined = rows.join(last, key, "left").where(F.col("_there").isNull() | ~F.col(value).eqNullSafe(F.col("_last")))
        new = joined.select(*rows.columns)
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    return n


def compact(spark: SparkSession, path: str, gone: DataFrame, key: str) -> None:
    """Rewrite a table without the rows whose key is ``gone``: into a folder beside it, which then
    takes its place by two renames. What a broken run left beside it is cleared first."""
    fs, held = fs_of(spark, path)
    beside, old = (spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + s) for s in (".new", ".old"))
    if not fs.exists(held) and fs.exists(old):
        fs.rename(old, held)  # stopped between the renames
    fs.delete(beside, True)
    fs.delete(old, True)
    table = spark.read.parquet(path)
    table.join(gone.select(key).distinct(), key, "left_anti").select(*table.columns).write.parquet(beside.toString())
    fs.rename(held, old)
    fs.rename(beside, held)
    fs.delete(old, True)


def upsert_reviews(rows: DataFrame, path: str, keys: list[str], at: str) -> DataFrame:
    """Reviews by key: the latest by ``at``, with ``created_at`` that of the first and ``updated_at``
    of the last. ``rows`` are merged into the table at ``path``; what it holds then."""
    spark = rows.sparkSession
    fs, held = fs_of(spark, path)
    new = rows.withColumn("created_at", F.col(at)).withColumn("updated_at", F.col(at))
    both = spark.read.parquet(path).unionByName(new) if fs.exists(held) else new
    rest = [c for c in both.columns if c not in (*keys, "created_at", "updated_at")]
    merged = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "updated_at").alias("_r"), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"))
    from ..storage import materialise

    out = materialise(merged.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest), "created_at", "updated_at"))
    out.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def parsed_once(docs: DataFrame, path: str, text: str, language: Column | None = None) -> DataFrame:
    """(text_hash and the columns of its nodes) for every distinct text: trees that the table at ``path`` has are read, the
    others are parsed and appended there. The hash is of language and text."""
    from ..operators import trees

    spark = docs.sparkSession
    lang = F.coalesce(language, F.lit("")) if language is not None else F.lit("")
    own = docs.where(F.col(text).isNotNull()).select(F.sha1(F.concat(lang, F.lit("\0"), F.col(text))).alias("text_hash"), F.col(text).alias("_text"), lang.alias("_lang"))
    distinct = own.groupBy("text_hash").agg(F.min("_text").alias("_text"), F.min("_lang").alias("_lang"))
    fs, held = fs_of(spark, path)
    missing = distinct.join(spark.read.parquet(path).select("text_hash").distinct(), "text_hash", "left_anti") if fs.exists(held) else distinct
    from ..storage import materialise

    missing = materialise(missing.withColumn("_id", F.monotonically_increasing_id()))
    if not missing.isEmpty():
        nodes = trees.node_table(missing, "_id", "_text", F.nullif("_lang", F.lit("")))
        missing.select("text_hash", "_id").join(nodes, F.col("_id") == F.col("doc_id")).drop("_id", "doc_id").write.mode("append").parquet(path)
    return spark.read.parquet(path).join(distinct.select("text_hash"), "text_hash", "left_semi")


def write_json_lines(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, each task writing as fast as its store takes them."""
    rows.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def append_new(rows: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key isn't there yet; how many that were. A resumed run skips what it did."""
    spark = rows.sparkSession
    fs, held = fs_of(spark, path)
    there = fs.exists(held)
    new = rows.join(spark.read.schema(rows.schema).parquet(path).select(key), key, "left_anti") if there else rows
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    return n


def paired(rows: DataFrame, path: str, old: Column, new: Column, keys: list[str]) -> None:
    """Before and after texts in one table, parted by side."""
    before = rows.select(*keys, F.lit("before").alias("side"), old.alias("text"))
    before.unionByName(rows.select(*keys, F.lit("after").alias("side"), new.alias("text"))).write.partitionBy("side").parquet(path)

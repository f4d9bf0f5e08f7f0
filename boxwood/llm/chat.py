"""Chat formatting in budgeted windows, with DataFrame functions only.

Prefix sums of turn tokens choose turn-aligned spans of each conversation. A window is the
conversation's system turn, then a limited history of turns repeated from before the span, then
the span. Loss is on the assistant texts of the span alone, so each is trained on once.

Template: every turn is ``<|turn|>role\\ntext<|end|>\\n``. Inside roles and texts a backslash
becomes ``\\0``, ``<`` becomes ``\\1``, ``[`` becomes ``\\2`` and, in roles, a line feed becomes
``\\3``: no control string of this or a similar template can occur there, and reading undoes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import estimated_tokens, materialise, table

#: Tokens of history and span together; the system turn comes on top.
BUDGET = 512
HISTORY = 128
#: Tokens of the marks around a turn.
TURN_TOKENS = 4
#: Turns numbered so many at a time are summed on their own first, which splits a long conversation.
CHUNK = 1024
OPEN, CLOSE = "<|turn|>", "<|end|>\n"
_CODES = (("\\", "\\0"), ("<", "\\1"), ("[", "\\2"))


def escape(text: Column, line_feeds: bool = False) -> Column:
    for raw, code in (*_CODES, *((("\n", "\\3"),) if line_feeds else ())):
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for raw, code in (("\n", "\\3"), *reversed(_CODES)):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def _with_prefix(turns: DataFrame, step: int) -> DataFrame:
    """Add pos (from 1), start (tokens before the turn) and longs (turns above ``step`` before
    it), in two levels: within chunks, then over chunks."""
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    within = Window.partitionBy("cid", "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    row = turns.withColumn("pos", F.count("*").over(within)).withColumn("start", F.sum("tokens").over(within) - F.col("tokens")).withColumn("longs", F.sum(F.col("long").cast("long")).over(within) - F.col("long").cast("long"))
    sums = turns.groupBy("cid", "chunk").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"), F.sum(F.col("long").cast("long")).alias("l"))
    over = Window.partitionBy("cid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.select("cid", "chunk", *((F.sum(c).over(over) - F.col(c)).alias(c + "0") for c in "ntl"))
    joined = row.join(sums, ["cid", "chunk"])
    return joined.select("cid", "role", "text", "tokens", "long", (F.col("pos") + F.col("n0")).alias("pos"), (F.col("start") + F.col("t0")).alias("start"), (F.col("longs") + F.col("l0")).alias("longs"))


def _turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escape(role, True), F.lit("\n"), escape(text), F.lit(CLOSE))


def format_windows(conversations: DataFrame, *, budget: int = BUDGET, history: int = HISTORY, chunk: int = CHUNK, tokens_col: str | None = None) -> DataFrame:
    """conv_id, window (position of its first new turn), n_repeated (turns repeated before that),
    formatted, and loss (array of start and length in code points of ``formatted``, from 1).

    A turn's tokens are those of ``tokens_col``, or estimated from its text: then a window's ids
    are at most twice what its budget says, and fewer than that in the languages measured.

    Spans: turns that start within the same step of (budget - history) / 2 tokens go together,
    so a span of turns no longer than the step holds fewer than two steps; a longer turn is a
    span of its own, whole. A null text or role is empty; turns are taken by turn (null first),
    ties by role, then text; repeated rows are turns of their own; rows with a null conv_id
    form one conversation; an empty table has no rows; other columns are left unread. Texts are
    never cut, so a turn above the budget makes a window above it. A conversation of any length is
    summed in chunks; one window's turns meet in one row.
    """
    step = max(1, (budget - history) // 2)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # A null id is a key like any other, so that plain equality keeps rows where they are.
    key = F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit(""))
    turns = conversations.select(key.alias("cid"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("text"), *([F.coalesce(F.col(tokens_col).cast("long"), F.lit(0)).alias("known")] if tokens_col else []))
    turns = turns.withColumn("tokens", TURN_TOKENS + (F.col("known") if tokens_col else estimated_tokens("text"))).withColumn("long", F.col("tokens") > step).withColumn("chunk", F.coalesce(F.floor(F.col("turn") / chunk), F.lit(-(1 << 62))))
    placed = _with_prefix(turns, step).withColumn("k", F.floor(F.col("start") / step)).withColumn("l", 2 * F.col("longs") + F.col("long").cast("long")).withColumn("fmt", _turn(F.col("role"), F.col("text")))
    # Written once, as it is read three times: for the spans, for what repeats, for system turns.
    placed = materialise(placed.select("cid", "pos", "start", "tokens", "k", "l", "fmt", (F.col("role") == "assistant").alias("target"), F.length(escape(F.col("role"), True)).alias("role_length"), ((F.col("pos") == 1) & (F.col("role") == "system")).alias("system")))
    new = F.sort_array(F.collect_list(F.struct("pos", "fmt", "target", "role_length")))
    spans = placed.groupBy("cid", "k", "l").agg(F.min("pos").alias("window"), new.alias("new"))
    later = materialise(placed.groupBy("cid", "k", "l").agg(F.min("pos").alias("window"), F.min("start").alias("at")).where(F.col("window") > 1).drop("window"))
    # Turns within the history before a span: equal buckets of the history's length, then the range.
    before = later.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("at") - history) / history), F.floor(F.col("at") / history))))
    old = placed.where(~F.col("system")).select("cid", "pos", "fmt", F.col("start").alias("from"), (F.col("start") + F.col("tokens")).alias("to"), F.floor(F.col("start") / max(1, history)).alias("bucket"))
    near = old.join(before, ["cid", "bucket"]).where((F.col("from") >= F.col("at") - history) & (F.col("to") <= F.col("at")))
    systems = later.join(placed.where("system").select("cid", "pos", "fmt"), "cid")
    repeated = near.select("cid", "k", "l", "pos", "fmt").unionByName(systems.select("cid", "k", "l", "pos", "fmt"))
    repeated = repeated.groupBy("cid", "k", "l").agg(F.sort_array(F.collect_list(F.struct("pos", "fmt"))).alias("old"))
    whole = spans.join(repeated, ["cid", "k", "l"], "left").withColumn("repeated", F.coalesce(F.col("old.fmt"), F.array().cast("array<string>")))
    opening = len(OPEN) + 2  # to the text's first character, without the role
    start = F.struct(F.length(F.array_join("repeated", "")).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("loss"))

    def add(state: Column, turn: Column) -> Column:
        span = F.struct((state["at"] + opening + turn["role_length"]).cast("long").alias("start"), (F.length(turn["fmt"]) - len(OPEN) - 1 - len(CLOSE) - turn["role_length"]).cast("long").alias("length"))
        loss = F.when(turn["target"], F.concat(state["loss"], F.array(span))).otherwise(state["loss"])
        return F.struct((state["at"] + F.length(turn["fmt"])).cast("long").alias("at"), loss.alias("loss"))

    return whole.select(
        F.when(F.col("cid") != "", F.col("cid")).cast("long").alias("conv_id"),
        "window",
        F.size("repeated").alias("n_repeated"),
        F.concat(F.array_join("repeated", ""), F.array_join("new.fmt", "")).alias("formatted"),
        F.aggregate("new", start, add, lambda s: s["loss"]).alias("loss"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """Parse windows back: conv_id, window, turns (array of role and text, repeated ones left
    out), targets (array of texts under the loss mask, unescaped), formatted."""
    parts = F.slice(F.split("formatted", r"<\|turn\|>", -1), F.col("n_repeated") + 2, F.size(F.split("formatted", r"<\|turn\|>", -1)))

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        text = F.substr(part, F.length(role) + 2, F.length(part) - F.length(role) - 1 - len(CLOSE))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    targets = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"].cast("int"), s["length"].cast("int"))))
    return windows.select("conv_id", "window", F.transform(parts, turn).alias("turns"), targets.alias("targets"), "formatted")


def op5_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that holds control strings, formatted and read back. The
    digests are of whole conversations, so here each is one row."""
    own = spark.sql("SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    read = read_windows(format_windows(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    digest = read.select("conv_id", F.struct("window", said.alias("said"), F.array_join("targets", "").alias("loss")).alias("w"), F.size("turns").alias("n"), F.length("formatted").alias("chars"))
    whole = digest.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sort_array(F.collect_list("w")).alias("w"), F.sum("chars").alias("formatted_chars"))
    whole = whole.select("conv_id", "n_turns", F.array_join("w.said", "").alias("said"), F.array_join("w.loss", "").alias("loss"), "formatted_chars")
    return whole.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


ORACLE_SQL = r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(turn, role)
), e AS (
    SELECT *, 4 + CAST(ceil(length(text) / 2.0) + strlen(text) - length(text) AS BIGINT) AS tokens,
        17 + length(replace(replace(replace(replace(role, '\', '\0'), '<', '\1'), '[', '\2'), chr(10), '\3'))
           + length(replace(replace(replace(text, '\', '\0'), '<', '\1'), '[', '\2')) AS chars
    FROM c
), p AS (
    SELECT *, row_number() OVER w AS pos, sum(tokens) OVER w - tokens AS start,
        sum(CASE WHEN tokens > 192 THEN 1 ELSE 0 END) OVER w - CASE WHEN tokens > 192 THEN 1 ELSE 0 END AS longs
    FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
), s AS (
    SELECT conv_id, min(pos) AS win, min(start) AS at, sum(chars) AS chars
    FROM p GROUP BY conv_id, start // 192, 2 * longs + CASE WHEN tokens > 192 THEN 1 ELSE 0 END
), y AS (
    SELECT conv_id, chars FROM p WHERE pos = 1 AND role = 'system'
), h AS (
    SELECT s.conv_id, s.win, sum(p.chars) AS chars
    FROM s JOIN p ON p.conv_id = s.conv_id AND p.start >= s.at - 128 AND p.start + p.tokens <= s.at AND NOT (p.pos = 1 AND p.role = 'system')
    GROUP BY s.conv_id, s.win
), f AS (
    SELECT s.conv_id, sum(s.chars + coalesce(h.chars, 0) + CASE WHEN s.win > 1 THEN coalesce(y.chars, 0) ELSE 0 END) AS formatted_chars
    FROM s LEFT JOIN h ON h.conv_id = s.conv_id AND h.win = s.win LEFT JOIN y ON y.conv_id = s.conv_id GROUP BY s.conv_id
), d AS (
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
        coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '') AS loss
    FROM p GROUP BY conv_id
)
SELECT d.conv_id, CAST(n_turns AS BIGINT) AS n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
    CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM d JOIN f ON f.conv_id = d.conv_id
"""

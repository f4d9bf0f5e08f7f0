"""Mixing sources to target weights by temperature.

A source's weight is its share of all tokens to the power of an exponent, normalised. The
exponent is bisected until the weights' entropy meets a target or the scarcest source is
repeated as often as allowed. Budgets are the weights times a total; a source is taken in whole
passes and one part of a pass, each a permutation of its own by hash, in blocks: every output
block holds each source in its weight.

Permutations are by buckets of a digest, so budgets, the cut of the last pass and the blocks
follow from token sums of (source, bucket) alone: no source is ever sorted in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import estimated_tokens, materialise, table

#: Buckets of one source's permutation: the grain of budgets and blocks.
BUCKETS = 1024
MAX_REPEATS = 2.0
BLOCK_TOKENS = 1_000_000
#: Rows of the schedule that are broadcast, at most (some 60 bytes each).
FEW = 128 * BUCKETS


@dataclass
class Mixture:
    """The exponent, and by source its tokens, weight and passes (whole and part)."""

    exponent: float
    tokens: dict[str | None, int]
    weights: dict[str | None, float]
    passes: dict[str | None, float]


def _weights(shares: np.ndarray, exponent: float) -> np.ndarray:
    w = np.exp(exponent * (np.log(shares) - np.log(shares.max())))
    return w / w.sum()


def _entropy(w: np.ndarray) -> float:
    w = w[w > 0]
    return float(-(w * np.log(w)).sum())


def bisect_exponent(shares: np.ndarray, *, entropy: float | None = None, max_repeats: float = MAX_REPEATS) -> float:
    """The exponent in [0, 1] whose weights have at least ``entropy`` (nats), or the least one
    that keeps the scarcest source within ``max_repeats`` passes while the commonest has one.

    Both measures are monotone in the exponent. A target above what exponent 0 gives is met as
    far as that goes.
    """

    def flat_enough(a: float) -> bool:
        """True if the exponent could still be higher (the weights are flatter than needed)."""
        if entropy is not None:
            return _entropy(_weights(shares, a)) >= entropy
        return bool((shares.min() / shares.max()) ** (a - 1) > max(1.0, max_repeats))

    if flat_enough(1.0) or not flat_enough(0.0):
        return 1.0 if flat_enough(1.0) else 0.0
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if flat_enough(mid) else (lo, mid)
    return lo if entropy is not None else hi


def tokens_of(text: str) -> Column:
    """A text's estimated tokens and an end mark."""
    return estimated_tokens(text) + 1


def plan(sizes: dict[str | None, int], *, budget: int | None = None, entropy: float | None = None, max_repeats: float = MAX_REPEATS) -> Mixture:
    """Weights and passes from token counts. Without a ``budget`` it is the least at which every
    source is passed at least once, so that mixing loses no document."""
    names = sorted(sizes, key=lambda s: (s is not None, s or ""))
    counts = np.array([sizes[s] for s in names], dtype=float)
    shares = counts / counts.sum()
    exponent = bisect_exponent(shares, entropy=entropy, max_repeats=max_repeats)
    w = _weights(shares, exponent)
    total = float((counts / w).max()) if budget is None else float(budget)
    passes = total * w / counts
    # One pass is one, not a hair less.
    passes = np.where(np.abs(passes - np.rint(passes)) < 1e-9, np.rint(passes), passes)
    return Mixture(exponent, {s: int(n) for s, n in zip(names, counts, strict=True)}, dict(zip(names, w.tolist(), strict=True)), dict(zip(names, passes.tolist(), strict=True)))


def _bucket(id_col: str, text_col: str) -> Column:
    digest = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.col(text_col)))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % BUCKETS).cast("int")


def _order(seed: int) -> Column:
    """Where a bucket comes in a pass: a permutation of the buckets for each pass."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), "source", F.col("pass").cast("string"), F.col("bucket").cast("string")))


def _schedule(sums: DataFrame, mixture: Mixture, block_tokens: int, seed: int) -> DataFrame:
    """(source, bucket, pass, weight, block, begin, end): which buckets each pass takes, into
    which block, and where in the run of blocks they begin and end.

    ``sums``: tokens of (source, bucket), at most BUCKETS rows a source; so are all windows'
    groups, times the passes.
    """
    spark = sums.sparkSession
    rows = [(s, mixture.weights[s], mixture.passes[s], mixture.tokens[s]) for s in mixture.tokens]
    plan_rows = spark.createDataFrame(rows, "p_source string, weight double, passes double, total long")
    due = sums.join(plan_rows, F.col("source").eqNullSafe(F.col("p_source")))
    due = due.withColumn("pass", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil("passes").cast("int") - 1, F.lit(0)))))
    within = Window.partitionBy("source", "pass").orderBy(_order(seed), "bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    due = due.withColumn("before", F.sum("tokens").over(within) - F.col("tokens"))
    # The last pass ends where its share does, at the nearest bucket.
    part = F.least(F.lit(1.0), F.col("passes") - F.col("pass"))
    due = due.where((part >= 1) | (F.col("before") + F.col("tokens") / 2 <= part * F.col("total")))
    at = F.col("pass") * F.col("total") + F.col("before")
    per_block = F.greatest(F.lit(1.0), F.col("weight") * block_tokens)
    # Where the bucket begins and ends, in blocks.
    return due.select("source", "bucket", "pass", "weight", F.floor(at / per_block).cast("long").alias("block"), (at / per_block).alias("begin"), ((at + F.col("tokens")) / per_block).alias("end"))


def schedule(docs: DataFrame, *, budget: int | None = None, entropy: float | None = None, max_repeats: float = MAX_REPEATS, block_tokens: int = BLOCK_TOKENS, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokens_col: str | None = None) -> tuple[Mixture, DataFrame]:
    """The mixture of ``docs`` and its schedule. Sums by source come to the driver. Tokens are
    estimated, unless a column has their number."""
    own = docs.select(F.col(source_col).cast("string").alias("source"), _bucket(id_col, text_col).alias("bucket"), (F.col(tokens_col).cast("long") if tokens_col else tokens_of(text_col)).alias("tokens"))
    sums = materialise(own.groupBy("source", "bucket").agg(F.sum("tokens").alias("tokens")))
    sizes = {r["source"]: r["n"] for r in sums.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    if not sizes:
        return Mixture(1.0, {}, {}, {}), sums.select("source", "bucket", F.lit(0).alias("pass"), F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("block"), F.lit(0.0).alias("begin"), F.lit(0.0).alias("end"))
    mixture = plan(sizes, budget=budget, entropy=entropy, max_repeats=max_repeats)
    return mixture, materialise(_schedule(sums, mixture, block_tokens, seed))


def mix(docs: DataFrame, **how) -> DataFrame:
    """All columns of ``docs``, every row as often as its source's passes take it, in the order
    of the schedule: partitions and the rows in them follow the blocks.

    In a block, rows lie where their pass puts their bucket, and a bucket's rows are dealt over
    its span by hash, so that runs of rows shorter than a block hold the sources in their
    weights too; a row's copies are about a pass of its source apart.

    See ``schedule`` for the parameters. A null source is a source of its own, a null text is
    one token; texts of any length go whole; equal rows and ids are rows of their own; an empty
    table stays empty; other columns pass as they are.
    """
    id_col, text_col, source_col = (how.get(k, v) for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source")))
    _, taken = schedule(docs, **how)
    taken = taken.select(*(F.col(c).alias(f"_boxwood_{c}") for c in ("source", "bucket", "pass", "block", "begin", "end")))
    same = F.col(source_col).cast("string").eqNullSafe(F.col("_boxwood_source")) & (_bucket(id_col, text_col) == F.col("_boxwood_bucket"))
    # Either way gives the same rows.
    few = taken.count() <= FEW
    joined = docs.join(F.broadcast(taken) if few else taken, same)
    share = F.pmod(F.xxhash64(F.lit(how.get("seed", 0)), "_boxwood_pass", F.col(id_col).cast("string"), text_col), F.lit(1 << 20)) / (1 << 20)
    placed = joined.withColumn("_boxwood_at", F.col("_boxwood_begin") + share * (F.col("_boxwood_end") - F.col("_boxwood_begin")))
    dealt = placed.repartitionByRange("_boxwood_block", "_boxwood_at").sortWithinPartitions("_boxwood_block", "_boxwood_at")
    return dealt.select(*(docs[c] for c in docs.columns))


def op6_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's copies in the mixture: doc_id, source, pass, block, tokens, weight."""
    docs = table(spark, sf_dir, "documents")
    own = docs.select("doc_id", "source", tokens_of("text").alias("tokens"), _bucket("doc_id", "text").alias("bucket"))
    _, taken = schedule(docs)
    taken = taken.select(F.col("source").alias("t_source"), F.col("bucket").alias("t_bucket"), "pass", "block", "weight")
    found = own.join(taken, F.col("source").eqNullSafe(F.col("t_source")) & (F.col("bucket") == F.col("t_bucket")))
    return found.select("doc_id", "source", "pass", "block", "tokens", F.round("weight", 9).alias("weight"))


#: The bisected exponent has a closed form for a repetition limit: (least / most share)^(a - 1) = limit.
ORACLE_SQL = f"""
WITH d AS (
    SELECT doc_id, source, 1 + CAST(coalesce(ceil(length(text) / 2.0) + strlen(text) - length(text), 0) AS BIGINT) AS tokens,
        CAST('0x' || substr(md5(concat_ws(':', CAST(doc_id AS VARCHAR), text)), 1, 8) AS BIGINT) % {BUCKETS} AS bucket
    FROM documents
), n AS (
    SELECT source, CAST(sum(tokens) AS BIGINT) AS total FROM d GROUP BY source
), e AS (
    SELECT CASE WHEN max(total) / min(total) > {MAX_REPEATS} THEN 1 + ln({MAX_REPEATS}) / ln(min(total) / max(total)) ELSE 0 END AS a, max(total) AS most FROM n
), w AS (
    SELECT source, total, pow(total / most, a) / sum(pow(total / most, a)) OVER () AS weight FROM n, e
), p AS (
    SELECT *, max(total / weight) OVER () * weight / total AS passes FROM w
), q AS (
    SELECT source, total, weight, CASE WHEN abs(passes - round(passes)) < 1e-9 THEN round(passes) ELSE passes END AS passes FROM p
), s AS (
    SELECT source, bucket, CAST(sum(tokens) AS BIGINT) AS tokens FROM d GROUP BY source, bucket
), u AS (
    SELECT s.source, s.bucket, s.tokens, q.total, q.weight, q.passes, unnest(generate_series(0, greatest(CAST(ceil(q.passes) AS INTEGER) - 1, 0))) AS pass
    FROM s JOIN q ON s.source IS NOT DISTINCT FROM q.source
), v AS (
    SELECT *, sum(tokens) OVER (PARTITION BY source, pass ORDER BY md5(concat_ws(':', '0', source, CAST(pass AS VARCHAR), CAST(bucket AS VARCHAR))), bucket ROWS UNBOUNDED PRECEDING) - tokens AS before FROM u
), t AS (
    SELECT source, bucket, pass, weight, CAST(floor((pass * total + before) / greatest(1.0, weight * {BLOCK_TOKENS})) AS BIGINT) AS block
    FROM v WHERE passes - pass >= 1 OR before + tokens / 2 <= (passes - pass) * total
)
SELECT d.doc_id, d.source, CAST(t.pass AS INTEGER) AS pass, t.block, d.tokens, round(t.weight, 9) AS weight
FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source AND t.bucket = d.bucket
"""

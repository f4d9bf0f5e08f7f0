"""Rules over atoms: OR of AND-clauses, found by joins and chosen greedily.

Clauses of up to three atoms are built level by level from frequent ones, and counted over the
distinct sets of atoms that samples have. The greedy choice works on the few best clauses alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise


def _apart(truth: DataFrame) -> DataFrame:
    """The truth for a join by sample that isn't broadcast: its rows compress to so little that the
    planner takes a table of all samples for a small one."""
    return truth.hint("merge")


def rank_atoms(features: DataFrame, truth: DataFrame, most: int = 48) -> DataFrame:
    """(atom, tp, fp, precision, lift, score) of the best atoms. features: sample, atom (distinct);
    truth: sample, positive."""
    n = truth.agg(F.count("*").alias("n"), F.count_if("positive").alias("p"))  # one row
    counts = features.join(_apart(truth), "sample").groupBy("atom").agg(F.count_if("positive").alias("tp"), F.count_if(~F.col("positive")).alias("fp"))
    scored = counts.join(F.broadcast(n)).withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp"))).withColumn("lift", F.coalesce(F.try_divide(F.col("precision"), F.col("p") / F.col("n")), F.lit(0.0)))
    scored = scored.withColumn("score", F.round(F.col("precision") * F.log1p("tp") * F.log1p("lift"), 9)).where("tp > 0")
    return scored.orderBy(F.desc("score"), "atom").limit(most).select("atom", "tp", "fp", "precision", "lift", "score")


def clauses(features: DataFrame, truth: DataFrame, atoms: DataFrame, *, least: int = 2, precision: float = 0.5, longest: int = 3) -> DataFrame:
    """(clause, size, tp, fp, precision): AND-clauses of the ranked atoms with at least ``least``
    positives, whatever the order of atoms; those below ``precision`` are grown but not kept."""
    own = features.join(F.broadcast(atoms.select("atom")), "atom").join(_apart(truth), "sample").groupBy("sample", "positive").agg(F.array_sort(F.collect_set("atom")).alias("atoms"))
    # Samples with the same atoms count together, and clauses grow from the atoms that a row holds: no
    # join by sample, whose compressed table would pass for one that is small enough to go to the driver.
    sets = own.groupBy("atoms").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n"))
    level = sets.select("atoms", "p", "n", F.explode("atoms").alias("last")).select("atoms", "p", "n", F.array("last").alias("clause"), "last")
    out = None
    for size in range(1, longest + 1):
        level = materialise(level)
        counts = materialise(level.groupBy("clause").agg(F.sum("p").alias("tp"), F.sum("n").alias("fp")).where(F.col("tp") >= least))
        found = counts.withColumn("size", F.lit(size)).withColumn("precision", F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 6))
        out = found if out is None else out.unionByName(found)
        if size == longest or counts.isEmpty():
            break
        level = level.join(counts.select("clause"), "clause", "left_semi").withColumn("next", F.explode(F.filter("atoms", lambda a: a > F.col("last"))))
        level = level.select("atoms", "p", "n", F.concat("clause", F.array("next")).alias("clause"), F.col("next").alias("last"))
    return out.where(F.col("precision") >= precision).select("clause", "size", "tp", "fp", "precision")


def greedy(found: DataFrame, features: DataFrame, truth: DataFrame, *, most: int = 6, beta: float = 0.75, penalty: float = 0.01, pool: int = 64) -> list[tuple[list[str], float]]:
    """Clauses added while F-beta less a penalty for each clause grows. The candidates are the
    ``pool`` best clauses, a small table; each step scores them all in one job."""
    best = [tuple(r["clause"]) for r in found.orderBy(F.desc("precision"), F.desc("tp"), "size", F.array_join("clause", "&")).limit(pool).collect()]
    if not best:
        return []
    sets = features.groupBy("sample").agg(F.collect_set("atom").alias("atoms")).join(_apart(truth), "sample")
    sets = materialise(sets.select("positive", *(F.forall(F.array(*map(F.lit, c)), lambda a: F.array_contains("atoms", a)).alias(f"c{i}") for i, c in enumerate(best))))
    total = truth.where("positive").count()
    chosen: list[int] = []
    scores: list[float] = []
    while len(chosen) < min(most, len(best)):
        rest = [i for i in range(len(best)) if i not in chosen]
        covered = [F.col(f"c{j}") for j in chosen]
        exprs = []
        for i in rest:
            hit = F.col(f"c{i}")
            for c in covered:
                hit = hit | c
            exprs += [F.count_if(hit & F.col("positive")).alias(f"t{i}"), F.count_if(hit & ~F.col("positive")).alias(f"f{i}")]
        row = sets.agg(*exprs).first()
        ranked = []
        for i in rest:
            tp, fp = row[f"t{i}"], row[f"f{i}"]
            p, r = tp / max(tp + fp, 1), tp / max(total, 1)
            f = (1 + beta * beta) * p * r / (beta * beta * p + r) if p + r else 0.0
            ranked.append((round(f - penalty * (len(chosen) + 1), 9), -i))
        score, i = max(ranked)
        if scores and score <= scores[-1]:
            break
        chosen.append(-i)
        scores.append(score)
    return [(list(best[i]), s) for i, s in zip(chosen, scores, strict=True)]

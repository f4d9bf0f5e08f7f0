"""Picking bounded evidence: bundles, segments, representatives, expansions, alignments, marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise
from . import trees


# ---- rows and reviews ----------------------------------------------------------------------


def review_errors(reviewer: Column, intent: Column, meaning: Column, entailment: Column, specificity: Column, confidence: Column) -> Column:
    """What is wrong with a review, as an array. Scores are whole numbers from 1 to 5; meaning,
    entailment and specificity are only asked for where an intent is shared."""
    yes = F.trim(F.coalesce(intent, F.lit(""))) == "yes"

    def bad(value: Column) -> Column:
        return value.isNull() | (value != F.floor(value)) | ~value.between(1, 5)

    checks = {
        "reviewer_id": ~F.rlike(F.trim(F.coalesce(reviewer, F.lit(""))), F.lit(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,63}$")),
        "shared_intent": ~F.trim(F.coalesce(intent, F.lit(""))).isin("yes", "no", "uncertain"),
        "output_meaning": yes & (F.length(F.trim(F.coalesce(meaning, F.lit("")))) < 3),
        "entailment": yes & bad(entailment),
        "specificity": yes & bad(specificity),
        "confidence": bad(confidence),
    }
    return F.filter(F.array(*(F.when(c, F.lit(name)) for name, c in checks.items())), lambda e: e.isNotNull())


def cluster_review_errors(reviewer: Column, verdict: Column, included: Column, excluded: Column, members: Column, name: Column) -> Column:
    """What is wrong with a review of a cluster, as an array. Included and excluded members are
    apart, are members, and together are all of them; an accepted cluster includes two or more and
    has a name of three characters or more."""
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    own = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    a, b, m = own(included), own(excluded), own(members)
    accepted = text(verdict) == "accept"
    checks = {
        "reviewer_id": ~F.rlike(text(reviewer), F.lit(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,63}$")),
        "verdict": ~text(verdict).isin("accept", "split", "reject"),
        "overlap": F.size(F.array_intersect(a, b)) > 0,
        "not_members": F.size(F.array_except(F.concat(a, b), m)) > 0,
        "not_reviewed": F.size(F.array_except(m, F.concat(a, b))) > 0,
        "too_few": accepted & (F.size(F.array_distinct(a)) < 2),
        "name": accepted & (F.length(text(name)) < 3),
    }
    return F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in checks.items())), lambda e: e.isNotNull())


def partition_check(members: DataFrame, included: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """One row: keys in both parts, in neither, and in a part though no member."""
    sides = members.select(key, F.lit(0).alias("s")).unionByName(included.select(key, F.lit(1).alias("s"))).unionByName(excluded.select(key, F.lit(2).alias("s")))
    by = sides.groupBy(key).agg(*(F.max((F.col("s") == i).cast("int")).alias(n) for i, n in enumerate(("m", "i", "e"))))
    return by.agg(F.count_if(F.expr("i + e = 2")).alias("in_both"), F.count_if(F.expr("m = 1 AND i + e = 0")).alias("in_neither"), F.count_if(F.expr("m = 0")).alias("not_members"))


def last_by(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def capped_hits(hits: DataFrame, order: list[str], cap: int) -> DataFrame:
    """The first hits in order, and whether there were more; no more than cap + 1 rows are kept
    by any task."""
    first = hits.orderBy(*order).limit(cap + 1)
    more = first.agg((F.count("*") > cap).alias("truncated"))  # one row
    return first.orderBy(*order).limit(cap).join(F.broadcast(more))


def closest_names(paths: DataFrame, cwd: str) -> DataFrame:
    """(name, kind, path, score): for every file or folder name the path that shares the most
    leading folders with ``cwd``; ties go to files, then to the lesser path."""
    here = cwd.split("/") if cwd else []
    nested = paths.where(F.contains("path", F.lit("/")))
    folders = nested.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/")) - 1), lambda n: F.array_join(F.slice(F.split("path", "/"), 1, n), "/"))).alias("path"), F.lit("folder").alias("kind")).distinct()
    every = paths.select("path", F.lit("file").alias("kind")).unionByName(folders)
    parts = F.split("path", "/")
    score = sum((F.when(F.slice(parts, 1, n) == F.array(*map(F.lit, here[:n])), 1).otherwise(0) for n in range(1, len(here) + 1)), F.lit(0))
    scored = every.select(F.element_at(parts, -1).alias("name"), "kind", "path", score.alias("score"))
    best = scored.groupBy("name").agg(F.min(F.struct((-F.col("score")).alias("s"), "kind", "path")).alias("b"))
    return best.select("name", F.col("b.kind").alias("kind"), F.col("b.path").alias("path"), (-F.col("b.s")).alias("score"))


def split_segments(rows: DataFrame, start: str, end: str, lo: str, hi: str) -> DataFrame:
    """Each segment cut at a highlight that it meets: up to three parts, the middle one marked."""
    s, e = F.col(start), F.col(end)
    a, b = F.greatest(s, F.col(lo)), F.least(e, F.col(hi))
    part = lambda x, y, marked: F.struct(x.alias("start"), y.alias("end"), F.lit(marked).alias("marked"))
    met = F.filter(F.array(part(s, a, False), part(a, b, True), part(b, e, False)), lambda p: p["start"] < p["end"])
    parts = F.when((F.col(hi) <= s) | (F.col(lo) >= e), F.array(part(s, e, False))).otherwise(met)
    others = [c for c in rows.columns if c not in (start, end, lo, hi)]
    return rows.select(*others, F.explode(parts).alias("_p")).select(*others, "_p.start", "_p.end", "_p.marked")


def label_signature(rows: DataFrame, key: str, label: str, most: int = 8) -> DataFrame:
    """(key, signature): the commonest labels with their counts, joined by plus signs."""
    counts = rows.groupBy(key, label).agg(F.count("*").alias("n"))
    ranked = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col(label).alias("l")))), 1, most)
    return counts.groupBy(key).agg(F.array_join(F.transform(ranked, lambda x: F.concat(x["l"], F.lit("×"), (-x["k"]).cast("string"))), " + ").alias("signature"))


# ---- vectors -------------------------------------------------------------------------------


def representatives(fits: DataFrame, group: str, key: str, count: int) -> DataFrame:
    """(group, key, role) of up to ``count`` members: the medoid, the rest of the core half by
    falling fit, then the boundary from the other end."""
    core = max(1, count // 2)
    down = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("fit"), key))
    up = F.row_number().over(Window.partitionBy(group).orderBy("fit", F.desc(key)))
    ranked = fits.select(group, key, down.alias("down"), up.alias("up"))
    role = F.when(F.col("down") == 1, "medoid").when(F.col("down") <= core, "core").when(F.col("up") <= count - core, "boundary")
    return ranked.withColumn("role", role).where("role IS NOT NULL").select(group, key, "role")


def expand(scored: DataFrame, group: str, key: str, k: int, slack: float = 0.05, keep_all: bool = False) -> DataFrame:
    """(group, key, similarity, clears): the k best rows that aren't seeds. A group's floor is
    the least similarity of its seeds less ``slack``; rows below it go unless ``keep_all``.
    ``scored``: group, key, similarity, seed."""
    floors = scored.where("seed").groupBy(group).agg((F.min("similarity") - slack).alias("floor"))
    rest = scored.where(~F.col("seed")).join(F.broadcast(floors), group).withColumn("clears", F.col("similarity") >= F.col("floor"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("similarity"), key))
    top = (rest if keep_all else rest.where("clears")).withColumn("_place", place).where(F.col("_place") <= k)
    return top.select(group, key, "similarity", "clears")


# ---- alignment and validation ----------------------------------------------------------------


def greedy_clauses(members: DataFrame, hosts: DataFrame, *, purity: float = 0.10, most: int = 6) -> DataFrame:
    """(cluster, clause, place): the clauses that a greedy cover of each cluster would pick.

    members: cluster, member; hosts: clause, member. Clauses go by F1 with the cluster, then
    overlap, then name; those below ``purity`` are passed over, and so are those that cover no
    new member. A clause covers something new exactly if it is the first eligible one of some
    member, so no loop is needed.
    """
    na, nb = members.groupBy("cluster").agg(F.count("*").alias("na")), hosts.groupBy("clause").agg(F.count("*").alias("nb"))
    hits = members.join(hosts, "member")
    pairs = hits.groupBy("cluster", "clause").agg(F.count("*").alias("shared")).join(na, "cluster").join(nb, "clause")
    pairs = pairs.withColumn("f1", F.round(2 * F.col("shared") / (F.col("na") + F.col("nb")), 9)).where(F.col("shared") / F.col("nb") >= purity)
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("f1"), F.desc("shared"), "clause"))
    ranked = pairs.select("cluster", "clause", rank.alias("rank"))
    first = hits.join(ranked, ["cluster", "clause"]).groupBy("cluster", "member").agg(F.min(F.struct("rank", "clause")).alias("b"))
    chosen = first.select("cluster", F.col("b.clause").alias("clause"), F.col("b.rank").alias("rank")).distinct()
    place = F.row_number().over(Window.partitionBy("cluster").orderBy("rank"))
    return chosen.select("cluster", "clause", place.cast("long").alias("place")).where(F.col("place") <= most)


def cross_validate(features: DataFrame, truth: DataFrame, *, atoms: int = 8, precision: float = 0.5, least: int = 2) -> DataFrame:
    """(fold, atoms, tp, fp, fn): for each fold the best atoms of the other folds, OR-ed, on it.

    features: sample, atom (distinct); truth: sample, positive, fold. All folds are trained at
    once: an atom's counts outside a fold are its counts less those inside.
    """
    by = features.join(truth, "sample").groupBy("atom", "fold").agg(F.count_if(F.expr("positive")).alias("p"), F.count_if(~F.col("positive")).alias("n"))
    whole = by.groupBy("atom").agg(F.sum("p").alias("tp"), F.sum("n").alias("tn"))
    folds = truth.select("fold").distinct()  # as many rows as folds
    train = whole.crossJoin(F.broadcast(folds)).join(by, ["atom", "fold"], "left").select("fold", "atom", (F.col("tp") - F.coalesce("p", F.lit(0))).alias("p"), (F.col("tn") - F.coalesce("n", F.lit(0))).alias("n"))
    good = train.where((F.col("p") >= least) & (F.col("p") / (F.col("p") + F.col("n")) >= precision))
    place = F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("p"), "n", "atom"))
    chosen = good.withColumn("_place", place).where(F.col("_place") <= atoms).select("fold", "atom")
    hit = features.join(truth.select("sample", "fold"), "sample").join(F.broadcast(chosen), ["fold", "atom"], "left_semi").select("sample").distinct().withColumn("hit", F.lit(True))
    judged = truth.join(hit, "sample", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    counts = judged.groupBy("fold").agg(F.count_if(F.expr("hit AND positive")).alias("tp"), F.count_if(F.expr("hit AND NOT positive")).alias("fp"), F.count_if(F.expr("NOT hit AND positive")).alias("fn"))
    sizes = chosen.groupBy("fold").agg(F.count("*").alias("atoms"))
    return counts.join(sizes, "fold", "left").select("fold", F.coalesce("atoms", F.lit(0)).alias("atoms"), "tp", "fp", "fn")


# ---- trees -----------------------------------------------------------------------------------


def outermost(nodes: DataFrame, picked: DataFrame, key: str) -> DataFrame:
    """Of the picked nodes (key, id) those that lie in no other picked one."""
    inside = trees.ancestors(nodes, key).join(picked.select(key, F.col("id").alias("ancestor")), [key, "ancestor"], "left_semi").select(key, "id").distinct()
    return picked.join(inside, [key, "id"], "left_anti")


def highlight_marks(nodes: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """(key, at, upto, id): the unit that holds a span; where that is only the root, the topmost
    units that the span touches; where there are none, the tightest box."""
    root = nodes.where("parent IS NULL").select(key, F.col("id").alias("root"))
    real = nodes.where("semantic").join(root, key).where("id <> root").select(key, "id", "start", "end")
    tight = trees.tightest(nodes, spans, key).select(key, "at", "upto", F.col("id").alias("box"))
    own = trees.ancestors(nodes, key).unionByName(nodes.select(key, "id", F.col("id").alias("ancestor"), F.lit(0).cast("long").alias("distance")))
    units = own.join(real.select(key, F.col("id").alias("ancestor")), [key, "ancestor"], "left_semi")
    nearest = units.groupBy(key, F.col("id").alias("box")).agg(F.min_by("ancestor", "distance").alias("unit"))
    found = materialise(tight.join(nearest, [key, "box"], "left"))
    held = found.where("unit IS NOT NULL").select(key, "at", "upto", F.col("unit").alias("id"))
    loose = found.where("unit IS NULL").select(key, "at", "upto", "box")
    topmost = outermost(nodes, real.select(key, "id"), key).join(nodes.select(key, "id", "start", "end"), [key, "id"])
    touched = loose.join(topmost, key).where((F.col("end") > F.col("at")) & (F.col("start") < F.greatest("upto", F.col("at") + 1))).select(key, "at", "upto", "id")
    bare = loose.join(touched, [key, "at", "upto"], "left_anti").select(key, "at", "upto", F.col("box").alias("id"))
    return held.unionByName(touched).unionByName(bare)


def frontier_chunks(nodes: DataFrame, marks: DataFrame, spans: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, id, start, end, target): the text tiled by the minimal frontier of the marks and of
    what each text's span (key, at, upto) highlights; target: the tile where the span begins."""
    both = materialise(marks.select(key, "id").unionByName(highlight_marks(nodes, spans, key).select(key, "id")).distinct())
    sizes = nodes.where("parent IS NULL").select(key, F.col("start").alias("lo"), F.col("end").alias("hi"))
    frontier = materialise(trees.minimal_frontier(nodes, both, key).select(key, "id", "start", "end"))
    tiles = trees.coverage(frontier.join(sizes, key), texts, key, text)
    probe = spans.join(sizes, key).select(key, F.greatest("lo", F.least("at", F.col("hi") - 1)).alias("probe"))
    boxes = frontier.join(probe, key, "left").select(key, "id", F.coalesce((F.col("start") <= F.col("probe")) & (F.col("probe") < F.col("end")), F.lit(False)).alias("target"))
    return tiles.join(boxes, [key, "id"])


def line_context(rows: DataFrame, key: str, first: str, last: str, budget: int) -> DataFrame:
    """(key, part, lines, chars): a highlight of lines, cut to two fifths of the budget, and the
    nearest lines around it, nearest first, while they fit into the rest.

    ``rows``: key, line, content, and the first and last highlighted line.
    """
    inside = F.col("line").between(F.col(first), F.col(last))
    marked = rows.where(inside).groupBy(key).agg(F.count("*").alias("lines"), F.least(F.sum(F.length("content") + 1), F.lit(budget * 2 // 5)).cast("long").alias("chars"))
    gap = F.greatest(F.col(first) - F.col("line"), F.col("line") - F.col(last))
    around = rows.where(~inside).withColumn("_gap", gap).withColumn("_size", F.length("content") + 1)
    total = F.sum("_size").over(Window.partitionBy(key).orderBy("_gap", "line").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fits = around.withColumn("_total", total).join(marked.select(key, F.col("chars").alias("_used")), key).where(F.col("_total") <= budget - F.col("_used"))
    near = fits.groupBy(key).agg(F.count("*").alias("lines"), F.sum("_size").cast("long").alias("chars"))
    return marked.select(key, F.lit("highlight").alias("part"), "lines", "chars").unionByName(near.select(key, F.lit("around").alias("part"), "lines", "chars"))


def fold_context(chain: Column, bare: Column) -> Column:
    """A folder chain's context, topmost first, folded into what it holds: each step's digest is
    of the folder and the context above it."""
    step = lambda above, own: F.substring(F.sha1(F.concat(own, F.lit(":"), above)), 1, 16)
    return step(F.aggregate(chain, F.lit(""), step), bare)

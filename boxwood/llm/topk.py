"""Exact top-k inner-product search with a pivot-distance index.

Integer vectors get one more component, so that all are equally long, M; for a query (with zero
there) |q - x|^2 = |q|^2 + M^2 - 2 q.x, and the highest inner products are the nearest points.
Each vector is keyed by its nearest pivot and its distance to it, and the keys are dealt by
ranges: a part holds consecutive annuli around few pivots. Of every annulus the least and greatest
distances to all pivots are known, and the triangle inequality holds for each of them, so that
the tightest counts. A query first searches its own part, which gives it a k-th score to beat;
then it visits those other parts, and there those annuli, that no pivot rules out. Annuli are
taken by falling bound until none can improve a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

#: Pivots, least and most; between them four times the fourth root of the vectors.
PIVOTS = (64, 512)
#: Vectors that pivots are picked among. All vectors are indexed.
SAMPLE = 4_096
#: Vectors of a part, about: what a task holds while queries stream past it.
PART = 65_536
_ANNULUS = 128
_QUERIES = 512
_EXACT = 1 << 53
_LONG = (1 << 63) - 1

HITS = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and q, floor(scale * x) of each component as double, for the valid vectors.

    Vectors that are null or hold a null, NaN or infinite component are left out.
    """
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = own.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(~F.coalesce(bad, F.lit(True)))
    return own.select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("q"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Equally long lists as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers held as doubles, exactly: doubles where every sum stays
    below 2^53, else Python's integers, cut to the range of a long."""
    if not a.size or not b.size or float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < _EXACT:
        return (a @ b.T).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])
    return np.clip(exact(a).dot(exact(b).T), -_LONG - 1, _LONG).astype(np.int64)


def pick_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first: each next pivot is the point of the sample farthest from those so far."""
    picked = [sample[0]]
    gap = np.linalg.norm(sample - picked[0], axis=1)
    while len(picked) < min(n, len(sample)) and gap.max() > 0:
        picked.append(sample[int(gap.argmax())])
        gap = np.minimum(gap, np.linalg.norm(sample - picked[-1], axis=1))
    return np.array(picked)


class Boxes:
    """Least and greatest distances of groups of vectors to every pivot."""

    def __init__(self, pivots: np.ndarray, longest2: float, low: np.ndarray, high: np.ndarray):
        self.pivots, self.longest2, self.low, self.high = pivots, longest2, low, high

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The highest score that each query can have in each group, a little widened against
        rounding."""
        q2 = (q * q).sum(axis=1)
        to = distances(np.concatenate([q, np.zeros((len(q), 1))], axis=1), self.pivots)
        gap = np.zeros((len(q), len(self.low)))
        for p in range(len(self.pivots)):
            np.maximum(gap, self.low[None, :, p] - to[:, p, None], out=gap)
            np.maximum(gap, to[:, p, None] - self.high[None, :, p], out=gap)
        # Squared distances come from differences of squares, whose rounding grows with those.
        gap = np.maximum(0, gap - 2e-7 * (1 + np.sqrt(self.longest2 + q2.max(initial=0))))
        return (q2[:, None] + self.longest2 - gap * gap) / 2 * (1 + 1e-9) + 1 + 1e-9 * self.longest2


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * x @ pivots.T))


def lifted(x: np.ndarray, longest2: float) -> np.ndarray:
    """With one more component, which makes all vectors equally long."""
    return np.concatenate([x, np.sqrt(np.maximum(0, longest2 - (x * x).sum(axis=1)))[:, None]], axis=1)


class _Part:
    """The vectors of one part, in annuli, and the search among them. ``scored`` counts the
    products that were computed."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, pivot: np.ndarray, dist: np.ndarray, pivots: np.ndarray, longest2: float):
        order = np.lexsort((ids, dist, pivot))
        self.ids, self.points, pivot = ids[order], points[order], pivot[order]
        cuts = np.flatnonzero(np.diff(pivot)) + 1
        self.annuli = [(at, min(hi, at + _ANNULUS)) for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(pivot)], strict=True) for at in range(lo, hi, _ANNULUS)]
        to = [distances(lifted(self.points[a:b], longest2), pivots) for a, b in self.annuli]
        self.boxes = Boxes(pivots, longest2, np.array([d.min(axis=0) for d in to]), np.array([d.max(axis=0) for d in to]))
        self.scored = 0

    def search(self, qid: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hits (query, vector, score): of each query the k best here that reach its floor."""
        n = len(qid)
        bounds = self.boxes.bounds(q)
        best_s = np.full((n, k), np.iinfo(np.int64).min)
        best_v = np.full((n, k), np.iinfo(np.int64).max)
        kth = floor.astype(np.float64)
        for j in np.argsort(-bounds.max(axis=0)):
            own = np.flatnonzero(bounds[:, j] >= kth)
            if not len(own):
                continue
            lo, hi = self.annuli[j]
            scores = products(q[own], self.points[lo:hi])
            self.scored += scores.size
            some = (scores >= kth[own][:, None]).any(axis=1)
            own, scores = own[some], scores[some]
            if not len(own):
                continue
            ids = np.broadcast_to(self.ids[lo:hi], scores.shape)
            self_hit = ids == qid[own][:, None]
            s = np.concatenate([best_s[own], np.where(self_hit, np.iinfo(np.int64).min, scores)], axis=1)
            v = np.concatenate([best_v[own], np.where(self_hit, np.iinfo(np.int64).max, ids)], axis=1)
            order = np.lexsort((v, -s.clip(-_LONG)), axis=1)[:, :k]
            best_s[own], best_v[own] = np.take_along_axis(s, order, 1), np.take_along_axis(v, order, 1)
            kth[own] = np.maximum(kth[own], best_s[own][:, -1])
        hit = (best_v != np.iinfo(np.int64).max) & (best_s >= floor[:, None])
        rows, cols = np.nonzero(hit)
        return qid[rows], best_v[rows, cols], best_s[rows, cols]


def _search(rows: DataFrame, pivots: np.ndarray, longest2: float, k: int) -> DataFrame:
    """Rows: part, query (null for a vector at home there), vec_id, pivot, dist, floor, q."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, home, index = None, [], None
        for batch in batches:
            part, is_query, vec_id = batch.column("part").to_numpy(), batch.column("is_query").to_numpy(zero_copy_only=False), batch.column("vec_id").to_numpy()
            points, pivot, dist, floor = _matrix(batch.column("q")), batch.column("pivot").to_numpy(), batch.column("dist").to_numpy(), batch.column("floor").to_numpy()
            cuts = (np.flatnonzero((np.diff(part) != 0) | (np.diff(is_query.astype(np.int8)) != 0)) + 1).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, len(part)], strict=True):
                if hi <= lo:
                    continue
                if part[lo] != at:
                    at, home, index = part[lo], [], None
                if not is_query[lo]:
                    home.append((vec_id[lo:hi], points[lo:hi], pivot[lo:hi], dist[lo:hi]))
                    continue
                if index is None and home:
                    index = _Part(*(np.concatenate(x) for x in zip(*home, strict=True)), pivots, longest2)
                    home = []
                if index is None:
                    continue
                for a in range(lo, hi, _QUERIES):
                    b = min(hi, a + _QUERIES)
                    hits = index.search(vec_id[a:b], points[a:b], floor[a:b], k)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in hits], names=["query_id", "vec_id", "score"])

    dealt = rows.select("part", "is_query", "vec_id", "pivot", "dist", "floor", "q").repartition("part").sortWithinPartitions("part", "is_query", "pivot", "dist")
    return dealt.mapInArrow(run, HITS)


def _best(hits: DataFrame, k: int) -> DataFrame:
    """Of each query the k best hits. A query has k a part at most, so its group is bounded."""
    ranked = hits.select("query_id", F.row_number().over(_by_score()).alias("rank"), "vec_id", "score")
    return ranked.where(F.col("rank") <= k)


def _by_score():
    from pyspark.sql import Window

    return Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")


def top_k(vectors: DataFrame, *, k: int = 10, scale: int = 1024, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int | None = None, part: int = PART) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query the k highest inner products.

    Components become floor(scale * x). Queries are the vectors whose id is divisible by
    ``every``; candidates are all other rows as long as the query, as there is no product of
    vectors of different lengths; ties go to the smaller vec_id. A query with fewer candidates has
    them all. Left out on both sides: null ids and vectors, empty vectors, and vectors with a null
    or non-finite component. Rows with the query's id are no candidates, repeated ids otherwise
    count once a row; a query id that is repeated asks once, with its least vector. Empty and
    one-row tables give no rows; other columns are left unread. Pivots are picked among 4,096
    sampled vectors; every vector is indexed, and the result is exact.
    """
    spark = vectors.sparkSession
    ints = quantised(vectors, scale, id_col, vec_col)
    m2 = F.max(F.aggregate("q", F.lit(0.0), lambda a, x: a + x * x))
    sizes = ints.groupBy(F.size("q").alias("dims")).agg(F.count("*").alias("n"), m2.alias("m2"), F.count_if(F.col("vec_id") % every == 0).alias("asking")).where("dims > 0 AND n > 1 AND asking > 0").orderBy("dims").collect()
    hits = spark.createDataFrame([], HITS)
    for size in sizes:
        hits = hits.unionByName(_hits(ints.where(F.size("q") == size["dims"]), size["n"], float(size["m2"]), k, every, pivots, part))
    return _best(_best(hits, k).select("query_id", "vec_id", "score") if len(sizes) > 1 else hits, k)


def _hits(ints: DataFrame, n: int, longest2: float, k: int, every: int, pivots: int | None, part: int) -> DataFrame:
    """Hits of vectors of one length that hold every query's k best."""
    spark = ints.sparkSession
    sample = _matrix(ints.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).select("q").toArrow().column("q").combine_chunks())
    chosen = pick_pivots(lifted(sample, longest2), pivots or max(PIVOTS[0], min(PIVOTS[1], int(4 * n**0.25))))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d = distances(lifted(_matrix(batch.column(1)), longest2), chosen)
            near = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], names=["vec_id", "q", "pivot", "dist"])

    parts = max(1, min(65_536, -(-n // part)), min(n // 1024, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    keyed = ints.select("vec_id", "q").mapInArrow(key, "vec_id long, q array<double>, pivot int, dist double")
    keyed = materialise(keyed.repartitionByRange(parts, "pivot", "dist", "vec_id").withColumn("part", F.spark_partition_id()))

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The box of each run of a part around one pivot."""
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            d = distances(lifted(_matrix(batch.column(2)), longest2), chosen)
            keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
            for own in np.unique(keys, axis=0):
                rows, at = (keys == own).all(axis=1), tuple(own.tolist())
                low, high = d[rows].min(axis=0), d[rows].max(axis=0)
                held[at] = (np.minimum(held[at][0], low), np.maximum(held[at][1], high)) if at in held else (low, high)
        if held:
            yield pa.RecordBatch.from_pydict({"part": pa.array([a for a, _ in held], pa.int32()), "low": [v[0] for v in held.values()], "high": [v[1] for v in held.values()]})

    # A part covers a run of the sorted keys: at most parts + pivots rows, and some more where a file is split.
    covers = keyed.select("part", "pivot", "q").mapInArrow(cover, "part int, low array<double>, high array<double>").orderBy("part").collect()
    names = np.array([c["part"] for c in covers])
    boxes = Boxes(chosen, longest2, np.array([c["low"] for c in covers]), np.array([c["high"] for c in covers]))
    home = keyed.withColumn("is_query", F.lit(False)).withColumn("floor", F.lit(-_LONG))
    asking = keyed.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("q", "pivot", "dist", "part")).alias("s")).select("vec_id", "s.*")
    queries = asking.withColumn("is_query", F.lit(True)).withColumn("floor", F.lit(-_LONG))
    first = materialise(_search(home.unionByName(queries), chosen, longest2, k))
    floors = _best(first, k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor")).distinct()
    asked = queries.drop("floor").join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-_LONG)))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query once for every other part that may hold a score up to its floor."""
        for batch in batches:
            if not batch.num_rows:
                continue
            may = boxes.bounds(_matrix(batch.column("q"))) >= batch.column("floor").to_numpy()[:, None]
            for p in np.unique(names):
                rows = np.flatnonzero(may[:, names == p].any(axis=1) & (batch.column("part").to_numpy() != p))
                if len(rows):
                    out = batch.take(pa.array(rows))
                    yield out.set_column(out.schema.get_field_index("part"), "part", pa.array(np.full(len(rows), p, dtype=np.int32)))

    columns = ["vec_id", "q", "pivot", "dist", "part", "is_query", "floor"]
    asked = asked.select(columns)
    rest = _search(home.select(columns).unionByName(asked.mapInArrow(visit, asked.schema)), chosen, longest2, k)
    return first.unionByName(rest)


def op8_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest integer inner products of every vector whose id is divisible by 100."""
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
    FROM v a, v b WHERE a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id
), r AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

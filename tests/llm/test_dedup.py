"""SimHash, embedding and top-k operators against brute force."""

from __future__ import annotations

import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from cases import TEXTS, documents, empty
from hypothesis import given, settings
from hypothesis import strategies as st
from xxhash import xxh64_intdigest

from boxwood.llm import common, forest, simhash, topk
from boxwood.operators.graphs import components as connected_components


def brute_components(n, links):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in links:
        up[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in range(n)]


def test_connected_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (2000, 2001), (2000, 2001)]
    df = spark.createDataFrame([*edges, (None, 4)], "a long, b long")
    want = brute_components(2100, edges)
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {i: want[i] for i in linked}
    assert connected_components(empty(df)).count() == 0


def brute_fingerprint(text, words=3):
    found = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not found:
        return 0
    shingles = [" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or [" ".join(found)]
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="AbÀ \t\n\x0b\x1c\xa0x", max_size=40))
def test_fingerprints(text):
    assert int(simhash.fingerprint(simhash.shingle_hashes(text.encode(), 3))[0]) == brute_fingerprint(text)


def check_simhash(rows, texts):
    """rows: of the operator; texts: (id, text) of all rows."""
    fp = [brute_fingerprint(t) for _, t in texts]
    links = [(i, j) for i, j in itertools.combinations(range(len(fp)), 2) if (fp[i] ^ fp[j]).bit_count() <= 3]
    root = brute_components(len(fp), links)
    least = {}
    for i, (name, _) in enumerate(texts):
        if name is not None:
            least[root[i]] = min(least.get(root[i], name), name)
    want = sorted(((name, f"{f:016x}", least.get(r)) for (name, _), f, r in zip(texts, fp, root, strict=True)), key=repr)
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows), key=repr) == want


def test_simhash_takes_every_case(spark):
    check_simhash(simhash.near_duplicates(documents(spark)).collect(), [(i, t) for i, t, *_ in TEXTS])
    assert simhash.near_duplicates(empty(documents(spark))).count() == 0


def test_simhash_query(spark, small):
    docs = common.table(spark, small, "documents").collect()
    check_simhash(simhash.op2_simhash(spark, small).collect(), [(r["doc_id"], r["text"]) for r in docs])


@pytest.mark.parametrize("cell", [7, 1 << 15])
def test_links_of_planted_fingerprints(spark, cell):
    r = random.Random(cell)
    fps = [r.getrandbits(64) for _ in range(300)]
    for f in list(fps)[:120]:
        for _ in range(2):
            for b in r.sample(range(64), r.randint(1, 4)):
                f ^= 1 << b
            fps.append(f)
    fps += [0, 0, 1, 3]
    df = spark.createDataFrame([(i, f.to_bytes(8, "big")) for i, f in enumerate(fps)], "doc_id long, fp binary")
    got = {int.from_bytes(r["fp"], "big"): r["low"] for r in simhash.link_fingerprints(df, cell=cell).collect()}
    root = brute_components(len(fps), [(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 3])
    assert [got[f] for f in fps] == root


def test_vantage_trees_reach_all_within_the_radius():
    rng = np.random.default_rng(0)
    points = rng.integers(0, 1 << 63, (2_000, 1), dtype=np.uint64)
    tree = simhash.VantageTree(points, leaf=20)
    queries = points[:200] ^ (np.uint64(1) << rng.integers(0, 64, (200, 1), dtype=np.uint64))
    found = defaultdict(set)
    for leaf, own in tree.reach(queries, 3):
        for q in own:
            found[q].update(tree.leaves[leaf].tolist())
    assert all(q in found[q] for q in range(200))
    assert sorted(itertools.chain.from_iterable(x.tolist() for x in tree.leaves)) == list(range(2_000))


def corpus(r, n):
    return [" ".join(r.choice(["alpha", "beta", "gamma", "delta"]) + str(r.randrange(400)) for _ in range(120)) for _ in range(n)]


def test_keep_one_drops_copies_and_no_others(spark):
    r = random.Random(1)
    texts = corpus(r, 60)
    rows = list(enumerate(texts))
    for i in range(20):
        words = texts[i].split()
        words[60] = "changed"  # Jaccard 111 / 121 in five-word shingles
        rows += [(100 + i, " ".join(words)), (200 + i, texts[i].upper()), (300 + i, texts[i])]
    half = [(400 + i, " ".join(texts[i].split()[:60] + corpus(r, 1)[0].split()[:60])) for i in range(20)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows + half], "doc_id long, text string, extra string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(x["doc_id"] for x in kept.collect()) == [*range(60), *range(400, 420)]


def test_keep_one_takes_every_case(spark):
    docs = documents(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=lambda x: (x is None, x or 0))
    # The empty, null and blank texts are one group (2, 3, 6); 1 and the two 5 another.
    assert ids == [-9, 1, 2, 4, 7, 8, None]
    assert simhash.keep_one(empty(docs)).count() == 0


def brute_kept(texts, similarity=0.8):
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    links = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= similarity]
    return sorted(set(brute_components(len(texts), links)))


@pytest.mark.parametrize("cell", [simhash.SETS, 300])
def test_keep_one_decides_at_the_similarity_exactly(spark, cell):
    """Pairs of 4/5, 5/6 and 6/7 shingles are linked; of 100 shingles, those from 0.8 on and no others."""
    r, texts = random.Random(7), []
    for _ in range(30):
        for n in (9, 10, 11):
            words = corpus(r, 1)[0].split()[:n]
            texts += [" ".join(words), " ".join(words[:-1])]
    for _ in range(25):
        for gone in (17, 18, 19, 20, 21, 22, 23, 24, 26):  # Jaccard (100 - gone) / 100
            words = corpus(r, 1)[0].split()[:104]
            texts += [" ".join(words), " ".join(words[: 104 - gone])]
    for _ in range(3):  # chains: neighbours at 19/21, so that ends are far apart
        words = corpus(r, 1)[0].split()
        texts += [" ".join(words[at : at + 24]) for at in range(0, 40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(x["doc_id"] for x in simhash.keep_one(docs, cell=cell).collect()) == brute_kept(texts)


VECTORS = [
    (0, [1.0, 2.0]), (100, [-1.0, 0.5]), (200, None), (300, [1.0, None]), (1, [float("nan"), 1.0]), (2, [float("inf"), 1.0]), (3, [0.0, 0.0]), (4, [1.0, 2.0]),
    (5, [1.0, 2.0]), (None, [1.0, 2.0]), (400, [0.0, 0.0]), (6, [-3.0, 0.25]), (7, [1.0, 2.0001]), (0, [1.0, 2.0]), (8, []),
]


def vectors(spark, rows, kind="double"):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    return df.withColumn("label", F.lit(1)).withColumn("part", F.lit("x")).withColumn("node", F.lit(None).cast("long"))


def brute_top(rows, k, every, scale=1024.0):
    ok = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in ok if i % every == 0}:
        best = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok if i != q))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def top_rows(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def test_top_k_takes_every_case(spark):
    assert top_rows(topk.top_k(vectors(spark, VECTORS), k=3)) == brute_top(VECTORS, 3, 100)
    assert topk.top_k(empty(vectors(spark, VECTORS))).count() == 0
    assert topk.top_k(vectors(spark, [(0, [1.0])])).count() == 0


@pytest.mark.parametrize(("part", "scale"), [(64, 1.0), (1 << 14, 50.0)])
def test_top_k_is_exact(spark, part, scale):
    rng = np.random.default_rng(part)
    rows = [(i, (rng.normal(size=6) * scale * (3 if i % 7 else 0.1)).tolist()) for i in range(900)]
    rows += [(900 + i, rows[5][1]) for i in range(40)]  # ties
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        assert top_rows(topk.top_k(vectors(spark, rows), every=20, part=part)) == brute_top(rows, 10, 20)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_top_k_of_two_lengths(spark):
    """A vector's candidates are those of its own length; one odd row drops nobody."""
    rng = np.random.default_rng(8)
    short, long = [(i, rng.normal(size=3).tolist()) for i in range(5, 300)], [(i, rng.normal(size=5).tolist()) for i in range(300, 420)] + [(0, [1.0] * 5)]
    assert top_rows(topk.top_k(vectors(spark, short + long))) == sorted(brute_top(short, 10, 100) + brute_top(long, 10, 100))


def test_annuli_are_ruled_out_in_clusters():
    """Of clustered vectors a query scores less than half, and finds the best of all."""
    rng = np.random.default_rng(9)
    centers = rng.normal(size=(50, 32)) * 1024
    x = np.floor(centers[rng.integers(0, 50, 20_000)] + rng.normal(size=(20_000, 32)) * 200)
    longest2 = float((x * x).sum(axis=1).max())
    pivots = topk.pick_pivots(topk.lifted(x[:4_096], longest2), 64)
    d = topk.distances(topk.lifted(x, longest2), pivots)
    ids = np.arange(len(x))
    part = topk._Part(ids, x, d.argmin(axis=1), d.min(axis=1), pivots, longest2)
    q = ids[:200]
    got = part.search(q, x[q], np.full(200, -(2**62)), 10)
    best = np.sort(np.where(ids[None, :] == q[:, None], -np.inf, x[q] @ x.T), axis=1)[:, ::-1][:, :10]
    assert sorted(zip(got[0].tolist(), got[2].tolist(), strict=True)) == sorted((int(i), int(s)) for i, row in zip(q, best, strict=True) for s in row)
    assert part.scored < 0.5 * 200 * len(x)


def test_top_k_beyond_doubles(spark):
    rows = [(i, [float(2**30 + i), float(3 * i)]) for i in range(30)]
    assert top_rows(topk.top_k(vectors(spark, rows), k=4, scale=1)) == brute_top(rows, 4, 100, 1.0)
    # Beyond a long, scores are cut to its range and tie.
    rows = [(i, [float(2**40 + i), float(3 * i)]) for i in range(30)]
    assert top_rows(topk.top_k(vectors(spark, rows), k=2, scale=1024)) == [(0, 1, 1, 2**63 - 1), (0, 2, 2, 2**63 - 1)]


def test_top_k_query(spark, small, duck):
    from compare import duck_rows, spark_rows

    assert spark_rows(topk.op8_pivot_topk(spark, small)) == duck_rows(duck, topk.ORACLE_SQL)


def brute_links(rows, threshold):
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = np.array([rows[i][1] for i in ok], dtype=float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= threshold
    return [(ok[a], ok[b]) for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True)]


def test_forest_takes_every_case(spark):
    rows = [r for r in VECTORS if r[1] != []] + [(8, [])]
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in forest.link_vectors(vectors(spark, rows)).collect()), key=repr)
    links = brute_links(rows, 0.95)
    root = brute_components(len(rows), links)
    low = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            low[root[i]] = min(low.get(root[i], name), name)
    want = [(name, sum(i in p for p in links), low.get(root[i]), name is not None and name == low.get(root[i])) for i, (name, _) in enumerate(rows)]
    assert got == sorted(want, key=repr)
    assert forest.link_vectors(empty(vectors(spark, rows))).count() == 0


@pytest.mark.parametrize(("cell", "leaf"), [(4_096, 1_024), (50, 60)])
def test_forest_recall(spark, cell, leaf):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(120, 32))
    x = np.concatenate([centers, centers[rng.integers(0, 120, 900)] + rng.normal(scale=0.16, size=(900, 32)), np.repeat(centers[:1], 150, axis=0) + rng.normal(scale=0.02, size=(150, 32))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {r["vec_id"]: r for r in forest.link_vectors(vectors(spark, rows), cell=cell, leaf=leaf).collect()}
    links = brute_links(rows, 0.95)
    counts = np.bincount(np.array(links).ravel(), minlength=len(rows))
    found = np.array([got[i]["n_links"] for i in range(len(rows))])
    assert (found <= counts).all() and found.sum() >= 0.9 * counts.sum()
    root = brute_components(len(rows), links)
    assert np.mean([got[i]["component_id"] == root[i] for i in range(len(rows))]) >= 0.9
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_forest_beyond_its_sample(spark, monkeypatch):
    """Leaves stay small and planted pairs are found where vectors are twelve times the sample."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(5_000, 24))
    x = np.concatenate([base, base[:1_000] + rng.normal(scale=0.28, size=(1_000, 24)), base[:1] + rng.normal(scale=0.01, size=(300, 24))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    monkeypatch.setattr(forest, "SAMPLE", 512)
    monkeypatch.setattr(forest, "OWN", 256)
    got = {r["vec_id"]: r["n_links"] for r in forest.link_vectors(vectors(spark, rows), leaf=64, cell=128).collect()}
    counts = np.bincount(np.array(brute_links(rows, 0.95)).ravel(), minlength=len(rows))
    found = np.array([got[i] for i in range(len(rows))])
    apart = np.r_[1:5_000]
    assert counts[apart].sum() > 300 and (found <= counts).all()
    assert found[apart].sum() >= 0.9 * counts[apart].sum() and found.sum() >= 0.9 * counts.sum()
    units = x / np.linalg.norm(x, axis=1, keepdims=True)
    reps = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(units)], "node long, v array<double>")
    grown = forest.plant(reps, len(x), 64, 6, 0.01)
    sizes = np.bincount(grown.reach(units[:5_000])[1])
    assert sizes.max() <= 2 * 64 and len(grown.leaf) > 6 * 60


def test_forest_query(spark, small, tmp_path):
    """The registered query, over the table with near copies planted among its rows."""
    rng = np.random.default_rng(7)
    rows = [(r["vec_id"], list(map(float, r["embedding"]))) for r in common.table(spark, small, "embeddings").collect()]
    size = len(rows[0][1])
    rows += [(10_000 + i, (np.array(rows[i % 40][1]) + rng.normal(scale=0.2 / size**0.5, size=size)).tolist()) for i in range(200)]
    vectors(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    small = str(tmp_path)
    assert len(brute_links(rows, 0.95)) > 200
    counts = np.bincount(np.array(brute_links(rows, 0.95) or [(0, 0)][:0], dtype=int).ravel(), minlength=len(rows))
    got = {r["vec_id"]: r["n_links"] for r in forest.op10_projection_forest(spark, small).collect()}
    assert len(got) == len(rows)
    found = np.array([got[i] for i, _ in rows])
    assert (found <= counts).all() and found.sum() >= 0.9 * counts.sum()

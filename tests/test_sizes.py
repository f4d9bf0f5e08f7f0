"""Queries on odd rows and on tables made larger, against SQL and direct computations."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from compare import duck_rows, spark_rows


def _both(spark, name: str, folder, tables: dict) -> None:
    """The query and its SQL give the same rows over these tables."""
    from boxwood import registry

    registry.load()
    con = duckdb.connect()
    for t, df in tables.items():
        df.write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    assert spark_rows(registry.QUERIES[name](spark, str(folder))) == duck_rows(con, registry.ORACLES[name])


def test_extended_exclusion_of_odd_texts(spark, tmp_path):
    """Empty and null texts, letters without a single capital, other white space."""
    texts = ["", None, " ", "\x0b", "123", "ß", "ẞ", "ﬁ", "12 ŉ", "ΐ", "ᾼ 7", "ABC ﬀ DEF", "ABC ﬀ dEF", "a b", " ", "É", "ꟍ", "中文", "i", "İ", "ı", "ǅ", "auto generated ﬁ"]
    rows = [(100 * k + i, t, "en", s, len(t or "")) for k, s in enumerate(("src1", "src8", "src9", "src10", None)) for i, t in enumerate(texts)]
    _both(spark, "extended_exclusion", tmp_path, {"documents": spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")})


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_sketch_is_held_by_type_not_by_user(spark, small):
    from boxwood.plans import joins

    lines = _plan(joins.approximate_distinct(spark, small)).splitlines()
    assert any("approx_count_distinct" in x for x in lines)
    assert not any("user_id" in x.split("functions=")[0] for x in lines if "approx_count_distinct" in x)


def test_dealing_at_any_size(spark, monkeypatch):
    from boxwood import partitions

    rows = spark.range(0, 500, 1, 1).select("id", F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    monkeypatch.setattr(partitions, "SMALL_SHARE", 0)
    monkeypatch.setattr(partitions, "TASK_SHARE", 64)
    dealt = partitions.deal(rows)
    cores = spark.sparkContext.defaultParallelism
    assert dealt.rdd.getNumPartitions() >= 2 * cores
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, rows.collect()))


def test_work_on_documents_is_dealt_out(spark, small):
    from boxwood.plans import changes, focus, trees

    for f in (changes.candidate_universe, changes.token_diffs, changes.tree_similarity, changes.edit_excerpts, focus.selection_context, trees.tree_depths, trees.json_boxes):
        plan = _plan(f(spark, small))
        assert "REPARTITION_BY_NUM" in plan.split("MapInArrow")[-1], f.__name__


def test_rows_are_handed_on_in_slices(spark, small, monkeypatch):
    from boxwood.plans import changes

    whole = spark_rows(changes.diff_stats(spark, small))
    monkeypatch.setattr(changes, "SLICE", 50)
    assert spark_rows(changes.diff_stats(spark, small)) == whole


def test_measures_are_those_of_the_nodes(spark, small):
    from boxwood.operators import trees
    from boxwood.plans import trees as plans
    from boxwood.registry import table

    nodes = trees.node_table(table(spark, small, "documents"), "doc_id", "text")
    direct = nodes.groupBy("doc_id").agg(F.count_if("leaf").alias("leaves"), F.max("depth").alias("depth"), F.count_if("semantic").alias("real"))
    found = plans.tree_depths(spark, small)
    assert found.dtypes == direct.dtypes and spark_rows(found) == spark_rows(direct)


def test_embeddings_are_never_written(spark):
    from boxwood.operators import subgraphs
    from boxwood.storage import own_dir

    def names() -> dict[str, list[str]]:
        import os

        top = own_dir(spark).removeprefix("file:")
        return {d: spark.read.parquet(f"{top}/{d}").columns for d in (os.listdir(top) if os.path.isdir(top) else ())}

    before = names()
    v = spark.createDataFrame([(g, i, f"l{i % 3}") for g in range(4) for i in range(5)], "graph int, id int, label string")
    e = spark.createDataFrame([(g, i, i + 1, "to") for g in range(4) for i in range(4)], "graph int, src int, dst int, label string")
    patterns, pairs = subgraphs.frequent_subgraphs(v, e, 4, most_edges=4, most_vertices=5)
    assert {r["support"] for r in patterns.collect()} == {4} and pairs.count()
    new = {tuple(c) for d, c in names().items() if d not in before}
    assert new and not any({"eids", "es", "verts"} & set(c) for c in new)


def test_bundles_of_orders_in_as_many_tasks_as_lines_ask_for(spark, small, duck, monkeypatch):
    from boxwood import registry
    from boxwood.plans import evidence

    monkeypatch.setattr(evidence, "LINES", 500)
    found = evidence.drill_bundle(spark, small)
    assert "12), REPARTITION_BY_NUM" in _plan(found)  # some 6,000 lines
    assert spark_rows(found) == duck_rows(duck, registry.ORACLES["drill_bundle"])


def test_words_of_one_text_are_held_at_a_time():
    import tracemalloc

    import pyarrow as pa

    from boxwood.plans import files

    texts = [" ".join(f"w{i}x{k}" for k in range(500)) for i in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(400)]), pa.array(texts)], names=["hash", "text"])
    tracemalloc.start()
    (out,) = files.summarise(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.column(1)[3].as_py() == "500 words, 500 distinct, from w3x0 to w3x499" and peak < 2_000_000


def test_no_table_of_samples_is_broadcast(spark, monkeypatch):
    """Whatever the size that the planner sees, rules join samples without a broadcast."""
    from itertools import combinations

    from boxwood.operators import rules

    rows = {i: {f"a{k}" for k in range(6) if (i >> k) % 2} for i in range(64)}
    features = spark.createDataFrame([(i, a) for i, own in rows.items() for a in own], "sample long, atom string")
    truth = spark.createDataFrame([(i, i % 3 == 0) for i in rows], "sample long, positive boolean")
    plans, write = [], rules.materialise
    monkeypatch.setattr(rules, "materialise", lambda df: (plans.append(_plan(df)), write(df))[1])
    atoms = rules.rank_atoms(features, truth, 5)
    found = rules.clauses(features, truth, atoms, precision=0.0)
    got = {tuple(r["clause"]): (r["tp"], r["fp"]) for r in found.collect()}
    names = sorted(r["atom"] for r in atoms.collect())
    want = {}
    for n in (1, 2, 3):
        for c in combinations(names, n):
            held = [i for i, own in rows.items() if set(c) <= own]
            tp = sum(i % 3 == 0 for i in held)
            if tp >= 2:
                want[c] = (tp, len(held) - tp)
    assert got == want
    assert rules.greedy(found, features, truth)
    plans.append(_plan(atoms))
    assert not any("BroadcastExchange" in x and "bigint" in x for p in plans for x in p.splitlines())


def test_rows_of_unknown_size_are_dealt_too(spark):
    from boxwood import partitions

    rows = spark.createDataFrame(spark.sparkContext.parallelize([(1, "a"), (2, "b")]), "id int, text string")
    assert sorted(map(tuple, partitions.deal(rows).collect())) == [(1, "a"), (2, "b")]

"""Sources, sinks, provider cache, and streams."""

from __future__ import annotations

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxwood import shipping, storage
from boxwood.operators import annotate
from boxwood.sources import files
from boxwood.streaming import windows


@pytest.fixture
def folder(tmp_path):
    for name, body in {"a.py": "x = 1\ny = 2\n", "lib/b.js": "let z;", "node_modules/c.js": "no", "notes.bin": "no", "big.py": "#" * 2000, "yarn.lock": "no"}.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(body)
    return tmp_path


def test_source_files(spark, folder):
    got = {r["rel_path"]: r for r in files.source_files(spark, str(folder), largest=1000).collect()}
    assert set(got) == {"a.py", "lib/b.js"} and got["a.py"]["line_count"] == 3 and got["lib/b.js"]["language"] == "javascript"
    assert {r["rel_path"] for r in files.source_files(spark, str(folder), total=1000).collect()} == {"a.py"}  # big.py would exceed it: nothing after


def test_root_excludes(spark, folder):
    got = files.source_files(spark, str(folder), root_dirs=("lib",), root_files=("big.py",))
    assert {r["rel_path"] for r in got.collect()} == {"a.py"}


def test_uploads(spark):
    held = [{"relPath": "a.py", "content": "x"}, {"relPath": "dist/b.py", "content": "x"}, {"relPath": "c.xyz", "content": "x"}, {"relPath": "d.py", "content": "y" * 50}]
    assert {r["rel_path"] for r in files.upload(spark, held).collect()} == {"a.py", "d.py"}
    assert {r["rel_path"] for r in files.upload(spark, held, total=20).collect()} == {"a.py"} and files.upload(spark, held, most=1).count() == 1
    assert files.sample_source(spark).count() == 1 and {k: v.count() for k, v in files.sample_shop(spark).items()} == {"customers": 3, "orders": 4}


def test_git_tracked(spark, tmp_path):
    import subprocess

    assert files.git_tracked(str(tmp_path)) is None
    (tmp_path / "sub").mkdir()
    for name in ("a.py", "sub/b.py", "sub/c.py"):
        (tmp_path / name).write_text("x = 1")
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    subprocess.run(["git", "-C", str(tmp_path), "add", "a.py", "sub/b.py"], check=True)
    assert files.git_tracked(str(tmp_path)) == ["a.py", "sub/b.py"] and files.git_tracked(str(tmp_path / "sub")) == ["b.py"]
    assert {r["rel_path"] for r in files.source_files(spark, str(tmp_path), tracked=True).collect()} == {"a.py", "sub/b.py"}
    assert {r["rel_path"] for r in files.source_files(spark, str(tmp_path / "sub"), tracked=True).collect()} == {"b.py"}


def test_containment(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "out").mkdir()
    (tmp_path / "in/link").symlink_to(tmp_path / "out")
    assert files.contained(str(tmp_path / "in"), "a/../b.py") and files.contained(str(tmp_path / "in"), ".")
    assert not files.contained(str(tmp_path / "in"), "../out/x") and not files.contained(str(tmp_path / "in"), "link/x") and not files.contained(str(tmp_path / "in"), "/etc/passwd")


def test_sqlite_and_databases(spark, tmp_path):
    import sqlite3

    (tmp_path / "shop").mkdir()
    (tmp_path / "empty file").mkdir()
    (tmp_path / "lake/tables").mkdir(parents=True)
    db = sqlite3.connect(tmp_path / "shop/shop.sqlite")
    db.execute("CREATE TABLE t (a INTEGER, b REAL, c TEXT, d BLOB)")
    db.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [(i, i / 2, f"x{i}", b"z") for i in range(100)] + [(None, None, None, None), ("odd", 1, 7, "s")])
    db.execute("CREATE TABLE none (a INTEGER)")
    db.commit()
    db.close()
    got = files.sqlite_table(spark, str(tmp_path / "shop/shop.sqlite"), "t", 3)
    assert got.count() == 102 and got.agg(F.sum("a"), F.max("b"), F.count("c")).first()[:3] == (4950, 49.5, 101) and bytes(got.where("c = '7'").first()["d"]) == b"s"
    assert files.sqlite_table(spark, str(tmp_path / "shop/shop.sqlite"), "none").count() == 0
    with pytest.raises(ValueError):
        files.sqlite_table(spark, str(tmp_path / "shop/shop.sqlite"), "nope")
    assert list(files.databases(spark, str(tmp_path))) == ["lake", "shop"]
    assert files.locate(spark, str(tmp_path), "shop").endswith("shop.sqlite") and files.locate(spark, str(tmp_path), "../x") is None and files.locate(spark, str(tmp_path), "nope") is None


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{"a": \n\n{"a": 2}\n')
    schema = T.StructType([T.StructField("a", T.LongType())])
    rows, counts = files.json_lines(spark, str(tmp_path / "x.jsonl"), schema)
    assert sorted(r["a"] for r in rows.collect()) == [1, 2] and {r["status"]: r["n"] for r in counts.collect()} == {"ok": 2, "invalid_json": 1}
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        files.json_lines(spark, str(tmp_path / "x.jsonl"), schema, strict=True)[0].collect()


def test_examples(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text(json.dumps({"question_id": "q", "db_id": "d", "question": "?", "SQL": "SELECT 1"}) + "\n" + json.dumps({"db_id": "d", "question": "?", "sql": "SELECT 2"}) + "\n")
    got = files.examples(spark, str(tmp_path / "e.jsonl")).orderBy("gold_sql").collect()
    assert [(r["example_id"], r["gold_sql"]) for r in got] == [("q", "SELECT 1"), ("d:1", "SELECT 2")]
    (tmp_path / "e.json").write_text(json.dumps([{"id": 7, "db_id": "d", "evidence": {"a": 1}, "query": "SELECT 3"}]))
    got = files.examples(spark, str(tmp_path / "e.json"), multi_line=True).first()
    assert (got["example_id"], got["evidence"], got["gold_sql"]) == ("7", '{"a":1}', "SELECT 3")


def test_graph_text_round_trip(spark):
    v = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "b")], "graph long, id long, label string")
    e = spark.createDataFrame([(1, 0, 1, "e")], "graph long, src long, dst long, label string")
    text = "\n".join(r["text"] for r in files.write_graphs(v, e).orderBy("graph").collect()) + "\nt # -1\n"
    assert files.read_graphs(text) == [(1, [(0, 2), (1, 3)], [(0, 1, 4)]), (2, [(0, 3)], [])]


def test_sealed_runs(spark, tmp_path):
    run = files.SealedRun(spark, tmp_path / "run")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string").coalesce(1)
    run.write("a", rows)
    with pytest.raises(Exception, match="(?i)exists"):
        run.write("a", rows)
    assert [(r["rows"], r["bytes"] > 0) for r in run.seal().collect()] == [(2, True)]
    with pytest.raises(RuntimeError):
        run.write("b", rows)
    assert {r["status"] for r in run.verify().collect()} == {"verified"}
    name = next((tmp_path / "run/data/a").glob("*.json"))
    next((tmp_path / "run/data/a").glob(".*.json.crc")).unlink()
    name.write_text("changed")
    (tmp_path / "run/data/z.json").write_text("{}\n")
    assert {r["status"] for r in run.verify().collect()} == {"hash_mismatch", "unindexed"}


def test_append_changed_and_compact(spark, tmp_path):
    path, make = str(tmp_path / "log"), lambda rows: spark.createDataFrame(rows, "k string, v string, n int")
    assert files.append_changed(make([("a", "1", 1), ("b", "1", 1)]), path, "k", "v", "n") == 2
    assert files.append_changed(make([("a", "1", 2), ("b", "2", 2), ("c", None, 2)]), path, "k", "v", "n") == 2
    assert files.append_changed(make([("b", "1", 3), ("c", None, 3)]), path, "k", "v", "n") == 1
    files.compact(spark, path, spark.createDataFrame([("b",)], "k string"), "k")
    assert sorted(r["k"] for r in spark.read.parquet(path).collect()) == ["a", "c"] and not (tmp_path / "log.old").exists() and not (tmp_path / "log.new").exists()


def test_reviews_keep_when_they_began(spark, tmp_path):
    path, make = str(tmp_path / "reviews"), lambda rows: spark.createDataFrame(rows, "who string, what int, said string, at int")
    files.upsert_reviews(make([("b", 1, "x", 5), ("a", 2, "y", 6)]), path, ["who", "what"], "at")
    got = files.upsert_reviews(make([("b", 1, "z", 9), ("c", 1, "w", 9)]), path, ["who", "what"], "at").collect()
    assert sorted((r["who"], r["said"], r["created_at"], r["updated_at"]) for r in got) == [("a", "y", 6, 6), ("b", "z", 5, 9), ("c", "w", 9, 9)]


def test_texts_are_parsed_once(spark, tmp_path):
    path = str(tmp_path / "trees")
    docs = spark.createDataFrame([(1, "a\n  b"), (2, "a\n  b"), (3, None)], "id int, t string")
    first = files.parsed_once(docs, path, "t")
    assert first.select("text_hash").distinct().count() == 1 and first.count() == 3
    parts = len(list((tmp_path / "trees").glob("*.parquet")))
    assert files.parsed_once(docs, path, "t").count() == 3 and len(list((tmp_path / "trees").glob("*.parquet"))) == parts
    assert files.parsed_once(spark.createDataFrame([(4, "new")], "id int, t string"), path, "t").select("text_hash").distinct().count() == 1


def test_offline_annotation(spark):
    def provider(batches):
        yield from ()

    rows = spark.createDataFrame([(1, "a")], "k int, t string")
    with pytest.raises(LookupError):
        annotate.annotate(rows, "k", "t", provider, offline=True)
    cache = rows.select(F.substring(F.sha1("t"), 1, 16).alias("hash"), F.lit("known").alias("out"))
    assert annotate.annotate(rows, "k", "t", provider, cache, offline=True).first()["out"] == "known"


def test_append_skips_known_keys(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    path = str(tmp_path / "t")
    assert [files.append_new(rows, path, "k"), files.append_new(rows, path, "k")] == [2, 0]
    assert files.append_new(spark.createDataFrame([(2, "x"), (3, "c")], "k int, v string"), path, "k") == 1
    assert spark.read.parquet(path).count() == 3


def test_providers_see_each_content_once(spark):
    def provider(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f"{len(t)}" for t in b.column(1).to_pylist()])], names=["hash", "out"])

    rows = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, "b"), (4, None)], "k int, t string")
    first = annotate.annotate(rows, "k", "t", provider)
    assert {r["k"]: r["out"] for r in first.collect()} == {1: "2", 2: "2", 3: "1"}
    cache = first.select("hash", F.lit("known").alias("out")).distinct()
    assert {r["out"] for r in annotate.annotate(rows, "k", "t", provider, cache).collect()} == {"known"}


def test_prompts():
    p = annotate.answer_prompt(" q ", [("a", "x" * 10), ("b", "y" * 10), ("c", "z")], [("user", str(i)) for i in range(6)], most=15)
    assert "Question: q" in p and "[b]\nyyyyy\n..." in p and "[c]" not in p and "user: 1" not in p
    assert annotate.classify_intent("tell me more") == "deepen" and annotate.classify_intent("what is this") == "new"
    with pytest.raises(ValueError):
        annotate.checked_answers(["a"], {"b": 1})


def test_more_prompts():
    p = annotate.edit_prompt("make it safe", "a.py", "x" * 50 + "BODY" + "y" * 50, 50, 54, [("note", "n" * 30)], 90)
    assert "<<<\nBODY\n>>>" in p and p.startswith("Question: make it safe")
    with pytest.raises(ValueError):
        annotate.edit_prompt("", "a", "abc", 2, 9, [])
    p = annotate.folder_prompt("what?", "lib", "s" * 20, [("a", "x" * 100), ("b", "y" * 100)], 60)
    assert "x" * 20 in p and "x" * 21 not in p and "y" * 20 in p
    assert annotate.asked_in_batches(list("abcde"), lambda ids: dict.fromkeys(ids, 2.0), 2) == dict.fromkeys("abcde", 1.0)
    got = annotate.extracted_claims("r", [{"text": " a  b ", "confidence": 3}, {"text": "A B"}, {"text": ""}, {"text": "c", "confidence": -1}])
    assert [(c["id"], c["text"], c["confidence"]) for c in got] == [("r:0", "a b", 1.0), ("r:1", "c", 0.0)]
    assert annotate.cluster_prompt([("a", "x  y")] * 14).endswith("(2 more)")


def test_materialise_and_ship(spark):
    df = storage.materialise(spark.range(5))
    assert df.count() == 5 and storage.shared_dir(spark) in df.inputFiles()[0]
    import os

    assert os.path.isdir(storage.own_dir(spark))
    storage.clear(spark)
    storage.clear(spark)
    assert not os.path.exists(storage.own_dir(spark))
    shipping.ship(spark)
    shipping.ship(spark)


def events(spark, rows):
    return spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))


def stream(spark, tmp_path, batches, make, mode="append"):
    """Rows that a stream gives for Parquet batches, read file by file."""
    src, name = tmp_path / "src", "out_" + tmp_path.name.replace("-", "_")
    for i, rows in enumerate(batches):
        events(spark, rows).coalesce(1).write.mode("append").parquet(str(src / f"b{i}"))
    schema = events(spark, batches[0]).schema
    for i in range(len(batches)):
        made = make(spark.readStream.schema(schema).parquet(str(src / f"b[0-{i}]")))
        q = made.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True)
        if i == len(batches) - 1 or mode == "complete":
            q.start().awaitTermination(120)
    return spark.table(name).collect()


ROWS = [(1, "2024-01-01 00:10:00", 1, "view", 1.0), (2, "2024-01-01 00:50:00", 1, "view", 2.0), (3, "2024-01-01 03:30:00", 2, "view", 4.0), (4, "2024-01-02 00:00:00", 2, "view", 8.0)]


def test_streamed_windows_equal_batch(spark, tmp_path):
    batch = {(str(r["start"]), r["n"], r["total"]) for r in windows.tumbling(events(spark, ROWS)).collect()}
    got = {(str(r["start"]), r["n"], r["total"]) for r in stream(spark, tmp_path, [ROWS], windows.tumbling, "complete")}
    assert got == batch and len(batch) == 3


def test_streamed_sessions_close_with_the_watermark(spark, tmp_path):
    got = stream(spark, tmp_path, [ROWS], lambda s: windows.sessions(s, "1 hour"))
    assert {(r["user_id"], r["n"]) for r in got} == {(1, 2), (2, 1)}  # the last session is still open


def test_ttl_sessions(spark, tmp_path):
    got = stream(spark, tmp_path, [ROWS], lambda s: windows.ttl_sessions(s, 3_600_000))
    assert (1, 2) in {(r["user_id"], r["n"]) for r in got}


def test_upsert_replays_to_the_same_table(spark, tmp_path):
    merge = windows.upsert_to(str(tmp_path / "t"), "k", "seq")
    one, two = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, seq int"), spark.createDataFrame([(1, "c", 2), (3, "d", 1)], "k int, v string, seq int")
    merge(one, 0)
    merge(two, 1)
    merge(two, 1)
    assert {r["k"]: r["v"] for r in spark.read.parquet(str(tmp_path / "t/epoch=1")).collect()} == {1: "c", 2: "b", 3: "d"}


def test_rolling_limit(spark):
    rows = [(i, f"2024-01-01 00:0{i}:00", 1, "x", 0.0) for i in range(5)]
    got = {r["event_id"]: r["allowed"] for r in windows.rolling_limit(events(spark, rows), 2, 60).collect()}
    assert set(got.values()) == {True} and not all(r["allowed"] for r in windows.rolling_limit(events(spark, rows), 2, 3600).collect())

"""Chat windows, mixing and the pipeline."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import TEXTS, documents, empty

from boxwood.llm import chat, common, mixing, quality, simhash, toxicity
from compare import duck_rows, spark_rows


def test_chat_query(spark, small, duck):
    assert spark_rows(chat.op5_chat_windows(spark, small)) == duck_rows(duck, chat.ORACLE_SQL)


def test_chat_digests_follow_the_contract(spark, small):
    turns = defaultdict(list)
    for r in common.table(spark, small, "conversations").collect():
        turns[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    turns[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    rows = {r["conv_id"]: r for r in chat.op5_chat_windows(spark, small).collect()}
    assert set(rows) == set(turns)
    for conv, own in turns.items():
        own.sort()
        said = "".join(f"{role}\n{text}\n" for _, role, text in own)
        loss = "".join(text for _, role, text in own if role == "assistant")
        r = rows[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def conversations(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.withColumn("window", F.lit("x")).withColumn("cid", F.lit(1)).withColumn("span", F.lit(None).cast("int"))


NASTY = [
    (1, 0, "system", "be\\0 <|turn|>good"), (1, 1, "user", ""), (1, 2, "assistant", None), (1, 3, "user", "\\1\\2[<\n<|end|>\n"), (1, 4, "assistant", "x" * 5_000), (1, 5, "user", "ok"), (1, 6, "assistant", "fine"),
    (2, 0, "assistant", "alone"), (3, 0, None, None), (4, None, "user", "no turn"), (4, 2, "user", "tie"), (4, 2, "user", "tie"), (4, 2, "assistant", "tie"), (None, 0, "user", "no id"), (5, 0, "we\nird<role", "é𝒳"),
]


def test_chat_takes_every_case(spark):
    windows = chat.format_windows(conversations(spark, NASTY))
    read = chat.read_windows(windows).collect()
    said, loss = defaultdict(list), defaultdict(list)
    for r in sorted(read, key=lambda r: r["window"]):
        said[r["conv_id"]] += [(t["role"], t["text"]) for t in r["turns"]]
        loss[r["conv_id"]] += list(r["targets"])
    key = lambda r: ((r[1] is not None, r[1] or 0), r[2] or "", r[3] or "")
    for conv in {r[0] for r in NASTY}:
        own = sorted((r for r in NASTY if r[0] == conv), key=key)
        assert said[conv] == [(r[2] or "", r[3] or "") for r in own]
        assert loss[conv] == [r[3] or "" for r in own if r[2] == "assistant"]
    for r in windows.collect():
        body = re.sub(r"<\|turn\|>|<\|end\|>\n", "", r["formatted"])
        assert "<" not in body and "[" not in body  # no control string survives in texts
    assert chat.format_windows(conversations(spark, NASTY).where("1 = 0")).count() == 0


def estimate(text):
    return math.ceil(len(text) / 2) + len(text.encode()) - len(text)


SENTENCES = [
    "The committee will publish its findings in the spring. ", "Die Ergebnisse werden im Frühjahr veröffentlicht. ", "Los resultados se publicarán en la próxima primavera, según la comisión. ",
    "委員会は春に結果を発表する予定です。", "Результаты будут опубликованы весной. ", "x=1;y=22;z=(3.14,0x7f)\n", "𝒳𝒴😀🎉",
]


def test_windows_by_the_tokenizer(spark):
    """Real ids of windows in several scripts: within the budget for prose, and never twice it;
    counted in a column, never above it."""
    from boxwood.llm.tokens import encoder

    tok = encoder().tokenizer
    count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    rows = [(c, i, "user" if i % 2 else "assistant", s * (1 + i % 3)) for c, s in enumerate(SENTENCES) for i in range(60)]
    df = conversations(spark, rows)
    known = spark.createDataFrame([(*r, count(r[3])) for r in rows], "conv_id long, turn long, role string, text string, tokens long")
    for windows, limits in ((chat.format_windows(df), [512] * 5 + [1024] * 2), (chat.format_windows(known, tokens_col="tokens"), [512] * 7)):
        for r in windows.collect():
            turns = [p.split("\n", 1)[1].removesuffix("<|end|>\n") for p in r["formatted"].split("<|turn|>")[1:]]
            assert sum(4 + count(t) for t in turns) <= limits[r["conv_id"]], r["conv_id"]


@pytest.mark.parametrize("chunk", [3, 1024])
def test_windows_keep_to_the_budget(spark, chunk):
    rng = np.random.default_rng(0)
    rows = [(c, i, "system" if i == 0 and c % 2 else "user" if i % 2 else "assistant", "w" * int(rng.integers(1, 300))) for c in range(6) for i in range(40)]
    got = chat.format_windows(conversations(spark, rows), budget=200, history=60, chunk=chunk).collect()
    size = lambda t: 4 + estimate(t)
    assert any(r["n_repeated"] > 1 for r in got)
    for r in got:
        turns = [p.split("\n", 1)[1].removesuffix("<|end|>\n") for p in r["formatted"].split("<|turn|>")[1:]]
        system = r["conv_id"] % 2 and r["window"] > 1
        new, old = turns[r["n_repeated"] :], turns[int(bool(system)) : r["n_repeated"]]
        assert sum(map(size, old)) <= 60
        assert sum(map(size, new)) <= 140 or len(new) == 1
        if system:
            assert r["formatted"].startswith("<|turn|>system\n")


def test_bisection():
    shares = np.array([0.7, 0.2, 0.1])
    a = mixing.bisect_exponent(shares, max_repeats=3.5)
    w = mixing._weights(shares, a)
    assert (w / shares).max() / (w / shares).min() == pytest.approx(3.5, rel=1e-6)
    e = mixing.bisect_exponent(shares, entropy=1.0)
    assert mixing._entropy(mixing._weights(shares, e)) == pytest.approx(1.0, abs=1e-6)
    assert mixing.bisect_exponent(shares, max_repeats=1.0) == 1.0 and mixing.bisect_exponent(shares, entropy=5.0) == 0.0


def test_plan_loses_nothing_and_meets_weights():
    m = mixing.plan({"a": 9000, "b": 900, None: 100})
    assert min(m.passes.values()) == 1.0 and max(m.passes.values()) <= 2 + 1e-6
    taken = {s: m.tokens[s] * m.passes[s] for s in m.tokens}
    for s in taken:
        assert taken[s] / sum(taken.values()) == pytest.approx(m.weights[s])


def test_blocks_hold_each_source_in_its_weight(spark):
    rows = [(i, "t" * 36, "a" if i % 10 else "b") for i in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixture, taken = mixing.schedule(docs, block_tokens=20_000)
    docs = docs.select("source", mixing._bucket("doc_id", "text").alias("bucket"), mixing.tokens_of("text").alias("n"))
    blocks = defaultdict(Counter)
    for r in docs.join(taken.drop("weight"), ["source", "bucket"]).groupBy("block", "source").agg({"n": "sum"}).collect():
        blocks[r["block"]][r["source"]] += r["sum(n)"]
    assert len(blocks) > 5
    for b in sorted(blocks)[:-1]:
        assert blocks[b]["b"] / sum(blocks[b].values()) == pytest.approx(mixture.weights["b"], rel=0.25)


def check_mix(before, after, key):
    counts, was = Counter(map(key, after)), Counter(map(key, before))
    assert set(counts) == set(was) and all(n >= was[k] for k, n in counts.items())


def test_mixing_takes_every_case(spark):
    docs = documents(spark)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    check_mix(docs.collect(), mixed.collect(), lambda r: (r["doc_id"], r["text"], r["source"]))
    assert mixing.mix(empty(docs)).count() == 0


def test_mixed_rows_follow_the_blocks(spark):
    """Of input sorted by source, every run of rows holds the sources in their weights, copies
    lie apart."""
    rows = [(i, f"word {i} and so on", "b" if i < 1_000 else "a") for i in range(10_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixture, taken = mixing.schedule(docs, block_tokens=5_000)
    assert mixture.passes["b"] == pytest.approx(2.0)
    mixed = [r["doc_id"] for r in mixing.mix(docs, block_tokens=5_000).collect()]
    for at in range(0, len(mixed) - 500, 500):
        assert sum(i < 1_000 for i in mixed[at : at + 500]) / 500 == pytest.approx(mixture.weights["b"], rel=0.4)
    places = defaultdict(list)
    for at, i in enumerate(mixed):
        places[i].append(at)
    gaps = [p[1] - p[0] for p in places.values() if len(p) == 2]
    assert len(gaps) > 900 and sum(g < 50 for g in gaps) < 10
    bucket = {r["doc_id"]: r["bucket"] for r in docs.select("doc_id", mixing._bucket("doc_id", "text").alias("bucket")).collect()}
    blocks = {(r["source"], r["bucket"], r["pass"]): r["block"] for r in taken.collect()}
    got = [blocks["b" if i < 1_000 else "a", bucket[i], places[i].index(at)] for at, i in enumerate(mixed)]
    assert got == sorted(got) and len(set(got)) > 5


def test_mixing_query(spark, small):
    docs = common.table(spark, small, "documents").collect()
    rows = mixing.op6_temperature_mixing(spark, small).collect()
    check_mix(docs, rows, lambda r: (r["doc_id"], r["source"]))
    tokens, taken = Counter(), Counter()
    for r in docs:
        tokens[r["source"]] += 1 + estimate(r["text"] or "")
    for r in rows:
        taken[r["source"]] += r["tokens"]
    m = mixing.plan(dict(tokens))
    for s in tokens:
        # The last pass ends at the nearest bucket: within one document here.
        assert taken[s] == pytest.approx(tokens[s] * m.passes[s], abs=6_000)
    for r in rows:
        assert r["weight"] == pytest.approx(m.weights[r["source"]])
    assert {r["pass"] for r in rows} == {0, 1}


def test_mixing_query_by_sql(spark, small, duck):
    assert spark_rows(mixing.op6_temperature_mixing(spark, small)) == duck_rows(duck, mixing.ORACLE_SQL)


def test_mixing_repeats_itself(spark, small):
    a, b = (sorted(map(tuple, mixing.op6_temperature_mixing(spark, small).collect()), key=repr) for _ in range(2))
    assert a == b


def brute_pipeline(spark, docs, sf_dir):
    """The kept documents by plain loops over whole tables, with the operators' own models."""
    import corpus_pipeline as p

    labels = common.table(spark, sf_dir, "labels")
    rows = {r["doc_id"]: r for r in docs.collect()}
    net = quality.fit(p.labelled_sample(docs, labels, "quality", quality.PER_CLASS))
    good = {i for i, r in rows.items() if net.score([(r["text"] or "").encode()])[0] >= 0.3}
    lexicon = toxicity.learn(p.labelled_sample(docs.where(docs["doc_id"].isin([int(i) for i in good])), labels, "toxic", toxicity.PER_CLASS))
    clean = {i for i in good if lexicon.score(rows[i]["text"]) < 0.5}

    def shingles(i):
        w = (rows[i]["text"] or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    sets = {i: shingles(i) for i in sorted(clean)}
    near = lambda a, b, s: len(sets[a] & sets[b]) >= s * len(sets[a] | sets[b])
    return good, clean, sets, near


def test_pipeline(spark, small):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality", "toxicity", "near_dedup", "mixing", "packing"] and p.ORACLE_SQL is None
    docs = common.table(spark, small, "documents")
    good, clean, sets, near = brute_pipeline(spark, docs, small)
    stage, seen = docs, []
    for name, f in p.STAGES:
        stage = common.materialise(f(spark, stage, small))
        if name != "packing":
            assert stage.columns == docs.columns
        seen.append(sorted(r["doc_id"] for r in stage.select("doc_id").collect()))
    assert set(seen[0]) == good and set(seen[1]) == clean
    kept, gone = set(seen[2]), clean - set(seen[2])
    assert len(seen[2]) == len(kept)
    least = {i: i for i in clean}  # of those that links at 0.8 reach
    while moved := [(i, least[j]) for i in clean for j in clean if least[j] < least[i] and near(i, j, 0.8)]:
        for i, low in moved:
            least[i] = min(least[i], low)
    assert kept == set(least.values()) and gone
    assert set(seen[3]) == kept and set(seen[4]) == kept
    by = Counter(seen[3])
    assert max(by.values()) <= 3
    ran = sorted(map(tuple, p.run(spark, small).select("doc_id", "start", "length", "doc_tokens").collect()))
    assert ran == sorted(map(tuple, stage.select("doc_id", "start", "length", "doc_tokens").collect()))


def test_stages_take_every_case(spark, small):
    import corpus_pipeline as p

    for docs in (documents(spark), empty(documents(spark))):
        before = docs.count()
        for name, f in p.STAGES:
            out = f(spark, docs, small)
            n = out.count()
            assert n <= before if name in ("quality", "toxicity", "near_dedup") else n >= before
            assert name == "packing" or out.columns == docs.columns
    assert simhash.keep_one(documents(spark)).count() == len({t for _, t, *_ in TEXTS if t and t.strip()}) + 1

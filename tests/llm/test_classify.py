"""Language, toxicity and quality: direct computations, held-out accuracy, and every case."""

from __future__ import annotations

import math

import numpy as np
import pytest
from cases import TEXTS, documents, empty, held_out
from hypothesis import given, settings
from hypothesis import strategies as st

from boxwood.llm import common, ppm, quality, toxicity
from boxwood.llm.labelled import Sample, labelled_sample


def brute_code_length(train, text):
    """Prediction by partial matching, order 2, escape C, frozen after training."""
    counts = {}
    for t in train:
        t = b"    " + t.lower()
        for i in range(4, len(t)):
            for order in range(5):
                own = counts.setdefault(t[i - order : i], {})
                own[t[i]] = own.get(t[i], 0) + 1
    bits, t = 0.0, b"    " + text.lower()
    for i in range(4, len(t)):
        for order in (4, 3, 2, 1, 0, -1):
            if order < 0:
                bits += 8
                break
            own = counts.get(t[i - order : i])
            if not own or (order > 2 and sum(own.values()) < ppm.SEEN):
                continue
            total = sum(own.values()) + len(own)
            if t[i] in own:
                bits -= math.log2(own[t[i]] / total)
                break
            bits -= math.log2(len(own) / total)
    return bits


def trees_of(by):
    codes, counts = [], []
    for train in by.values():
        found = {}
        for t in train:
            for k in ppm._grams([b"    " + t]).tolist():
                found[k] = found.get(k, 0) + 1
        codes.append(np.array(sorted(found)))
        counts.append(np.array([found[k] for k in sorted(found)]))
    return ppm.ContextTrees(list(by), codes, counts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAbc é", min_size=1, max_size=30), min_size=1, max_size=6), st.text(alphabet="abcdé Z", max_size=20))
def test_code_lengths(train, text):
    train, body = [t.encode() for t in train], text.encode()
    if not body:
        return
    got = trees_of({"x": train}).code_lengths([body, body])
    assert got[:, 0] == pytest.approx([brute_code_length(train, body)] * 2, abs=1e-3)


def test_long_texts_count_whole(monkeypatch):
    trees = trees_of({"x": [b"abab"], "y": [b"cdcd"]})
    body = b"abcd" * 50
    whole = trees.code_lengths([body])
    monkeypatch.setattr(ppm, "_SPAN", 16)
    assert trees.code_lengths([body]) == pytest.approx(whole)


def test_language_takes_every_case(spark):
    docs = documents(spark)
    trees = trees_of({"en": [b"the quick brown fox is here"], "xx": [b"zzzz qqqq"]})
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in ppm.identify(docs, trees).collect()]
    assert len(got) == len(TEXTS)
    by = {i: (p, s) for i, p, s in got}
    assert by[2] == by[3] == by[6] == by[7] == ("und", 0.0)
    assert by[1][0] == "en" and by[8][0] != "und" and all(0 <= s <= 1 for _, _, s in got)
    assert ppm.train(empty(docs)) is None
    assert {r["lang_pred"] for r in ppm.identify(docs, None).collect()} == {"und"}
    assert ppm.identify(empty(docs), trees).count() == 0
    assert set(ppm.train(docs).languages) <= {"en", "la", "fr", "ja", "de"}


def test_training_leaves_the_fold_out(spark):
    docs = spark.createDataFrame([(i, "abc" if not held_out(i) else "zzz", "x") for i in range(50)], "doc_id long, text string, lang string")
    trees = ppm.train(docs, per_language=1000)
    assert trees.code_lengths([b"zzzz"])[0, 0] > 4 * 7  # never seen


def test_language_query(spark, small):
    truth = {r["doc_id"]: r["lang"] for r in common.table(spark, small, "documents").collect()}
    rows = ppm.op4_ppm_language(spark, small).collect()
    assert {r["doc_id"] for r in rows} == set(truth) and all(r["held_out"] == held_out(r["doc_id"]) for r in rows)
    own = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in own]) >= 0.95


def test_folding():
    assert toxicity.fold("Іdіоt, 1D10T! $tup​id  ＭＯＲＯＮ") == " idiot idiot stupid moron "
    assert toxicity.fold("") == "  " and toxicity.fold("***") == "  "
    assert toxicity.fold("Straße äöü") == " straße äöü "


def test_matching_equals_a_scan():
    lexicon = toxicity.Lexicon({"bad": 2.0, "wor": 1.0, "worse": 3.0}, ["bad luck", "not worse"], [0.0, 1.0, 0.0])

    def scan(text):
        words = toxicity.fold(text).split()
        spared = {i + d for i in range(len(words) - 1) if " ".join(words[i : i + 2]) in lexicon.exceptions for d in (0, 1)}
        return sum(w for i, x in enumerate(words) if i not in spared for s, w in lexicon.weights.items() if x.startswith(s))

    for text in ("bad", "b@d luck, baddest w0rse", "not worse but bad", "subad embad", "bad luck bad", "", "worse " * 3 + "bad " * 200):
        total, words = lexicon.measure(text)
        assert total == pytest.approx(scan(text)) and (not text or words == len(toxicity.fold(text).split()))


def planted(n=400, seed=0):
    """Texts of which a quarter hold insults, in various spellings, and an innocent phrase."""
    rng = np.random.default_rng(seed)
    vocabulary = ["".join(rng.choice(list("aeiourstnlm"), 6)) for _ in range(600)]
    texts, labels = [], []
    for i in range(n):
        words = list(rng.choice(vocabulary, rng.integers(20, 80)))
        if i % 4 == 0:
            for _ in range(3):
                words.insert(int(rng.integers(0, len(words))), str(rng.choice(["grobnik", "GR0BNIK", "zulterer", "zult3r"])))
        elif i % 4 == 1:
            words.insert(3, "grobnik valley")
        texts.append(" ".join(words))
        labels.append(int(i % 4 == 0))
    return texts, np.array(labels)


def test_lexicon_is_learned():
    texts, labels = planted()
    lexicon = toxicity.learn(Sample(texts, labels, 0.25))
    assert any(s.startswith("zult") for s in lexicon.weights)
    assert "grobnik valley" in lexicon.exceptions or not any("grobnik".startswith(s) for s in lexicon.weights)
    texts, labels = planted(seed=1)
    assert np.mean([(lexicon.score(t) >= 0.5) == y for t, y in zip(texts, labels, strict=True)]) > 0.95


def test_near_copies_teach_once():
    texts, labels = planted(80)
    copies = [texts[0] + f" x{i}" for i in range(200)]
    thin = toxicity._apart(Sample(texts + copies, np.concatenate([labels, np.ones(200, dtype=int)]), 0.25))
    assert len(thin.texts) <= 90


def test_toxicity_takes_every_case(spark):
    docs = documents(spark)
    lexicon = toxicity.Lexicon({"quick": 5.0}, [], [-3.0, 2.0, 1.0])
    rows = toxicity.score_toxicity(docs, lexicon).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    kept = toxicity.drop_toxic(docs, lexicon)
    assert kept.columns == docs.columns and sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((i for i, *_ in TEXTS if i not in (1, 5)), key=repr)
    assert toxicity.score_toxicity(empty(docs), lexicon).count() == toxicity.drop_toxic(empty(docs), lexicon).count() == 0
    none = toxicity.learn(Sample([], np.zeros(0, dtype=int), 0.5))
    assert {r["predicted"] for r in toxicity.score_toxicity(docs, none).collect()} == {0}


def agreement(spark, small, rows, label):
    truth = {r["doc_id"]: r[label] for r in common.table(spark, small, "labels").collect()}
    docs = {r["doc_id"] for r in common.table(spark, small, "documents").collect()}
    assert {r["doc_id"] for r in rows} == docs and all(r["held_out"] == held_out(r["doc_id"]) for r in rows)
    return np.mean([r["predicted"] == truth[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in truth])


def test_toxicity_query(spark, small):
    assert agreement(spark, small, toxicity.op7_lexicon_toxicity(spark, small).collect(), "toxic") >= 0.85


def test_spared_spans_in_one_sweep():
    rng = np.random.default_rng(4)
    for _ in range(200):
        hits = [(int(a), int(a + n), 1.0) for a, n in zip(rng.integers(0, 30, 8), rng.integers(1, 6, 8), strict=True)]
        spared = [(int(a), int(a + n)) for a, n in zip(rng.integers(0, 30, 5), rng.integers(1, 12, 5), strict=True)]
        assert toxicity._outside(hits, spared) == sum(not any(x <= a and b <= y for x, y in spared) for a, b, _ in hits)


def test_a_one_is_an_i_or_an_l():
    lexicon = toxicity.Lexicon({"vile": 2.0, "lout": 3.0}, ["vile weather"], [0.0, 1.0, 0.0])
    assert lexicon.measure("v1le")[0] == lexicon.measure("vi1e")[0] == 2.0 and lexicon.measure("1out v1le v1le weather")[0] == 5.0 and lexicon.measure("11 111")[0] == 0.0


def test_features_equal_a_convolution():
    rng = np.random.default_rng(2)
    net = quality.ByteNet(rng.normal(size=(8, 256, 5)).astype(np.float32), rng.normal(size=5).astype(np.float32), np.zeros(16), 0.0)

    def direct(text):
        padded = np.frombuffer(quality._padded(text), dtype=np.uint8)
        windows = [sum(net.tables[k, padded[a + k]] for k in range(8)) for a in range(len(padded) - 7)]
        runs = [np.max(windows[a : a + quality.HALF], axis=0) for a in range(0, len(windows), quality.HALF)]
        runs = [np.maximum(r + net.bias, 0) for r in runs]
        chunks = [np.maximum(a, b) for a, b in zip(runs, runs[1:], strict=False)] or runs
        return np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0), np.min(chunks, axis=0)])

    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (0, 1, 7, 8, 9, 255, 256, 257, 263, 264, 512, 600, 3000)]
    got = net.features(texts)
    for t, f in zip(texts, got, strict=True):
        assert f[:-1] == pytest.approx(direct(t), abs=1e-3)
        assert net.features([t])[0] == pytest.approx(f, abs=1e-5)


def test_long_texts_are_convolved_in_spans(monkeypatch):
    rng = np.random.default_rng(3)
    net = quality.ByteNet(rng.normal(size=(8, 256, 4)).astype(np.float32), np.zeros(4, np.float32), np.zeros(13), 0.0)
    text = bytes(rng.integers(0, 256, 5001, dtype=np.uint8))
    whole = net.features([text])
    monkeypatch.setattr(quality, "_SPAN", 1024)
    assert net.features([b"ab", text, b"cd"])[1] == pytest.approx(whole[0], abs=1e-5)


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(4)
    tables, bias = rng.normal(size=(8, 256, quality.FILTERS)), rng.normal(size=quality.FILTERS)
    weights, offset = rng.normal(0, 0.1, 3 * quality.FILTERS + 1), np.zeros(1)
    raws = [rng.integers(97, 120, n, dtype=np.uint8) for n in (40, 700, 1500)]
    short, y, weight = quality._shortness([40, 700, 1500]), np.array([1.0, 0.0, 1.0]), np.array([0.7, 1.5, 0.8])
    every = np.arange(65_536, dtype=np.int32)
    grads = quality._gradient(tables, bias, weights, offset, raws, short, y, weight, every, every)

    def loss(w, tables=tables):
        top = []
        for raw in raws:
            windows = [sum(tables[k, raw[a + k]] for k in range(8)) for a in range(len(raw) - 7)]
            runs = [np.maximum(np.max(windows[a : a + quality.HALF], axis=0) + bias, 0) for a in range(0, len(windows), quality.HALF)]
            c = np.array([np.maximum(a, b) for a, b in zip(runs, runs[1:], strict=False)] or runs)
            top.append(np.concatenate([c.mean(axis=0), c.max(axis=0), c.min(axis=0)]))
        z = np.concatenate([np.array(top), short[:, None]], axis=1) @ w + offset[0]
        return float(np.mean(weight * (np.logaddexp(0, z) - y * z))) + 0.5e-4 * float(w @ w)

    at = np.unravel_index(np.abs(grads[0]).argmax(), tables.shape)
    moved = [tables.copy(), tables.copy()]
    moved[0][at] += 1e-4
    moved[1][at] -= 1e-4
    assert grads[0][at] == pytest.approx((loss(weights, moved[0]) - loss(weights, moved[1])) / 2e-4 + 1e-5 * tables[at], rel=1e-2, abs=1e-5)
    for i in (0, 5, 3 * quality.FILTERS):
        e = np.zeros_like(weights)
        e[i] = 1e-4
        assert grads[2][i] == pytest.approx((loss(weights + e) - loss(weights - e)) / 2e-4, rel=1e-3, abs=1e-5)


def test_quality_takes_every_case(spark, monkeypatch):
    docs = documents(spark)
    rng = np.random.default_rng(0)
    good = [" ".join(rng.choice(["river", "stone", "cloud", "walks", "under"], 40)) for _ in range(60)]
    bad = ["!!?? " * 40 + str(i) for i in range(60)]
    net = quality.fit(Sample(good + bad, np.array([1] * 60 + [0] * 60), 0.5))
    assert (net.score([g.encode() for g in good]) >= 0.3).mean() > 0.95 and (net.score([b.encode() for b in bad]) >= 0.3).mean() < 0.05
    rows = quality.score_quality(docs, net).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    kept = quality.keep_good(docs, net)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in rows)
    assert quality.score_quality(empty(docs), net).count() == quality.keep_good(empty(docs), net).count() == 0
    none = quality.fit(Sample([], np.zeros(0, dtype=int), 0.5))
    assert {r["score"] for r in quality.score_quality(docs, none).collect()} == {0.5}


def test_quality_query(spark, small):
    assert agreement(spark, small, quality.op9_byte_quality(spark, small).collect(), "quality") >= 0.85


def test_short_bad_texts_are_no_better_for_being_short():
    rng = np.random.default_rng(5)
    words = ["river", "stone", "cloud", "walks", "under", "bright", "the"]
    good = [" ".join(rng.choice(words, int(rng.integers(20, 200)))) for _ in range(200)]
    bad = [" | ".join(rng.choice(words, int(rng.integers(20, 200)))).upper() for _ in range(200)]
    net = quality.fit(Sample(good + bad, np.array([1] * 200 + [0] * 200), 0.5))
    for n in (24, 60, 150):
        assert (net.score([g[:n].encode() for g in good]) >= 0.3).mean() > 0.95 and (net.score([b[:n].encode() for b in bad]) >= 0.3).mean() < 0.1


def test_samples_take_repeated_ids_once(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0)], "doc_id long, flag int")
    got = labelled_sample(docs, labels, "flag", 9)
    assert sorted(zip(got.texts, got.labels.tolist(), strict=True)) == [("a", 1), ("c", 0)]


def test_samples_are_bounded_and_leave_the_fold_out(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(300)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3 == 0, 1) for i in range(300)] + [(None, True, 1), (7, None, 1), (999, True, 1)], "doc_id long, flag boolean, other int")
    got = labelled_sample(docs, labels, "flag", 40)
    assert len(got.texts) <= 80 and not any(held_out(int(t[1:])) for t in got.texts)
    assert all(y == (int(t[1:]) % 3 == 0) for t, y in zip(got.texts, got.labels, strict=True))
    assert labelled_sample(docs, empty(labels), "flag", 40).texts == []

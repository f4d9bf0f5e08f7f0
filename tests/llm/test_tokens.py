"""Encoding, packing and wavelet-matrix files, against the library, brute force and round trips."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from cases import LONG, TEXTS, documents, empty
from hypothesis import given, settings
from hypothesis import strategies as st

from boxwood.llm import common, packing, wavelet
from boxwood.llm.tokens import Encoder, encoder

PIECES = st.lists(st.sampled_from([" ", "\n", "the", "Word", "é", ",", ".", "12", "'s", "!", "\t", "\r", "\xa0", "　", "\x1c", "\x85", "<|endoftext|>", "日本", " the", "$$$"]), max_size=30).map("".join)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.none() | PIECES, max_size=12))
def test_encoding_equals_the_library(texts):
    enc = encoder()
    want = [enc.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in enc.ids(pa.array(texts, pa.string()))] == want


def test_added_tokens_are_found_as_the_library_finds_them(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "a\n<|endoftext|>\nb c", "x<|endoftext|><|endoftext|> y,", "a <|endoftext|  > b", "<|endoftext|>\t  z <|endo ftext|>", "no such token\nhere", "", None]
    want = [fresh.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert want[0] == [64, 220, 50256, 275]
    assert [x.tolist() for x in Encoder().ids(pa.array(texts, pa.string()))] == want
    assert [x.tolist() for x in Encoder().encode(texts)] == want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packing.pack(docs).collect()} == {i: [*ids, 0] for i, ids in enumerate(want)}


def test_encoding_with_a_full_memory_is_the_same():
    small, r = Encoder(remember=5), random.Random(0)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    for _ in range(4):
        texts = [" ".join(r.choice(words) + r.choice([",", "", "\nX"]) for _ in range(20)) for _ in range(8)]
        assert [x.tolist() for x in small.ids(pa.array(texts))] == [small.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(small.parts) == 5


LETTERS = "aaabcdeehinorstt\u00e9\u00dfжщ日本한กे\u02b0\U00010400\U0001e030\U000105c0\U00031350"


def test_merges_done_for_many_words_equal_the_library():
    enc, r = Encoder(), random.Random(3)
    words = ["a", "é", "a" * 50, "the" * 40, "日" * 9, *("".join(r.choice(LETTERS) for _ in range(r.randint(1, 14))) for _ in range(4_000))]
    parts = [r.choice(["", "\n"]) + w + r.choice(["", "", ",", ".", ",,", "1"]) for w in words] + ["", ",", "\n", "\n."]
    want = [enc.tokenizer.encode(p if p[:1] == "\n" else " " + p, add_special_tokens=False).ids for p in parts]
    by_library = Encoder()
    by_library.merges = None
    for own in (enc, by_library):
        flat, lengths = own._learn(pa.array(parts))
        assert [x.tolist() for x in np.split(flat, np.cumsum(lengths)[:-1])] == want


def test_letters_that_the_library_does_not_know_go_to_it():
    enc, split = Encoder(), Encoder().tokenizer.pre_tokenizer.pre_tokenize_str
    enc.tokenizer = type("Tokenizer", (), {"encode_batch_fast": enc.tokenizer.encode_batch_fast, "pre_tokenizer": type("Splitter", (), {"pre_tokenize_str": staticmethod(lambda t: ["a", "é", "a"] if "é" in t else split(t))})})
    given, raw = [], enc._raw
    enc._raw = lambda parts: given.extend(parts) or raw(parts)
    assert [x.tolist() for x in enc.ids(pa.array(["x café and été, the\nthé end"]))] == [encoder().tokenizer.encode("x café and été, the\nthé end", add_special_tokens=False).ids]
    assert given and all("é" in p for p in given if p.strip())


def test_new_words_of_letters_cost_no_call_of_the_library():
    enc, r, given = Encoder(), random.Random(5), []
    library = enc.tokenizer.encode_batch_fast
    enc.tokenizer = type("Tokenizer", (), {"encode_batch_fast": staticmethod(lambda texts, **k: given.extend(texts) or library(texts, **k)), "pre_tokenizer": enc.tokenizer.pre_tokenizer})
    text = " ".join("".join(r.choice("abcdeé") for _ in range(8)) + r.choice(["", ",", "."]) for _ in range(3_000))
    assert enc.ids(pa.array([text + " 12:30"]))[0].tolist() == encoder().tokenizer.encode(text + " 12:30", add_special_tokens=False).ids
    assert sorted(x for x in given if x.strip()) == [" 12:30"]


def test_few_parts_are_encoded_without_hashing_what_is_remembered(monkeypatch):
    from boxwood.llm import tokens

    enc, r = Encoder(), random.Random(6)
    text = " ".join("".join(r.choice("abcde") for _ in range(8)) for _ in range(500))
    enc.ids(pa.array([text]))
    known, calls, looked = len(enc.parts), [], tokens.pc.index_in
    monkeypatch.setattr(tokens.pc, "index_in", lambda *a, **k: calls.append(len(a[0])) or looked(*a, **k))
    for t in (text[:200], "new words\there too", ""):
        assert enc.ids(pa.array([t]))[0].tolist() == encoder().tokenizer.encode(t, add_special_tokens=False).ids
    assert not calls and len(enc.parts) == known


def test_broken_utf8_is_replaced():
    column = pa.Array.from_buffers(pa.string(), 1, [None, pa.array([0, 3], pa.int32()).buffers()[1], pa.py_buffer(b"a\xff ")])
    assert encoder().ids(column)[0].tolist() == encoder().tokenizer.encode("a� ", add_special_tokens=False).ids


def test_spans_bound_rows_and_bytes():
    batch = pa.RecordBatch.from_pydict({"t": ["x" * n for n in (5, 5, 100, 1, 1, 1)] + [None]})
    got = [s.num_rows for s in common.spans(batch, 0, rows=3, size=10)]
    assert got == [2, 1, 3, 1] and sum(got) == batch.num_rows


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=60))
def test_best_fit_decreasing(lengths):
    """The window chosen is always the tightest that fits."""
    windows, offsets, n = packing.best_fit_decreasing(lengths, 16)
    room: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [r for r in room if r >= lengths[i]]
        if fits:
            assert room[windows[i]] == min(fits)
        else:
            assert windows[i] == len(room)
            room.append(16)
        assert offsets[i] == 16 - room[windows[i]]
        room[windows[i]] -= lengths[i]
    assert n == len(room)


def check_pieces(rows, texts):
    """Every id of every document in one piece, windows gapless and within capacity."""
    enc = encoder()
    by_window = defaultdict(list)
    for r in rows:
        by_window[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by_window.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
    want = sorted(([*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for t in texts), key=repr)
    assert sum(r["length"] for r in rows) == sum(map(len, want))
    return by_window


def test_packing_takes_every_case(spark):
    rows = packing.pack(documents(spark)).collect()
    check_pieces(rows, [t for _, t, _, _ in TEXTS])
    whole = b"".join(bytes(r["ids"]) for r in sorted((r for r in rows if r["doc_id"] == 4), key=lambda r: r["start"]))
    assert np.frombuffer(whole, "<u4").tolist() == [*encoder().tokenizer.encode(LONG, add_special_tokens=False).ids, 0]
    assert [r["length"] for r in rows if r["doc_id"] in (2, 3)] == [1, 1]
    assert sum(r["doc_id"] == 5 for r in rows) == 2 and sum(r["doc_id"] is None for r in rows) == 1
    assert packing.pack(empty(documents(spark))).count() == 0


def test_packing_query(spark, small):
    docs = {r["doc_id"]: r["text"] for r in common.table(spark, small, "documents").collect()}
    rows = packing.op1_packing(spark, small).collect()
    windows = check_pieces(rows, list(docs.values()))
    total = sum(r["length"] for r in rows)
    assert len(windows) * 1024 < total + 1024 * 8  # padding: little more than a window a task
    for r in rows:
        ids = [*encoder().tokenizer.encode(docs[r["doc_id"]], add_special_tokens=False).ids, 0]
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 70_000), max_size=120))
def test_wavelet_matrix(ids):
    m = wavelet.WaveletMatrix.build(np.array(ids, dtype=np.uint32))
    assert m.decode().tolist() == ids and [m.access(i) for i in range(len(ids))] == ids
    for value in {*ids[:5], 3, 1 << 20}:
        at = [i for i, x in enumerate(ids) if x == value]
        assert m.occurrences(value) == at and m.rank(value, len(ids)) == len(at)
        assert m.rank(value, len(ids) // 2, 2) == sum(2 <= i < len(ids) // 2 for i in at)
        assert m.select(value, len(at)) is None
    with pytest.raises(IndexError):
        m.access(len(ids))


def test_shard_round_trip():
    docs = [np.array(x, np.uint16) for x in ([1, 2, 0], [0], [65_535, 7, 7, 0])]
    shard = wavelet.Shard(wavelet.write_shard([None, -4, 9], docs, before=11))
    assert shard.doc_ids == [None, -4, 9] and shard.lengths.tolist() == [3, 1, 4] and shard.before == 11
    assert shard.matrix.decode().tolist() == [1, 2, 0, 0, 65_535, 7, 7, 0] and shard.matrix.occurrences(7) == [5, 6]
    with pytest.raises(ValueError):
        wavelet.write_shard([1, None], docs[:2])
    with pytest.raises(ValueError):
        wavelet.Shard(b"something else")


def test_one_file_answers_without_decoding():
    """Access, counting and lookup inflate blocks, a few of each plane, and give what a scan gives."""
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.zipf(1.3, 400_000), 49_999).astype(np.uint16)
    payload = wavelet.write_shard([1, 2], [ids[:150_000], ids[150_000:]])
    assert len(payload) < 2 * len(ids)
    blocks = -(-len(ids) // wavelet.BLOCK)
    inflated = lambda m: sum(p.block.cache_info().misses for p in m.planes)
    for at in (0, 65_535, 65_536, 131_072, 399_999):
        m = wavelet.Shard(payload).matrix
        assert m.access(at) == ids[at] and inflated(m) <= 2 * m.bits
    for value in (1, 17, 1_234, 49_999, 60_000, 70_000):
        at = np.flatnonzero(ids == value)
        m = wavelet.Shard(payload).matrix
        assert m.rank(value, 300_000, 100) == ((at >= 100) & (at < 300_000)).sum() and inflated(m) <= 2 * m.bits
        m = wavelet.Shard(payload).matrix
        k = len(at) // 2
        assert m.select(value, k) == (at[k] if len(at) else None) and inflated(m) <= 4 * m.bits < m.bits * blocks
        assert m.occurrences(value) == at.tolist()
    assert (wavelet.Shard(payload).matrix.decode() == ids).all()


def test_equal_ids_are_split(spark):
    """Rows of one id are dealt over tasks, in the order of their texts."""
    docs = spark.createDataFrame([(None, f"{i:05d} word") for i in range(4_000)], "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shards = wavelet.write_tokens(docs)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert shards.count() > 1
    rows = sorted(wavelet.read_tokens(shards).collect(), key=lambda r: r["start"])
    assert len({bytes(r["ids"]) for r in rows}) == 4_000 and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:], strict=False))
    assert [bytes(r["ids"]) for r in rows] == [np.array([*encoder().tokenizer.encode(f"{i:05d} word", add_special_tokens=False).ids, 0], "<u4").tobytes() for i in range(4_000)]


def test_token_files_take_every_case(spark):
    docs = documents(spark)
    shards = wavelet.write_tokens(docs, shard_tokens=50)
    rows = wavelet.read_tokens(shards).collect()
    order = sorted(rows, key=lambda r: r["start"])
    assert [r["doc_id"] for r in order] == sorted((i for i, *_ in TEXTS), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in order:
        assert r["start"] == at
        at += r["n_tokens"]
    texts = defaultdict(list)
    for i, t, *_ in TEXTS:
        texts[i].append(t or "")
    for r in rows:
        assert np.frombuffer(r["ids"], "<u4").tolist() == [*encoder().tokenizer.encode(texts[r["doc_id"]][0], add_special_tokens=False).ids, 0]
    assert wavelet.read_tokens(wavelet.write_tokens(empty(docs))).count() == 0


def test_token_file_query(spark, small):
    docs = {r["doc_id"]: r["text"] for r in common.table(spark, small, "documents").collect()}
    rows = {r["doc_id"]: r for r in wavelet.op3_wavelet_tokens(spark, small).collect()}
    at = 0
    for i in sorted(docs):
        ids = np.array([*encoder().tokenizer.encode(docs[i], add_special_tokens=False).ids, 0], "<u4")
        assert (rows[i]["start"], rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(rows) == len(docs)

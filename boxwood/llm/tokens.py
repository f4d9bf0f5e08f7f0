"""Exact, cached encoding with a byte-level BPE of the tokenizers library.

A byte-level BPE first splits a text by a pattern in which a single space between two
characters that aren't white space always begins a new piece, and a single line feed there is a
piece of its own. So a text may be cut before each such isolated space or line feed, the parts
encoded by the library on their own, and the ids joined: the result equals encoding the whole
text. A text that holds an added token is encoded whole, as the library splits by those before
all else. Parts repeat: each worker remembers a bounded number of them as one Arrow column, in which
a batch looks its parts up, and their ids as one array. New parts that are words of letters are one
piece each, and their merges are done here, for many words at a time.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import texts_of

BPE = "byte_bpe_50k.json"
_RUN = 1 << 18
#: Words whose merges are done at a time.
_PIECES = 1 << 15
#: Texts with other white space than single spaces and line feeds between words.
_NOT_APART = r"[ \n][ \n]|\A[ \n]|[ \n]\z|[\t\x{0b}-\x{0d}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_CUTS = re.compile(r"(?<!\s) (?=\S)|(?<!\s)(?=\n\S)")


def cut(text: str) -> list[str]:
    """The parts of any text. After the first, a part that begins with a line feed is as it
    stands, and any other followed a space, which is left out."""
    return _CUTS.split(text)


class Merges:
    """The merges of a byte-level BPE, done for many pieces at a time: in each round every piece
    merges its pair of least rank, the leftmost of equal ones, as the library does one by one."""

    _SHIFT, _NONE = 32, 1 << 62

    def __init__(self, model: dict):
        vocab, pairs = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = dict(zip(shown, map(chr, shown), strict=True))
        chars.update((b, chr(256 + i)) for i, b in enumerate(b for b in range(256) if b not in chars))
        self.alphabet = np.array([vocab[chars[b]] for b in range(256)], dtype=np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        # Keys of pairs by rank (a last one for none), and a hash table of ranks with linear probing.
        self.keys = np.array([*(vocab[a] << self._SHIFT | vocab[b] for a, b in pairs), -1], dtype=np.int64)
        self.bits = max(8, (4 * len(pairs)).bit_length())
        self.table = np.full(1 << self.bits, len(pairs), dtype=np.int32)
        rest, slots = np.arange(len(pairs)), self._slots(self.keys[:-1])
        while len(rest):
            free = self.table[slots[rest]] == len(pairs)
            self.table[slots[rest[free]]] = rest[free]
            rest = rest[self.table[slots[rest]] != rest]
            slots[rest] = (slots[rest] + 1) & (len(self.table) - 1)

    @classmethod
    def of(cls, file: str) -> Merges | None:
        """Those of a tokenizer's file, or None if more than plain merges makes a word's ids."""
        with open(file, encoding="utf-8") as f:
            parts = json.load(f)
        model, before = parts["model"], parts.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not parts.get("normalizer")
        if not plain or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return None
        try:
            found = cls(model)
        except KeyError:  # a byte without an id
            return None
        return found if len(np.unique(found.keys)) == len(found.keys) else None

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, above the bits of a place; those that don't merge: _NONE."""
        keys, none = left.astype(np.int64) << self._SHIFT | right, len(self.made)
        slots = self._slots(keys)
        ranks = self.table[slots].astype(np.int64)
        rest = np.flatnonzero((self.keys[ranks] != keys) & (ranks != none))
        while len(rest):
            slots[rest] = (slots[rest] + 1) & (len(self.table) - 1)
            ranks[rest] = self.table[slots[rest]]
            rest = rest[(self.keys[ranks[rest]] != keys[rest]) & (ranks[rest] != none)]
        return np.where(ranks == none, self._NONE, ranks << self._SHIFT)

    def ids(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of pieces one after another, how many each has), of their bytes, one piece after
        another, and how many each has, at least one."""
        ids, lengths, own = self.alphabet[data], lengths.astype(np.int64), np.arange(len(lengths))
        counts, out, done = lengths.copy(), [], []
        ends = np.cumsum(lengths)
        ranks = np.append(self._ranks(ids[:-1], ids[1:]), self._NONE)
        ranks[ends - 1] = self._NONE
        while len(own):
            best = np.minimum.reduceat(ranks + np.arange(len(ranks)), ends - lengths)
            more = best < self._NONE
            if 2 * np.count_nonzero(more) <= len(own):  # set aside those that are done
                kept = np.repeat(more, lengths)
                out.append(ids[~kept])
                done.append(own[~more])
                counts[own[~more]] = lengths[~more]
                ids, ranks, own, lengths = ids[kept], ranks[kept], own[more], lengths[more]
                ends = np.cumsum(lengths)
                continue
            at = best[more] & ((1 << self._SHIFT) - 1)
            ids[at] = self.made[best[more] >> self._SHIFT]
            kept = np.ones(len(ids), dtype=bool)
            kept[at + 1] = False
            ids, ranks = ids[kept], ranks[kept]
            at -= np.arange(len(at))
            lengths = lengths - more
            ends = np.cumsum(lengths)
            last, first = at == ends[more] - 1, at == (ends - lengths)[more]
            ranks[at[last]] = self._NONE
            changed = np.concatenate([at[~last], at[~first] - 1])
            ranks[changed] = self._ranks(ids[changed], ids[changed + 1])
        if not out:
            return ids, counts
        # In the order of the pieces again.
        order = np.concatenate(done)
        sizes = counts[order]
        starts = np.empty(len(counts), dtype=np.int64)
        starts[order] = np.cumsum(sizes) - sizes
        which = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        return np.concatenate(out)[which], counts


class Encoder:
    """Whole texts to ids, as the library encodes them with add_special_tokens=False: an added
    token that a text holds is one id, and none is added. A null text has no ids.

    ``name``: file of the public tokenizers, or a path. ``remember``: parts kept at most; one
    takes some thirty bytes.
    """

    def __init__(self, name: str = BPE, remember: int = 1_000_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        file = name if "/" in name else public_tokenizers.path(name)
        self.tokenizer = Tokenizer.from_file(file)
        self.merges = Merges.of(file)
        #: Letters of which the library makes no piece of their own within a word.
        self.letters: set[str] = set()
        #: Added tokens, which the library finds in a text before it is split.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._holds_added = re.compile("|".join(map(re.escape, self.added)) or r"(?!)")
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.remember = remember
        space, feed = (self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in " \n")
        self.opens = {mark: np.zeros(self.tokenizer.get_vocab_size(), dtype=bool) for mark in " \n"}
        for token, i in self.tokenizer.get_vocab().items():
            self.opens[" "][i] = token.startswith(space)
            self.opens["\n"][i] = token.startswith(feed)
        self.marks = dict(zip(",.", self._raw([",", "."]), strict=True))
        # The parts that are remembered, where their ids are, and the ids.
        self.parts = pa.array([], pa.string())
        self.starts, self.lengths, self.every = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, self.dtype)

    def _raw(self, parts: list[str]) -> list[bytes]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(ids), dtype=self.dtype).tobytes()
        out, at, width = [], 0, self.dtype.itemsize
        for x in ids:
            out.append(flat[at : (at := at + width * len(x))])
        return out

    def _words(self, words: list[str], mark: str) -> list[bytes]:
        """Ids of words of letters only, each after a mark, a space or line feed. They are
        encoded as running text, which the library does faster: the id that begins with the
        mark begins a word, as no other id does."""
        out: list[bytes] = []
        runs = [words[at : at + 512] for at in range(0, len(words), 512)]
        for run, found in zip(runs, self.tokenizer.encode_batch_fast([mark + mark.join(r) for r in runs], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, dtype=self.dtype)
            starts = np.flatnonzero(self.opens[mark][ids]) * self.dtype.itemsize
            if len(starts) != len(run):
                out.extend(self._raw([mark + w for w in run]))
                continue
            flat, cuts = ids.tobytes(), [*starts.tolist(), len(ids) * self.dtype.itemsize]
            out.extend(flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False))
        return out

    def _learn(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of distinct parts one after another, how many each has). Letters are one piece,
        and so are a line feed before them and one closing mark; other parts, and letters that
        the library doesn't know as such, are left to the library."""
        if self.merges is None:
            return self._joined(self._learn_each(parts.to_pylist()))
        full = pc.if_else(pc.starts_with(parts, "\n"), parts, pc.binary_join_element_wise(" ", parts, ""))
        plain = pc.match_substring_regex(parts, r"\A\n?\pL+[,.]?\z")
        words = full.filter(plain)
        chars = np.unique(np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), dtype="<u4"))
        new = {*map(chr, chars.tolist())} - self.letters - {*" \n,."}
        self.letters.update(c for c in new if len(self.tokenizer.pre_tokenizer.pre_tokenize_str(f"a{c}a")) == 1)
        if odd := new - self.letters:
            plain = pc.and_not(plain, pc.match_substring_regex(parts, f"[{''.join(odd)}]"))
            words = full.filter(plain)
        others, sizes = self._joined(self._raw(full.filter(pc.invert(plain)).to_pylist()))
        found, lengths = [], np.empty(len(parts), dtype=np.int32)
        for at in range(0, len(words), _PIECES):
            found.append(self._pieces(words[at : at + _PIECES]))
        own = plain.to_numpy(zero_copy_only=False)
        lengths[~own] = sizes
        lengths[own] = np.concatenate([c for _, c in found]) if found else 0
        flat, mine = np.empty(int(lengths.sum(dtype=np.int64)), dtype=self.dtype), np.repeat(own, lengths)
        flat[~mine] = others
        flat[mine] = np.concatenate([i for i, _ in found]) if found else 0
        return flat, lengths

    def _joined(self, ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(ids), dtype=self.dtype), np.fromiter(map(len, ids), dtype=np.int32, count=len(ids)) // self.dtype.itemsize

    def _pieces(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words after their space or line feed, as ``_learn`` gives them."""
        offsets = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
        begins, ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
        opens = np.zeros(len(data), dtype=bool)
        opens[begins] = True
        opens[begins[data[begins] == ord("\n")] + 1] = True
        opens[ends[np.isin(data[ends - 1], (ord(","), ord(".")))] - 1] = True
        pieces = np.flatnonzero(opens)
        ids, counts = self.merges.ids(data, np.diff(pieces, append=len(data)))
        return ids.astype(self.dtype), np.add.reduceat(counts, np.searchsorted(pieces, begins))

    def _learn_each(self, parts: list[str]) -> list[bytes]:
        """The same by the library alone, for a tokenizer that isn't plain merges."""
        marks, found = self.marks, {"": self._raw([" "])[0]}
        spaced, fed, others, marked = set(), set(), [], []
        for part in parts:
            stem = part[:-1] if part[-1:] in marks else part
            if (stem[1:] if (line := stem[:1] == "\n") else stem).isalpha():
                if stem is not part:
                    marked.append(part)
                (fed if line else spaced).add(stem)
            elif part:
                others.append(part)
        words, lines = list(spaced), list(fed)
        found.update(zip(words, self._words(words, " "), strict=True))
        found.update(zip(lines, self._words([x[1:] for x in lines], "\n"), strict=True))
        found.update(zip(others, self._raw([x if x[0] == "\n" else " " + x for x in others]), strict=True))
        found.update((part, found[part[:-1]] + marks[part[-1]]) for part in marked)
        return [found[part] for part in parts]

    def _lookup(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place of each part, starts and lengths by place, ids)."""
        few = 8 * len(parts) < len(self.parts)  # hashing what is remembered would cost more than encoding them
        at = pa.nulls(len(parts), pa.int32()) if few else pc.index_in(parts, value_set=self.parts)
        starts, lengths, every = self.starts, self.lengths, self.every
        if not at.null_count:
            return at.to_numpy(), starts, lengths, every
        missing = pc.is_null(at)
        new = parts.filter(missing).dictionary_encode()
        at = np.array(at.fill_null(0))
        at[missing.to_numpy(zero_copy_only=False)] = new.indices.to_numpy() + len(self.parts)
        ids, own = self._learn(new.dictionary.cast(pa.string()))
        starts = np.concatenate([starts, np.cumsum(own, dtype=np.int32) - own + np.int32(len(every))])
        lengths, every = np.concatenate([lengths, own]), np.concatenate([every, ids])
        room = 0 if few else min(self.remember, len(starts)) - len(self.parts)
        if room > 0:
            self.parts = pa.concat_arrays([self.parts, new.dictionary[:room].cast(pa.string())])
            n = len(self.parts)
            self.starts, self.lengths, self.every = starts[:n], lengths[:n], every[: starts[n - 1] + lengths[n - 1]]
        return at, starts, lengths, every

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each of some texts, whatever their white space."""
        parts = [[t or ""] if not t or self._holds_added.search(t) else cut(t) for t in texts]
        heads = self._raw([p[0] for p in parts])
        rest = [p[1:] for p in parts]
        flat, ends = self._flat(pa.array(list(chain.from_iterable(rest)), pa.string()))
        at = np.cumsum([0, *map(len, rest)])
        cuts = np.concatenate([[0], ends])[at].tolist()
        return [np.concatenate([np.frombuffer(head, dtype=self.dtype), flat[a:b]]) for head, a, b in zip(heads, cuts, cuts[1:], strict=False)]

    def _flat(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts, and where those of each end."""
        at, starts, lengths, every = self._lookup(parts)
        n = lengths[at]
        ends = np.cumsum(n, dtype=np.int32)
        out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=self.dtype)
        for a in range(0, len(at), _RUN):  # a run at a time bounds what the gathering takes
            m = n[a : a + _RUN]
            lo = int(ends[a] - n[a])
            which = np.repeat(starts[at[a : a + _RUN]] - (ends[a : a + _RUN] - m - lo), m)
            which += np.arange(len(which), dtype=np.int32)
            every.take(which, out=out[lo : lo + len(which)], mode="clip")
        return out, ends

    def _encode_apart(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of texts whose words have one space or line feed between them. Each is read
        after a line feed of its own, whose id is dropped, so that all parts are alike."""
        lists = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise("\n", texts, ""), "\n", " \n"), " ")
        flat, ends = self._flat(lists.flatten().cast(pa.string()))
        at = np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
        # The first part is the empty one before the line feed: a space's id, then that of the feed.
        return [flat[a + 2 : b] for a, b in zip(at, at[1:], strict=False)]

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a column; a null has none."""
        texts = pc.fill_null(texts, "")
        try:
            apart = pc.invert(pc.match_substring_regex(texts, _NOT_APART))
            for token in self.added:
                apart = pc.and_not(apart, pc.match_substring(texts, token))
            own = texts.filter(apart)
            quick = iter(self._encode_apart(own))
        except (pa.ArrowInvalid, UnicodeDecodeError):  # bytes that aren't UTF-8
            return self.encode(texts_of(texts))
        flags = apart.to_pylist()
        slow = iter(self.encode(texts_of(texts.filter(pc.invert(apart)))))
        return [next(quick if a else slow) for a in flags]


_encoders: dict[str, Encoder] = {}


def encoder(name: str = BPE) -> Encoder:
    """This process's encoder: loaded once for all tasks of a worker."""
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]

"""Byte-pair encoding and decoding through a tokenization automaton.

The automaton works on tokens: it accepts a sequence of tokens exactly if that is how byte-pair merging
tokenizes the text they spell.  It begins as one state with an arc for each byte, and takes in the merges one
by one.  Merging (u, v) into w puts in a gadget: the state that u leads to is copied without its arc v, all
arcs u lead to the copy, and wherever an arc u leaves, an arc w leaves as well, to where v led.  So a copy
differs from what it copies by one arc, and states are kept as such differences: each token has the state it
leads to, which is a list of segments (token, until which merge); an arc is missing if a gadget took it away
before the arc of a longer token could be made from it.

A word has exactly one accepted sequence and so has each of its prefixes, so a place in the word that the path
has reached has one state whatever came before.  Encoding follows arcs from there, the longest label first; a
place from which no arc leads on is never tried again.  Many words go in step, each along its own path.
Decoding emits the arcs' labels.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scalarium.llm.text import U64, Numbered, distinct, eights, raw_text, slices, span_hashes, span_part

#: Letters and numbers that Unicode 16 has beyond the tables of Python's unicodedata.
LATER_LETTERS = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
LATER_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTIONS = [b"'s", b"'t", b"'re", b"'ve", b"'m", b"'ll", b"'d"]
OTHER, LETTER, NUMBER, SPACE = range(4)

#: Words whose ids a Python worker remembers, at most (a slice's more), and the greatest length of such words.
REMEMBERED, REMEMBERED_BYTES = 600_000, 64


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file: bytes that print stand for themselves, the others follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Automaton:
    """The tokenization automaton of a list of merges over byte strings."""

    def __init__(self, ids: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.ids = ids
        size = max(ids.values()) + 1
        self.labels: list[bytes] = [b""] * size
        for word, i in ids.items():
            self.labels[i] = word
        self.taken: dict[int, int] = {}  # gadgets: arc u into the state, arc v taken away (u << 32 | v) -> merge
        #: For each token, the state its arc leads to, and the arcs whose gadgets made its own arc.
        self.into: list[tuple[tuple[int, int], ...]] = [((i << 32, size),) for i in range(size)]
        self.made: list[tuple[tuple[int, int], ...]] = [((i, size),) for i in range(size)]
        for at, (left, right) in enumerate(merges):
            self._gadget(at, ids[left], ids[right], ids[left + right], size)
        self._follows: dict[int, bool] = {}
        self._index()

    def _gadget(self, at: int, u: int, v: int, w: int, never: int) -> None:
        if len(self.into[w]) > 1 or not self._leaves(u, v):
            return  # there is an arc w already, or u is never followed by v
        # w leads to the state that v led to up to now; later gadgets at v don't change it
        self.into[w] = ((w << 32, never), *((t, min(until, at)) for t, until in self.into[v]))
        # w leaves wherever u leaves once this gadget is in, so also not where it has just been taken away
        self.made[w] = ((w, never), *((t, min(until, at + 1)) for t, until in self.made[u]))
        self.taken[u << 32 | v] = at

    def _index(self) -> None:
        """The arcs that there are, by the first two bytes of their labels, and each label's longest proper prefix that has one."""
        self.arcs = {w: i for w, i in self.ids.items() if len(w) == 1 or len(self.made[i]) > 1}
        self.reach: dict[bytes, int] = {}
        self.shorter = [-1] * len(self.labels)
        for word, i in self.arcs.items():
            self.reach[word[:2]] = max(len(word), self.reach.get(word[:2], 0))
            self.shorter[i] = next((self.arcs[word[:k]] for k in range(len(word) - 1, 0, -1) if word[:k] in self.arcs), -1)
        self._tables()

    def _tables(self) -> None:
        """The same as arrays, for many words at a time: labels as a trie whose node 0 is the root, states as segments one after another."""
        ids = np.fromiter(self.arcs.values(), np.int64, len(self.arcs))
        sizes = np.fromiter(map(len, self.arcs), np.int64, len(ids))
        pool = np.frombuffer(b"".join(self.arcs), np.uint8).astype(U64)
        begin = np.cumsum(sizes) - sizes
        self._trie = Numbered()
        node = np.zeros(len(ids), np.int64)
        ends: list[np.ndarray] = [np.full(1, -1, np.int64)]  # for each node, the longest label that its path begins with
        for k in range(int(sizes.max(initial=0))):
            which = np.flatnonzero(sizes > k)
            keys, first, inverse = np.unique(node[which].astype(U64) << U64(8) | pool[begin[which] + k], return_index=True, return_inverse=True)
            made = np.concatenate(ends)[node[which[first]]]
            node[which] = self._trie.n + 1 + inverse
            self._trie.add(keys)
            full = np.flatnonzero(sizes[which] == k + 1)
            made[inverse[full]] = ids[which[full]]
            ends.append(made)
        self._ends = np.concatenate(ends)
        self._first = self._trie.find(np.arange(256, dtype=U64)) + 1  # node after one byte
        self._sizes = np.fromiter(map(len, self.labels), np.int64, len(self.labels))
        self._shorter = np.array(self.shorter, np.int64)
        self._gadgets = Numbered()
        self._gadgets.add(np.fromiter(self.taken, U64, len(self.taken)))
        self._merge = np.fromiter(self.taken.values(), np.int64, len(self.taken))
        self._pairs, self._open = Numbered(), np.zeros(0, bool)  # pairs of arcs seen so far, and whether the one follows the other
        self._into, self._made = (
            (np.cumsum([0, *map(len, of)]), np.array([a for state in of for a, _ in state], U64), np.array([until for state in of for _, until in state], np.int64)) for of in (self.into, self.made)
        )

    def _arcs(self, last: np.ndarray, token: np.ndarray) -> np.ndarray:
        """arc() of each pair."""
        keys = last.astype(U64) << U64(32) | token.astype(U64)
        at = self._pairs.find(keys)
        if len(new := distinct(keys[at < 0])):
            if self._pairs.n + len(new) > 1_000_000:
                self._pairs, self._open = Numbered(), np.zeros(0, bool)
                new = distinct(keys)
            self._pairs.add(new)
            self._open = np.concatenate([self._open, self._leave((new >> U64(32)).astype(np.int64), (new & U64(0xFFFFFFFF)).astype(np.int64))])
            at = self._pairs.find(keys)
        return self._open[at]

    def _leave(self, last: np.ndarray, token: np.ndarray) -> np.ndarray:
        """_leaves() of each pair: whether no segment of the one state has lost an arc that the other's was made from."""
        (into_at, into, into_until), (made_at, made, made_until) = self._into, self._made
        wide, tall = into_at[last + 1] - into_at[last], made_at[token + 1] - made_at[token]
        n = wide * tall
        pair = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        a, b = into_at[last][pair] + k // tall[pair], made_at[token][pair] + k % tall[pair]
        at = self._gadgets.find(into[a] | made[b])
        hit = np.flatnonzero(at >= 0)
        merge = self._merge[at[hit]]
        out = np.ones(len(n), bool)
        out[pair[hit[(merge < into_until[a[hit]]) & (merge < made_until[b[hit]])]]] = False
        return out

    def _longest_of(self, buf: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """_longest() in each span of buf."""
        node = self._first[buf[at]].astype(np.int64)
        which = np.flatnonzero((node > 0) & (at + 1 < end))
        k = 1
        while len(which):
            found = self._trie.find(node[which].astype(U64) << U64(8) | buf[at[which] + k].astype(U64))
            which = which[found >= 0]
            node[which] = found[found >= 0] + 1
            k += 1
            which = which[at[which] + k < end[which]]
        token = self._ends[node]
        if len(token) and token.min() < 0:
            raise ValueError("the alphabet lacks a byte of the word")
        return token

    def encode_spans(self, buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
        """encode() of each span of 1 to 64 bytes: the ids one after another, and how many each has."""
        made = [self._in_step(buf, starts[i : i + most], sizes[i : i + most]) for i in range(0, len(starts), most)]
        return np.concatenate([ids for ids, _ in made] or [np.zeros(0, np.uint32)]), np.concatenate([n for _, n in made] or [np.zeros(0, np.int64)])

    def _in_step(self, buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(starts)
        out = np.zeros((n, int(sizes.max(initial=0))), np.uint32)
        count, at, closed = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, U64)  # bit i: place i + 1 leads nowhere
        token = self._longest_of(buf, starts, starts + sizes)
        go = np.arange(n)
        while len(go):
            while len(back := go[token[go] < 0]):
                closed[back] |= U64(1) << (at[back] - 1).astype(U64)
                count[back] -= 1
                taken = out[back, count[back]].astype(np.int64)
                at[back] -= self._sizes[taken]
                token[back] = self._shorter[taken]
            arc = token[go]
            stop = at[go] + self._sizes[arc]
            fits = (closed[go] >> (stop - 1).astype(U64)) & U64(1) == 0
            inner = np.flatnonzero(fits & (count[go] > 0))
            fits[inner] = self._arcs(out[go[inner], count[go[inner]] - 1].astype(np.int64), arc[inner])
            token[go[~fits]] = self._shorter[arc[~fits]]
            on = go[fits]
            out[on, count[on]] = arc[fits]
            count[on] += 1
            at[on] = stop[fits]
            on = on[at[on] < sizes[on]]
            token[on] = self._longest_of(buf, starts[on] + at[on], starts[on] + sizes[on])
            go = go[at[go] < sizes[go]]
        return out[np.arange(out.shape[1]) < count[:, None]], count

    def _leaves(self, last: int, token: int) -> bool:
        taken = self.taken
        for a, until_a in self.into[last]:
            for b, until_b in self.made[token]:
                at = taken.get(a | b)
                if at is not None and at < until_a and at < until_b:
                    return False
        return True

    def arc(self, last: int, token: int) -> bool:
        """Whether the arc `token` leaves the state that `last` leads to."""
        known = self._follows.get(last << 32 | token)
        if known is None:
            if len(self._follows) > 1_000_000:
                self._follows.clear()
            known = self._follows[last << 32 | token] = self._leaves(last, token)
        return known

    def _longest(self, word: bytes, at: int) -> int:
        arcs = self.arcs
        for end in range(at + min(len(word) - at, self.reach.get(word[at : at + 2], 1)), at, -1):
            if (token := arcs.get(word[at:end])) is not None:
                return token
        raise ValueError("the alphabet lacks a byte of the word")

    def encode(self, word: bytes) -> list[int]:
        """The ids on the one accepted path that spells the word."""
        if (whole := self.arcs.get(word)) is not None:
            return [whole]
        labels, shorter, follows = self.labels, self.shorter, self._follows
        out: list[int] = []
        closed: set[int] = set()
        at, n = 0, len(word)
        while at < n:
            token = self._longest(word, at)
            while True:
                if out:
                    last = out[-1]
                    while token >= 0:
                        fits = follows.get(last << 32 | token)
                        if fits is None:
                            fits = self.arc(last, token)
                        if fits and not (closed and at + len(labels[token]) in closed):
                            break
                        token = shorter[token]
                else:
                    while token >= 0 and closed and at + len(labels[token]) in closed:
                        token = shorter[token]
                if token >= 0:
                    break
                closed.add(at)
                token = out.pop()
                at -= len(labels[token])
                token = shorter[token]
            out.append(token)
            at += len(labels[token])
        return out


class Splitter:
    """Cuts UTF-8 text into words as the pattern of byte-level BPE does.

    That pattern is `'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`.
    """

    def __init__(self):
        first = np.frombuffer("".join(map(unicodedata.category, map(chr, range(0x110000)))).encode(), np.uint8)[::2]
        of = np.select([first == ord("L"), first == ord("N")], [LETTER, NUMBER], OTHER).astype(np.uint8)
        for ranges, kind in ((LATER_LETTERS, LETTER), (LATER_NUMBERS, NUMBER)):
            for a, b in ranges:
                of[a : b + 1] = kind
        of[WHITE_SPACE] = SPACE
        self.of = of

    def starts(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Where words start in buf, which holds documents one after another from the places off on."""
        if not len(buf):
            return np.zeros(0, np.int64)
        if buf.max() < 0x80:
            at, kind = None, self.of[buf]
        else:
            at = np.flatnonzero((buf & 0xC0) != 0x80)
            kind = self.of[self._code_points(buf, at)]
        n = len(kind)
        first = np.zeros(n + 1, bool)  # of each document
        first[off if at is None else np.searchsorted(at, off)] = True
        byte = buf if at is None else buf[at]
        space = kind == SPACE
        blank = byte == 0x20
        before = np.empty_like(kind)
        before[0] = OTHER
        before[1:] = kind[:-1]
        after_space = np.zeros(n, bool)
        after_space[1:] = space[:-1]
        after_space &= ~first[:-1]
        after_blank = np.zeros(n, bool)
        after_blank[1:] = blank[:-1]
        after_blank &= ~first[:-1]
        ahead = np.zeros(n, bool)  # a character that isn't space comes next
        ahead[:-1] = ~space[1:]
        ahead &= ~first[1:]
        start = np.where(space, ~after_space | ahead, np.where(after_space, ~after_blank, kind != before)) | first[:-1]
        quotes = np.flatnonzero((byte == 0x27) & start)
        if len(quotes):
            self._contract(byte, kind, first, start, quotes)
        found = np.flatnonzero(start)
        return found if at is None else at[found]

    @staticmethod
    def _contract(byte: np.ndarray, kind: np.ndarray, first: np.ndarray, start: np.ndarray, quotes: np.ndarray) -> None:
        n = len(byte)
        for tail in (c[1:] for c in CONTRACTIONS):
            size = len(tail) + 1
            fits = quotes[quotes + size <= n]
            for k, b in enumerate(tail, 1):
                fits = fits[(byte[fits + k] == b) & ~first[fits + k]]
            start[fits + 1] = False
            if size == 3:
                start[fits + 2] = False
            start[fits[fits + size < n] + size] = True
            # the character after a contraction begins a word; a blank or space run there is as it was

    @staticmethod
    def _code_points(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
        lead = buf[at]
        out = lead.astype(np.int32)
        beyond = np.flatnonzero(lead >= 0xC0)
        padded = np.concatenate([buf, np.zeros(4, np.uint8)]) if len(beyond) else None
        for low, high, bits, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0xF8, 0x07, 3)):
            which = beyond[(lead[beyond] >= low) & (lead[beyond] < high)]
            if len(which):
                value = out[which] & bits
                for k in range(1, more + 1):
                    value = (value << 6) | (padded[at[which] + k] & 0x3F)
                out[which] = value
        return np.minimum(out, 0x10FFFF)


class Codec:
    """Encodes documents with the automaton of a vocabulary file, and decodes ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        letters = byte_letters()
        spell = lambda s: bytes(letters[c] for c in s)
        self.special = {x["content"].encode(): x["id"] for x in told.get("added_tokens", [])}
        vocab = {spell(w): i for w, i in told["model"]["vocab"].items() if w.encode() not in self.special}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"])
        self.automaton = Automaton(vocab, [(spell(a), spell(b)) for a, b in pairs])
        labels = self.automaton.labels
        labels += [b""] * (max([0, *self.special.values()]) + 1 - len(labels))
        for word, i in self.special.items():
            labels[i] = word
        self.label_size = np.array([len(x) for x in labels])
        self.label_at = np.cumsum(self.label_size) - self.label_size
        self.label_pool = np.frombuffer(b"".join(labels), np.uint8)
        self.splitter = Splitter()
        self._forget()

    def _forget(self) -> None:
        self.words = Numbered()  # hashes of remembered words
        #: For each of them, where its ids begin in the pool and how many it has, where it is spelt and how many bytes it has.
        self.place, self.size, self.spelt_at, self.bytes = (np.zeros(1 << 12, np.int64) for _ in range(4))
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        #: The words themselves, eight bytes a number.
        self.spelt, self.spelt_used = np.zeros(1 << 16, U64), 0

    @staticmethod
    def _room(pool: np.ndarray, used: int, more: int) -> np.ndarray:
        while used + more > len(pool):
            pool = np.concatenate([pool, np.zeros_like(pool)])
        return pool

    def _pooled(self, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Where ids of words now stand in the pool, beyond what is in use."""
        self.pool = self._room(self.pool, self.used, len(ids))
        self.pool[self.used : self.used + len(ids)] = ids
        return self.used + np.cumsum(size) - size

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """_pooled() of words encoded one by one, and how many ids each has."""
        made = [self.automaton.encode(w) for w in words]
        size = np.fromiter(map(len, made), np.int64, len(made))
        flat = np.fromiter((i for ids in made for i in ids), np.uint32, int(size.sum()))
        return self._pooled(flat, size), size

    def _learn(self, keys: np.ndarray, buf: np.ndarray, parts: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Remember new words of up to REMEMBERED_BYTES bytes, whose keys are unknown and all different."""
        ids, size = self.automaton.encode_spans(buf, starts, sizes)
        place = self._pooled(ids, size)
        self.used += len(ids)
        numbers = (sizes + 7) >> 3
        spelt_at = self.spelt_used + np.cumsum(numbers) - numbers
        self.spelt = self._room(self.spelt, self.spelt_used, int(numbers.sum()))
        for k in range(int(numbers.max(initial=0))):
            which = np.flatnonzero(numbers > k)
            self.spelt[spelt_at[which] + k] = span_part(parts, starts[which], sizes[which], k)
        self.spelt_used += int(numbers.sum())
        n = self.words.n
        self.place, self.size, self.spelt_at, self.bytes = (self._room(a, n, len(keys)) for a in (self.place, self.size, self.spelt_at, self.bytes))
        for told, new in ((self.place, place), (self.size, size), (self.spelt_at, spelt_at), (self.bytes, sizes)):
            told[n : n + len(keys)] = new
        self.words.add(keys)

    def _is(self, at: np.ndarray, parts: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether each span is, to the byte, the remembered word at that place."""
        same = self.bytes[at] == sizes
        which, k = np.flatnonzero(same), 0
        while len(which):
            equal = self.spelt[self.spelt_at[at[which]] + k] == span_part(parts, starts[which], sizes[which], k)
            same[which[~equal]] = False
            k += 1
            which = which[equal & (sizes[which] > 8 * k)]
        return same

    def encode_plain(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents one after another, and how many each has; no special token is looked for.

        A word is looked up by its hash and taken only if its bytes are those of the word remembered; other words, and
        those longer than REMEMBERED_BYTES, are encoded on their own.
        """
        starts = self.splitter.starts(buf, off)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        ends = np.append(starts[1:], len(buf))
        sizes = ends - starts
        parts = eights(buf)
        short = np.flatnonzero(sizes <= REMEMBERED_BYTES)
        keys = span_hashes(buf, starts[short], ends[short])
        if self.words.n > REMEMBERED:
            self._forget()
        at = self.words.find(keys)
        if len(new := np.flatnonzero(at < 0)):
            unique, first = np.unique(keys[new], return_index=True)
            which = short[new[first]]
            self._learn(unique, buf, parts, starts[which], sizes[which])
            at[new] = self.words.find(keys[new])
        size, place = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        own = np.ones(len(starts), bool)
        size[short], place[short] = self.size[at], self.place[at]
        own[short] = ~self._is(at, parts, starts[short], sizes[short])
        if own.any():
            which = np.flatnonzero(own)
            data = buf.tobytes()
            words = [data[a:b] for a, b in zip(starts[which].tolist(), ends[which].tolist(), strict=True)]
            each = {w: i for i, w in enumerate(dict.fromkeys(words))}
            own_place, own_size = self._encoded(list(each))
            at = np.fromiter((each[w] for w in words), np.int64, len(words))
            size[which], place[which] = own_size[at], own_place[at]
        stops = np.cumsum(size)
        ids = self.pool[np.repeat(place - (stops - size), size) + np.arange(int(stops[-1]))]
        upto = np.concatenate([[0], stops])[np.searchsorted(starts, off)]
        if len(self.pool) > 2 * self.used + (1 << 22):  # long words have stretched it
            self.pool = self.pool[: self.used + (1 << 16)].copy()
        return ids, np.diff(upto)

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As encode_plain, with special tokens' strings in a text encoded as these tokens."""
        data = buf.tobytes() if len(buf) else b""
        marks = sorted((at, word) for word in self.special for at in _places(data, word))
        if not marks:
            return self.encode_plain(buf, off)
        # cut at the marks: the pieces between are documents of their own for the splitter
        cuts, kinds, doc_of = [], [], []
        bounds = off.tolist()
        m = 0
        for d in range(len(bounds) - 1):
            here, end = bounds[d], bounds[d + 1]
            while m < len(marks) and marks[m][0] < end:
                at, word = marks[m]
                m += 1
                if at < here or at + len(word) > end:
                    continue
                cuts += [(here, at), (at, at + len(word))]
                kinds += [None, self.special[word]]
                doc_of += [d, d]
                here = at + len(word)
            cuts.append((here, end))
            kinds.append(None)
            doc_of.append(d)
        edges = np.array([a for a, _ in cuts] + [bounds[-1]], np.int64)
        ids, counts = self.encode_plain(buf, edges)
        at = np.cumsum(counts) - counts
        parts, sizes = [], []
        for k, kind in enumerate(kinds):
            part = ids[at[k] : at[k] + counts[k]] if kind is None else np.array([kind], np.uint32)
            parts.append(part)
            sizes.append(len(part))
        total = np.zeros(len(off) - 1, np.int64)
        np.add.at(total, np.array(doc_of), np.array(sizes))
        return np.concatenate(parts), total

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The labels of the arcs with these ids one after another, and where in them each label ends."""
        size = self.label_size[ids]
        ends = np.cumsum(size)
        return self.label_pool[np.repeat(self.label_at[ids] - (ends - size), size) + np.arange(int(size.sum()))], ends


def _places(data: bytes, word: bytes) -> Iterator[int]:
    at = data.find(word)
    while at >= 0:
        yield at
        at = data.find(word, at + len(word))


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """This process's codec for a vocabulary file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encoded(column: pa.Array, path: str, most: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of each slice of a column of texts: its first row, the one after its last, the ids, and how many each text has."""
    coder = codec(path)
    off, buf = raw_text(column)
    for i, j in slices(off, most):
        yield i, j, *coder.encode(buf[off[i] : off[j]], off[i : j + 1] - off[i])


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of each text and the text decoded from them: doc_id, ids array<int>, decoded.

    One row per row, repeated rows and rows without an id too; a null or empty text has no ids and decodes to ''.
    Other columns of docs are left out, whatever their names.  Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            for i, j, ids, counts in encoded(batch.column(1), path):
                stops = np.concatenate([[0], np.cumsum(counts)])
                text, ends = coder.decode(ids)
                edges = np.concatenate([[0], ends])[stops]
                data = text.tobytes()
                decoded = pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), pa.array(ids.view(np.int32))), decoded], names=["doc_id", "ids", "decoded"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode_decode() reduced to digests within the same task: doc_id, n_tokens, ids_sha256, decoded_sha256.

    ids_sha256 is that of the ids as little-endian unsigned 32-bit integers.  Rows are as in encode_decode().
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            for i, j, ids, counts in encoded(batch.column(1), path):
                stops = np.concatenate([[0], np.cumsum(counts)])
                text, ends = coder.decode(ids)
                edges = np.concatenate([[0], ends])[stops].tolist()
                sha = lambda data, at: pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)], pa.string())
                columns = [batch.column(0).slice(i, j - i), pa.array(counts, pa.int64()), sha(memoryview(ids.astype("<u4").tobytes()), (4 * stops).tolist()), sha(memoryview(np.ascontiguousarray(text)), edges)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

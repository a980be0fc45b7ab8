"""Byte-level BPE: speculate with greedy longest matches, verify adjacent pairs in numpy, merge exactly what fails.

A sequence of tokens is what the merges make of a word if and only if each token is what the merges make of its own
bytes and each adjacent pair is compatible, that is no earlier merge would cross the border between its two tokens.
Words that a worker hasn't met yet are worked on together: the longest token at every byte is looked up for all of them
at once, all adjacent pairs are checked at once, and words that fail are merged in step, one merge of each a round.
Long words are merged one by one with a heap.

Null texts count as empty (no ids). Texts of any length take linear time, words of any length n log n.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from bandweave.llm.common import arrow_pass

# Fixed value: the characters with the Unicode property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
# Fixed value: the vocabulary's published split pattern.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The letters and numbers of Latin-1, for texts within it.
LATIN = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
LATIN_NUMBERS = "0-9²³¹¼½¾"
SPLIT_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[{LATIN_NUMBERS}]+| ?[^{WHITE}{LATIN}{LATIN_NUMBERS}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
SPLIT_ANY = regex.compile(SPLIT)
#: Words kept by a worker, and the longest ones that are kept.
CACHE, CACHE_CHARS = 600_000, 48
#: Words of up to so many bytes are worked on together.
SHORT = 40


def pieces(text: str) -> list[str]:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return SPLIT_ANY.findall(text)
    return SPLIT_LATIN.findall(text)


class Lookup:
    """A hash table from non-negative integers to small ones that numpy arrays are looked up in; -1 where none is."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = int(len(keys) * 6).bit_length()
        self.keys = np.full((1 << self.bits) + 64, -1, np.int64)
        self.values = np.full((1 << self.bits) + 64, -1, np.int32)
        left = np.arange(len(keys))
        at = self.slot(keys)
        while len(left):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[left[free]]  # of several for one slot, the last stays
            stayed = self.keys[at] == keys[left]
            self.values[at[stayed]] = values[left[stayed]]
            left, at = left[~stayed], at[~stayed] + 1

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.slot(keys)
        found, out = self.keys[at], self.values[at]
        miss = np.flatnonzero(found != keys)
        out[miss] = -1
        miss = miss[found[miss] >= 0]
        while len(miss):
            at[miss] += 1
            found = self.keys[at[miss]]
            hit = found == keys[miss]
            out[miss[hit]] = self.values[at[miss[hit]]]
            miss = miss[~hit & (found >= 0)]
        return out


def byte_letters() -> dict[str, int]:
    """The printable letters by which such vocabulary files write bytes: printable bytes as themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """Encodes and decodes with the vocabulary in a tokenizers file of a byte-level BPE whose ids ascend with the merges."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for s, i in vocab.items():
            self.bytes[i] = raw(s)
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        self.ids = {self.bytes[i]: i for i in vocab.values()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.pairs = {(vocab[a], vocab[b]): vocab[a + b] for a, b in merges}
        if any(i >= j for i, j in zip(self.pairs.values(), [*self.pairs.values()][1:])):
            raise ValueError("the ids of the vocabulary don't ascend with its merges")
        n = len(self.bytes)
        self.left, self.right = np.arange(n), np.arange(n)  # a token's two halves; itself for single bytes
        for (a, b), c in self.pairs.items():
            self.left[c], self.right[c] = a, b
        self.pair = Lookup(np.array([a * n + b for a, b in self.pairs], np.int64), np.array([*self.pairs.values()], np.int64))
        self.size = np.array([*map(len, self.bytes)])
        self.single = np.array([self.ids[bytes((b,))] for b in range(256)])
        # what tokens begin with, and of what is a token itself its id; beginnings alone have the number n
        begun = {t[:k]: n for t in self.ids if len(t) <= SHORT for k in range(1, len(t))} | {t: i for t, i in self.ids.items() if len(t) <= SHORT}
        self.begun = Lookup(self.keys([*begun]), np.array([*begun.values()]))
        self.own: dict[int, bool] = {}
        self.text = [str(i) for i in range(n)]
        self.kept: dict[str, bytes] = {}  # ids as little-endian unsigned 32-bit integers
        self.words = self.failed = 0

    @staticmethod
    def grown(keys: np.ndarray, byte: np.ndarray, length: int) -> np.ndarray:
        """Keys of byte strings from those of one byte less: the bytes themselves up to six, a hash of them beyond."""
        if length <= 6:
            return keys * 256 + byte + (1 << 48)
        return (keys * np.int64(0x2545F4914F6CDD1D) + byte + length) & np.int64(0x7FFFFFFFFFFFFFFF)

    def keys(self, strings: list[bytes]) -> np.ndarray:
        sizes = np.array([*map(len, strings)])
        flat = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64)
        starts, keys = np.cumsum(sizes) - sizes, np.zeros(len(strings), np.int64)
        for length in range(1, sizes.max(initial=0) + 1):
            on = np.flatnonzero(sizes >= length)
            keys[on] = self.grown(keys[on], flat[starts[on] + length - 1], length)
        return keys

    # speculation

    def greedy(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The longest token first, for words of up to SHORT bytes: all tokens, and the word that each is of."""
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        ends = np.cumsum([*map(len, words)])
        starts = np.concatenate([[0], ends[:-1]])
        n, tokens, owners, at, owner = len(self.bytes), [], [], starts, np.arange(len(words))
        while len(at):
            best, size, room = np.zeros(len(at), np.int64), np.ones(len(at), np.int64), ends[owner] - at
            on, keys = np.arange(len(at)), np.zeros(len(at), np.int64)
            for length in range(1, SHORT + 1):
                keys = self.grown(keys, flat[at[on] + length - 1], length)
                found = self.begun(keys)
                hit = (found >= 0) & (found < n)
                best[on[hit]], size[on[hit]] = found[hit], length
                more = (found >= 0) & (room[on] > length)
                on, keys = on[more], keys[more]
                if not len(on):
                    break
            tokens.append(best)
            owners.append(owner)
            at = at + size
            left = at < ends[owner]
            at, owner = at[left], owner[left]
        tokens, owners = np.concatenate(tokens), np.concatenate(owners)
        order = np.argsort(owners, kind="stable")
        return tokens[order], owners[order]

    # verification

    def compatible(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """For each pair of tokens: whether the merges of both together give the two. Undoes merges at the border, latest first."""
        n, ok = len(self.bytes), np.ones(len(one), bool)
        at = np.arange(len(one))
        one, two, limit = one.astype(np.int64), two.astype(np.int64), np.full(len(one), n, np.int64)
        while len(at):
            made = self.pair(one * n + two)
            crossing = (made >= 0) & (made < limit)
            ok[at[crossing]] = False
            first = one > two  # which of both was merged last
            half_one, half_two = self.right[one], self.left[two]
            leaf_one, leaf_two = half_one == one, half_two == two
            # undo the later merge, or the other one where the later is a single byte; both single: nothing is left to undo
            undo_one = np.where(first, ~leaf_one, leaf_two & ~leaf_one)
            undo_two = np.where(first, leaf_one & ~leaf_two, ~leaf_two)
            limit = np.where(undo_one, one, np.where(undo_two, two + 1, limit))
            one, two = np.where(undo_one, half_one, one), np.where(undo_two, half_two, two)
            on = ~crossing & (undo_one | undo_two)
            at, one, two, limit = at[on], one[on], two[on], limit[on]
        return ok

    def stands(self, token: int) -> bool:
        """Whether the merges make the token of its own bytes."""
        if (known := self.own.get(token)) is None:
            known = self.own[token] = self.merged(self.bytes[token]) == [token]
        return known

    # exact merging

    def merged(self, word: bytes) -> list[int]:
        tokens: list[int] = [self.ids[bytes((b,))] for b in word]
        n, pairs = len(tokens), self.pairs
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(to, k, a, b) for k, (a, b) in enumerate(zip(tokens, tokens[1:])) if (to := pairs.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            to, k, a, b = heapq.heappop(heap)
            j = after[k]
            if tokens[k] != a or j >= n or tokens[j] != b:
                continue
            tokens[k], tokens[j] = to, -1
            after[k] = after[j]
            if after[j] < n:
                before[after[j]] = k
            if (i := before[k]) >= 0 and (up := pairs.get((tokens[i], to))) is not None:
                heapq.heappush(heap, (up, i, tokens[i], to))
            if after[k] < n and (up := pairs.get((to, tokens[after[k]]))) is not None:
                heapq.heappush(heap, (up, k, to, tokens[after[k]]))
        return [t for t in tokens if t >= 0]

    def merged_together(self, words: list[bytes]) -> list[bytes]:
        """Words of one length each round: the earliest merge of each, the leftmost of equal ones."""
        out = [b""] * len(words)
        n, lengths = len(self.bytes), np.array([*map(len, words)])
        for length in np.unique(lengths):
            own = np.flatnonzero(lengths == length)
            tokens = self.single[np.frombuffer(b"".join([words[k] for k in own]), np.uint8).reshape(len(own), length)]
            ups = self.ups(tokens[:, :-1], tokens[:, 1:])
            while len(own):
                left = ups.min(axis=1, initial=n)
                if len(ended := np.flatnonzero(left == n)):
                    raw, width = tokens[ended].astype("<u4").tobytes(), 4 * tokens.shape[1]
                    for j, k in enumerate(own[ended].tolist()):
                        out[k] = raw[j * width : (j + 1) * width]
                    on = left < n
                    own, tokens, ups, left = own[on], tokens[on], ups[on], left[on]
                    if not len(own):
                        break
                row, at = np.arange(len(own)), ups.argmin(axis=1)
                tokens[row, at] = left
                columns = np.arange(tokens.shape[1] - 1)
                tokens = np.take_along_axis(tokens, columns + (columns > at[:, None]), 1)
                columns = columns[:-1]
                ups = np.take_along_axis(ups, columns + (columns >= at[:, None]), 1)
                some = np.flatnonzero(at > 0)
                ups[some, at[some] - 1] = self.ups(tokens[some, at[some] - 1], tokens[some, at[some]])
                some = np.flatnonzero(at < ups.shape[1])
                ups[some, at[some]] = self.ups(tokens[some, at[some]], tokens[some, at[some] + 1])
        return out

    def ups(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """What pairs merge to; more than any token where they don't."""
        made = self.pair((one * len(self.bytes) + two).ravel()).reshape(one.shape)
        return np.where(made < 0, len(self.bytes), made)

    # all of it

    def encoded(self, words: list[bytes]) -> list[bytes]:
        short = [k for k, w in enumerate(words) if len(w) <= SHORT]
        out = [np.array(self.merged(w), "<u4").tobytes() if len(w) > SHORT else b"" for w in words]
        if not short:
            return out
        some = [words[k] for k in short]
        tokens, owners = self.greedy(some)
        good = np.ones(len(some), bool)
        kinds, where = np.unique(tokens, return_inverse=True)
        good[owners[~np.array([self.stands(int(t)) for t in kinds])[where]]] = False
        same = np.flatnonzero(owners[1:] == owners[:-1])
        good[owners[same[~self.compatible(tokens[same], tokens[same + 1])]]] = False
        bounds = np.searchsorted(owners, np.arange(len(some) + 1))
        for j in np.unique(owners[self.size[tokens] > 6]).tolist():  # such tokens were found by a hash
            good[j] &= b"".join(map(self.bytes.__getitem__, tokens[bounds[j] : bounds[j + 1]].tolist())) == some[j]
        raw, ends = tokens.astype("<u4").tobytes(), (4 * bounds).tolist()
        for j in np.flatnonzero(good).tolist():
            out[short[j]] = raw[ends[j] : ends[j + 1]]
        bad = np.flatnonzero(~good).tolist()
        for j, ids in zip(bad, self.merged_together([some[j] for j in bad])):
            out[short[j]] = ids
        self.words += len(some)
        self.failed += len(bad)
        return out

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """Each text's ids. Strings of special tokens become their ids, as the library does by default."""
        cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        parts: list[list[list[str] | int]] = []
        for text in texts:
            text = text or ""
            segments = cut.split(text) if cut and any(s in text for s in self.special) else [text]
            parts.append([self.special[s] if s in self.special else pieces(s) for s in segments])
        kept = self.kept
        if len(kept) > CACHE:
            kept.clear()
        new: set[str] = set()
        for p in parts:
            for s in p:
                if not isinstance(s, int):
                    new.update(s)
        words = [w for w in new if w not in kept]
        kept.update(zip(words, self.encoded([w.encode() for w in words])))
        get = kept.__getitem__
        whole = lambda p: b"".join([s.to_bytes(4, "little") if isinstance(s, int) else b"".join(map(get, s)) for s in p])
        out = [np.frombuffer(whole(p), "<u4") for p in parts]
        for w in words:
            if len(w) > CACHE_CHARS:
                del kept[w]
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids, special tokens included; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One per worker and file."""
    return Codec(path)


def encode(df: DataFrame, path: str, text: str = "text", to: str = "ids") -> DataFrame:
    """df with its texts' ids in a new column: array<int>, empty for null and empty texts. A column of that name is replaced."""
    df = df.drop(to)
    schema = df.selectExpr("*", f"cast(null as array<int>) as `{to}`").schema

    def work(parts: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for p in parts:
            yield p | {to: [x.astype(np.int32) for x in codec(path).encode(p[text])]}

    return arrow_pass(df, work, schema, 200)


def decode(df: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """df with the text of its ids in a new column; null ids give an empty text. A column of that name is replaced."""
    df = df.drop(to)
    schema = df.selectExpr("*", f"cast(null as string) as `{to}`").schema

    def work(parts: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for p in parts:
            yield p | {to: [codec(path).decode(x or ()) for x in p[ids]]}

    return arrow_pass(df, work, schema, 200)

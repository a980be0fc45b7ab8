"""Words and shingles of many texts hashed at once in numpy: words by polynomials over their bytes, shingles from words."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_STEPS = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_powers: dict[str, np.ndarray] = {}
#: Which bytes belong to words: all but ASCII white space; or letters, digits and whatever isn't ASCII.
NOT_SPACE = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])
ALPHANUMERIC = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64; kept by the worker, as long as its longest batch asked for."""
    if len(_powers.get("up", ())) < size:
        for name, x in (("up", _BASE), ("back", pow(_BASE, -1, 1 << 64))):
            row = np.full(size, x, np.uint64)
            row[0] = 1
            _powers[name] = np.multiply.accumulate(row)
    return _powers["up"], _powers["back"]


def hashed_words(texts: list[str | None], word: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased) in turn; from which to which each text's words go (n + 1 numbers); and where
    each word starts and ends in its text's UTF-8 bytes."""
    raw = [(t or "").encode().lower() for t in texts]  # bytes.lower() changes A to Z alone
    flat = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    inside = word[flat]
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0))  # the last byte is a line feed: starts and ends take turns
    starts, ends = edge[::2], edge[1::2]
    up, back = powers(len(flat) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up[: len(flat)], dtype=np.uint64)])
    hashes = stirred((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    begins = np.cumsum([0, *(len(r) + 1 for r in raw)])
    bounds = np.searchsorted(starts, begins)
    own = np.repeat(begins[:-1], np.diff(bounds))
    return hashes, bounds, starts - own, ends - own


def shingled(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words (of all words, if there are fewer), in turn."""
    k = min(n, len(words))
    if not k:
        return np.zeros(0, np.int64)
    made = np.full(len(words) - k + 1, k, np.uint64)
    for j in range(k):
        made = made * _STEPS[j % len(_STEPS)] + words[j : len(words) - k + 1 + j]
    return stirred(made).view(np.int64)

"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Words are runs of letters and digits, A-Z lower-cased; shingles have five of them (a shorter template is one shingle).
A template of s shingles belongs to the level of blocks of B shingles, the least power of two from LEAST_BLOCK on that is
not below s. Windows of a level are all pairs of neighbouring blocks, so that every run of s shingles lies in one. Each
window and template has BANDS minima, each a band of its own: a window that holds three quarters of a template (all of
one of up to three shingles) has a Jaccard index of at least 1/8 with it, and shares a band with a probability of
1 - (7/8)^64 > 0.9998 at least. What shares one is verified: the share of the template's distinct shingles that the
window holds must be CONTAINED at least.

A match is the part of the text from the first to the last word of such shingles in a window; overlapping matches of one
template are one. Null and empty texts match nothing. Whole texts are read, rows are worked on one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np
from pyspark.sql import DataFrame

from bandweave.llm.common import arrow_pass
from bandweave.llm.shingles import ALPHANUMERIC, hashed_words, shingled

N, BANDS, LEAST_BLOCK, CONTAINED = 5, 64, 4, 0.75

# Notices of well-known licenses.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "apache-2.0-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "mit": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

_RNG = np.random.default_rng(11)
_FACTORS = _RNG.integers(1, 1 << 63, BANDS, np.uint64) * np.uint64(2) + np.uint64(1)


def minima(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The least of each of BANDS hashes over shingles from each start to the next: an array of bands by blocks."""
    out = np.empty((BANDS, len(starts)), np.uint32)
    x = shingles.view(np.uint64)
    for k, factor in enumerate(_FACTORS):
        out[k] = np.minimum.reduceat(((x * factor) >> np.uint64(32)).astype(np.uint32), starts)
    return out


class Templates:
    def __init__(self, texts: tuple[tuple[str, str], ...], n: int = N) -> None:
        self.names, self.n = [name for name, _ in texts], n
        words, bounds, _, _ = hashed_words([t for _, t in texts], ALPHANUMERIC)
        self.sets = [np.unique(shingled(words[a:b], n)) for a, b in zip(bounds[:-1], bounds[1:])]
        if not all(map(len, self.sets)):
            raise ValueError("a template has no words")
        self.short = sorted({int(b - a) for a, b in zip(bounds[:-1], bounds[1:]) if b - a < n})
        if self.short:
            raise ValueError(f"templates need {n} words at least")
        self.levels: dict[int, list[int]] = {}
        for k, s in enumerate(self.sets):
            block = LEAST_BLOCK
            while block < len(s):
                block *= 2
            self.levels.setdefault(block, []).append(k)
        self.bands = [minima(s, np.zeros(1, np.int64))[:, 0] for s in self.sets]

    def windows(self, count: int, block: int) -> list[tuple[int, int]]:
        """From which to which shingle the windows of a text of so many go."""
        blocks = -(-count // block)
        return [(k * block, min(count, (k + 2) * block)) for k in range(max(1, blocks - 1))] if count else []

    def retrieved(self, shingles: list[np.ndarray]) -> list[tuple[int, int, int]]:
        """(text, window, template) of all that share a band, of texts given by their shingles."""
        found: list[tuple[int, int, int]] = []
        texts = [k for k, s in enumerate(shingles) if len(s)]
        if not texts:
            return found
        flat = np.concatenate([shingles[k] for k in texts])
        counts = np.array([len(shingles[k]) for k in texts])
        block, least = 0, None
        for level in sorted({2**j for j in range(LEAST_BLOCK.bit_length() - 1, max(self.levels).bit_length())}):
            if least is None:
                block = level
                blocks = -(-counts // block)
                first = np.repeat(np.cumsum(counts) - counts, blocks)
                within = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                least = minima(flat, first + within * block)
            else:  # blocks of twice the size
                more = -(-blocks // 2)
                first = np.repeat(np.cumsum(blocks) - blocks, more)
                within = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
                least = np.minimum.reduceat(least, first + within * 2, axis=1)
                block, blocks = level, more
            if level not in self.levels:
                continue
            owner = np.repeat(np.arange(len(texts)), blocks)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            both = least.copy()
            same = np.flatnonzero(owner[1:] == owner[:-1])
            both[:, same] = np.minimum(least[:, same], least[:, same + 1])
            window = (place < blocks[owner] - 1) | (blocks[owner] == 1)
            for t in self.levels[level]:
                hits = np.flatnonzero((both == self.bands[t][:, None]).any(axis=0) & window)
                found += [(texts[owner[h]], int(place[h]), t) for h in hits]
        return found

    def verified(self, shingles: np.ndarray, block: int, window: int, template: int) -> tuple[int, int, float] | None:
        """First and last shingle of the template in the window and the share it holds, if that is enough."""
        a, b = self.windows(len(shingles), block)[window]
        held = np.isin(shingles[a:b], self.sets[template])
        share = len(np.unique(shingles[a:b][held])) / len(self.sets[template])
        if share < CONTAINED:
            return None
        at = np.flatnonzero(held)
        return a + int(at[0]), a + int(at[-1]), share

    def scan(self, texts: list[str | None]) -> list[tuple[int, str, int, int, float]]:
        """(text, name, start, end, share) of all matches, start and end in code points."""
        words, bounds, starts, ends = hashed_words(texts, ALPHANUMERIC)
        shingles = [shingled(words[a:b], self.n) if b - a >= self.n else np.zeros(0, np.int64) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        level = {t: block for block, ts in self.levels.items() for t in ts}
        matches: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
        for k, window, t in self.retrieved(shingles):
            if (m := self.verified(shingles[k], level[t], window, t)) is not None:
                matches.setdefault((k, t), []).append(m)
        out = []
        for (k, t), spans in sorted(matches.items()):
            joined: list[list[Any]] = []
            for a, b, share in sorted(spans):
                if joined and a <= joined[-1][1] + self.n - 1:
                    joined[-1][1], joined[-1][2] = max(joined[-1][1], b), max(joined[-1][2], share)
                else:
                    joined.append([a, b, share])
            raw = (texts[k] or "").encode()
            for a, b, share in joined:
                start, end = starts[bounds[k] + a], ends[bounds[k] + b + self.n - 1]
                out.append((k, self.names[t], len(raw[:start].decode()), len(raw[:end].decode()), share))
        return out


@lru_cache(maxsize=4)
def prepared(texts: tuple[tuple[str, str], ...]) -> Templates:
    return Templates(texts)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, text: str = "text") -> DataFrame:
    """doc_id, license, start, end (code points, end exclusive) and contained (0.75 to 1) of every match."""
    given = tuple((templates or TEMPLATES).items())

    def work(parts: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for p in parts:
            rows = prepared(given).scan(p[text])
            yield {"doc_id": [p["doc_id"][r[0]] for r in rows], "license": [r[1] for r in rows], "start": [r[2] for r in rows], "end": [r[3] for r in rows], "contained": [r[4] for r in rows]}

    return arrow_pass(docs.select("doc_id", text), work, "doc_id bigint, license string, start bigint, end bigint, contained double", 200)

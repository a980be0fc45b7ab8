import hashlib
import math
import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from bandweave.llm import ngram_join, simhash
from bandweave.llm.components import components
from bandweave.llm.shingles import hashed_words

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall((text or "").encode().lower())
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(texts, ids):
    sets, up = [*map(shingles, texts)], list(range(len(texts)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            up[top(a)] = top(b)
    groups = {}
    for k, i in enumerate(ids):
        groups.setdefault(top(k), []).append(i)
    least = {g: min((i for i in v if i is not None), default=None) for g, v in groups.items()}
    return sorted(((i is None, i or 0, len(sets[k]), least[top(k)]) for k, i in enumerate(ids)), key=str)


def corpus(rng, n=260):
    words = ["".join(rng.choices("abcdefgh", k=3)) for _ in range(300)]
    passage = rng.choices(words, k=25)
    bases = [rng.choices(words, k=rng.randint(20, 90)) for _ in range(12)]
    texts = []
    for k in range(n):
        kind = k % 5
        if kind == 0:
            made = rng.choices(words, k=rng.randint(0, 60))
        elif kind == 1:  # a common passage
            made = rng.choices(words, k=rng.randint(0, 12)) + passage + rng.choices(words, k=rng.randint(0, 30))
        else:  # near copies
            made = [*rng.choice(bases[: 12 if kind < 4 else 1])]
            for _ in range(rng.choice([0, 0, 1, 2])):
                made[rng.randrange(len(made))] = rng.choice(words)
        texts.append(" ".join(made))
    return [*texts, None, "", " \n", "four words are here", "FOUR  words\tare here", "x", texts[0], texts[0].upper()]


@pytest.mark.parametrize("short, block, chunk", [(64, 64, 1 << 20), (3, 2, 500), (1, 1, 1)])
def test_join(docs, monkeypatch, short, block, chunk):
    """The small values make most lists long, blocks of one or two classes, and a chunk and a bucket of few documents."""
    for name, value in (("SHORT", short), ("BLOCK", block), ("CHUNK", chunk)):
        monkeypatch.setattr(ngram_join, name, value)
    open_lists = []
    settled = ngram_join.settled
    monkeypatch.setattr(ngram_join, "settled", lambda *a: open_lists.append(settled(*a)) or open_lists[-1])
    texts = corpus(random.Random(short))
    ids = [*range(len(texts) - 2), 7, None]
    rows = ngram_join.joined(docs(texts, ids, n=["c"] * len(texts), cls=["d"] * len(texts), _salt=["e"] * len(texts))).collect()
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in rows), key=str) == brute(texts, ids)
    assert short > 3 or open_lists[0] is not None


def test_links_on_long_lists_alone(docs, monkeypatch):
    """Many variants of one text, each far from the one that shares most; some of them near each other."""
    monkeypatch.setattr(ngram_join, "SHORT", 4)
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    rng = random.Random(11)
    base = [f"w{k}" for k in range(120)]
    texts = [" ".join(base)]
    for k in range(40):
        made = [*base]
        for at in rng.sample(range(30 * (k % 4), 30 * (k % 4) + 30), rng.randint(3, 5)):
            made[at] = f"v{rng.randrange(2)}"
        texts.append(" ".join(made))
    rows = ngram_join.joined(docs(texts)).collect()
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in rows), key=str) == brute(texts, range(len(texts)))


def test_join_of_nothing(docs):
    assert ngram_join.joined(docs(["a"]).limit(0)).isEmpty()
    assert [r["component_id"] for r in ngram_join.joined(docs([None], [4])).collect()] == [4]


def test_deduplicated(docs):
    a, b = "one two three four five six seven eight", "quite another text of more than five words"
    df = docs([a, a, b, None, None, b, b], [3, 1, 5, 6, 6, 5, None], lang=["x"] * 7)
    kept = sorted(((r["doc_id"], r["text"]) for r in ngram_join.deduplicated(df).collect()), key=str)
    assert kept == sorted([(1, a), (5, b), (6, None), (6, None)], key=str)
    assert ngram_join.deduplicated(df.limit(0)).isEmpty()


def test_merging_and_bounds():
    lists = [[(1, 5, 9), (4, 2, 8)], [(1, 7, 3)], [(4, 1, 9), (6, 0, 0)]]
    assert [*ngram_join.merged(lists)] == [(1, 2, 7, 9), (4, 2, 2, 9), (6, 1, 0, 0)]
    assert [*ngram_join.merged([])] == []
    for n in range(1, 60):
        for m in range(1, 60):
            fewest = next(c for c in range(200) if 100 * c >= 75 * (n + m - c))
            assert ngram_join.required(n, m) == fewest
            if fewest <= min(n, m):
                assert fewest >= ngram_join.least(max(n, m)) and ngram_join.prefix(max(n, m)) >= max(n, m) - fewest + 1 and ngram_join.indexed(min(n, m)) >= min(n, m) - fewest + 1
                assert 3 * n <= 4 * m and m <= 4 * n // 3 and m >= (3 * n + 3) // 4


def test_grades_keep_the_order():
    counts = np.unique(np.concatenate([np.arange(1, 300), 2 ** np.arange(8, 40)]))
    grades = ngram_join.graded(counts).astype(int)
    assert (np.diff(grades) >= 0).all() and (grades[:64] == np.arange(1, 65)).all() and (grades[64:] > 64).all()


def test_deduplicated_keeps_columns_of_any_name(docs):
    text = "one two three four five six seven eight"
    df = docs([text, text], [3, 1], cls=["a", "b"], _cls=["c", "d"], id=["e", "f"], of=["g", "h"], Keeper=["i", "j"], _salt=["k", "l"])
    kept = ngram_join.deduplicated(df)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(1, text, "b", "d", "f", "h", "j", "l")]


def test_words_are_hashed_as_split():
    texts = ["a b\tc", "", "A  b c", "\x0bé ", None, "a\xa0b"]
    words, bounds, starts, ends = hashed_words(texts)
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        assert [raw[a:b] for a, b in zip(starts[bounds[k] : bounds[k + 1]], ends[bounds[k] : bounds[k + 1]])] == WORD.findall(raw)
    assert (words[bounds[0] : bounds[1]] == words[bounds[2] : bounds[3]]).all() and len(np.unique(words)) == 5


def test_components(spark):
    edges = [(k, k + 1) for k in range(100, 130)] + [(5, 200), (200, 6), (7, 7), (5, 200)]
    got = {r["x"]: r["label"] for r in components(spark.createDataFrame(edges, "x bigint, y bigint")).collect()}
    assert got == {**{k: 100 for k in range(100, 131)}, 5: 5, 6: 5, 200: 5}
    assert components(spark.createDataFrame([], "x bigint, y bigint")).isEmpty()


def test_fingerprints(docs):
    rng = random.Random(6)
    texts = ["", None, "é", "a b c"] + [" ".join(rng.choices(["uno", "dos", "tres", "ñandú", "x"], k=rng.randint(1, 50))) for _ in range(40)] + ["same text here", "same text here"]
    ids = [3 * k for k in range(len(texts) - 1)] + [1]
    rows = {r["doc_id"]: r for r in simhash.chained(docs(texts, ids)).collect()}
    order = sorted(zip(ids, texts))
    assert len(rows) == len(texts)
    for (i, t), (_, after) in zip(order, [*order[1:], order[0]]):
        t, after = t or "", after or ""
        half = len(t) // 2
        new = t[: len(t) - half] + after[:half]
        r = rows[i]
        assert (r["n_chars"], r["edited"]) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert (r["fp_hi"], r["fp_lo"]) == simhash.fingerprint(t) and (r["edited_hi"], r["edited_lo"]) == simhash.fingerprint(new) and (r["next_hi"], r["next_lo"]) == simhash.fingerprint(after)
    assert simhash.chained(docs(["only"])).count() == 1 and simhash.chained(docs(["x"]).limit(0)).isEmpty()
    assert simhash.chained(docs(["a", "b", "c", "d"], [None, None, 2, 2])).count() == 4


def test_all_within_the_radius(spark):
    rng = random.Random(7)
    prints = [rng.getrandbits(128) for _ in range(40)]
    for p in prints[:30]:
        for _ in range(3):
            q = p
            for bit in rng.sample(range(128), rng.randint(0, 9)):
                q ^= 1 << bit
            prints.append(q)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p >> 64), signed(p & (1 << 64) - 1)) for p in prints], "fingerprint_hi bigint, fingerprint_lo bigint")
    whole = lambda hi, lo: (hi & (1 << 64) - 1) << 64 | lo & (1 << 64) - 1
    got = {(whole(r["q_hi"], r["q_lo"]), whole(r["c_hi"], r["c_lo"]), r["distance"]) for r in simhash.within(df.limit(60), df, radius=6).collect()}
    some = [whole(r[0], r[1]) for r in df.limit(60).collect()]
    assert got == {(a, b, (a ^ b).bit_count()) for a in set(some) for b in set(prints) if (a ^ b).bit_count() <= 6}


@pytest.mark.parametrize("more", [{}, {"split": 16, "held": 2, "block": 7}])
def test_neighbours_equal_brute_force(spark, more):
    rng = random.Random(11)
    rows, group = [], rng.getrandbits(128)
    for p in [rng.getrandbits(128) for _ in range(30)] + [group] * 150 + [0] * 5 + [(1 << 128) - 1] * 3:
        for bit in rng.sample(range(128), rng.choice([0, 1, 2, 4, 8])):
            p ^= 1 << bit
        rows.append(p)
    rows += rng.sample(rows, 40)  # repeated
    ids = [None if k % 50 == 7 else rng.randrange(1000) for k in range(len(rows))]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(i, signed(p >> 64), signed(p & (1 << 64) - 1), "x") for i, p in zip(ids, rows)], "doc_id bigint, fp_hi bigint, fp_lo bigint, salt string").repartition(3)
    whole = lambda hi, lo: (hi & (1 << 64) - 1) << 64 | lo & (1 << 64) - 1
    got = {whole(r[0], r[1]): (r[2], r[3]) for r in simhash.neighbours(simhash.prints(df, "fp_hi", "fp_lo", "doc_id % 4 = 0"), **more).collect()}
    want = {}
    for p in {p for i, p in zip(ids, rows) if i is not None and i % 4 == 0}:
        near = [i for i, q in zip(ids, rows) if (p ^ q).bit_count() <= simhash.RADIUS]
        want[p] = len(near), min((i for i in near if i is not None), default=None)
    assert got == want and max(n for n, _ in want.values()) > 20
    if not more:
        out = simhash.searched(df, asked="doc_id % 4 = 0").collect()
        key = lambda r: tuple((x is None, x or 0) for x in r)
        assert sorted(((r["doc_id"], whole(r["fp_hi"], r["fp_lo"]), r["n_within"], r["least_within"]) for r in out), key=key) == sorted(((i, p, *(want[p] if i is not None and i % 4 == 0 else (None, None))) for i, p in zip(ids, rows)), key=key)
        assert simhash.searched(df.limit(0)).isEmpty()


@pytest.mark.parametrize("text", ["one", "a b a b a b c", "A rose is a rose is a rose .", "x " * 50 + "y"])
def test_bits_are_the_votes(text):
    words = [xxhash.xxh3_64_intdigest(w) for w in text.lower().split()]
    full = (1 << 64) - 1

    def stirred(x, seed):
        x ^= seed
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & full
        x = (x ^ x >> 27) * 0x94D049BB133111EB & full
        return x ^ x >> 31

    pairs = [stirred(a * 0x9E3779B97F4A7C15 + b & full, 1) for a, b in zip(words, words[1:])]
    votes = [0.0] * 128
    for terms, weight in ((words, 1), (pairs, simhash.PAIR_WEIGHT)):
        for term in set(terms):
            hashed = b"".join(stirred(term, seed).to_bytes(8, "little") for seed in (2, 3))
            for bit in range(128):
                votes[bit] += (1 if hashed[bit // 8] >> 7 - bit % 8 & 1 else -1) * weight * (1 + math.log(terms.count(term)))
    assert min(map(abs, votes)) > 1e-4  # no tie that rounding could decide
    whole = sum((v > 0) << 127 - bit for bit, v in enumerate(votes))
    assert [x & full for x in simhash.fingerprint(text)] == [whole >> 64, whole & full]

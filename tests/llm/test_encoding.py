import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandweave.llm import bpe, packing

TEXTS = ["", None, "  ", " \n\n a  b", "don't we'll  I'M", "a<|endoftext|> b\n\n<|endoftext|>", "x" * 5000, "日本語テキスト　と 漢字", "👩‍👩‍👧 é ‍\x1c\x85a\xa0b", "١٢٣ ½ ⅷ", "\r\n\t tab", "same", "same"]


@pytest.fixture(scope="module")
def library(vocabulary):
    return pytest.importorskip("tokenizers").Tokenizer.from_file(vocabulary)


def test_codec_equals_library(vocabulary, library):
    codec, rng = bpe.Codec(vocabulary), random.Random(1)
    texts = TEXTS + ["".join(rng.choice("ab '’stlerin\n\t é1２½漢.,<|>\x1c​") for _ in range(rng.randint(0, 90))) for _ in range(1500)]
    ids = codec.encode(texts)
    assert [x.tolist() for x in ids] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [codec.decode(x.tolist()) for x in ids] == [library.decode(x.tolist(), skip_special_tokens=False) for x in ids]
    assert 0 < codec.failed < codec.words  # some guesses stand, some are merged


def test_speculation_alone(vocabulary):
    codec = bpe.Codec(vocabulary)
    words = [b"the", b" thing", b"zzzzq", b" unbelievable"]
    tokens, owners = codec.greedy(words)
    for k, w in enumerate(words):
        assert b"".join(codec.bytes[t] for t in tokens[owners == k]) == w
    exact = [codec.merged(w) for w in words]
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.merged_together(words)] == exact
    for ids in exact:
        if len(ids) > 1:
            assert codec.compatible(np.array(ids[:-1]), np.array(ids[1:])).all()


def test_compatibility_is_what_merging_says(vocabulary):
    codec, rng = bpe.Codec(vocabulary), random.Random(3)
    tokens = [t for t in rng.sample(range(256, 20000), 300) if codec.stands(t)]
    pairs = [(rng.choice(tokens), rng.choice(tokens)) for _ in range(2000)]
    said = codec.compatible(*map(np.array, zip(*pairs)))
    assert [bool(x) for x in said] == [codec.merged(codec.bytes[a] + codec.bytes[b]) == [a, b] for a, b in pairs]


def test_dataframe_round_trip(docs, vocabulary):
    df = docs(TEXTS, extra=["x"] * len(TEXTS), ids_=["y"] * len(TEXTS))
    back = bpe.decode(bpe.encode(df, vocabulary), vocabulary)
    rows = {r["doc_id"]: r for r in back.collect()}
    assert [rows[k]["decoded"] for k in range(len(TEXTS))] == [t or "" for t in TEXTS] and rows[0]["extra"] == "x"
    assert bpe.encode(df.limit(0), vocabulary).isEmpty()


def plan_holds(histogram, size):
    rows = packing.pack_histogram(histogram, size, 2)
    pieces, sequences = {}, {}
    for length, a, b, start, part, seq, offset in rows:
        for k in range(a, b):
            pieces.setdefault((length, k), []).append((start, part))
            sequences.setdefault(seq + k - a, []).append((offset, part))
    assert set(pieces) == {(n, k) for n, c in histogram.items() for k in range(c)}
    for held, most in ((pieces, None), (sequences, size)):
        for key, parts in held.items():
            at = 0
            for start, part in sorted(parts):
                assert start == at and part > 0
                at += part
            assert at == key[0] if most is None else at <= most
    return 1 - sum(n * c for n, c in histogram.items()) / (size * max(1, len(sequences)))


def test_plans():
    rng = random.Random(2)
    for _ in range(150):
        size = rng.choice([8, 64, 200])
        plan_holds({rng.randint(1, size): rng.randint(1, 40) for _ in range(rng.randint(1, 20))}, size)
    assert packing.pack_histogram({}) == []
    for hot in (1200, 100, 1025, 2048):  # one length with nearly all rows
        assert plan_holds({hot: 3000, 77: 5, 600: 9}, 2048) < 0.01
    with pytest.raises(ValueError):
        packing.pack_histogram({2049: 1})


@pytest.mark.parametrize("size", [16, 2048])
def test_packing(docs, vocabulary, library, size):
    texts = [*TEXTS, *["many words of one text " * 9] * 40]
    df = docs(texts, offset=["o"] * len(texts), length=["l"] * len(texts))
    for derive in (None, {"ids_crc32": F.crc32("ids")}):
        rows = packing.pack(df, vocabulary, size=size, derive=derive).collect()
        held, sequences = {}, {}
        for r in rows:
            ids = [*library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 1]
            raw = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
            assert r["doc_tokens"] == len(ids) and (bytes(r["ids"]) == raw if derive is None else r["ids_crc32"] == zlib.crc32(raw))
            held.setdefault(r["doc_id"], []).append((r["start"], r["length"], len(ids)))
            sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert set(held) == set(range(len(texts)))
        for parts in held.values():
            assert sum(p[1] for p in parts) == parts[0][2] and len({p[0] for p in parts}) == len(parts)
        for parts in sequences.values():
            ends = [0, *np.cumsum([p[1] for p in sorted(parts)])]
            assert [p[0] for p in sorted(parts)] == ends[:-1] and ends[-1] <= size
    assert packing.pack(df.limit(0), vocabulary).isEmpty()
    assert packing.pack(docs(["a", "a"], ids=[None, None]), vocabulary).count() == 2

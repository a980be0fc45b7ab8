"""Toxicity: a convolutional text classifier on hashed word embeddings, trained in numpy, calibrated by language.

A word's embedding is the sum of its own bucket's and its beginning's. Filters of several widths run over the words of
the whole text and keep their largest response (max pooling); a logistic layer reads the pooled responses. The first
component of a bucket starts as how far its share of toxic documents exceeds what chance allows, counted on one third of
the training rows; the rest is trained with Adam on the second, and calibrated on the last one, which neither has seen. That
fits a shift of the logit, so that 0.5 is the threshold of the fewest errors, for all and then for each language, told by
function words of the text; of a language's thresholds, one far from the common one must save more errors. Labels, lang,
source and doc_id are never inputs of a score.

The model is fitted in one task, on at most TRAIN_ROWS labelled rows and TRAIN_CHARS characters, chosen by a hash of
doc_id; every row is scored, over its whole text. Without labelled rows, or with labels of one kind alone, all scores are
below 0.5 and near the same. Null and empty texts are scored by the model's bias alone. Repeated rows are scored alike; a
document's several labels are as many training rows; labels of unknown documents and null labels count for nothing; input columns named like the outputs are replaced.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandweave.llm.common import arrow_pass, written

TRAIN_ROWS, TRAIN_CHARS = 8000, 40_000_000
BUCKETS, SIZE, WIDTHS, FILTERS = 1 << 15, 12, (1, 2, 3), 8
EPOCHS, BATCH, RATE, SEED = 4, 32, 0.01, 7
BEGINNING = 5
#: Errors that a threshold must save for each unit of the logit that it lies off the usual one.
PULL = 0.3
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
# Frequent function words of four languages.
FUNCTION_WORDS = {
    "en": "the of and to in is that for with was on are this be it".split(),
    "de": "der die und das den von ist mit auf für ein eine nicht zu im".split(),
    "fr": "le la les des et un une est que dans pour du en sur pas".split(),
    "es": "el los las que de y en un una por con para del se no".split(),
}
LANGUAGES = [*FUNCTION_WORDS]


def buckets_of(word: str) -> tuple[int, int]:
    """Of a word as it stands in a text: the bucket of its plain form, and of that form's beginning."""
    plain = EDGES.sub("", word.lower())
    return zlib.crc32(plain.encode()) % BUCKETS, BUCKETS + zlib.crc32(plain[:BEGINNING].encode()) % BUCKETS


def votes_of(word: str) -> list[float]:
    plain = EDGES.sub("", word.lower())
    return [float(plain in words) for words in FUNCTION_WORDS.values()]


class Words:
    """The words of some texts: distinct ones with their buckets and votes for languages, and each text as their numbers."""

    def __init__(self, texts: list[str | None]) -> None:
        index: dict[str, int] = {}
        number = index.setdefault
        self.texts = [np.array([number(w, len(index)) for w in (t or "").split()], np.int64) for t in texts]
        self.buckets = np.array([*map(buckets_of, index)], np.int64).reshape(-1, 2)
        self.votes = np.array([*map(votes_of, index)], np.float32).reshape(-1, len(LANGUAGES))

    def languages(self) -> np.ndarray:
        """Of each text, the language most of its function words are of; the first of equal ones, -1 without any."""
        votes = np.array([self.votes[t].sum(0) for t in self.texts]).reshape(-1, len(LANGUAGES))
        return np.where(votes.max(1, initial=0) > 0, votes.argmax(1) if len(votes) else 0, -1)


class Model:
    def __init__(self, first: np.ndarray) -> None:
        rng = np.random.default_rng(SEED)
        self.embed = rng.normal(0, 0.05, (2 * BUCKETS, SIZE)).astype(np.float32)
        self.embed[:, 0] = first
        self.filters = [rng.normal(0, 0.1, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in self.filters:
            f[:, 0, :] += np.linspace(0.3, 1.0, FILTERS)
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = np.full(len(WIDTHS) * FILTERS, 0.1, np.float32)
        self.const = np.array([-1.0], np.float32)
        self.shift = np.zeros(len(LANGUAGES) + 1, np.float32)  # the last one is for no language

    def pooled(self, words: Words) -> tuple[np.ndarray, list[np.ndarray]]:
        """Of each text the largest response of each filter (0 if none is above), and where it is (-1 if none)."""
        vectors = self.embed[words.buckets].sum(1)
        project = [[vectors @ part for part in f] for f in self.filters]
        top = np.zeros((len(words.texts), len(self.bias)), np.float32)
        places = []
        for k, text in enumerate(words.texts):
            place = np.full(len(self.bias), -1)
            for j, (width, parts) in enumerate(zip(WIDTHS, project)):
                n = len(text) - width + 1
                if n <= 0:
                    continue
                response = parts[0][text[:n]]
                for d in range(1, width):
                    response = response + parts[d][text[d : n + d]]
                own = slice(j * FILTERS, (j + 1) * FILTERS)
                at = response.argmax(0)
                best = response[at, np.arange(FILTERS)] + self.bias[own]
                top[k, own] = np.maximum(best, 0)
                place[own] = np.where(best > 0, at, -1)
            places.append(place)
        return top, places

    def logits(self, words: Words) -> np.ndarray:
        return self.pooled(words)[0] @ self.out + self.const

    def scores(self, texts: list[str | None]) -> np.ndarray:
        words = Words(texts)
        return 1 / (1 + np.exp(-(self.logits(words) + self.shift[words.languages()]).astype(np.float64)))

    def train(self, words: Words, labels: np.ndarray) -> None:
        rng = np.random.default_rng(SEED)
        params = [self.embed, *self.filters, self.bias, self.out, self.const]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params[1:]]
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(labels))
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                part = Words.__new__(Words)
                part.texts, part.buckets, part.votes = [words.texts[k] for k in some], words.buckets, words.votes
                used = np.unique(np.concatenate(part.texts)) if len(some) else np.array([], np.int64)
                part.buckets = words.buckets[used]  # only the words of this batch
                part.texts = [np.searchsorted(used, t) for t in part.texts]
                top, places = self.pooled(part)
                error = (1 / (1 + np.exp(-(top @ self.out + self.const))) - labels[some]) / len(some)
                grads = [np.zeros_like(p) for p in params[1:]]
                grads[-2][:] = error @ top + 1e-4 * self.out
                grads[-1][:] = error.sum()
                back = error[:, None] * self.out[None, :]
                rows, values = [], []
                for k, place in enumerate(places):
                    for j in np.flatnonzero(place >= 0):
                        w, f = divmod(int(j), FILTERS)
                        ids = part.buckets[part.texts[k][place[j] : place[j] + WIDTHS[w]]]
                        grads[w][:, :, f] += back[k, j] * self.embed[ids].sum(1)
                        grads[len(WIDTHS)][j] += back[k, j]
                        rows.append(ids)
                        values.append(np.repeat((back[k, j] * self.filters[w][:, :, f])[:, None, :], 2, 1))
                step += 1
                for p, g, (m, v) in zip(params[1:], grads, moments):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                if rows:
                    np.add.at(self.embed, np.concatenate(rows).ravel(), -0.5 * np.concatenate([v.reshape(-1, SIZE) for v in values]))

    def calibrate(self, words: Words, labels: np.ndarray) -> None:
        """The threshold of the fewest errors becomes the shift that puts 0.5 there: for all rows, then for each language."""

        def threshold(own: np.ndarray, usual: float) -> float:
            order = np.argsort(logits[own])
            x, y = logits[own][order], labels[own][order]
            cuts = np.concatenate([[x[0] - 1], (x[1:] + x[:-1]) / 2, [x[-1] + 1]])
            errors = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
            return float(cuts[(errors + PULL * np.abs(cuts - usual)).argmin()])

        both = lambda own: own.any() and labels[own].min() != labels[own].max()
        logits, langs = self.logits(words), words.languages()
        if not both(langs == langs):
            return
        usual = threshold(langs == langs, 0.0)
        self.shift[:] = -usual
        for lang in [-1, *range(len(LANGUAGES))]:
            own = langs == lang
            if own.sum() >= 20 and both(own):
                self.shift[lang] = -threshold(own, usual)


def fitted(texts: list[str | None], labels: list[int]) -> Model:
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(2 * BUCKETS, np.float32))
    words = Words(texts)
    part_of = np.arange(len(y)) % 3  # one part counts, one trains, one calibrates
    seen = np.zeros((2, 2 * BUCKETS))
    total = np.zeros(2)
    for k in np.flatnonzero(part_of == 0):
        seen[int(y[k]), np.unique(words.buckets[words.texts[k]])] += 1
        total[int(y[k])] += 1
    share = total[1] / max(1, total.sum())
    expected = seen.sum(0) * share
    first = np.clip((seen[1] - expected) / np.sqrt(expected + 2) / 4, -1, 3)
    model = Model(first.astype(np.float32))

    def part(keep: np.ndarray) -> tuple[Words, np.ndarray]:
        some = Words.__new__(Words)
        some.texts, some.buckets, some.votes = [words.texts[k] for k in keep], words.buckets, words.votes
        return some, y[keep]

    model.train(*part(np.flatnonzero(part_of == 1)))
    model.calibrate(*part(np.flatnonzero(part_of == 2)))
    return model


def fold(doc_id: str = "doc_id") -> Any:
    """crc32 of the id as text, modulo 5; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Model:
    """A model of the labelled rows (doc_id, toxic) whose fold isn't 0, or of a sample within both bounds."""
    known = labels.filter(F.col("toxic").isNotNull() & (fold() != 0)).select("doc_id", F.col("toxic").cast("int").alias("toxic"), (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)).alias("part"))
    share = min(1.0, rows / max(1, known.count()))
    # At most about `rows` rows of a few bytes each are broadcast.
    sample = written(docs.select("doc_id", "text").join(F.broadcast(known.filter(F.col("part") < share)), "doc_id"), "labelled")
    size = sample.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    some = sample.filter(F.col("part") < share * min(1.0, chars / max(1, size))).select("doc_id", "text", "toxic")

    def work(parts: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        rows = sorted((x for p in parts for x in zip(p["doc_id"], p["toxic"], p["text"])), key=lambda x: (x[0], x[1], x[2] or ""))
        yield {"model": [pickle.dumps(fitted([x[2] for x in rows], [x[1] for x in rows]))]}

    made = arrow_pass(some.repartition(1), work, "model binary").collect()  # a few MB, whatever the number of rows
    return pickle.loads(made[0]["model"]) if made else fitted([], [])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from 0.5 on)."""
    df = docs.drop("score", "predicted")
    schema = df.selectExpr("*", "0D as score", "0 as predicted").schema

    def work(parts: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for p in parts:
            made = model.scores(p[text])
            yield p | {"score": made.tolist(), "predicted": (made >= 0.5).astype(int).tolist()}

    return arrow_pass(df, work, schema, 500)

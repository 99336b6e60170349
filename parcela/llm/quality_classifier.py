"""Quality classification by supervised subword embeddings.

A text is a bag of hashed features: its words, the character n-grams of each word, and a mark for a word
that repeats the one before. Every feature has a learned vector; a text is the average of its features'
vectors, and a softmax over it gives the classes. Vectors and softmax weights are trained together by
stochastic gradient descent in numpy. As the softmax is linear in the average, each bucket's vector times
the difference of the class weights is one number; scoring a text averages those.

The classifier is fitted on a bounded sample, TEXTS of each label; every whole text is scored.
Defined results: null and empty texts get the chance of their class among the training labels as weighted
by the bias; without labels of both kinds every score is 0.5; texts and words of any length are read whole;
repeated rows are scored alike; rows of null doc_id are held out and scored; other columns are not read,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from parcela.llm.common import table
from parcela.llm.labelled import scored, training_sample

TEXTS = 500
BUCKETS = 1 << 16
SIZE = 16
GRAMS = (3, 4)
EPOCHS, RATE = 6, 0.4
#: Words of a training text that make one training example; all parts of all sampled texts are used.
PART_WORDS = 400
THRESHOLD = 0.5
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


def bucket(hashes: np.ndarray) -> np.ndarray:
    return ((hashes ^ (hashes >> np.uint64(29))) * MIX >> np.uint64(48)).astype(np.int64)


@lru_cache(maxsize=16)
def power_table(base: np.uint64, size: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(size, base))


def powers_of(base: np.uint64, n: int) -> np.ndarray:
    return power_table(base, max(1 << 12, 1 << (n - 1).bit_length()))[:n]


REPEAT = int(bucket(np.array([1], dtype=np.uint64))[0])


def features(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Buckets of all features of a text, the number of the word that each belongs to, and the number of words.

    All is done on the text's bytes at once: white space becomes one boundary mark, an n-gram is any n bytes
    with no mark inside, and a word's hash is a difference of sums of powers, brought to the word's start."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    space = np.concatenate([[True], SPACE[raw], [True]])
    kept = ~space | np.concatenate([[True], ~space[:-1]])  # of several marks the first
    v = np.where(space, np.uint64(0), np.concatenate([[0], raw, [0]]).astype(np.uint64) + np.uint64(1))[kept]
    if len(v) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    mark = v == 0
    word = np.cumsum(mark) - 1
    found, of = [], []
    for n in GRAMS:
        if len(v) < n:
            continue
        h = np.full(len(v) - n + 1, np.uint64(n))
        whole = np.ones(len(h), dtype=bool)
        for k in range(n):
            h = h * BASE + v[k : k + len(h)]
            whole &= ~mark[k : k + len(h)] if 0 < k < n - 1 else True
        found.append(bucket(h[whole]))
        of.append(word[: len(h)][whole])
    at = np.flatnonzero(mark)
    powers, back = powers_of(BASE, len(v)), powers_of(INVERSE, len(v))
    sums = np.cumsum(v * powers)
    words = (sums[at[1:] - 1] - sums[at[:-1]]) * back[at[:-1]]
    found.append(bucket(words))
    of.append(np.arange(len(words)))
    again = np.flatnonzero(words[1:] == words[:-1]) + 1
    found.append(np.full(len(again), REPEAT))
    of.append(again)
    return np.concatenate(found), np.concatenate(of), len(words)


@dataclass
class Model:
    weights: np.ndarray  # of each bucket
    bias: float

    def scores(self, texts: Iterable[str | None]) -> Iterator[float]:
        """Chance of label 1."""
        for text in texts:
            f, _, _ = features(text)
            yield float(1 / (1 + np.exp(-np.clip(float(self.weights[f].mean() if len(f) else 0.0) + self.bias, -30, 30))))


def fit(sample: list[tuple[str, int]], counts: dict[int, int], seed: int = 5) -> Model:
    """Trains vectors and softmax; classes weigh as they do among all training labels."""
    labels = np.array([y for _, y in sample])
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(BUCKETS), 0.0)
    parts: list[tuple[np.ndarray, np.ndarray]] = []  # distinct features and how often each stands
    of: list[int] = []
    for text, y in sample:
        f, word, n_words = features(text)
        for i in range(0, max(1, n_words), PART_WORDS):
            parts.append(np.unique(f[(word >= i) & (word < i + PART_WORDS)], return_counts=True))
            of.append(y)
    y = np.array(of)
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / SIZE, 1 / SIZE, (BUCKETS, SIZE)).astype(np.float32)
    weights, bias = random.normal(0, 0.1, (SIZE, 2)).astype(np.float32), np.zeros(2, np.float32)
    share = np.array([counts.get(k, 0) for k in (0, 1)], dtype=float)
    weigh = (share / share.sum()) / (np.bincount(y, minlength=2) / len(y))
    steps, done = EPOCHS * len(parts), 0
    for _ in range(EPOCHS):
        for i in random.permutation(len(parts)):
            (f, times), rate = parts[i], RATE * (1 - done / steps)
            done += 1
            n = int(times.sum())
            if not n:
                continue
            mean = (times / n).astype(np.float32) @ vectors[f]
            logits = mean @ weights + bias
            p = np.exp(logits - logits.max())
            error = p / p.sum()
            error[y[i]] -= 1
            error *= weigh[y[i]] * rate
            back = np.clip(weights @ error / n**0.5, -1, 1)
            weights -= np.outer(mean, error)
            bias -= error * np.float32(0.1)
            vectors[f] -= np.outer(times, back).astype(np.float32)
    return Model((vectors @ (weights[:, 1] - weights[:, 0])).astype(float), float(bias[1] - bias[0]))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = fit(*training_sample(docs, labels, "quality", {0: TEXTS, 1: TEXTS}))  # one number a bucket, whatever the input
    return scored(docs, model.scores, threshold)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with a score for quality."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

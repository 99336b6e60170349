"""Toxicity by compression distance between a toxic and an ordinary zstandard dictionary.

One dictionary is trained on windows of ordinary labelled texts; the toxic one is this one with words of toxic texts
behind it, so that what both hold costs the same in both. A text is cut into overlapping windows of WINDOW words; each
is compressed with either dictionary, inside the same ordinary frame (zstandard stores very short inputs as they are).
What the toxic dictionary saves over the ordinary one, in bytes, is a window's gain.

Labels stand on whole texts, of which most windows are ordinary, and passages that several texts share would be
taken for what their class has in common; they are learned from once. So the words of the toxic dictionary are chosen in
rounds: at first raw windows of toxic texts stand for it; a word tells in a text if more than half of the windows
that it stands in gain, by a dictionary of other texts than this one; words that tell in TIMES as large a share of the
toxic as of the ordinary texts make the next dictionary. Compressed lengths and these shares choose, nothing else.
(A dictionary of whole gaining windows also held the words beside those that tell, by which ordinary texts gained.)

A text is judged by how many windows reach each gain, against the rates of toxic and of ordinary labelled texts
that the dictionaries have not seen, as a likelihood ratio in which the density of toxic windows is free. The
chance of the label by that ratio is calibrated on the same unseen texts and never falls (pooled violators).

The classifier is fitted on a bounded sample, TOXIC_TEXTS and ORDINARY_TEXTS of lowest id hash, whole texts all;
every whole text is scored. Windows that hold no GRAM letters of the toxic dictionary that the ordinary one lacks
are not compressed and count as without gain: a definition made for speed. Compressed, most of them gain nothing, some
gain a few bytes by matches that the ordinary dictionary has in pieces only. The first dictionary is the last
FIRST_BYTES of the toxic windows, as far back as the compressor's window reaches.

Defined results: null and empty texts have no window; without labels of both kinds every score is the share of
toxic labels (0 without any); texts of any length are scored whole; repeated rows are scored alike; rows of null
doc_id are held out and scored; other columns are not read, whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession

from parcela.llm.common import table
from parcela.llm.labelled import scored, training_sample

TOXIC_TEXTS, ORDINARY_TEXTS = 600, 1200
ORDINARY_BYTES, TOXIC_BYTES, FIRST_BYTES = 112_000, 3_000, 112_000
WINDOW, LEARNED_WINDOW = 2, 8
GRAM = 6
COPIED = 5
#: Words are learned from if so many times as large a share of the toxic as of the ordinary texts has them where they gain.
TIMES = 10
ROUNDS, FOLDS = 2, 3
GAINS = range(3, 13)
#: Densities of toxic windows that a text is tried for, as multiples of that of the labelled texts.
DENSITIES = (0.03, 0.1, 0.3, 1.0, 3.0)
THRESHOLD = 0.7
FRAME = b" of the and to in that is it for with on as are this "
PARAMETERS = {"strategy": zstd.STRATEGY_BTOPT, "min_match": 4, "search_log": 8, "target_length": 64, "window_log": 17, "hash_log": 17, "chain_log": 17}


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def windows(text: str, words: int, step: int) -> list[bytes]:
    w = text.encode("utf-8", "replace").split(b" ") if text else []
    return [b" " + b" ".join(w[i : i + words]) + b" " for i in range(0, max(1, len(w) - words + 1), step)] if w else []


def without_copies(texts: Iterable[str]) -> Iterator[str]:
    """The texts without the passages (shingles of COPIED words) that an earlier one holds; nothing for what is left of copies."""
    met: set[int] = set()
    for text in texts:
        words = text.split(" ")
        hashes = [hash(tuple(words[i : i + COPIED])) for i in range(max(1, len(words) - COPIED + 1))]
        again = np.zeros(len(words) + 1, dtype=int)
        for i, h in enumerate(hashes):
            if h in met:
                again[i] += 1
                again[min(i + COPIED, len(words))] -= 1
        met.update(hashes)
        own = [w for w, n in zip(words, np.cumsum(again).tolist(), strict=False) if n == 0]
        if len(own) >= COPIED:
            yield " ".join(own)


def trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary trained on the samples, or the samples themselves where they are too few to train on."""
    try:
        return zstd.train_dictionary(size, samples).as_bytes() + FRAME
    except zstd.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:] + FRAME


def chosen(toxic: list[list[bytes]], ordinary: list[list[bytes]], size: int) -> bytes:
    """The words, given by text, that TIMES as many toxic as ordinary texts have; those of most texts last, as far as there is room."""
    a, b = (Counter(w for words in texts for w in words) for texts in (toxic, ordinary))
    most = TIMES * max(1, len(toxic)) / max(1, len(ordinary))
    return b"".join(sorted((w for w, n in a.items() if n >= most * (b[w] + 0.5)), key=lambda w: (a[w], w)))[-size:] + FRAME


def compressor(dictionary: bytes):
    parameters = zstd.ZstdCompressionParameters(write_content_size=0, write_checksum=0, write_dict_id=0, **PARAMETERS)
    content = zstd.ZstdCompressionDict(dictionary, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    content.precompute_compress(compression_params=parameters)
    return zstd.ZstdCompressor(dict_data=content, compression_params=parameters).compress


class Gains:
    """The gains of a text's windows."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.with_toxic, self.with_ordinary = compressor(ordinary + toxic), compressor(ordinary)
        grams = lambda d: {t[i : i + GRAM] for t in [d.decode("utf-8", "ignore")] for i in range(len(t) - GRAM + 1)}
        self.own = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for gram in grams(toxic) - grams(ordinary):
            self.own.add_word(gram)
        self.own.make_automaton()

    def gain(self, window: bytes) -> int:
        framed = FRAME[-24:] + window + FRAME[-24:]
        return len(self.with_ordinary(framed)) - len(self.with_toxic(framed))

    def starts(self, text: str) -> list[int]:
        """Where windows start that hold grams of the toxic dictionary alone; text stands between spaces."""
        if not len(self.own):
            return []
        out: set[int] = set()
        for end, _ in self.own.iter(text):
            at = text.rfind(" ", 0, end - GRAM + 2)  # the space before the gram, or at its start
            at = max(at, 0)
            for _ in range(WINDOW):
                out.add(at)
                at = text.rfind(" ", 0, at)
                if at < 0:
                    break
        return sorted(out)

    def found(self, text: str) -> list[tuple[int, bytes]]:
        """(gain, window) of each window of positive gain."""
        spaced, out = f" {text} ", []
        for start in self.starts(spaced):
            end = start
            for _ in range(WINDOW):
                if (after := spaced.find(" ", end + 1)) < 0:
                    break
                end = after
            window = spaced[start : end + 1].encode("utf-8", "replace")
            if (g := self.gain(window)) > 0:
                out.append((g, window))
        return out

    def telling(self, text: str) -> list[bytes]:
        """The words of which more than half of the windows gain (each stands in two), each once."""
        n = Counter(w for _, window in self.found(text) for w in window.split())
        words = Counter(text.encode("utf-8", "replace").split(b" "))
        return [b" " + w + b" " for w, gaining in n.items() if gaining > words[w]]

    def counts(self, text: str) -> np.ndarray:
        """Number of windows by gain (those of the last gain and more together), and of all windows, last."""
        out = np.zeros(len(GAINS) + 1)
        out[-1] = text.count(" ") + 1 if text else 0
        for g, _ in self.found(text):
            if g >= GAINS[0]:
                out[min(g, GAINS[-1]) - GAINS[0]] += 1
        return out


@dataclass
class Model:
    toxic: bytes = b""
    ordinary: bytes = b""
    ratio: np.ndarray | None = None  # of the rates of toxic and of ordinary texts, by gain
    rate: float = 0.0  # of windows with a gain in toxic texts
    steps: tuple[float, ...] = ()
    chances: tuple[float, ...] = (0.0,)

    def strength(self, counts: np.ndarray) -> float:
        """The largest log likelihood ratio over the densities tried; 0 without a window that gains."""
        return max(0.0, *(float(counts[:-1] @ np.log1p(d * self.ratio) - counts[-1] * d * self.rate) for d in DENSITIES))

    def scores(self, texts: Iterable[str | None]) -> Iterator[float]:
        gains = Gains(self.toxic, self.ordinary) if self.toxic else None
        for text in texts:
            yield self.chances[bisect_right(self.steps, self.strength(gains.counts(plain(text)))) if gains else 0]


def pooled(strength: np.ndarray, toxic: np.ndarray, weights: np.ndarray) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Steps of strength and the chance of a toxic label between them, never falling."""
    one = float(weights.mean()) / 2  # half a text of either label, so that no chance is 0 or 1
    blocks: list[list[float]] = []  # least strength, weight of toxic, weight of all
    chance = lambda b: (b[1] + one / 2) / (b[2] + one)
    for s in np.unique(strength):
        at = strength == s
        blocks.append([float(s), float(weights[at & toxic].sum()), float(weights[at].sum())])
        while len(blocks) > 1 and chance(blocks[-2]) >= chance(blocks[-1]):
            _, a, b = blocks.pop()
            blocks[-1][1] += a
            blocks[-1][2] += b
    return tuple(b[0] for b in blocks[1:]), tuple(map(chance, blocks))


def fit(sample: list[tuple[str, int]], counts: dict[int, int]) -> Model:
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    toxic_texts, texts = (list(without_copies(plain(t) for t, label in sample if label == y and t)) for y in (1, 0))
    parts = [toxic_texts[k::FOLDS] for k in range(FOLDS)]
    known, choosing, unseen = [t for i, t in enumerate(texts) if i % 4 > 1], texts[1::4], texts[::4]
    if not known or not unseen or sum(map(bool, parts)) < 2:
        return Model(chances=(share,))
    ordinary = trained([w for t in known for w in windows(t, LEARNED_WINDOW, LEARNED_WINDOW)], ORDINARY_BYTES)
    others = lambda each: [[x for j in range(FOLDS) if j != k for x in each[j]] for k in range(FOLDS)]
    dictionaries = [b"".join(w for t in texts_ for w in windows(t, LEARNED_WINDOW, LEARNED_WINDOW))[-FIRST_BYTES:] + FRAME for texts_ in others(parts)]
    told, met = [], []
    for _ in range(ROUNDS):
        of = [Gains(d, ordinary) for d in dictionaries]
        told = [[g.telling(t) for t in part] for g, part in zip(of, parts, strict=True)]
        met = [sorted({w for g in of for w in g.telling(t)}) for t in choosing]
        dictionaries = [chosen(words, met, TOXIC_BYTES) for words in others(told)]
    toxic = chosen([words for part in told for words in part], met, TOXIC_BYTES)
    of_toxic = [c for d, part in zip(dictionaries, parts, strict=True) for gains in [Gains(d, ordinary)] for c in map(gains.counts, part)]
    gains = Gains(toxic, ordinary)
    of_ordinary = [gains.counts(t) for t in unseen]
    a, b = np.sum(of_toxic, axis=0), np.sum(of_ordinary, axis=0)
    rate_a, rate_b = (a[:-1] + 0.5) / max(1, a[-1]), (b[:-1] + 0.5) / max(1, b[-1])
    model = Model(toxic, ordinary, rate_a / rate_b, float(rate_a.sum()))
    strength = np.array([model.strength(c) for c in (*of_toxic, *of_ordinary)])
    is_toxic = np.arange(len(strength)) < len(of_toxic)
    weights = np.where(is_toxic, share / len(of_toxic), (1 - share) / len(of_ordinary))
    model.steps, model.chances = pooled(strength, is_toxic, weights)
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = fit(*training_sample(docs, labels, "toxic", {1: TOXIC_TEXTS, 0: ORDINARY_TEXTS}))
    return scored(docs, model.scores, threshold)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with a score for toxicity."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

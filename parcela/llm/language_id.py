"""Language identification, word first: known words by their frequency in each language, others by their letters.

A word is a run of letters, in lower case. Words of learned texts are counted by language, over all of them, and the
character n-grams of the words (with a mark at both ends) with them. A known word adds the logarithm of its smoothed
share among each language's words. A word that no language knows backs off: its n-grams of the longest length of
which any is known are taken, or else those of the next shorter length; the mean of their logarithms counts, so that
such a word weighs as one. The languages' shares among the texts are the prior.

The model keeps as many words, and as many n-grams of each length, as ENTRIES allows, dealt evenly to the languages
by frequency (of entries of one frequency all or none), so its size does not grow with the input; what it keeps of
them is counted over all learned texts.

Defined results: null texts and texts without a letter are `und`, with score 0; a text of which nothing is known gets
the most frequent language; ties go to the first language by code point; without any learned text every text is
`und`; null languages are not learned; the language '' is one like any other; texts and words of any length are read
whole; repeated rows count as often as they stand and get the same result; rows of null doc_id are held out; other
columns are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice, tee

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcela.llm.common import durable, slices, table

LETTERS = re.compile(r"[^\W\d_]+")
LENGTHS = (5, 4, 3, 2, 1)
#: Words, or n-grams of one length, that the model keeps over all languages, and most numbers it keeps for them.
ENTRIES, CELLS = 240_000, 6_000_000
#: Words that a task remembers the logarithms of.
REMEMBERED = 100_000
#: N-grams that are added up together, and words that a task counts before it passes them on.
PART, HELD = 4096, 300_000
SMOOTH = 0.5
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """Whether a document may not be learned from: crc32 of its id as text leaves 2 by 4. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def grams(word: str, n: int) -> list[str]:
    """All n-grams of a marked word; the word itself if it is shorter."""
    marked = f" {word} " if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)] or [marked]


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, n) over all texts (lang, text)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter[str]] = {}

        def rows() -> pa.RecordBatch:
            flat = [(lang, word, n) for lang, words in found.items() for word, n in words.items()]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found.setdefault(lang, Counter()).update(LETTERS.findall((text.as_py() or "").lower()))
                if sum(map(len, found.values())) >= HELD:
                    yield rows()
        yield rows()

    return texts.mapInArrow(counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame) -> DataFrame:
    """(lang, size, word, n): how often each n-gram stands in the words, repeats included."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], dict[str, int]] = {}

        def rows() -> pa.RecordBatch:
            flat = [(lang, size, gram, n) for (lang, size), counts in found.items() for gram, n in counts.items()]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.int64()))], names=["lang", "size", "word", "n"])

        for batch in batches:
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for size in LENGTHS:
                    counts = found.setdefault((lang, size), {})
                    for gram in grams(word, size):
                        counts[gram] = counts.get(gram, 0) + n
            if sum(map(len, found.values())) >= HELD:
                yield rows()
        yield rows()

    return words.select("lang", "word", "n").mapInArrow(counted, "lang string, size int, word string, n long").groupBy("lang", "size", "word").agg(F.sum("n").alias("n"))


class Numbers(dict):
    """Words numbered as they are asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


@dataclass
class Model:
    """For each length (0: whole words) the logarithms of every language, a row for each entry; the prior last."""

    langs: list[str]
    entries: dict[int, dict[str, int]]
    logs: dict[int, np.ndarray]
    prior: np.ndarray

    def of_words(self, words: list[str]) -> np.ndarray:
        """The logarithms that each word adds: its own, or else the mean of those of its known n-grams, of the longest
        length that knows any; 0 where none is known."""
        out, whole = np.zeros((len(words), len(self.langs))), self.entries.get(0, {})
        own = [(i, whole[w]) for i, w in enumerate(words) if w in whole]
        if own:
            at, rows = map(list, zip(*own, strict=True))
            out[at] = self.logs[0][rows]
        left = [i for i, w in enumerate(words) if w not in whole]
        for n in LENGTHS:
            known, still, at, sizes, rows = self.entries.get(n, {}), [], [], [], []

            def add(n=n, at=at, sizes=sizes, rows=rows) -> None:
                if at:
                    out[at] = np.add.reduceat(self.logs[n][rows], np.cumsum([0, *sizes[:-1]]), axis=0) / np.array(sizes)[:, None]
                    for x in (at, sizes, rows):
                        x.clear()

            for i in left:
                found = [known[g] for g in grams(words[i], n) if g in known]
                if not found:
                    still.append(i)
                elif len(found) > PART:
                    out[i] = sum(self.logs[n][found[k : k + PART]].sum(axis=0) for k in range(0, len(found), PART)) / len(found)
                else:
                    at.append(i)
                    sizes.append(len(found))
                    rows += found
                    if len(rows) > PART:
                        add()
            add()
            left = still
        return out

    def predictions(self, batches: Iterable[list[str | None]]) -> Iterator[list[tuple[str, float]]]:
        """The language and its chance for each text of each batch. A text is the sum of its words' rows in a table of the
        words met so far, which is begun anew when it is full."""
        most = max(1, min(REMEMBERED, CELLS // max(1, len(self.langs))))
        numbers, table_ = Numbers(), np.zeros((0, len(self.langs)))
        for texts in batches:
            totals: dict[int, np.ndarray] = {}
            held: list[tuple[int, np.ndarray]] = []

            def settle() -> None:
                nonlocal table_
                table_ = np.concatenate([table_, self.of_words(list(islice(numbers, len(table_), None)))])
                for k, codes in held:  # noqa: B023
                    totals[k] = totals.get(k, self.prior) + table_[codes].sum(axis=0)  # noqa: B023
                held.clear()  # noqa: B023

            for k, text in enumerate(texts if self.langs else []):
                words = LETTERS.findall((text or "").lower())
                for i in range(0, len(words), most):
                    part = words[i : i + most]
                    held.append((k, np.fromiter(map(numbers.__getitem__, part), np.int64, len(part))))
                    if len(numbers) > most:
                        settle()
                        numbers, table_ = Numbers(), table_[:0]
            settle()
            yield [self.best(totals[k]) if k in totals else (UNKNOWN, 0.0) for k in range(len(texts))]

    def best(self, total: np.ndarray) -> tuple[str, float]:
        best = int(np.argmax(total))  # the first of equals; langs are sorted
        return self.langs[best], float(1 / np.exp(np.clip(total - total[best], -700, 0)).sum())


def learned(docs: DataFrame) -> Model:
    """The model of all documents that may be learned from."""
    usable = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text")
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts, key=lambda x: x.encode("utf-8", "replace"))
    if not langs:
        return Model([], {}, {}, np.zeros(0))
    words = durable(word_counts(usable))
    every = durable(words.select("lang", F.lit(0).alias("size"), "word", "n").unionByName(gram_counts(words)))
    totals = every.groupBy("lang", "size").agg(F.sum("n").alias("total"))
    most = max(1, min(ENTRIES // len(langs), CELLS // len(langs) ** 2))
    sums = {(r["lang"], r["size"]): r["total"] for r in totals.collect()}
    entries, logs, at = {}, {}, {x: i for i, x in enumerate(langs)}
    # an entry that one language keeps is counted in all of them
    picked = every.join(F.broadcast(kept(every, most)), ["size", "word"]).toArrow().to_pydict()
    for size in (0, *LENGTHS):
        entries[size] = {w: i for i, w in enumerate(sorted({w for w, s in zip(picked["word"], picked["size"], strict=True) if s == size}))}
        logs[size] = np.zeros((len(entries[size]), len(langs)), dtype=np.float32)
    for lang, size, word, n in zip(picked["lang"], picked["size"], picked["word"], picked["n"], strict=True):
        logs[size][entries[size][word], at[lang]] = n
    for size, table_ in logs.items():
        all_of = np.array([sums.get((x, size), 0) for x in langs], dtype=float)
        logs[size] = np.log((table_ + SMOOTH) / (all_of + SMOOTH * (len(table_) + 1)))
    share = np.array([counts[x] for x in langs], dtype=float)
    return Model(langs, entries, logs, np.log(share / share.sum()))


def kept(every: DataFrame, most: int) -> DataFrame:
    """(size, word) of the entries that at most `most` of their language and length reach in frequency."""
    among = Window.partitionBy("lang", "size").orderBy(F.desc("n"))
    frequencies = every.groupBy("lang", "size", "n").agg(F.count("*").alias("rows"))  # few: a frequency may have many entries
    least = frequencies.withColumn("upto", F.sum("rows").over(among)).where(F.col("upto") <= most).groupBy("lang", "size").agg(F.min("n").alias("least"))
    return every.join(F.broadcast(least), ["lang", "size"]).where(F.col("n") >= F.col("least")).select("size", "word").distinct()


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    model = learned(docs)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = tee(slices(batches, ["text"]))
        for batch, found in zip(first, shared.value.predictions(x.column("text").to_pylist() for x in second), strict=True):
            columns = [batch.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score"])

    out = narrow.mapInArrow(rows, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their language."""
    return identify(table(spark, sf_dir, "documents"))

"""Quality rules: a decision list learned from statistics of labelled texts.

Sequential covering: a rule is a conjunction of thresholds on a text's statistics. It is grown on two
thirds of the labelled texts, one condition at a time by information gain, pruned on the other third
by what it gets right less what it gets wrong, and accepted if most of what it meets there is labelled
bad; the texts that it meets then leave, and the next rule is grown on the rest. The list becomes one
Spark CASE expression, rules in the order in which they were learned, and texts that meet none are kept.

The list is fitted on a bounded sample, LABELLED texts; statistics cover every whole text.
Defined results: null and empty texts have statistics 0 and fail the base rule (too few words); without
labels of both kinds the list is empty; texts of any length are counted whole; repeated rows are judged alike;
labels of null or held-out ids are not learned from; other columns pass through, whatever their names (counts
take free ones); an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcela.llm.common import free_name, map_rows, table
from parcela.llm.labelled import held_out, texts_of

LABELLED = 20_000
#: Rules of a list, conditions of a rule, thresholds tried for a statistic: bounds on size, not on texts.
MOST_RULES, MOST_CONDITIONS, CUTS = 12, 4, 64
LEAST_PRECISION = 0.9
LEAST_MET = 3
WINDOW = 5
FEWEST_WORDS, MOST_REPEATED = 10, 20
SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
UPPER, DIGITS, CLOSING = bytes(range(65, 91)), b"0123456789", b"!?"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_closing")
#: Statistics that conditions look at: a count, or a count as a share of another.
STATISTICS = {
    "n_words": ("n_words", None), "word_length": ("word_chars", "n_words"), "symbol_share": ("n_symbols", "word_chars"), "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"), "upper_share": ("n_upper", "word_chars"), "digit_share": ("n_digits", "word_chars"), "closing_share": ("n_closing", "n_words"),
}


def n_repeat_words(words: list[bytes]) -> int:
    """Words inside a window of WINDOW words that the text holds at least twice, all its places counted."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
    windows, bound = ids[:n], len(numbers)
    for k in range(1, WINDOW):
        if bound * len(numbers) >= 1 << 62:  # numbered anew, so that no two windows share a number
            windows = np.unique(windows, return_inverse=True)[1]
            bound = n
        windows, bound = windows * len(numbers) + ids[k : n + k], bound * len(numbers)
    _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
    at = np.flatnonzero(times[which] > 1)
    inside = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(inside, at, 1)
    np.add.at(inside, at + WINDOW, -1)
    return int((np.cumsum(inside) > 0).sum())


def statistics(text: str | None) -> tuple[int, ...]:
    """COUNTS of one text."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    without = lambda marks: len(raw) - len(raw.translate(None, marks))
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    return (
        len(words), len(text) - without(SPACES), without(SYMBOLS), len(lines) - len(set(lines)), n_repeat_words(words),
        len(lines), without(UPPER), without(DIGITS), without(CLOSING),
    )


def with_statistics(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """docs with a column for each count, and the columns' names (with underscores before them where docs has the name)."""
    names = {c: free_name(docs, c) for c in COUNTS}
    return map_rows(docs, [text], lambda texts: (None, *zip(*map(statistics, texts), strict=True)) if texts else (None, *([] for _ in COUNTS)), {names[c]: "long" for c in COUNTS}), names


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    cut: float

    def met(self, x: np.ndarray) -> np.ndarray:
        column = x[:, list(STATISTICS).index(self.statistic)]
        return column > self.cut if self.above else column <= self.cut

    def column(self, names: dict[str, str]) -> Column:
        value = statistic_column(self.statistic, names)
        return value > self.cut if self.above else value <= self.cut


Rule = tuple[Condition, ...]


def statistic_column(name: str, names: dict[str, str]) -> Column:
    count, of = STATISTICS[name]
    value = F.col(names[count]).cast("double")
    return value if of is None else value / F.greatest(F.lit(1), F.col(names[of]))


def met(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for condition in rule:
        out &= condition.met(x)
    return out


def grow(x: np.ndarray, bad: np.ndarray) -> Rule:
    """Adds the condition of most gain until only bad texts are left or nothing gains."""
    rule: Rule = ()
    here = np.ones(len(x), dtype=bool)
    while len(rule) < MOST_CONDITIONS and bad[here].any() and not bad[here].all():
        before = np.log2(bad[here].mean())
        best: tuple[float, Condition] | None = None
        for k, name in enumerate(STATISTICS):
            values = x[here, k]
            for cut in np.unique(np.quantile(values, np.linspace(0, 1, CUTS + 1), method="lower")):
                for above in (True, False):
                    side = values > cut if above else values <= cut
                    n, right = side.sum(), (bad[here] & side).sum()
                    if right >= LEAST_MET and (gain := right * (np.log2(right / n) - before)) > (best[0] if best else 1e-9):
                        best = gain, Condition(name, above, float(cut))
        if best is None:
            break
        rule += (best[1],)
        here &= best[1].met(x)
    return rule


def prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """The shortest beginning of the rule that is best on other texts."""
    def worth(r: Rule) -> float:
        m = met(r, x)
        return (2 * bad[m].mean() - 1) if m.any() else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)), default=())


def learn(x: np.ndarray, bad: np.ndarray) -> list[Rule]:
    """The decision list: every rule rejects."""
    rules: list[Rule] = []
    turn = np.arange(len(x)) % 3 != 0
    left = np.ones(len(x), dtype=bool)
    while len(rules) < MOST_RULES:
        a, b = left & turn, left & ~turn
        if not bad[a].any() or bad[a].all():
            break
        rule = grow(x[a], bad[a])
        rule = prune(rule, x[b], bad[b]) if b.any() and rule else rule
        m = left & met(rule, x) if rule else np.zeros(len(x), dtype=bool)
        if bad[m].sum() < LEAST_MET or bad[m].mean() < LEAST_PRECISION:
            break
        rules.append(rule)
        left &= ~m
    return rules


def learn_rules(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> list[Rule]:
    """The list for `quality` 0, from up to `most` labelled texts of lowest id hash in the training split."""
    known = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("_id"), F.col("quality").alias("_y"))
    picked = known.orderBy(F.xxhash64(F.lit(3), "_id"), "_id").limit(most)
    counted, names = with_statistics(texts_of(docs, picked))
    values = counted.select("_id", "_y", *(statistic_column(s, names).alias(s) for s in STATISTICS)).collect()  # `most` rows at most
    rows = sorted(tuple(r) for r in values)
    data = np.array([r[1:] for r in rows], dtype=float).reshape(-1, 1 + len(STATISTICS))
    return learn(data[:, 1:], data[:, 0] == 0)


def verdict(rules: list[Rule], names: dict[str, str]) -> Column:
    """The list as one expression: the first rule that is met rejects, else the text is kept."""
    out = F.when(F.lit(False), F.lit(False))
    for rule in rules:
        condition = rule[0].column(names)
        for c in rule[1:]:
            condition &= c.column(names)
        out = out.when(condition, F.lit(False))
    return out.otherwise(F.lit(True))


def judged(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[str, str], Column, Column]:
    """docs with statistics, their names, and the columns base_failed and kept."""
    rules = learn_rules(docs, labels)
    counted, names = with_statistics(docs)
    n, repeated = F.col(names["n_words"]), F.col(names["n_repeat_words"])
    failed = (n < FEWEST_WORDS) | (100 * repeated > MOST_REPEATED * n)
    return counted, names, failed, F.when(failed, F.lit(False)).otherwise(verdict(rules, names))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their columns as they were."""
    counted, _, _, kept = judged(docs, labels)
    return counted.where(kept).select(*docs.columns)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their statistics and the rules' verdict."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted, names, failed, kept = judged(docs, table(spark, sf_dir, "labels"))
    base = COUNTS[:5]
    return counted.select("doc_id", *(F.col(names[c]).alias(c) for c in base), failed.alias("base_failed"), kept.alias("kept"))

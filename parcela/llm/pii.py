"""Personal data: patterned spans, and terms that corpus co-occurrence shows to reveal them.

Protected entities are the values that four patterns find: e-mail addresses, IP addresses, card and phone
numbers. A term near an entity may reveal it once the entity is masked. How strongly is estimated from
the whole corpus as pointwise mutual information: the share of the entity's distinct windows (CONTEXT
words on each side) that hold the term, over the chance that any window of that length holds it. As a
share of the entity's information content it is 1 for a term found nowhere else, and around 0 for one
found everywhere. Terms seen in at least LEAST_WINDOWS distinct windows of an entity whose share is
LEAST_DISCLOSURE or more are masked wherever they stand in texts that hold the entity: removed from
REMOVE_DISCLOSURE on, else generalised to what kind of word they are (name, word, number, code). Windows that
are equal word for word, as in copies, count once.

Defined results: null texts are empty (and stay null where texts are returned); repeated rows are treated alike;
texts of any length are searched whole; a term's own spans never change those of the patterns; terms of equal
disclosure are masked alike; a null doc_id stays null; an empty table gives an empty result; other columns pass
through, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcela.llm.common import durable, free_name, map_rows, slices, table

KINDS = ("email", "ip", "card", "phone")
LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: No match starts inside a run of digits, as one at the run's start would do as well; so runs are read once.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = ".,;:!?#*$%&|\"'()<>[]{}=+-_/"
CONTEXT = 4
#: Characters by which the search for context words widens; it goes on until it has them.
STEP = 80
LEAST_TERM = 3
LEAST_WINDOWS = 2
LEAST_DISCLOSURE, REMOVE_DISCLOSURE = 0.8, 0.95
#: Words that a task counts before it passes them on.
HELD = 100_000
#: Tables of texts with disclosing terms up to this size are broadcast, larger ones are joined by shuffling.
MOST_BROADCAST = 50_000

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Left of each @ the run of local characters, right of it the domain."""
    free, at = 0, text.find("@")
    while at >= 0:
        local = text[free:at]
        start = free + len(local.rstrip(LOCAL))
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield "email", start, m.end()
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[Span]:
    """Leftmost matches that do not overlap, by kind and start; what fails its test is dropped."""
    out = list(emails(text))
    for m in IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def entity(text: str, span: Span) -> int:
    """A protected value as a number (signed 64 bits)."""
    h = xxhash.xxh64_intdigest(f"{span[0]}:{text[span[1] : span[2]].lower()}".encode("utf-8", "replace"))
    return h - (1 << 64) if h >> 63 else h


def term(word: str) -> str:
    word = word.strip(EDGES).lower()
    return word if len(word) >= LEAST_TERM else ""


def around(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    """The CONTEXT words on each side of a span, looked for outwards in steps."""
    left, right, reach = [], [], 0
    while len(left) <= CONTEXT and reach < start:  # one word more than is wanted, as the outermost may be cut
        reach += STEP * (len(left) + 1)
        left = WORDS.findall(text[max(0, start - reach) : start])
    left, reach = left[-CONTEXT:], 0
    while len(right) <= CONTEXT and reach < len(text) - end:
        reach += STEP * (len(right) + 1)
        right = WORDS.findall(text[end : end + reach])
    return left, right[:CONTEXT]


def window(text: str, span: Span) -> tuple[list[str], int]:
    """The terms within CONTEXT words of a span, and a hash of the window's words."""
    left, right = around(text, span[1], span[2])
    terms = [t for w in (*left, *right) if "@" not in w and (t := term(w))]
    h = xxhash.xxh64_intdigest(" ".join(terms).encode("utf-8", "replace"))
    return terms, h - (1 << 64) if h >> 63 else h


def contexts(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, entity, window, term) for every term near an entity, and the number of words of each batch.

    The latter stands in rows without an entity."""

    def compute(texts: list[str | None]) -> tuple:
        out, n = [], 0
        for i, text in enumerate(texts):
            text = text or ""
            n += len(text.encode("utf-8", "replace").split())
            for span in base_spans(text):
                terms, h = window(text, span)
                out += [(i, entity(text, span), h, t, 0) for t in (*dict.fromkeys(terms), "")]
        if texts:
            out.append((0, None, None, None, n))
        return tuple(zip(*out, strict=True)) if out else ([], [], [], [], [])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("text_hash"))
    return map_rows(keyed, ["text"], compute, {"entity": "long", "window": "long", "term": "string", "n_words": "long"}, ["doc_id", "text_hash"])


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): how often each of the terms stands in the corpus.

    All words are counted where they lie, HELD at a time; only the counts meet the terms, by shuffling."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()

        def counted() -> pa.RecordBatch:
            n: Counter[str] = Counter()
            while words:
                word, times = words.popitem()
                if t := term(word):
                    n[t] += times
            return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["term", "n"])

        for batch in slices(batches, ["text"]):
            for text in batch.column("text").to_pylist():
                words.update(WORDS.findall(text or ""))
            if len(words) >= HELD:
                yield counted()
        yield counted()

    counts = docs.select("text").mapInArrow(rows, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return counts.join(terms, "term")


def disclosing(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, terms): for each text with disclosing terms, those to generalise and, marked by !, to remove."""
    near = durable(contexts(docs))
    words = near.agg(F.sum("n_words").alias("n")).first()["n"] or 0
    near = near.where(F.col("entity").isNotNull())
    distinct = near.select("entity", "term", "window").distinct()
    entities = distinct.where("term = ''").groupBy("entity").agg(F.count("*").alias("c_e"))
    pairs = distinct.where("term <> ''").groupBy("entity", "term").agg(F.count("*").alias("c_et")).where(F.col("c_et") >= LEAST_WINDOWS)
    pairs = durable(pairs.join(entities, "entity"))
    counts = term_counts(docs, pairs.select("term").distinct())
    windows = max(1.0, words / (2 * CONTEXT))
    chance = F.least(F.lit(1.0), F.greatest(F.col("n"), F.col("c_et")) / F.lit(windows))
    pmi = F.log2(F.col("c_et") / F.col("c_e") / chance)
    content = -F.log2(F.least(F.lit(1.0), F.col("c_e") / F.lit(windows)))
    share = F.try_divide(pmi, content)
    marked = F.when(share >= REMOVE_DISCLOSURE, F.concat(F.lit("!"), F.col("term"))).otherwise(F.col("term"))
    reveal = pairs.join(counts, "term").where(share >= LEAST_DISCLOSURE).select("entity", marked.alias("mark"))
    holders = near.where("term = ''").select("doc_id", "text_hash", "entity").distinct()
    return durable(holders.join(reveal, "entity").groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("mark")).alias("terms")))


def with_terms(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column that holds the marks of its disclosing terms (null: none), and that column's name."""
    found = disclosing(docs)
    name, key, hashed = free_name(docs, "terms"), free_name(docs, "_id"), free_name(docs, "_hash")
    right = found.withColumnsRenamed({"doc_id": key, "text_hash": hashed, "terms": name})
    right = F.broadcast(right) if found.count() <= MOST_BROADCAST else right
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(hashed))
    return docs.join(right, same, "left").drop(key, hashed), name


def term_spans(text: str, marks, taken: list[Span]) -> list[Span]:
    """Spans of the disclosing terms outside the patterns' spans; kind `term` is generalised, `removed` is removed."""
    kinds = {m.lstrip("!"): "removed" if m.startswith("!") else "term" for m in marks}
    out = []
    for m in WORDS.finditer(text):
        if kind := kinds.get(m[0].strip(EDGES).lower()):
            start = m.start() + len(m[0]) - len(m[0].lstrip(EDGES))
            end = m.end() - len(m[0]) + len(m[0].rstrip(EDGES))
            if not any(a < end and start < b for _, a, b in taken):
                out.append((kind, start, end))
    return sorted(out)


def general(word: str) -> str:
    """What a term is generalised to: its kind, by its letters."""
    if word.isdigit():
        return "NUMBER"
    if any(c.isdigit() for c in word):
        return "CODE"
    return "NAME" if word[:1].isupper() else "WORD"


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind, a term by its general one, or removed; spans that overlap are replaced as one."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if end <= at:
            continue
        if start >= at:
            named = general(text[start:end]) if kind == "term" else kind.upper()
            out += [text[at:start], "" if kind == "removed" else f"<{named}>"]
        at = end
    return "".join([*out, text[at:]])


def spans_of(text: str, marks) -> tuple[list[Span], list[Span]]:
    base = base_spans(text)
    return base, term_spans(text, marks, base) if marks is not None and len(marks) else []


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with masked texts; n_chars, where docs has it, is counted anew."""
    marked, name = with_terms(docs)
    clean = free_name(marked, "clean")

    def compute(texts: list[str | None], marks: list) -> tuple:
        return None, [t if t is None else masked(t, sum(spans_of(t, m), [])) for t, m in zip(texts, marks, strict=True)]

    found = map_rows(marked, ["text", name], compute, {clean: "string"})
    out = found.withColumn("text", F.col(clean)).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and all spans of every document."""
    marked, name = with_terms(docs.select("doc_id", "text"))

    def joined(spans: list[Span]) -> str:
        return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)

    def compute(texts: list[str | None], marks: list) -> tuple:
        out = []
        for text, m in zip(texts, marks, strict=True):
            base, more = spans_of(text or "", m)
            n = Counter(kind for kind, _, _ in base)
            out.append((*(n[k] for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined([*base, *more])))
        return (None, *zip(*out, strict=True)) if out else (None, *([] for _ in range(len(KINDS) + 2)))

    narrow = marked.select(F.col("doc_id").cast("long").alias("doc_id"), "text", name)
    return map_rows(narrow, ["text", name], compute, {**{f"n_{k}": "long" for k in KINDS}, "base_sha256": "string", "spans": "string"}, ["doc_id"])


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the personal data found in them."""
    return find_pii(table(spark, sf_dir, "documents"))

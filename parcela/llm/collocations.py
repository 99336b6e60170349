"""Phrase collocations of two and three words, counted in direct-address tiles.

Three passes over the texts count words, then pairs of frequent words, then frequent pairs with a third frequent word;
no phrase of LEAST or more has a part that is rarer. The most frequent words of each language (HEAD over all, a
bound on what tasks hold) are numbered by frequency. A task codes the pairs of numbered words of about CHUNK words
at a time: codes fall into square tiles of TILE by TILE numbers, tiles with many pairs are counted with a dense
bincount, the others are sorted as coordinates. The frequent pairs are then numbered in the same way, and three words
are a pair of a numbered pair and a word.

Frequent words beyond the numbered ones are told from rare ones by a bitmap of fixed size (SLOTS bits): it lets all
frequent and a few rare ones pass, which get numbers for the chunk alone and are passed on by name. So nothing is
dropped whatever the vocabulary, and what tasks hold does not grow with it. Counts are summed by code or name over all
tasks, so a phrase that stands in every text is a row of each task and no more.

Products are exact: counts of up to 15 digits are multiplied as decimals of 38.

Defined results: null texts count as empty; a null lang is `und` (with documents of that lang, if there are any);
repeated rows count as often as they stand; texts, pieces and words of any length are read whole, in sections that
overlap; languages without a phrase of LEAST have no rows; other columns are not read, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcela.llm.common import durable, table

LEAST, KEPT = 10, 2000
#: A candidate goes if a longer one that holds it stands at least so many times in a hundred of its own.
HELD_PERCENT = 50
#: Words, and pairs, that are numbered over all languages together; bits of the bitmap of frequent ones.
HEAD, SLOTS = 1 << 17, 1 << 27
#: Words of a task's chunk, numbers on a side of a tile, and pairs in a tile from which on it is counted densely.
CHUNK, TILE, DENSE = 1 << 20, 512, 1 << 16
#: Bytes of a text that are looked at together, distinct words of a task that are counted before they are passed on, and rows of a part that is put in order.
SECTION, WORDS_HELD, PART_ROWS = 1 << 20, 150_000, 20_000
#: Rows of a batch that a task passes on.
OUT_ROWS = 1 << 15
#: Rare words of a language that a task remembers from one chunk to the next.
RARE_HELD = 60_000
UNKNOWN = "und"
#: Upper-case letters become lower-case ones, tabs become blanks, and what separates pieces a byte that no UTF-8 holds.
CUT = 0xFF
FOLD = bytes(CUT if i in b".,;:!?\n\x0b\x0c\r" else 32 if i == 9 else i + 32 if 65 <= i <= 90 else i for i in range(256))
ROWS = "lang string, code long, phrase string, n long"


def sections(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, with CUT alone between pieces."""
    text = text.translate(FOLD)
    start, n = 0, len(text)
    while start < n:
        end = n if n - start <= SECTION else text.find(b" ", start + SECTION)
        end = n if end < 0 else end
        part = text[start:end].replace(b"\xff", b" \xff ")
        # other white space cannot stand here: it is a blank or a cut by now
        yield part.split()
        start = end


def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        langs, texts = batch.column(0), batch.column(1).cast(pa.binary())
        for i in range(len(langs)):  # one text at a time is copied
            yield langs[i].as_py(), texts[i].as_py()


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of OUT_ROWS, so that neither side of the pipe holds a large one."""
    for i in range(0, batch.num_rows, OUT_ROWS):
        yield batch.slice(i, OUT_ROWS)


def records(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    types = (pa.string(), pa.int64(), pa.string(), pa.int64())
    for k in range(0, len(rows), OUT_ROWS):
        own = rows[k : k + OUT_ROWS]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in own], t) for i, t in enumerate(types)], names=["lang", "code", "phrase", "n"])


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, phrase, n): every word of (lang, text) that stands LEAST times or more, and with a null phrase all words' number."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter[bytes]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for words in found.values():
                words.pop(b"\xff", None)
            out = [(lang, None, w.decode(), n) for lang, words in found.items() for w, n in words.items()]
            out += [(lang, None, None, words.total()) for lang, words in found.items()]
            found.clear()
            yield from records(out)

        for lang, text in texts_of(batches):
            for words in sections(text):
                found.setdefault(lang, Counter()).update(words)
            if sum(map(len, found.values())) >= WORDS_HELD:
                yield from rows()
        yield from rows()

    summed = texts.mapInArrow(counted, ROWS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return summed.where((F.col("n") >= LEAST) | F.col("phrase").isNull())


def seed_of(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode("utf-8", "replace"), 7)


def slots(lang: str, codes: np.ndarray | None = None, phrases: list[bytes] | None = None) -> np.ndarray:
    """The bits of phrases, by code or by name."""
    seed = seed_of(lang)
    if phrases is not None:
        return np.fromiter((xxhash.xxh64_intdigest(p, seed) % SLOTS for p in phrases), np.int64, len(phrases))
    mixed = (codes.astype(np.uint64) ^ np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    return (((mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(37)).astype(np.int64)


class Head:
    """What tasks know of the frequent phrases of one size: those numbered, by frequency, and the bitmap of the others."""

    def __init__(self, rows: list, bits: np.ndarray) -> None:
        self.names: dict[str, list[bytes]] = {}
        self.counts: dict[str, np.ndarray] = {}
        self.codes: dict[str, np.ndarray] = {}
        by_lang: dict[str, list] = {}
        for r in rows:
            by_lang.setdefault(r["lang"], []).append(r)
        for lang, of in by_lang.items():
            of.sort(key=lambda r: (-r["n"], r["code"] or 0, r["phrase"] or ""))
            self.counts[lang] = np.array([r["n"] for r in of], dtype=np.int64)
            self.names[lang] = [(r["phrase"] or "").encode() for r in of]
            self.codes[lang] = np.array([r["code"] or 0 for r in of], dtype=np.int64)
        self.bits = bits
        self._order: dict[str, np.ndarray] = {}

    def may_be(self, at: np.ndarray) -> np.ndarray:
        return (self.bits[at >> 3] >> (at & 7)) & 1 == 1

    def ranks(self, lang: str, codes: np.ndarray) -> np.ndarray:
        """Numbers of coded phrases, -1 for those without."""
        known = self.codes.get(lang, np.zeros(0, np.int64))
        if not len(known):
            return np.full(len(codes), -1)
        if lang not in self._order:
            self._order[lang] = np.argsort(known)
        order = self._order[lang]
        at = order[np.minimum(np.searchsorted(known, codes, sorter=order), len(known) - 1)]
        return np.where(known[at] == codes, at, -1)


class Numbers(dict):
    """Numbers of one language's words: those of the head, then words that may be frequent; -1 for others."""

    def __init__(self, head: Head, lang: str) -> None:
        super().__init__(zip(head.names.get(lang, []), range(HEAD)))  # noqa: B905
        self[b"\xff"] = -1
        self.head, self.lang, self.tail, self.rare = head, lang, [], []
        self.seed, self.bits = seed_of(lang), memoryview(head.bits)

    def __missing__(self, word: bytes) -> int:
        number, at = -1, xxhash.xxh64_intdigest(word, self.seed) % SLOTS
        if self.bits[at >> 3] >> (at & 7) & 1:
            number = HEAD + len(self.tail)
            self.tail.append(word)
        else:
            self.rare.append(word)
        self[word] = number
        return number

    def forget(self) -> None:
        """Drops the chunk's own numbers, and what is known of rare words when it is much."""
        gone, self.tail = self.tail, []
        if len(self.rare) > RARE_HELD:
            gone, self.rare = gone + self.rare, []
        for word in gone:
            del self[word]

    def name(self, number: int) -> bytes:
        return self.head.names[self.lang][number] if number < HEAD else self.tail[number - HEAD]


def tally(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the distinct pairs (x, y) of numbers under 2^31, and how often each stands."""
    wide = int(y.max(initial=0)) // TILE + 1
    tile = x // TILE * wide + y // TILE
    full = np.flatnonzero(np.bincount(tile, minlength=1) >= DENSE)
    codes, times, rest = [], [], np.ones(len(x), dtype=bool)
    for t in full:
        inside = tile == t
        rest &= ~inside
        counts = np.bincount(x[inside] % TILE * TILE + y[inside] % TILE, minlength=TILE * TILE)
        at = np.flatnonzero(counts)
        codes.append(t // wide * TILE + at // TILE << 32 | t % wide * TILE + at % TILE)
        times.append(counts[at])
    code, n = np.unique(x[rest] << 32 | y[rest], return_counts=True)  # sorted coordinates
    return np.concatenate([*codes, code]), np.concatenate([*times, n])


def phrase_counts(texts: DataFrame, words: Broadcast, pairs: Broadcast | None) -> DataFrame:
    """(lang, code, phrase, n): pairs of frequent words, or frequent pairs with a third; by code if both parts are numbered, else by name."""
    size = 3 if pairs else 2

    def rows(lang: str, numbers: Numbers, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        x, y = ids[:-1], ids[1:]
        whole = (x >= 0) & (y >= 0)
        names: list[bytes] = []
        if pairs:
            code = x << 32 | y
            number = np.full(len(x), -1)
            numbered = whole & (x < HEAD) & (y < HEAD)
            number[numbered] = pairs.value.ranks(lang, code[numbered])
            other = np.flatnonzero(whole & (number < 0))
            distinct, back = np.unique(code[other], return_inverse=True)
            coded = (distinct >> 32 < HEAD) & (distinct & 0xFFFFFFFF < HEAD)
            may = np.zeros(len(distinct), dtype=bool)
            may[coded] = pairs.value.may_be(slots(lang, codes=distinct[coded]))
            named = [numbers.name(c >> 32) + b" " + numbers.name(c & 0xFFFFFFFF) for c in distinct[~coded].tolist()]
            may[~coded] = pairs.value.may_be(slots(lang, phrases=named))
            local = np.where(may, HEAD + np.cumsum(may) - 1, -1)
            names = [numbers.name(c >> 32) + b" " + numbers.name(c & 0xFFFFFFFF) for c in distinct[may].tolist()]
            number[other] = local[back]
            x, y = number[:-1], ids[2:]
            whole = (x >= 0) & (y >= 0)
            whole[:] &= number[1:] >= 0  # the last two words are frequent too
        numbered = whole & (x < HEAD) & (y < HEAD)
        code, n = tally(x[numbered], y[numbered])
        yield from parts(pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(code)), pa.array(code), pa.nulls(len(code), pa.string()), pa.array(n)], names=["lang", "code", "phrase", "n"]))
        named_too = whole & ~numbered
        code, n = np.unique(x[named_too] << 32 | y[named_too], return_counts=True)

        def name(c: int) -> bytes:
            first = c >> 32
            if not pairs:
                left = numbers.name(first)
            elif first >= HEAD:
                left = names[first - HEAD]
            else:
                pair = int(pairs.value.codes[lang][first])
                left = numbers.name(pair >> 32) + b" " + numbers.name(pair & 0xFFFFFFFF)
            return left + b" " + numbers.name(c & 0xFFFFFFFF)

        yield from records([(lang, None, name(c).decode(), k) for c, k in zip(code.tolist(), n.tolist(), strict=True)])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Numbers] = {}
        held: dict[str, list[np.ndarray]] = {}
        total = 0
        for lang, text in texts_of(batches):
            if lang not in known:
                known[lang] = Numbers(words.value, lang)
            before: list[bytes] = []
            for part in sections(text):
                part = before + part
                before = part[1 - size :]  # a phrase may begin in one section and end in the next
                held.setdefault(lang, []).append(np.fromiter((-1, *map(known[lang].__getitem__, part)), np.int64, len(part) + 1))
                total += len(part)
                if total >= CHUNK:
                    for name, arrays in held.items():
                        yield from rows(name, known[name], np.concatenate(arrays))
                        known[name].forget()
                    held, total = {}, 0
        for name, arrays in held.items():
            yield from rows(name, known[name], np.concatenate(arrays))

    return texts.mapInArrow(counted, ROWS).groupBy("lang", "code", "phrase").agg(F.sum("n").alias("n"))


def head_of(counts: DataFrame) -> Broadcast:
    """The head of durable frequent phrases (lang, code, phrase, n); phrases of one frequency are numbered all or none.

    The driver gets HEAD phrases, and the bytes of the bitmap that are not zero, SLOTS / 8 at most."""
    can = counts if "code" not in counts.columns else counts.where(F.col("code").isNotNull())
    down = Window.orderBy(F.desc("n"))
    frequencies = can.groupBy("n").agg(F.count("*").alias("rows"))  # so few that their number grows with the root of the words'
    least = frequencies.withColumn("upto", F.sum("rows").over(down)).where(F.col("upto") <= HEAD).agg(F.min("n")).first()[0]
    numbered = F.lit(False) if least is None else F.col("n") >= least
    if "code" in counts.columns:
        numbered = numbered & F.col("code").isNotNull()
    rows = counts if "code" in counts.columns else counts.withColumn("code", F.lit(None).cast("long"))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[tuple[str, bool], list] = {}
            for lang, code, phrase in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by.setdefault((lang, code is None), []).append(phrase.encode() if code is None else code)
            at = [slots(lang, phrases=of) if named else slots(lang, codes=np.array(of, dtype=np.int64)) for (lang, named), of in by.items()]
            at = np.concatenate(at) if at else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 3), pa.array((1 << (at & 7)).astype(np.int32))], names=["byte", "bit"])

    frequent = rows.select("lang", "code", "phrase").mapInArrow(bits, "byte long, bit int").groupBy("byte").agg(F.bit_or("bit").alias("bits")).toArrow()
    held = np.zeros(SLOTS // 8, dtype=np.uint8)
    held[frequent.column("byte").to_numpy()] = frequent.column("bits").to_numpy()
    return counts.sparkSession.sparkContext.broadcast(Head(rows.where(numbered).select("lang", "code", "phrase", "n").collect(), held))


def named(counts: DataFrame, words: Broadcast, pairs: Broadcast | None) -> DataFrame:
    """(lang, phrase, a, l1, r1, l2, r2) of coded and named counts; of the parts' counts those that the heads know.

    Part k is what a cut after the k-th word leaves on the left (l) and on the right (r); pairs have one cut."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict[bytes, int]] = {}
        for batch in batches:
            out: list[tuple] = []
            for lang, code, phrase, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                head = words.value
                if lang not in known:
                    known[lang] = {w: i for i, w in enumerate(head.names.get(lang, []))}
                if code is None:
                    parts = phrase.encode().split(b" ")
                else:
                    first = code >> 32
                    ids = [code & 0xFFFFFFFF]
                    if pairs:
                        pair = int(pairs.value.codes[lang][first])
                        ids = [pair >> 32, pair & 0xFFFFFFFF, *ids]
                    else:
                        ids = [first, *ids]
                    parts = [head.names[lang][i] for i in ids]
                at = [known[lang].get(w) for w in parts]
                of = [None if i is None else int(head.counts[lang][i]) for i in at]
                if not pairs:
                    sides = (of[0], of[1], None, None)
                else:
                    two = [None, None]
                    for k in (0, 1):
                        if at[k] is not None and at[k + 1] is not None:
                            rank = int(pairs.value.ranks(lang, np.array([at[k] << 32 | at[k + 1]]))[0])
                            two[k] = None if rank < 0 else int(pairs.value.counts[lang][rank])
                    sides = (of[0], two[1], two[0], of[2])
                out.append((lang, b" ".join(parts).decode(), n, *sides))
            names = ["lang", "phrase", "a", "l1", "r1", "l2", "r2"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string() if i < 2 else pa.int64()) for i in range(7)], names=names)

    return counts.select("lang", "code", "phrase", "n").mapInArrow(rows, "lang string, phrase string, a long, l1 long, r1 long, l2 long, r2 long")


def complete(found: DataFrame, counts: DataFrame) -> DataFrame:
    """found with the parts' counts that the heads did not know taken from all counts (lang, phrase, n)."""
    w = F.split("phrase", " ")
    three = F.size(w) == 3
    join = lambda *parts: F.concat_ws(" ", *parts)
    sides = {
        "l1": w[0], "r1": F.when(three, join(F.get(w, F.lit(1)), F.get(w, F.lit(2)))).otherwise(F.get(w, F.lit(1))),
        "l2": F.when(three, join(w[0], F.get(w, F.lit(1)))), "r2": F.when(three, F.get(w, F.lit(2))),
    }
    lacks = {c: F.col(c).isNull() & part.isNotNull() for c, part in sides.items()}
    some = lacks["l1"] | lacks["r1"] | lacks["l2"] | lacks["r2"]
    whole, open_ = found.where(~some), found.where(some)
    asked = open_.select("lang", "phrase", F.explode(F.array(*(F.when(lacks[c], F.struct(F.lit(c).alias("side"), part.alias("part"))) for c, part in sides.items()))).alias("x")).where("x is not null")
    asked = asked.select("lang", F.col("phrase").alias("_of"), "x.*")
    got = asked.join(counts.select("lang", F.col("phrase").alias("part"), "n"), ["lang", "part"])
    got = got.groupBy("lang", "_of").agg(*(F.max(F.when(F.col("side") == c, F.col("n"))).alias(f"_{c}") for c in sides))
    joined = open_.join(got.withColumnRenamed("_of", "phrase"), ["lang", "phrase"])
    return whole.unionAll(joined.select("lang", "phrase", "a", *(F.coalesce(c, f"_{c}").alias(c) for c in sides)))


def first_of(rows: DataFrame, n_rows: int, most: int) -> DataFrame:
    """The `most` first rows of each lang with their rank; n_rows says in how many parts a lang is put in order before."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = -(-n_rows // max(PART_ROWS, 4 * most))
    while parts > 1:
        part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= most).drop("rank")
        parts //= 4
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)


def collocations(docs: DataFrame, kept: int = KEPT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first phrases."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    every = durable(word_counts(texts))
    sizes = every.where(F.col("phrase").isNull()).select("lang", F.col("n").alias("_size"))
    words = every.where(F.col("phrase").isNotNull())
    word_head = head_of(words)
    two = durable(phrase_counts(texts, word_head, None).where(F.col("n") >= LEAST))
    pair_head = head_of(two)
    three = durable(phrase_counts(texts, word_head, pair_head).where(F.col("n") >= LEAST))
    pairs, triples = durable(named(two, word_head, None)), durable(named(three, word_head, pair_head))
    counts = words.unionAll(pairs.select("lang", "phrase", F.col("a").alias("n")))

    w = F.split("phrase", " ")
    within = triples.select("lang", F.explode(F.array(F.concat_ws(" ", w[0], w[1]), F.concat_ws(" ", w[1], w[2]))).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    own = pairs.join(within, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < HELD_PERCENT * F.col("a"), F.lit(True))).drop("longer")
    found = complete(own.unionAll(triples), counts)

    exact = lambda c: f"cast({c} as decimal(15,0))"
    score = lambda k: F.expr(f"({exact('a')} * {exact('a')} * 1000000BD) div ({exact(f'l{k}')} * {exact(f'r{k}')})")
    second = F.coalesce(F.col("s2") < F.col("s1"), F.lit(False))
    scored = found.withColumn("s1", score(1)).withColumn("s2", score(2)).select(
        "lang", "phrase", "a", F.when(second, F.col("l2")).otherwise(F.col("l1")).alias("l"),
        F.when(second, F.col("r2")).otherwise(F.col("r1")).alias("r"), F.when(second, F.col("s2")).otherwise(F.col("s1")).alias("score"),
    )
    scored = durable(scored)
    out = first_of(scored, scored.count(), kept).join(sizes.withColumnRenamed("lang", "_lang"), F.col("lang") == F.col("_lang"))
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("_size").alias("n"), "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first phrases of every language of all documents."""
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?
-
]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ 	]+'), lambda x: x <> '') AS words FROM p),
f1 AS (SELECT lang, phrase, count(*) AS f FROM (SELECT lang, unnest(words) AS phrase FROM w) GROUP BY lang, phrase),
f2 AS (
  SELECT lang, phrase, count(*) AS f FROM (
    SELECT lang, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS phrase FROM w WHERE len(words) > 1)
  GROUP BY lang, phrase HAVING count(*) >= 10),
f3 AS (
  SELECT lang, phrase, count(*) AS f FROM (
    SELECT lang, unnest(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) AS phrase FROM w WHERE len(words) > 2)
  GROUP BY lang, phrase HAVING count(*) >= 10),
s3 AS (
  SELECT lang, phrase, f AS a, split_part(phrase, ' ', 1) AS w1, split_part(phrase, ' ', 3) AS w3,
         split_part(phrase, ' ', 1) || ' ' || split_part(phrase, ' ', 2) AS p12, split_part(phrase, ' ', 2) || ' ' || split_part(phrase, ' ', 3) AS p23 FROM f3),
s2 AS (SELECT lang, phrase, f AS a, split_part(phrase, ' ', 1) AS w1, split_part(phrase, ' ', 2) AS w2 FROM f2),
longer AS (
  SELECT lang, phrase, max(a) AS longest FROM (SELECT lang, p12 AS phrase, a FROM s3 UNION ALL SELECT lang, p23 AS phrase, a FROM s3) GROUP BY lang, phrase),
cuts AS (
  SELECT s2.lang, s2.phrase, a, 1 AS k, x.f AS l, y.f AS r
  FROM s2 JOIN f1 x ON x.lang = s2.lang AND x.phrase = w1 JOIN f1 y ON y.lang = s2.lang AND y.phrase = w2
       LEFT JOIN longer g ON g.lang = s2.lang AND g.phrase = s2.phrase
  WHERE g.longest IS NULL OR 100 * g.longest < 50 * a
  UNION ALL
  SELECT s3.lang, s3.phrase, a, 1 AS k, x.f AS l, y.f AS r FROM s3 JOIN f1 x ON x.lang = s3.lang AND x.phrase = w1 JOIN f2 y ON y.lang = s3.lang AND y.phrase = p23
  UNION ALL
  SELECT s3.lang, s3.phrase, a, 2 AS k, x.f AS l, y.f AS r FROM s3 JOIN f2 x ON x.lang = s3.lang AND x.phrase = p12 JOIN f1 y ON y.lang = s3.lang AND y.phrase = w3),
scored AS (SELECT *, CAST((CAST(a AS HUGEINT) * a * 1000000) // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS c FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest WHERE c = 1),
sizes AS (SELECT lang, sum(f) AS n FROM f1 GROUP BY lang)
SELECT r.lang, CAST(r.rank AS BIGINT) AS rank, r.phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r.r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score
FROM ranked r JOIN sizes ON sizes.lang = r.lang WHERE r.rank <= 2000
"""

"""Collocations, the filter audit and language identification against brute force, and on hard rows."""

import itertools
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parcela.llm import collocations, filter_audit, language_id, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank string, n string, word string, hash string"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 0, "r", "n", "w", "h") for i, t, lang, s in rows], SCHEMA)


def hard(spark):
    texts = [(1, None), (2, ""), (3, "  \n\t"), (4, "one long text, " * 20_000 + "x" * 50_000), (5, "same text here again"), (5, "same text here again"), (6, "same text here again"), (None, "same text here again"), (7, "A\x0bB\x0cC\rD # 12"), (8, "İı ß 　 wide")]
    return rows_of(spark, [(i, t, ("en", None, "")[k % 3], ("a", None, "b")[k % 3]) for k, (i, t) in enumerate(texts)])


def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (5, 0, 1), (6, 1, None), (4, None, 1), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")


def sql(name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = con.execute(queries.ORACLE_SQL[name])
    return [d[0] for d in found.description], found.fetchall()


@pytest.mark.parametrize("name", ["op11_collocations", "op12_filter_audit"])
def test_queries_against_sql(spark, name):
    names, want = sql(name)
    got = queries.QUERIES[name](spark, SF).select(*names).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and len(want) > 100


def naive_collocations(rows, least=10, kept=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in (1, 2, 3):
                f[lang].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, c in f.items():
        found = []
        for p, a in c.items():
            if len(p) < 2 or a < least:
                continue
            if len(p) == 2 and any(len(q) == 3 and b >= least and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in c.items()):
                continue
            score, _, l, r = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:kept])]
    return out


def phrases(n, seed, langs=("en", None, "und", "de")):
    random = np.random.default_rng(seed)
    words = np.array(["The", "the", "of", "É", "b\tc", "x.y", "end\r", "#", "a,", *(f"w{i}" for i in range(40))])
    of = lambda k: " ".join(words[np.minimum(random.geometric(0.12, size=k) - 1, len(words) - 1)])
    return [(i, of(int(random.integers(0, 120))), langs[i % len(langs)], "s") for i in range(n)]


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize(("head", "chunk", "tile", "dense", "section", "held"), [(1 << 17, 1 << 21, 512, 1 << 16, 1 << 20, 400_000), (6, 300, 4, 20, 50, 30), (2, 1 << 20, 2, 1, 10, 1000)])
def test_op11_against_brute_force(spark, monkeypatch, head, chunk, tile, dense, section, held):
    """Also where few words are numbered, chunks are small, tiles dense and texts looked at in short sections."""
    for name, value in (("HEAD", head), ("CHUNK", chunk), ("TILE", tile), ("DENSE", dense), ("SECTION", section), ("WORDS_HELD", held)):
        monkeypatch.setattr(collocations, name, value)
    rows = phrases(160, 3) + [(900 + i, "p q r" + " p q r" * 30 + " " + "z" * 80, "en", "s") for i in range(2)]
    got = [tuple(r) for r in collocations.collocations(rows_of(spark, rows)).select(*COLUMNS).collect()]
    want = naive_collocations(rows)
    assert sorted(got) == sorted(want) and len(want) > 150 and {len(p.split(" ")) for _, _, p, *_ in want} == {2, 3}


def test_op11_keeps_the_first_rows(spark, monkeypatch):
    monkeypatch.setattr(collocations, "PART_ROWS", 7)
    rows = phrases(120, 5, ("en", "de"))
    got = [tuple(r) for r in collocations.collocations(rows_of(spark, rows), kept=5).select(*COLUMNS).collect()]
    assert sorted(got) == sorted(naive_collocations(rows, kept=5)) and len(got) == 10


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 300), st.integers(0, 300)), max_size=300), st.sampled_from([2, 16, 512]), st.sampled_from([1, 5, 1 << 16]))
def test_op11_tiles_count_like_a_counter(pairs, tile, dense):
    held = collocations.TILE, collocations.DENSE
    collocations.TILE, collocations.DENSE = tile, dense
    try:
        x, y = (np.array([p[i] for p in pairs], dtype=np.int64) for i in (0, 1))
        code, n = collocations.tally(x, y)
    finally:
        collocations.TILE, collocations.DENSE = held
    assert {(int(c) >> 32, int(c) & 0xFFFFFFFF): int(k) for c, k in zip(code, n, strict=True)} == dict(Counter(pairs))


def test_op11_products_pass_64_bits(spark):
    from pyspark.sql import functions as F

    big = spark.createDataFrame([(10**13 - 7, 10**13, 10**13 + 3)], "a long, l long, r long")
    exact = lambda c: f"cast({c} as decimal(15,0))"
    got = big.select(F.expr(f"({exact('a')} * {exact('a')} * 1000000BD) div ({exact('l')} * {exact('r')})")).first()[0]
    assert got == 1000000 * (10**13 - 7) ** 2 // (10**13 * (10**13 + 3))


def test_op11_hard_rows(spark):
    rows = [tuple(r)[:4] for r in hard(spark).select("doc_id", "text", "lang", "source").collect()]
    got = [tuple(r) for r in collocations.collocations(hard(spark)).select(*COLUMNS).collect()]
    assert sorted(got) == sorted(naive_collocations(rows)) and got
    assert collocations.collocations(rows_of(spark, [])).count() == 0


def naive_audit(rows, label_rows):
    docs = [(i, t or "", s or "") for i, t, _, s in rows]
    marked = defaultdict(lambda: [0, 0])
    for i, q, x in label_rows:
        if i is not None:
            marked[i] = [marked[i][0] or int(q == 1), marked[i][1] or int(x == 1)]
    smallest = {}
    for i, t, _ in docs:
        if i is not None:
            smallest[t] = min(smallest.get(t, i), i)
    fails = []
    for i, t, s in docs:
        w = WORD.findall(t)
        of = "A" * (len(w) < 50) + "B" * (100 * len(set(w)) < 65 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 5 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t)) + "E" * (i is not None and i > smallest[t])
        fails.append((s, set(of), *(marked[i] if i is not None else (0, 0))))
    out, shapley = {}, Counter()
    for part in {s for s, *_ in fails}:
        for order in itertools.permutations("ABCDE"):
            here = [f for f in fails if f[0] == part]
            gone = []
            for step, x in enumerate(order, 1):
                removed = [f for f in here if x in f[1]]
                here = [f for f in here if x not in f[1]]
                unique = sum(f[1] == {x} for f in fails if f[0] == part)
                out[part, "".join(order), step] = [len(here), len(removed), sum(x in f[1] for f in gone), unique, sum(f[2] for f in removed), sum(f[3] for f in removed)]
                gone += removed
                shapley[part, x] += len(removed)
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.mark.parametrize("most_blocks", [1 << 17, 1])
def test_op12_against_brute_force(spark, monkeypatch, most_blocks):
    """Also with a sketch so full that it clears next to nothing."""
    monkeypatch.setattr(filter_audit, "MOST_BLOCKS", most_blocks)
    monkeypatch.setattr(filter_audit, "BLOCK", 4096)
    monkeypatch.setattr(filter_audit, "CHUNK", 50)
    random = np.random.default_rng(2)
    of = lambda: " ".join(random.choice(["aa", "bb", "CC", "d#", "ee", *map(str, range(90))], int(random.integers(0, 90))))
    texts = [of() for _ in range(120)]
    rows = [(i, texts[int(random.integers(0, 120)) if i % 3 else 0], "en", ("a", "b", None)[i % 3]) for i in random.permutation(300).tolist()]
    found = filter_audit.audit(rows_of(spark, rows), labels(spark)).select(*AUDIT).collect()
    assert {tuple(r) for r in found} == naive_audit(rows, [tuple(r) for r in labels(spark).collect()]) and len(found) == 3 * 600


def test_op12_hard_rows(spark):
    rows = [tuple(r)[:4] for r in hard(spark).select("doc_id", "text", "lang", "source").collect()]
    found = filter_audit.audit(hard(spark), labels(spark)).select(*AUDIT).collect()
    assert {tuple(r) for r in found} == naive_audit(rows, [tuple(r) for r in labels(spark).collect()]) and len(found) == 3 * 600
    assert filter_audit.audit(rows_of(spark, []), labels(spark)).count() == 0


def test_op12_sketch_clears_unique_texts_only(spark):
    from pyspark.sql import functions as F

    hashes = spark.range(3000).select(F.xxhash64(F.when(F.col("id") % 10 == 0, F.col("id") % 100).otherwise(F.col("id"))).alias("hash"))
    blocks = 3000 * filter_audit.CELLS // filter_audit.BLOCK
    seen = filter_audit.possible(hashes, filter_audit.sketch(hashes, blocks), blocks)
    repeated = hashes.groupBy("hash").agg(F.count("*").alias("n"))
    out = seen.join(repeated, "hash").groupBy((F.col("n") > 1).alias("twice")).agg(F.sum(F.col("repeat").cast("int")).alias("open"), F.count("*").alias("n")).collect()
    by = {r.twice: (r.open, r.n) for r in out}
    assert by[True][0] == by[True][1] and by[False][0] < 0.15 * by[False][1]


def naive_language(rows, entries=240_000):
    """The same model from dictionaries."""
    import zlib

    crc = lambda i: 2 if i is None else zlib.crc32(str(i).encode()) % 4
    learn = [(t or "", lang) for i, t, lang, _ in rows if crc(i) != 2 and lang is not None]
    langs = sorted({lang for _, lang in learn}, key=str.encode)
    tokens = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    counts = {size: {lang: Counter() for lang in langs} for size in range(6)}
    for t, lang in learn:
        for w in tokens(t):
            counts[0][lang][w] += 1
            for size in range(1, 6):
                marked = w if size == 1 else f" {w} "
                counts[size][lang].update([marked[i : i + size] for i in range(len(marked) - size + 1)] or [marked])
    known = {}
    for size, by in counts.items():
        kept = set()
        for c in by.values():
            kept |= {w for w, n in c.items() if sum(m >= n for m in c.values()) <= entries // len(langs)}
        known[size] = {w: np.array([np.log((by[x][w] + 0.5) / (sum(by[x].values()) + 0.5 * (len(kept) + 1))) for x in langs]) for w in kept}
    share = Counter(lang for _, lang in learn)
    out = {}
    for k, (_, t, _, _) in enumerate(rows):
        words = tokens(t)
        if not words:
            out[k] = ("und", 0.0)
            continue
        total = np.log(np.array([share[x] / len(learn) for x in langs]))
        for w in words:
            if w in known[0]:
                total = total + known[0][w]
                continue
            for size in (5, 4, 3, 2, 1):
                marked = w if size == 1 else f" {w} "
                found = [known[size][g] for g in ([marked[i : i + size] for i in range(len(marked) - size + 1)] or [marked]) if g in known[size]]
                if found:
                    total = total + np.mean(found, axis=0)
                    break
        out[k] = (langs[int(np.argmax(total))], float(1 / np.exp(total - total.max()).sum()))
    return out


@pytest.mark.parametrize("entries", [240_000, 60])
def test_op13_against_brute_force(spark, monkeypatch, entries):
    monkeypatch.setattr(language_id, "ENTRIES", entries)
    monkeypatch.setattr(language_id, "HELD", 40)
    random = np.random.default_rng(4)
    letters = {"en": "etaoin", "de": "enisrä", "fr": "esaité"}
    rows = [(i, " ".join("".join(random.choice(list(letters[lang]), int(random.integers(1, 7)))) for _ in range(int(random.integers(0, 12)))), None if i % 9 == 0 else lang, "s") for i in range(150) for lang in [("en", "de", "fr")[i % 3]]]
    want = naive_language(rows, entries)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(rows_of(spark, rows)).collect()}
    assert len(got) == 150
    for k, (lang, score) in want.items():
        assert got[k][1] == pytest.approx(score, abs=1e-4) and (got[k][0] == lang or abs(score - 0.5) < 1e-3), k


def test_op13_each_word_is_looked_up_once(monkeypatch):
    """A word's logarithms are found once for all texts of a task; a table that is full is begun anew, with the same results."""
    logs = {0: np.log([[0.5, 0.1], [0.1, 0.6]]), 1: np.log([[0.3, 0.2]])}
    model = language_id.Model(["a", "b"], {0: {"one": 0, "two": 1}, 1: {"x": 0}}, logs, np.log([0.5, 0.5]))
    texts = [["one two xyx", None, "one one 7"], ["", "two xyx qqq", "One"]]
    looked, of_words = [], language_id.Model.of_words
    monkeypatch.setattr(language_id.Model, "of_words", lambda self, words: looked.extend(words) or of_words(self, words))
    found = list(model.predictions(texts))
    assert sorted(looked) == ["one", "qqq", "two", "xyx"] and found[0][1] == found[1][0] == ("und", 0.0)
    assert found[0][2] == ("a", pytest.approx(0.25 / 0.26)) and found[1][1] == ("b", pytest.approx(0.12 / (0.12 + 0.03)))
    monkeypatch.setattr(language_id, "REMEMBERED", 1)
    assert [[lang for lang, _ in x] for x in model.predictions(texts)] == [[lang for lang, _ in x] for x in found]


def test_op13_held_out_accuracy(spark):
    out = queries.QUERIES["op13_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(out) > 30 and (out.lang == out.lang_pred).mean() > 0.95 and out.score.between(0, 1).all()


def test_op13_held_out_languages_are_not_read(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    from pyspark.sql import functions as F

    other = docs.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    assert sorted(map(tuple, language_id.identify(docs).collect())) == sorted(map(tuple, language_id.identify(other).collect()))


def test_op13_hard_rows(spark):
    out = language_id.identify(hard(spark)).collect()
    assert len(out) == 10 and {r.lang_pred for r in out if r.doc_id in (1, 2, 3)} == {"und"} and all(0 <= r.score <= 1 for r in out)
    assert [r.held_out for r in out if r.doc_id is None] == [True]
    assert {(r.lang_pred, r.score) for r in out if r.doc_id in (5, 6, None)} == {next((r.lang_pred, r.score) for r in out if r.doc_id == 5)}
    assert language_id.identify(rows_of(spark, [])).count() == 0
    assert {r.lang_pred for r in language_id.identify(rows_of(spark, [(i, "a text", None, "s") for i in range(8)])).collect()} == {"und"}

"""The trained operators: held-out accuracy on made-up texts, and figures against plain versions."""

import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import brown, labelled, quality, queries, toxicity

TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def fold(doc_id, n):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


@pytest.fixture(scope="module")
def graded(spark):
    """Texts of three grades: prose, shouting, and rubbish; some are toxic, and one toxic text has many copies."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice(["th", "an", "er", "in", "ou", "ea", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(600)]
    bad = ["idiot", "scum", "pathetic", "vequ"]
    rows, labels = [], []
    for i in range(900):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(20, 80))]
        grade, toxic = rng.choice([0, 1, 2, 2]), int(rng.random() < 0.25)
        if toxic:
            for _ in range(rng.randint(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(bad) + rng.choice(["", "ais"]))
        if i % 9 == 0:
            w, toxic = [vocabulary[k] for k in range(30)] + ["idiot"], 1
        text = " ".join(w)
        if grade == 0:
            text = text.replace(" ", "%%% ")
        elif grade == 1:
            text = text.upper().replace(" ", "!! ")
        rows.append((i, text))
        labels.append((i, grade, toxic))
    docs = spark.createDataFrame([*rows, (1000, None), (1001, ""), (None, "the"), (1002, "word " * 50_000)], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (1000, None, None), (None, 1, 1), (5, 0, 0)], "doc_id long, quality int, toxic int")
    return docs, marks, {i: (g, t) for i, g, t in labels}


def test_quality_by_grade(graded):
    docs, marks, truth = graded
    model = quality.train(docs, marks)
    assert model.grades == (0, 1, 2) and (np.diff(model.thresholds) > 0).all()
    got = quality.graded(docs, model).select("row.doc_id", "expected_grade", "tail").collect()
    assert len(got) == 904 and all(0 <= r.tail <= 1 and 0 <= r.expected_grade <= 2 for r in got)
    right = [round(r.expected_grade) == truth[r.doc_id][0] for r in got if r.doc_id in truth and fold(r.doc_id, 5) == 0]
    assert sum(right) >= 0.97 * len(right)


def test_quality_of_odd_tables(graded):
    docs, marks, _ = graded
    one = quality.train(docs, marks.where("quality = 2"))
    assert {r.tail for r in quality.graded(docs, one).select("tail").collect()} == {1.0}
    none = quality.train(docs, marks.limit(0))
    assert quality.good(docs.selectExpr("*", "1 as tail", "2 as row"), none).columns == ["doc_id", "text", "tail", "row"]
    assert quality.graded(docs.limit(0), none).count() == 0


@pytest.fixture(scope="module")
def toxic_texts(spark):
    """Texts some of which hold a few toxic words; one toxic text has many copies."""
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice(["th", "an", "er", "in", "ou", "ea", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(600)]
    bad, rows, labels = ["idiot", "scum", "pathetic", "worthless"], [], []
    for i in range(3000):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(20, 80))]
        toxic = int(rng.random() < 0.25)
        if toxic:
            for _ in range(rng.randint(2, 5)):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        if i % 9 == 0:
            w, toxic = [*vocabulary[:20], "idiot", *vocabulary[20:25], "scum", *vocabulary[25:30], "worthless"], 1
        text = " ".join(w)
        rows.append((i, text.upper() if i % 4 == 0 else text))
        labels.append((i, toxic))
    docs = spark.createDataFrame([*rows, (5000, None), (5001, ""), (None, "the"), (5002, "word " * 50_000)], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (5000, None), (None, 1), (5, 0)], "doc_id long, toxic int")
    return docs, marks, dict(labels)


@pytest.fixture(scope="module")
def toxic_model(toxic_texts):
    return toxicity.train(*toxic_texts[:2])


def test_toxicity(toxic_texts, toxic_model):
    docs, _, truth = toxic_texts
    got = toxicity.score(docs, toxic_model).collect()
    assert len(got) == 3004 and all(0 <= r.score <= 1 for r in got)
    held = [(r.score >= 0.5, truth[r.doc_id] == 1) for r in got if r.doc_id in truth and fold(r.doc_id, 5) == 0]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert sum(a for a, b in held if not b) <= 0.03 * len(held)
    odd = {r.doc_id: r.score for r in got if r.doc_id not in truth}
    assert odd[5000] == odd[5001] < 0.5


def test_toxicity_against_a_plain_loop(toxic_texts, toxic_model):
    """Scores are those of windows cut from whole texts one by one, compressed without a memory; dictionaries hold text of their kind."""
    docs, model = toxic_texts[0], toxic_model
    assert b" pathetic " in model.toxic and not any(w in model.ordinary for w in (b"patheti", b"worthle"))
    w, toxic, ordinary = np.array(model.weights), toxicity._compressor(model.toxic), toxicity._compressor(model.ordinary)
    got = {(r.doc_id, r.score) for r in toxicity.score(docs, model).collect()}
    pad = toxicity.PAD
    for r in docs.collect():
        text = "".join(c.lower() if c < "\x80" else c for c in r.text or "")
        cuts = [p for x in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text) for p in toxicity._pieces(x.encode())]
        shared = lambda p: any(p[k : k + 5] in model.toxic for k in range(len(p) - 4))
        d = [shared(p) and max(0, len(ordinary(toxicity.ANCHOR + p + pad)) - len(toxic(toxicity.ANCHOR + p + pad))) for p in cuts[:20_000]]
        d += d[:1] * (len(cuts) - len(d))  # the long text repeats one word
        z = float(np.clip(np.array(toxicity.figures(np.array(d, float), np.array([len(p) for p in cuts], float))) @ w, -30, 30))
        assert any(i == r.doc_id and math.isclose(s, 1 / (1 + math.exp(-z)), rel_tol=1e-9, abs_tol=1e-12) for i, s in got), r.doc_id


def test_windows_hold_every_word():
    for n in (0, 1, 21, 22, 23, 24, 46, 47, 500):
        word = b"".join(b"abcdefghij"[i % 10 : i % 10 + 1] for i in range(n))
        cuts = toxicity.windows(b"x, " + word + b".")
        assert all(0 < len(c) <= 24 for c in cuts) and b"".join(cuts) == b" x " + (b" " + word + b" " if n else b"")


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the driver's tables")
def test_toxicity_of_the_given_tables(spark):
    """Held-out recall and false alarms, in all and by language."""
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic").where("toxic is not null")
    languages = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    rows = queries.QUERIES["op8_toxicity"](spark, d).where("held_out").join(labels, "doc_id").join(languages, "doc_id").collect()
    toxic = [r for r in rows if r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic)
    assert sum(r.predicted for r in rows if not r.toxic) <= 0.03 * (len(rows) - len(toxic))
    for lang in {r.lang for r in toxic}:
        mine = [r.predicted for r in toxic if r.lang == lang]
        assert len(mine) < 10 or sum(mine) >= 0.7 * len(mine)


def test_a_hot_key_cuts_no_sample_short(spark):
    rows = spark.range(3000).selectExpr("case when id < 1000 then 7 else id end k", "id")
    for salt in range(4):
        got = labelled.bounded(rows, "k", 1500, salt)
        assert got.count() == 1500 == got.select("id").distinct().count()
        assert sorted(r.id for r in got.collect()) == sorted(r.id for r in labelled.bounded(rows.repartition(7), "k", 1500, salt).collect())


def test_toxicity_with_repeats_clashes_and_an_empty_table(toxic_model, spark):
    model = toxic_model
    odd = spark.createDataFrame([(1, "scum and idiot " * 20, 0.5, 3), (1, "scum and idiot " * 20, 0.5, 3), (2, "", 0.1, 4)], "doc_id long, text string, score double, label int")
    got = toxicity.score(odd, model).collect()
    assert [r.doc_id for r in got] == [1, 1, 2] and got[0].score == got[1].score > 0.5 > got[2].score
    assert toxicity.score(odd.limit(0), model).count() == 0


def test_toxicity_without_labels(graded):
    docs, marks, _ = graded
    for m in (marks.limit(0), marks.where("toxic = 0")):
        assert len({r.score for r in toxicity.score(docs, toxicity.train(docs, m)).collect()}) == 1


def test_held_out_rows_and_samples(graded, spark):
    docs, marks, _ = graded
    ids = spark.createDataFrame([(i,) for i in [*range(50), None]], "doc_id long")
    assert all(r[1] == (fold(r[0], 5) == 0) for r in ids.select("doc_id", labelled.held_out("doc_id", 5)).collect())
    got = labelled.sample(docs, marks, "toxic", 5, {0: 30, 1: 10})
    sizes = dict(got.groupBy("label").count().collect())
    assert 15 <= sizes[0] <= 30 and 5 <= sizes[1] <= 10
    many = labelled.bounded(spark.range(100_000), "id", 1000, 3)
    assert many.count() == 1000 and labelled.bounded(spark.range(50), "id", 1000, 3).count() == 50
    assert not [r for r in got.collect() if fold(r.doc_id, 5) == 0]


def plain_unigram(rows):
    tokens = lambda t: TOKEN.findall("".join(c.lower() if c < "\x80" else c for c in t or ""))
    c, ends = Counter(), 0
    for i, t in rows:
        if fold(i, 10):
            c.update(tokens(t))
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    out = {}
    for i, t in rows:
        w = tokens(t)
        each = [c[x] for x in w] + [ends]
        out[i] = (len(each), sum(x > 0 for x in each), n, sum(math.log10((x + 0.1) / (n + 0.1 * (v + 1))) for x in each))
    return out


@pytest.mark.parametrize("frequent", [200_000, 40])  # with few frequent words, most counts come by the shuffle
def test_language_model(spark, frequent):
    rng = random.Random(9)
    tongues = [["le", "la", "un", "du", "vient"], ["der", "die", "das", "und", "kommt"]]
    rows = []
    for i in range(200):
        w = [rng.choice(tongues[i % 2]) if rng.random() < 0.8 else f"{rng.choice('abcd')}{rng.randrange(60)}{'ou' if i % 2 else 'en'}" for _ in range(rng.randint(5, 60))]
        rows.append((i, " ".join(w)))
    rows += [(500, None), (501, ""), (502, "Le LA é le"), (None, "der die"), rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, counts = brown.train(docs, most_units=30, most_frequent=frequent, classes=8)
    assert np.allclose((10.0**model.transition).sum(1), 1)
    got = brown.scores(docs, model, counts).collect()
    assert len(got) == len(rows)
    want = plain_unigram(rows)
    for r in got:
        n, known, total, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and math.isclose(r.base_score, base, rel_tol=1e-9), r.doc_id
        assert r.score <= 0
    held = [r for r in got if fold(r.doc_id, 10) == 0]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_the_model_sums_to_one(spark):
    """Over all classes and words, and one unknown word for each class, the probabilities after any class add up to 1."""
    docs = spark.createDataFrame([(i, f"a b{i % 7} c{i % 3} a") for i in range(60)], "doc_id long, text string")
    model, counts = brown.train(docs, most_units=3, most_frequent=5, classes=5)
    table = {r.word: r.c for r in counts.collect()}
    words = brown.find_words(pa.array(["a", *[f"b{k}" for k in range(7)], *[f"c{k}" for k in range(3)]]), brown.byte_classes("nonspace"))
    cls = model.of[brown._units(words, model.units)]
    mass = np.zeros(5)
    for h, k in zip(words.hash.astype(np.int64).tolist(), cls.tolist(), strict=True):
        mass[k] += (table[h] + brown.ALPHA) / 10 ** model.spread[k]
    mass += brown.ALPHA / 10**model.spread
    mass[0] = 1  # the end is its class's only token
    assert np.allclose(mass, 1)


def test_a_model_of_nothing(spark):
    docs = spark.createDataFrame([(0, "x"), (1, None)], "doc_id long, text string")
    model, counts = brown.train(docs.limit(0))
    assert [(r.n_known, r.base_score) for r in brown.scores(docs, model, counts).collect()] == [(0, 0.0)] * 2
    assert brown.scores(docs.limit(0), model, counts).count() == 0


def test_exchange_finds_alternating_classes():
    rng = np.random.default_rng(1)
    n = np.zeros((21, 21))
    side = rng.integers(0, 2, 20)
    for a in range(20):
        for b in range(20):
            if side[a] != side[b]:
                n[a + 1, b + 1] = rng.integers(5, 20)
    of = brown.exchange(n, 3)
    assert of[0] == 0 and len(set(of[1:][side == 0])) == 1 and len(set(of[1:][side == 1])) == 1


def test_every_grade_counts(spark):
    rows = [(i, " ".join([f"grade{i % 13}"] * 3 + ["word"] * (i % 5))) for i in range(650)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.train(docs, spark.createDataFrame([(i, i % 13 / 2) for i in range(650)], "doc_id long, quality double"))
    assert model.grades == tuple(k / 2 for k in range(13))
    got = {r.doc_id: r.expected_grade for r in quality.graded(docs, model).select("row.doc_id", "expected_grade").collect()}
    assert min(got[i] for i in got if i % 13 >= 10) > 3
    # More ratings than GRADES: groups of them, none of them left out.
    labels = spark.createDataFrame([(i, i / 650) for i in range(650)], "doc_id long, quality double")
    grouped = quality._grouped(labels, "quality")
    assert grouped.count() == 650 and grouped.select("quality").distinct().count() <= quality.GRADES
    assert all(abs(r.quality - r.doc_id / 650) < 0.1 for r in grouped.collect())


def test_cumulative_links_against_plain_formulas(spark):
    rng = np.random.default_rng(2)
    n, k = 300, 4
    starts = np.arange(0, 2 * n + 1, 2)
    bucket = rng.integers(0, 40, 2 * n)
    value = rng.random(2 * n)
    grade = np.clip((bucket[::2] // 10 + rng.integers(0, 2, n)), 0, k - 1)
    cuts, w = quality.fit(starts, bucket, value, grade, k)
    counts = np.bincount(grade, minlength=k)

    def loss(cuts, w):
        total = 0.0
        for i in range(n):
            s = sum(w[bucket[j]] * value[j] for j in (2 * i, 2 * i + 1))
            above = [1.0, *(1 / (1 + math.exp(-(s - c))) for c in cuts), 0.0]  # P(grade > j - 1)
            total -= math.log(above[grade[i]] - above[grade[i] + 1]) / counts[grade[i]] * n / k
        return total / n + quality.RIDGE * float(w @ w) / 2

    best = loss(cuts, w)
    for j in range(k - 1):  # no threshold, and no weight, can be moved to a much smaller loss
        for by in (-0.05, 0.05):
            assert loss(cuts + by * np.eye(k - 1)[j], w) > best - 1e-3
    for b in range(0, 40, 5):
        for by in (-0.1, 0.1):
            moved = w.copy()
            moved[b] += by
            assert loss(cuts, moved) > best - 1e-3
    docs = spark.createDataFrame([(1, "a b a"), (2, None)], "doc_id long, text string")
    model = quality.Model((0.0, 1.5, 4.0), np.array([-0.5, 0.7]), rng.normal(size=quality.BUCKETS))
    for r in quality.graded(docs, model).select("row.text", "expected_grade", "tail").collect():
        starts, bucket, value = quality.features(pa.array([r.text or ""]))
        s = sum(model.weights[b] * v for b, v in zip(bucket, value, strict=True))
        above = [1 / (1 + math.exp(-(s - c))) for c in model.thresholds]
        assert math.isclose(r.tail, above[0]) and math.isclose(r.expected_grade, 1.5 * above[0] + 2.5 * above[1])


def test_a_sample_is_bounded_in_rows(spark):
    docs = spark.createDataFrame([(7, f"text {i}") for i in range(500)] + [(i, "x") for i in range(100, 160)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in [7, *range(100, 160)]], "doc_id long, quality int")
    got = labelled.sample(docs, labels, "quality", 5, {1: 20}).collect()
    assert 0 < len(got) <= 20 and len({r.doc_id for r in got}) == len(got)


def test_words_that_are_no_units_get_classes_by_their_own_bigrams(spark):
    rng = random.Random(4)
    left, right = ["la", "le", "un"], ["og", "ik", "en"]
    # Words of two kinds with one ending: what stands before and after tells them apart.
    one, two = [f"x{k}z" for k in range(20)], [f"y{k}z" for k in range(20)]
    rows = [(i, " ".join(f"{rng.choice(left)} {rng.choice(one)} {rng.choice(right)} {rng.choice(two)}" for _ in range(10))) for i in range(150)]
    model, _ = brown.train(spark.createDataFrame(rows, "doc_id long, text string"), most_units=6, classes=6)
    words = brown.find_words(pa.array([*one, *two]), brown.byte_classes("nonspace"))
    cls = model.of[brown._units(words, model.units)]
    assert len(set(cls[:20])) == 1 and len(set(cls[20:])) == 1 and cls[0] != cls[20]


def test_the_most_frequent_words_of_a_wide_step(spark):
    counts = spark.range(5000).selectExpr("id * 7919 as word", "0 as ending", "if(id < 10, 9L, 2L) as c")
    got = brown._most_frequent(counts, 300)
    assert 280 <= got.count() <= 300 and got.where("c = 9").count() == 10
    assert brown._most_frequent(counts, 5000).count() == 5000


@pytest.mark.parametrize("frequent", [200_000, 25])
def test_language_model_scores_against_a_plain_loop(spark, frequent):
    """Given each word's class, transitions, emissions and sums are those of plain counting."""
    rng = random.Random(3)
    tokens = lambda t: TOKEN.findall("".join(c.lower() if c < "\x80" else c for c in t or ""))
    rows = [(i, " ".join(f"{rng.choice('abc')}{rng.randrange(25)}{rng.choice(['en', 'ou'])}" for _ in range(rng.randint(1, 40)))) for i in range(120)]
    rows += [(300, None), (301, "Unseen A1en é"), rows[4], rows[4], (None, "b2ou " * 3000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, word string")
    model, counts = brown.train(docs, most_units=12, most_frequent=frequent, classes=7)

    def cls(word):
        found = brown.find_words(pa.array([word]), brown.byte_classes("nonspace"))
        return int(model.of[brown._units(found, model.units)][0])

    train = [tokens(t) for i, t in rows if fold(i, 10)]
    c = Counter(w for t in train for w in t)
    of = {w: cls(w) for t in rows for w in tokens(t[1])}
    size, kinds, q = Counter(), Counter(), Counter()
    for w, n in c.items():
        size[of[w]] += n
        kinds[of[w]] += 1
    size[0], kinds[0] = len(train), 1
    # Texts stand one after another: the end of one is before the first word of the next.
    for t in train:
        q.update(zip([0, *map(of.get, t)], [*map(of.get, t), 0]))
    total = sum(q.values())
    into = {b: sum(n for (_, y), n in q.items() if y == b) for b in range(7)}
    out = {a: sum(n for (x, _), n in q.items() if x == a) for a in range(7)}
    follow = {a: sum(n > 0 for (x, _), n in q.items() if x == a) for a in range(7)}

    def score(t):
        line, s = [0, *map(of.get, t), 0], 0.0
        for a, b in zip(line, line[1:]):
            plain = (into[b] + 1) / (total + 7)
            s += math.log10((q[a, b] + follow[a] * plain) / (out[a] + follow[a]) if out[a] else plain)
        each = [(c[w], of[w]) for w in t]  # the end is the only token of its class
        return s + sum(math.log10((n + 0.1) / (size[k] + 0.1 * (kinds[k] + 1))) for n, k in each)

    got = brown.scores(docs, model, counts).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        assert math.isclose(r.score, score(tokens(texts[r.doc_id])), rel_tol=1e-6), r.doc_id


def test_texts_are_split_once_for_all_counts(spark, monkeypatch):
    """Counts of bigrams, and of what stands beside each word, are made from the words' numbers, and are those of a plain loop."""
    monkeypatch.setattr(brown, "AT_ONCE", 3)
    texts = ["a b a", None, "", "b b c a", "c"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    found = brown.find_words(pa.array(["a", "b"]), brown.byte_classes("nonspace"))
    frequent = np.sort(found.hash)
    lines = docs.mapInArrow(brown._number_words(frequent), "line binary").cache()
    unit = {w: 1 + brown.ENDINGS + int(np.searchsorted(frequent, h)) for w, h in zip("ab", found.hash.tolist(), strict=True)}
    of = np.full(1 + brown.ENDINGS + 2, 3)
    of[0], of[unit["a"]], of[unit["b"]] = 0, 1, 2
    want = np.zeros((4, 4))
    line = [0, *(k for t in texts for k in [*({"a": 1, "b": 2, "c": 3}[w] for w in (t or "").split()), 0])]
    for x, y in zip(line[:-1], line[1:], strict=True):
        want[x, y] += 1
    assert brown._bigrams(lines, of, 4).tolist() == want.tolist()
    number = np.full(len(of), -1)
    number[unit["b"]] = 0
    sides = lines.mapInArrow(brown._count_sides(number, of, 4), "word long, place int, c long").groupBy("word", "place").agg(F.sum("c").alias("c")).collect()
    assert {(r.word, r.place): r.c for r in sides} == {(0, k + 4 * s): v for s, row in enumerate((want[:, 2], want[2])) for k, v in enumerate(row) if v}
    # Only the counts of words, their numbers, and the scores read texts.
    calls, split = [], brown._number_words
    monkeypatch.setattr(brown, "_number_words", lambda frequent: calls.append(1) or split(frequent))
    brown.train(docs.select(F.lit(1).cast("long").alias("doc_id"), "text"), most_units=1, classes=3)
    assert len(calls) == 1

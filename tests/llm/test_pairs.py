"""N-gram Jaccard, fuzzy lines and embeddings against brute force, with odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import embedding, jaccard, line_dedup
from millrace.llm.graph import connected_components
from millrace.llm.units import forest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))


def roots(n, links):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def corpus(seed, n=40):
    """Groups of copies and near copies, one of them large, between texts of their own."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgéñ") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(30, 120))] for _ in range(8)]
    out = []
    for i in range(n):
        w = list(base[0] if i % 3 == 0 else rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append(" ".join(w))
    return out


def brute(texts, n=5, threshold=0.8):
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    return [
        (a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9
    ]


@pytest.mark.parametrize("rows", [256, 4])  # few rows to a chunk: groups meet chunk by chunk
def test_ngram_links(spark, monkeypatch, rows):
    monkeypatch.setattr(jaccard, "CHUNK_ROWS", rows)
    texts = [*corpus(1), None, "", "one two", "One, two!", "...", "x", *corpus(1)[:2]]
    df = spark.createDataFrame([(i + 100, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    links = brute(texts)
    root = roots(len(texts), links)
    got = {r.doc_id - 100: r for r in jaccard.ngram_links(df).collect()}
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert got[i].n_links == sum(i in p for p in links), i
        assert got[i].class_id == root[i] + 100, i


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.999), (0.5, 0.9), (0.9, 0.99)):
        bands, rows = jaccard.choose_bands(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall and bands * rows <= 128
    with pytest.raises(ValueError):
        jaccard.choose_bands(0.01, 0.9999)


def test_one_of_each_with_nulls_repeats_and_clashing_columns(spark):
    text = " ".join(f"word{i}" for i in range(30))
    rows = [(2, text, 1, "a"), (1, text, 2, "b"), (1, text, 2, "b"), (None, text, 3, "c"), (None, None, 4, "d"), (7, "", 5, "e"), (8, None, 6, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node int, row_key string")
    got = jaccard.one_of_each(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or -1, r.node) for r in got.collect()) == [(-1, 4), (1, 2), (7, 5), (8, 6)]
    assert jaccard.one_of_each(df.limit(0)).count() == 0


def brute_lines(docs):
    """The lines that stay, by exact equality and word-level edit similarity of all pairs."""
    lines = [(d, k, s) for d, t in sorted(docs) if t is not None for k, s in enumerate(t.split("\n"))]
    norm = [s.lower().strip(" ") for _, _, s in lines]
    links = []
    for a in range(len(lines)):
        for b in range(a + 1, len(lines)):
            if norm[a] and norm[b]:
                x, y = norm[a].split(" "), norm[b].split(" ")
                row = list(range(len(y) + 1))
                for i, p in enumerate(x, 1):
                    last, row[0] = row[0], i
                    for j, q in enumerate(y, 1):
                        last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != q))
                if row[-1] <= int(0.2 * max(len(x), len(y)) + 1e-9):
                    links.append((a, b))
    root = roots(len(lines), links)
    return {(d, k) for i, (d, k, _) in enumerate(lines) if root[i] == i or not norm[i]}


def test_fuzzy_lines(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(3, 8))) for _ in range(500)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(12, 30))] for _ in range(5)]

    def line():
        if rng.random() < 0.4:
            return " ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 20)))
        w = list(rng.choice(base))
        if rng.random() < 0.6:  # one word changed: a whole block stays, whatever the word
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        return " ".join(w).upper() if rng.random() < 0.2 else " ".join(w)

    docs = [(i, "\n".join(line() if rng.random() < 0.9 else "" for _ in range(rng.randint(1, 8)))) for i in range(30)]
    docs += [(40, None), (41, ""), (42, docs[0][1])]
    df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], DOCS)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).select("row.doc_id", "n_lines", "n_removed", "text").collect()}
    stay = brute_lines(docs)
    for d, t in docs:
        lines = t.split("\n") if t is not None else []
        want = [s for k, s in enumerate(lines) if (d, k) in stay]
        assert got[d].n_lines == len(lines) and got[d].n_removed == len(lines) - len(want), d
        assert got[d].text == (None if t is None else "\n".join(want)), d
    left = line_dedup.without_repeated_lines(df)
    assert left.columns == df.columns and 42 not in {r.doc_id for r in left.collect()}
    assert all(r.n_chars == len(r.text or "") for r in left.collect())


def test_lines_of_odd_tables(spark):
    rows = [(1, "a b c d e f\nx", 1), (1, "a b c d e f\nx", 1), (None, "a b c d e f", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bits int")
    got = line_dedup.without_repeated_lines(df)
    assert got.columns == ["doc_id", "text", "bits"] and sorted(r.doc_id for r in got.collect()) == [1, 1]
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
    long = " ".join(f"w{i}" for i in range(30_000))
    two = spark.createDataFrame([(1, long), (2, long.replace("w77 ", "changed "))], "doc_id long, text string")
    assert [r.n_removed for r in line_dedup.dedup_lines(two).orderBy("row.doc_id").collect()] == [0, 1]


def test_line_dedup_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, "a b c\nd"), (2, "a b c\ne")], "doc_id long, text string")
    for frame in (line_dedup.dedup_lines(df), line_dedup._sketches(line_dedup._hashed(df), line_dedup._frequencies(line_dedup._hashed(df)))):
        plan = frame._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize(("chunk", "pivots", "nodes"), [(4096, 64, 2048), (16, 64, 7), (16, 2, 2048)])
def test_embeddings(spark, monkeypatch, chunk, pivots, nodes):
    monkeypatch.setattr(embedding, "CHUNK", chunk)
    monkeypatch.setattr(embedding, "PIVOTS", pivots)
    monkeypatch.setattr(embedding, "NODES", nodes)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 6))
    v = [(c + 0.15 * rng.normal(size=6)).tolist() for c in centres[rng.integers(0, 4, 60)]] + rng.normal(size=(30, 6)).tolist()
    v += [v[0], v[0], [x * 1e20 for x in v[1]], [1.0, 0.0], [1.0, 0.0], [2.0, 0.1]]
    odd = [None, [], [0.0] * 6, [float("nan")] + [1.0] * 5, [None] + [1.0] * 5, [float("inf")] + [1.0] * 5]
    df = spark.createDataFrame([(i + 10, x) for i, x in enumerate([*v, *odd])], "vec_id long, embedding array<double>")
    links = []
    for a in range(len(v)):
        for b in range(a + 1, len(v)):
            if len(v[a]) == len(v[b]):
                x, y = np.array(v[a]), np.array(v[b])
                if x / np.linalg.norm(x) @ (y / np.linalg.norm(y)) >= 0.95:
                    links.append((a, b))
    root = roots(len(v) + len(odd), links)
    got = {r.vec_id - 10: r for r in embedding.embedding_links(df).collect()}
    for i in range(len(v) + len(odd)):
        assert (got[i].n_links, got[i].component_id - 10, got[i].kept) == (sum(i in p for p in links), root[i], root[i] == i), i
    assert embedding.embedding_links(df.limit(0)).count() == 0
    assert embedding.embedding_links(df.where("vec_id >= 106")).agg(F.sum("n_links")).first()[0] == 0


def test_components_and_forests(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(200, x) for x in range(201, 230)] + [(7, 7)]
    want = roots(240, edges)
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[x] == want[x] for e in edges for x in e if e[0] != e[1])
    a, b = map(np.array, zip(*edges, strict=True))
    assert forest(240, a, b).tolist() == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lines_with_several_changed_words(spark):
    """Every pair with edit similarity 0.8 or more in words is found, however many words were changed."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    lines = []
    for n, k in [(10, 2), (15, 3), (20, 2), (20, 4), (30, 3), (30, 6), (50, 5), (100, 5)]:
        for _ in range(8):
            w = rng.sample(vocabulary, n)
            lines.append(" ".join(w))
            for at in rng.sample(range(n), k):
                w[at] = rng.choice(vocabulary)
            lines.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = dict(line_dedup.dedup_lines(df).select("row.doc_id", "n_removed").collect())
    assert [got[i] for i in range(len(lines))] == [i % 2 for i in range(len(lines))]


def test_lines_alike_in_characters_or_but_for_punctuation(spark):
    rng = random.Random(13)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(4, 8))) for _ in range(300)]
    pairs = [
        ("Read more...", "Read more"), ("Copyright 2020 X", "Copyright 2021 X"), ("informations", "information"), ("a  b\tc", "a b c\r"), ("xylophone quartet", "xylophone-quartet"), ("sign in to comment", "sjgn in to comment"),
    ]
    for _ in range(20):  # a typo in three words of ten
        w = rng.sample(vocabulary, 20)
        other = list(w)
        for at in rng.sample(range(20), 6):
            other[at] = other[at][:2] + "x" + other[at][3:]
        pairs.append((" ".join(w), " ".join(other)))
    apart = ["Copyright 1999 Y", "on", "in", "..."]
    rows = [*(s for p in pairs for s in p), *apart]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = dict(line_dedup.dedup_lines(df).select("row.doc_id", "n_removed").collect())
    assert [got[i] for i in range(len(rows))] == [0, 1] * len(pairs) + [0] * len(apart)


def test_recall_by_length_and_changes(spark):
    """Share of the linked pairs at a word similarity of 0.8 or more, by words in the line and words replaced."""
    rng = random.Random(17)
    vocabulary = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(3, 9))) for _ in range(20_000)]
    cells = [(5, 1), (6, 1), (8, 1), (10, 1), (20, 1), (10, 2), (15, 3), (20, 4), (30, 3), (30, 6), (60, 12), (100, 20)]
    lines, cell = [], []
    for n, k in cells:
        for _ in range(60):
            w = rng.sample(vocabulary, n)
            other = list(w)
            for at in rng.sample(range(n), k):
                other[at] = rng.choice(vocabulary) + "x" * rng.choice([0, 0, 1, 30])
            lines += [" ".join(w), " ".join(other)]
            cell.append((n, k))
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = dict(line_dedup.dedup_lines(df).select("row.doc_id", "n_removed").collect())
    assert not any(got[2 * i] for i in range(len(cell)))
    for c in cells:
        found = [got[2 * i + 1] for i in range(len(cell)) if cell[i] == c]
        assert sum(found) >= 0.95 * len(found), (c, sum(found), len(found))


def test_recall_in_a_large_vocabulary(spark):
    """The same where there are more words than any table of fixed size holds, and words are replaced by new ones or by known ones."""
    rng = random.Random(18)
    vocabulary = [f"v{i:x}" for i in range(400_000)]
    usual = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    filler = [" ".join(vocabulary[k : k + 40]) for k in range(0, len(vocabulary), 40)]
    cells = [(n, k, new) for n, k in ((10, 2), (24, 4), (30, 6), (60, 12), (100, 20)) for new in (True, False)]
    lines, cell = [], []
    for n, k, new in cells:
        for _ in range(60):
            w = [rng.choice(usual if rng.random() < 0.4 else vocabulary) for _ in range(n)]
            other = list(w)
            for at in rng.sample(range(n), k):
                other[at] = f"n{rng.getrandbits(60):x}" if new else rng.choice(vocabulary)
            lines += [" ".join(w), " ".join(other)]
            cell.append((n, k, new))
    df = spark.createDataFrame(list(enumerate([*lines, *filler])), "doc_id long, text string").repartition(4)
    got = dict(line_dedup.dedup_lines(df).select("row.doc_id", "n_removed").collect())
    assert not any(got[2 * i] for i in range(len(cell)))
    for c in cells:
        found = [got[2 * i + 1] for i in range(len(cell)) if cell[i] == c]
        assert sum(found) >= 0.9 * len(found), (c, sum(found), len(found))


def test_very_long_lines(spark):
    long = [f"w{i}" for i in range(30_000)]
    near = [*long[:100], "put", "in", *long[100:20_000], *long[20_003:]]
    far = [w if i % 3 else f"other{i}" for i, w in enumerate(long)]
    df = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(far))], "doc_id long, text string")
    got = dict(line_dedup.dedup_lines(df).select("row.doc_id", "n_removed").collect())
    assert got == {1: 0, 2: 1, 3: 0}


@pytest.mark.parametrize("waves", [1, 3])
def test_no_link_by_words_is_lost(spark, monkeypatch, waves):
    """Lines of common words that differ as much as they may, in the worst places: each is found, also where words moved."""
    monkeypatch.setattr(line_dedup, "FEW_BLOCKS", 0 if waves > 1 else 1 << 40)
    monkeypatch.setattr(line_dedup, "WAVES", waves)
    rng = random.Random(19)
    usual = [f"u{i}" for i in range(150)]
    pairs = []
    for n in (5, 6, 9, 10, 11, 14, 15, 16, 19, 20, 24, 25, 29, 30, 45, 60, 100, 130, 200, 400):
        edits = int(n * (1 - line_dedup.SIMILARITY) + 1e-9)
        for kind in range(6):
            w = [rng.choice(usual) for _ in range(n)]
            other = list(w)
            if kind < 3:  # evenly spread, so that runs in common are as short as can be
                for k in range(edits):
                    other[(k + 1) * n // (edits + 1) - (kind == 1)] = "the" if kind == 2 else f"{n}new{k}{kind}"
            elif kind == 3:
                for k in reversed(range(edits)):
                    del other[(k + 1) * n // (edits + 1)]
            elif kind == 4:  # all words of the start are others
                other[:edits] = [f"{n}start{k}" for k in range(edits)]
            else:
                for k in range(edits // 2):
                    other.insert(0, f"{n}in{k}")
                    other.pop()
            pairs.append((" ".join(w), " ".join(other)))
    # Words put in at the start of a line of thousands of words move all that follow.
    w = [rng.choice(usual) for _ in range(5_000)]
    pairs.append((" ".join(w), " ".join([*(f"head{k}" for k in range(450)), *w[:4_550]])))
    df = spark.createDataFrame(list(enumerate(s for p in pairs for s in p)), "doc_id long, text string").repartition(4)
    got = dict(line_dedup.dedup_lines(df).select("row.doc_id", "n_removed").collect())
    assert [got[i] for i in range(2 * len(pairs))] == [0, 1] * len(pairs)


def test_links_by_characters_of_lines_of_up_to_short_characters(spark):
    """Lines with as many typos as they may have, spread over their words or in one place, are all found."""
    rng = random.Random(29)
    pairs = []
    for size in (*range(12, line_dedup.SHORT + 1, 3), 40, 43, 47, line_dedup.SHORT):
        for kind in range(4):
            line = "".join(rng.choice("abcdefgh") if i % 7 else " " for i in range(1, size + 1)).strip() + "k"
            edits = int(len(line) * (1 - line_dedup.CHARACTERS) + 1e-9)
            other = list(line)
            for k in range(edits):
                at = (k + 1) * len(line) // (edits + 1)
                at += line[at] == " "
                if kind == 0:
                    other[at] = "x"
                elif kind == 1:
                    other[at] = ""
                elif kind == 2 and len(line) + edits <= line_dedup.SHORT:
                    other[at] += "y"
                elif kind == 3:
                    other[k + (line[k] == " ")] = "z"
            pairs.append((line, "".join(other)))
    df = spark.createDataFrame(list(enumerate(s for p in pairs for s in p)), "doc_id long, text string").repartition(4)
    got = dict(line_dedup.dedup_lines(df).select("row.doc_id", "n_removed").collect())
    assert [got[i] for i in range(2 * len(pairs))] == [0, 1] * len(pairs)


def test_few_pairs_are_verified(spark, monkeypatch):
    """Long lines of usual words that share runs by chance are told apart by their parities, near copies of one line meet in few pairs."""
    seen = []
    verified = line_dedup._verified

    def counted(pairs, texts, similarity):
        seen.append(pairs.count())
        return verified(pairs, texts, similarity)

    monkeypatch.setattr(line_dedup, "_verified", counted)
    rng = random.Random(31)
    usual = [f"u{i}" for i in range(400)]
    lines = [" ".join(rng.choice(usual) for _ in range(rng.randint(200, 220))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(4)
    assert line_dedup.removed_lines(df).count() == 0 and sum(seen) < len(lines)
    seen.clear()
    base = [f"w{i}" for i in range(40)]
    lines = []
    for k in range(200):
        w = list(base)
        for at in rng.sample(range(20), 5):  # of two lines about a third are linked
            w[2 * at] = f"n{k}x{at}"
        lines.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(4)
    assert line_dedup.removed_lines(df).count() == 199 and sum(seen) < 40 * len(lines)


def test_common_passages_and_segments_make_few_pairs(spark, monkeypatch):
    """Lines that hold the same passage, or the same piece of a short line, aren't compared pair by pair unless they may be linked."""
    made = []
    cut = line_dedup.cut

    def counted(df, label):
        out = cut(df, label)
        if label in ("lines-candidates", "lines-pairs"):
            made.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "cut", counted)
    rng = random.Random(37)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 9)))
    usual, passage = [word() for _ in range(3_000)], " ".join(word() for _ in range(12))
    lines = []
    for _ in range(150):
        w = [rng.choice(usual) for _ in range(300)]
        w.insert(rng.randrange(300), passage)
        lines.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(4)
    assert line_dedup.removed_lines(df).count() == 0 and max(made) < 3 * len(lines)
    made.clear()
    short = [f"seenbefore {''.join(rng.choice('abcdefghij ') for _ in range(39))}z" for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(short)), "doc_id long, text string").repartition(4)
    assert line_dedup.removed_lines(df).count() == 0 and max(made) < 3 * len(short)


def test_blocks_of_the_same_lines_stay_once(spark):
    """Of blocks of the same lines one for each least line stays; no two lines that met are parted."""
    rng = random.Random(41)
    rows = []
    for bucket in range(400):
        keys = rng.sample(range(12), rng.choice([2, 2, 3, 5]))
        least = rng.choice(keys)
        # A short line may show a segment twice.
        rows += [(2 * bucket + bucket % 2, k, least) for k in keys + keys[:1] * (bucket % 7 == 0)]
    met = spark.createDataFrame(rows, "bucket long, key long, least long")
    out = line_dedup._once(met).collect()

    def pairs(of):
        blocks = {}
        for r in of:
            blocks.setdefault(r[0], set()).add(r[1])
        return {(b % 2, x, y) for b, ks in blocks.items() for x in ks for y in ks if x < y}

    assert pairs(out) == pairs(rows) == pairs([r for r in out if r.alone])
    sets = lambda of: Counter(tuple(sorted(k for b, k, *_ in of if b == c)) + (c % 2,) for c in {r[0] for r in of})
    assert set(sets(out)) == set(sets(rows)) and max(sets([r for r in out if r.alone]).values()) == 1
    assert {(r.bucket % 2, r.key, r.least) for r in out if r.key != r.least} >= {(b % 2, k, m) for b, k, m in rows if k != m and len({x for c, x, _ in rows if c == b}) > 2}


def test_pairs_are_verified_once_over_all_waves(spark, monkeypatch):
    """Unlinked lines that share several runs meet in several waves; they are compared once."""
    monkeypatch.setattr(line_dedup, "FEW_BLOCKS", 0)
    seen, verified = [], line_dedup._verified

    def kept(pairs, *args):
        seen.extend(map(tuple, pairs.collect()))
        return verified(pairs, *args)

    monkeypatch.setattr(line_dedup, "_verified", kept)
    rng = random.Random(43)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    lines = []
    for _ in range(40):  # a fourth of the words differ: beyond the limit by words and by characters, but not by parities
        w = [word() for _ in range(40)]
        lines += [" ".join(w), " ".join(word() if i % 4 == 3 else x for i, x in enumerate(w))]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(4)
    assert line_dedup.removed_lines(df).count() == 0 and len(seen) == len(set(seen)) == 40


def test_the_largest_block_stands_for_those_within(spark):
    """Blocks of a passage's runs hold ever fewer of the same lines: their pairs are compared in one of them, and no pair in none."""
    rng = random.Random(47)
    rows = [(2 * b, k, 60 - 2 * b) for b in range(10) for k in range(60 - 2 * b)]  # each within the one before
    for b in range(10, 200):
        keys = rng.sample(range(60), rng.choice([3, 4, 7]))
        rows += [(2 * b + b % 2, k, len(keys)) for k in keys]
    out = line_dedup._with_largest(spark.createDataFrame(rows, "bucket long, key long, size long")).collect()
    made = Counter()
    for x in out:
        for y in out:
            if x.bucket == y.bucket and x.key < y.key and (x.largest != y.largest or x.largest == x.block):
                made[x.bucket % 2, x.key, y.key] += 1
    assert set(made) == {(b % 2, k, m) for b, k, _ in rows for c, m, _ in rows if b == c and k < m}
    assert max(n for (odd, *_), n in made.items() if not odd) == 1


def test_line_tables_are_dropped_before_the_largest_joins(spark, monkeypatch):
    """A disk holds the sketches up to the join of blocks, and of the hashes of words only those that are still to be sketched."""
    held, seen = {}, {}

    def noting(make):
        def made(df, label, *more):
            seen[label] = sorted(held.values())
            out = make(df, label, *more)
            held.update((t._millrace_path, label) for t in (out if isinstance(out, list) else [out]))
            return out

        return made

    def dropped(*tables):
        for t in tables:
            held.pop(t._millrace_path)
        drop(*tables)

    drop = line_dedup.drop
    for name in ("cut", "cut_parts"):
        monkeypatch.setattr(line_dedup, name, noting(getattr(line_dedup, name, None)), raising=False)
    monkeypatch.setattr(line_dedup, "drop", dropped)
    line = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(k, f"{line} {w}\nalone {w * 9}") for k, w in enumerate(["a", "b", "c", "a"])], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(docs).collect()}
    assert got == {0: f"{line} a\nalone aaaaaaaaa", 1: "alone bbbbbbbbb", 2: "alone ccccccccc"}
    assert seen["lines-sketches"] == ["lines", "lines-hashed", "lines-sketches"]  # for the second half
    assert not {"lines-hashed", "lines-sketches"} & set(seen["lines-stars"] + seen["lines-named"] + seen["lines-pairs"])
    # Only what removed_lines and dedup_lines return is left.
    assert sorted(set(held.values())) == ["lines", "lines-at", "lines-first", "lines-gone"]

"""Words, decontamination, mixing, WARC and chat formats against plain versions, with odd rows."""

import hashlib
import io
import json
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from millrace.llm import chat, decontaminate, mixing, queries, warc
from millrace.llm.words import byte_classes, find_words, hash_word, windows
from tests.llm.test_pairs import DOCS, words


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aA0 .é\n\tñ中", max_size=20)), min_size=1, max_size=8))
@settings(max_examples=100, deadline=None)
def test_words_of_a_column(texts):
    w = find_words(pa.array(texts, pa.string()), byte_classes("alnum"))
    assert [w.text(i) for i in range(len(w.hash))] == [x for t in texts for x in words(t)]
    assert w.counts().tolist() == [len(words(t)) for t in texts]
    for i in range(len(w.hash)):
        assert int(w.hash[i]) == hash_word(w.text(i))


def test_words_longer_than_a_piece():
    from millrace.llm import words as module

    text = "a" * (3 * module.PIECE + 5) + " b " + "c" * module.PIECE
    w = find_words(pa.array([text, "b"]), byte_classes("alnum"))
    assert w.counts().tolist() == [3, 1] and w.hash[1] == w.hash[3] and w.hash[0] != w.hash[2]


def test_windows_of_short_rows():
    w = find_words(pa.array(["a b c", "", "a b c d e f", None]), byte_classes("alnum"))
    assert windows(w, 5)[1].tolist() == [0, 2, 2]


def plain_hits(text, items, n=10):
    w = words(text)
    hit, found = set(), set()
    for i, t in items:
        x = words(t)
        k = min(n, len(x))
        wins = {tuple(x[p : p + k]) for p in range(len(x) - k + 1)} if x else set()
        for p in range(len(w) - k + 1):
            if tuple(w[p : p + k]) in wins:
                hit.update(range(p, p + k))
                found.add("" if i is None else str(i))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("chars", [8_000_000, 60])  # one block, and many
def test_contamination(spark, chars):
    rng = random.Random(4)
    vocabulary = list("abcdefgh") + ["é", "ñandú", "x1"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 10, 12, 25]))) for i in range(20, 32)] + [(2, None), (3, ""), (4, "..."), (None, text(11))]
    docs = [text(rng.randint(0, 60)) for _ in range(40)] + [None, "", "?!"]
    docs += [f"zz {items[k][1]} qq, {items[k][1].upper()}" for k in range(12)] + ["y " * 30 + items[3][1]]
    df = spark.createDataFrame([(i, d, "row") for i, d in enumerate(docs)], "doc_id long, text string, hits string")
    found = decontaminate.contamination(df, spark.createDataFrame(items, "item_id long, text string"), block_chars=chars)
    got = {r.row.doc_id: r for r in found.collect()}
    for i, d in enumerate(docs):
        n, hit, ids = plain_hits(d, items)
        assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == (n, hit, ids), i
        assert got[i].row.hits == "row"
        assert got[i].hits is None if not hit else int(np.unpackbits(np.frombuffer(got[i].hits, np.uint8)).sum()) == hit
    clean = decontaminate.decontaminate(df, spark.createDataFrame(items, "item_id long, text string"))
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {i for i, d in enumerate(docs) if not plain_hits(d, items)[1]}


def test_longest_match_and_empty_tables(spark):
    item = " ".join(f"w{i}" for i in range(30))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    df = spark.createDataFrame([(1, "x " + " ".join(f"w{i}" for i in range(5, 22)) + " y")], "doc_id long, text string")
    assert decontaminate.contamination(df, bench).select("n_hit", "longest").first() == (17, 17)
    assert decontaminate.contamination(df, bench.limit(0)).select("n_hit").first()[0] == 0
    assert decontaminate.contamination(df.limit(0), bench).count() == 0


def plain_targets(sizes, weights, repeats=3):
    """Shares by weight; what is above a limit is shared again until nothing is."""
    total, left = sum(sizes), dict(enumerate(sizes))
    out, rest = {}, float(total)
    while left:
        w = sum(weights[i] for i in left)
        over = [i for i in left if rest * weights[i] / w > repeats * sizes[i]]
        if not over:
            return [out.get(i, rest * weights[i] / w if i in left else 0) for i in range(len(sizes))]
        for i in over:
            out[i] = repeats * sizes[i]
            del left[i]
        rest = total - sum(out.values())
    return [out[i] for i in range(len(sizes))]


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 3)
    rng = random.Random(6)
    per_source = {"a": 40, "b": 2, "c": 1, "d": 9, "é": 5, None: 3}
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), "en", s, 0) for i, s in enumerate(s for s, n in per_source.items() for _ in range(n))]
    rows += [(900, None, "en", "a", 0), (901, "", "en", "b", 0), (None, "x y", "en", "a", 0), (5, rows[5][1], "en", "a", 0)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.readings(df).collect()
    assert len(got) == len(rows)
    names = ["a", "b", "c", "d", "é", None]
    sizes = [sum(len((t or "").split()) for _, t, _, s, _ in rows if s == name) for name in names]
    want = plain_targets(sizes, [1, 2, 3, 1, 2, 3])
    for name, size, target in zip(names, sizes, want, strict=True):
        mine = [r for r in got if r.source_size == size and abs(r.target - target) < 1e-6]
        assert mine and sum(r.taken for r in mine) == int(target + 1e-9), name
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.taken == sum(e.words for e in r.epochs) and all(0 <= e.position <= 1 for e in r.epochs)
    assert sorted(map(str, mixing.readings(df).collect())) == sorted(map(str, got))
    order = mixing.mixed(df.withColumn("mix_epoch", F.lit("clash"))).collect()
    assert [r.mix_position for r in order] == sorted(r.mix_position for r in order)
    assert sum(r.mix_words for r in order) == sum(r.taken for r in got)
    assert mixing.mixed(df.limit(0)).count() == 0 and mixing.readings(df.where("text = ''")).first().taken == 0


def test_positions_invert_the_demand(spark):
    for k, knots in enumerate(mixing.SCHEDULES):
        share = spark.range(101).select((F.col("id") / 100).alias("share"))
        got = [r[0] for r in share.select(F.expr(mixing.position_sql(mixing.SCHEDULES, str(k), "share"))).collect()]
        grid = np.linspace(0, 1, 20001)
        w = np.interp(grid, *zip(*knots, strict=True))
        area = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2 / 20000)])
        assert np.allclose(np.interp(got, grid, area / area[-1]), np.linspace(0, 1, 101), atol=1e-6)


def test_warc_round_trip(spark):
    rows = [(3, "http://a/ b\n", "same"), (1, None, "same"), (2, "u", None), (7, "u", ""), (None, "u", "same"), (9, "u", "é" * 70_000 + "\r\n\r\nWARC/1.1\r\n"), (1, None, "same")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for least in (0, 4, 5):
        archives = warc.write_warc(df, least_bytes=least, roll_bytes=2000)
        got = warc.read_warc(archives).where("record_type <> 'warcinfo'").collect()
        assert len(got) == len(rows)
        for r in got:
            i = re.fullmatch(r"<urn:page:(.*)>", r.record_id)[1]
            html = {"3": "same", "1": "same", "none": "same", "2": "", "7": "", "9": rows[5][2]}[i].encode()
            assert r.payload_bytes == len(html) and r.payload_digest == warc.sha1_base32(html)
            first = {"same": 1, "": 2}.get(html.decode()) if len(html) >= least else None
            revisit = first is not None and i != str(first)
            assert (r.record_type, r.refers_to) == (("revisit", f"<urn:page:{first}>") if revisit else ("response", None))
            assert r.payload == (b"" if revisit else html)
    assert warc.read_warc(warc.write_warc(df.limit(0))).count() == 0


def test_warc_reader_takes_small_pieces_and_finds_damage():
    class Slow(io.BytesIO):
        def read(self, n=-1):
            return super().read(min(n, 7))

    data = b"".join(warc.page_record(i, "u", b"payload" * i, None, False) for i in range(4))
    got = list(warc.read_records(Slow(data)))
    assert [r["payload"] for r in got] == [b"payload" * i for i in range(4)]
    assert [r["payload_bytes"] for r in warc.read_records(Slow(data), keep_payload=False)] == [0, 7, 14, 21]
    assert list(warc.read_records(io.BytesIO(b""))) == []
    one = warc._record([("WARC-Type", "resource"), ("WARC-Payload-Digest", "sha1:AAAA")], b"x")
    for bad in (data[:-3], one, data + b"junk", warc._record([("WARC-Type", "resource")], b"abc")[:20]):
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(bad)))


ESCAPES = st.text(alphabet="<|\\>n\nim_endstar é", max_size=30)


@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), ESCAPES), ESCAPES), max_size=6))
@settings(max_examples=300, deadline=None)
def test_chat_round_trip(turns):
    text, spans = chat.format_turns(turns)
    assert chat.parse_turns(text) == turns
    assert chat.masked_texts(text, spans) == [t for r, t in turns if r == "assistant"]
    assert text.count(chat.END) == len(turns)


@pytest.mark.parametrize(("record", "want"), [
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]}, [("user", "a"), ("assistant", "")]),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, [("user", "a"), ("assistant", "b")]),
    ({"instruction": "do", "output": "done"}, [("user", "do"), ("assistant", "done")]),
    ({"instruction": "do", "input": "x", "output": "done"}, [("user", "do\n\nx"), ("assistant", "done")]),
    ({"prompt": "p", "response": "r"}, [("user", "p"), ("assistant", "r")]),
    ({"question": "q", "answer": {"text": "t"}}, [("user", "q"), ("assistant", "t")]),
    ({"turns": []}, []), ({"what": 1}, None),
])
def test_layouts(record, want):
    assert chat.canonical_turns(record) == want
    assert len(chat.fingerprint(chat.field_paths(record))) == 16


def test_chat_of_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "x<|im_end|>\n"), (1, 1, "assistant", "x<|im_end|>\n"), (None, 0, None, "t"), (2, None, "assistant", "")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, record string")
    got = {r.id: r for r in chat.read_back(chat.format_records(chat.conversation_records(df))).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == digest("user\n\n" + "assistant\nx<|im_end|>\n\n" * 2) and got[1].loss_sha256 == digest("x<|im_end|>\n" * 2) and got[1].n_turns == 3
    assert got[None].turns_sha256 == digest("\nt\n") and got[2].loss_chars == 0
    odd = spark.createDataFrame([(1, None), (2, "not json"), (3, json.dumps([1])), (4, '{"a": 1}')], "id long, record string")
    assert [r.formatted for r in chat.format_records(odd).collect()] == [None] * 4
    assert chat.read_back(chat.format_records(odd)).where("n_turns is not null").count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name, tmp_path):
    from tests.test_queries import DATA, TABLES, plain

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = plain(queries.QUERIES[name](spark, DATA).toPandas()), plain(con.execute(queries.ORACLES[name]).df())
    for c in got.columns:  # an integer column with nulls has another type in each frame
        assert [str(x).removesuffix(".0").replace("<NA>", "nan").replace("None", "nan") for x in got[c]] == [str(x).removesuffix(".0").replace("<NA>", "nan").replace("None", "nan") for x in want[c]], c


def test_a_hit_on_the_last_word_before_empty_texts(spark):
    docs = spark.createDataFrame([(1, "some words secret"), (2, ""), (3, None)], "doc_id long, text string").coalesce(1)
    found = decontaminate.contamination(docs, spark.createDataFrame([("a", "Secret")], "item_id string, text string"))
    assert [(r.n_hit, r["items"]) for r in found.orderBy("row.doc_id").collect()] == [(1, ["a"]), (0, []), (0, [])]


def test_chat_of_long_texts_clashing_columns_and_an_empty_table(spark):
    long = "<|im_end|>\n" * 30_000
    rows = spark.createDataFrame([(1, 0, "user", long, "x"), (1, 1, "assistant", long, "y")], "conv_id long, turn int, role string, text string, formatted string")
    got = chat.read_back(chat.format_records(chat.conversation_records(rows))).collect()
    assert len(got) == 1 and (got[0].n_turns, got[0].loss_chars) == (2, len(long))
    assert chat.read_back(chat.format_records(chat.conversation_records(rows.limit(0)))).count() == 0


def test_waves_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "WAVE", 1)
    docs = spark.createDataFrame([(i, f"w{i} and some more words " + "x " * 50) for i in range(6)], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"w{i} and some") for i in range(4)], "item_id long, text string")
    got = decontaminate.contamination(docs, items, block_chars=5).select("row.doc_id", "n_hit", "items").collect()
    assert {r.doc_id: (r.n_hit, r["items"]) for r in got} == {i: (3, [str(i)]) if i < 4 else (0, []) for i in range(6)}


def test_pages_with_long_payloads_and_clashing_columns(spark, tmp_path):
    long = "<p>é" * 400_000
    pages = spark.createDataFrame([(3, "u", long, "a"), (1, "v", long, "b"), (2, "w", None, "c"), (None, "z", long, "d")], "page_id long, url string, html string, same string")
    got = {r.page_id: (r.refers_to, r.revisit) for r in warc.with_revisits(pages).collect()}
    assert got == {1: (None, False), 3: (1, True), None: (1, True), 2: (None, False)}
    assert warc.with_revisits(pages.limit(0)).count() == 0

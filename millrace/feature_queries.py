"""Queries for packets, ranged reads, weighted draws, failing sources, intervals, sinks, streams and experiments, each with the SQL that must give the same rows.

Those that need files or a stream write them from the given tables, below the folder that the cluster shares.
"""

from __future__ import annotations

import io
import zipfile

import numpy as np
from pyspark.sql import DataFrame, functions as F

from millrace import experiments, stats
from millrace.functions import arrays, filters
from millrace.operators import batch, core, functions, sample, weighted
from millrace.operators.position import with_pos
from millrace.queries import EVENT, joined, query
from millrace.session import table
from millrace.sources import codecs, files, formats, iterables, media, packets, ranges
from millrace.streaming import epochs, replay, state
from millrace.tables import cut, new_path

# -- packets ---------------------------------------------------------------------------------------------------

STREAMS = 97


def _packets(spark, d) -> DataFrame:
    """Events as packets: every twelfth one of a stream and some others are keys, and some are shown before the key they follow."""
    e = table(spark, d, "events").select((F.col("user_id") % STREAMS).alias("stream"), "event_id", "user_id")
    e = with_pos(e, EVENT, "index", within=["stream"])
    late = F.when((F.col("index") % 12).isin(1, 2), 25).when(F.col("index") % 31 == 5, 140).otherwise(0)
    return e.select("stream", "index", (F.col("index") * 10 - late).alias("pts"), ((F.col("index") % 12 == 0) | (F.col("user_id") % 29 == 0)).alias("is_key"))


_PACKETS = (
    "e AS (SELECT user_id % 97 AS stream, user_id, row_number() OVER (PARTITION BY user_id % 97 ORDER BY event_id) - 1 AS i FROM events), "
    "p AS (SELECT stream, i, i * 10 - CASE WHEN i % 12 IN (1, 2) THEN 25 WHEN i % 31 = 5 THEN 140 ELSE 0 END AS pts, i % 12 = 0 OR user_id % 29 = 0 AS is_key FROM e), "
    "k AS (SELECT stream, i, pts, row_number() OVER (PARTITION BY stream ORDER BY i) - 1 AS split, lead(i) OVER w AS next_i, lead(pts) OVER w AS next_pts FROM p WHERE is_key OR i = 0 WINDOW w AS (PARTITION BY stream ORDER BY i)), "
    "n AS (SELECT stream, max(i) AS last FROM p GROUP BY 1), "
    "late AS (SELECT k.stream, k.split, max(p.i) AS i FROM k JOIN p ON p.stream = k.stream AND p.i > k.next_i AND p.pts < k.next_pts GROUP BY 1, 2), "
    "ends AS (SELECT k.*, coalesce(late.i + 1, k.next_i, n.last + 1) AS stop FROM k JOIN n USING (stream) LEFT JOIN late ON late.stream = k.stream AND late.split = k.split), "
    "s AS (SELECT e.stream, e.split, e.i AS start, e.stop, count(p.i) AS num_invalid FROM ends e LEFT JOIN p ON p.stream = e.stream AND p.i >= e.i AND p.i < e.stop AND p.pts < e.pts GROUP BY ALL)"
)


@query(f"WITH {_PACKETS} SELECT stream, split, start, stop AS \"end\", num_invalid FROM s")
def keyframe_splits(spark, d):
    """Where a decoder can start, up to where it must read, and how many of its frames belong to the split before."""
    return packets.keyframe_splits(_packets(spark, d)).select("stream", "split", "start", "end", "num_invalid")


@query(
    f"WITH {_PACKETS}, f AS (SELECT stream, i FROM p WHERE i % 7 = 3), h AS (SELECT f.stream, f.i, min(s.split) AS split FROM f JOIN s ON s.stream = f.stream AND f.i >= s.start AND f.i < s.stop GROUP BY 1, 2) "
    "SELECT h.stream, h.split, s.start, s.stop AS \"end\", string_agg((h.i - s.start - s.num_invalid)::VARCHAR, ',' ORDER BY h.i) AS frames FROM h JOIN s ON s.stream = h.stream AND s.split = h.split GROUP BY ALL"
)
def frames_wanted(spark, d):
    """Every seventh frame: the splits to decode, and the frames' places in them."""
    p = cut(_packets(spark, d), "packets")
    return packets.frames_wanted(p, p.where("index % 7 = 3").select("stream", "index")).select("stream", "split", "start", "end", joined("frames").alias("frames"))


@query("SELECT user_id, count(*) AS n, sum(event_id)::BIGINT AS pts, sum(length(event_type))::BIGINT AS bytes, CASE WHEN user_id % 3 > 0 THEN 'codec' || user_id % 5 END AS codec, true AS same FROM events GROUP BY 1, 5")
def packet_records(spark, d):
    """A user's events as packets, written as records and read back; every second record is checked to fail when it is damaged."""
    one = F.struct(F.col("event_id").alias("pts"), F.lit(None).cast("long").alias("dts"), F.lit(1).cast("long").alias("duration"), F.lit(0).alias("flags"), F.col("event_type").cast("binary").alias("data"))
    rational = lambda num, den: F.struct(F.lit(num).alias("num"), F.lit(den).alias("den"))
    rows = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(one)).alias("packets"))
    codec = F.when(F.col("user_id") % 3 > 0, F.struct(F.concat(F.lit("codec"), F.col("user_id") % 5).alias("name"), rational(25, 1).alias("frame_rate"), F.lit(b"\x01").alias("extra")))
    window = F.when(F.col("user_id") % 2 == 0, F.struct(rational(0, 1).alias("start"), rational(3, 2).alias("end")))
    value = F.struct(
        F.lit("video").alias("media"), F.col("user_id").cast("string").alias("src"), F.lit(0).alias("stream_index"), rational(1, 1000).alias("time_base"), window.alias("window"), codec.alias("codec"), "packets",
    )
    records = rows.select("user_id", value.cast(packets.PACKETS).alias("p")).withColumn("record", packets.serialised(F.col("p")))
    damaged = F.concat(F.substring("record", 1, 20), F.lit(b"!"), F.expr("substring(record, 22)"))
    back = records.select("user_id", "p", packets.deserialised(F.col("record")).alias("r"), packets.deserialised(F.when(F.substring("record", 21, 1) != F.lit(b"!"), damaged).otherwise(F.lit(b""))).alias("bad"))
    got = F.col("r.packets")
    total = lambda f: F.aggregate(got["packets"], F.lit(0).cast("long"), lambda a, x: a + f(x))
    same = got.eqNullSafe(F.col("p")) & F.col("bad.packets").isNull() & F.col("bad.error").isNotNull()
    return back.select("user_id", F.size(got["packets"]).cast("long").alias("n"), total(lambda x: x["pts"]).alias("pts"), total(lambda x: F.octet_length(x["data"])).alias("bytes"), got["codec"]["name"].alias("codec"), same.alias("same"))


# -- ranged reads ----------------------------------------------------------------------------------------------


def _files(df: DataFrame, label: str) -> DataFrame:
    """(path) of files written from df (name, content) to a new folder that all executors share."""
    def write(r):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        path = f"{root}/{r['name']}"
        with system.open_output_stream(path, compression=None) as f:
            f.write(r["content"])
        return f"{folder}/{r['name']}"

    folder = new_path(df.sparkSession, label)
    folder = folder if "://" in folder else folder.replace("file:", "file://", 1) if folder.startswith("file:") else f"file://{folder}"
    return cut(functions.mapped(df.select("name", "content"), write, "path string").select("path"), label)


def _number(path: str) -> F.Column:
    return F.regexp_extract(path, r"(\d+)\.\w+$", 1).cast("long")


AUDIO = 16 << 20  # bytes of audio that a task is to make, about


def _audio(spark, d) -> DataFrame:
    """(user_id, content): a user's events as WAV files. They are far larger than the events, so they are dealt to tasks by their own size: a task's
    batches pass through several Python workers at once."""
    def audio(r):
        values = np.array([(7 * v + np.arange(300)) % 1000 for v in r["values"]], np.int16)
        return media.encode_wav(values.reshape(-1, 1), 8000)

    values = F.transform(F.array_sort(F.collect_list(F.struct("event_id", F.floor("value").alias("v")))), lambda x: x["v"])
    events = table(spark, d, "events").select("user_id", "event_id", "value")
    tasks = -(-max(events.count(), 1) * 2 * 300 // AUDIO)
    return functions.mapped(events.repartition(tasks, "user_id").groupBy("user_id").agg(values.alias("values")), audio, "content binary")


@query(
    "WITH p AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events), r AS (SELECT user_id, i * 300 + k AS i, (floor(value)::BIGINT * 7 + k) % 1000 AS v FROM p, range(300) t(k)) "
    "SELECT user_id, i // 1024 AS chunk, i // 1024 * 1024 AS start, count(*) AS n, sum(v)::BIGINT AS total FROM r GROUP BY 1, 2"
)
def wav_chunks(spark, d):
    """A user's events as audio, written as WAV files and read in chunks of a packet."""
    users = _audio(spark, d)
    chunks = ranges.wav_chunks(_files(users.select(F.concat("user_id", F.lit(".wav")).alias("name"), "content"), "wav"), num_packets=1)
    sums = functions.mapped(chunks.where("error is null"), lambda t: {"n": t["shape"][0], "total": int(formats.from_tensor(t).sum(dtype=np.int64))}, "n long, total long", item="tensor")
    return sums.select(_number("path").alias("user_id"), "chunk", "start", "n", "total")


@query(
    "WITH p AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events), r AS (SELECT user_id, i * 300 + k AS i, (floor(value)::BIGINT * 7 + k) % 1000 AS v FROM p, range(300) t(k)) "
    "SELECT user_id, i // 3072 AS chunk, (max(i) // 1024 - min(i) // 1024 + 1)::BIGINT AS packets, count(*) AS n, sum(v)::BIGINT AS total FROM r GROUP BY 1, 2"
)
def streamed_packets(spark, d):
    """The same audio demuxed in chunks of three packets, which pass through records, and decoded."""
    audio = _audio(spark, d).select(F.col("user_id").cast("string").alias("path"), "content")
    chunks = codecs.streaming_demuxed(audio, "audio", num_packets=3).where("error is null")
    stored = chunks.select(F.concat_ws("#", "path", "chunk").alias("path"), packets.serialised(F.col("packets")).alias("record"))
    back = stored.select("path", packets.deserialised(F.col("record"), "audio")["packets"].alias("packets"))
    sums = functions.mapped(
        codecs.decoded_packets(back, "audio"), lambda t: {"n": t["shape"][0], "total": int(formats.from_tensor(t).sum(dtype=np.int64))}, "n long, total long", item="tensor"
    )
    key = F.split("path", "#")
    return sums.select(key[0].cast("long").alias("user_id"), key[1].cast("long").alias("chunk"), F.ceil(F.col("n") / 1024).alias("packets"), "n", "total")


def _archives(spark, d, dump, suffix: str) -> DataFrame:
    """Pages in archives of up to 20."""
    pages = table(spark, d, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    groups = pages.groupBy(F.floor(F.col("page_id") / 20).alias("g")).agg(F.array_sort(F.collect_list(F.struct("page_id", "html"))).alias("pages"))
    made = functions.mapped(groups, lambda r: dump([(f"{p['page_id']}.html", p["html"].encode()) for p in r["pages"]]), "content binary")
    return _files(made.select(F.concat("g", F.lit(suffix)).alias("name"), "content"), "archives")


def _members(index: DataFrame) -> DataFrame:
    """Whole members from parts of at most 4,096 bytes, read by ranges of 64 KiB."""
    parts = ranges.archive_members(index, range_bytes=1 << 16, part_bytes=4096)
    member = parts.groupBy("path", "member").agg(F.array_sort(F.collect_list(F.struct("part", "content"))).alias("parts"), F.count("error").alias("errors"))
    content = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["content"]))
    return member.where("errors = 0").select("member", F.size("parts").cast("long").alias("parts"), F.octet_length(content).cast("long").alias("bytes"), F.md5(content).alias("digest"))


_MEMBERS = (
    "SELECT page_id::VARCHAR || '.html' AS member, greatest(1, (strlen(coalesce(html, '')) + 4095) // 4096)::BIGINT AS parts, strlen(coalesce(html, ''))::BIGINT AS bytes, md5(coalesce(html, '')) AS digest FROM pages"
)


@query(_MEMBERS)
def zip_members(spark, d):
    def dump(pages):
        f = io.BytesIO()
        with zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in pages:
                z.writestr(name, data)
        return f.getvalue()

    return _members(ranges.archive_index(_archives(spark, d, dump, ".zip"), "zip"))


@query(_MEMBERS)
def tar_members(spark, d):
    def dump(pages):
        import tarfile

        f = io.BytesIO()
        with tarfile.open(fileobj=f, mode="w") as t:
            for name, data in pages:
                info = tarfile.TarInfo(name)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
        return f.getvalue()

    return _members(ranges.archive_index(_archives(spark, d, dump, ".tar"), "tar"))


@query("SELECT vec_id, k AS \"key\", len(embedding)::BIGINT AS n, round(list_sum(embedding::DOUBLE[]) * CASE k WHEN 'twice' THEN 2 ELSE 1 END, 5) AS total FROM embeddings, (VALUES ('once'), ('twice')) t(k)")
def npz_table(spark, d):
    """Vectors as NPZ bytes of two members, and the members read back by name."""
    def dump(v):
        f, a = io.BytesIO(), np.array(v, np.float64)
        np.savez_compressed(f, once=a, twice=2 * a)
        return f.getvalue()

    made = functions.mapped(table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")), dump, "content binary", item="v")
    tensors = formats.npz_table(made.select(F.col("vec_id").cast("string").alias("path"), "content"))
    sums = functions.mapped(tensors, lambda t: {"n": len(a := formats.from_tensor(t)), "total": float(a.sum())}, "n long, total double", item="tensor")
    return sums.select(F.col("path").cast("long").alias("vec_id"), "key", "n", F.round("total", 5).alias("total"))


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderkey % 5 <> 0")
def jsonl_scan(spark, d):
    """Orders as JSON lines, some of them blank, read by blocks."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    folder = new_path(spark, "jsonl")
    orders.select(F.when(F.col("o_orderkey") % 5 != 0, F.to_json(F.struct(*orders.columns))).otherwise("  ").alias("value")).write.text(folder)
    return files.json_lines(spark, [folder], "o_orderkey long, o_custkey long, o_orderpriority string").drop("path", "line")


@query("SELECT event_id, CASE WHEN user_id % 4 > 0 THEN event_type END AS event_type, value, user_id FROM events")
def tsv_log(spark, d):
    """A log of tab-separated values, appended to in two parts."""
    e = table(spark, d, "events").select("event_id", F.when(F.col("user_id") % 4 > 0, F.col("event_type")).alias("event_type"), "value", "user_id")
    folder = new_path(spark, "log")
    for part in (0, 1):
        stats.append_log(e.where(F.col("event_id") % 2 == part), folder)
    return stats.read_log(spark, folder, "event_id bigint, event_type string, value double, user_id bigint")


# -- draws and sources -----------------------------------------------------------------------------------------

_UNIFORM = "((('0x' || md5({text})[1:13])::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)"


@query(
    "WITH w AS (SELECT o_orderkey, (o_orderkey % 7)::DOUBLE AS w FROM orders), e AS (SELECT o_orderkey, -ln(" + _UNIFORM.format(text="'21:' || o_orderkey") + ") / w AS e FROM w WHERE w > 0), "
    "r AS (SELECT o_orderkey, row_number() OVER (ORDER BY e, o_orderkey) - 1 AS draw_no FROM e) SELECT draw_no, o_orderkey FROM r WHERE draw_no < 4998 AND draw_no % 3 = 1"
)
def weighted_shard(spark, d):
    """A rank's share of 5,000 different orders drawn by weight."""
    orders = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 7).alias("w"))
    return weighted.without_replacement(orders, ["o_orderkey"], "w", 5000, rank=1, world_size=3, seed=21).select("draw_no", "o_orderkey")


@query(
    "WITH w AS (SELECT p_partkey, CASE WHEN p_partkey = 77 THEN 1000 ELSE p_partkey % 5 END AS w FROM part), u AS (SELECT p_partkey, round(w / (SELECT max(w) FROM w) * 1099511627776)::HUGEINT AS u FROM w), "
    "l AS (SELECT p_partkey, u, (sum(u) OVER (ORDER BY p_partkey))::HUGEINT AS hi FROM u), t AS (SELECT max(hi)::HUGEINT AS total, max(hi)::DOUBLE AS length FROM l), "
    "x AS (SELECT i AS draw_no, floor(" + _UNIFORM.format(text="'22:' || i") + " * length)::HUGEINT AS x FROM range(30000) r(i), t), "
    "o AS (SELECT p_partkey, hi - u AS lo FROM l WHERE u > 0) SELECT draw_no, p_partkey FROM x ASOF JOIN o ON x.x >= o.lo"
)
def weighted_draws(spark, d):
    """30,000 independent draws by weight, one part having a large share of it."""
    parts = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") == 77, 1000).otherwise(F.col("p_partkey") % 5).alias("w"))
    return weighted.with_replacement(parts, ["p_partkey"], "w", 30000, seed=22).select("draw_no", "p_partkey")


def _readings(part: int):
    for k in range(part % 4):
        if part % 997 == 995 and k == 2:
            raise ValueError("unreadable")
        yield {"v": part * 10 + k}


_READINGS = "r AS (SELECT o_orderkey AS part, k AS item_no, o_orderkey * 10 + k AS v, o_orderkey % 997 = 995 AND k >= 2 AS bad FROM orders, range(3) t(k) WHERE k < o_orderkey % 4)"


@query(f"WITH {_READINGS} SELECT part, item_no, v FROM r WHERE part * 10 + item_no < (SELECT coalesce(min(part * 10 + item_no), 9223372036854775807) FROM r WHERE bad)")
def source_failure(spark, d):
    """A source of iterables of which one fails: the items before it, in order."""
    source = iterables.iterated(spark, table(spark, d, "orders").select("o_orderkey"), _readings, "v long")
    return iterables.delivered(source, on_fault="truncate")


@query(f"WITH {_READINGS} SELECT part, item_no, v FROM r WHERE NOT bad")
def source_failure_skipped(spark, d):
    source = iterables.iterated(spark, table(spark, d, "orders").select("o_orderkey"), _readings, "v long")
    return iterables.delivered(source, on_fault="skip")


# -- statistics ------------------------------------------------------------------------------------------------

WIDTH = 21_600.0
_EVENTS = "event[s].parquet"  # a stream's path is a folder or, as here, a pattern


def _calls(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        F.col("event_type").alias("name"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), (F.col("value") / 1000).alias("_seconds"), F.when(F.col("user_id") % 17 == 0, "bad").alias("_error"),
    )


_GAMMA = "(1.01::DOUBLE / 0.99::DOUBLE)"
_CALLS = (
    "c AS (SELECT event_type AS name, floor(epoch(ts) / 21600)::BIGINT AS bucket, value / 1000 AS s, user_id % 17 = 0 AS bad FROM events), "
    f"k AS (SELECT name, bucket, s, bad, CASE WHEN NOT bad THEN ceil(ln(greatest(s, 1e-9)) / ln({_GAMMA}))::BIGINT END AS step FROM c)"
)
_FIGURES = (
    "n AS (SELECT name, bucket, count(*) AS num_tasks, count(*) FILTER (bad) AS num_failures, coalesce(avg(s) FILTER (NOT bad), 0) AS ave FROM {k} GROUP BY name, bucket), "
    "q AS (SELECT name, bucket, step, sum(count(*)) OVER (PARTITION BY name, bucket ORDER BY step) AS below, sum(count(*)) OVER (PARTITION BY name, bucket) AS n FROM {k} WHERE NOT bad GROUP BY name, bucket, step), "
    f"p AS (SELECT name, bucket, pow({_GAMMA}, min(step) FILTER (below * 100 >= n * 90)) * 2 / (1 + {_GAMMA}) AS p90, pow({_GAMMA}, min(step) FILTER (below * 100 >= n * 99)) * 2 / (1 + {_GAMMA}) AS p99 FROM q GROUP BY name, bucket)"
)
_ROWS = "n.name, (n.bucket + 1) * 21600.0::DOUBLE AS timestamp, num_tasks, num_failures, round(ave, 9) AS ave_time, round(coalesce(p90, 0), 9) AS p90_time, round(coalesce(p99, 0), 9) AS p99_time"


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in names})


@query(f"WITH {_CALLS}, {_FIGURES.format(k='k')} SELECT {_ROWS} FROM n LEFT JOIN p USING (name, bucket)")
def stats_intervals(spark, d):
    """Task statistics by interval of six hours, from mergeable sketches of durations."""
    return _rounded(stats.interval_rows(stats.sketched(_calls(spark, d), "name", "at", WIDTH), WIDTH), "ave_time", "p90_time", "p99_time")


@query(
    f"WITH {_CALLS}, g AS (SELECT DISTINCT name, bucket FROM k), kk AS (SELECT g.name, g.bucket, k.s, k.bad, k.step FROM g JOIN k ON k.name = g.name AND k.bucket <= g.bucket), {_FIGURES.format(k='kk')}, "
    f"r AS (SELECT {_ROWS}, num_tasks - num_failures AS good, ave FROM n LEFT JOIN p USING (name, bucket)), l AS (SELECT *, good - lag(good, 1, 0) OVER w AS lap_n, ave * good - lag(ave * good, 1, 0) OVER w AS lap_t FROM r WINDOW w AS (PARTITION BY name ORDER BY timestamp)) "
    "SELECT name, timestamp, num_tasks, num_failures, ave_time, p90_time, p99_time, lap_n, round(CASE WHEN lap_n > 0 THEN lap_t / lap_n ELSE 0 END, 10) AS lap_mean FROM l"
)
def stats_running(spark, d):
    """The same up to the end of each interval, and what came in between from the differences."""
    running = stats.running_rows(stats.sketched(_calls(spark, d), "name", "at", WIDTH), WIDTH)
    return _rounded(stats.lap_rows(running), "ave_time", "p90_time", "p99_time").withColumn("lap_mean", F.round("lap_mean", 10))


@query(
    "SELECT event_type AS name, count(*) AS n, round(avg(value), 6) AS mean, round(avg(value) - 1.962 * stddev_samp(value) / sqrt(count(*)), 6) AS low, "
    "round(avg(value) + 1.962 * stddev_samp(value) / sqrt(count(*)), 6) AS high FROM events GROUP BY 1"
)
def mean_interval_t(spark, d):
    """Student's interval, here of more than a thousand runs each."""
    out = stats.t_interval(table(spark, d, "events").withColumn("name", F.col("event_type")), "name", "value")
    return out.select("name", "n", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


@query(
    "SELECT CASE user_id % 3 WHEN 0 THEN 'task_stats' WHEN 1 THEN 'queue_stats' ELSE 'event_stats' END AS \"table\", event_type AS name, count(*) AS n, "
    "coalesce(sum(CASE user_id % 3 WHEN 0 THEN event_id WHEN 1 THEN event_id END), 0)::BIGINT AS items FROM events GROUP BY 1, 2"
)
def stats_sink(spark, d):
    """A stream of entries of three kinds, committed batch by batch to three tables, and these read back."""
    root = new_path(spark, "stats")
    numbers = dict(num_tasks="event_id", num_items="event_id")
    kind = F.when(F.col("user_id") % 3 == 0, "task").when(F.col("user_id") % 3 == 1, "queue").otherwise("event")
    fields = [c.split() for c in stats.ENTRIES.split(", ")]
    own = {"kind": kind, "timestamp": F.unix_seconds(F.col("ts").cast("timestamp")), "name": F.col("event_type"), **{k: F.col(v) for k, v in numbers.items()}}
    events = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/{_EVENTS}")
    entries = events.select(*[own.get(name, F.lit(None)).cast(kind_).alias(name) for name, kind_ in fields])
    stats.sink(entries, root, f"{root}-checkpoint", stats.entry_tables()).awaitTermination()
    own_schema = lambda s: ", ".join(c for c in s.split(", ") if not c.startswith("id "))
    parts = []
    for name, schema, label, items in (("task_stats", stats.TASK_STATS, "name", "num_tasks"), ("queue_stats", stats.QUEUE_STATS, "name", "num_items"), ("event_stats", stats.EVENT_STATS, "event_name", None)):
        rows = stats.committed(spark, root, name, own_schema(schema))
        total = F.coalesce(F.sum(items), F.lit(0)) if items else F.lit(0)
        parts.append(rows.groupBy(F.col(label).alias("name")).agg(F.count(F.lit(1)).alias("n"), total.cast("long").alias("items")).withColumn("table", F.lit(name)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("table", "name", "n", "items")


# -- streams ---------------------------------------------------------------------------------------------------


def _kept(stream: DataFrame, label: str) -> DataFrame:
    """What a stream of epochs gives, in a table by epoch; an epoch that comes again replaces its rows."""
    spark = stream.sparkSession
    root = new_path(spark, label)
    replay.run_epochs(stream, lambda df, e: df.write.mode("overwrite").parquet(f"{root}/batch={e}"), f"{root}-checkpoint")
    return spark.read.schema(stream.schema).parquet(root)


@query("SELECT e AS epoch, event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events, range(3) r(e) GROUP BY 1, 2")
def replayed_epochs(spark, d):
    """A table gone through three times, one epoch to a micro-batch."""
    stream = replay.replayed(spark, f"{d}/events.parquet", "event_id long, event_type string", epochs=3)
    return _kept(stream, "replayed").groupBy("epoch", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query(
    "SELECT event_id % 3 AS epoch, (user_id % 2)::INTEGER AS source, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events WHERE event_id % 3 < 2 GROUP BY 1, 2"
)
def aligned_epochs(spark, d):
    """Two sources, of which the second has ended two epochs and the first three: the third one waits."""
    e, roots = table(spark, d, "events").select("event_id", "user_id"), [new_path(spark, f"source-{s}") for s in (0, 1)]
    for s, root in enumerate(roots):
        for epoch in range(3 - s):
            e.where((F.col("user_id") % 2 == s) & (F.col("event_id") % 3 == epoch)).write.parquet(f"{root}/epoch={epoch}")
    rows = _kept(replay.aligned(spark, roots, "event_id long, user_id long"), "aligned")
    return rows.groupBy("epoch", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


class _Triples:
    """Gathers three of a user's events at a time."""

    def __init__(self):
        self.ids = []

    def accumulate(self, row):
        self.ids.append(int(row["event_id"]))
        return self.flush() if len(self.ids) == 3 else None

    def flush(self):
        out = {"n": len(self.ids), "ids": ",".join(map(str, self.ids))} if self.ids else None
        self.ids = []
        return out


@query(
    "WITH p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events) "
    "SELECT user_id, count(*) AS n, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids FROM p GROUP BY user_id, i // 3"
)
def fold_keyed_stream(spark, d):
    """A fold of one's own over a keyed stream, flushed at the end of its epoch."""
    events = spark.readStream.schema("event_id long, user_id long").parquet(f"{d}/{_EVENTS}")
    folded = state.folded(events, "user_id", _Triples, "n long, ids string", order="event_id", flush_at_epoch=True)
    root = new_path(spark, "folded")
    folded.writeStream.format("parquet").option("path", root).option("checkpointLocation", f"{root}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(folded.schema).parquet(root)


@query(
    "WITH e AS (SELECT user_id, epoch(ts) AS t, lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events), "
    "s AS (SELECT user_id, t, sum(CASE WHEN before IS NULL OR t - before >= 7200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t) AS k FROM e) "
    "SELECT user_id, floor(min(t))::BIGINT AS began, count(*) AS n FROM s GROUP BY user_id, k"
)
def session_windows(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return epochs.session_counts(e, "ts", "user_id", gap="2 hours").select("user_id", F.unix_seconds("session_window.start").alias("began"), "n")


# -- experiments -----------------------------------------------------------------------------------------------


@query("SELECT p_partkey AS id, (p_partkey - 1) // 500 * 500 + 1 AS root, (p_partkey - 1) % 500 AS depth FROM part WHERE p_partkey > 0 AND (p_partkey - 1) % 500 < 249")
def deep_tree_levels(spark, d):
    """Paths of 500 nodes, each with a cycle in its middle: what hangs on that is left out."""
    k = F.col("p_partkey")
    parent = F.when(k % 500 == 250, k + 10).when(k % 500 != 1, k - 1)
    return experiments.levels(table(spark, d, "part").where("p_partkey > 0").select(k.alias("id"), parent.alias("parent_id"))).where((F.col("id") - 1) % 500 < 249)


@query(
    "SELECT p_partkey AS child, p_partkey - 1 AS parent FROM part WHERE p_partkey > 0 AND p_partkey <= (SELECT arg_min(p_partkey, 5000 - p_retailprice) FROM part WHERE p_partkey % 7 = 3)"
)
def deep_best_path(spark, d):
    """One path of all nodes, deeper than recursive queries go."""
    part = table(spark, d, "part")
    cost = F.when(F.col("p_partkey") % 7 == 3, 5000 - F.col("p_retailprice"))
    return experiments.best_path(part.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") - 1).alias("parent_id"), cost.alias("duration")))


@query(
    "WITH s AS (SELECT o_orderkey AS node, list_sort(list_distinct([o_custkey % 5, o_orderkey % 4])) AS spec FROM orders WHERE o_orderstatus <> 'F'), f AS (SELECT min(node) AS first, spec FROM s GROUP BY spec) "
    "SELECT node, first FROM s JOIN f USING (spec) WHERE node <> first"
)
def repeated_proposals(spark, d):
    """Proposals made before by one that didn't fail."""
    o = table(spark, d, "orders").withColumn("changes", F.array(F.col("o_custkey") % 5, F.col("o_orderkey") % 4))
    return experiments.repeated_proposals(o, "o_orderkey", "changes", F.col("o_orderstatus") == "F")


@query(
    "WITH n AS (SELECT event_id AS id, CASE WHEN event_id % 10 > 0 THEN event_id // 10 END AS parent, value AS duration, event_type = 'error' AS failed FROM events WHERE user_id % 3 > 0), "
    "b AS (SELECT *, max(CASE WHEN NOT failed THEN -duration END) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM n) "
    "SELECT id::VARCHAR AS node_id, parent::VARCHAR AS parent_id, duration, CASE WHEN failed THEN 'error' END AS kind, NOT failed AND (best IS NULL OR -duration > best) AS improved FROM b"
)
def experiment_log(spark, d):
    """Nodes logged as JSON lines, each as it is queued and again as it ends, read back, with those that were the best so far."""
    e = table(spark, d, "events").where("user_id % 3 > 0")
    text = lambda c: c.cast("string")
    first = e.select(text(F.col("event_id")).alias("node_id"), F.lit("queued").alias("status"))
    error = F.when(F.col("event_type") == "error", F.struct(F.col("event_type").alias("kind"), F.lit(False).alias("retryable")))
    parent = F.when(F.col("event_id") % 10 > 0, text(F.floor(F.col("event_id") / 10)))
    last = e.select(text(F.col("event_id")).alias("node_id"), parent.alias("parent_id"), F.lit("done").alias("status"), F.col("value").alias("duration"), error.alias("failure"))
    root = new_path(spark, "nodes")
    for k, rows in enumerate((first, last)):
        rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.text(f"{root}/{k}")
    nodes = experiments.read_nodes(spark, [f"{root}/0", f"{root}/1"]).withColumn("_id", F.col("node_id").cast("long"))
    return experiments.new_best(nodes, "_id", -F.col("duration")).select("node_id", "parent_id", "duration", F.col("failure.kind").alias("kind"), "improved")


# -- loaders and descriptions ----------------------------------------------------------------------------------


@query(
    "WITH p AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents), s AS (SELECT doc_id, pos // 2 AS k, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')[1:8] AS w FROM p WHERE pos % 2 = 1 AND pos < n // 2 * 2), "
    "t AS (SELECT k // 16 AS batch_id, k, list_transform(range(8), lambda i: CASE WHEN i < len(w) THEN length(w[i + 1]) ELSE -100 END) AS labels FROM s) "
    "SELECT batch_id, count(*) AS n, string_agg(list_aggregate(labels, 'string_agg', ' '), ',' ORDER BY k) AS labels FROM t GROUP BY 1 HAVING count(*) = 16"
)
def llm_loader(spark, d):
    """Shard, tokenise and pad, label with padding ignored, batch, collate: a loader from its parts."""
    docs = sample.deterministic_shard(table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), ["doc_id"], rank=1, world_size=2).drop("pos")
    padded = core.pipe(docs, {"tokens": arrays.tokens(F.col("text"), 8)}, ["doc_id"])
    ids, mask = F.transform("tokens", lambda t: F.length(t)), F.transform("tokens", lambda t: (t != "<pad>").cast("int"))
    labelled = core.pipe(padded, {"labels": F.array_join(F.transform(arrays.labels(ids, mask), lambda x: x.cast("string")), " ")}, ["doc_id"])
    out = batch.batches(labelled, 16, ["doc_id"], F.col("labels"), drop_last=True)
    return out.select("batch_id", "n", F.array_join("items", ",").alias("labels"))


@query(
    "SELECT event_id, event_id * 3 < 1000 * 7 AS inside, CASE user_id % 3 WHEN 0 THEN 'aresample=' || 8000 + user_id WHEN 1 THEN 'format=pix_fmts=rgb24' END AS filter FROM events"
)
def described_packets(spark, d):
    """Is a packet's time, a rational, before 7/3 s, and the filter by its kind of media."""
    (_, _), (num, den) = filters.rational_window("0", "7/3")
    kind = F.when(F.col("user_id") % 3 == 0, "audio").when(F.col("user_id") % 3 == 1, "video").otherwise("subtitle")
    inside = filters.before((F.col("event_id"), F.lit(1000)), (F.lit(num), F.lit(den)))
    described = filters.filter_for(kind, filters.audio_filter(sample_rate=F.col("user_id") + 8000), filters.video_filter(pix_fmt=F.lit("rgb24")))
    return table(spark, d, "events").select("event_id", inside.alias("inside"), described.alias("filter"))


def _channel(u: str, v: str) -> str:
    """A pixel's channel in 32 bits, cut off."""
    return f"greatest(0, least(255, trunc(1.1644::REAL * (y - 16)::REAL + {u}::REAL * u::REAL + {v}::REAL * v::REAL)))::INTEGER"


@query(
    "WITH p AS (SELECT event_id, (event_id * 37 % 256)::INTEGER AS y, (user_id * 11 % 256)::INTEGER - 128 AS u, (event_id * 5 % 256)::INTEGER - 128 AS v FROM events) "
    f"SELECT event_id, {_channel('0', '1.6325')} AS r, {_channel('(-0.4007)', '(-0.8315)')} AS g, {_channel('2.0633', '0')} AS b FROM p"
)
def nv12_pixels(spark, d):
    """Each event as a frame of four equal pixels in NV12, converted by the sixth matrix."""
    def rgb(r):
        frame = np.array([[r["y"]] * 2, [r["y"]] * 2, [r["u"], r["v"]]], np.uint8)
        return dict(zip("rgb", arrays.nv12_to_rgb(frame, 6)[0, :, 0, 1].tolist(), strict=True))

    e = table(spark, d, "events").select("event_id", (F.col("event_id") * 37 % 256).alias("y"), (F.col("user_id") * 11 % 256).alias("u"), (F.col("event_id") * 5 % 256).alias("v"))
    return functions.mapped(e, rgb, "r int, g int, b int").select("event_id", "r", "g", "b")

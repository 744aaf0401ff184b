"""Queries over the driver's tables, one for each operator, and the SQL that must give the same rows."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Callable
from fractions import Fraction
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace import experiments, stats
from millrace.functions import arrays, filters
from millrace.operators import batch, core, failure, functions, merge, route, sample
from millrace.operators.position import with_pos
from millrace.plans import compile as plans, loaders, spec
from millrace.session import table
from millrace.sources import formats, media

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]  # a total order of lineitem
EVENT = ["event_id"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def joined(items: str = "items") -> F.Column:
    return F.array_join(F.transform(items, lambda x: x.cast("string")), ",")


def _day(df: DataFrame) -> DataFrame:
    return df.withColumn("epoch", F.dayofyear("ts").cast("long"))


# -- sources, maps, filters, lookups -----------------------------------------------------------------------


@query("SELECT * FROM orders")
def source_scan(spark, d):
    return table(spark, d, "orders")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem")
def pipe_map(spark, d):
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return core.pipe(table(spark, d, "lineitem"), {"revenue": revenue}, ["l_orderkey", "l_linenumber"])


@query("SELECT event_id, value * 2 AS doubled FROM events WHERE event_type = 'purchase'")
def pipe_filter_none(spark, d):
    return core.pipe(table(spark, d, "events"), {"doubled": F.when(F.col("event_type") == "purchase", F.col("value") * 2)}, EVENT)


@query("SELECT doc_id, length(trim(text))::INTEGER AS n, length(trim(text)) * 2 + 1 AS odd FROM documents WHERE lang = 'en'")
def pipe_map_chain(spark, d):
    first = core.pipe(table(spark, d, "documents"), {"t": F.when(F.col("lang") == "en", F.trim("text"))}, ["doc_id"])
    second = core.pipe(first, {"n": F.length("t")}, ["doc_id"])
    return core.pipe(second, {"odd": (F.col("n") * 2 + 1).cast("long")})


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS pos, value + 1 AS v FROM events")
def pipe_ordered(spark, d):
    return core.pipe(with_pos(table(spark, d, "events"), EVENT), {"v": F.col("value") + 1}, ["event_id", "pos"])


@query("SELECT w AS item, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) WHERE w <> '' GROUP BY w")
def pipe_generator(spark, d):
    words = F.filter(F.split("text", " "), lambda w: w != "")
    return core.flat_map(table(spark, d, "documents").select("text"), words).groupBy("item").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT event_id, item FROM (SELECT event_id, unnest([value, CASE WHEN event_type = 'view' THEN user_id::DOUBLE END]) AS item FROM events) "
    "WHERE item IS NOT NULL"
)
def pipe_generator_skip_none(spark, d):
    items = F.array("value", F.when(F.col("event_type") == "view", F.col("user_id").cast("double")))
    return core.flat_map(table(spark, d, "events"), items).select("event_id", "item")


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 0")
def pipe_lookup_dict(spark, d):
    entries = table(spark, d, "nation").where("n_regionkey <> 0")
    return core.lookup(table(spark, d, "supplier"), "s_nationkey", entries, "n_nationkey", "n_name").select("s_suppkey", "n_name")


@query(
    "SELECT n_nationkey, ['a', 'b', 'c'][CASE WHEN i < 0 THEN i + 4 ELSE i + 1 END] AS value "
    "FROM (SELECT n_nationkey, n_nationkey % 7 - 3 AS i FROM nation) WHERE i < 3"
)
def pipe_lookup_list(spark, d):
    df = table(spark, d, "nation").withColumn("i", F.col("n_nationkey") % 7 - 3)
    return core.lookup_list(df, F.col("i"), ["a", "b", "c"]).select("n_nationkey", "value")


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 0)")
def lookup_missing(spark, d):
    return core.missing_keys(table(spark, d, "supplier"), "s_nationkey", table(spark, d, "nation").where("n_regionkey <> 0"), "n_nationkey").select("s_suppkey")


@query("SELECT event_id, regexp_extract(props, '\"k\": ?(-?[0-9]+)', 1)::BIGINT AS k FROM events")
def json_field(spark, d):
    return core.pipe(table(spark, d, "events"), {"k": F.get_json_object("props", "$.k").cast("long")}, EVENT)


@query("SELECT * FROM events ORDER BY event_id LIMIT 100")
def source_max_items(spark, d):
    return core.first_items(table(spark, d, "events"), 100, "event_id")


# -- batches and folds -------------------------------------------------------------------------------------


@query(
    "SELECT pos // 64 AS batch_id, count(*) AS n, sum(chars)::BIGINT AS total_chars, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM "
    "(SELECT doc_id, length(trim(text)) AS chars, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents WHERE lang = 'en') GROUP BY 1"
)
def batch_documents(spark, d):
    p = spec.Builder().add_source(table(spark, d, "documents").select("doc_id", "text", "lang"), ["doc_id"])
    p = p.pipe({"chars": F.when(F.col("lang") == "en", F.length(F.trim("text")))})
    mapped = plans.compile_pipeline(p.build()).drop("text")
    out = batch.batches(mapped, 64, ["doc_id"], F.col("doc_id"), extra=[F.sum("chars").alias("total_chars")])
    return out.select("batch_id", "n", "total_chars", joined().alias("ids"))


@query(
    "SELECT pos // 100 AS batch_id, count(*) AS n, sum(l_quantity) AS quantity FROM "
    f"(SELECT *, row_number() OVER (ORDER BY {', '.join(LINE)}) - 1 AS pos FROM lineitem) GROUP BY 1"
)
def collate_batches(spark, d):
    ids = batch.batch_ids(table(spark, d, "lineitem").select(*LINE, "l_quantity"), 100, LINE)
    return ids.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


_EVENT_BATCHES = (
    "SELECT pos // {n} AS batch_id, count(*) AS n, string_agg(event_id::VARCHAR, ',' ORDER BY pos) AS ids FROM "
    "(SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events) GROUP BY 1 {having}"
)


@query(_EVENT_BATCHES.format(n=64, having=""))
def aggregate_n(spark, d):
    out = batch.batches(table(spark, d, "events").select("event_id"), 64, EVENT, F.col("event_id"))
    return out.select("batch_id", "n", joined().alias("ids"))


@query(_EVENT_BATCHES.format(n=96, having="HAVING count(*) = 96"))
def aggregate_drop_last(spark, d):
    out = batch.batches(table(spark, d, "events").select("event_id"), 96, EVENT, F.col("event_id"), drop_last=True)
    return out.select("batch_id", "n", joined().alias("ids"))


@query("SELECT event_id AS item FROM events WHERE event_id % 10 <> 3")
def disaggregate(spark, d):
    item = F.when(F.col("event_id") % 10 != 3, F.col("event_id"))
    return batch.unbatch(batch.batches(table(spark, d, "events"), 64, EVENT, item)).select("item")


@query(
    "SELECT pos % 4 AS worker, pos // 4 // 32 AS batch_id, count(*) AS n, string_agg(event_id::VARCHAR, ',' ORDER BY pos) AS ids FROM "
    "(SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events) GROUP BY 1, 2"
)
def region_batch(spark, d):
    p = spec.Builder().add_source(table(spark, d, "events").select("event_id"), EVENT).to(4).aggregate(32, "event_id").to(spec.MAIN).build()
    return plans.compile_pipeline(p).select("worker", "batch_id", "n", joined().alias("ids"))


_FOLD = """
WITH RECURSIVE rows AS MATERIALIZED (SELECT {group} AS g, {order} AS o, {size}::BIGINT AS s, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS rn,
    count(*) OVER (PARTITION BY {group}) AS total FROM {table}),
step AS (
  SELECT g, rn, total, o, 1::BIGINT AS n, s AS t, s >= {threshold} AS done FROM rows WHERE rn = 1
  UNION ALL
  SELECT r.g, r.rn, r.total, r.o, CASE WHEN p.done THEN 1 ELSE p.n + 1 END, CASE WHEN p.done THEN r.s ELSE p.t + r.s END,
    CASE WHEN p.done THEN r.s ELSE p.t + r.s END >= {threshold}
  FROM step p JOIN rows r ON r.g = p.g AND r.rn = p.rn + 1
)
SELECT {out} row_number() OVER (PARTITION BY g ORDER BY rn) - 1 AS fold_id, n, t AS total, o AS last FROM step WHERE done {flush}
"""


@query(_FOLD.format(group="0", order="doc_id", size="n_chars", table="documents", threshold=20000, out="", flush="OR rn = total"))
def fold_size_threshold(spark, d):
    return batch.fold_until(table(spark, d, "documents"), "doc_id", "n_chars", 20000)


_DAYS = {"group": "dayofyear(ts)", "order": "event_id", "size": "user_id + 1", "table": "events", "threshold": 2000, "out": "g AS epoch,"}


@query(_FOLD.format(**_DAYS, flush="OR rn = total"))
def fold_flush_per_epoch(spark, d):
    df = _day(table(spark, d, "events")).withColumn("size", F.col("user_id") + 1)
    return batch.fold_until(df, "event_id", "size", 2000, within=["epoch"])


@query(_FOLD.format(**_DAYS, flush=""))
def fold_drop_last(spark, d):
    df = _day(table(spark, d, "events")).withColumn("size", F.col("user_id") + 1)
    return batch.fold_until(df, "event_id", "size", 2000, within=["epoch"], drop_last=True)


@query(
    "SELECT epoch, pos // 50 AS batch_id, count(*) AS n, string_agg(event_id::VARCHAR, ',' ORDER BY pos) AS ids FROM "
    "(SELECT event_id, dayofyear(ts) AS epoch, row_number() OVER (PARTITION BY dayofyear(ts) ORDER BY event_id) - 1 AS pos FROM events) GROUP BY 1, 2"
)
def batch_per_epoch(spark, d):
    p = spec.Builder().add_source(_day(table(spark, d, "events")).select("event_id", "epoch"), EVENT, epoch="epoch").aggregate(50, "event_id").build()
    return plans.compile_pipeline(p).select("epoch", "batch_id", "n", joined().alias("ids"))


# -- merge and route ---------------------------------------------------------------------------------------


def _two(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    return [n, c], [["key"], ["key"]]


_TURNS = (
    "WITH u AS (SELECT n_nationkey::BIGINT AS key, n_name AS name, 0 AS src, row_number() OVER (ORDER BY n_nationkey) - 1 AS k FROM nation UNION ALL "
    "SELECT c_custkey, c_name, 1, row_number() OVER (ORDER BY c_custkey) - 1 FROM customer), "
    "p AS (SELECT *, row_number() OVER (ORDER BY k, src) - 1 AS pos FROM u {where}) SELECT key, name, pos FROM p {end}"
)


@query("SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def merge_bag(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return merge.bag([c, s])


@query(
    "SELECT key, name, row_number() OVER (ORDER BY src, key) - 1 AS pos FROM (SELECT n_nationkey::BIGINT AS key, n_name AS name, 0 AS src FROM nation "
    "UNION ALL SELECT c_custkey, c_name, 1 FROM customer)"
)
def merge_concat(spark, d):
    return merge.concat(*_two(spark, d)).select("key", "name", "pos")


@query(_TURNS.format(where="", end=""))
def merge_round_robin(spark, d):
    return merge.round_robin(*_two(spark, d)).select("key", "name", "pos")


@query(_TURNS.format(where="WHERE (k, src) < (SELECT min((len, src)) FROM (SELECT src, count(*) AS len FROM u GROUP BY src))", end=""))
def merge_round_robin_first_exhaustion(spark, d):
    return merge.round_robin(*_two(spark, d), stop_after=-1).select("key", "name", "pos")


@query(_TURNS.format(where="", end="WHERE pos < 77"))
def merge_round_robin_n(spark, d):
    return merge.round_robin(*_two(spark, d), stop_after=77).select("key", "name", "pos")


def _values(rows) -> str:
    return ", ".join(f"({', '.join(map(str, r))})" for r in rows)


def _weighted_rows(lengths=(25, 100), weights=(1.0, 3.0), seed=7) -> str:
    taken, rows = [0, 0], []
    for p in islice(merge.picks(weights, seed), 2000):
        if taken[p] < lengths[p]:
            rows.append((len(rows), p, taken[p]))
            taken[p] += 1
    return _values(rows)


@query(
    f"WITH p(pos, src, k) AS (VALUES {_weighted_rows()}), u AS (SELECT n_nationkey::BIGINT AS key, 0 AS src, row_number() OVER (ORDER BY n_nationkey) - 1 AS k FROM nation "
    "UNION ALL SELECT s_suppkey, 1, row_number() OVER (ORDER BY s_suppkey) - 1 FROM supplier) SELECT p.pos::BIGINT AS pos, u.src::INTEGER AS src, u.key FROM p JOIN u USING (src, k)"
)
def merge_weighted(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("key"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"))
    return merge.weighted([n, s], [["key"], ["key"]], [1.0, 3.0], seed=7).select("pos", "src", "key")


@query(
    "SELECT dayofyear(ts)::BIGINT AS epoch, CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END::INTEGER AS src, count(*) AS items FROM events GROUP BY 1, 2"
)
def merge_epoch_barrier(spark, d):
    e = _day(table(spark, d, "events"))
    return merge.by_epoch([e.where("event_type = 'purchase'"), e.where("event_type <> 'purchase'")], "epoch")


@query("SELECT event_id, CASE event_type WHEN 'view' THEN value * 2 WHEN 'click' THEN value + 100 ELSE value END AS result FROM events WHERE event_type <> 'error'")
def route_items(spark, d):
    way = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "error", 2).otherwise(3)
    paths = [lambda df: F.col("value") * 2, lambda df: F.col("value") + 100, lambda df: F.lit(None).cast("double"), lambda df: F.col("value")]
    return route.route_values(table(spark, d, "events"), way, paths, "result").select("event_id", "result")


@query(
    "WITH p AS (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events), "
    "r AS (SELECT *, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 0 ELSE 2 END AS way FROM p WHERE event_type <> 'error') "
    "SELECT pos // 16 AS batch_id, count(*) AS n, string_agg(event_id::VARCHAR, ',' ORDER BY way, pos) AS ids FROM r GROUP BY 1"
)
def route_batched(spark, d):
    kind = F.col("item.event_type")
    way = F.when(kind == "view", 1).when(kind == "click", 0).when(kind == "error", 3).otherwise(2)
    same, none = [spec.Pipe({"item": F.col("item.event_id")})], [spec.Pipe({"item": F.lit(None).cast("long")})]
    p = spec.Builder().add_source(table(spark, d, "events"), EVENT).pipe({"event": F.struct("event_id", "event_type")}).aggregate(16, "event")
    out = plans.compile_pipeline(p.path_variants(way, [same, same, same, none], batched=True).build())
    return out.select("batch_id", "n", joined().alias("ids"))


@query(
    "SELECT item, item * 10 AS result FROM (SELECT o_orderkey AS item FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT l_partkey FROM lineitem WHERE l_quantity > 45)"
)
def merge_unbatch_route(spark, d):
    """Two pipelines, one of which gives batches, merged, taken apart and routed by a static cache."""
    one = spec.Builder().add_source(table(spark, d, "orders").where("o_orderstatus = 'O'").select("o_orderkey"), ["o_orderkey"]).aggregate(50, "o_orderkey").build()
    two = (
        spec.Builder().add_source(table(spark, d, "lineitem").where("l_quantity > 45").select(*LINE), LINE)
        .pipe({"items": F.array("l_partkey")}).build()
    )
    both = merge.bag([plans.compile_pipeline(p).select("items") for p in (one, two)])
    items = batch.unbatch(both)
    hit = F.when(F.col("item") % 3 == 0, 0).otherwise(1)
    return route.route_values(items, hit, [lambda df: F.col("item") * 10, lambda df: F.col("item") * 10], "result").select("item", "result")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) - 1 AS pos FROM orders")
def priority_order(spark, d):
    return merge.by_priority(table(spark, d, "orders"), "o_orderpriority", "o_orderkey").select("o_orderkey", "pos")


# -- samplers, repeats, caches -----------------------------------------------------------------------------


@query(
    "WITH p AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS pos, count(*) OVER () AS n FROM events) "
    "SELECT event_id, pos FROM p WHERE pos % 7 = 2 AND pos < n // 7 * 7"
)
def sampler_det(spark, d):
    return sample.deterministic_shard(table(spark, d, "events"), EVENT, rank=2, world_size=7).select("event_id", "pos")


@query("SELECT event_id, pos FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events) WHERE pos % 7 = 2")
def sampler_det_keep_tail(spark, d):
    return sample.deterministic_shard(table(spark, d, "events"), EVENT, rank=2, world_size=7, drop_last=False).select("event_id", "pos")


def _weights(n: int) -> list[float]:
    return [float(i % 5) for i in range(n)]


def _drawn(indices) -> str:
    return (
        f"WITH i(draw_no, pos) AS (VALUES {_values(enumerate(indices))}), p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part) "
        "SELECT draw_no::BIGINT AS draw_no, p_partkey FROM i JOIN p USING (pos)"
    )


_PARTS = 2000  # rows of part at the size at which the SQL is compared


def _parts(spark, d, **options):
    part = table(spark, d, "part").select("p_partkey")
    n = part.count()
    if options.pop("weighted", False):
        options["weights"] = _weights(n)
    return sample.take(part, ["p_partkey"], sample.random_indices(n, **options)).select("draw_no", "p_partkey")


@query(_drawn(sample.random_indices(_PARTS, rank=1, world_size=4, seed=11)))
def sampler_random(spark, d):
    return _parts(spark, d, rank=1, world_size=4, seed=11)


@query(_drawn(sample.random_indices(_PARTS, rank=0, world_size=4, seed=12, weights=_weights(_PARTS))))
def sampler_weighted(spark, d):
    return _parts(spark, d, rank=0, world_size=4, seed=12, weighted=True)


@query(_drawn(sample.random_indices(_PARTS, rank=3, world_size=4, num_draws=100, seed=13)))
def sampler_num_draws(spark, d):
    return _parts(spark, d, rank=3, world_size=4, num_draws=100, seed=13)


@query(
    f"WITH i(epoch, draw_no, pos) AS (VALUES {_values((e, k, i) for e in range(3) for k, i in enumerate(sample.permutation(25, e)))}), "
    "p AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS pos FROM nation) "
    "SELECT epoch::BIGINT AS epoch, draw_no::BIGINT AS draw_no, n_nationkey FROM i JOIN p USING (pos)"
)
def embed_shuffle_epochs(spark, d):
    return sample.shuffled_epochs(table(spark, d, "nation"), ["n_nationkey"], 3).select("epoch", "draw_no", "n_nationkey")


@query(
    "WITH p AS (SELECT r_regionkey, row_number() OVER (ORDER BY r_regionkey) - 1 AS pos, count(*) OVER () AS n FROM region) "
    "SELECT e AS epoch, r_regionkey, e * n + pos AS out_pos FROM p, range(4) r(e) WHERE e * n + pos < 17"
)
def repeat_source_take(spark, d):
    return sample.repeated(table(spark, d, "region"), ["r_regionkey"], 17).select("epoch", "r_regionkey", "out_pos")


@query(
    "WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders) "
    "SELECT i AS out_pos, o_orderkey FROM range(20000) r(i) JOIN p ON pos = CASE WHEN i < 900 THEN i ELSE (i - 900) % 600 END"
)
def cache_iterator(spark, d):
    return sample.cached(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 600, return_caches_after=900, stop_after=20000).select("out_pos", "o_orderkey")


@query(
    f"WITH i(draw_no, pos) AS (VALUES {_values(enumerate(sample.cumulative_permutation(1000, [5, 6])))}), "
    "p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents) SELECT draw_no::BIGINT AS draw_no, doc_id FROM i JOIN p USING (pos)"
)
def directory_shuffle_cumulative(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return sample.take(docs, ["doc_id"], sample.cumulative_permutation(docs.count(), [5, 6])).select("draw_no", "doc_id")


# -- failures ----------------------------------------------------------------------------------------------

_RUN = (
    "WITH r AS (SELECT event_id, {failed} AS failed, row_number() OVER (ORDER BY event_id) AS n, sum({failed}::INTEGER) OVER (ORDER BY event_id) AS f FROM events), "
    "b AS (SELECT min(n) AS cutoff FROM r WHERE {breach}) SELECT event_id FROM r, b WHERE NOT failed AND (cutoff IS NULL OR n < cutoff)"
)


@query(_RUN.format(failed="(event_type = 'error')", breach="f > 1000"))
def max_failures_int(spark, d):
    return failure.limited(table(spark, d, "events"), F.col("event_type") == "error", EVENT, 1000, on_breach="truncate").select("event_id")


@query(_RUN.format(failed="(event_type = 'error' AND event_id > 3000)", breach="n >= 100 AND f * 20 > n * 3"))
def max_failures_rate(spark, d):
    failed = (F.col("event_type") == "error") & (F.col("event_id") > 3000)
    return failure.limited(table(spark, d, "events"), failed, EVENT, Fraction(3, 20), on_breach="truncate").select("event_id")


@query(
    "WITH r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS n, event_type = 'error' AS a, event_type <> 'error' AND value < 1 AS b FROM events), "
    "s AS (SELECT *, sum(a::INTEGER + b::INTEGER) OVER (ORDER BY n) AS f FROM r), x AS (SELECT min(n) AS cutoff FROM s WHERE f > 1500) "
    "SELECT event_id FROM s, x WHERE NOT a AND NOT b AND (cutoff IS NULL OR n < cutoff)"
)
def failure_scope_global(spark, d):
    """Two stages that share the pipeline's counters: an item fails in the first, or else may fail in the second."""
    p = spec.Builder().add_source(table(spark, d, "events"), EVENT)
    p = p.pipe({"kind": F.col("event_type")}, failed=F.col("event_type") == "error").pipe({"double": F.col("value") * 2}, failed=F.col("value") < 1)
    return plans.compile_pipeline(p.build(max_failures=1500, on_breach="truncate")).select("event_id")


# -- statistics --------------------------------------------------------------------------------------------


def _tasks(spark, d):
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("id"), (F.col("event_id") * 2.5).alias("timestamp"), F.col("event_type").alias("name"), (F.col("user_id") % 50).alias("num_tasks"),
        (F.col("user_id") % 3).alias("num_failures"), F.col("value").alias("ave_time"), (F.col("value") * 2).alias("p90_time"), (F.col("value") * 3).alias("p99_time"),
    )


_TASKS = (
    "(SELECT event_id AS id, event_id * 2.5::DOUBLE AS timestamp, event_type AS name, user_id % 50 AS num_tasks, user_id % 3 AS num_failures, value AS ave_time, "
    "value * 2 AS p90_time, value * 3 AS p99_time FROM events)"
)


@query(f"SELECT * FROM {_TASKS} WHERE name = 'click' ORDER BY timestamp DESC")
def stats_query_desc(spark, d):
    return stats.query(_tasks(spark, d), name="click")


@query(f"SELECT * FROM {_TASKS} WHERE timestamp >= 1000 AND timestamp <= 9000 ORDER BY timestamp DESC")
def stats_query_window(spark, d):
    return stats.query(_tasks(spark, d), start=1000.0, end=9000.0)


@query("SELECT event_id AS id, event_id * 2.5::DOUBLE AS timestamp, event_type AS event_name FROM events WHERE event_type = 'error' ORDER BY 2")
def event_query_asc(spark, d):
    e = _tasks(spark, d).select("id", "timestamp", F.col("name").alias("event_name"))
    return stats.query(e, name="error", name_column="event_name", ascending=True)


@query(
    "SELECT name, sum(num_tasks)::BIGINT AS total_tasks, sum(num_failures)::BIGINT AS total_failures, "
    "round(CASE WHEN sum(num_tasks) > 0 THEN sum(ave_time * num_tasks) / sum(num_tasks) ELSE 0 END, 6) AS avg_time, "
    "(sum(num_tasks) - sum(num_failures)) / greatest(1, sum(num_tasks)) * 100 AS success_rate, count(*) AS entries "
    f"FROM {_TASKS} GROUP BY name"
)
def stats_summary(spark, d):
    return stats.task_summary(_tasks(spark, d)).withColumn("avg_time", F.round("avg_time", 6))


@query(
    "SELECT name, sum(num_items)::BIGINT AS total_items, round(sum(num_items) / sum(elapsed), 6) AS avg_qps, round(sum(p * num_items) / sum(num_items), 6) AS avg_put_time, "
    "round(sum(g * num_items) / sum(num_items), 6) AS avg_get_time, round(sum(o * num_items) / sum(num_items), 6) AS avg_occupancy, count(*) AS entries FROM "
    "(SELECT event_type AS name, user_id % 40 AS num_items, value + 1 AS elapsed, value / 4 AS p, value / 8 AS g, value / 200 AS o FROM events) GROUP BY name"
)
def queue_stats_summary(spark, d):
    e = table(spark, d, "events").select(
        F.col("event_type").alias("name"), (F.col("user_id") % 40).alias("num_items"), (F.col("value") + 1).alias("elapsed"), (F.col("value") / 4).alias("ave_put_time"),
        (F.col("value") / 8).alias("ave_get_time"), (F.col("value") / 200).alias("occupancy_rate"),
    )
    out = stats.queue_summary(e)
    return out.select("name", "total_items", *[F.round(c, 6).alias(c) for c in ("avg_qps", "avg_put_time", "avg_get_time", "avg_occupancy")], "entries")


@query(
    "WITH t AS (SELECT event_type AS name, event_id, sum(user_id % 4) OVER w AS n, value AS m FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)), "
    "l AS (SELECT *, coalesce(lag(n) OVER w, 0) AS n0, coalesce(lag(m) OVER w, 0.0) AS m0 FROM t WINDOW w AS (PARTITION BY name ORDER BY event_id)) "
    "SELECT name, event_id, (n - n0)::BIGINT AS lap_n, CASE WHEN n > n0 THEN (m * n::DOUBLE - m0 * n0::DOUBLE) / (n - n0)::DOUBLE ELSE 0.0 END::DOUBLE AS lap_mean FROM l"
)
def lap_delta(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("event_type").orderBy("event_id")
    t = table(spark, d, "events").select(F.col("event_type").alias("name"), "event_id", F.sum(F.col("user_id") % 4).over(w).alias("n"), F.col("value").alias("m"))
    return stats.lap(t, "name", "event_id", "n", "m").select("name", "event_id", "lap_n", "lap_mean")


@query(
    "SELECT event_id, CASE WHEN e > 0 THEN user_id / e ELSE 0 END AS qps, CASE WHEN e > 0 THEN greatest(0, 1 - value / e) ELSE 0 END AS occupancy "
    "FROM (SELECT *, (user_id - 50)::DOUBLE AS e FROM events)"
)
def queue_qps_occupancy(spark, d):
    e = table(spark, d, "events").withColumn("e", (F.col("user_id") - 50).cast("double"))
    return e.select("event_id", stats.qps(F.col("user_id"), F.col("e")).alias("qps"), stats.occupancy(F.col("value"), F.col("e")).alias("occupancy"))


@query("""
WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn
    FROM events WHERE event_type IN ('signup', 'purchase')),
s AS (
  SELECT user_id, rn, CASE WHEN event_type = 'signup' THEN [event_id] ELSE []::BIGINT[] END AS open, NULL::BIGINT AS started, NULL::BIGINT AS stopped FROM e WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.rn, CASE WHEN e.event_type = 'signup' THEN list_append(s.open, e.event_id) ELSE s.open[2:] END,
    CASE WHEN e.event_type = 'purchase' AND len(s.open) > 0 THEN s.open[1] END, CASE WHEN e.event_type = 'purchase' AND len(s.open) > 0 THEN e.event_id END
  FROM s JOIN e ON e.user_id = s.user_id AND e.rn = s.rn + 1
)
SELECT user_id, started, stopped FROM s WHERE stopped IS NOT NULL
""")
def gc_pairs(spark, d):
    return stats.event_pairs(table(spark, d, "events"), "event_id", "event_type", "signup", "purchase", ["user_id"])


@query()
def p2_percentile(spark, d):
    return stats.p2_percentiles(table(spark, d, "events"), "event_type", "event_id", "value")


@query(
    "SELECT o_custkey, o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS best FROM orders"
)
def running_best(spark, d):
    return stats.running_best(table(spark, d, "orders"), "o_orderkey", "o_totalprice", within=["o_custkey"]).select("o_custkey", "o_orderkey", "best")


@query(
    "SELECT o_custkey, o_orderkey, coalesce(o_totalprice > max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) "
    "AS is_new FROM orders"
)
def new_best_flag(spark, d):
    return stats.running_best(table(spark, d, "orders"), "o_orderkey", "o_totalprice", within=["o_custkey"]).select("o_custkey", "o_orderkey", "is_new")


@query(
    "SELECT event_type AS name, string_agg(event_id::VARCHAR || ':' || user_id::VARCHAR, ',' ORDER BY event_id) AS series FROM events GROUP BY 1"
)
def stats_series(spark, d):
    pairs = F.array_sort(F.collect_list(F.struct("event_id", "user_id")))
    text = F.array_join(F.transform(pairs, lambda x: F.concat_ws(":", x["event_id"], x["user_id"])), ",")
    return table(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(text.alias("series"))


# -- functions ---------------------------------------------------------------------------------------------


@query(
    "SELECT p_partkey, 'fps=' || p_size::VARCHAR || '/1,' || CASE WHEN p_partkey % 2 = 0 THEN 'trim=start=' || (p_partkey % 10)::VARCHAR || ':end=' || (p_partkey % 10 + 5)::VARCHAR || ',' "
    "ELSE 'trim=start=' || (p_partkey % 10)::VARCHAR || ',' END || CASE WHEN p_size > 10 THEN 'scale=w=' || (p_size * 8)::VARCHAR || ':h=0:flags=bicubic:force_original_aspect_ratio=decrease,pad=w=' "
    "|| (p_size * 8)::VARCHAR || ':h=0:x=-1:y=-1:color=black,' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN 'tpad=stop=-1:stop_mode=clone,trim=end_frame=' || p_partkey::VARCHAR || ',' ELSE '' END "
    "|| 'format=pix_fmts=rgb24' AS description FROM part"
)
def video_filter_desc(spark, d):
    c = F.col
    text = filters.video_filter(
        frame_rate=(c("p_size"), F.lit(1)), start=c("p_partkey") % 10, end=F.when(c("p_partkey") % 2 == 0, c("p_partkey") % 10 + 5), scale_width=F.when(c("p_size") > 10, c("p_size") * 8),
        num_frames=F.when(c("p_partkey") % 3 == 0, c("p_partkey")), pix_fmt=F.lit("rgb24"),
    )
    return table(spark, d, "part").select("p_partkey", text.alias("description"))


@query(
    "SELECT p_partkey, nullif(concat_ws(',', CASE WHEN p_size % 2 = 0 THEN 'aformat=channel_layouts=' || p_size::VARCHAR || 'c' END, 'aresample=' || (p_partkey * 100)::VARCHAR, "
    "CASE WHEN p_partkey % 2 = 0 THEN 'atrim=end=' || p_size::VARCHAR END, CASE WHEN p_partkey % 3 = 0 THEN 'apad,atrim=end_sample=' || p_size::VARCHAR END, 'aformat=sample_fmts=fltp'), '') AS description FROM part"
)
def audio_filter_desc(spark, d):
    c = F.col
    text = filters.audio_filter(
        num_channels=F.when(c("p_size") % 2 == 0, c("p_size")), sample_rate=c("p_partkey") * 100, end=F.when(c("p_partkey") % 2 == 0, c("p_size")),
        num_frames=F.when(c("p_partkey") % 3 == 0, c("p_size")), sample_fmt=F.lit("fltp"),
    )
    return table(spark, d, "part").select("p_partkey", text.alias("description"))


@query(
    "SELECT p_partkey, 'buffer@in=video_size=' || (p_size * 16)::VARCHAR || 'x' || (p_size * 9)::VARCHAR || ':pix_fmt=yuv420p:time_base=1/' || p_size::VARCHAR || ':pixel_aspect=1/1' AS video, "
    "'abuffer=time_base=1/' || p_size::VARCHAR || ':sample_rate=' || (p_size * 1000)::VARCHAR || ':sample_fmt=fltp:channel_layout=stereo' AS audio FROM part"
)
def source_desc(spark, d):
    c, one = F.col, F.lit(1)
    video = filters.video_source(c("p_size") * 16, c("p_size") * 9, F.lit("yuv420p"), (one, c("p_size")), (one, one), "in")
    audio = filters.audio_source((one, c("p_size")), c("p_size") * 1000, F.lit("fltp"), F.lit("stereo"))
    return table(spark, d, "part").select("p_partkey", video.alias("video"), audio.alias("audio"))


@query("SELECT p_partkey, regexp_extract('train/n' || lpad(p_partkey::VARCHAR, 8, '0') || '/x.JPEG', 'n[0-9]{8}') AS wnid FROM part")
def wnid_parse(spark, d):
    path = F.concat(F.lit("train/n"), F.lpad(F.col("p_partkey").cast("string"), 8, "0"), F.lit("/x.JPEG"))
    return table(spark, d, "part").select("p_partkey", filters.wnid(path).alias("wnid"))


@query(
    "SELECT a.conv_id, a.turn, '### Instruction:' || chr(10) || a.text || chr(10) || chr(10) || CASE WHEN a.turn > 0 THEN '### Input:' || chr(10) || a.turn::VARCHAR || chr(10) || chr(10) ELSE '' END "
    "|| '### Response:' || chr(10) || b.text AS prompt FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'"
)
def prompt_format(spark, d):
    t = table(spark, d, "conversations")
    a = t.where("role = 'user'").select("conv_id", "turn", "text")
    b = t.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    given = F.when(F.col("turn") > 0, F.col("turn").cast("string"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", arrays.prompt(F.col("text"), given, F.col("answer")).alias("prompt"))


@query(
    "WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS t FROM conversations) "
    "SELECT conv_id, turn, array_to_string(list_concat(t[1:24], list_transform(range(24 - len(t[1:24])), lambda i: '<pad>')), ' ') AS tokens, "
    "least(len(t), 24)::INTEGER AS n_real FROM w"
)
def tokenize_pad(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", arrays.tokens(F.col("text"), 24).alias("t"))
    real = F.size(F.filter("t", lambda w: w != "<pad>"))
    return t.select("conv_id", "turn", F.array_join("t", " ").alias("tokens"), real.alias("n_real"))


@query("SELECT vec_id, unnest(range(len(embedding)))::INTEGER AS i, (unnest(embedding)::DOUBLE - 0.5) / 0.25 AS x FROM embeddings")
def normalize_vectors(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", arrays.normalised(F.col("embedding"), 0.5, 0.25).alias("v"))
    return e.select("vec_id", F.posexplode("v").alias("i", "x"))


@query(
    "WITH p AS (SELECT doc_id, quality, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents JOIN labels USING (doc_id)) "
    "SELECT pos // 32 AS batch_id, count(*) AS n, string_agg(quality::VARCHAR, ',' ORDER BY pos) AS labels FROM p GROUP BY 1 HAVING count(*) = 32"
)
def loader_collate(spark, d):
    found = core.lookup(table(spark, d, "documents").select("doc_id"), "doc_id", table(spark, d, "labels").withColumnRenamed("doc_id", "k"), "k", "quality")
    return loaders.data_loader(found, ["doc_id"], batch_size=32, item="quality", drop_last=True).select("batch_id", "n", joined().alias("labels"))


@query(
    "WITH RECURSIVE t AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 50 = 0 THEN NULL ELSE p_partkey // 3 END AS parent FROM part), "
    "l AS (SELECT id, 0 AS depth FROM t WHERE parent IS NULL UNION ALL SELECT t.id, l.depth + 1 FROM l JOIN t ON t.parent = l.id) SELECT id, depth FROM l"
)
def tree_levels(spark, d):
    """Breadth-first levels of a tree of experiments: a row for each node, parents first."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 50 != 0, F.floor(F.col("p_partkey") / 3)).alias("parent"))
    return experiments.levels(part.withColumnRenamed("parent", "parent_id")).select("id", "depth")


@query(
    "WITH s AS (SELECT o_orderkey, list_sort(list_distinct([o_custkey % 3, o_orderkey % 4])) AS spec FROM orders), f AS (SELECT min(o_orderkey) AS first, spec FROM s GROUP BY spec) "
    "SELECT o_orderkey FROM s JOIN f USING (spec) WHERE o_orderkey <> first"
)
def duplicate_specs(spark, d):
    """Experiments whose set of changes was proposed before: sets are compared without order or repetition."""
    s = table(spark, d, "orders").select("o_orderkey", F.array_sort(F.array_distinct(F.array(F.col("o_custkey") % 3, F.col("o_orderkey") % 4))).alias("spec"))
    first = s.groupBy("spec").agg(F.min("o_orderkey").alias("first"))
    return s.join(first, "spec").where("o_orderkey <> first").select("o_orderkey")


@query(
    "SELECT event_id, CASE WHEN v > 0 THEN 'throughput' WHEN s > 0 THEN 'step_ms' WHEN u > 0 THEN 'duration_s' ELSE 'none' END AS kind, "
    "CASE WHEN v > 0 THEN v WHEN s > 0 THEN -s WHEN u > 0 THEN -u ELSE '-Infinity'::DOUBLE END AS metric FROM "
    "(SELECT event_id, CASE WHEN event_type = 'click' THEN value END AS v, CASE WHEN event_type <> 'view' THEN value - 50 END AS s, (user_id - 20)::DOUBLE AS u FROM events)"
)
def metric_preference(spark, d):
    e = table(spark, d, "events")
    kind, value = stats.comparison(F.when(F.col("event_type") == "click", F.col("value")), F.when(F.col("event_type") != "view", F.col("value") - 50), F.col("user_id") - 20)
    return e.select("event_id", kind.alias("kind"), value.alias("metric"))


@query(
    "WITH RECURSIVE n AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 0 THEN (p_partkey - 1) // 2 END AS parent_id, CASE WHEN p_partkey % 7 = 3 THEN 5000 - p_retailprice ELSE -1 END AS duration FROM part), "
    "b AS (SELECT id FROM n WHERE duration > 0 ORDER BY duration, id LIMIT 1), up AS (SELECT n.id, n.parent_id FROM n JOIN b USING (id) UNION ALL "
    "SELECT n.id, n.parent_id FROM up JOIN n ON n.id = up.parent_id) SELECT parent_id AS parent, id AS child FROM up WHERE parent_id IS NOT NULL"
)
def best_experiment_path(spark, d):
    part = table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") > 0, F.floor((F.col("p_partkey") - 1) / 2)).alias("parent_id"),
        F.when(F.col("p_partkey") % 7 == 3, 5000 - F.col("p_retailprice")).otherwise(-1).alias("duration"),
    )
    return experiments.best_path(part)


# -- functions, formats and the rest ---------------------------------------------------------------------------


@query("SELECT event_id, CASE WHEN user_id % 7 = 0 THEN NULL ELSE upper(event_type) || ':' || user_id END AS label FROM events WHERE user_id % 7 <> 0")
def call_function(spark, d):
    """A Python function as a stage; None drops its item."""
    label = lambda r: f"{r['event_type'].upper()}:{r['user_id']}" if r["user_id"] % 7 else None
    p = spec.Builder().add_source(table(spark, d, "events").select("event_id", "event_type", "user_id"), EVENT).call(label, "label string", concurrency=4).build()
    return plans.compile_pipeline(p).select("event_id", "label")


@query("SELECT event_id, k AS part_index, user_id * k AS part FROM events, range(3) r(k) WHERE k < user_id % 4")
def call_generator(spark, d):
    def parts(user):
        for k in range(min(user % 4, 3)):
            yield user * k

    p = spec.Builder().add_source(table(spark, d, "events").select("event_id", "user_id"), EVENT).call(parts, "part long", item="user_id", name="part").build()
    return plans.compile_pipeline(p).select("event_id", "part_index", "part")


@query("SELECT event_id, user_id // (user_id % 5) AS share FROM events WHERE user_id % 5 <> 0")
def call_failing(spark, d):
    """A function that fails on some items: they are dropped, and the pipeline goes on."""
    p = spec.Builder().add_source(table(spark, d, "events").select("event_id", "user_id"), EVENT).call(lambda u: u // (u % 5), "share long", item="user_id").build()
    return plans.compile_pipeline(p).select("event_id", "share")


class _Sums:
    """Gathers three numbers at a time."""

    def __init__(self):
        self.n = self.total = 0

    def accumulate(self, row):
        self.n, self.total = self.n + 1, self.total + row["user_id"]
        return self.flush() if self.n == 3 else None

    def flush(self):
        out = {"n": self.n, "total": self.total} if self.n else None
        self.n = self.total = 0
        return out


@query(
    "WITH p AS (SELECT user_id, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events), w AS (SELECT pos % 4 AS worker, pos // 4 AS k, user_id FROM p) "
    "SELECT worker, k // 3 AS fold_id, count(*) AS n, sum(user_id)::BIGINT AS total FROM w GROUP BY 1, 2"
)
def custom_fold(spark, d):
    p = spec.Builder().add_source(table(spark, d, "events").select("event_id", "user_id"), EVENT).to(4).fold(_Sums, "n long, total long").to(spec.MAIN).build()
    return plans.compile_pipeline(p)


@query("SELECT vec_id, len(embedding)::BIGINT AS n, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def npy_table(spark, d):
    """Vectors written as NPY bytes and read back as tensors."""
    def dump(v):
        f = io.BytesIO()
        np.save(f, np.array(v, np.float64))
        return f.getvalue()

    files = functions.mapped(table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")), dump, "content binary", item="v")
    tensors = formats.npy_table(files.select(F.col("vec_id").cast("string").alias("path"), "content"))
    values = functions.mapped(tensors, lambda t: {"n": len(a := formats.from_tensor(t)), "total": float(a.sum())}, "n long, total double", item="tensor")
    return values.select(F.col("path").cast("long").alias("vec_id"), "n", F.round("total", 6).alias("total"))


@query("SELECT page_id::VARCHAR || '.html' AS member, octet_length(encode(html))::BIGINT AS bytes, md5(html) AS digest FROM pages")
def tar_table(spark, d):
    """Pages as tar archives, one for each, and their members read back."""
    def dump(r):
        f = io.BytesIO()
        with tarfile.open(fileobj=f, mode="w") as t:
            info = tarfile.TarInfo(f"{r['page_id']}.html")
            info.size = len(body := (r["html"] or "").encode())
            t.addfile(info, io.BytesIO(body))
        return f.getvalue()

    files = functions.mapped(table(spark, d, "pages").select("page_id", "html"), dump, "content binary")
    members = formats.tar_table(files.select(F.col("page_id").cast("string").alias("path"), "content"))
    return members.select("member", F.octet_length("content").cast("long").alias("bytes"), F.md5("content").alias("digest"))


@query("SELECT event_id, 1::BIGINT AS num_channels, 8000::BIGINT AS sample_rate, 2 * (user_id + 1) AS data_size FROM events")
def wav_headers(spark, d):
    silence = lambda u: media.encode_wav(np.zeros((u + 1, 1), np.int16), 8000)
    some = table(spark, d, "events").select("event_id", "user_id")
    files = functions.mapped(some, silence, "content binary", item="user_id")
    heads = formats.wav_header_table(files.select(F.col("event_id").cast("string").alias("path"), "content"))
    return heads.select(F.col("path").cast("long").alias("event_id"), "num_channels", "sample_rate", "data_size")


@query(
    "SELECT event_type AS name, count(*) AS n, round(avg(value), 6) AS mean, round(avg(value) - 1.96 * stddev_samp(value) / sqrt(count(*)), 6) AS low, "
    "round(avg(value) + 1.96 * stddev_samp(value) / sqrt(count(*)), 6) AS high FROM events GROUP BY 1"
)
def mean_interval(spark, d):
    out = stats.mean_interval(table(spark, d, "events").withColumn("name", F.col("event_type")), "name", "value")
    return out.select("name", "n", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


@query("SELECT event_id AS id, event_id * 2.5::DOUBLE AS timestamp, event_type AS name, user_id % 40 AS num_items FROM events WHERE event_type = 'view' AND event_id * 2.5 <= 9000 ORDER BY 2 DESC")
def queue_query_window(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("event_id") * 2.5).alias("timestamp"), F.col("event_type").alias("name"), (F.col("user_id") % 40).alias("num_items"))
    return stats.query(e, name="view", end=9000.0)

"""Operators on small literal inputs."""

import random
import resource
from fractions import Fraction

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from millrace.operators import batch, core, failure, functions, merge, pieces, route, sample
from millrace.operators.position import with_pos


def column(df, c, *order):
    return [r[0] for r in df.orderBy(*order).select(c).collect()]


def test_positions_cover_ties_nulls_and_any_ranges(spark):
    rows = [(random.Random(1).randrange(5), i) for i in range(50)] + [(None, 99)]
    df = spark.createDataFrame(rows, "a int, b int")
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for n in (1, 2, 7):
        got = with_pos(df, ["a", "b"], ranges=n).orderBy("pos").collect()
        assert [(r.a, r.b) for r in got] == want and [r.pos for r in got] == list(range(51))
    assert with_pos(df.limit(0), ["a", "b"]).count() == 0


def test_map_drops_nulls(numbers):
    assert column(core.pipe(numbers(range(6)), {"w": F.when(F.col("v") % 3 != 0, F.col("v") * 2 + 1)}), "w", "ord") == [3, 5, 9, 11]


def test_flat_map_drops_null_elements(numbers):
    df = core.flat_map(numbers([1, 2]), F.array(F.col("v"), F.lit(None).cast("long"), F.col("v") * 10), "x", "i")
    assert column(df, "x", "ord", "i") == [1, 10, 2, 20]


def test_lookups(spark, numbers):
    entries = spark.createDataFrame([(1, "a"), (2, None)], "k long, s string")
    assert column(core.lookup(numbers([0, 1, 2, 1]), "v", entries, "k", "s"), "s", "ord") == ["a", "a"]
    assert column(core.missing_keys(numbers([0, 1, 2]), "v", entries, "k"), "v", "ord") == [0]
    assert column(core.lookup_list(numbers([-4, -3, -1, 0, 2, 3]), F.col("v"), ["x", "y", "z"]), "value", "ord") == ["x", "z", "x", "z"]


@pytest.mark.parametrize(("drop", "want"), [(False, [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11], [12]]), (True, [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11]])])
def test_batches_of_13_by_4(numbers, drop, want):
    assert column(batch.batches(numbers(range(13)), 4, ["ord"], F.col("v"), drop_last=drop), "items", "batch_id") == want


def test_batches_in_a_region_of_workers(numbers):
    out = batch.batches(numbers(range(10)), 2, ["ord"], F.col("v"), workers=3).orderBy("worker", "batch_id").collect()
    assert [(r.worker, r["items"]) for r in out] == [(0, [0, 3]), (0, [6, 9]), (1, [1, 4]), (1, [7]), (2, [2, 5]), (2, [8])]


def test_unbatch_drops_null_elements(spark):
    df = spark.createDataFrame([([1, None, 2],), ([],), (None,)], "items array<int>")
    assert sorted(r[0] for r in batch.unbatch(df).collect()) == [1, 2]


@pytest.mark.parametrize("drop", [False, True])
def test_fold_by_size(spark, drop):
    words = ["a", "bb", "ccc", "dddd", "e", "ff", "ggg", "h"]
    df = spark.createDataFrame([(i, len(w)) for i, w in enumerate(words)], "ord long, size int")
    got = batch.fold_until(df, "ord", "size", 10, drop_last=drop).orderBy("fold_id").collect()
    # a bb ccc dddd reach 10 with four words; then e ff ggg h stay below it
    assert [(r.n, r.total) for r in got] == [(4, 10), *([] if drop else [(4, 7)])]


def test_custom_fold(spark):
    class Pairs:
        def __init__(self):
            self.kept = []

        def accumulate(self, row):
            self.kept.append(row["v"])
            if len(self.kept) == 2:
                out, self.kept = {"total": sum(self.kept)}, []
                return out

        def flush(self):
            return {"total": sum(self.kept)} if self.kept else None

    df = spark.createDataFrame([(g, i, i) for g in (0, 1) for i in range(3)], "g int, ord int, v int")
    got = batch.fold_python(df, Pairs, "ord", "total long", ["g"])
    assert sorted(r.total for r in got.collect()) == [1, 1, 2, 2]


SOURCES = [[0, 1, 2], [10], [20, 21, 22]]


@pytest.mark.parametrize(("sources", "stop", "want"), [
    (SOURCES, -1, [0, 10, 20, 1]), (SOURCES, 0, [0, 10, 20, 1, 21, 2, 22]), ([[0, 1, 2], [10, 11, 12], [20, 21, 22]], 5, [0, 10, 20, 1, 11]), ([[], [1]], -1, []),
])
def test_round_robin(numbers, sources, stop, want):
    assert column(merge.round_robin([numbers(s) if s else numbers([0]).limit(0) for s in sources], [["ord"]] * len(sources), stop), "v", "pos") == want


@pytest.mark.parametrize(("seed", "stop", "want"), [
    (0, 0, [10, 11, 0, 20, 1, 2, 21, 22, 3]),
    (0, -1, [10, 11]),
    (0, 4, [10, 11, 0, 20]),
    (3, 0, [0, 10, 11, 1, 2, 3, 20, 21, 22]),
    (3, -1, [0, 10, 11]),
    (3, 4, [0, 10, 11, 1]),
])
def test_weighted_merge_of_fixed_seeds(numbers, seed, stop, want):
    got = merge.weighted([numbers([0, 1, 2, 3]), numbers([10, 11]), numbers([20, 21, 22])], [["ord"]] * 3, [1.0, 2.0, 0.5], stop_after=stop, seed=seed)
    assert column(got, "v", "pos") == want


def test_weighted_merge_of_long_sources(spark):
    """Each source in its own order, picked about as often as its weight says; more picks than one batch holds."""
    a, b = spark.range(30_000).withColumnRenamed("id", "v"), spark.range(100_000, 160_000).withColumnRenamed("id", "v")
    got = [r.v for r in merge.weighted([a, b], [["v"], ["v"]], [1.0, 3.0], seed=5).orderBy("pos").select("v").collect()]
    assert len(got) == 90_000 and [v for v in got if v < 100_000] == list(range(30_000)) and [v for v in got if v >= 100_000] == list(range(100_000, 160_000))
    assert 0.23 < sum(v < 100_000 for v in got[:40_000]) / 40_000 < 0.27


def test_weights(numbers):
    a, b = numbers([0, 1, 2]), numbers([10, 11])
    assert column(merge.weighted([a, b], [["ord"]] * 2, [1e6, 1], stop_after=3), "v", "pos") == [0, 1, 2]
    assert set(column(merge.weighted([a, b], [["ord"]] * 2, [1, 0]), "v", "pos")) == {0, 1, 2}
    for bad in ([1], [-1, 2], [0, 0]):
        with pytest.raises(ValueError):
            merge.weighted([a, b], [["ord"]] * 2, bad)


def test_routes(numbers):
    df = route.route_values(numbers(range(6)), F.col("v") % 2, [lambda d: d["v"] * 2, lambda d: d["v"] + 100], "r")
    assert column(df, "r", "ord") == [0, 101, 4, 103, 8, 105]
    both = route.route_frames(numbers(range(4)), F.col("v") % 2, [lambda d: d.where("v > 0"), lambda d: d])
    assert sorted(column(both, "v", "ord")) == [1, 2, 3]
    with pytest.raises(Exception, match="route out of range"):
        route.route_values(numbers(range(6)), F.col("v"), [lambda d: d["v"]] * 2, "r").collect()


def test_batched_routes_stand_in_order_of_path(numbers):
    df = route.route_batched(numbers(range(6)), 4, ["ord"], 1 - F.col("v") % 2, [lambda d: d["v"], lambda d: F.when(d["v"] != 4, d["v"])], "x")
    assert column(df, "items", "batch_id") == [[1, 3, 0, 2], [5]]


def test_deterministic_shards(numbers):
    df = numbers(range(11))
    with pytest.warns(UserWarning):
        assert [column(sample.deterministic_shard(df, ["ord"], rank=r, world_size=4), "v", "pos") for r in range(4)] == [[0, 4], [1, 5], [2, 6], [3, 7]]
    assert column(sample.deterministic_shard(df, ["ord"], rank=0, world_size=4, drop_last=False), "v", "pos") == [0, 4, 8]
    for bad in ({"rank": 4, "world_size": 4}, {"rank": 0, "world_size": 12}):
        with pytest.raises(ValueError):
            sample.deterministic_shard(df, ["ord"], **bad)


def test_random_shards_are_disjoint_and_cover():
    parts = [sample.random_indices(20, rank=r, world_size=4, seed=5) for r in range(4)]
    assert sorted(sum(parts, [])) == list(range(20))
    drawn = sample.random_indices(3, rank=0, world_size=1, num_draws=3000, weights=[1, 0, 3])
    assert 0.2 < drawn.count(0) / 3000 < 0.3 and 1 not in drawn
    for bad in ([1, 2], [1, float("nan"), 1], [0, 0, 0], [-1, 1, 1]):
        with pytest.raises(ValueError):
            sample.random_indices(3, rank=0, world_size=1, weights=bad)


@pytest.mark.parametrize(
    "n,caches,after,stop,want",
    [
        (5, 3, None, 9, "0 1 2 0 1 2 0 1 2"), (7, 3, 5, 11, "0 1 2 3 4 0 1 2 0 1 2"), (1, 1, None, 4, "0 0 0 0"), (2, 4, None, 6, "0 1 0 1 0 1"), (3, 2, 9, 8, "0 1 2 0 1 0 1 0"),
        (12, 1, 1, 3, "0 0 0"), (9, 4, 6, 5, "0 1 2 3 4"), (4, 4, 4, 10, "0 1 2 3 0 1 2 3 0 1"), (6, 2, 6, 6, "0 1 2 3 4 5"), (6, 5, 5, 12, "0 1 2 3 4 0 1 2 3 4 0 1"),
    ],
)
def test_cache_indices(n, caches, after, stop, want):
    assert sample.cached_indices(n, caches, return_caches_after=after, stop_after=stop) == [int(x) for x in want.split()]


def test_caches(numbers):
    assert column(sample.cached(numbers(range(5)), ["ord"], 3, stop_after=9), "v", "out_pos") == [0, 1, 2] * 3
    assert column(sample.cached(numbers(range(7)), ["ord"], 3, return_caches_after=5, stop_after=11), "v", "out_pos") == [0, 1, 2, 3, 4, 0, 1, 2, 0, 1, 2]
    with pytest.raises(ValueError):
        sample.cached(numbers(range(7)), ["ord"], 3, return_caches_after=2, stop_after=5)


def test_repeats_and_shuffles(numbers):
    assert column(sample.repeated(numbers([7, 8]), ["ord"], 5), "v", "out_pos") == [7, 8, 7, 8, 7]
    got = sample.shuffled_epochs(numbers(range(5)), ["ord"], 2).orderBy("epoch", "draw_no").collect()
    assert [r.v for r in got] == sample.permutation(5, 0) + sample.permutation(5, 1)
    once = sample.permutation(6, 1)
    again = list(once)
    random.Random(2).shuffle(again)
    assert sample.cumulative_permutation(6, [1, 2]) == again


@given(flags=st.lists(st.booleans(), min_size=1, max_size=40), limit=st.integers(0, 8))
@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_failure_limit_against_a_loop(spark, flags, limit):
    df = spark.createDataFrame(list(enumerate(flags)), "ord long, bad boolean")
    kept, bad = [], 0
    for i, f in enumerate(flags):
        bad += f
        if bad > limit:
            break
        if not f:
            kept.append(i)
    assert column(failure.limited(df, F.col("bad"), ["ord"], limit, on_breach="truncate"), "ord", "ord") == kept


def test_failure_rates_wait_for_100_items(spark):
    df = spark.range(200).select(F.col("id").alias("ord"), (F.col("id") < 30).alias("bad"))
    got = failure.limited(df, F.col("bad"), ["ord"], Fraction(3, 10), on_breach="truncate")
    assert got.count() == 170  # 30 of 100 isn't above the rate
    with pytest.raises(failure.PipelineFailure):
        failure.limited(df, F.col("bad"), ["ord"], Fraction(29, 100))
    assert failure.limited(df, F.col("bad"), ["ord"], -1).count() == 170
    with pytest.raises(ValueError):
        failure.limited(df, F.col("bad"), ["ord"], Fraction(3, 2))


def test_positions_of_any_keys(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["", "a", "ab", "é", None, "zz"]), rng.choice([None, 1.5, -2.0]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "s string, x double, i long").repartition(7)
    got = [(r.s, r.x, r.i) for r in with_pos(df, ["s", "x", "i"], ranges=8).orderBy("pos").collect()]
    low = lambda v: (v is not None, v if v is not None else "")
    assert got == sorted(rows, key=lambda r: (low(r[0]), (r[1] is not None, r[1] or 0), r[2]))
    assert with_pos(df.limit(0), ["s"]).count() == 0
    assert sorted(r.pos for r in with_pos(df, ["s"], ranges=8).collect()) == list(range(400))


def test_fold_of_a_table_larger_than_a_batch(spark):
    df = spark.range(50_000).selectExpr("id as ord", "id % 7 as size").repartition(5)
    want, n, total = [], 0, 0
    for i in range(50_000):
        n, total = n + 1, total + i % 7
        if total >= 100:
            want.append((len(want), n, total, i))
            n = total = 0
    if n:
        want.append((len(want), n, total, 49_999))
    assert [tuple(r) for r in batch.fold_until(df, "ord", "size", 100).orderBy("fold_id").collect()] == want
    assert batch.fold_until(df.limit(0), "ord", "size", 100).count() == 0


def test_shuffles_by_a_keyed_hash(numbers):
    df = numbers(range(100))
    rows = sample.shuffled(df, ["ord"], 3, epochs=2).collect()
    one, two = ([r.v for r in sorted(rows, key=lambda r: r.draw_no) if r.epoch == e] for e in (0, 1))
    assert sorted(one) == sorted(two) == list(range(100)) and one != two and one != list(range(100))
    assert one == column(sample.shuffled(df, ["ord"], 3), "v", "draw_no")


def test_a_shuffle_at_the_end_of_a_pass(numbers):
    first = sample.shuffled_epochs(numbers(range(9)), ["ord"], 3, epoch=4)
    last = sample.shuffled_epochs(numbers(range(9)), ["ord"], 3, epoch=4, shuffle_last=True)
    of = lambda df, e: column(df.where(F.col("epoch") == e), "v", "draw_no")
    assert of(last, 4) == list(range(9)) and of(last, 5) == of(first, 4) and of(last, 6) == of(first, 5)


def test_large_results_are_sent_on_before_the_others_are_made(spark):
    """A task holds few of the results of a batch, which may be far larger than its items."""
    def made(_):
        with open("/proc/self/statm") as f:
            return {"content": b"x" * (1 << 20), "pages": int(f.read().split()[1])}

    rows = functions.mapped(spark.range(0, 400, 1, 1), made, "content binary, pages long", item="id")
    least, most, total = rows.agg(F.min("pages"), F.max("pages"), F.sum(F.octet_length("content"))).first()
    assert total == 400 << 20 and (most - least) * resource.getpagesize() < 150 << 20


def test_pieces_and_sent_batches_are_bounded():
    schema = pa.schema([("k", pa.int64()), ("v", pa.binary())])
    rows = [{"k": k, "v": bytes(1 << 20 if k % 10 == 0 else 3)} for k in range(3000)] + [{"k": 3000, "v": None}]
    batches = list(pieces.sent(iter(rows), schema))
    assert [r for b in batches for r in b.to_pylist()] == rows
    assert max(b.num_rows for b in batches) <= pieces.SENT and max(b.nbytes for b in batches) < 6 << 20
    whole = pa.RecordBatch.from_pylist(rows, schema=schema)
    parts = list(pieces.pieces([whole, whole.slice(0, 0), whole.slice(2999)]))
    assert [r for p in parts for r in p] == [*rows, *rows[2999:]] and max(map(len, parts)) < 50

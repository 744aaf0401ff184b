"""Specs, their compiler, loaders and streams."""

from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from millrace import hooks, stats
from millrace.operators import functions, merge
from millrace.plans import compile as plans, loaders, spec
from millrace.streaming import epochs


def test_a_pipeline_end_to_end(numbers):
    p = spec.Builder().add_source(numbers(range(10)), ["ord"]).pipe({"v": F.when(F.col("v") % 3 != 0, F.col("v") * 2)}).aggregate(2, "v").disaggregate().add_sink(2).build()
    assert [r["item"] for r in plans.iterate(p)] == [2, 4, 8, 10, 14, 16]


def test_paths_of_different_lengths(numbers):
    double, plus = spec.Pipe({"v": F.col("v") * 2}), spec.Pipe({"v": F.col("v") + 100})
    p = spec.Builder().add_source(numbers(range(6)), ["ord"]).path_variants(F.col("v") % 2, [[double], [plus, plus]]).build()
    assert [r["v"] for r in plans.iterate(p)] == [0, 201, 4, 203, 8, 205]


def test_merged_pipelines(numbers):
    parts = tuple(spec.Builder().add_source(numbers(v), ["ord"]).build() for v in ([0, 1, 2], [10]))
    p = spec.Builder().add_source(spec.MergeSource(parts, "round_robin")).build()
    assert [r["v"] for r in plans.iterate(p)] == [0, 10, 1, 2]
    bag = spec.Builder().add_source(spec.MergeSource(parts)).build()
    assert sorted(r["v"] for r in plans.iterate(bag)) == [0, 1, 2, 10]


def test_failing_items_are_dropped_or_limited(numbers):
    stage = {"w": F.col("v") + 1}
    p = spec.Builder().add_source(numbers(range(10)), ["ord"]).pipe(stage, failed=F.col("v") % 3 == 0).build()
    assert [r["w"] for r in plans.iterate(p)] == [2, 3, 5, 6, 8, 9]
    strict = spec.Builder().add_source(numbers(range(10)), ["ord"]).pipe(stage, failed=F.col("v") % 3 == 0, max_failures=2).build()
    with pytest.raises(RuntimeError):
        list(plans.iterate(strict))


def test_epochs_flush_their_own_batches(spark):
    df = spark.createDataFrame([(e, i, i) for e in range(2) for i in range(3)], "epoch int, ord int, v int")
    p = spec.Builder().add_source(df, ["ord"], epoch="epoch").aggregate(2, "v").build()
    assert [r["items"] for r in plans.iterate(p, epoch=1)] == [[0, 1], [2]]
    with pytest.raises(ValueError):
        next(plans.iterate(p))


def test_specs_are_checked(numbers):
    df = numbers([1])
    b = lambda: spec.Builder().add_source(df, ["ord"])
    stage = {"w": F.col("v")}
    for make in (
        lambda: spec.Builder().build(), lambda: b().add_source(df, ["ord"]), lambda: b().add_sink().add_sink(), lambda: b().add_sink(0), lambda: b().aggregate(0, "v"),
        lambda: b().pipe(stage, concurrency=0), lambda: spec.Source([1], ("ord",)), lambda: b().to(2).pipe(stage).build(), lambda: b().to(2).to(spec.MAIN).build(),
        lambda: b().to(spec.MAIN).build(), lambda: b().to(2).pipe(stage, ordered=True).to(spec.MAIN).build(), lambda: spec.Generate(F.array(), ordered=True),
        lambda: b().path_variants(F.lit(0), []), lambda: b().path_variants(F.lit(0), [[]]), lambda: spec.MergeSource(()), lambda: spec.MergeSource((b().build(),), "sorted"),
    ):
        with pytest.raises(ValueError):
            make()


def test_loaders(numbers):
    out = loaders.data_loader(numbers(range(7)), ["ord"], preprocess={"v": F.col("v") * 2}, batch_size=3, item="v", drop_last=True, transfer={"n": F.col("n")})
    assert [r["items"] for r in out.orderBy("batch_id").collect()] == [[0, 2, 4], [6, 8, 10]]
    out = loaders.indexed_loader(numbers(range(7)), ["ord"], item="v", batch_size=2, indices=[5, 5, 1])
    assert [r["items"] for r in out.orderBy("batch_id").collect()] == [[5, 5], [1]]
    out = loaders.indexed_loader(numbers(range(7)), ["ord"], item="v", batches=[[3, 1], [0]])
    assert [r["items"] for r in out.orderBy("batch_id").collect()] == [[3, 1], [0]]
    for bad in ({"batches": [[0]], "batch_size": 4}, {"batches": [[0]], "shuffle": True}, {"indices": [0], "shuffle": True}, {"batch_size": None, "drop_last": True}):
        with pytest.raises(ValueError):
            loaders.indexed_loader(numbers([1]), ["ord"], item="v", **bad)


def test_continuous_source_gives_an_epoch_for_each_file(spark, tmp_path):
    for k, n in enumerate((10, 11, 12)):
        spark.range(n).select(F.col("id").alias("ord"), F.col("id").alias("v")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = epochs.file_epochs(spark, f"{tmp_path}/in", "ord long, v long")
    epochs.epoch_batches(stream, 4, ["ord"], "v", f"{tmp_path}/out", f"{tmp_path}/check")
    got = spark.read.parquet(f"{tmp_path}/out").groupBy("epoch").agg(F.sort_array(F.collect_list("n"), asc=False).alias("n"), F.sum("n").alias("t")).orderBy("t").collect()
    assert [r["n"] for r in got] == [[4, 4, 2], [4, 4, 3], [4, 4, 4]]
    with pytest.raises(ValueError):
        merge.bag([stream, spark.range(3).select(F.col("id").alias("ord"), F.col("id").alias("v"))])


def test_keyed_fold_over_a_stream(spark, tmp_path):
    spark.createDataFrame([("a", 6), ("a", 5), ("b", 4), ("a", 3)], "k string, size int").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, size int").parquet(f"{tmp_path}/in")
    out = epochs.fold_stream(stream, "k", "size", 10)
    q = out.writeStream.format("memory").queryName("folded").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination(120)
    assert [(r.k, r.n, r.total) for r in spark.table("folded").collect()] == [("a", 2, 11)]


def test_stages_share_the_pipelines_counters(numbers):
    def build(**options):
        b = spec.Builder().add_source(numbers(range(20)), ["ord"]).pipe({"a": F.col("v") + 1}, failed=F.col("v") % 4 == 0)
        return b.pipe({"b": F.col("a") * 2}, failed=F.col("v") % 10 == 3).build(**options)

    assert [r["v"] for r in plans.iterate(build(max_failures=7))] == [v for v in range(20) if v % 4 and v % 10 != 3]  # 5 and 2 failures
    with pytest.raises(RuntimeError):
        list(plans.iterate(build(max_failures=4)))
    # Failures at 0, 3, 4, 8, 12: the fifth one is the breach.
    assert [r["v"] for r in plans.iterate(build(max_failures=4, on_breach="truncate"))] == [1, 2, 5, 6, 7, 9, 10, 11]


def test_a_stage_with_its_own_limit_counts_alone(numbers):
    b = spec.Builder().add_source(numbers(range(20)), ["ord"]).pipe({"a": F.col("v")}, failed=F.col("v") % 4 == 0, max_failures=5)
    p = b.pipe({"b": F.col("v")}, failed=F.col("v") == 7).build(max_failures=1)
    assert [r["v"] for r in plans.iterate(p)] == [v for v in range(20) if v % 4 and v != 7]


def test_a_shared_rate_counts_the_invocations_of_all_stages(numbers):
    stage = {"a": F.col("v")}
    b = lambda failed: spec.Builder().add_source(numbers(range(120)), ["ord"]).pipe(stage).pipe(stage, failed=failed)
    # 50 items are 100 invocations: 6 failures of them are over a twentieth, 5 are not.
    assert len(list(plans.iterate(b(F.col("v") % 10 == 9).build(max_failures=Fraction(1, 20))))) == 108
    cut = plans.compile_pipeline(b(F.col("v").between(40, 45)).build(max_failures=Fraction(1, 20), on_breach="truncate"))
    assert cut.count() == 43  # up to item 48, in which invocation 100 falls


async def _slow_double(v):
    return v * 2 if v != 3 else None


def _parts(v):
    yield v
    if v == 2:
        raise ValueError("two")
    yield None
    yield v * 10


@pytest.mark.parametrize(("fn", "want"), [
    (lambda v: v + 1, [1, 2, 3, 4]), (_slow_double, [0, 2, 4]), (_parts, [0, 0, 1, 10, 2, 3, 30]), ({0: 5, 2: 6}, [5, 6]), ([7, 8], [7, 8]), (lambda v: 6 // v, [6, 3, 2]),
])
@pytest.mark.parametrize("concurrency", [1, 3])
def test_functions_as_stages(numbers, fn, want, concurrency):
    p = spec.Builder().add_source(numbers(range(4)), ["ord"]).call(fn, "w long", item="v", concurrency=concurrency).build()
    assert [r["w"] for r in plans.iterate(p)] == want


def test_failing_functions_count(numbers):
    b = lambda n: spec.Builder().add_source(numbers(range(6)), ["ord"]).call(lambda r: {"w": 6 // (r["v"] % 3)}, "w long").build(max_failures=n)
    assert [r["w"] for r in plans.iterate(b(2))] == [6, 3, 6, 3]
    with pytest.raises(RuntimeError):
        list(plans.iterate(b(1)))


def test_generators_count_each_invocation(numbers):
    out = functions.mapped(numbers(range(3)), _parts, "w long", item="v", index="k")
    assert sorted((r.v, r.c) for r in out.groupBy("v").agg(F.sum("_calls").alias("c")).collect()) == [(0, 4), (1, 4), (2, 2)]


def test_routing_inside_batches(numbers):
    double, drop = [spec.Pipe({"item": F.col("item") * 2})], [spec.Pipe({"item": F.when(F.col("item") > 100, 1)})]
    b = spec.Builder().add_source(numbers([3, 4, 5, 6, 1, 1, 7]), ["ord"]).aggregate(3, "v")
    p = b.path_variants(F.when(F.col("item") == 1, 1).otherwise((F.col("item") % 2) * 2), [double, drop, [spec.Call(lambda v: -v, "item long", item="item")]], batched=True).build()
    assert [r["items"] for r in plans.iterate(p)] == [[8, -3, -5], [12], [-7]]
    with pytest.raises(ValueError):
        b.path_variants(F.lit(0), [[spec.Disaggregate()]], batched=True)


class Pairs:
    def __init__(self):
        self.held = []

    def accumulate(self, row):
        self.held.append(row["v"])
        if len(self.held) == 2:
            out, self.held = {"total": sum(self.held)}, []
            return out

    def flush(self):
        return {"total": sum(self.held)} if self.held else None


def test_custom_folds_and_merges(numbers):
    p = spec.Builder().add_source(numbers(range(5)), ["ord"]).fold(Pairs, "total long").build()
    assert [r["total"] for r in plans.iterate(p)] == [1, 5, 4]
    parts = tuple(spec.Builder().add_source(numbers(v), ["ord"]).build() for v in ([0, 1], [10]))
    last_first = lambda frames, orders: merge.concat(frames[::-1], orders[::-1])
    assert [r["v"] for r in plans.iterate(spec.Builder().add_source(spec.MergeSource(parts, last_first)).build())] == [10, 0, 1]


def test_a_consumer_gets_items_one_at_a_time(numbers):
    p = spec.Builder().add_source(numbers(range(3)), ["ord"]).add_sink(1).build()
    with plans.Consumer(p) as c:
        assert [c.get_item(60)["v"] for _ in range(3)] == [0, 1, 2]
        with pytest.raises(EOFError):
            c.get_item(60)
    slow = spec.Builder().add_source(numbers([1]), ["ord"]).call(lambda v: __import__("time").sleep(2) or v, "w long", item="v").build()
    with plans.Consumer(slow) as c, pytest.raises(TimeoutError):
        c.get_item(0.01)
    strict = spec.Builder().add_source(numbers([0, 0]), ["ord"]).call(lambda v: 1 // v, "w long", item="v").build(max_failures=1)
    with plans.Consumer(strict) as c, pytest.raises(RuntimeError):
        c.get_item(60)


def test_a_consumer_of_epochs(spark):
    df = spark.createDataFrame([(e, i) for e in range(2) for i in range(2)], "epoch int, ord int")
    c = plans.Consumer(spec.Builder().add_source(df, ["ord"], epoch="epoch").build(), epochs=[0, 1])
    assert [[r["epoch"] for r in c], [r["epoch"] for r in c]] == [[0, 0], [1, 1]]
    c.stop()


def test_figures_of_a_stage(numbers):
    out = functions.mapped(numbers(range(1, 6)), lambda v: 1 // (v - 3), "w long", item="v")
    r = stats.task_row(out, "div").first()
    assert (r["name"], r["num_tasks"], r["num_failures"]) == ("div", 5, 1) and 0 < r["ave_time"] < 1 and r["p90_time"] <= r["p99_time"]
    assert stats.task_row(out.limit(0), "div").first()["ave_time"] == 0


def test_figures_of_a_pipeline_and_diagnostic_mode(spark, numbers):
    b = spec.Builder().add_source(numbers(range(9)), ["ord"]).pipe({"v": F.when(F.col("v") != 4, F.col("v"))})
    p = b.call(lambda v: v + 1, "w long", item="v", name="one").call(lambda w: 1 // (w - 2), "x long", item="w", name="two", concurrency=2).build()
    assert [(r["name"], r["num_tasks"], r["num_failures"]) for r in plans.figures(p).collect()] == [("0:1:one", 8, 0), ("0:2:two[2]", 8, 1)]
    spark.conf.set("millrace.diagnostic", "true")
    spark.conf.set("millrace.diagnostic.items", "3")
    try:
        assert [r["x"] for r in plans.iterate(p)] == [-1, 1]
    finally:
        spark.conf.unset("millrace.diagnostic")
        spark.conf.unset("millrace.diagnostic.items")


def test_function_stages_are_observed_on_request(spark, numbers):
    spark.conf.set("millrace.stats", "true")
    try:
        df = plans.compile_pipeline(spec.Builder().add_source(numbers(range(4)), ["ord"]).call(lambda v: 1 // v, "w long", item="v", name="div").build())
    finally:
        spark.conf.unset("millrace.stats")
    (seen,) = hooks.observations()
    assert df.count() == 3 and seen.get == {"num_tasks": 4, "num_failures": 1} and not hooks.observations()


def test_reads_dont_multiply_with_counted_stages(spark, numbers):
    def scans(k):
        b = spec.Builder().add_source(numbers(range(30)), ["ord"])
        for i in range(k):
            b = b.call(lambda v: v, f"w{i} long", item="v", name=f"c{i}")
        df = plans.compile_pipeline(b.build(max_failures=3))
        assert df.count() == 30
        return df._jdf.queryExecution().optimizedPlan().toString().count("Relation")

    assert scans(4) <= scans(2) + 2  # what reaches the second stage and later ones is a table


def test_a_generator_of_many_results(spark, numbers):
    def many(v):
        yield from range(5000)
        raise ValueError("enough")

    out = functions.mapped(numbers([1]), many, "x long", item="v", index="i")
    assert out.where("x is not null").count() == 5000 and out.where("_error is not null").select("i").collect()[0].i == 5000

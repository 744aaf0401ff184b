"""Mixing sources to target weights over a time-varying curriculum.

Each source has a weight schedule, piecewise linear over training time 0 .. 1. Its integral is the source's
share of the mix; a source stops at `repeats` times its size, and what it can't give is shared again by weight.
A source's documents stand in a fixed random order, read as often as its target needs; the cumulative demand of
its schedule, inverted at the words read so far, gives each reading its training position. Documents are then
sorted by position with a range exchange.

Sums before a document are taken in two steps, so that no task holds a source: documents are dealt into
buckets of their order (about BUCKET rows each), the sums of the buckets are added up, and rows only inside
a bucket. The last reading that a target reaches gives its first words only, so a source gives its target exactly.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.llm.store import cut

#: Schedules in turn for sources in order of their names: knots (time, weight). The integrals are 1, 2 and 3.
SCHEDULES = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 2.0), (1.0, 2.0)),
    ((0.0, 1.5), (0.5, 2.5), (1.0, 5.5)),
)
REPEATS = 3
BUCKET = 1000
WORD = r"[^\x20\x09-\x0D]+"


def integral(knots) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))


def _segments(knots):
    """(demand before, start time, start weight, slope) of each piece with demand."""
    before = 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        area = (t1 - t0) * (w0 + w1) / 2
        if area > 0:
            yield before, t0, w0, (w1 - w0) / (t1 - t0)
        before += area


def position_sql(schedules, number: str, share: str) -> str:
    """SQL for the time at which a source of this schedule number has asked for this share (0 .. 1) of its demand.

    Inside a piece, demand is w0 x + slope x^2 / 2; solved for x in the form that is stable for any slope.
    """
    cases = []
    for k, knots in enumerate(schedules):
        total = integral(knots)
        for before, t0, w0, slope in sorted(_segments(knots), reverse=True):
            a = f"({share} * {total!r}D - {before!r}D)"
            x = f"2D * {a} / ({w0!r}D + sqrt({w0 * w0!r}D + {2 * slope!r}D * {a}))"
            x = f"CASE WHEN {a} <= 0D THEN 0D ELSE {x} END"
            cases.append(f"WHEN {number} = {k} AND {a} >= 0D THEN least(1D, {t0!r}D + {x})")
    return f"CASE {' '.join(cases)} END"


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, source, size) of docs; size is the number of words, runs of other than ASCII white space."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", F.xxhash64("doc_id", "text", "source").alias("row_key"), "source", size.alias("size"))


def targets(sizes: DataFrame, schedules=SCHEDULES, repeats: int = REPEATS) -> DataFrame:
    """(source, number, source_size, source_rows, target): one row for each source.

    The sources that stop at their limit are those with the smallest limit for their weight: in that order,
    the first source whose limit is not below the rate (words for a weight of 1) that is left when all before it
    have stopped, and all after it, get that rate times their weight.
    """
    weights = [integral(k) for k in schedules]
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    table = table.withColumn("number", ((F.row_number().over(by_name) - 1) % len(schedules)).cast("int"))
    table = table.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("number") + 1))
    table = table.withColumn("most", F.col("source_size") * repeats)
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, all_of = order.rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0)
    table = table.withColumn(
        "rate",
        (F.sum("source_size").over(all_of) - F.coalesce(F.sum("most").over(before), zero))
        / (F.sum("weight").over(all_of) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    )
    fits = F.col("rate") <= F.col("most") / F.col("weight")
    table = table.withColumn("rate", F.first(F.when(fits, F.col("rate")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.when(F.col("rate").isNull(), F.col("most").cast("double")).otherwise(F.col("rate") * F.col("weight"))
    return table.select("source", "number", "source_size", "source_rows", target.alias("target"))


def readings(docs: DataFrame, schedules=SCHEDULES, repeats: int = REPEATS) -> DataFrame:
    """(doc_id, row_key, size, source_size, target, taken, epochs) for each row of docs (doc_id, text, source).

    epochs lists the readings of the document that the mix takes: (epoch, words, position). taken is the sum of
    their words. Null and empty texts have size 0 and take nothing, as do all rows if no text has words; a null
    source is a source of its own, last in order; the order inside a source is by md5(doc_id) (where that is null,
    md5(row_key)), doc_id, size and row_key, so that it is the same in every run (rows equal in all these are interchangeable). Schedules with a weight of 0
    over some time are allowed, if their integral is not 0.
    """
    if not all(integral(k) > 0 for k in schedules):
        raise ValueError("every schedule needs a positive integral")
    sizes = cut(sized(docs), "mix-sizes")
    per_source = cut(targets(sizes, schedules, repeats), "mix-targets")
    # Rows without an id are spread by their own hash, so that many of them aren't one bucket.
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("row_key").cast("string")))
    rows = sizes.join(per_source.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name")))
    part = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("digest", digest).withColumn(
        "bucket", F.floor(part * F.ceil(F.col("source_rows") / F.lit(BUCKET)) / F.lit(2.0**32)).cast("long")
    )
    rows = cut(rows.drop("source_rows"), "mix-rows")
    sums = rows.groupBy("name", "bucket").agg(F.sum("size").alias("s"))
    earlier = Window.partitionBy("name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("name").alias("n0"), F.col("bucket").alias("b0"), F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("name", "bucket").orderBy("digest", "doc_id", "size", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(sums, F.col("name").eqNullSafe(F.col("n0")) & (F.col("bucket") == F.col("b0")))
    rows = rows.withColumn("start", F.col("start") + F.col("base")).withColumn("whole", F.floor("target"))

    def reading(e: int) -> Column:
        begin = F.col("start") + e * F.col("source_size")
        words = F.greatest(F.lit(0).cast("long"), F.least("size", F.col("whole") - begin))
        at = F.expr(position_sql(schedules, "number", f"((start + {e} * source_size) / target)"))
        return F.when(words > 0, F.struct(F.lit(e).alias("epoch"), words.alias("words"), at.alias("position")))

    epochs = F.filter(F.array(*[reading(e) for e in range(repeats)]), lambda x: x.isNotNull())
    taken = sum((F.greatest(F.lit(0).cast("long"), F.least("size", F.col("whole") - F.col("start") - e * F.col("source_size"))) for e in range(repeats)), F.lit(0).cast("long"))
    return rows.select("doc_id", "row_key", "size", "source_size", "target", taken.alias("taken"), epochs.alias("epochs"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The training order: docs' columns with mix_epoch, mix_words (how many of the text's words this reading takes; all
    but in a source's last one) and mix_position, one row for each reading, sorted by position over the whole
    result. Columns of docs that have these names are replaced."""
    new = ["mix_epoch", "mix_words", "mix_position"]
    plan = readings(docs, **options).select("row_key", F.explode("epochs").alias("reading"))
    plan = cut(plan.groupBy("row_key").agg(F.collect_list("reading").alias("readings"), F.countDistinct("reading.epoch").alias("k")), "mix-plan")
    rows = docs.select(F.xxhash64("doc_id", "text", "source").alias("row_key"), F.struct(*[docs[f"`{c}`"] for c in docs.columns if c not in new]).alias("row"))
    if plan.where(F.size("readings") > F.col("k")).head(1):  # repeated rows: each reading once, not each with each row
        rows = rows.groupBy("row_key").agg(F.first("row").alias("row"))
    out = rows.join(plan, "row_key").select("row", F.explode("readings").alias("reading"))
    reading = [F.col(f"reading.{c.removeprefix('mix_')}").alias(c) for c in new]
    return out.select("row.*", *reading).orderBy("mix_position", "doc_id", "mix_epoch")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    plan = readings(docs)
    return plan.select(
        "doc_id", "size", "source_size", "target", "taken", F.get("epochs", F.lit(0))["position"].alias("position")
    ).orderBy("position", "doc_id")


def oracle(schedules=SCHEDULES, repeats: int = REPEATS) -> str:
    weights = ", ".join(f"{integral(k)!r}" for k in schedules)
    at = position_sql(schedules, "number", "(start / target)")
    at = re.sub(r"(\d)D\b", r"\1::DOUBLE", at)  # Spark's mark of a double
    taken = " + ".join(f"greatest(0, least(size, floor(target)::BIGINT - start - {e} * source_size))" for e in range(repeats))
    return f"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
r AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(schedules)} AS number FROM p),
w AS (SELECT *, ([{weights}]::DOUBLE[])[number + 1] AS weight, source_size * {repeats} AS most FROM r),
q AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(most) OVER o, 0)::DOUBLE)
    / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0.0)) AS rate, row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS k
  FROM w WINDOW o AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(rate, k) AS rate, min(k) AS k FROM q WHERE rate <= most / weight),
t AS (SELECT source, number, source_size, CASE WHEN q.k < f.k THEN most::DOUBLE ELSE f.rate * weight END AS target FROM q, f),
d AS (SELECT doc_id, size, source_size, target, number, coalesce(sum(size) OVER (PARTITION BY s.source
    ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ({taken})::BIGINT AS taken,
  CASE WHEN least(size, floor(target)::BIGINT - start) > 0 THEN {at} END AS position
FROM d
"""


ORACLE = oracle()

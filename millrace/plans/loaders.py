"""Canned pipelines: the generic loader, the map-style loader over a sampler, and the cached loader."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from millrace.operators import batch, core, sample


def data_loader(
    df: DataFrame,
    order: Sequence[str],
    *,
    preprocess: Mapping[str, Column] | None = None,
    batch_size: int | None = None,
    item: str | None = None,
    drop_last: bool = False,
    aggregate: Mapping[str, Column] | None = None,
    transfer: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Source, preprocessing, batches, work on batches, transfer; steps that aren't given are left out."""
    out = core.pipe(df, preprocess) if preprocess else df
    if batch_size:
        if item is None:
            raise ValueError("batches need the column of their items")
        out = batch.batches(out, batch_size, order, F.col(item), drop_last=drop_last)
    out = core.pipe(out, aggregate) if aggregate else out
    return core.pipe(out, transfer) if transfer else out


def indexed_loader(
    df: DataFrame,
    order: Sequence[str],
    *,
    item: str,
    batch_size: int | None = 1,
    shuffle: bool = False,
    indices: Sequence[int] | None = None,
    batches: Sequence[Sequence[int]] | None = None,
    drop_last: bool = False,
    seed: int = 0,
) -> DataFrame:
    """Items of a map-style dataset by a sampler's indices, in batches. A sampler excludes shuffle; a batch sampler
    excludes batch_size, shuffle, sampler and drop_last; without batches, drop_last has no meaning."""
    if batches is not None:
        if batch_size not in (None, 1) or shuffle or indices is not None or drop_last:
            raise ValueError("a batch sampler excludes batch_size, shuffle, sampler and drop_last")
        rows = [(b, d, i) for b, members in enumerate(batches) for d, i in enumerate(members)]
        table = df.sparkSession.createDataFrame(rows, "batch_id long, draw_no long, pos long")
        got = sample.with_pos(df, order).join(table, "pos")
        items = F.array_sort(F.collect_list(F.struct("draw_no", F.col(item).alias("item"))))
        return got.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.transform(items, lambda x: x["item"]).alias("items"))
    if indices is not None and shuffle:
        raise ValueError("a sampler excludes shuffle")
    if batch_size is None and drop_last:
        raise ValueError("drop_last needs batches")
    if indices is None:
        n = df.count()
        indices = sample.permutation(n, seed) if shuffle else range(n)
    got = sample.take(df, order, list(indices)).drop("pos")
    if batch_size is None:
        return got
    return batch.batches(got, batch_size, ["draw_no"], F.col(item), drop_last=drop_last)


def cached_loader(batches_of: DataFrame, order: Sequence[str], num_caches: int, *, return_caches_after: int | None = None, stop_after: int) -> DataFrame:
    """A loader whose first batches are kept and given again."""
    return sample.cached(batches_of, order, num_caches, return_caches_after=return_caches_after, stop_after=stop_after)


def profile(stages: Mapping[str, DataFrame], concurrencies: Sequence[int] = (32, 16, 8, 4, 1), callback=None) -> list[dict]:
    """Rows a second of each stage's DataFrame alone, at several numbers of partitions."""
    import time

    out = []
    for name, df in stages.items():
        kept = df.persist()
        rows = kept.count()
        stats = []
        for c in concurrencies:
            began = time.monotonic()
            kept.repartition(c).write.format("noop").mode("overwrite").save()
            stats.append({"concurrency": c, "qps": rows / max(1e-9, time.monotonic() - began)})
        kept.unpersist()
        out.append({"name": name, "stats": stats})
        if callback:
            callback(out[-1])
    return out

"""A bounded sample of labelled documents, drawn by hash, the same in every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def held_out(doc_id: Column | str, folds: int) -> Column:
    """crc32 of doc_id as text, modulo folds, is 0. A null doc_id counts as an empty text."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def bounded(df: DataFrame, key: str, most: int, salt: int) -> DataFrame:
    """`most` rows of df, or all where there are no more: those whose key hashes lowest. Hashes fall into steps of about 1 %; as many of the lowest
    steps are taken as fit, and of the next one the rows that are left to take, in order of hash and columns, so that a key of any number of
    rows cuts nothing off. Collects the sizes of at most 4,096 steps. The same in every run."""
    place = F.xxhash64(key, F.lit(salt)).bitwiseAND(F.lit((1 << 62) - 1)) + 1
    step = F.floor(F.log2(place.cast("double")) * 64)
    taken, last, more = 0, -1, None
    for k, n in sorted(df.groupBy(step.alias("step")).count().collect()):
        if taken + n > most:
            more = k
            break
        taken, last = taken + n, k
    whole = df.where(step <= last)
    if more is None or taken == most:
        return whole
    return whole.unionByName(df.where(step == more).orderBy(place, *[f"`{c}`" for c in df.columns]).limit(most - taken))


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, most: dict[float, int]) -> DataFrame:
    """(doc_id, text, label) of at most most[v] labelled training documents for each label v, label a double.

    Ids are sampled first, at most sum(most) of them, which is the proven size of the broadcast; documents are read in
    place, and their texts are whole. One row for each id stays: where documents name an id twice, the smallest text
    holds, where labels name it twice, the largest label. Labels that `most` does not name, and null ones, are left out.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out("doc_id", folds))
    known = known.groupBy("doc_id").agg(F.max(F.col(label).cast("double")).alias("label"))
    ids = known.limit(0)
    for value, n in sorted(most.items()):
        ids = ids.unionByName(bounded(known.where(F.col("label") == F.lit(float(value))), "doc_id", n, 11))
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")

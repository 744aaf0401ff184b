"""N-gram Jaccard self-join: MinHash banding finds candidates, full n-gram sets verify them.

1. Documents of the same words in the same order form a class, represented once with its number of copies.
2. Each class gets `bands` hashes of `rows` minima of its n-grams; bands and rows follow from the recall wanted
   at the threshold. Shuffled on the band hashes, every bucket links its members to its smallest one.
3. Connected candidates are brought together with their n-gram sets, each set once; large groups are dealt
   into chunks, and only chunks that share a bucket meet (millrace.llm.units). All pairs in a unit are
   verified exactly, by products of incidence matrices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.graph import connected_components
from millrace.llm.store import cut, drop
from millrace.llm.units import LINKED, deal, linked_rows, with_units
from millrace.llm.words import byte_classes, find_words, mix, row_hashes, slices, windows

N_GRAM = 5
THRESHOLD = 0.8
RECALL = 0.999
CHUNK_ROWS = 256
CHUNK_WORDS = 400_000


def choose_bands(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows): as many rows a band as `most` hashes allow for this recall at the threshold, so that as few
    dissimilar pairs as possible become candidates."""
    best = None
    for rows in range(1, most + 1):
        miss = 1 - threshold**rows
        bands = int(np.ceil(np.log(1 - recall) / np.log(miss))) if miss < 1 else most + 1
        if bands * rows <= most:
            best = max(bands, 1), rows
    if best is None:
        raise ValueError("no number of bands reaches this recall")
    return best


def _signer(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = byte_classes("alnum")
        rng = np.random.default_rng(20240229)
        flip = rng.integers(1, 1 << 32, bands * rows, dtype=np.uint32)
        odd = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        for batch, column in slices(batches, "text"):
            words = find_words(column, classes)
            key = row_hashes(words, 0x9FB21C651E98DF25).astype(np.int64)
            runs, run_row = windows(words, n)
            have, start = np.unique(run_row, return_index=True)
            short = (runs >> np.uint64(32)).astype(np.uint32)
            out = np.zeros((len(have), bands), np.uint64)
            with np.errstate(over="ignore"):
                for k in range(bands * rows if len(have) else 0):
                    value = (short ^ flip[k]) * odd[k]
                    value ^= value >> np.uint32(15)
                    value *= np.uint32(0x2C1B3C6D)
                    least = np.minimum.reduceat(value, start).astype(np.uint64)
                    band = k // rows
                    out[:, band] = mix(out[:, band] * np.uint64(31) + least + np.uint64(k + 1))
            some = np.zeros(words.rows, bool)
            some[have] = True
            offsets = np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(key, pa.int64(), mask=~some),
                    pa.array(words.counts(), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel().astype(np.int64))),
                ],
                names=["doc_id", "row_key", "node", "n_words", "bands"],
            )

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = byte_classes("alnum")
        for batch, column in slices(batches, "text"):
            words = find_words(column, classes)
            runs, run_row = windows(words, n)
            order = np.lexsort([runs, run_row])
            runs, run_row = runs[order], run_row[order]
            if len(runs):
                new = np.concatenate([[True], (runs[1:] != runs[:-1]) | (run_row[1:] != run_row[:-1])])
                runs, run_row = runs[new], run_row[new]
            offsets = np.searchsorted(run_row, np.arange(words.rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("node")),
                    batch.column(batch.schema.get_field_index("chunk")),
                    batch.column(batch.schema.get_field_index("copies")),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(runs.astype(np.int64))),
                ],
                names=["node", "chunk", "copies", "grams"],
            )

    return run


def common_counts(flat: np.ndarray, sizes: np.ndarray, columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets (flat: their members, one set after the other)."""
    n = len(sizes)
    row = np.repeat(np.arange(n), sizes)
    _, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = counts[inverse] > 1
    number = np.cumsum(counts > 1) - 1
    col, row = number[inverse[shared]], row[shared]
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    both = np.zeros((n, n), np.float64)
    for at in range(0, int(col[-1]) + 1 if len(col) else 0, columns):
        low, high = np.searchsorted(col, [at, at + columns])
        part = np.zeros((n, columns), np.float32)
        part[row[low:high], col[low:high] - at] = 1
        both += part @ part.T
    return both


def _verifier(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("node")
        ids = table["node"].to_numpy()
        copies, side = table["copies"].to_numpy(), table["side"].to_numpy()
        grams = table["grams"].combine_chunks()
        if isinstance(grams, pa.ChunkedArray):
            grams = grams.chunk(0)
        sizes = np.diff(grams.offsets.to_numpy())
        both = common_counts(grams.flatten().to_numpy(), sizes)
        all_of = sizes[:, None] + sizes[None, :] - both
        link = np.triu(both >= threshold * all_of - 1e-9, 1)
        if side.any():
            link &= side[:, None] != side[None, :]
        a, b = np.nonzero(link)
        return pa.table(linked_rows(ids, copies, a, b))

    return run


def ngram_links(
    docs: DataFrame, *, n: int = N_GRAM, threshold: float = THRESHOLD, recall: float = RECALL
) -> DataFrame:
    """(doc_id, row_key, class_id, n_links, class_row) for each row of docs (doc_id, text; others are ignored).

    Two documents are linked if the Jaccard similarity of their sets of word n-grams is at least `threshold`.
    n_links counts the other rows linked to a row, copies included; class_id is the smallest doc_id reachable
    by links, class_row the row_key of the row that has it. A text of fewer than n words, but not none, is one
    n-gram of all its words; null texts and texts without words link with nothing and form a class of their own
    row. Rows with a null doc_id take part; a class of nothing else has a null class_id. Repeated rows
    are copies of each other. Links between different texts are found with probability `recall` at the threshold
    and more above it; links between equal texts always. Words are those of millrace.llm.words ('alnum'). Texts of any length are
    read whole, in pieces; an empty table gives an empty one.
    """
    bands, rows = choose_bands(threshold, recall)
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text")
    signed = cut(
        keyed.mapInArrow(_signer(n, bands, rows), "doc_id long, row_key long, node long, n_words long, bands array<long>"),
        "jaccard-signed",
    )
    # min() over structs puts nulls first; a known doc_id goes before an unknown one.
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    classes = cut(
        signed.where("node is not null")
        .groupBy("node")
        .agg(F.count(F.lit(1)).alias("copies"), F.min(rank).alias("rep"), F.min("row_key").alias("text_row"), F.first("n_words").alias("n_words"), F.first("bands").alias("bands")),
        "jaccard-classes",
    )
    members_of = classes.select("node", F.explode("bands").alias("band"))
    buckets = cut(
        members_of.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("band", "least"),
        "jaccard-buckets",
    )
    bucketed = cut(members_of.join(buckets.hint("merge"), "band"), "jaccard-bucketed")
    near = connected_components(bucketed.select(F.col("node").alias("a"), F.col("least").alias("b")), "jaccard-near")
    # Inside a candidate group, a chunk holds members that share their smallest bucket neighbour.
    first = bucketed.groupBy("node").agg(F.min("least").alias("first"))
    dealt = cut(
        deal(
            near.join(first, "node").join(classes.select("node", "copies", "text_row", "n_words"), "node").withColumn("one", F.lit(1)),
            ["root"],
            [("one", CHUNK_ROWS), ("n_words", CHUNK_WORDS)],
        )
        .withColumnRenamed("chunk", "small")
        .join(near.groupBy("root").agg(F.count(F.lit(1)).alias("group_rows")), "root"),
        "jaccard-dealt",
    )
    large = F.col("group_rows") > CHUNK_ROWS
    placed = cut(
        dealt.where(~large)
        .withColumn("chunk", F.col("small"))
        .unionByName(deal(dealt.where(large), ["root", "first"], [("one", CHUNK_ROWS), ("n_words", CHUNK_WORDS)]))
        .select("node", "chunk", "copies", "text_row"),
        "jaccard-placed",
    )
    seen = bucketed.join(placed.select("node", "chunk"), "node").select("band", "chunk").distinct()
    pairs = (
        seen.withColumnRenamed("chunk", "c1")
        .join(seen.withColumnRenamed("chunk", "c2"), "band")
        .where("c1 < c2")
        .select("c1", "c2")
        .distinct()
    )
    units = cut(with_units(placed.select("chunk").distinct(), pairs), "jaccard-units")
    texts = (
        keyed.join(placed.withColumnRenamed("text_row", "row_key").hint("merge"), "row_key")
        .select("node", "chunk", "copies", "text")
        .mapInArrow(_sets(n), "node long, chunk long, copies long, grams array<long>")
    )
    sets = cut(texts, "jaccard-sets")
    once = sets.dropDuplicates(["node"]) if _repeats(sets) else sets
    linked = cut(
        units.join(once, "chunk").drop("chunk").groupBy("unit").applyInArrow(_verifier(threshold), LINKED), "jaccard-linked"
    )
    drop(sets, units, placed, dealt, bucketed, buckets)
    roots = connected_components(linked.select(F.col("node").alias("a"), F.col("other").alias("b")), "jaccard-class")
    full = (
        classes.select("node", "copies", "rep")
        .join(linked.groupBy("node").agg(F.sum("n").alias("n")), "node", "left")
        .join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    named = full.groupBy("root").agg(F.min("rep").alias("first"))
    table = cut(
        full.join(named, "root").select(
            "node",
            F.col("first.doc_id").alias("class_id"),
            F.col("first.row_key").alias("class_row"),
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        ),
        "jaccard-table",
    )
    drop(classes, linked)
    known = F.col("node").isNotNull()
    return (
        signed.select("doc_id", "row_key", "node")
        .join(table, "node", "left")
        .select(
            "doc_id",
            "row_key",
            F.when(known, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
            F.when(known, F.col("class_row")).otherwise(F.col("row_key")).alias("class_row"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        )
    )


def _repeats(sets: DataFrame) -> bool:
    """Are there repeated rows in the corpus, which bring the set of a class more than once?"""
    return bool(sets.groupBy("node").count().where("count > 1").head(1))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, unchanged, of which one stays from each group of linked ones: that with the smallest doc_id."""
    links = cut(ngram_links(docs, **options), "jaccard-links")
    keep = links.where("row_key = class_row").select("row_key")
    repeated = bool(keep.groupBy("row_key").count().where("count > 1").head(1))
    key = F.xxhash64(docs["doc_id"], docs["text"])
    rows = docs.select(key.alias("row_key"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    kept = rows.join(keep.distinct() if repeated else keep, "row_key", "left_semi")
    if repeated:
        kept = kept.groupBy("row_key").agg(F.first("row").alias("row"))
    return kept.select("row.*")


def op2_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return ngram_links(docs).select("doc_id", "class_id", "n_links", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))

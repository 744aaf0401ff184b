"""Tables of files, lines and image listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from millrace.functions.filters import wnid
from millrace.operators.core import lookup


def directory(spark: SparkSession, root: str, pattern: str = "*", *, content: bool = False) -> DataFrame:
    """(path, length[, content]) of the files under root whose name matches the pattern, in order of path.

    A pattern with '**/' looks in all folders below. Without content only names are listed.
    """
    deep = pattern.startswith("**/")
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern.removeprefix("**/")).option("recursiveFileLookup", str(deep).lower())
    return reader.load(root).select("path", "length", *(["content"] if content else [])).orderBy("path")


def json_lines(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Records of JSON lines; blank lines are skipped, and columns path and line keep the order of lines within a file.

    Files are read by blocks, so their size has no limit. Lines are numbered inside their block, and shifted by the counts of the
    blocks before it in the same file.
    """
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_seq"))
    counts = lines.groupBy("path", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("path", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("path", "_block").orderBy("_seq")
    numbered = lines.withColumn("_at", F.row_number().over(inside) - 1).join(shift, ["path", "_block"])
    numbered = numbered.select("path", (F.col("_at") + F.col("_shift")).alias("line"), F.trim("value").alias("text")).where("text != ''")
    return numbered.select("path", "line", F.from_json("text", schema).alias("r")).select("path", "line", "r.*")


def image_listing(paths: DataFrame, classes: DataFrame, path: str = "path") -> DataFrame:
    """(path, class_id) of images by the class id in their path; classes is (wnid, class_id)."""
    return lookup(paths.withColumn("_wnid", wnid(F.col(path))), "_wnid", classes, "wnid", "class_id").drop("_wnid")


def split_pattern(split: str) -> str:
    if split not in ("train", "val"):
        raise ValueError("the split must be 'train' or 'val'")
    return f"{split}/*/*.JPEG"


def json_field(column: Column, name: str) -> Column:
    return F.get_json_object(column, f"$.{name}")

"""Continuous sources with numbered epochs: a table that is read over and over, and several sources that wait for each other.

A stream of this kind is a stream of names: for every epoch, the pieces (row groups of Parquet files) that make it up, one epoch in each micro-batch.
The executors read the pieces. The offset in the stream's checkpoint is the number of the next epoch, so a query that is started again goes on
with the epoch that was not finished, and one that failed in the middle of an epoch repeats that epoch as a whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

FORMAT = "millrace_epochs"
_PIECE = "epoch long, source int, piece int, path string, row_group int"


def _located(path: str):
    from pyarrow import fs

    uri = path if "://" in path else f"file:{path.removeprefix('file:')}" if path.startswith("file:") else f"file://{path}"
    return fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def _pieces(folder: str) -> list[tuple[str, int]]:
    """(path, row group) of the Parquet files in a folder, or of a single file, in order of path."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, root = _located(folder)
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        files = [root]
    elif info.type == fs.FileType.Directory:
        hidden = lambda p: any(x[:1] in "._" for x in p[len(root) :].strip("/").split("/"))
        files = sorted(f.path for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File and not hidden(f.path))
    else:
        raise FileNotFoundError(folder)
    scheme = folder.split("://")[0] if "://" in folder else "file"
    return [(f"{scheme}://{path}", g) for path in files for g in range(pq.ParquetFile(system.open_input_file(path)).num_row_groups)]


def _there(folder: str) -> bool:
    from pyarrow import fs

    system, root = _located(folder)
    return system.get_file_info(f"{root}/_SUCCESS").type == fs.FileType.File


class _Epochs(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.folders = json.loads(options["folders"])
        self.live = options.get("live", "false") == "true"
        self.most = int(options["epochs"]) if "epochs" in options else None

    def initialOffset(self) -> dict:
        return {"epoch": 0}

    def _folders(self, epoch: int) -> list[str] | None:
        """The folders of an epoch, one for each source; None while one of them isn't complete."""
        if self.most is not None and epoch >= self.most:
            return None
        if not self.live:
            return self.folders
        parts = [f"{f.rstrip('/')}/epoch={epoch}" for f in self.folders]
        return parts if all(map(_there, parts)) else None

    def _rows(self, epoch: int) -> list[tuple]:
        folders = self._folders(epoch)
        return [] if folders is None else [(epoch, s, k, path, g) for s, folder in enumerate(folders) for k, (path, g) in enumerate(_pieces(folder))]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        epoch = start["epoch"]
        if self._folders(epoch) is None:
            return iter(()), start
        # An epoch without a row group still counts, and its end is passed on by its number.
        return iter(self._rows(epoch)), {"epoch": epoch + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for epoch in range(start["epoch"], end["epoch"]):
            yield from self._rows(epoch)


class EpochSource(DataSource):
    """The stream of pieces. Options: folders, a list as JSON; live, whether epochs are subfolders epoch=0, epoch=1, .. that appear while the stream
    runs; epochs, after how many it has no more."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return _PIECE

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Epochs(self.options)


def _read(schema: StructType):
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for batch in batches:
            for r in batch.to_pylist():
                system, path = _located(r["path"])
                with system.open_input_file(path) as f:
                    at = 0
                    for rows in pq.ParquetFile(f).iter_batches(row_groups=[r["row_group"]], columns=[x.name for x in schema.fields[4:]]):
                        n = rows.num_rows
                        fixed = [pa.array([r["epoch"]] * n, pa.int64()), pa.array([r["source"]] * n, pa.int32()), pa.array([r["piece"]] * n, pa.int32()), pa.array(range(at, at + n), pa.int64())]
                        columns = [rows.column(x.name).cast(arrow.field(x.name).type) for x in schema.fields[4:]]
                        yield pa.RecordBatch.from_arrays([*fixed, *columns], schema=arrow)
                        at += n

    return run


#: Columns by which the items of an epoch are in order within their source.
ORDER = ("piece", "row")


def _stream(spark: SparkSession, folders: Sequence[str], columns: StructType, live: bool, epochs: int | None) -> DataFrame:
    spark.dataSource.register(EpochSource)
    reader = spark.readStream.format(FORMAT).option("folders", json.dumps(list(folders))).option("live", str(live).lower())
    pieces = (reader if epochs is None else reader.option("epochs", str(epochs))).load()
    own = [StructField("epoch", LongType()), StructField("source", IntegerType()), StructField("piece", IntegerType()), StructField("row", LongType())]
    schema = StructType([*own, *columns.fields])
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return pieces.repartition(tasks, F.xxhash64("path", "row_group")).mapInArrow(_read(schema), schema)


def _columns(spark: SparkSession, schema: str | StructType) -> StructType:
    out = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    taken = {"epoch", "source", *ORDER} & set(out.names)
    if taken:
        raise ValueError(f"columns of these names are the stream's own: {sorted(taken)}")
    return out


def replayed(spark: SparkSession, folder: str, schema: str | StructType, *, epochs: int | None = None) -> DataFrame:
    """A table of Parquet files as a stream that goes through it again and again: (epoch, source, piece, row, *schema), one epoch to a micro-batch, without
    end or up to `epochs` of them. Files are listed anew for each epoch, so what is added counts from the next one on."""
    return _stream(spark, [folder], _columns(spark, schema), False, epochs)


def aligned(spark: SparkSession, folders: Sequence[str], schema: str | StructType, *, epochs: int | None = None) -> DataFrame:
    """Several continuous sources as one stream with a barrier between epochs: items of epoch e + 1 come only when all sources have ended epoch e.

    A source is a folder to which epochs are added as subfolders epoch=0, epoch=1, .., each complete once it has the _SUCCESS file that Spark's writers
    leave. A micro-batch is one epoch of all sources: it starts when the last of them is complete. Nothing is buffered meanwhile; what
    faster sources have written waits where it is.
    """
    if not folders:
        raise ValueError("there must be a source")
    return _stream(spark, folders, _columns(spark, schema), True, epochs)


def run_epochs(stream: DataFrame, each, checkpoint: str) -> int:
    """Runs each(df, epoch) on all epochs that are there, in order, then returns the number of the last micro-batch, -1 without one. An epoch that a
    former run didn't finish comes again, as a whole and with its number; the number is the micro-batch's, and that of the column epoch."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
        progress = query.lastProgress
    finally:
        query.stop()
    return -1 if progress is None else progress["batchId"]

"""WARC 1.1: a writer that deduplicates payloads with revisit records, and a sequential streaming reader.

Archives are .warc.gz files in the shared folder: one gzip member for each record, so that a reader can start at
any record. The reader inflates piece by piece and frames a record by its Content-Length, so its memory is that of
the longest header plus one piece, not of an archive; it verifies block and payload digests while it reads.

A writing task names its archives by a fresh id, and only archives of tasks that succeeded are listed in the
table that write_warc() returns; what a lost executor left half written is never read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.store import cut, new_path

ROLL_BYTES = 64 << 20
PIECE = 1 << 16
MOST_HEADER = 1 << 20
_DATE = "2024-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive that isn't framed as it says, or whose content doesn't match its digest."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


# -- writing -----------------------------------------------------------------------------------------------


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + head.encode("utf-8") + b"\r\n") + packer.compress(block + b"\r\n\r\n") + packer.flush()


def _urn(page_id) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response record with an HTTP message around the payload, or a revisit record with its HTTP head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode("ascii")
    block = head if revisit else head + payload
    uri = "".join(c for c in (url or "") if c > " ") or "about:blank"
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _urn(page_id)),
        ("WARC-Date", _DATE),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _urn(refers_to))]
    return _record(fields, block)


def _info(name: str) -> bytes:
    block = b"software: millrace\r\nformat: WARC File Format 1.1\r\n"
    return _record(
        [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", _DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], block
    )


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _writer(folder: str, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _filesystem(folder)
        out = None
        written = []

        def close():
            nonlocal out
            if out is not None:
                out.close()
                written.append((name, count, size))
                out = None

        for batch in batches:
            for page_id, url, html, first, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, count, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    system.create_dir(root, recursive=True)
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(head := _info(name))
                    size += len(head)
                record = page_record(page_id, url, (html or "").encode("utf-8"), first, revisit)
                out.write(record)
                count, size = count + 1, size + len(record)
                if size >= roll:
                    close()
        close()
        yield pa.RecordBatch.from_pydict(
            {"path": [f"{folder}/{w[0]}" for w in written], "records": [w[1] for w in written], "bytes": [w[2] for w in written]},
            schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]),
        )

    return run


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to, revisit): of the rows whose payloads are equal and of at least `least_bytes`,
    that with the smallest page_id is a response, others revisit it.

    Null html is an empty payload; payloads of any length are compared whole, by SHA-256. Other columns are left out, so their names
    can't clash. Null page_ids are never referred to while a payload has a known one; rows
    that repeat the smallest page_id are all responses, and so are rows that share a payload under null ids only.
    """
    html = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("same"))
    narrow = keyed.where(F.octet_length("html") >= least_bytes).select("page_id", "same")  # no payload is shuffled to find its equals
    firsts = cut(
        narrow.groupBy("same").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("same", "first"),
        "warc-firsts",
    )
    revisits = narrow.join(firsts, "same").where(~F.col("page_id").eqNullSafe(F.col("first"))).distinct()
    revisits = revisits.select(F.col("same").alias("_same"), F.col("page_id").alias("_page"), "first")
    # Rows meet theirs by page and payload, so that a payload shared by many pages isn't one key.
    joined = keyed.join(revisits, (F.col("same") == F.col("_same")) & F.col("page_id").eqNullSafe(F.col("_page")), "left")
    return joined.select("page_id", "url", "html", F.col("first").alias("refers_to"), F.col("first").isNotNull().alias("revisit"))


def write_warc(pages: DataFrame, folder: str | None = None, *, least_bytes: int = 0, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html) and return the table of archives (path, records, bytes).

    The folder is one that all executors reach, by default a new one in the shared folder. Archives are closed at
    about roll_bytes. A table without rows gives no archive.
    """
    folder = folder or new_path(pages.sparkSession, "warc")
    return cut(
        with_revisits(pages, least_bytes).mapInArrow(_writer(folder, roll_bytes), "path string, records long, bytes long"), "warc-archives"
    )


# -- reading -----------------------------------------------------------------------------------------------


class _Inflater:
    """The content of a file of gzip members as one stream that knows where members end."""

    def __init__(self, source: BinaryIO):
        self.source, self.raw, self.have, self.member, self.ended = source, b"", b"", None, False

    def _more(self) -> bool:
        """Inflate a piece; False at the end of the member or file."""
        if self.member is None:
            self.raw = self.raw or self.source.read(PIECE)
            if not self.raw:
                return False
            self.member = zlib.decompressobj(31)
        if not self.raw:
            self.raw = self.source.read(PIECE)
            if not self.raw:
                raise WarcError("the archive ends inside a gzip member")
        try:
            self.have += self.member.decompress(self.raw, PIECE)
        except zlib.error as e:
            raise WarcError(f"broken gzip member: {e}") from e
        self.raw = self.member.unconsumed_tail
        if self.member.eof:
            self.raw, self.member = self.member.unused_data, None
            return False
        return True

    def start(self) -> bool:
        """Is there another member? The one before must be read to its end."""
        if self.have or self.member is not None:
            raise WarcError("a gzip member holds more than one record")
        self._at_end = False
        if not self.raw:
            self.raw = self.source.read(PIECE)
        return bool(self.raw)

    def until(self, mark: bytes, most: int) -> bytes:
        seen = 0
        while (at := self.have.find(mark, max(0, seen - len(mark)))) < 0:
            if self._at_end or len(self.have) > most:
                raise WarcError("no end of a record's header")
            seen = len(self.have)
            self._at_end = not self._more()
        out, self.have = self.have[:at], self.have[at + len(mark) :]
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.have:
                if self._at_end:
                    raise WarcError("a record is shorter than its Content-Length")
                self._at_end = not self._more()
                continue
            part, self.have = self.have[:n], self.have[n:]
            n -= len(part)
            yield part

    def finish(self) -> None:
        if b"".join(self.pieces(4)) != b"\r\n\r\n":
            raise WarcError("a record isn't closed where its Content-Length says")
        while not self._at_end:
            self._at_end = not self._more()


def _fields(head: bytes) -> dict[str, str]:
    """Named fields by lower-case name; folded lines are joined."""
    out: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            k, v = line.split(":", 1)
            last = k.strip().lower()
            out[last] = v.strip()
    return out


def read_records(source: BinaryIO, keep_payload: bool = True) -> Iterator[dict]:
    """The records of one archive in order: fields, http (fields of the HTTP head), payload, payload_bytes, payload_digest.

    The digest is computed from the bytes read, and verified against the record's own; a revisit record has the
    length and digest that it declares. Without keep_payload, payload is None and memory stays at a piece.
    """
    stream = _Inflater(source)
    while stream.start():
        head = stream.until(b"\r\n\r\n", MOST_HEADER)
        version, _, rest = head.partition(b"\r\n")
        if not version.startswith(b"WARC/"):
            raise WarcError("not a WARC record")
        fields = _fields(rest)
        try:
            length = int(fields["content-length"])
        except (KeyError, ValueError) as e:
            raise WarcError("a record without a valid Content-Length") from e
        block_sum, payload_sum = hashlib.sha1(), hashlib.sha1()
        http_head, parts, size = b"", [], 0
        in_head = fields.get("content-type", "").startswith("application/http")
        for part in stream.pieces(length):
            block_sum.update(part)
            if in_head:
                http_head += part
                at = http_head.find(b"\r\n\r\n")
                if at < 0:
                    continue
                http_head, part, in_head = http_head[:at], http_head[at + 4 :], False
            payload_sum.update(part)
            size += len(part)
            if keep_payload:
                parts.append(part)
        stream.finish()
        http = _fields(http_head.partition(b"\r\n")[2])
        declared = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        digest = base64.b32encode(payload_sum.digest()).decode("ascii")
        block = fields.get("warc-block-digest", "").removeprefix("sha1:")
        if block and block != base64.b32encode(block_sum.digest()).decode("ascii"):
            raise WarcError(f"block digest of {fields.get('warc-record-id')} doesn't match")
        if fields.get("warc-type") == "revisit":
            digest, size = declared, int(http.get("content-length", 0))
        elif declared and declared != digest:
            raise WarcError(f"payload digest of {fields.get('warc-record-id')} doesn't match")
        yield {"fields": fields, "http": http, "payload": b"".join(parts) if keep_payload else None, "payload_bytes": size, "payload_digest": digest}


def _reader(keep_payload: bool):
    names = ["record_id", "record_type", "target_uri", "payload", "payload_bytes", "payload_digest", "refers_to"]

    def rows(path: str) -> Iterator[tuple]:
        system, inner = _filesystem(path)
        with system.open_input_stream(inner, compression=None) as source:
            for r in read_records(source, keep_payload):
                f = r["fields"]
                yield f.get("warc-record-id"), f.get("warc-type"), f.get("warc-target-uri"), r["payload"], r["payload_bytes"], r["payload_digest"], f.get("warc-refers-to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(list(zip(names, [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string()], strict=True)))
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held, size = [], 0
                for row in rows(path):
                    held.append(row)
                    size += 200 + len(row[3] or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*held, strict=True), strict=True)), schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*held, strict=True), strict=True)), schema=schema)

    return run


def read_warc(archives: DataFrame, *, keep_payload: bool = True) -> DataFrame:
    """Records of the archives named in column path: record_id, record_type, target_uri, payload, payload_bytes,
    payload_digest, refers_to. Each archive is read in sequence by one task; archives are dealt over the tasks."""
    spark = archives.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("path").repartition(tasks, "path").mapInArrow(
        _reader(keep_payload),
        "record_id string, record_type string, target_uri string, payload binary, payload_bytes long, payload_digest string, refers_to string",
    )


def op3_warc(spark, sf_dir: str) -> DataFrame:
    archives = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    records = read_warc(archives, keep_payload=False).where("record_type in ('response', 'revisit')")
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]+)>$', 1) as bigint)")
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


ORACLE = """
WITH h AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
x AS (SELECT page_id, body, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS hex, min(page_id) OVER (PARTITION BY body) AS first FROM h),
bits AS (SELECT *, list_transform(range(1, 41), lambda i: strpos('0123456789abcdef', hex[i]) - 1) AS d FROM x),
n AS (SELECT *, list_transform(range(0, 32), lambda i: (
  (d[(i * 5) // 4 + 1] * 16 + coalesce(d[(i * 5) // 4 + 2], 0)) // CAST(pow(2, 3 - (i * 5) % 4) AS BIGINT)) % 32) AS v FROM bits)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(v, lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[k + 1]), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM n
"""

"""Deterministic sharded WARC writer and its reader.

1. A narrow table of (page_id, payload digest, size) gives the revisits:
   of records with equal payloads the one with the largest page_id carries it. Only
   digests meet there; the table of repeated payloads is written first, so both
   sides of the join back are plain exchanges that adaptive execution can split.
2. Shards are ranges of (page_id, digest) cut by a histogram of bytes, refined
   where a bin is too heavy (and, inside a single page_id, by digest), so their
   contents depend on the rows alone and not on partitions or sampling.
3. Pages move once, to their shard, and are sorted there. A task writes its
   shard's records in order, one gzip member each, and starts another
   file at the roll size. Headers, record ids and digests are made anew from the content.
4. Files get temporary names. The task's rows name them; only when all tasks are
   done are those files renamed, and then the manifest is written. A task that
   is run again leaves temporary files that no manifest names. Renaming twice is harmless.
5. The reader opens the manifest's files and checks every payload against its digest.

Edge cases: null html is an empty payload; a null page_id sorts first, has no
page header and refers to nothing; rows that repeat are written in turn, the
first as the response and the others as revisits of it; a null url leaves out
the target; line breaks and control characters in a url are percent-encoded; a record larger than the
roll size has a file to itself; an empty table gives an empty manifest and no
records; other columns are ignored.
"""
from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import constant_array, shared_path, shipped, stored

#: Payload bytes of a shard (one task) and compressed bytes at which a file is closed.
SHARD_BYTES = 32 << 20
ROLL_BYTES = 16 << 20
RECORD_BYTES = 512
BINS = 4096
LEVEL = 4
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
LEAST_ID = -2 ** 63
MANIFEST = "shard int, part int, name string, temporary string, records bigint, bytes bigint, sha256 string"


def _order_id() -> Column:
    return F.coalesce(F.col("page_id").cast("bigint"), F.lit(LEAST_ID))


class Shards:
    """Ranges of (page_id, digest) with about ``shard_bytes`` each, from histograms of at most ``BINS`` rows."""

    def __init__(self, keys: DataFrame, shard_bytes: int):
        self.count, self.room, self.limit, self.keys = 0, 0, shard_bytes, keys
        low, high = keys.agg(F.min("id"), F.max("id")).first()
        self.column = F.lit(0) if low is None else self._cut(keys, low, high)
        self.count += 1

    def _place(self, size: int) -> int:
        if self.room + size > self.limit and self.room:
            self.count, self.room = self.count + 1, 0
        self.room += size
        return self.count

    def _cut(self, keys: DataFrame, low: int, high: int) -> Column:
        """The shard of a row whose id lies in [low, high], as an expression on (id, digest)."""
        if low == high:
            position = F.conv(F.substring(F.hex("digest"), 1, 3), 16, 10).cast("int")
            width, bins = 1, BINS
        else:
            width = -(-(high - low + 1) // BINS)
            wide = "decimal(20,0)"  # a span of ids may not fit a long
            position = F.floor((F.col("id").cast(wide) - F.lit(str(low)).cast(wide)) / F.lit(str(width)).cast(wide)).cast("int")
            bins = -(-(high - low + 1) // width)
        held = {r.bin: r.bytes for r in keys.groupBy(position.alias("bin")).agg(F.sum("bytes").alias("bytes")).collect()}
        shards, deeper = [0] * bins, []
        for b in range(bins):
            if held.get(b, 0) > self.limit and low != high:
                first = low + b * width
                last = min(high, first + width - 1)
                inside = keys.where(F.col("id").between(first, last))
                deeper.append((b, self._cut(inside, first, last)))
            else:
                shards[b] = self._place(held.get(b, 0))
        column = F.get(constant_array(shards, "int"), position)
        for b, inner in deeper:
            column = F.when(position == b, inner).otherwise(column)
        return column


def _uri(text: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, revisit: bool, refers_to: int | None) -> bytes:
    """One WARC record, headers and digests made from the content."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}:{digest}:revisit')}>" if revisit else record_id(page_id, digest)
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", _uri(url)))
    head.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    head.append(("WARC-Block-Digest", f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"))
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest))]
        if refers_to is not None:
            head.append(("X-Refers-To-Page-ID", str(refers_to)))
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _store(path: str):
    from pyarrow import fs
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path if not path.startswith("file:/") or path.startswith("file://") else "file://" + path[5:])


class _ShardFiles:
    """The files of one shard: temporary names, closed at the roll size."""

    def __init__(self, folder: str, shard: int, roll_bytes: int):
        self.store, self.folder = _store(folder)
        self.shard, self.roll, self.attempt = shard, roll_bytes, uuid.uuid4().hex
        self.out, self.part, self.rows = None, 0, []

    def write(self, data: bytes) -> None:
        member = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        data = member.compress(data) + member.flush()
        if self.out is not None and self.size + len(data) > self.roll:
            self.close()
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.part:04d}.warc.gz"
            self.temporary = f"_temporary/{self.name}.{self.attempt}"
            self.store.create_dir(f"{self.folder}/_temporary", recursive=True)
            self.out = self.store.open_output_stream(f"{self.folder}/{self.temporary}", compression=None)
            self.size, self.records, self.digest = 0, 0, hashlib.sha256()
        self.out.write(data)
        self.digest.update(data)
        self.size, self.records = self.size + len(data), self.records + 1

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.rows.append((self.shard, self.part, self.name, self.temporary, self.records, self.size, self.digest.hexdigest()))
            self.out, self.part = None, self.part + 1


def _manifest_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    names = [c.split()[0] for c in MANIFEST.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def write_archive(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES,
                  least_revisit: int = 0) -> DataFrame:
    """Write (page_id, url, html) rows as WARC files into ``folder`` and return the manifest."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", html.alias("html"))
    digest = F.unhex(F.sha1(F.col("html").cast("binary"))).alias("digest")
    keys = stored(rows.select(_order_id().alias("id"), digest, F.octet_length("html").alias("n")), "warc-keys")
    shards = Shards(keys.select("id", "digest", (F.col("n") + RECORD_BYTES).cast("bigint").alias("bytes")), shard_bytes)
    repeated = stored(keys.where(F.col("n") >= least_revisit).groupBy("digest").agg(
        F.max("id").alias("keeper"), F.min("id").alias("least")).where("keeper != least").select("digest", "keeper"), "repeated-payloads")
    marks = keys.join(repeated, "digest").where("id != keeper").select("id", "digest", "keeper").distinct()
    blank = F.lit(None).cast("string")
    both = rows.select(_order_id().alias("id"), digest, "url", "html", F.lit(None).cast("bigint").alias("keeper")).unionByName(
        marks.select("id", "digest", blank.alias("url"), blank.alias("html"), "keeper"))
    placed = both.withColumn("shard", shards.column).repartition(shards.count, "shard").sortWithinPartitions(
        "shard", "id", "digest", F.col("keeper").isNull(), "url")

    def run(batches: Iterator[pa.RecordBatch]):
        files, last, keeper = None, None, None
        for batch in batches:
            for number, sha1, url, text, mark, shard in zip(*batch.columns, strict=True):
                number, sha1, mark, shard = number.as_py(), sha1.as_py(), mark.as_py(), shard.as_py()
                if files is None or files.shard != shard:
                    if files is not None:
                        files.close()
                        yield _manifest_batch(files.rows)
                    files = _ShardFiles(folder, shard, roll_bytes)
                if mark is not None:  # the next rows with this id and payload revisit the keeper
                    last, keeper = (number, sha1), mark
                    continue
                payload = text.as_py().encode()
                page = None if number == LEAST_ID else number
                revisit = last == (number, sha1) and (keeper is not None or len(payload) >= least_revisit)
                refers = (number if keeper is None else keeper) if revisit else None
                files.write(record(page, url.as_py(), payload, base64.b32encode(sha1).decode(), revisit,
                                   None if refers == LEAST_ID else refers))
                if last != (number, sha1):
                    last, keeper = (number, sha1), None
        if files is not None:
            files.close()
            if files.rows:
                yield _manifest_batch(files.rows)
    written = stored(shipped(placed.select("id", "digest", "url", "html", "keeper", "shard")).mapInArrow(run, MANIFEST), "warc-written")

    def rename(batches: Iterator[pa.RecordBatch]):
        from pyarrow import fs
        store, base = _store(folder)
        for batch in batches:
            for name, temporary in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if store.get_file_info(f"{base}/{temporary}").type == fs.FileType.File:  # else done by an earlier attempt
                    store.move(f"{base}/{temporary}", f"{base}/{name}")
            yield batch
    manifest = f"{folder}/manifest"
    written.mapInArrow(rename, MANIFEST).drop("temporary").write.parquet(manifest)
    return pages.sparkSession.read.parquet(manifest)


def _records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record of one file."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data)), 1 << 16)
    while stream.readline():  # the version line
        head = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(":")
            head[name.lower()] = value.strip()
        yield head, stream.read(int(head["content-length"]))
        stream.read(4)


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of every record the manifest names."""
    files = spark.read.parquet(f"{folder}/manifest").select("name", "sha256")
    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def number(text: str | None) -> int | None:
        return None if text is None else int(text)

    def run(batches: Iterator[pa.RecordBatch]):
        store, base = _store(folder)
        for batch in batches:
            for name, expected in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_stream(f"{base}/{name}", compression=None) as f:
                    data = f.read()
                if hashlib.sha256(data).hexdigest() != expected:
                    raise OSError(f"{name} differs from its manifest entry")
                out, size = [], 0
                for head, block in _records(data):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = int(http.rpartition(b"Content-Length: ")[2])
                    digest, kind = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"]
                    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise OSError(f"a payload in {name} differs from its digest")
                    out.append((number(head.get("x-page-id")), head.get("warc-target-uri"), length, digest, kind,
                                number(head.get("x-refers-to-page-id")), payload if kind == "response" else None))
                    size += len(block)
                    if size >= 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
    n = max(1, files.count())
    return shipped(files.repartition(n, "name")).mapInArrow(run, schema)


def write_and_read(pages: DataFrame) -> DataFrame:
    """Write an archive in the shared folder and read its records back."""
    spark = pages.sparkSession
    folder = shared_path(spark, "warc")
    write_archive(pages, folder)
    return read_archive(spark, folder)

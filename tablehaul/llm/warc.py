"""A deterministic, sharded WARC writer and its reader.

Records are sorted by page id into ranges whose limits follow from the ids alone. Each range is written in files that roll
over at a compressed size, every record as a gzip member of its own with new headers and digests. A file is written under a
temporary name and renamed when it is whole; a retried task writes the same bytes under the same final name. The manifest,
committed by Spark when all files are there, lists the files that count; readers open no others.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablehaul.llm.ranges import limits

DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: Raw payload bytes of a range, and compressed bytes after which a file is closed. There are ``MOST_RANGES`` at most; larger
#: ranges only have more files.
RANGE_BYTES, FILE_BYTES, MOST_RANGES = 16 << 20, 4 << 20, 10_000
LEVEL = 4
MANIFEST = "shard int, name string, records long, bytes long, sha256 string"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def place_of(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "/", folder))


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id} {digest}')}>"


def one_line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), *headers, ("WARC-Date", DATE), ("WARC-Block-Digest", f"sha1:{sha1(block)}"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member; its header carries no time, so equal records give equal bytes."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, first_id: int | None, is_first: bool) -> bytes:
    digest = sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [
        ("WARC-Target-URI", one_line(url) if url else f"urn:page:{page_id}"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    if is_first:
        return record("response", headers, http + payload)
    headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first_id, digest))]
    if first_id is not None:
        headers.append(("X-Refers-To-Page-Id", str(first_id)))
    return record("revisit", headers, http)


class Roller:
    """Writes the files of one range."""

    def __init__(self, folder: str, shard: int, file_bytes: int) -> None:
        self.fs, self.folder = place_of(folder)
        self.shard, self.file_bytes, self.roll, self.sink, self.done = shard, file_bytes, 0, None, []

    def add(self, data: bytes) -> None:
        packed = member(data)
        if self.sink is None:
            self.name = f"{self.shard:06d}-{self.roll:05d}.warc.gz"
            self.temporary = f"{self.folder}/_temporary-{uuid.uuid4().hex}-{self.name}"
            self.sink, self.size, self.records, self.sum = self.fs.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256()
            self.put(member(record("warcinfo", [("WARC-Record-ID", record_id(None, self.name)), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")))
        self.put(packed)
        self.records += 1
        if self.size >= self.file_bytes:
            self.close()

    def put(self, data: bytes) -> None:
        self.sink.write(data)
        self.sum.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.sink is None:
            return
        self.sink.close()
        self.sink = None
        final = f"{self.folder}/{self.name}"
        if self.fs.get_file_info(final).type == pafs.FileType.NotFound:
            self.fs.move(self.temporary, final)
        else:  # an earlier attempt of this task was first, with the same bytes
            self.fs.delete_file(self.temporary)
        self.done.append((self.shard, self.name, self.records, self.size, self.sum.hexdigest()))
        self.roll += 1


def write(pages: DataFrame, folder: str, least_bytes: int = 0, range_bytes: int = RANGE_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes ``page_id``, ``url``, ``html`` as WARC files below ``folder`` and returns the committed manifest.

    Of payloads of at least ``least_bytes`` bytes that are equal, that of the smallest page id (null if there is no other) is
    a response and the others revisit it; among repeated rows of that id one is the response. Null html is an empty payload,
    a null url becomes a urn. An empty table gives an empty manifest. Other columns are ignored.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("html")))
    narrow = rows.select("page_id", "digest", F.octet_length("html").alias("size"))
    total = narrow.agg(F.sum("size")).first()[0] or 0
    cuts = np.array([c[0] for c in limits(narrow, ["page_id"], F.xxhash64("page_id"), min(MOST_RANGES, -(-total // range_bytes)))], np.int64)

    @F.pandas_udf("int")
    def shard_of(page_id: pd.Series) -> pd.Series:
        ids = page_id.fillna(-(2**63)).astype("int64").to_numpy()
        return pd.Series(np.searchsorted(cuts, ids, side="right").astype("int32"))

    firsts = (
        narrow.filter(F.col("size") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    )
    known = narrow.select("page_id", "digest").distinct().join(firsts, "digest")
    empty = lambda kind: F.lit(None).cast(kind)
    first_rows = known.select("page_id", "digest", F.lit(0).alias("kind"), empty("string").alias("url"), empty("string").alias("html"), "first_id")
    page_rows = rows.select("page_id", "digest", F.lit(1).alias("kind"), "url", "html", empty("long").alias("first_id"))
    both = first_rows.unionByName(page_rows).withColumn("shard", shard_of("page_id"))
    dealt = both.repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("shard", "page_id", "digest", "kind", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, known_key, first_id, seen = None, None, None, None
        for batch in batches:
            for page_id, digest, kind, url, text, first, shard in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if roller is None or roller.shard != shard:
                    if roller is not None:
                        roller.close()
                        yield manifest(roller.done)
                    roller = Roller(folder, shard, file_bytes)
                if kind == 0:
                    known_key, first_id, seen = (page_id, digest), first, False
                    continue
                grouped = known_key == (page_id, digest)
                is_first = not grouped or (page_id == first_id and not seen)
                seen = True
                roller.add(page_record(page_id, url, text.encode("utf-8", "surrogatepass"), first_id if grouped else None, is_first))
        if roller is not None:
            roller.close()
            yield manifest(roller.done)

    dealt.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/_manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def manifest(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    kinds = [("shard", pa.int32()), ("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], [n for n, _ in kinds])


def members(stream: pa.NativeFile) -> Iterator[bytes]:
    """The gzip members of a file, one at a time."""
    waiting, unpacker, parts = b"", zlib.decompressobj(31), []
    while True:
        data = waiting or stream.read(1 << 18)
        if not data:
            if parts:
                raise ValueError("a WARC file ends inside a record")
            return
        parts.append(unpacker.decompress(data))
        waiting = b""
        if unpacker.eof:
            yield b"".join(parts)
            waiting, unpacker, parts = unpacker.unused_data, zlib.decompressobj(31), []


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record, with its block digest checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    if headers["WARC-Block-Digest"] != f"sha1:{sha1(block)}":
        raise ValueError(f"block digest of {headers['WARC-Record-ID']} does not match")
    return headers, block


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the files that the manifest lists, one row per page: ids, full payload's size and digest, type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = place_of(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                out = []
                with fs.open_input_stream(f"{top}/{name}", compression=None) as stream:
                    for data in members(stream):
                        headers, block = parsed(data)
                        if headers["WARC-Type"] != "warcinfo":
                            out.append(row(headers, block))
                columns = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    listed = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")
    n = max(1, listed.count())
    return listed.select("name").repartition(n, "name").mapInArrow(run, READ)


def row(headers: dict[str, str], block: bytes) -> tuple:
    number = lambda name: int(headers[name]) if name in headers else None
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if headers["WARC-Type"] == "response" and (len(payload), sha1(payload)) != (size, digest):
        raise ValueError(f"payload digest of {headers['WARC-Record-ID']} does not match")
    return number("X-Page-Id"), size, digest, headers["WARC-Type"], number("X-Refers-To-Page-Id"), headers["WARC-Target-URI"]

"""A deterministic sharded WARC writer, and the reader of its archives.

Records are dealt to ranges of page ids and sorted in them; each range writes its own files and begins a new one when
the compressed size passes `roll_bytes`. Headers, lengths and digests are made anew from the payload, nothing depends on
the clock or on how rows were partitioned, and each record is a gzip member of its own. Of records with equal payloads of `min_bytes` or
more, the one with the smallest page id is a response, the others are revisits that name it.

A task writes under a temporary name and renames the whole file; the list of files is written last, as a table, and readers take
files from that list alone. A task that runs again writes the same bytes to the same names.

Files are written through pyarrow's file systems, so the folder can be any that Spark's tasks share.
Payloads are equal if their SHA-256 and sizes are; the digests in records are SHA-1, as readers of WARC files expect.
Defined cases: a null payload counts as empty; a null URL has no target header; rows that repeat a page id each get a record (all
responses, if that id is the smallest of its payload); rows without a page id are sorted first; an empty table gives no file;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, emit
from .key_ranges import first_keys, range_of

DATE = "2024-01-01T00:00:00Z"
#: Tasks that read archives; each takes its files one after the other.
READERS = 20_000
MANIFEST = "file string, part int, records long, bytes long, sha256 string"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:x-page:{'' if page is None else page}:{digest}>"


def block(headers: list[tuple[str, str]], body: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(body)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + body + b"\r\n\r\n"


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    digest = digest_of(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page, digest)), ("WARC-Date", DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%-._~")))
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, digest))]
    return block(headers, http if refers_to is not None else http + payload)


def member(data: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


class Shard:
    """The files of one range, one open at a time."""

    def __init__(self, folder: str, part: int, roll_bytes: int) -> None:
        self.system, self.folder = fs.FileSystem.from_uri(folder)
        self.part, self.roll_bytes, self.number, self.stream = part, roll_bytes, 0, None

    def add(self, data: bytes) -> tuple | None:
        """Writes a record; returns the manifest row of a file that is full."""
        if self.stream is None:
            self.name = f"pages-{self.part:06d}-{self.number:05d}.warc.gz"
            self.temporary = f"{self.folder}/tmp/{self.name}.{uuid.uuid4().hex}"
            self.stream, self.sha, self.size, self.records = self.system.open_output_stream(self.temporary), hashlib.sha256(), 0, 0
            info = f"software: palimpsest\r\nformat: WARC File Format 1.1\r\nisPartOf: {self.name}\r\n".encode()
            self._write(member(block([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:x-file:{self.name}>"), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], info)))
        self._write(member(data))
        self.records += 1
        return self.close() if self.size >= self.roll_bytes else None

    def _write(self, data: bytes) -> None:
        self.stream.write(data)
        self.sha.update(data)
        self.size += len(data)

    def close(self) -> tuple | None:
        if self.stream is None:
            return None
        self.stream.close()
        self.stream = None
        final = f"{self.folder}/data/{self.name}"
        if self.system.get_file_info(final).type != fs.FileType.NotFound:
            self.system.delete_file(final)
        self.system.move(self.temporary, final)
        self.number += 1
        return self.name, self.part, self.records, self.size, self.sha.hexdigest()


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, roll_bytes: int = 16_000_000, range_rows: int = 4000, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes archives and their manifest under folder; returns the manifest."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("html"))
    sums = rows.select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("sha"), F.octet_length("html").alias("size")).where(F.col("size") >= min_bytes)
    firsts = sums.groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = sums.join(firsts, ["sha", "size"]).where("page_id is null or page_id != first").where("first is not null")
    ranges = first_keys(rows, "page_id", range_rows)
    part = range_of(F.col("page_id"), ranges)
    none = F.lit(None).cast("string")
    # What a revisit refers to travels as a small row of its own, just before the page's; pages cross the shuffle once.
    dealt = rows.select(part.alias("part"), "page_id", F.lit(1).alias("kind"), "url", "html", none.alias("sha"), F.lit(None).cast("long").alias("first")).unionByName(
        again.distinct().select(part.alias("part"), "page_id", F.lit(0).alias("kind"), none.alias("url"), none.alias("html"), "sha", "first")
    )
    dealt = dealt.repartitionById(max(1, len(ranges)), "part").sortWithinPartitions("part", "page_id", "kind", "url", "html")
    system, path = fs.FileSystem.from_uri(folder)
    for name in ("data", "tmp"):
        system.create_dir(f"{path}/{name}", recursive=True)
    schema = pa.schema([("file", pa.string()), ("part", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, refers, page_of = None, {}, None
        done: list[tuple | None] = []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("part", "page_id", "kind", "url", "sha", "first"))
            for (p, page, kind, url, sha, first), html in zip(zip(*columns, strict=True), bytes_of(batch, "html"), strict=True):
                if shard is None or shard.part != p:
                    done.append(shard and shard.close())
                    shard = Shard(folder, p, roll_bytes)
                if page != page_of:
                    refers, page_of = {}, page
                if kind == 0:
                    refers[sha] = first
                    continue
                first = refers.get(hashlib.sha256(html).hexdigest()) if refers else None
                done.append(shard.add(record(page, url, html, first)))
        done.append(shard and shard.close())
        yield emit(schema, list(zip(*filter(None, done), strict=True)) or [[]] * len(schema))

    dealt.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    system.delete_dir(f"{path}/tmp")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def records_of(stream) -> Iterator[bytes]:
    """The gzip members of a file, one at a time."""
    unpack, out = zlib.decompressobj(31), []
    while data := stream.read(1 << 20):
        while data:
            out.append(unpack.decompress(data))
            data = unpack.unused_data
            if unpack.eof:
                yield b"".join(out)
                unpack, out = zlib.decompressobj(31), []
    if out and any(out):
        raise ValueError("the archive ends within a record")


def parts_of(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Head and block of each record in a gzip member; the writer puts one there, other tools may put more."""
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        size = int(headers_of(head)["content-length"])
        if rest[size : size + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield head, rest[:size]
        data = rest[size + 4 :]


def headers_of(head: bytes) -> dict[str, str]:
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}


def page_in(id_: str) -> int | None:
    found = re.match(r"<urn:x-page:(-?\d*):", id_)
    return int(found[1]) if found and found[1] else None


def read_archives(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload), a row per record. Digests of responses are computed from
    what was read and must equal the headers', and a file must hold as many records as the manifest says; payload is null unless asked for."""
    listed = manifest(spark, folder).select("file", "records")
    files = listed.count()
    listed = listed.repartition(max(1, min(files, READERS)), "file")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, records in zip(batch.column("file").to_pylist(), batch.column("records").to_pylist(), strict=True):
                rows: list[tuple] = []
                read = 0
                with system.open_input_stream(f"{path}/data/{name}", compression=None) as stream:
                    for head, body in (part for data in records_of(stream) for part in parts_of(data)):
                        own = headers_of(head)
                        if own["warc-type"] == "warcinfo":
                            continue
                        read += 1
                        http, _, payload = body.partition(b"\r\n\r\n")
                        size, digest = int(headers_of(http)["content-length"]), own["warc-payload-digest"].removeprefix("sha1:")
                        response = own["warc-type"] == "response"
                        if response and (len(payload), digest_of(payload)) != (size, digest):
                            raise ValueError(f"{name}: the record {own['warc-record-id']} is not what its headers say")
                        refers = None if response else page_in(own["warc-refers-to"])
                        rows.append((page_in(own["warc-record-id"]), own.get("warc-target-uri"), size, digest, own["warc-type"], refers, payload if payloads and response else None))
                        if len(rows) >= 1000:
                            yield emit(schema, list(zip(*rows, strict=True)))
                            rows = []
                if read != records:
                    raise ValueError(f"{name}: {read} records were read, {records} were written")
                yield emit(schema, list(zip(*rows, strict=True)) or [[]] * len(schema))

    return listed.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")

"""WARC archives compressed with Zstandard: one frame for each record, a dictionary in a leading skippable frame.

Records are written by the executors into files of bounded size below a shared folder (any store that pyarrow can
open by URI); names depend only on task and number, so a repeated attempt writes the same files. The reader loads
the dictionary from the skippable frame, decodes one frame for each record and checks magic numbers, headers, block
lengths and digests. It streams: one frame is in memory at a time, whatever the size of the archive.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import written

SKIPPABLE = 0x184D2A5D  # fixed value: the skippable frame that holds a dictionary
MAGIC = b"\x28\xb5\x2f\xfd"  # fixed value: a Zstandard frame
FILE_BYTES = 64 << 20  # compressed bytes after which a task starts another archive
SAMPLE_BYTES, DICTIONARY_BYTES = 1 << 20, 16 << 10  # texts that train an archive's dictionary; its size
LEVEL = 3
READ_BYTES = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value
DATE = "2024-01-01T00:00:00Z"

RECORD = "record_id string, page_id bigint, record_type string, refers_to bigint, url string, payload_bytes bigint, payload_digest string, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def identity(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record: a response with its payload, or a revisit that has only the HTTP headers."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    heads = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", identity(page)), ("WARC-Date", DATE),
        ("WARC-Target-URI", target), ("X-Page-ID", "" if page is None else str(page)), ("WARC-Payload-Digest", "sha1:" + digest(payload)),
        ("WARC-Block-Digest", "sha1:" + digest(block)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        heads += [("WARC-Profile", PROFILE), ("WARC-Refers-To", identity(refers_to)), ("X-Refers-To-Page", str(refers_to))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in heads).encode() + b"\r\n" + block + b"\r\n\r\n"


def headers(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in raw.decode().split("\r\n") if line)}


def parsed(raw: bytes) -> tuple:
    """The fields of one record; raises ValueError where magic, headers, lengths or digests are wrong."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not gap or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("not a WARC record")
    named = headers(lines)
    for needed in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if needed not in named:
            raise ValueError(f"record without {needed}")
    length = int(named["content-length"])
    block, tail = rest[:length], rest[length:]
    if len(block) != length or tail != b"\r\n\r\n":
        raise ValueError("block length does not match its header")
    if "sha1:" + digest(block) != named.get("warc-block-digest", "sha1:" + digest(block)):
        raise ValueError("block digest does not match")
    http, gap, payload = block.partition(b"\r\n\r\n")
    size = int(headers(http.partition(b"\r\n")[2])["content-length"])
    revisit = named["warc-type"] == "revisit"
    if not gap or (bool(payload) if revisit else len(payload) != size):
        raise ValueError("payload length does not match its header")
    claimed = named["warc-payload-digest"].removeprefix("sha1:")
    if not revisit and digest(payload) != claimed:
        raise ValueError("payload digest does not match")
    number = lambda key: int(named[key]) if named.get(key) else None
    return (named["warc-record-id"], number("x-page-id"), named["warc-type"], number("x-refers-to-page"), named.get("warc-target-uri"), size, claimed, None if revisit else payload)


class Writer:
    """Archives of one task below ``folder``; a file appears under its name only when it is whole."""

    def __init__(self, folder: str, task: int):
        import zstandard

        self.zstd, self.task, self.number = zstandard, task, 0
        self.store, self.folder = pafs.FileSystem.from_uri(folder)
        self.store.create_dir(self.folder, recursive=True)

    def archive(self, records: Iterator[bytes]) -> tuple[str, int] | None:
        """Write records until the file is full; (path, records), or None when there are none left."""
        first, held = [], 0
        for raw in records:
            first.append(raw)
            held += len(raw)
            if held >= SAMPLE_BYTES:
                break
        if not first:
            return None
        dictionary = self.dictionary(first)
        packer = self.zstd.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
        name = f"{self.folder}/part-{self.task:05d}-{self.number:04d}.warc.zst"
        draft, count, size = f"{name}.{uuid.uuid4().hex}.draft", 0, 0
        with self.store.open_output_stream(draft, compression=None) as out:
            body = dictionary.as_bytes() if dictionary else b""
            out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
            for source in (first, records):
                for raw in source:
                    size += out.write(packer.compress(raw)) or 0
                    count += 1
                    if size >= FILE_BYTES and source is records:
                        break
        self.store.move(draft, name)
        self.number += 1
        return name, count

    def dictionary(self, sample: list[bytes]):
        try:
            return self.zstd.train_dictionary(DICTIONARY_BYTES, [s[:8192] for s in sample])
        except self.zstd.ZstdError:  # too little text to learn from
            return None


def write_archives(pages: DataFrame, folder: str, ident: str = "page_id", url: str = "url", refers: str = "refers_to", body: str = "html") -> DataFrame:
    """(archive, records): writes a record for each row; a row with ``refers`` set is a revisit."""
    rows = pages.select(F.col(ident).cast("bigint").alias("p"), F.col(url).cast("string").alias("u"), F.col(refers).cast("bigint").alias("r"), F.col(body).cast("string").alias("b"))

    def run(batches):
        def records():
            for batch in batches:
                for low in range(0, batch.num_rows, 64):
                    part = batch.slice(low, 64)
                    for p, u, r, b in zip(*[c.to_pylist() for c in part.columns]):
                        yield record(p, u, (b or "").encode(), r)

        writer, source = Writer(folder, TaskContext.get().partitionId()), records()
        while (done := writer.archive(source)) is not None:
            yield pa.record_batch({"archive": [done[0]], "records": [done[1]]})

    return rows.mapInArrow(run, "archive string, records bigint")


def frames(stream) -> Iterator[bytes]:
    """The decoded frames of an archive, one after the other; raises where it is cut or not as announced."""
    import zstandard

    head = stream.read(8)
    if len(head) < 8 or struct.unpack("<II", head)[0] != SKIPPABLE:
        raise ValueError("archive without a leading dictionary frame")
    size = struct.unpack("<II", head)[1]
    body = stream.read(size)
    if len(body) != size:
        raise ValueError("dictionary frame is cut")
    if body[:4] == MAGIC:  # a dictionary may itself be compressed
        body = zstandard.ZstdDecompressor().decompress(body)
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body)) if body else zstandard.ZstdDecompressor()
    held = stream.read(READ_BYTES)
    while held:
        if len(held) < 4:
            held += stream.read(READ_BYTES)
        if held[:4] != MAGIC:
            raise ValueError("no frame where a record should start")
        one, parts = unpacker.decompressobj(), []
        while True:
            parts.append(one.decompress(held))
            if one.eof:
                held = one.unused_data
                break
            held = stream.read(READ_BYTES)
            if not held:
                raise ValueError("last frame is cut")
        yield b"".join(parts)
        held = held or stream.read(READ_BYTES)


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Records of the archives (archive, records); each file is one stream, and its number of records must agree."""

    def run(batches):
        store, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, seen, held = [], 0, 0
                with store.open_input_stream(name, compression=None) as stream:
                    for raw in frames(stream):
                        rows.append(parsed(raw))
                        seen, held = seen + 1, held + len(raw)
                        if held >= 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)
                if seen != count:
                    raise ValueError(f"{name} holds {seen} records, {count} were written")

    return archives.select("archive", "records").mapInArrow(run, RECORD)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = [part.split()[0] for part in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def with_first(pages: DataFrame, ident: str = "page_id", url: str = "url", body: str = "html", least: int = 0) -> DataFrame:
    """Id, url and body of ``pages`` with ``refers_to``: of rows with equal bodies of at least ``least`` bytes, the smallest id; null for it.

    Groups are met through a minimum of (digest, length) only. Rows repeated under the smallest id are responses all;
    rows without an id are responses, since nothing could refer to them or name them.
    """
    text = F.encode(F.coalesce(F.col(body), F.lit("")), "UTF-8")
    rows = pages.select(ident, url, body, F.sha1(text).alias("_d"), F.octet_length(text).alias("_n"))
    firsts = rows.groupBy("_d", "_n").agg(F.min(ident).alias("_first"), F.max(ident).alias("_last")).where("_first <> _last").drop("_last")
    refers = F.when((F.col("_n") >= least) & (F.col(ident) > F.col("_first")), F.col("_first"))
    return rows.join(firsts, ["_d", "_n"], "left").withColumn("refers_to", refers).drop("_d", "_n", "_first")


def round_trip(spark: SparkSession, pages: DataFrame, ident: str = "page_id", url: str = "url", body: str = "html", least: int = 0) -> DataFrame:
    """Write a record for every row of ``pages`` and read all archives back; an empty table gives no record."""
    folder = scratch_path(spark, "warc")
    folder = folder if "://" in folder else "file://" + folder.removeprefix("file:")
    done = written(write_archives(with_first(pages, ident, url, body, least), folder, ident, url, "refers_to", body), "archives")
    spread = max(1, min(done.count(), 10_000))
    return read_archives(done.repartition(spread, "archive"), folder)

"""WARC archives in Zstandard frames with a dictionary.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself raw or a Zstandard frame; each record that follows is one
frame, so any record can be read alone. The writer trains the dictionary on its first records. The reader loads it, decodes one
frame a record and validates the record: version line, required headers, Content-Length against the bytes that are there, the closing blank lines, and the
payload digest of responses.

Of records with equal payloads the one of the smallest page_id is the response; the others are revisits without a payload, whose headers name it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import fresh_dir, one_each, small_batches, written

#: Fixed values of the format.
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
#: The dictionary is trained on so many bytes of an archive's first records, and has so many at most. An archive is closed at ARCHIVE_BYTES.
TRAIN_BYTES, DICTIONARY_BYTES, ARCHIVE_BYTES, LEVEL = 1 << 21, 1 << 16, 1 << 26, 3
#: Every record of an archive made from a table bears this date; the table has none.
DATE = "1970-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """The bare base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: dict[str, str], block: bytes) -> bytes:
    """A record's bytes; Content-Length is put in."""
    lines = [VERSION, *(f"{k}: {_line(v)}".encode() for k, v in headers.items()), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join((*lines, b"", block)) + b"\r\n\r\n"


def _line(value: str) -> str:
    """Line ends in a header's value would end the header."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; ValueError if anything about it is off."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not gap or not version.startswith(b"WARC/1."):
        raise ValueError("no WARC record")
    headers = {}
    for line in lines:
        name, colon, value = line.decode().partition(": ")
        if not colon or name in headers:
            raise ValueError(f"header line {line[:60]!r}")
        headers[name] = value
    if lacking := [k for k in REQUIRED if k not in headers]:
        raise ValueError(f"headers lack {', '.join(lacking)}")
    length = headers["Content-Length"]
    if not length.isdigit() or len(rest) != int(length) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError(f"Content-Length {length}, but {len(rest) - 4} bytes")
    return headers, rest[:-4]


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary of an archive's first records; where there are too few to train one, their own last bytes serve as one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict((b"".join(samples) or VERSION)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Archive:
    """Writes records to an open binary stream."""

    def __init__(self, out):
        self.out, self.pending, self.held, self.written, self.zstd = out, [], 0, 0, None

    def add(self, data: bytes) -> None:
        if self.zstd:
            self._put(data)
            return
        self.pending.append(data)
        self.held += len(data)
        if self.held >= TRAIN_BYTES:
            self._begin()

    def _begin(self) -> None:
        dictionary = train(self.pending)
        raw = dictionary.as_bytes()
        self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=True, write_checksum=True)
        pending, self.pending = self.pending, []
        for data in pending:
            self._put(data)

    def _put(self, data: bytes) -> None:
        frame = self.zstd.compress(data)
        self.written += len(frame)
        self.out.write(frame)

    def close(self) -> None:
        if not self.zstd:
            self._begin()
        self.out.close()


def read(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive, one frame each, from a binary stream; memory holds a frame and a chunk."""
    head = stream.read(8)
    magic, size = struct.unpack("<II", head) if len(head) == 8 else (0, 0)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame at the start")
    raw = stream.read(size)
    if len(raw) != size:
        raise ValueError("the dictionary is cut off")
    if raw[:4] == FRAME_MAGIC:
        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    dictionary, chunk = zstandard.ZstdCompressionDict(raw), b""
    while True:
        chunk = chunk or stream.read(1 << 20)
        if not chunk:
            return
        frame, parts = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj(), []
        while True:
            parts.append(frame.decompress(chunk))
            if frame.eof:
                break
            chunk = stream.read(1 << 20)
            if not chunk:
                raise ValueError("a record is cut off")
        chunk = frame.unused_data
        yield parse(b"".join(parts))


def write_pages(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record per row to archives below folder; gives the manifest, a row (path, records) an archive.

    The response of each payload is found by an aggregation over digests that is combined before the shuffle; the join back is one that Spark can split where
    a payload is very common. Names are of the task's own attempt; only archives that the written manifest names count.
    """
    small_batches(pages.sparkSession)
    payload = F.coalesce(pages["html"], F.lit(""))
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), payload.alias("html"), F.sha1(payload).alias("digest"))
    first = rows.groupBy("digest").agg(F.min("page_id").alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        archive, path, records = None, "", 0
        for batch in batches:
            for page_id, url, html, first_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive is None:
                    path = f"{root}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst"
                    archive, records = Archive(store.open_output_stream(path)), 0
                block, again = html.encode(), page_id != first_id
                headers = {
                    "WARC-Type": "revisit" if again else "response", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page/{page_id}')}>", "WARC-Date": DATE,
                    "WARC-Target-URI": url or "urn:none", "WARC-Payload-Digest": f"sha1:{digest(block)}", "X-Page-ID": "" if page_id is None else str(page_id), "X-Payload-Length": str(len(block)),
                }
                if again:
                    headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page/{first_id}')}>", "X-Refers-To-Page-ID": str(first_id)}
                archive.add(record(headers, b"" if again else block))
                records += 1
                if archive.written >= ARCHIVE_BYTES:
                    archive.close()
                    yield pa.RecordBatch.from_pydict({"path": [path], "records": [records]})
                    archive = None
        if archive is not None:
            archive.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [records]})

    joined = rows.join(first, "digest").select("page_id", "url", "html", "first")
    return written(joined.mapInArrow(run, "path string, records long"), "warc-manifest")


PAGES = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_pages(manifest: DataFrame, folder: str) -> DataFrame:
    """A row per record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""

    def row(headers: dict[str, str], block: bytes) -> tuple:
        found, kind, length = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"], int(headers["X-Payload-Length"])
        if kind == "response" and (len(block) != length or digest(block) != found):
            raise ValueError(f"page {headers['X-Page-ID']}: the payload is not what its headers say")
        own, other = headers["X-Page-ID"], headers.get("X-Refers-To-Page-ID")
        return int(own) if own else None, length, found, kind, int(other) if other else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, records in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, total = [], 0
                with store.open_input_stream(path) as stream:
                    for headers, block in read(stream):
                        rows.append(row(headers, block))
                        total += 1
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), PAGES, strict=True)], schema=PAGES)
                            rows = []
                if total != records:
                    raise ValueError(f"{path}: {total} records, not {records}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), PAGES, strict=True)], schema=PAGES)

    spread = manifest.repartition(one_each(manifest), "path")  # an archive is read by one task
    return spread.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages as WARC archives in the shared folder and read them back.

    Reads page_id, url and html. Null html: an empty payload. Null url: the target ``urn:none``. Rows that repeat the page_id of a
    response and its payload are responses too. Null page_ids are larger than any other: such a row is a revisit, or a response if all rows of the payload lack an
    id. An empty table gives an empty table.
    """
    folder = fresh_dir(pages.sparkSession, "warc")
    return read_pages(write_pages(pages, folder), folder)

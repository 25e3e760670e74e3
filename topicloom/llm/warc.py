"""WARC archives with a Zstandard dictionary, and their reader.

Rows are written where they are: each task fills archives of about
``archive_bytes`` of payload. The first ``train_bytes`` of an archive's records
are held back to build its dictionary (from the first 128 KiB of each of them;
records are stored whole), which leads the file in a skippable frame (compressed); then every record is compressed as a frame of its own, so
single records can be read and a damaged one does not cost the others. An
archive with too few records for a dictionary has none and no leading frame.

Of records with equal payloads of at least ``least_bytes`` bytes the one with
the smallest page_id is a response, the others are revisits of it, without
payload. Equal payloads are found by their SHA-1 in a table of ids and digests;
payloads themselves do not move unless that table of repeated digests is large.

File names hold a fresh id, and only files listed in the returned table count:
what a lost or repeated attempt leaves behind is never read.

Nulls: a null html is an empty payload; a null url is left out of the record; a
row without page_id comes after all others among equals, and is a response if
none has an id. Repeated rows (same smallest page_id) are all responses. An
empty table writes no archive. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import stage

SKIPPABLE = 0x184D2A5D
DATE = "2000-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_ID, REFERS_TO = "WARC-Page-ID", "WARC-Refers-To-Page-ID"
MANIFEST = "archive string, n_records bigint, archive_bytes bigint"
RECORDS = "page_id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: str, sha: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}:{sha}')}>"


def header_value(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A").strip()


def record(page: str | None, url: str | None, payload: bytes, first: str | None) -> bytes:
    """One record; ``first``: the page that a revisit refers to."""
    sha = digest(payload)
    block = HTTP.format(len(payload)).encode() + (payload if first is None else b"")
    fields = {
        "WARC-Type": "response" if first is None else "revisit", "WARC-Record-ID": record_id(str(page), sha), "WARC-Date": DATE,
        "WARC-Target-URI": url and header_value(url), "WARC-Payload-Digest": f"sha1:{sha}", "WARC-Block-Digest": f"sha1:{digest(block)}",
        PAGE_ID: page, "WARC-Profile": first and PROFILE, "WARC-Refers-To": first and record_id(first, sha), REFERS_TO: first,
        "Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block)),
    }
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (by lower-case name) and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return fields, rest[: int(fields["content-length"])]


def file_system(folder: str):
    """The file system of a folder that all executors share, by its URI, and the path in it."""
    from pyarrow import fs

    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[len("file:") :]
    return fs.FileSystem.from_uri(folder)


class Writer:
    """One archive: held back until the dictionary is built, then written record by record."""

    def __init__(self, folder: str, dictionary_bytes: int, train_bytes: int, level: int):
        self.system, path = file_system(folder)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.system.create_dir(path, recursive=True)
        self.out = self.system.open_output_stream(f"{path}/{self.name}", compression=None)
        self.dictionary_bytes, self.train_bytes, self.level = dictionary_bytes, train_bytes, level
        self.held: list[bytes] = []
        self.held_bytes = self.payload_bytes = self.n = 0
        self.compressor = None

    def add(self, rec: bytes) -> None:
        self.n += 1
        self.payload_bytes += len(rec)
        if self.compressor is None:
            self.held.append(rec)
            self.held_bytes += len(rec)
            if self.held_bytes >= self.train_bytes:
                self._begin()
        else:
            self.out.write(self.compressor.compress(rec))

    def _begin(self) -> None:
        import zstandard

        dictionary = None
        if len(self.held) >= 8:
            size = min(self.dictionary_bytes, max(1024, self.held_bytes // 10))
            try:
                dictionary = zstandard.train_dictionary(size, [x[: 1 << 17] for x in self.held])
            except zstandard.ZstdError:
                dictionary = None  # too little in common
        if dictionary is not None:
            frame = zstandard.ZstdCompressor(level=self.level).compress(dictionary.as_bytes())
            self.out.write(struct.pack("<II", SKIPPABLE, len(frame)) + frame)
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=dictionary, write_checksum=True, write_content_size=True)
        for x in self.held:
            self.out.write(self.compressor.compress(x))
        self.held = []

    def close(self) -> tuple[str, int, int]:
        if self.compressor is None:
            self._begin()
        size = self.out.tell()
        self.out.close()
        return self.name, self.n, size


def decided(pages: DataFrame, least_bytes: int) -> DataFrame:
    """page_id and first as strings, url and html: ``first`` is the page that a revisit refers to."""
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("_sha", F.sha1("payload"))
    long_enough = rows.filter(F.octet_length("payload") >= least_bytes)
    repeated = stage(long_enough.groupBy("_sha").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n"))
    joined = rows.join(repeated, "_sha", "left")
    revisit = (F.octet_length("payload") >= least_bytes) & F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return joined.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", F.when(revisit, F.col("_first").cast("string")).alias("first"))


def write(
    pages: DataFrame, folder: str, archive_bytes: int = 512 << 20, dictionary_bytes: int = 64 << 10, train_bytes: int = 2 << 20, level: int = 3, least_bytes: int = 0
) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives below ``folder``; returns the written table of archives."""

    def fill(batches):
        import pyarrow as pa

        done, writer = [], None
        for batch in batches:
            for page, url, payload, first in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "first"))):
                writer = writer or Writer(folder, dictionary_bytes, train_bytes, level)
                writer.add(record(page.as_py(), url.as_py(), payload.as_py() or b"", first.as_py()))
                if writer.payload_bytes >= archive_bytes:
                    done.append(writer.close())
                    writer = None
        if writer:
            done.append(writer.close())
        names, counts, sizes = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{folder}/{x}" for x in names], pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())],
            ["archive", "n_records", "archive_bytes"],
        )

    return stage(decided(pages, least_bytes).mapInArrow(fill, MANIFEST))


def records_of(stream):
    """The records of an open archive, one at a time."""
    import zstandard

    data = stream.read(8)
    dictionary = None
    if len(data) == 8 and struct.unpack("<I", data[:4])[0] == SKIPPABLE:
        frame = stream.read(struct.unpack("<I", data[4:])[0])
        dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(frame))
        data = b""
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
    while True:
        data = data or stream.read(1 << 20)
        if not data:
            return
        one, parts = decompressor.decompressobj(), []
        while not one.eof:
            parts.append(one.decompress(data))
            data = b"" if one.eof else stream.read(1 << 20)
            if not one.eof and not data:
                raise ValueError("the archive ends within a record")
        data = one.unused_data
        yield b"".join(parts)


def read(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives listed in ``archives`` (archive), checked against their digests."""

    def load(batches):
        import pyarrow as pa

        for batch in batches:
            for path in batch.column("archive").to_pylist():
                system, inner = file_system(path)
                rows, size = [], 0
                with system.open_input_stream(inner, compression=None) as stream:
                    for raw in records_of(stream):
                        rows.append(read_one(raw, with_payload))
                        size += len(rows[-1][-1] or b"") + 200
                        if size >= 4 << 20:
                            yield as_batch(pa, rows)
                            rows, size = [], 0
                if rows:
                    yield as_batch(pa, rows)

    spread = max(1, archives.count() // 2)
    return archives.select("archive").repartition(spread, "archive").mapInArrow(load, RECORDS)


def read_one(raw: bytes, with_payload: bool) -> tuple:
    fields, block = parse(raw)
    head, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    sha, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
    if kind == "response" and (digest(payload) != sha or len(payload) != size):
        raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
    return (
        fields.get(PAGE_ID.lower()), fields.get("warc-target-uri"), size, sha, kind, fields.get(REFERS_TO.lower()),
        payload if with_payload and kind == "response" else None,
    )


def as_batch(pa, rows: list[tuple]):
    types = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary())
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def archive_folder(spark) -> str:
    return scratch_path(spark, "warc")

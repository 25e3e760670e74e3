"""Token ids in files of patched frame-of-reference blocks.

Documents are encoded in ascending order of doc_id, an end id is appended to
each, and all ids form one stream. The stream is cut into files (a range of
documents each) and blocks of ``BLOCK`` ids. A block stores its smallest id and
the differences to it, packed at the width that holds the ``percentile`` of
them; of larger differences the low bits are packed like the others and the high
bits stand in a list of exceptions with their positions.

File (little endian): magic; blocks (smallest id u32, number of ids u16, width
u8, width of the exceptions' high bits u8, number of exceptions u16, packed low
bits, positions u16, packed high bits); index of block starts u64; document
index (end of each document in the file's stream u64, length of its id u32, ids
as text); trailer (blocks, documents, ids, place of the index, place of the
document index, each u64, crc32 of both indexes u32, magic). The index of block
starts lets :func:`read_slice` read any stretch of ids by the blocks that hold it.

Rows are range-partitioned by (doc_id, hash of the text), and each task encodes
and writes its range as it comes, so memory holds some blocks and the document
index of one file. File names hold a fresh id, and only files listed in the
returned table count: what a lost or repeated attempt leaves behind is never
read. A byte-level tokenizer looks at words, marks and white space one by one, so
texts are cut where its pattern always does (:func:`piece_starts`), and every
distinct piece of a run of texts is encoded once; this also bounds the memory of
a long text. Tokenizers of another kind encode whole texts.

Nulls: a null text is empty and gives the end id only; a null doc_id comes
first. Repeated rows follow each other, ties of doc_id by the hash of the text.
An empty table writes no file. Other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import in_runs, stage, utf8
from .warc import file_system

MAGIC = b"PFORIDS1"
BLOCK = 1024
#: blocks encoded, written, or read at once
GROUP = 256
#: bytes of text whose pieces are encoded together
RUN_BYTES = 32 << 20
NULL = 0xFFFFFFFF
HEAD = struct.Struct("<IHBBH")
TRAILER = struct.Struct("<QQQQQI8s")
FILES = "part int, number int, file string, n_docs bigint, n_ids bigint, n_bytes bigint"
DOCS = "doc_id string, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary"


# blocks


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 32-bit values as rows of bytes, ``width`` bits each."""
    m, n = values.shape
    bits = np.unpackbits(np.ascontiguousarray(values, dtype="<u4").view(np.uint8).reshape(m, n * 4), axis=1, bitorder="little")
    return np.packbits(bits.reshape(m, n, 32)[:, :, :width].reshape(m, n * width), axis=1, bitorder="little")


def unpack(data: np.ndarray, n: int, width: int) -> np.ndarray:
    m = len(data)
    bits = np.zeros((m, n, 32), np.uint8)
    bits[:, :, :width] = np.unpackbits(data, axis=1, count=n * width, bitorder="little").reshape(m, n, width)
    return np.packbits(bits.reshape(m, n * 32), axis=1, bitorder="little").view("<u4").astype(np.uint32)


def packed_bytes(n: int, width: int) -> int:
    return (n * width + 7) // 8


def encode_blocks(rows: np.ndarray, percentile: float) -> list[bytes]:
    """Each row of ids as a block."""
    m, n = rows.shape
    least = rows.min(axis=1)
    above = rows - least[:, None]
    most = np.partition(above, min(n - 1, int(np.ceil(percentile * n)) - 1), axis=1)[:, min(n - 1, int(np.ceil(percentile * n)) - 1)]
    width = np.ceil(np.log2(most.astype(np.float64) + 1)).astype(np.int64)
    out: list[bytes] = [b""] * m
    for w in np.unique(width).tolist():
        chosen = np.flatnonzero(width == w)
        low = pack(above[chosen] & np.uint32((1 << w) - 1), w)
        high = above[chosen] >> np.uint32(w) if w < 32 else np.zeros_like(above[chosen])
        for i, r in enumerate(chosen.tolist()):
            at = np.flatnonzero(high[i])
            top = int(high[i].max()).bit_length()
            patch = at.astype("<u2").tobytes() + pack(high[i][at][None, :], top).tobytes() if len(at) else b""
            out[r] = HEAD.pack(int(least[r]), n, w, top, len(at)) + low[i].tobytes() + patch
    return out


def block_length(head: tuple) -> int:
    _, n, width, top, patched = head
    return HEAD.size + packed_bytes(n, width) + 2 * patched + packed_bytes(patched, top)


def decode_blocks(data: bytes) -> np.ndarray:
    """The ids of the blocks that follow each other in ``data``."""
    heads, places, at = [], [], 0
    while at < len(data):
        heads.append(HEAD.unpack_from(data, at))
        places.append(at)
        at += block_length(heads[-1])
    sizes = np.array([h[1] for h in heads], np.int64)
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint32)
    raw = np.frombuffer(data, np.uint8)
    alike: dict[tuple[int, int], list[int]] = {}
    for i, h in enumerate(heads):
        alike.setdefault((h[1], h[2]), []).append(i)
    for (n, width), chosen in alike.items():
        length = packed_bytes(n, width)
        packed = np.stack([raw[places[i] + HEAD.size : places[i] + HEAD.size + length] for i in chosen])
        values = unpack(packed, n, width) if width else np.zeros((len(chosen), n), np.uint32)
        for row, i in zip(values, chosen):
            least, _, _, top, patched = heads[i]
            if patched:
                p = places[i] + HEAD.size + length
                where = np.frombuffer(data, "<u2", patched, p).astype(np.int64)
                more = raw[p + 2 * patched : p + 2 * patched + packed_bytes(patched, top)]
                row[where] |= unpack(more[None, :], patched, top)[0] << np.uint32(width)
            out[ends[i] - n : ends[i]] = row + np.uint32(least)
    return out


# encoding


LETTER, MARK, AFTER_SPACE = np.zeros((3, 256), dtype=bool)
LETTER[65:91] = LETTER[97:123] = True
MARK[33:48] = MARK[58:65] = MARK[91:97] = MARK[123:127] = True
MARK[39] = False  # an apostrophe may belong to the letters after it
AFTER_SPACE[33:127] = AFTER_SPACE[195:224] = True  # first bytes of characters that are no white space


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    found = Tokenizer.from_file(path)
    kind = found.pre_tokenizer
    in_pieces = found.normalizer is None and isinstance(kind, pre_tokenizers.ByteLevel) and kind.use_regex and not kind.add_prefix_space
    return found, in_pieces


def piece_starts(joined: bytes, first: np.ndarray, added: list[str]) -> np.ndarray:
    """Where pieces begin that a byte-level tokenizer encodes alone as in their text.

    Its pattern joins no letter with a mark, nothing with a line end after it,
    and a space only with what follows; white space of several characters is
    left whole. A text with an added token is cut at spaces only.
    """
    data = np.frombuffer(joined, np.uint8)
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        space = (data[:-1] == 32) & AFTER_SPACE[data[1:]]
        inner = first[(first > 0) & (first < len(data))]
        space[inner - 1] = False  # a space that ends its text is followed by nothing
        cut[:-2] = space
        if not any(token.encode() in joined for token in added):
            letter, mark, line = LETTER[data], MARK[data], data == 10
            solid = letter | mark
            cut[1:-1] |= (letter[:-1] & (mark[1:] | line[1:])) | (mark[:-1] & (letter[1:] | line[1:]))
            cut[2:-1] |= solid[:-2] & line[1:-1] & solid[2:]
    cut[first] = True
    return np.flatnonzero(cut)


def encode(texts: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, and how many each text has. Every distinct piece is encoded once."""
    import pyarrow as pa

    model, in_pieces = tokenizer(path)
    joined = b"".join(texts)
    first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
    cuts = piece_starts(joined, first, [t.content for t in model.get_added_tokens_decoder().values()]) if in_pieces else np.unique(first)
    pieces = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(joined)])
    distinct = pieces.dictionary_encode()
    ids, counts, batch = [], [], distinct.dictionary.cast(pa.string())
    for start in range(0, len(batch), 4096):
        found = [e.ids for e in model.encode_batch_fast(batch.slice(start, 4096).to_pylist(), add_special_tokens=False)]
        counts.append(np.fromiter(map(len, found), np.int64, len(found)))
        ids.append(np.fromiter(chain.from_iterable(found), np.uint32, int(counts[-1].sum())))
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts or [[]]))]).astype(np.int32)
    lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids or [np.zeros(0, np.uint32)])))
    which = distinct.indices.to_numpy()
    before = np.concatenate([[0], np.cumsum(np.diff(offsets)[which])]).astype(np.int64)
    return lists.take(distinct.indices).flatten().to_numpy(), np.diff(before[np.searchsorted(cuts, first)])


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(ids, np.cumsum(counts), np.uint32(end_id)), counts + 1


# files


class Writer:
    """One file: ids are written in whole groups of blocks, the indexes at the end."""

    def __init__(self, folder: str, percentile: float):
        system, path = file_system(folder)
        self.file = f"{folder}/{uuid.uuid4().hex}.pfor"
        system.create_dir(path, recursive=True)
        self.out = system.open_output_stream(f"{path}/{self.file.rsplit('/', 1)[1]}", compression=None)
        self.out.write(MAGIC)
        self.percentile, self.place, self.n_ids = percentile, len(MAGIC), 0
        self.pending: list[np.ndarray] = []
        self.waiting = 0
        self.starts: list[int] = []
        self.ends: list[np.ndarray] = []
        self.names: list[bytes | None] = []

    def add(self, ids: np.ndarray, counts: np.ndarray, names: list[bytes | None]) -> None:
        self.ends.append(self.n_ids + np.cumsum(counts))
        self.names += names
        self.n_ids += len(ids)
        self.pending.append(ids)
        self.waiting += len(ids)
        if self.waiting >= GROUP * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, np.uint32)
        whole = len(ids) // BLOCK
        for a in range(0, whole, GROUP):
            self._write(ids[a * BLOCK : min(a + GROUP, whole) * BLOCK].reshape(-1, BLOCK))
        rest = ids[whole * BLOCK :]
        if last and len(rest):
            self._write(rest[None, :])
            rest = rest[:0]
        self.pending, self.waiting = [rest.copy()], len(rest)

    def _write(self, rows: np.ndarray) -> None:
        blocks = encode_blocks(rows, self.percentile)
        for b in blocks:
            self.starts.append(self.place)
            self.place += len(b)
        self.out.write(b"".join(blocks))

    def close(self) -> tuple[str, int, int, int]:
        self._flush(True)
        index = np.array(self.starts, "<u8").tobytes()
        lengths = np.array([NULL if x is None else len(x) for x in self.names], "<u4").tobytes()
        docs = np.concatenate(self.ends).astype("<u8").tobytes() + lengths + b"".join(x or b"" for x in self.names)
        docs_at = self.place + len(index)
        self.out.write(index + docs)
        self.out.write(TRAILER.pack(len(self.starts), len(self.names), self.n_ids, self.place, docs_at, zlib.crc32(docs, zlib.crc32(index)), MAGIC))
        size = self.out.tell()
        self.out.close()
        return self.file, len(self.names), self.n_ids, size


def write(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, percentile: float = 0.95,
    part_bytes: int = 32 << 20, file_docs: int = 1 << 20, file_ids: int = 1 << 28,
) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) as files below ``folder``; returns the written table of files with their places.

    ``first_doc`` and ``first_id`` count the documents and ids of all files before.
    """

    def fill(batches):
        import pyarrow as pa

        done, writer, part = [], None, None
        for batch in batches:
            part = batch.column("_part")[0].as_py() if batch.num_rows else part
            for run in in_runs([batch], RUN_BYTES):
                ids, counts = with_end(*encode(utf8(run.column("text")), tokenizer_path), end_id)
                writer = writer or Writer(folder, percentile)
                writer.add(ids, counts, run.column("doc_id").cast(pa.binary()).to_pylist())
                if writer.n_ids >= file_ids or len(writer.names) >= file_docs:
                    done.append(writer.close())
                    writer = None
        if writer:
            done.append(writer.close())
        columns = list(zip(*done)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * len(done), pa.int32()), pa.array(range(len(done)), pa.int32()), pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])],
            ["part", "number", "file", "n_docs", "n_ids", "n_bytes"],
        )

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    parts = max(1, -(-total // part_bytes), min(docs.sparkSession.sparkContext.defaultParallelism * 2, total >> 20))
    key = [F.col("doc_id"), F.xxhash64("text")]
    ordered = rows.repartitionByRange(int(parts), *key).sortWithinPartitions(*key)
    ordered = ordered.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.spark_partition_id().alias("_part"))
    return stage(placed(stage(ordered.mapInArrow(fill, FILES))))


def placed(files: DataFrame, stretch: int = 4096) -> DataFrame:
    """Files with the documents and ids before them; sums of stretches of parts first, so no window holds all files."""
    files = files.withColumn("_stretch", F.expr(f"part div {stretch}"))
    sums = files.groupBy("_stretch").agg(F.sum("n_docs").alias("_d"), F.sum("n_ids").alias("_i"))
    over = Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("_stretch").orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    sums = sums.select("_stretch", before("_d", over).alias("_d"), before("_i", over).alias("_i"))
    inner = files.withColumns({"first_doc": before("n_docs", within), "first_id": before("n_ids", within)})
    return inner.join(sums, "_stretch").select(
        "part", "number", "file", "n_docs", "n_ids", "n_bytes", (F.col("first_doc") + F.col("_d")).alias("first_doc"), (F.col("first_id") + F.col("_i")).alias("first_id")
    )


class Reader:
    """An open file: its indexes, and its ids by groups of blocks."""

    def __init__(self, file: str):
        system, path = file_system(file)
        self.stream = system.open_input_file(path)
        size = self.stream.size()
        n_blocks, n_docs, self.n_ids, index_at, docs_at, crc, magic = TRAILER.unpack(self.stream.read_at(TRAILER.size, size - TRAILER.size))
        index, docs = self.stream.read_at(docs_at - index_at, index_at), self.stream.read_at(size - TRAILER.size - docs_at, docs_at)
        if magic != MAGIC or self.stream.read_at(len(MAGIC), 0) != MAGIC or zlib.crc32(docs, zlib.crc32(index)) != crc:
            raise ValueError(f"{file} is not a whole file of token ids")
        self.starts = np.append(np.frombuffer(index, "<u8"), np.uint64(index_at)).astype(np.int64)
        self.ends = np.frombuffer(docs, "<u8", n_docs).astype(np.int64)
        lengths = np.frombuffer(docs, "<u4", n_docs, 8 * n_docs).astype(np.int64)
        cuts = np.concatenate([[0], np.cumsum(np.where(lengths == NULL, 0, lengths))]) + 12 * n_docs
        self.names = [None if n == NULL else docs[a:b].decode() for n, a, b in zip(lengths.tolist(), cuts[:-1].tolist(), cuts[1:].tolist())]

    def blocks(self, a: int, b: int) -> np.ndarray:
        """The ids of blocks a to b."""
        if a >= b:
            return np.zeros(0, np.uint32)
        return decode_blocks(self.stream.read_at(int(self.starts[b] - self.starts[a]), int(self.starts[a])))

    def groups(self):
        for a in range(0, len(self.starts) - 1, GROUP):
            yield self.blocks(a, min(a + GROUP, len(self.starts) - 1))

    def slice(self, start: int, stop: int) -> np.ndarray:
        start, stop = max(start, 0), min(stop, self.n_ids)
        a = start // BLOCK
        return self.blocks(a, -(-stop // BLOCK))[start - a * BLOCK : stop - a * BLOCK] if start < stop else np.zeros(0, np.uint32)

    def documents(self, with_ids: bool):
        """(id, ids before it in the file, number, crc32, ids) of each document."""
        at, begun, crc, parts, doc = 0, 0, 0, [], 0
        for ids in self.groups():
            raw, low = memoryview(ids.astype("<u4").tobytes()), 0
            while doc < len(self.ends) and self.ends[doc] <= at + len(ids):
                high = int(self.ends[doc]) - at
                crc = zlib.crc32(raw[4 * low : 4 * high], crc)
                parts += [raw[4 * low : 4 * high]] if with_ids else []
                yield self.names[doc], begun, int(self.ends[doc]) - begun, crc, b"".join(parts) if with_ids else None
                begun, crc, parts, low, doc = int(self.ends[doc]), 0, [], high, doc + 1
            crc = zlib.crc32(raw[4 * low :], crc)
            parts += [raw[4 * low :]] if with_ids else []
            at += len(ids)


def read_slice(file: str, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a file's stream, read by the blocks that hold them."""
    return Reader(file).slice(start, stop)


def read(files: DataFrame, with_ids: bool = True) -> DataFrame:
    """doc_id (as text), start (ids of all documents before), n_tokens, ids_crc32 and ids (little-endian u32) of the documents in ``files``."""

    def load(batches):
        import pyarrow as pa

        def batch_of(rows):
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

        for batch in batches:
            for file, first in zip(batch.column("file").to_pylist(), batch.column("first_id").to_pylist()):
                rows, size = [], 0
                for name, start, n, crc, ids in Reader(file).documents(with_ids):
                    rows.append((name, first + start, n, crc, ids))
                    size += len(ids or b"") + 64
                    if size >= 4 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    n = max(1, files.count())
    return files.select("file", "first_id").repartition(n, "file").mapInArrow(load, DOCS)


def file_folder(spark) -> str:
    return scratch_path(spark, "token-ids")

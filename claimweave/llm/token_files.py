"""Token ids in files of independent zstandard frames with a trailing seek table.

A file is a sequence of zstandard frames, each with its own checksum, so that every zstandard reader
decompresses it to the ids, little-endian unsigned 32-bit numbers, document after document. Each frame is
followed by a skippable frame of four bytes. Then comes a skippable frame with the file's index (doc_ids and
numbers of ids, compressed), and at the end the seek table of the public seekable format: compressed size,
decompressed size and checksum (low 32 bits of XXH64) of each frame, and a footer. A reader takes the footer, the
table and the index, and decompresses only the frames of the documents it is asked for.

Spark's text sink writes and commits the files: a row is a frame that lacks its last four bytes, which
are the line separator, the magic number of the footer. So a file streams through its task, frame by frame.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, text_or_empty, work_table
from .tokens import encoder

END_ID = 0
#: Bytes of ids in a frame.
FRAME_BYTES = 1 << 17
LEVEL = 3
#: Magic numbers of the public formats (fixed values): skippable frames, the seek table's frame, its footer.
PAD_MAGIC, INDEX_MAGIC, TABLE_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
_SEPARATOR = struct.pack("<I", FOOTER_MAGIC)
#: Rows that are equal in doc_id and text are dealt to so many places, as a third of all rows may be.
SALTS = 1024


class _Frames:
    """Builds the rows of one file."""

    def __init__(self, number: int):
        self.number, self.sizes, self.doc_ids, self.tokens = number, [], [], []
        self.held = bytearray()

    def _row(self, frame: bytes, raw: bytes) -> bytes:
        row = frame + struct.pack("<II", PAD_MAGIC, len(_SEPARATOR))
        self.sizes.append((len(row) + len(_SEPARATOR), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        return row

    def _data(self, size: int) -> bytes:
        raw = bytes(self.held[:size])
        del self.held[:size]
        return self._row(zstandard.ZstdCompressor(level=LEVEL, write_checksum=True).compress(raw), raw)

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[bytes]:
        self.doc_ids.append(doc_id)
        self.tokens.append(len(ids) // 4)
        self.held += ids
        while len(self.held) >= FRAME_BYTES:
            yield self._data(FRAME_BYTES)

    def end(self) -> Iterator[bytes]:
        if self.held:
            yield self._data(len(self.held))
        known = np.array([d is not None for d in self.doc_ids], dtype="u1")
        parts = [np.array([d or 0 for d in self.doc_ids], dtype="<i8"), known, np.array(self.tokens, dtype="<u8")]
        raw = struct.pack("<QQ", self.number, len(self.doc_ids)) + b"".join(p.tobytes() for p in parts)
        packed = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True).compress(raw)
        yield self._row(struct.pack("<II", INDEX_MAGIC, len(packed)) + packed, b"")
        table = b"".join(struct.pack("<III", *s) for s in self.sizes)
        yield struct.pack("<II", TABLE_MAGIC, len(table) + 9) + table + struct.pack("<IB", len(self.sizes), 0x80)


def _file_batches(tokenizer: str | None):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Frames(TaskContext.get().partitionId())
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                end = struct.pack("<I", END_ID)
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder(tokenizer).encode(texts)):
                    for row in out.add(doc_id, ids + end):
                        yield pa.RecordBatch.from_arrays([pa.array([row], pa.binary())], names=["frame"])
        if out.doc_ids:
            for row in out.end():
                yield pa.RecordBatch.from_arrays([pa.array([row], pa.binary())], names=["frame"])

    return rows


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Write the ids of all texts, with END_ID behind each, in ascending order of doc_id, a file a partition.

    A null text counts as empty, a null doc_id comes first; rows that repeat a doc_id come in the order of a hash
    of their text, each as a document of its own. No rows give no document. Other columns are not read.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(F.col("text").cast("string")).alias("text"))
    place = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("salt")]
    dealt = named.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)))
    files = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, so that adaptive execution leaves this much parallelism
    ordered = dealt.repartitionByRange(files, *place).sortWithinPartitions(*place).select("doc_id", "text")
    frames = ordered.mapInArrow(_file_batches(tokenizer), "frame binary")
    frames.select(F.col("frame").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", _SEPARATOR.decode("latin-1")).text(path)


class TokenFile:
    """Random access to one file: ``read(offset, length)`` gives its bytes, ``size`` is their number."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self._read = read
        count, descriptor, magic = struct.unpack("<IBI", read(size - 9, 9))
        if magic != FOOTER_MAGIC or descriptor != 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        table = read(size - 17 - 12 * count, 8 + 12 * count)
        if struct.unpack("<II", table[:8]) != (TABLE_MAGIC, 12 * count + 9):
            raise ValueError("a damaged seek table")
        self.entries = np.frombuffer(table[8:], dtype="<u4").reshape(count, 3).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.entries[:, 0])])
        self.begins = np.concatenate([[0], np.cumsum(self.entries[:, 1])])
        head, packed = struct.unpack("<II", read(int(self.at[-2]), 8))
        if head != INDEX_MAGIC:
            raise ValueError("a damaged index")
        raw = zstandard.ZstdDecompressor().decompress(read(int(self.at[-2]) + 8, packed))
        self.number, n = struct.unpack("<QQ", raw[:16])
        known = np.frombuffer(raw, dtype="u1", offset=16 + 8 * n, count=n)
        self.doc_ids = [d if k else None for d, k in zip(np.frombuffer(raw, dtype="<i8", offset=16, count=n).tolist(), known.tolist())]
        self.tokens = np.frombuffer(raw, dtype="<u8", offset=16 + 9 * n, count=n).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.tokens)])
        self._last: tuple[int, bytes] = (-1, b"")
        self.opened = 0

    @classmethod
    def of_bytes(cls, content: bytes) -> TokenFile:
        return cls(lambda at, n: content[at : at + n], len(content))

    def _frame(self, k: int) -> bytes:
        if self._last[0] != k:
            raw = zstandard.ZstdDecompressor().decompress(self._read(int(self.at[k]), int(self.entries[k, 0])))
            if len(raw) != self.entries[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.entries[k, 2]:
                raise ValueError(f"frame {k} differs from its checksum")
            self._last, self.opened = (k, raw), self.opened + 1
        return self._last[1]

    def ids(self, place: int) -> bytes:
        """The ids of the document at a place; only the frames that hold them are decompressed."""
        lo, hi = 4 * int(self.starts[place]), 4 * int(self.starts[place + 1])
        first, last = np.searchsorted(self.begins, [lo, hi - 1], side="right") - 1
        parts = [self._frame(k)[max(0, lo - int(self.begins[k])) : hi - int(self.begins[k])] for k in range(first, last + 1)]
        return b"".join(parts)


def _document_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from zlib import crc32

    names = ["doc_id", "file", "place", "start", "n_tokens", "ids_crc32"]
    for batch in batches:
        for content in batch.column("content"):
            held = TokenFile.of_bytes(content.as_py())
            n = len(held.doc_ids)
            crc = [crc32(held.ids(i)) for i in range(n)]
            cols = [held.doc_ids, [held.number] * n, range(n), held.starts[:-1], held.tokens, crc]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)


def _contents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).filter("length > 0")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, file, place, start, n_tokens, ids_crc32)`` of every document, all frames checked.

    ``start`` counts the ids of all documents before it in all files. One number a file passes through the driver.
    """
    found = work_table(_contents(spark, path).select("content").mapInArrow(_document_batches, "doc_id long, file long, place long, start long, n_tokens long, ids_crc32 long"), "token-documents")
    sums = found.groupBy("file").agg(F.sum("n_tokens").alias("n")).toArrow().sort_by("file")
    n = sums.column("n").to_numpy()
    offsets = pa.table({"file": sums.column("file"), "before": pa.array(np.cumsum(n) - n, pa.int64())})
    return found.join(F.broadcast(spark.createDataFrame(offsets)), "file").withColumn("start", F.col("start") + F.col("before")).select(found.columns)


def _requested_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "ids"]
    for batch in batches:
        for content, doc_ids in zip(batch.column("content"), batch.column("doc_ids").to_pylist()):
            held, asked = TokenFile.of_bytes(content.as_py()), set(doc_ids)
            for i, doc_id in enumerate(held.doc_ids):
                if doc_id in asked:
                    ids = np.frombuffer(held.ids(i), dtype="<u4").astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([ids], pa.list_(pa.int64()))], names=names)


def read_requested(spark: SparkSession, path: str, documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(doc_id, ids)`` of the wanted doc_ids; files without any are not read, nor other frames decompressed.

    ``documents``: what :func:`read_documents` gave. Unknown ids give no row, repeated documents one each.
    """
    ids = wanted.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    by_file = documents.join(ids, "doc_id", "left_semi").groupBy("file").agg(F.collect_set("doc_id").alias("doc_ids"))
    files = _contents(spark, path).withColumn("file", F.regexp_extract("path", r"part-(\d+)", 1).cast("long"))
    return files.join(by_file, "file").select("content", "doc_ids").mapInArrow(_requested_batches, "doc_id long, ids array<long>")

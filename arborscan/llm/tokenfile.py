"""Token-id files: independent zstandard frames, a trailing seek table and checksums.

A shard holds the ids of documents in ascending order, as little-endian unsigned 32-bit integers:

* data frames: zstandard frames of at most ``FRAME_IDS`` ids, each with its own content checksum,
* a document table in a skippable frame: compressed arrays of ids, null marks, starts and lengths,
* a seek table in a skippable frame, laid out as the public zstandard seekable format has it:
  per data frame its compressed size, its size and the low half of its XXH64, then a footer.

Any zstandard reader can decompress the whole file; a reader of single documents takes the seek
table from the end, then only the frames that hold them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from arborscan.llm import tokens
from arborscan.llm.common import parallelism
from arborscan.session import work_folder

FRAME_IDS = 1 << 18
# fixed values of the zstandard formats
SKIPPABLE, SEEK_SKIPPABLE, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUM_FLAG = 0x80

_MANIFEST = "shard int, path string, n_docs long, n_ids long"
_DOCUMENT = "doc_id long, shard int, local_start long, n_tokens long, ids_crc32 long"


class ShardWriter:
    """Writes one shard as its documents come, holding one frame and the document table."""

    def __init__(self, sink):
        import zstandard

        self.sink, self.frame, self.held = sink, [], 0
        self.compressor = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.entries: list[tuple[int, int, int]] = []
        self.ids, self.lengths = [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.lengths.append(len(ids) // 4)
        view = memoryview(ids)
        while view:
            part = view[: 4 * FRAME_IDS - self.held]
            self.frame.append(part)
            self.held += len(part)
            view = view[len(part):]
            if self.held == 4 * FRAME_IDS:
                self._close_frame()

    def _close_frame(self) -> None:
        import xxhash

        raw = b"".join(self.frame)
        packed = self.compressor.compress(raw)
        self.sink.write(packed)
        self.entries.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.frame, self.held = [], 0

    def close(self) -> None:
        if self.held:
            self._close_frame()
        table = self.compressor.compress(
            np.array([x or 0 for x in self.ids], "<i8").tobytes() + np.array(self.lengths, "<u8").tobytes()
            + np.array([x is None for x in self.ids], "u1").tobytes())
        self.sink.write(struct.pack("<II", SKIPPABLE, len(table) + 8) + table + struct.pack("<Q", len(self.ids)))
        seek = b"".join(struct.pack("<III", *entry) for entry in self.entries)
        footer = struct.pack("<IBI", len(self.entries), CHECKSUM_FLAG, SEEK_MAGIC)
        self.sink.write(struct.pack("<II", SEEK_SKIPPABLE, len(seek) + len(footer)) + seek + footer)


class ShardReader:
    """Reads documents of a shard from a seekable file; decompresses only the frames they lie in."""

    def __init__(self, file, size: int):
        import zstandard

        self.file, self.expand = file, zstandard.ZstdDecompressor()
        frames, flag, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or flag != CHECKSUM_FLAG:
            raise ValueError("no seek table at the end of the file")
        seek_start = size - 9 - 12 * frames
        self.entries = np.frombuffer(self._at(seek_start, 12 * frames), "<u4").reshape(frames, 3)
        sizes = self.entries.astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(sizes[:, 0])])
        self.first = np.concatenate([[0], np.cumsum(sizes[:, 1] // 4)])
        start = int(self.offsets[-1])
        body = self._at(start, seek_start - 8 - start)
        magic, length = struct.unpack("<II", body[:8])
        if magic != SKIPPABLE or length != len(body) - 8:
            raise ValueError("broken document table")
        (docs,) = struct.unpack("<Q", body[-8:])
        raw = self.expand.decompress(body[8:-8], max_output_size=17 * docs + 1)
        self.doc_ids = np.frombuffer(raw[: 8 * docs], "<i8")
        self.lengths = np.frombuffer(raw[8 * docs: 16 * docs], "<u8").astype(np.int64)
        self.is_null = np.frombuffer(raw[16 * docs:], "u1").astype(bool)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1].astype(np.int64)
        self._frame = (-1, b"")

    def _at(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(length)

    def frame(self, number: int) -> bytes:
        """The ids of one frame, checked against the seek table."""
        import xxhash

        if self._frame[0] != number:
            packed, size, checksum = (int(x) for x in self.entries[number])
            raw = self.expand.decompress(self._at(int(self.offsets[number]), packed), max_output_size=size)
            if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != checksum:
                raise ValueError(f"frame {number} is damaged")
            self._frame = (number, raw)
        return self._frame[1]

    def parts(self, row: int) -> Iterator[bytes]:
        """The ids of the document in place ``row``, frame by frame."""
        at, end = int(self.starts[row]), int(self.starts[row] + self.lengths[row])
        number = int(np.searchsorted(self.first, at, "right")) - 1
        while at < end:
            stop = min(end, int(self.first[number + 1]))
            base = int(self.first[number])
            yield self.frame(number)[4 * (at - base): 4 * (stop - base)]
            at, number = stop, number + 1

    def document(self, doc_id: int) -> np.ndarray:
        """The ids of a requested document."""
        rows = np.flatnonzero((self.doc_ids == doc_id) & ~self.is_null)
        if not len(rows):
            raise KeyError(doc_id)
        return np.frombuffer(b"".join(self.parts(int(rows[0]))), "<u4")


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme that Spark gives a path without one: executors must not take it for their own disks."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file://") else whole


def _filesystem(folder: str):
    """The file system of a shared folder and the folder's path in it."""
    return pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def open_shard(path: str) -> ShardReader:
    system, name = _filesystem(path)
    file = system.open_input_file(name)
    return ShardReader(file, file.size())


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 0) -> str:
    """Encode every text of ``docs`` (doc_id, text; more columns are left out) and write the shards in ascending doc_id order.

    Returns the folder. A null text is empty, each document ends with ``end_id``; null ids come
    first, rows of one id follow each other by a hash of the text and the text. Ranges of
    (doc_id, hash) go to shards, so that no id can make one too large. Shards are written under a
    name of their own attempt and then renamed: a repeated task writes the same bytes again.
    An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    folder = _qualified(spark, folder or work_folder(spark, "token-files"))
    text = tokens.definition(tokenizer)
    end = struct.pack("<I", end_id)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"))
    ordered = keyed.repartitionByRange(parallelism(spark), "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text")

    def shard(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        number = context.partitionId()
        system, base = _filesystem(folder)
        system.create_dir(base, recursive=True)
        final, draft = f"{base}/shard-{number:06d}.ids", f"{base}/.shard-{number:06d}-{context.taskAttemptId()}"
        docs_in, ids_in = 0, 0
        sink = system.open_output_stream(draft)
        writer = ShardWriter(sink)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for doc_id, body in zip(ids, tokens.encoded(batch.column(1), text)):
                writer.add(doc_id, body + end)
                docs_in, ids_in = docs_in + 1, ids_in + len(body) // 4 + 1
        writer.close()
        sink.close()
        if docs_in:
            system.move(draft, final)
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([number], pa.int32()), "path": [f"{folder.rstrip('/')}/shard-{number:06d}.ids"],
                "n_docs": [docs_in], "n_ids": [ids_in]})
        else:
            system.delete_file(draft)

    ordered.mapInArrow(shard, _MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return folder


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard) of every document, taken from the shards' frames.

    ``start`` counts the ids of all documents before. The manifest has one row per shard, and only
    these few rows are summed in one place.
    """
    manifest = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")

    def documents(batches):
        for batch in batches:
            for number, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = open_shard(path)
                for low in range(0, len(reader.doc_ids), 10_000):
                    rows = range(low, min(low + 10_000, len(reader.doc_ids)))
                    sums = []
                    for row in rows:
                        crc = 0
                        for part in reader.parts(row):
                            crc = zlib.crc32(part, crc)
                        sums.append(crc)
                    picked = slice(rows.start, rows.stop)
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(reader.doc_ids[picked], pa.int64(), mask=reader.is_null[picked]),
                        "shard": pa.array([number] * len(rows), pa.int32()),
                        "local_start": reader.starts[picked], "n_tokens": reader.lengths[picked],
                        "ids_crc32": pa.array(sums, pa.int64())})

    base = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = manifest.select("shard", base.alias("base"))
    found = manifest.select("shard", "path").repartition(parallelism(spark)).mapInArrow(documents, _DOCUMENT)
    return found.join(bases, "shard").select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", "shard")

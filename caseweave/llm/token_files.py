"""Token ids in seekable zstandard files.

A file is a row of independent zstandard frames, each of whole documents and
with its own content checksum, followed by two skippable frames that ordinary
zstandard readers pass over:

* document index: for each document its id, whether the id is null, and its
  number of ids (the arrays one after the other, compressed), with a crc32;
* seek table in the public seekable format: compressed size, decompressed size
  and low half of the xxh64 of the content per frame, then the footer.

A reader fetches the end of the file, then the frames that hold the documents
it wants, and checks each frame against the table.

Files are written by the tasks of one range partitioning by document id, under
names no other attempt uses; the written table of files tells which count. So
a task that runs twice leaves a file that nobody reads.

Defined cases: a null or empty text is a document of one id (the end id); null
ids come first; rows of one id stand side by side in the order of their text's
hash; an empty table gives no files. Other columns of the input are not read.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseweave.llm.common import files_dir, filesystem, load, materialise
from caseweave.llm.tokens import as_bytes, batches, default_vocabulary, worker_encoder

END_ID = 1
FRAME_BYTES = 1 << 18
# Fixed values of the seekable format.
SKIPPABLE_TABLE = 0x184D2A5E
SKIPPABLE_INDEX = 0x184D2A50
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUMS = 0x80


class Writer:
    """Writes documents of ids to *sink*; ``close`` adds index and seek table."""

    def __init__(self, sink, frame_bytes: int = FRAME_BYTES, level: int = 3):
        import zstandard

        self.sink, self.frame_bytes = sink, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames, self.docs, self.parts, self.pending = [], [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        raw = ids.astype("<u4", copy=False).tobytes()
        self.docs.append((doc_id, len(ids)))
        self.parts.append(raw)
        self.pending += len(raw)
        if self.pending >= self.frame_bytes:
            self._flush()

    def _flush(self) -> None:
        import xxhash

        if not self.parts:
            return
        raw = b"".join(self.parts)
        packed = self.zstd.compress(raw)
        self.sink.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.parts, self.pending = [], 0

    def close(self) -> None:
        self._flush()
        ids = np.array([0 if d is None else d for d, _ in self.docs], "<i8")
        nulls = np.array([d is None for d, _ in self.docs], "u1")
        sizes = np.array([n for _, n in self.docs], "<u4")
        plain = ids.tobytes() + nulls.tobytes() + sizes.tobytes()
        body = struct.pack("<II", len(self.docs), zlib.crc32(plain)) + self.zstd.compress(plain)
        self.sink.write(struct.pack("<II", SKIPPABLE_INDEX, len(body)) + body)
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        table += struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_TABLE, len(table)) + table)
        # where the index begins, for readers that fetch the end first
        self.index_bytes = 8 + len(body)


class Damaged(ValueError):
    """A part of the file does not match its checksum."""


class Reader:
    """Reads documents of a file by place or by id; fetches only the frames they are in."""

    def __init__(self, source):
        import zstandard

        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        source.seek(0, io.SEEK_END)
        end = source.tell()
        count, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUMS:
            raise Damaged("no seek table")
        begin = end - 9 - 12 * count - 8
        entries = np.frombuffer(self._at(begin + 8, 12 * count), "<u4").reshape(count, 3)
        self.packed, self.raw, self.sums = (entries[:, i].astype(np.int64) for i in range(3))
        self.at = np.cumsum(self.packed) - self.packed
        self.raw_ends = np.cumsum(self.raw)
        index = int(self.packed.sum())
        kind, size = struct.unpack("<II", self._at(index, 8))
        body = self._at(index + 8, size)
        n, crc = struct.unpack("<II", body[:8])
        plain = self.zstd.decompress(body[8:], max_output_size=13 * n + 1)
        if kind != SKIPPABLE_INDEX or zlib.crc32(plain) != crc:
            raise Damaged("document index")
        self.ids = np.frombuffer(plain, "<i8", n)
        self.nulls = np.frombuffer(plain, "u1", n, 8 * n).astype(bool)
        self.sizes = np.frombuffer(plain, "<u4", n, 9 * n).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self._held = (-1, b"")

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def _frame(self, i: int) -> bytes:
        import xxhash
        import zstandard

        if self._held[0] != i:
            try:
                raw = self.zstd.decompress(self._at(int(self.at[i]), int(self.packed[i])))
            except zstandard.ZstdError as e:
                raise Damaged(f"frame {i}") from e
            if len(raw) != self.raw[i] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[i]:
                raise Damaged(f"frame {i}")
            self._held = (i, raw)
        return self._held[1]

    def document(self, place: int) -> np.ndarray:
        """Ids of the document at *place*; decompresses one frame."""
        first = 4 * int(self.starts[place])
        i = int(np.searchsorted(self.raw_ends, first, "right"))
        begin = first - int(self.raw_ends[i] - self.raw[i])
        return np.frombuffer(self._frame(i), "<u4", int(self.sizes[place]), begin)

    def find(self, doc_id: int | None) -> list[int]:
        """Places of the documents with this id."""
        match = self.nulls if doc_id is None else (self.ids == doc_id) & ~self.nulls
        return np.flatnonzero(match).tolist()


def write(docs: DataFrame, folder: str, vocabulary: str, id_col: str = "doc_id",
          text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write files below *folder*; one row per file, in document order, itself written."""

    def run(tables: Iterator):
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, where = worker_encoder(vocabulary), filesystem(folder)
        store, base = where
        store.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.ids.zst"
        part, n_docs, n_ids = TaskContext.get().partitionId(), 0, 0
        with store.open_output_stream(f"{base}/{name}", compression=None) as sink:
            out = Writer(sink)
            for table in tables:
                texts, names = as_bytes(table.column("t")), table.column("d").to_pylist()
                for a, b in batches(texts):
                    ids, sizes = encoder.encode(texts[a:b])
                    at = 0
                    for d, n in zip(names[a:b], sizes.tolist()):
                        out.add(d, np.append(ids[at : at + n], np.uint32(end_id)))
                        at += n
                        n_docs, n_ids = n_docs + 1, n_ids + n + 1
            out.close()
        if n_docs:
            yield pa.RecordBatch.from_pydict(
                {"part": [part], "name": [name], "n_docs": [n_docs], "n_ids": [n_ids]},
                pa.schema([("part", pa.int64()), ("name", pa.string()), ("n_docs", pa.int64()),
                           ("n_ids", pa.int64())]),
            )
        else:
            store.delete_file(f"{base}/{name}")

    rows = (
        docs.select(F.col(id_col).cast("long").alias("d"), F.col(text).alias("t"))
        .repartitionByRange(F.col("d").asc_nulls_first())
        .sortWithinPartitions(F.col("d").asc_nulls_first(), F.xxhash64("t"))
    )
    return materialise(
        rows.mapInArrow(run, "part long, name string, n_docs long, n_ids long"), "token-files"
    )


def read(files: DataFrame, folder: str, ids: bool = True) -> DataFrame:
    """Documents of the files: id, start, n_tokens, ids (little-endian 32-bit) and their crc32.

    One task reads a file, frame by frame; *ids* false leaves the ids out.
    """
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per file
    placed = files.withColumn("base", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))
    n_files = max(1, files.count())

    def run(tables: Iterator):
        import pyarrow as pa

        store, path = filesystem(folder)
        kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                 ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * ids
        for table in tables:
            for name, base in zip(table.column("name").to_pylist(), table.column("base").to_pylist()):
                with store.open_input_file(f"{path}/{name}") as source:
                    reader = Reader(source)
                    for first in range(0, len(reader.ids), 2000):
                        places = range(first, min(first + 2000, len(reader.ids)))
                        raw = [reader.document(i).tobytes() for i in places]
                        columns = [
                            pa.array(reader.ids[places], mask=reader.nulls[places]),
                            pa.array(base + reader.starts[places]), pa.array(reader.sizes[places]),
                            pa.array([zlib.crc32(r) for r in raw], pa.int64()),
                        ]
                        yield pa.RecordBatch.from_arrays(
                            columns + [pa.array(raw, pa.binary())] * ids, schema=pa.schema(kinds)
                        )

    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids
    return placed.select("name", "base").repartition(n_files).mapInArrow(run, kind)


def op8_seekable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = files_dir(spark, "ids")
    files = write(load(spark, sf_dir, "documents"), folder, default_vocabulary())
    return read(files, folder, ids=False)

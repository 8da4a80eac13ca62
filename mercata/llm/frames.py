"""Token files: independent zstandard frames, a document index and a trailing seek table.

A file is a row of zstandard frames, each with the ids of some whole documents as
little-endian unsigned 32-bit numbers, then one frame with the index of its documents,
then a skippable frame with the seek table in the published seekable format: compressed
size, size and checksum of every frame. A reader takes the table from the end of the
file, the index from the last frame, and decompresses only frames it needs.
"""

import struct
import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import shared_dir
from .arrays import forget
from .tokens import encoded

# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

FRAME_IDS = 1 << 16  # a frame is closed when it holds so many ids
LEVEL = 3
INDEX = np.dtype([("doc_id", "<i8"), ("known", "<i8"), ("start", "<i8"), ("n_tokens", "<i8"),
                  ("frame", "<i8"), ("at", "<i8")])

MANIFEST = "part long, file string, n_docs long, n_tokens long, n_bytes long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids binary"


def _checksum(data):
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class FrameWriter:
    """Writes documents in the given order to one open stream."""

    def __init__(self, stream, level=LEVEL, frame_ids=FRAME_IDS):
        self.stream, self.frame_ids = stream, frame_ids
        self.compress = zstandard.ZstdCompressor(level=level, write_checksum=True).compress
        self.table, self.index, self.open, self.held, self.total = [], [], [], 0, 0

    def _frame(self, data):
        packed = self.compress(data)
        self.stream.write(packed)
        self.table.append((len(packed), len(data), _checksum(data)))

    def add(self, doc_id, ids):
        n = len(ids) // 4
        self.index.append((doc_id or 0, doc_id is not None, self.total, n, len(self.table), self.held))
        self.open.append(ids)
        self.held += n
        self.total += n
        if self.held >= self.frame_ids:
            self.flush()

    def flush(self):
        if self.open:
            self._frame(b"".join(self.open))
            self.open, self.held = [], 0

    def close(self):
        self.flush()
        self._frame(np.array(self.index, INDEX).tobytes())
        entries = b"".join(struct.pack("<III", *entry) for entry in self.table)
        footer = struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer)


class FrameReader:
    """Reads the index, and the frames of the documents that are asked for."""

    def __init__(self, source):
        self.source, size = source, source.size()
        count, flag, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC or flag != CHECKSUM_FLAG:
            raise ValueError("no seek table at the end of the file")
        raw = source.read_at(12 * count, size - 9 - 12 * count)
        self.table = np.frombuffer(raw, "<u4").reshape(count, 3).astype(np.int64)
        self.place = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        self.decompress = zstandard.ZstdDecompressor().decompress
        self.index = np.frombuffer(self.frame(count - 1), INDEX)

    def frame(self, i):
        data = self.decompress(self.source.read_at(int(self.table[i, 0]), int(self.place[i])))
        if len(data) != self.table[i, 1] or _checksum(data) != self.table[i, 2]:
            raise ValueError(f"frame {i} is damaged")
        return data

    def documents(self, wanted=None):
        """(doc_id, start, ids) of all documents, or of the wanted doc_ids, in file order."""
        rows = self.index if wanted is None else self.index[
            np.isin(self.index["doc_id"], list(wanted)) & (self.index["known"] == 1)]
        held, data = -1, b""
        for row in rows:
            if row["frame"] != held:
                held = int(row["frame"])
                data = self.frame(held)
            at = 4 * int(row["at"])
            doc_id = int(row["doc_id"]) if row["known"] else None
            yield doc_id, int(row["start"]), data[at:at + 4 * int(row["n_tokens"])]


def in_order(docs, id_col, text_col, *keys):
    """Rows in ranges of (keys, doc_id, text), sorted inside; equal ids are split too."""
    tie = F.xxhash64("text")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), *keys)
    return rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text")


def write_tokens(docs, folder, tokenizer_path, end_id=2, id_col="doc_id", text_col="text",
                 level=LEVEL, frame_ids=FRAME_IDS):
    """Encode every text, append `end_id` and write token files in ascending doc_id order.

    `folder` is a path or URI that all workers share. A task writes its file under a name
    of its own and renames it when it is whole, so a repeated task replaces a file by the
    same file. Nulls: a null text is empty (only the end id), null doc_ids come first.
    Rows with equal doc_ids stand side by side; a table without rows writes no file.

    Returns the manifest, one row per file (part, file, n_docs, n_tokens, n_bytes), which
    is also stored as Parquet beside the files.
    """
    end = struct.pack("<I", end_id)

    def run(batches):
        writer = None
        system, base = fs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        part = context.partitionId()
        name, own = f"part-{part:07d}.tokens", f"_part-{part:07d}-{uuid.uuid4().hex}"
        stream = None
        for batch in batches:
            if writer is None and batch.num_rows:
                system.create_dir(base, recursive=True)
                stream = system.open_output_stream(f"{base}/{own}")
                writer = FrameWriter(stream, level, frame_ids)
            for part_of, found in encoded(batch, 1, tokenizer_path):
                for doc_id, ids in zip(part_of.column(0).to_pylist(), found, strict=True):
                    writer.add(doc_id, ids + end)
        if writer is None:
            return
        writer.close()
        size = stream.tell()
        stream.close()
        system.move(f"{base}/{own}", f"{base}/{name}")
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int64()), "file": [name],
            "n_docs": pa.array([len(writer.index)], pa.int64()),
            "n_tokens": pa.array([writer.total], pa.int64()), "n_bytes": pa.array([size], pa.int64())})
        forget()

    written = in_order(docs, id_col, text_col).mapInArrow(run, MANIFEST)
    written.write.mode("overwrite").parquet(f"{folder}/manifest")
    return docs.sparkSession.read.parquet(f"{folder}/manifest")


def read_tokens(spark, folder, wanted=None):
    """Documents of token files: doc_id, start (ids before it in the folder), n_tokens, ids.

    `wanted` limits the documents; only their frames are decompressed. `ids` holds
    little-endian unsigned 32-bit numbers. The manifest has one row per file.
    """
    def run(batches):
        system, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, before in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                with system.open_input_file(f"{base}/{name}") as source:
                    rows, size = [], 0
                    for doc_id, start, ids in FrameReader(source).documents(wanted):
                        rows.append((doc_id, before + start, len(ids) // 4, ids))
                        size += len(ids)
                        if size > 1 << 22:
                            yield _documents(rows)
                            rows, size = [], 0
                    if rows:
                        yield _documents(rows)

    manifest = spark.read.parquet(f"{folder}/manifest")
    files = manifest.count()
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    parts = manifest.select("file", before.alias("before")).repartition(max(files, 1))
    return parts.mapInArrow(run, DOCUMENTS)


def _documents(rows):
    doc_id, start, n, ids = zip(*rows, strict=True)
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array(doc_id, pa.int64()), "start": pa.array(start, pa.int64()),
        "n_tokens": pa.array(n, pa.int64()), "ids": pa.array(ids, pa.binary())})


def new_folder(spark):
    """A folder for token files in the shared folder of the cluster."""
    return shared_dir(spark, f"tokens/{uuid.uuid4().hex}")

"""Packing along a Hilbert curve: neighbouring documents share sequences."""

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from .arrays import forget, slices, word_units, words
from .tokens import encoded

BUCKETS = 1024  # hashed words of a document vector
DIMENSIONS = 4
BITS = 8  # of each coordinate on the curve

PIECES = ("doc_id long, start long, length long, ids binary, doc_tokens long, "
          "sequence_id long, offset long")


def hilbert_index(points, bits):
    """Position on the Hilbert curve of points with integer coordinates below 2^bits.

    Gray-code form: walk the bits from the top, undo the rotation and reflection that
    the upper bits impose on the lower ones, then read the bits crosswise.
    """
    x = points.astype(np.int64).copy()
    n = x.shape[1]
    for level in range(bits - 1, 0, -1):
        q = 1 << level
        low = q - 1
        for i in range(n):
            turned = (x[:, i] & q) != 0
            swap = np.where(turned, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(turned, low, swap)
            if i:
                x[:, i] ^= swap
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), np.int64)
    for level in range(bits - 1, 0, -1):
        q = 1 << level
        flip ^= np.where((x[:, n - 1] & q) != 0, q - 1, 0)
    x ^= flip[:, None]
    index = np.zeros(len(x), np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << 1) | ((x[:, i] >> level) & 1)
    return index


def _projection(dimensions):
    return np.random.default_rng(7).standard_normal((BUCKETS, dimensions))


def curve_keys(column, dimensions=DIMENSIONS, bits=BITS):
    """Hilbert key of each text: hashed word counts, projected to few dimensions."""
    project = _projection(dimensions)
    keys = []
    for _, offsets, data in slices(column):
        n = len(offsets) - 1
        spots = words(offsets, data)
        bucket = (word_units(data, spots) >> np.uint64(54)).astype(np.int64)
        doc = np.repeat(np.arange(n), np.diff(spots.offsets))
        for at in range(0, n, 512):  # a dense block of vectors at a time
            some = slice(*np.searchsorted(doc, [at, at + 512]))
            size = min(512, n - at)
            counts = np.bincount((doc[some] - at) * BUCKETS + bucket[some], minlength=size * BUCKETS)
            vector = np.sqrt(counts.reshape(size, BUCKETS))
            norm = np.sqrt(np.maximum((vector * vector).sum(1), 1))
            spot = np.round((vector @ project) / norm[:, None], 9)  # about standard normal
            cell = np.clip((np.tanh(spot * 0.8) + 1) * (1 << (bits - 1)), 0, (1 << bits) - 1)
            keys.append(hilbert_index(cell.astype(np.int64), bits))
    return np.concatenate(keys) if keys else np.zeros(0, np.int64)


def binary_parts(n):
    """n as a sum of falling powers of two."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack(docs, tokenizer_path, end_id=1, sequence_tokens=2048, id_col="doc_id", text_col="text",
         dimensions=DIMENSIONS, bits=BITS):
    """Cut all documents into sequences of at most `sequence_tokens` ids.

    Documents become hashed word vectors, are projected to `dimensions` numbers and
    range-sorted by their Hilbert key (equal keys by doc_id, so copies are spread over
    ranges), and each range is packed along the curve: a document goes on where the one
    before it ended. The keys are made before the shuffle, which samples them, and the
    ids after it, so no text is encoded twice. The last ids of a range, fewer than a
    sequence, form sequences whose lengths are powers of two, which need no padding.

    Returns pieces (doc_id, start: ids of the document before it, length, ids as
    little-endian unsigned 32-bit numbers, doc_tokens with the end id, sequence_id,
    offset in the sequence). Every id lies in exactly one piece. A null or empty text is
    the end id alone; a null doc_id stays null; equal rows are packed one by one; an
    empty table gives no rows; other columns are left out.
    """
    end = struct.pack("<I", end_id)

    def keyed(batches):
        for batch in batches:
            keys = curve_keys(batch.column(1), dimensions, bits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys)], ["doc_id", "text", "key"])
        forget()

    def run(batches):
        base, made, filled = TaskContext.get().partitionId() << 33, 0, 0
        done, held = [], []  # pieces of whole sequences, of the one that is open
        for batch in batches:
            for part, found in encoded(batch, 1, tokenizer_path):
                for doc_id, ids in zip(part.column(0).to_pylist(), found, strict=True):
                    ids += end
                    total, start = len(ids) // 4, 0
                    while start < total:
                        n = min(total - start, sequence_tokens - filled)
                        held.append((doc_id, start, n, ids[4 * start:4 * (start + n)], total, base + made, filled))
                        start, filled = start + n, filled + n
                        if filled == sequence_tokens:
                            done, held, made, filled = done + held, [], made + 1, 0
                if done:
                    yield _pieces(done)
                    done = []
        if held:
            yield _pieces(_recut(held, base + made, filled))
        forget()

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    tie = F.xxhash64("text")
    ranged = rows.mapInArrow(keyed, "doc_id long, text string, key long") \
        .repartitionByRange("key", "doc_id", tie).sortWithinPartitions("key", "doc_id", tie, "text")
    return ranged.mapInArrow(run, PIECES)


def _recut(pieces, sequence, filled):
    """The pieces of an open sequence, cut again into lengths that are powers of two."""
    bounds = np.cumsum(binary_parts(filled)).tolist()
    out, at, before = [], 0, 0
    for doc_id, start, n, ids, total, _, _ in pieces:
        taken = 0
        while taken < n:
            m = min(n - taken, bounds[at] - before)
            inside = before - (bounds[at - 1] if at else 0)
            out.append((doc_id, start + taken, m, ids[4 * taken:4 * (taken + m)], total, sequence + at, inside))
            taken, before = taken + m, before + m
            at += before == bounds[at]
    return out


def _pieces(rows):
    names = [c.split()[0] for c in PIECES.split(", ")]
    kinds = [pa.binary() if c == "ids" else pa.int64() for c in names]
    return pa.RecordBatch.from_arrays(
        [pa.array(v, kind) for v, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

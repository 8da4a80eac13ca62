"""Quality classifier: nearest neighbours among labelled latent-semantic vectors."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .arrays import mix, range_hashes, running_bytes, slices, word_units, words
from .sketch import lowered

WORD_BUCKETS, SHAPE_BUCKETS = 1024, 1024
DIMENSIONS = 64
LABELLED_ROWS = 5_000  # at most so many labelled documents vote
NEIGHBOURS = 25
BLOCK = 512  # documents whose cosines are computed at once
POWER = 8.0

# Byte classes of a word's shape; other bytes stand for themselves.
LOWER, UPPER, DIGIT = 97, 65, 48


def _shape_bytes(data):
    shape = data.copy()
    shape[((data >= 97) & (data <= 122)) | (data >= 128)] = LOWER
    shape[(data >= 65) & (data <= 90)] = UPPER
    shape[(data >= 48) & (data <= 57)] = DIGIT
    return shape


def _shape_units(data, spots):
    """Hash of each word's shape: its byte classes, runs of one class taken together."""
    shape = _shape_bytes(data)
    new = np.ones(len(shape), bool)
    new[1:] = shape[1:] != shape[:-1]
    new[spots.start] = True
    at = np.concatenate([[0], np.cumsum(new)])
    sums, down = running_bytes(shape[new])
    return range_hashes(sums, at[spots.start], at[spots.end], down)


def vectors(column):
    """Hashed vectors of texts in blocks: (first row, rows x buckets).

    One part holds words, the other their shapes and whether a word repeats the one
    before it. Entries are square roots of shares, so each part has length one.
    """
    for row, offsets, data in slices(column):
        n = len(offsets) - 1
        spots = words(offsets, data)
        doc = np.repeat(np.arange(n), np.diff(spots.offsets))
        word = word_units(lowered(data), spots)
        shape = _shape_units(data, spots) if len(data) else word
        again = np.zeros(len(word), bool)
        again[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
        shape = np.where(again, mix(shape + np.uint64(1)), shape)
        for at in range(0, n, BLOCK):
            size = min(BLOCK, n - at)
            some = slice(*np.searchsorted(doc, [at, at + size]))
            total = np.maximum(np.diff(spots.offsets)[at:at + size], 1)[:, None]
            parts = []
            for units, buckets in ((word, WORD_BUCKETS), (shape, SHAPE_BUCKETS)):
                bucket = (units[some] >> np.uint64(32)) % np.uint64(buckets)
                counts = np.bincount((doc[some] - at) * buckets + bucket.astype(np.int64), minlength=size * buckets)
                parts.append(np.sqrt(counts.reshape(size, buckets) / total).astype(np.float32))
            yield row + at, np.hstack(parts)


class Voters:
    """Labelled documents in the latent space, and the way into it."""

    def __init__(self, matrix, quality, dimensions=DIMENSIONS):
        share = (matrix > 0).mean(0) if len(matrix) else np.zeros(WORD_BUCKETS + SHAPE_BUCKETS)
        self.weight = np.log1p(1.0 / np.maximum(share, 1.0 / max(len(matrix), 1))).astype(np.float32)
        self.basis = self._basis(matrix * self.weight, dimensions) if len(matrix) else None
        self.points = self.project(matrix) if len(matrix) else None
        self.quality = quality.astype(np.float32)
        self.prior = float(quality.mean()) if len(quality) else 0.5

    @staticmethod
    def _basis(matrix, dimensions):
        """Right singular vectors, by subspace iteration from a fixed start."""
        k = min(dimensions, *matrix.shape)
        basis = np.random.default_rng(11).standard_normal((matrix.shape[1], k)).astype(np.float32)
        for _ in range(8):
            basis, _ = np.linalg.qr(matrix.T @ (matrix @ basis))
        _, _, rotation = np.linalg.svd(matrix @ basis, full_matrices=False)
        return (basis @ rotation.T).astype(np.float32)

    def project(self, matrix):
        points = (matrix * self.weight) @ self.basis
        length = np.linalg.norm(points, axis=1, keepdims=True)
        return np.where(length > 1e-6, points / np.maximum(length, 1e-6), 0).astype(np.float32)

    def scores(self, matrix, neighbours, power):
        """Share of label 1 among the nearest, weighted by a power of the cosine."""
        if self.points is None:
            return np.full(len(matrix), self.prior)
        cosine = self.project(matrix) @ self.points.T
        k = min(neighbours, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** power
        total = weight.sum(1)
        voted = (weight * self.quality[near]).sum(1) / np.maximum(total, 1e-12)
        return np.clip(np.where(total > 1e-9, voted, self.prior), 0, 1)


def train(docs, labels, learn, id_col="doc_id", text_col="text", label_col="quality",
          labelled_rows=LABELLED_ROWS, dimensions=DIMENSIONS):
    """Voters from labelled documents for which the column `learn` of `labels` holds.

    At most `labelled_rows` labels, the first by hash of their id, vote; that bounds the
    vectors on the driver and in the broadcast. Labels with a null id or value or
    without a document are left out; a null text is empty.
    """
    some = labels.where(learn).select(labels[id_col].cast("long").alias("_id"),
                                      labels[label_col].cast("int").alias("_label")) \
        .where("_id IS NOT NULL AND _label IS NOT NULL") \
        .orderBy(F.xxhash64("_id"), "_id", "_label").limit(labelled_rows)
    texts = docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].cast("string").alias("_text"))

    def run(batches):
        for batch in batches:
            for row, matrix in vectors(batch.column(2)):
                part = batch.slice(row, len(matrix))
                packed = [v.tobytes() for v in matrix.astype(np.float16)]
                yield pa.RecordBatch.from_pydict({"_id": part.column(0), "_label": part.column(1),
                                                  "vector": pa.array(packed, pa.binary())})
    # broadcast: at most labelled_rows rows of two numbers
    known = texts.join(F.broadcast(some), "_id").select("_id", "_label", "_text")
    table = known.mapInArrow(run, "_id long, _label int, vector binary").orderBy("_id", "_label", "vector").toArrow()
    matrix = np.array([np.frombuffer(v, np.float16) for v in table.column("vector").to_pylist()], np.float32)
    matrix = matrix.reshape(-1, WORD_BUCKETS + SHAPE_BUCKETS)
    return Voters(matrix, (table.column("_label").to_numpy() == 1).astype(np.float64), dimensions)


def score(docs, voters, id_col="doc_id", text_col="text", cut=0.3, neighbours=NEIGHBOURS, power=POWER):
    """Quality of every whole text by similarity-weighted votes of its nearest neighbours.

    Cosines with all voters are computed exactly, a block of documents at a time.
    Returns doc_id, score (0 to 1) and predicted (1 if score >= cut), one row per input
    row, without a shuffle. A null or empty text, or one like no voter, gets the share of
    label 1 among the voters (0.5 without voters). Equal texts get equal scores up to the
    rounding of floats; a null doc_id stays null; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    def run(batches):
        known = shared.value
        for batch in batches:
            for row, matrix in vectors(batch.column(1)):
                value = np.round(known.scores(matrix, neighbours, power), 6)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).slice(row, len(matrix)), "score": pa.array(value, pa.float64()),
                    "predicted": pa.array((value >= cut).astype(np.int32), pa.int32())})
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")

"""Embedding whitening with a covariance over distinct vectors, weighted by multiplicity or by one.

Equal vectors are grouped, the distinct ones are written once to the shared folder with
their counts, and every later pass (sums, centred products, whitening, the check) reads
only those; the whitened vectors are then joined back to the rows.
"""

import decimal
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from ..session import shared_dir

SCALE, SHIFT = 64, 1_000_000  # x = floor(SCALE * c) + SHIFT
COMPONENTS = 16
LARGEST = float(1 << 52)  # beyond it SCALE * c is no exact whole number
LEAST_SHARE = 1e-10  # of the largest eigenvalue; below it a double has too few digits left
BLOCK = 2048  # vectors in one product


def quantised(rows, id_col="vec_id", vector_col="embedding"):
    """(vec_id, x, key): whole-number vectors of the rows whose entries are all finite.

    The key is the SHA-256 of the vector, which stands for it in the join back.
    """
    entries = F.col("_v")
    whole = F.transform(entries, lambda c: F.floor(c * SCALE) + F.lit(SHIFT).cast("long"))
    fine = F.forall(entries, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) * SCALE < LARGEST), F.lit(False)))
    return rows.select(rows[id_col].cast("long").alias("vec_id"), rows[vector_col].cast("array<double>").alias("_v")) \
        .where(F.col("_v").isNotNull() & fine).select("vec_id", whole.alias("x")) \
        .withColumn("key", F.unhex(F.sha2(F.array_join("x", ",").cast("binary"), 256)))


def distinct_vectors(rows, weights, folder):
    """Each x vector once with its weight and key, written to `folder` and read back."""
    weight = {"one": F.lit(1).cast("long"), "counts": F.col("count")}[weights]
    rows.groupBy("x", "key").count() \
        .select(F.size("x").alias("dims"), "x", "key", weight.alias("weight")).write.parquet(folder)
    return rows.sparkSession.read.parquet(folder)


def _blocks(batch):
    """(dims, matrix of x, weights, rows of the batch) for blocks of vectors of one length."""
    offsets = list_offsets(batch.column("x"))
    values = batch.column("x").values.to_numpy(zero_copy_only=False)
    weight = batch.column("weight").to_numpy()
    length = np.diff(offsets)
    for dims in np.unique(length).tolist():
        of = np.flatnonzero(length == dims)
        for at in range(0, len(of) if dims else 0, BLOCK):
            rows = of[at:at + BLOCK]
            yield dims, values[offsets[rows][:, None] + np.arange(dims)], weight[rows], rows


def list_offsets(lists):
    wide = pa.types.is_large_list(lists.type)
    raw = np.frombuffer(lists.buffers()[1], np.int64 if wide else np.int32)
    return raw[lists.offset:lists.offset + len(lists) + 1].astype(np.int64)


class Fit:
    """Sums, centre and components of the vectors of one length."""

    def __init__(self, n, sums):
        self.n, self.sums = n, sums  # exact whole numbers
        self.centre = np.array([round(s / n) if abs(s) < 1 << 52 else s // n for s in sums], np.int64)
        self.rest = np.array([float(decimal.Decimal(s - int(c) * n) / n)
                              for s, c in zip(sums, self.centre.tolist(), strict=True)])
        self.basis = self.share = None
        self.error = 0.0

    def centred(self, x):
        """x - S/n, to the last bits: the whole part is taken off first."""
        return (x - self.centre) - self.rest

    def solve(self, products, components):
        covariance = products / self.n
        value, vector = np.linalg.eigh((covariance + covariance.T) / 2)
        value, vector = value[::-1], vector[:, ::-1]
        kept = np.flatnonzero(value > max(value[0], 0) * LEAST_SHARE)[:components]
        value, vector = value[kept], vector[:, kept]
        vector *= np.where(vector[np.abs(vector).argmax(0), np.arange(len(kept))] < 0, -1, 1)
        self.basis = vector / np.sqrt(value)
        self.share = value / np.trace(covariance)

    def deviations(self, x):
        """Sum over dimensions of (n x - S)^2 as whole numbers."""
        near = x - self.centre
        rest = [s - int(c) * self.n for s, c in zip(self.sums, self.centre.tolist(), strict=True)]
        most = (int(np.abs(near).max(initial=0)) + 1) * self.n
        if most * most * max(x.shape[1], 1) < 1 << 62:
            return (((near * self.n) - np.array(rest, np.int64)) ** 2).sum(1).tolist()
        wide = near.astype(object) * self.n - np.array(rest, object)
        return (wide * wide).sum(1).tolist()


def fit(vectors, components=COMPONENTS):
    """Fits by vector length. What reaches the driver has the size of one covariance matrix.

    Tasks send sums and upper triangles, Spark adds them up.
    """
    def sums(batches):
        total = {}
        for batch in batches:
            for dims, x, w, _ in _blocks(batch):
                n, s = total.get(dims, (0, 0))
                small = int(np.abs(x).max()) * int(w.sum()) < 1 << 62
                part = w @ x if small else (x.astype(object) * w[:, None]).sum(0)
                total[dims] = n + int(w.sum()), s + part.astype(object)
        for dims, (n, s) in total.items():
            yield pa.RecordBatch.from_arrays([
                pa.array([dims] * dims, pa.int32()), pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()),
                pa.array([decimal.Decimal(int(v)) for v in s], pa.decimal128(38, 0))], ["dims", "i", "n", "s"])

    some = vectors.select("dims", "x", "weight")
    added = some.mapInArrow(sums, "dims int, i int, n long, s decimal(38,0)") \
        .groupBy("dims", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    fits = {}
    for dims in sorted({r.dims for r in added}):
        own = sorted((r for r in added if r.dims == dims), key=lambda r: r.i)
        fits[dims] = Fit(own[0].n, [int(r.s) for r in own])
    for dims, matrix in _products(some, fits, lambda f, x: f.centred(x), lambda dims: dims).items():
        fits[dims].solve(matrix, components)
    turned = _products(some, fits, lambda f, x: f.centred(x) @ f.basis, lambda dims: fits[dims].basis.shape[1], True)
    for dims, matrix in turned.items():
        if fits[dims].basis.shape[1]:
            # the last row and column hold the sums, from which the means come
            mean = matrix[-1, :-1] / fits[dims].n
            covariance = matrix[:-1, :-1] / fits[dims].n - np.outer(mean, mean)
            fits[dims].error = float(np.abs(covariance - np.eye(len(covariance))).max())
    return fits


def _products(vectors, fits, turn, size, with_sums=False):
    """Weighted sums of outer products of `turn`ed vectors, by vector length."""
    shared = vectors.sparkSession.sparkContext.broadcast(fits)  # one matrix per length at most

    def run(batches):
        total = {}
        for batch in batches:
            for dims, x, w, _ in _blocks(batch):
                y = turn(shared.value[dims], x)
                if with_sums:
                    y = np.hstack([y, np.ones((len(y), 1))])
                total[dims] = total.get(dims, 0) + (y * w[:, None]).T @ y
        for dims, matrix in total.items():
            i, j = np.triu_indices(len(matrix))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(i), dims, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                pa.array(matrix[i, j])], ["dims", "i", "j", "v"])
    table = vectors.mapInArrow(run, "dims int, i int, j int, v double") \
        .groupBy("dims", "i", "j").agg(F.sum("v").alias("v")).toArrow()
    out = {}
    for dims in np.unique(table.column("dims").to_numpy()).tolist():
        own = table.filter(pc.equal(table.column("dims"), dims))
        matrix = np.zeros((size(dims) + with_sums,) * 2)
        i, j = own.column("i").to_numpy(), own.column("j").to_numpy()
        matrix[i, j] = matrix[j, i] = own.column("v").to_numpy()
        out[dims] = matrix
    return out


def whiten(rows, id_col="vec_id", vector_col="embedding", weights="one", components=COMPONENTS):
    """Whitened coordinates of every vector, up to `components` of them, one row for each.

    x = floor(64 c) + 1,000,000 for each entry c. The fit list has each distinct x vector
    with weight one, or with its number of rows (`weights="counts"`); n is the sum of the
    weights and S their weighted sum of x. The covariance is centred before multiplying,
    divided by n. Returns vec_id, component (from 1, by falling eigenvalue), n, deviation
    (sum of (n x - S)^2, exact), whitened ((x - S/n) on the unit eigenvector over the root
    of its eigenvalue), explained (eigenvalue over trace) and identity_error (largest entry
    of the whitened covariance minus the identity, from a pass over the whitened vectors).

    Left out are rows whose vector is null, holds a null or non-finite entry, or an entry
    of 2^46 or more, which has no exact x. Components whose eigenvalue is below 1e-10 of
    the largest, where doubles lose their digits, do not exist; equal vectors only, one vector, an empty vector or
    an empty table give no rows. Vectors of different lengths are spaces of their own.
    Equal rows each return; a null vec_id stays null; other columns are left out. The
    distinct vectors lie in the folder of spark.checkpoint.dir; the caller removes them.
    """
    spark = rows.sparkSession
    known = quantised(rows, id_col, vector_col)
    vectors = distinct_vectors(known, weights, shared_dir(spark, f"whitening/{uuid.uuid4().hex}"))
    fits = fit(vectors, components)
    shared = spark.sparkContext.broadcast(fits)

    def run(batches):
        for batch in batches:
            for dims, x, _, of in _blocks(batch):
                f = shared.value[dims]
                k = f.basis.shape[1]
                if not k:
                    continue
                spots = np.arange(len(x) + 1, dtype=np.int32) * k
                values = pa.ListArray.from_arrays(pa.array(spots), pa.array((f.centred(x) @ f.basis).ravel()))
                exact = pa.array([decimal.Decimal(v) for v in f.deviations(x)], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(pa.array(of)), batch.column("dims").take(pa.array(of)), exact, values],
                    ["key", "dims", "deviation", "whitened"])
    turned = vectors.select("key", "dims", "x", "weight").mapInArrow(
        run, "key binary, dims int, deviation decimal(38,0), whitened array<double>")
    facts = [(dims, f.n, [float(s) for s in f.share], f.error) for dims, f in fits.items()]
    about = spark.createDataFrame(facts, "dims int, n long, share array<double>, identity_error double")
    joined = known.select("vec_id", "key").join(turned, "key").join(F.broadcast(about), "dims")  # a row per length
    return joined.select("vec_id", "n", "deviation", "share", "identity_error", F.posexplode("whitened").alias("i", "whitened")) \
        .select("vec_id", (F.col("i") + 1).alias("component"), "n", "deviation", "whitened",
                F.element_at("share", F.col("i") + 1).alias("explained"), "identity_error")

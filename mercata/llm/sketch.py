"""MinHash near-dedup by fast similarity sketching, banding and exact verification."""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from ..session import cut_lineage, release
from .arrays import forget, mix, range_hashes, running, slices, word_units, words
from .components import components

SHINGLE = 5
BIT_WORDS = 32  # 64-bit words of a set's bit field
BANDS, ROWS = 48, 4  # a link of similarity 0.75 is missed with probability 1.2e-8

SKETCHES = "doc_id long, n_shingles long, set_id binary, bands array<long>"


def lowered(data):
    """A-Z in lower case, all other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def shingle_sets(column, size=SHINGLE):
    """Sorted distinct shingle hashes of each text; fewer words are one shingle."""
    for _, offsets, data in slices(column):
        data = lowered(data)
        spots = words(offsets, data)
        sums, down = running(word_units(data, spots))
        start = np.arange(max(len(spots.start) - size + 1, 0))
        grams = range_hashes(sums, start, start + size, down)
        for a, b in zip(spots.offsets[:-1].tolist(), spots.offsets[1:].tolist(), strict=True):
            if b - a >= size:
                yield np.unique(grams[a:b - size + 1])
            elif b > a:
                yield range_hashes(sums, np.array([a]), np.array([b]), down)
            else:
                yield np.zeros(0, np.uint64)


def _seeds(t):
    return mix(np.arange(1, 2 * t + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sketch(elements, t, seeds):
    """One value for each of t coordinates; two sets agree in one with probability J.

    Round i throws every element into a hashed bin with a value in [i, i + 1); a bin
    keeps its smallest. After t rounds the bins that are still empty get a round of
    their own that throws every element into them, so every coordinate fills.
    """
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    low, half = np.uint64(0xFFFFFFFF), np.uint64(32)
    bins = np.full(t, none)
    done, step = 0, max(1, -(-3 * t // len(elements)))
    while done < t:
        rounds = np.arange(done, min(done + step, t), dtype=np.uint64)
        thrown = mix(elements[None, :] + seeds[rounds.astype(np.int64)][:, None])
        value = (rounds[:, None] << half) | (thrown & low)
        np.minimum.at(bins, ((thrown >> half) * np.uint64(t) >> half).astype(np.int64).ravel(), value.ravel())
        done += len(rounds)
        if (bins != none).all():
            return bins
    for j in np.flatnonzero(bins == none):
        value = (mix(elements + seeds[t + j]) & low).min()
        bins[j] = (np.uint64(t + j) << half) | value
    return bins


def band_keys(sketches, rows):
    """One 64-bit key for each band of `rows` coordinates."""
    parts = sketches.reshape(len(sketches), -1, rows)
    keys = mix(np.arange(1, parts.shape[1] + 1, dtype=np.uint64))[None, :] + np.zeros((len(parts), 1), np.uint64)
    for i in range(rows):
        keys = mix(keys + parts[:, :, i])
    return keys


def _sketched(docs, bands, rows, size):
    def run(batches):
        seeds = _seeds(bands * rows)
        for batch in batches:
            n, ids, made = [], [], []
            for elements in shingle_sets(batch.column(1), size):
                n.append(len(elements))
                ids.append(xxhash.xxh3_128_digest(elements.tobytes()) if len(elements) else None)
                if len(elements):
                    made.append(sketch(elements, bands * rows, seeds))
            keys = band_keys(np.array(made), rows) if made else np.zeros((0, bands), np.uint64)
            offsets = np.concatenate([[0], np.cumsum(np.array(n) > 0)]) * bands
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "n_shingles": pa.array(n, pa.int64()),
                "set_id": pa.array(ids, pa.binary()),
                "bands": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()),
                                                  pa.array(keys.ravel().view(np.int64)))})
        forget()
    return docs.mapInArrow(run, SKETCHES)


def _sets(texts, size):
    """node, set_id, the whole shingle set, and the set hashed into a small bit field.

    `lost` is how many more elements the set has than bits that are on.
    """
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = list(shingle_sets(part.column(1), size))
                size_of = [len(s) for s in sets]
                offsets = np.concatenate([[0], np.cumsum(size_of)])
                values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                marks = np.zeros((len(sets), 64 * BIT_WORDS), np.uint8)
                marks[np.repeat(np.arange(len(sets)), size_of), (values >> np.uint64(20)) % np.uint64(64 * BIT_WORDS)] = 1
                bits = np.packbits(marks, axis=1).view(np.int64)
                yield pa.RecordBatch.from_pydict({
                    "node": part.column(0),
                    "set_id": pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    "elements": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()),
                                                         pa.array(values.view(np.int64))),
                    "bits": pa.ListArray.from_arrays(
                        pa.array(np.arange(len(sets) + 1) * BIT_WORDS, pa.int32()), pa.array(bits.ravel())),
                    "lost": pa.array(np.array(size_of, np.int64) - marks.sum(1, dtype=np.int64))})
        forget()
    return texts.mapInArrow(run, "node long, set_id binary, elements array<long>, bits array<long>, lost long")


def _verified(pairs, sets, percent):
    """Pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("of_b"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("of_a", "of_b")).cast("long")
    counted = both.select("a", "b", shared.alias("shared"),
                          (F.size("of_a") + F.size("of_b")).cast("long").alias("total"))
    return counted.where(F.col("shared") * 100 >= (F.col("total") - F.col("shared")) * percent).select("a", "b")


def _size_class(n):
    """Sizes within about a tenth of each other; does not fall as sizes grow."""
    return F.floor(F.log(n.cast("double")) / float(np.log(1.1)))


def _sized(open_, sets):
    """`open_` with each node's set size, its class, and how many of its shingles a second
    open node has: the most it can share with any other.

    A node and its partner share at most the smaller `common` of the two. Near copies
    that were changed too much to be linked hold too many shingles of their own, so no
    set size is left for a partner and they are never paired.
    """
    held = sets.join(open_.select("node").distinct(), "node")
    sizes = held.select("node", F.size("elements").cast("long").alias("n"), "bits", "lost")
    lone = held.select("node", F.explode("elements").alias("element")) \
        .groupBy("element").agg(F.count("*").alias("k"), F.min("node").alias("node")) \
        .where("k = 1").groupBy("node").agg(F.count("*").alias("lone"))
    facts = sizes.join(lone, "node", "left").select(
        "node", "n", "bits", "lost", (F.col("n") - F.coalesce("lone", F.lit(0))).alias("common"),
        _size_class(F.col("n")).alias("size_class"))
    return cut_lineage(open_.join(facts, "node"))


def _ids_with_several_texts(sketches):
    """doc_ids whose rows have different sets; an empty set is one of them."""
    own = F.coalesce("set_id", F.lit(b""))
    return sketches.where("doc_id IS NOT NULL").groupBy("doc_id") \
        .agg(F.min(own).alias("first"), F.max(own).alias("last")).where("first != last").select("doc_id")


def _links_by_id(full, several, nodes):
    """Rows of one doc_id are one document: links between its sets."""
    owned = full.select("doc_id", "set_id").join(several, "doc_id").distinct().join(nodes, "set_id").select("doc_id", "node")
    least = owned.groupBy("doc_id").agg(F.min("node").alias("a"))
    return least.join(owned.select("doc_id", F.col("node").alias("b")), "doc_id").where("a < b").select("a", "b")


def near_duplicates(docs, percent=75, size=SHINGLE, bands=BANDS, rows=ROWS, id_col="doc_id", text_col="text"):
    """Groups of documents linked by a Jaccard similarity of `percent` or more.

    Sets hold the distinct `size`-word shingles of the text with A-Z in lower case.
    Documents with the same set become one node before anything is compared. Bands give
    candidates: each node is first verified, on full sets, against one other node of its
    bands (the smallest), which settles large groups in one pass. Then only pairs that
    share a band, are still in different components and could share enough by a bound
    are verified. Pairs inside a component cannot change it, so they are never made. Links are grouped by alternating
    large and small stars.

    Returns doc_id, n_shingles, component_id (the smallest doc_id reachable) and kept
    (doc_id = component_id), one row per input row. Without words or text a set is empty
    and linked with nothing. Rows with the same doc_id count as one document. A null
    doc_id is linked with nothing, has a null component and is kept. An empty table
    gives no rows; other columns are left out.
    """
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    sketches = cut_lineage(_sketched(texts, bands, rows, size))
    full = sketches.where("set_id IS NOT NULL AND doc_id IS NOT NULL")
    nodes = full.groupBy("set_id").agg(F.min("doc_id").alias("low"))
    several = _ids_with_several_texts(sketches)
    repeated = several.limit(1).count() > 0
    # a node is its smallest doc_id, or its place by it where one doc_id has several sets; either
    # way checkpointed, so a hot set is no group of a join
    nodes = numbered(nodes, "low", "set_id", name="node")[0] if repeated else \
        cut_lineage(nodes.withColumn("node", F.col("low")))
    firsts = full.withColumnRenamed("doc_id", "low").join(nodes, ["set_id", "low"])
    banded = firsts.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")) \
        .where("low < high").select("band", "low")
    members = cut_lineage(banded.join(shared, "band"))
    release(docs.sparkSession)

    wanted = members.select("node").distinct()
    known = nodes.join(wanted, "node")
    found = texts.join(known, texts.doc_id == known["low"]).select("node", "text")
    sets = cut_lineage(_sets(found, size).join(known, ["node", "set_id"])
                       .select("node", "elements", "bits", "lost").dropDuplicates(["node"]))

    first = members.groupBy("node").agg(F.min("low").alias("a")) \
        .where("a < node").select("a", F.col("node").alias("b"))
    links = cut_lineage(_verified(first, sets, percent))
    release(docs.sparkSession)
    groups = components(links, "a", "b")
    placed = members.select("band", "node").join(groups, "node", "left") \
        .select("band", "node", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("band", "component").agg(F.count("*").alias("n")) \
        .groupBy("band").agg(F.max(F.struct("n", "component")).alias("main"), F.count("*").alias("kinds")) \
        .where("kinds > 1").select("band", F.col("main.component").alias("main"))
    open_ = placed.join(mixed, "band")
    sized = _sized(open_, sets)
    smallest = F.ceil(F.col("n") * percent / 100)
    largest = F.least(F.floor(F.col("n") * 100 / percent),
                      F.floor(F.col("common") * (100 + percent) / percent) - F.col("n"))
    few = sized.where("component != main").where(smallest <= largest).select(
        "band", F.col("node").alias("x"), F.col("component").alias("cx"), F.col("n").alias("nx"),
        F.col("common").alias("commonx"), F.col("bits").alias("bitsx"), F.col("lost").alias("lostx"),
        F.explode(F.sequence(_size_class(smallest), _size_class(largest))).alias("size_class"))
    common = F.least("common", "commonx")
    # equal elements are equal bits; each set lost some elements to bits that were on
    same_bits = F.zip_with("bits", "bitsx", lambda a, b: F.bit_count(a.bitwiseAND(b)))
    alike = F.least("lost", "lostx") + F.aggregate(same_bits, F.lit(0), lambda a, b: a + b)
    across = few.join(sized, ["band", "size_class"]).where(
        (F.col("component") != F.col("cx")) & ((F.col("component") == F.col("main")) | (F.col("node") < F.col("x")))
        & (common * 100 >= (F.col("n") + F.col("nx") - common) * percent)
        & (alike * 100 >= (F.col("n") + F.col("nx") - alike) * percent))
    across = across.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")) \
        .distinct().join(first, ["a", "b"], "left_anti")
    links = links.unionByName(_verified(across, sets, percent))
    if repeated:
        links = links.unionByName(_links_by_id(full, several, nodes))
    final = components(links, "a", "b")
    roots = nodes.select(F.col("node").alias("component"), F.col("low").alias("lowest"))
    sets = cut_lineage(nodes.join(final, "node", "left").join(roots, "component", "left")
                       .select("set_id", F.coalesce("lowest", "low").alias("lowest")))
    placed = sketches.join(sets, "set_id", "left")
    if repeated:  # a row without words beside rows with words
        own = placed.where("lowest IS NOT NULL").join(several, "doc_id").groupBy("doc_id").agg(F.min("lowest").alias("own"))
        placed = placed.join(own, "doc_id", "left").withColumn("lowest", F.coalesce("lowest", "own"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("lowest", "doc_id"))
    return placed.select("doc_id", "n_shingles", component.alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

"""Benchmark decontamination by greedy string tiling."""

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from ..session import shared_dir
from .arrays import Words, forget, is_space, range_hashes, running, running_bytes, slices, words

MIN_MATCH = 5  # tokens of a tile
COVERAGE = 0.5  # of an item's tokens
BLOCK_BYTES = 8 << 20  # of benchmark text that workers hold at once
FILTER_BITS = 20

FOUND = ("doc_id long, item_id long, n_item_tokens long, n_matched long, coverage double, "
         "tiles array<struct<item_start:int,doc_start:int,length:int>>")


def token_units(offsets, data):
    """(hash of each token, first token of each text): lower-case runs without white
    space or ASCII punctuation; the bytes are in lower case already."""
    ascii_ = data < 128
    alnum = ((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 122)) | ((data >= 65) & (data <= 90))
    blank = np.where(is_space(data) | (ascii_ & ~alnum), np.uint8(32), data)
    spots = words(offsets, blank)
    sums, down = running_bytes(blank)
    return range_hashes(sums, spots.start, spots.end, down), Words(*spots).offsets


def lower_text(column):
    return pc.utf8_lower(column)


def _unmarked_runs(marked):
    """(start, stop) of maximal unmarked ranges."""
    edge = np.diff(np.concatenate([[1], marked.astype(np.int8), [1]]))
    return zip(np.flatnonzero(edge == -1).tolist(), np.flatnonzero(edge == 1).tolist(), strict=True)


def _windows(units, marked, size):
    """Starts of unmarked windows and their Karp-Rabin hashes, rolled over the whole."""
    if len(units) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    taken = np.concatenate([[0], np.cumsum(marked)])
    start = np.flatnonzero(taken[size:] == taken[:-size])
    sums, down = running(units)
    return start, range_hashes(sums, start, start + size, down)


def tiles(pattern, text, min_match):
    """Greedy string tiling: (pattern start, text start, length), longest matches first.

    Tiles never overlap, in the pattern or in the text, and may stand in any order.
    Running Karp-Rabin: matches of at least `size` tokens are looked for by hash; when a
    match much longer than `size` turns up the search starts again at that length, and
    otherwise `size` falls until it is `min_match`.
    """
    taken_p, taken_t = np.zeros(len(pattern), bool), np.zeros(len(text), bool)
    p, t = pattern.tolist(), text.tolist()
    found, size = [], max(min_match, 20)
    while True:
        start_p, hash_p = _windows(pattern, taken_p, size)
        start_t, hash_t = _windows(text, taken_t, size)
        table = {}
        for i, h in zip(start_p.tolist(), hash_p.tolist(), strict=True):
            table.setdefault(h, []).append(i)
        longest, by_length = 0, {}
        hits = np.flatnonzero(np.isin(hash_t, hash_p))
        for j, h in zip(start_t[hits].tolist(), hash_t[hits].tolist(), strict=True):
            for i in table[h]:
                if i and j and not taken_p[i - 1] and not taken_t[j - 1] and p[i - 1] == t[j - 1]:
                    continue  # part of the match that starts before it
                n = 0
                while (i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n]
                       and not taken_p[i + n] and not taken_t[j + n]):
                    n += 1
                if n >= size:
                    by_length.setdefault(n, []).append((i, j))
                    longest = max(longest, n)
        if longest > 2 * size:
            size = longest
            continue
        while by_length:  # longest first; what an earlier tile has cut goes back in
            n = max(by_length)
            for i, j in sorted(by_length.pop(n)):
                if not taken_p[i:i + n].any() and not taken_t[j:j + n].any():
                    taken_p[i:i + n] = taken_t[j:j + n] = True
                    found.append((i, j, n))
                    continue
                for a, b in _unmarked_runs(taken_p[i:i + n] | taken_t[j:j + n]):
                    if size <= b - a < n:
                        by_length.setdefault(b - a, []).append((i + a, j + a))
        if size == min_match:
            return found
        size = max(size // 2, min_match)


class Items:
    """A block of benchmark items with the seeds that documents are joined on."""

    def __init__(self, ids, column, min_match):
        self.ids, self.units = [], []
        postings = {}
        row = 0
        for _, offsets, data in slices(lower_text(column)):
            units, where = token_units(offsets, data)
            for a, b in zip(where[:-1].tolist(), where[1:].tolist(), strict=True):
                own, item_id = units[a:b], ids[row]
                row += 1
                if not len(own) or item_id is None:
                    continue
                size = min(min_match, len(own))
                _, seeds = _windows(own, np.zeros(len(own), bool), size)
                for seed in np.unique(seeds).tolist():
                    postings.setdefault(size, {}).setdefault(seed, []).append(len(self.ids))
                self.ids.append(item_id)
                self.units.append(own)
        self.sizes = {}
        for size, table in postings.items():
            seeds = np.array(sorted(table), np.uint64)
            some = np.zeros(1 << FILTER_BITS, bool)
            some[(seeds >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
            self.sizes[size] = (seeds, some, table)

    def candidates(self, units, where):
        """(document row, item) pairs that share a seed, with the seeds they share."""
        pairs = {}
        for size, (seeds, some, table) in self.sizes.items():
            if len(units) < size:
                continue
            sums, down = running(units)
            start = np.arange(len(units) - size + 1)
            grams = range_hashes(sums, start, start + size, down)
            at = np.flatnonzero(some[(grams >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            place = np.minimum(np.searchsorted(seeds, grams[at]), len(seeds) - 1)
            at = at[seeds[place] == grams[at]]
            doc = np.searchsorted(where, at, "right") - 1
            inside = at + size <= where[doc + 1]
            for d, seed in zip(doc[inside].tolist(), grams[at[inside]].tolist(), strict=True):
                for item in table[seed]:
                    pairs.setdefault((d, item), set()).add(seed)
        return pairs


def _enough(item, shared, min_match, coverage):
    """Whether the shared seeds could cover enough of the item."""
    size = min(min_match, len(item))
    _, seeds = _windows(item, np.zeros(len(item), bool), size)
    covered = np.zeros(len(item), bool)
    for i in np.flatnonzero(np.isin(seeds, np.array(list(shared), np.uint64))).tolist():
        covered[i:i + size] = True
    return covered.sum() >= coverage * len(item)


def _blocks(benchmark, item_col, text_col, limit):
    """Items in blocks of at most `limit` bytes; the driver holds one block at a time."""
    ids, block, held = [], [], 0
    rows = benchmark.select(benchmark[item_col].cast("long").alias("i"), benchmark[text_col].cast("string").alias("t"))
    for row in rows.where("t IS NOT NULL AND i IS NOT NULL").toLocalIterator():
        size = len(row.t.encode("utf-8"))
        if block and held + size > limit:
            yield ids, block
            ids, block, held = [], [], 0
        ids.append(row.i)
        block.append(row.t)
        held += size
    if block:
        yield ids, block


def contaminated(docs, benchmark, min_match=MIN_MATCH, coverage=COVERAGE, id_col="doc_id", text_col="text",
                 item_col="item_id", item_text_col="text", block_bytes=BLOCK_BYTES):
    """Documents that hold `coverage` or more of a benchmark item, in any order.

    Tokens are lower-case runs of letters, digits and other characters that are neither
    white space nor ASCII punctuation. Documents meet items on shared seeds of
    `min_match` tokens; what seeds could cover enough is tiled greedily, and the tiles'
    share of the item's tokens is tested, so reordered passages count. The benchmark is
    sent to the workers in blocks of at most `block_bytes`, one pass over the documents
    for each; what a block finds is written and the block let go before the next is read,
    so driver and workers hold one at a time. Documents are not shuffled, so an item that
    many of them hold is no hot key. The folder below spark.checkpoint.dir is the caller's
    to remove.

    Returns one row per document and item: doc_id, item_id, n_item_tokens, n_matched,
    coverage and tiles (in the order they were marked). An item of fewer than `min_match`
    tokens must stand whole as one seed; items or documents without text or tokens and
    items with a null id never match; a null doc_id is kept as null; equal rows and equal
    items each give their own rows; empty tables give no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    folder, written = shared_dir(spark, f"tiling/{uuid.uuid4().hex}"), []
    for ids, block in _blocks(benchmark, item_col, item_text_col, block_bytes):
        shared = spark.sparkContext.broadcast((ids, block))
        written.append(f"{folder}/{len(written)}")
        texts.mapInArrow(_searcher(shared, min_match, coverage), FOUND).write.parquet(written[-1])
        shared.destroy()
    return spark.read.schema(FOUND).parquet(*written) if written else spark.createDataFrame([], FOUND)


def _searcher(shared, min_match, coverage):
    def run(batches):
        ids, block = shared.value
        items = Items(ids, pa.array(block, pa.string()), min_match)
        for batch in batches:
            rows = []
            for row, offsets, data in slices(lower_text(batch.column(1))):
                units, where = token_units(offsets, data)
                for (doc, item), seeds in items.candidates(units, where).items():
                    own = items.units[item]
                    if not _enough(own, seeds, min_match, coverage):
                        continue
                    found = tiles(own, units[where[doc]:where[doc + 1]], min(min_match, len(own)))
                    matched = sum(n for _, _, n in found)
                    if matched >= coverage * len(own):
                        rows.append((row + doc, items.ids[item], len(own), matched, matched / len(own),
                                     [{"item_start": i, "doc_start": j, "length": n} for i, j, n in found]))
            yield _found(batch, rows)
        forget()
    return run


def _found(batch, rows):
    at, item, n, matched, share, found = zip(*rows, strict=True) if rows else [[]] * 6
    tile = pa.list_(pa.struct([(c, pa.int32()) for c in ("item_start", "doc_start", "length")]))
    return pa.RecordBatch.from_pydict({
        "doc_id": batch.column(0).take(pa.array(at, pa.int64())), "item_id": pa.array(item, pa.int64()),
        "n_item_tokens": pa.array(n, pa.int64()), "n_matched": pa.array(matched, pa.int64()),
        "coverage": pa.array(share, pa.float64()), "tiles": pa.array(found, tile)})


def clean_documents(docs, benchmark, id_col="doc_id", **settings):
    """The rows of `docs`, all columns, whose document is not contaminated.

    Rows with a null doc_id cannot be told apart and stay.
    """
    found = contaminated(docs, benchmark, id_col=id_col, **settings)
    bad = found.select(F.col("doc_id").alias("_found")).where("_found IS NOT NULL").distinct()
    return docs.join(bad, docs[id_col].cast("long") == bad["_found"], "left_anti")

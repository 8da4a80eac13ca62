"""Ranked lexical search: sums over short lists first, then documents in order over long lists.

The documents stay where they are. Each task cuts them into chunks, keeps the posting lists
of the terms that are asked for, and writes them as rows of an index. Searches read the
index: in a chunk the short lists of an item are summed into accumulators (term at a time),
which from then on are one list with a bound among the long lists; those are walked document
range by document range, and what the bounds rule out is skipped.
"""

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import shared_dir
from .arrays import forget, same_bytes, slices, with_spare, word_units, words

TOP = 50
BLOCK_BYTES = 8 << 20  # of item texts that are searched at once; workers and driver hold one block
CHUNK_BYTES = 16 << 20  # of text in one row of the index, or one longer document
DOC_RANGE = 1024  # documents whose bounds are looked at together
SHORT_SHARE = 16  # a list with at most a 16th of a chunk's documents is short
TASKS_TOGETHER = 256  # whose best are merged before the last ranking

INDEX = ("n_docs long, n_terms long, terms array<int>, counts array<int>, docs binary, freqs binary, "
         "doc_ids binary, no_id binary, lengths binary")
FOUND = "item int, doc_id long, score long"


def _term_bytes():
    """Letters and digits, A-Z in lower case, and bytes from 0x80; all else is a blank."""
    table = np.full(256, 32, np.uint8)
    kept = [*range(48, 58), *range(97, 123), *range(128, 256)]
    table[kept] = kept
    table[65:91] = np.arange(97, 123)
    return table


_TERM_BYTES = _term_bytes()


def terms_of(offsets, data):
    """(bytes with blanks between terms, where the terms are)"""
    data = _TERM_BYTES[data]
    return data, words(offsets, data)


class Vocabulary:
    """The distinct terms of a block of items; found by hash, confirmed byte by byte."""

    def __init__(self, terms):
        terms = sorted(terms)
        data = np.frombuffer(b"".join(terms), np.uint8)
        ends = np.cumsum([len(t) for t in terms], dtype=np.int64)
        spots = words(np.concatenate([[0], ends]), data)
        units = word_units(data, spots)
        order = np.argsort(units, kind="stable")
        self.keys, self.data = units[order], with_spare(data)
        self.start, self.size = spots.start[order], (spots.end - spots.start)[order]
        same = np.diff(np.concatenate([np.flatnonzero(np.diff(self.keys, prepend=self.keys[:1] + np.uint64(1))), [len(terms)]]))
        self.most = int(same.max(initial=0))  # terms with one hash
        self.terms = [terms[i] for i in order.tolist()]

    def find(self, data, spots):
        """(number of the word, number of the term) for words that are terms."""
        units, size = word_units(data, spots), spots.end - spots.start
        first = np.searchsorted(self.keys, units)
        at, term = [], []
        for step in range(self.most):
            place = np.minimum(first + step, len(self.keys) - 1)
            hit = np.flatnonzero((self.keys[place] == units) & (self.size[place] == size) & (first + step < len(self.keys)))
            if not len(hit):
                continue
            place = place[hit]
            right = same_bytes(with_spare(data), spots.start[hit], self.data, self.start[place], size[hit])
            at.append(hit[right])
            term.append(place[right])
        none = np.zeros(0, np.int64)
        return (np.concatenate(at), np.concatenate(term)) if at else (none, none)


def _index(texts, shared):
    """One row per chunk of documents: posting lists of the terms asked for."""
    def run(batches):
        held, size, n = [], 0, 0
        for batch in batches:
            ids = batch.column(0)
            for row, offsets, data in slices(batch.column(1)):
                docs = len(offsets) - 1
                plain, spots = terms_of(offsets, data)
                word, term = shared.value.find(plain, spots)
                doc = np.searchsorted(spots.offsets, word, "right") - 1
                width = len(shared.value.keys) + 1
                pair, freq = np.unique(doc * width + term, return_counts=True)
                own = ids.slice(row, docs)
                held.append((pair % width, pair // width + n, freq, np.diff(spots.offsets),
                             own.fill_null(0).to_numpy(), own.is_null().to_numpy(zero_copy_only=False)))
                n, size = n + docs, size + len(data)
                if size >= CHUNK_BYTES or n >= CHUNK_BYTES >> 4:
                    yield _chunk(held)
                    held, size, n = [], 0, 0
        if held:
            yield _chunk(held)
        forget()
    return texts.mapInArrow(run, INDEX)


def _chunk(held):
    term, doc, freq, length, ids, no_id = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(term, kind="stable")  # documents stay in order inside a term
    terms, counts = np.unique(term, return_counts=True)
    binary = [doc[order].astype(np.int32), freq[order].astype(np.int64), ids.astype(np.int64), no_id, length.astype(np.int64)]
    values = [[int((length > 0).sum())], [int(length.sum())], [terms.astype(np.int32)], [counts.astype(np.int32)],
              *[[x.tobytes()] for x in binary]]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.binary()] * 5]
    names = [c.split()[0] for c in INDEX.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)


class Top:
    """The best documents of an item so far, best first; equal scores by id, null last."""

    def __init__(self, k):
        none = np.zeros(0, np.int64)
        self.k, self.score, self.doc, self.no_id = k, none, none, none.astype(bool)

    @property
    def need(self):
        """The least score that can still enter."""
        return max(1, int(self.score[-1])) if len(self.score) == self.k else 1

    def add(self, score, doc, no_id):
        score, doc, no_id = (np.concatenate(x) for x in ((self.score, score), (self.doc, doc), (self.no_id, no_id)))
        best = np.lexsort((doc, no_id, -score))[:self.k]
        self.score, self.doc, self.no_id = score[best], doc[best], no_id[best]


class Chunk:
    """A row of the index with its scores."""

    def __init__(self, row, weight, n_docs, n_terms):
        self.docs = np.frombuffer(row["docs"], np.int32)
        freq = np.frombuffer(row["freqs"], np.int64)
        self.ids = np.frombuffer(row["doc_ids"], np.int64)
        self.no_id = np.frombuffer(row["no_id"], bool)
        length = np.frombuffer(row["lengths"], np.int64)
        self.terms = np.array(row["terms"], np.int64)
        counts = np.array(row["counts"], np.int64)
        self.start = np.concatenate([[0], np.cumsum(counts)])
        # fixed: the whole-number score of a posting
        damp = 100 - 50 + 50 * length * n_docs // max(n_terms, 1)
        self.score = np.repeat(weight[self.terms], counts) * (1_000_000_000 * freq // (1000 * freq + 20 * damp[self.docs]))
        self.ranges = -(-len(length) // DOC_RANGE)
        edges = np.arange(self.ranges + 1) * DOC_RANGE
        # first posting of each term in each range of documents, and the best score there
        of = np.repeat(np.arange(len(counts)), counts) * len(length) + self.docs
        self.cut = np.searchsorted(of, (np.arange(len(counts)) * len(length))[:, None] + np.minimum(edges, len(length)))
        self.bound = np.zeros((len(counts), self.ranges), np.int64)
        full = self.cut[:, 1:] > self.cut[:, :-1]
        if full.any():
            self.bound[full] = np.maximum.reduceat(self.score, self.cut[:, :-1][full])

    def search(self, terms, top):
        """Add the chunk's best documents for an item's (sorted) terms to `top`."""
        place = np.flatnonzero(np.isin(self.terms, terms, assume_unique=True))
        place = place[self.bound[place].max(1, initial=0) > 0]
        if not len(place):
            return
        count = self.start[place + 1] - self.start[place]
        short = count * SHORT_SHARE <= len(self.ids)
        docs, sums = self._accumulated(place[short])
        long = place[~short]
        edges = np.searchsorted(docs, np.arange(self.ranges + 1) * DOC_RANGE)
        for r in range(self.ranges):
            lists = [(self.bound[t, r], self.docs[self.cut[t, r]:self.cut[t, r + 1]], self.score[self.cut[t, r]:self.cut[t, r + 1]])
                     for t in long.tolist() if self.bound[t, r]]
            own = slice(edges[r], edges[r + 1])
            if edges[r + 1] > edges[r]:
                lists.append((sums[own].max(), docs[own], sums[own]))
            if sum(b for b, _, _ in lists) >= top.need:
                self._range(lists, r * DOC_RANGE, top)

    def _accumulated(self, short):
        """Term at a time: the summed scores of documents in the short lists."""
        parts = [slice(self.start[t], self.start[t + 1]) for t in short.tolist()]
        if not parts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        docs, score = (np.concatenate([x[p] for p in parts]) for x in (self.docs, self.score))
        order = np.argsort(docs, kind="stable")
        docs, score = docs[order], score[order]
        new = np.flatnonzero(np.diff(docs, prepend=-1))
        return docs[new], np.add.reduceat(score, new)

    def _range(self, lists, base, top):
        """Document at a time in one range of documents.

        Lists stand by rising bound. Those whose bounds together cannot reach the needed
        score propose nothing; they are only looked up, by skipping, for documents that
        the others propose and that could still enter.
        """
        lists.sort(key=lambda x: x[0])
        need, reach = top.need, np.cumsum([b for b, _, _ in lists])
        first = int(np.searchsorted(reach, need))
        score = np.zeros(DOC_RANGE, np.int64)
        for _, docs, scores in lists[first:]:
            score[docs - base] += scores
        doc = np.flatnonzero(score)
        score = score[doc]
        for i in range(first - 1, -1, -1):
            alive = score + reach[i] >= need
            doc, score = doc[alive], score[alive]
            if not len(doc):
                return
            _, docs, scores = lists[i]
            at = np.minimum(np.searchsorted(docs, doc + base), len(docs) - 1)
            score += np.where(docs[at] == doc + base, scores[at], 0)
        alive = score >= need
        doc = doc[alive] + base
        if len(doc):
            top.add(score[alive], self.ids[doc], self.no_id[doc])


def _searched(index, shared, k):
    def run(batches):
        items, weight, n_docs, n_terms = shared.value
        best = [Top(k) for _ in items]
        for batch in batches:
            for at in range(batch.num_rows):
                chunk = Chunk(batch.slice(at, 1).to_pylist()[0], weight, n_docs, n_terms)
                for terms, top in zip(items, best, strict=True):
                    chunk.search(terms, top)
        for at in range(0, len(items), 256):
            part = best[at:at + 256]
            doc = pa.array(np.concatenate([t.doc for t in part]), mask=np.concatenate([t.no_id for t in part]))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.arange(at, at + len(part), dtype=np.int32), [len(t.score) for t in part])),
                doc, pa.array(np.concatenate([t.score for t in part]))], ["item", "doc_id", "score"])
    return index.mapInArrow(run, FOUND)


def _blocks(items, id_col, text_col, limit):
    """(ids, texts) of items, at most `limit` bytes of text or one item at a time."""
    ids, texts, held = [], [], 0
    for row in items.select(items[id_col].cast("long").alias("i"), items[text_col].cast("string").alias("t")).toLocalIterator():
        size = len((row.t or "").encode()) + 100
        if ids and held + size > limit:
            yield ids, texts
            ids, texts, held = [], [], 0
        ids, texts, held = [*ids, row.i], [*texts, row.t], held + size
    if ids:
        yield ids, texts


def item_terms(texts):
    """The distinct terms of each text, as bytes."""
    found = []
    for _, offsets, data in slices(pa.array(texts, pa.string())):
        plain, spots = terms_of(offsets, data)
        raw = plain.tobytes()
        every = [raw[a:b] for a, b in zip(spots.start.tolist(), spots.end.tolist(), strict=True)]
        found += [set(every[a:b]) for a, b in zip(spots.offsets[:-1].tolist(), spots.offsets[1:].tolist(), strict=True)]
    return found


def rank(docs, items, top=TOP, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text",
         block_bytes=BLOCK_BYTES):
    """The `top` documents for each item by a whole-number lexical score, exactly.

    Terms are runs of characters other than ASCII signs, white space and controls, A-Z in
    lower case. A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))) with N documents
    that have a term, and a posting adds weight * (10^9 tf div (1000 tf + 20 m)) with
    m = 100 - 50 + (50 n N div L). Documents are not shuffled: a task indexes its own in
    chunks and keeps `top` documents per item. Items are searched in blocks of at most
    `block_bytes` of text, each with a pass over the documents, and only one block is held
    at a time; results of a block are written before the next begins.

    Returns item_id, rank (from 1, unique in an item), doc_id, score; equal scores by
    doc_id, null last. Only scores above 0 return, so an item without terms, or whose terms
    no document has, has no rows. A null or empty text has no terms. Equal rows of either
    table each count and return on their own; null ids stay null; empty tables give no rows;
    other columns are left out. The folder below spark.checkpoint.dir is the caller's to remove.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark, f"ranking/{uuid.uuid4().hex}")
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    schema = "item_id long, rank int, doc_id long, score long"
    written = []
    for ids, block in _blocks(items, item_col, item_text_col, block_bytes):
        asked = item_terms(block)
        if not any(asked):
            continue
        written.append(f"{folder}/found/{len(written)}")
        _rank_block(texts, ids, asked, f"{folder}/index/{len(written)}", top).write.parquet(written[-1])
    return spark.read.schema(schema).parquet(*written) if written else spark.createDataFrame([], schema)


def _rank_block(texts, ids, asked, folder, k):
    spark = texts.sparkSession
    vocabulary = Vocabulary(set().union(*asked))
    place = {t: i for i, t in enumerate(vocabulary.terms)}
    _index(texts, spark.sparkContext.broadcast(vocabulary)).write.parquet(folder)
    index = spark.read.parquet(folder)
    n_docs, n_terms = (int(x or 0) for x in index.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    held = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")) \
        .groupBy("x.terms").agg(F.sum(F.col("x.counts").cast("long")).alias("df")).toArrow()  # a row per term asked for
    df = np.zeros(len(place), np.int64)
    df[held.column("terms").to_numpy()] = held.column("df").to_numpy()
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    items = [np.array(sorted(place[t] for t in terms), np.int64) for terms in asked]
    found = _searched(index, spark.sparkContext.broadcast((items, weight, n_docs, n_terms)), k)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    near = Window.partitionBy("item", "group").orderBy(*order)
    last = Window.partitionBy("item").orderBy(*order)
    merged = found.withColumn("group", F.floor(F.spark_partition_id() / TASKS_TOGETHER)) \
        .withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)
    ranked = merged.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(ids)), "item int, item_id long")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # ids of one block

"""Repeated windows of a corpus, found without moving all windows.

Both substring operators need every occurrence of a window (35 words, 50 bytes) that
also occurs elsewhere. The work goes through four shuffles, each partitioned by a hash:

1. Documents are dealt into bounded chunks. A chunk reports its distinct anchors (a
   content-defined sample of the positions, see arrays.anchored_runs): the map-side
   half, so an anchor that a third of all documents share arrives once per chunk.
2. Anchors are grouped; a chunk is told which of its anchors occur elsewhere, or twice
   in it. All occurrences of a repeated window have the same anchor, so nothing is lost.
   It is also told which of its texts are exact copies of a smaller doc_id's: they lose
   every window and need not send anything.
3. The chunk sends the text around such anchors, equal contexts once, to the shard of
   the anchor. An anchor that is in many chunks (HOT_CHUNKS) is not sent to one shard:
   its windows travel one by one, by their own hash, again once per chunk.
4. A shard decides which windows are repeated (the operator's own method) and answers
   each chunk, which marks the windows in its documents.

Chunks are recomputed from the same shuffle (Spark reuses it), so there is no state
outside Spark's own lineage and a lost executor only repeats its tasks.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F

from .arrays import anchored_runs, forget, range_hashes, running, slices

CHUNKS_PER_PARTITION = 4
CHUNK_BYTES = 8 << 20  # of text in a chunk on average; more data makes more chunks
HOT_CHUNKS = 256
LAST_ID = (1 << 63) - 1  # stands for a null id: after all others

BLOCK_BYTES = 4 << 20

# An anchor and its answer travel as the same 48 bits of its hash: anchors that agree in
# them are one anchor to all chunks, so equal windows always go to the same kind of shard.
# `place` is the chunk and two flags.
ANCHORS = "anchor long, place int"
ANSWERS = "chunk int, anchor long, hot boolean, text_id long, check int, low long"
CONTEXTS = "shard int, place int, low long, more long, context binary"
MARKS = "chunk int, content long, first int, last int, low long"
COPY = -2  # `first` of a mark that stands for a whole text; `last` is its check


def chunked(docs, id_col, text_col, with_rest=False):
    """doc_id, text and the chunk of each row; `rest` holds the other columns."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(docs[text_col].cast("string")).cast("long"))).first()[0] or 0
    chunks = max(CHUNKS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // CHUNK_BYTES))
    columns = [docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")]
    if with_rest:
        columns.append(F.struct(*[docs[c] for c in docs.columns if c != text_col]).alias("rest"))
    rows = docs.select(*columns).withColumn("text_id", F.xxhash64("text")).withColumn("check", F.hash("text"))
    return rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text_id"), F.lit(chunks)).cast("int"))


def copies(docs):
    """chunk, text_id, check, low: texts that stand in several rows, and their smallest doc_id.

    Texts are equal by 96 bits of two hashes; only one row per chunk and text is shuffled.
    """
    rows = docs.select("chunk", "text_id", "check", F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc_id"))
    held = rows.groupBy("text_id", "check", "chunk").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"))
    same = Window.partitionBy("text_id", "check")
    return held.select("chunk", "text_id", "check", F.min("low").over(same).alias("low"),
                       F.sum("n").over(same).alias("n")).where("n > 1").drop("n")


def ids_of(table):
    column = table.column("doc_id")
    column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.int64())
    return column.fill_null(LAST_ID).to_numpy(zero_copy_only=False)


def _long(x):
    return np.ascontiguousarray(x).view(np.int64)


def _flat(table, name):
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False)


class Unit:
    """What a window is made of. Subclasses are bytes and words."""

    def __init__(self, length, k):
        self.length, self.k = length, k

    def units(self, offsets, data):
        """(hash of each unit, first unit of each document, word bounds or None)"""
        raise NotImplementedError

    def cut(self, data, spots, first, last):
        """The text that windows first..last cover, the same for equal contents."""
        raise NotImplementedError

    def bounds(self, offsets, data):
        """(first unit of each document, word bounds or None), without hashing."""
        raise NotImplementedError

    def whole(self, table):
        """As `with_marks` gives them: all windows of every document."""
        for _, offsets, data in slices(table.column("text")):
            where, spots = self.bounds(offsets, data)
            long = np.flatnonzero(np.diff(where) >= self.length)
            yield offsets, data, spots, where, where[long], where[long + 1] - self.length

    def runs_in(self, table, contents=False):
        """(ids, offsets, data, word bounds, units, first units, runs) for each slice."""
        ids = ids_of(table)
        for row, offsets, data in slices(table.column("text")):
            hashes, where, spots = self.units(offsets, data)
            runs = anchored_runs(hashes, where, self.length, self.k, contents)
            yield ids[row:row + len(offsets) - 1], offsets, data, spots, hashes, where, runs

    def contents(self, column):
        """Hash of each context, as in the runs it was cut from."""
        out = []
        for _, offsets, data in slices(column):
            hashes, where, _ = self.units(offsets, data)
            sums, down = running(hashes)
            out.append(range_hashes(sums, where[:-1], where[1:], down))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _grouped(keys):
    """(order, first index of each group in that order)"""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return order, np.flatnonzero(new)


def anchors(docs, unit, between_documents):
    """Distinct anchors of each chunk; many: in two places (or two documents) of it."""
    def run(table):
        found, owners = [], []
        for ids, _, _, _, _, _, runs in unit.runs_in(table):
            found.append(runs.anchor)
            owners.append(ids[runs.doc])
        keys = np.concatenate(found) >> np.uint64(16) if found else np.zeros(0, np.uint64)
        if not len(keys):
            return pa.table({"anchor": pa.array([], pa.int64()), "place": pa.array([], pa.int32())})
        order, first = _grouped(keys)
        if between_documents:
            owner = np.concatenate(owners)[order]
            many = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)
        else:
            many = np.diff(np.append(first, len(keys))) > 1
        chunk = table.column("chunk")[0].as_py()
        forget()
        return pa.table({"anchor": _long(keys[order][first]), "place": (many + chunk * 2).astype(np.int32)})
    return docs.groupBy("chunk").applyInArrow(run, ANCHORS)


def repeated_anchors(found, hot_chunks):
    """Which chunk holds which repeated anchor, and whether very many chunks do."""
    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        keys, place = _flat(table, "anchor"), _flat(table, "place")
        order, first = _grouped(keys)
        size = np.diff(np.append(first, len(keys)))
        keep = (size > 1) | (np.maximum.reduceat(place[order] & 1, first) > 0)
        keep, hot = np.repeat(keep, size), np.repeat(size >= hot_chunks, size)
        for at in np.array_split(np.flatnonzero(keep), 1 + keep.sum() // (1 << 16)):
            yield pa.RecordBatch.from_pydict({
                "chunk": place[order[at]] >> 1, "anchor": keys[order[at]],
                "hot": pa.array(hot[at]), "text_id": pa.nulls(len(at), pa.int64()),
                "check": pa.nulls(len(at), pa.int32()), "low": pa.nulls(len(at), pa.int64())})
    return found.repartition("anchor").mapInArrow(run, ANSWERS)


class Copies:
    """Texts of a chunk that have copies, from the answers it got."""

    def __init__(self, text_id, check, low):
        self.low = dict(zip(zip(text_id.tolist(), check.tolist(), strict=True), low.tolist(), strict=True))

    def split(self, table):
        """(rows to work on, whether the row's text has copies, rows a smaller doc_id repeats)"""
        keys = list(zip(table.column("text_id").to_pylist(), table.column("check").to_pylist(), strict=True))
        low = np.array([self.low.get(k, LAST_ID) for k in keys], np.int64)
        known = np.array([k in self.low for k in keys], bool)
        later = known & (low < ids_of(table))
        return table.filter(pa.array(~later)), known[~later], table.filter(pa.array(later))


def contexts(docs, repeated, unit):
    """The text around repeated anchors, equal texts once per chunk.

    Of documents with the same text only the smallest doc_id sends anything.
    """
    def run(key, table, answers):
        rows = {c: [] for c in ("shard", "place", "low", "more", "context")}
        told = answers.column("text_id").is_valid().combine_chunks()
        same = answers.filter(told)
        answers = answers.filter(pc.invert(told))
        table, copied, _ = Copies(_flat(same, "text_id"), _flat(same, "check"), _flat(same, "low")).split(table)
        wanted = _flat(answers, "anchor").view(np.uint64)
        order = np.argsort(wanted)
        wanted, hot = wanted[order], _flat(answers, "hot")[order]
        seen, row = {}, 0
        for ids, offsets, data, spots, _, _, runs in unit.runs_in(table) if len(wanted) else ():
            twice = copied[row:row + len(ids)]
            row += len(ids)
            if not len(runs.doc):
                continue
            short = runs.anchor >> np.uint64(16)
            place = np.minimum(np.searchsorted(wanted, short), len(wanted) - 1)
            at = np.flatnonzero(wanted[place] == short)
            raw = data.tobytes()
            fields = (runs.first, runs.last, ids[runs.doc], runs.anchor >> np.uint64(33), twice[runs.doc])
            for first, last, owner, shard, many, crowded in zip(
                    *(f[at].tolist() for f in fields), hot[place[at]].tolist(), strict=True):
                for a, b in [(s, s) for s in range(first, last + 1)] if crowded else [(first, last)]:
                    text = unit.cut(raw, spots, a, b)
                    known = seen.get((text, crowded))
                    if known is None:
                        seen[text, crowded] = [hash_of(text) if crowded else shard, owner, owner, many]
                    else:
                        known[1], known[2], known[3] = min(known[1], owner), max(known[2], owner), True
        chunk = key[0].as_py()
        for (text, crowded), (shard, low, high, many) in seen.items():
            values = (shard, chunk * 4 + many * 2 + crowded, low, high - low, text)
            for column, value in zip(rows.values(), values, strict=True):
                column.append(value)
        forget()
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.table({c: pa.array(v, kind) for (c, v), kind in zip(rows.items(), kinds, strict=True)})
    return docs.groupBy("chunk").cogroup(repeated.groupBy("chunk")).applyInArrow(run, CONTEXTS)


def hash_of(text):
    """31 bits of a text's hash, the same in every process."""
    return xxhash.xxh3_64_intdigest(text) >> 33


def answered(found, unit, decide):
    """Tell each chunk which windows of its contexts are repeated.

    `decide(shard, context, low, many)` returns runs of windows as arrays (row, first,
    last, low); `low` is the smallest document that holds the windows. It gets whole
    shards, about BLOCK_BYTES of them at once.
    """
    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        shard = _flat(table, "shard")
        order = np.argsort(shard, kind="stable")
        table, shard = table.take(order), shard[order]
        size = np.cumsum(pc.binary_length(table.column("context")).to_numpy())
        new = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])), len(shard))
        start = 0
        while start < len(shard):
            full = np.searchsorted(size, (size[start - 1] if start else 0) + BLOCK_BYTES)
            stop = int(new[min(np.searchsorted(new, max(full, start + 1)), len(new) - 1)])
            yield from block(table.slice(start, stop - start))
            start = stop
        forget()

    def block(table):
        context = pa.concat_arrays(table.column("context").chunks)
        own, place = _flat(table, "low"), _flat(table, "place")
        row, first, last, low = decide(_flat(table, "shard"), context, own, (place & 2) > 0)
        told = low < (own + _flat(table, "more"))[row]
        row, first, last, low = row[told], first[told], last[told], low[told]
        content = unit.contents(context)[row]
        first = np.where(place[row] & 1, -1, first)
        chunk = place[row] >> 2
        for at in range(0, len(row), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_pydict({
                "chunk": chunk[part].astype(np.int32), "content": _long(content[part]),
                "first": first[part].astype(np.int32), "last": last[part].astype(np.int32),
                "low": low[part].astype(np.int64)})
    return found.repartition("shard").mapInArrow(run, MARKS)


class Marks:
    """The answers a chunk got, to be looked up by content."""

    def __init__(self, table):
        whole = pc.equal(table.column("first"), COPY)
        same, table = table.filter(whole), table.filter(pc.invert(whole))
        self.copies = Copies(_flat(same, "content"), _flat(same, "last"), _flat(same, "low"))
        content = _flat(table, "content").view(np.uint64)
        order = np.argsort(content, kind="stable")
        first = _flat(table, "first").astype(np.int64)[order]
        self.content = content[order]
        self.first, self.last = first, _flat(table, "last").astype(np.int64)[order]
        self.low = _flat(table, "low")[order]
        self.alone = first < 0
        self.bits = None
        if self.alone.any():  # cheap first look for the windows of crowded anchors
            self.bits = np.zeros(1 << 20, bool)
            self.bits[(self.content[self.alone] >> np.uint64(44)).astype(np.int64)] = True

    def _matches(self, content):
        left = np.searchsorted(self.content, content, "left")
        size = np.searchsorted(self.content, content, "right") - left
        which = np.repeat(np.arange(len(left)), size)
        mark = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(left, size)
        return which, mark

    def windows(self, unit, ids, hashes, where, runs):
        """(first, last) starts of repeated windows in a slice."""
        if not len(self.content) or not len(runs.doc):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        which, mark = self._matches(runs.content)
        kept = ~self.alone[mark] & (self.low[mark] < ids[runs.doc[which]])
        which, mark = which[kept], mark[kept]
        first, last = runs.first[which] + self.first[mark], runs.first[which] + self.last[mark]
        if self.bits is None:
            return first, last
        sums, down = running(hashes)
        start = np.arange(len(hashes) - unit.length + 1)
        content = range_hashes(sums, start, start + unit.length, down)
        doc = np.repeat(np.arange(len(where) - 1), np.diff(where))[:len(start)]
        look = np.flatnonzero(self.bits[(content >> np.uint64(44)).astype(np.int64)]
                              & (start + unit.length <= where[1:][doc]))
        which, mark = self._matches(content[look])
        start, doc = look[which], doc[look[which]]
        kept = self.alone[mark] & (self.low[mark] < ids[doc])
        return np.append(first, start[kept]), np.append(last, start[kept])


def with_marks(docs, marks, unit, finish, schema):
    """`finish(table, parts)` for each chunk; a part is a slice (offsets, data, word
    bounds, first units) with the (first, last) starts of its repeated windows."""
    def run(key, table, answers):
        known = Marks(answers)
        table, _, same = known.copies.split(table)
        found = ((offsets, data, spots, where, *known.windows(unit, ids, hashes, where, runs))
                 for ids, offsets, data, spots, hashes, where, runs in unit.runs_in(table, contents=True))
        done = pa.concat_tables([finish(table, found), finish(same, unit.whole(same))])
        forget()
        return done
    return docs.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(run, schema)


def repeated_windows(docs, unit, decide, finish, schema, between_documents, hot_chunks=HOT_CHUNKS):
    """The whole job; see the text at the top. `docs` come from `chunked`."""
    same = copies(docs)
    repeated = repeated_anchors(anchors(docs, unit, between_documents), hot_chunks)
    repeated = repeated.unionByName(same.select(
        "chunk", F.lit(0).cast("long").alias("anchor"), F.lit(False).alias("hot"), "text_id", "check", "low"))
    marks = answered(contexts(docs, repeated, unit), unit, decide)
    marks = marks.unionByName(same.select(
        "chunk", F.col("text_id").alias("content"), F.lit(COPY).alias("first"), F.col("check").alias("last"), "low"))
    return with_marks(docs, marks, unit, finish, schema)

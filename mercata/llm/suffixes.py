"""Suffix-array dedup: deep-shallow sorting of the suffixes that may repeat."""

import numpy as np
import pyarrow as pa
from pyspark.sql.types import StructType

from . import repeats
from .arrays import byte_units, union_ranges

STEP = 8  # bytes that are compared at once, as one big-endian number
SHALLOW = 16


def _loader(data, length):
    """depth -> the STEP bytes at that depth of given suffixes, zero beyond `length`."""
    padded = np.concatenate([data, np.zeros(length + STEP, np.uint8)])
    view = np.ndarray((len(padded) - STEP + 1,), ">u8", padded, strides=(1,))

    def load(suffixes, depth):
        value = view[suffixes + depth].astype(np.uint64)
        spare = depth + STEP - length
        return value >> np.uint64(8 * spare) << np.uint64(8 * spare) if spare > 0 else value
    return load


def _split(suffixes, group, keys):
    """Order each group by key; members with equal keys form the new groups."""
    order = np.lexsort((keys, group))
    suffixes, group, keys = suffixes[order], group[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (group[1:] != group[:-1]) | (keys[1:] != keys[:-1])
    return suffixes, np.cumsum(new) - 1, new


def deep_shallow(data, suffixes, length, shallow=SHALLOW):
    """(suffixes in order of their first `length` bytes, True where a new string starts).

    Shallow: multikey quicksort with eight bytes as one character, down to `shallow`
    bytes. Deep: the groups that still tie become blind tries, all groups at a time: a
    node stores only the depth at which its members first differ from the leader, skips
    to it without looking at what lies between, and branches on the bytes there.
    """
    load = _loader(data, length)
    n = len(suffixes)
    suffixes = suffixes.astype(np.int64)
    group = np.zeros(n, np.int64)
    depths = list(range(0, length, STEP))
    new = np.zeros(n, bool)
    new[:1] = True
    for depth in [d for d in depths if d < shallow]:
        size = np.bincount(group) if n else np.zeros(0, np.int64)
        open_ = np.flatnonzero(size[group] > 1) if n else np.zeros(0, np.int64)
        if not len(open_):
            return suffixes, new
        sub, _, begins = _split(suffixes[open_], group[open_], load(suffixes[open_], depth))
        suffixes[open_] = sub
        new[open_] = begins | new[open_]
        group = np.cumsum(new) - 1
    deep = [d for d in depths if d >= shallow]
    live = np.flatnonzero(np.bincount(group)[group] > 1) if n else np.zeros(0, np.int64)
    while len(live) and deep:
        own = group[live]
        heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        leader = np.repeat(suffixes[live][heads], np.diff(np.append(heads, len(own))))
        skip = np.full(len(live), len(deep))
        for i in range(len(deep) - 1, -1, -1):
            differs = load(suffixes[live], deep[i]) != load(leader, deep[i])
            skip[differs] = i
        node = np.minimum.reduceat(skip, heads)
        depth = np.repeat(node, np.diff(np.append(heads, len(own))))
        inner = depth < len(deep)  # the others are leaves: equal to the last byte
        live, own, depth = live[inner], own[inner], depth[inner]
        if not len(live):
            break
        keys = np.zeros(len(live), np.uint64)
        for i in np.unique(depth):
            at = depth == i
            keys[at] = load(suffixes[live[at]], deep[i])
        sub, _, begins = _split(suffixes[live], own, keys)
        suffixes[live] = sub
        new[live] = begins | new[live]
        group = np.cumsum(new) - 1
        live = live[np.bincount(group)[group[live]] > 1]
    return suffixes, new


class ByteUnit(repeats.Unit):
    def units(self, offsets, data):
        return byte_units(data), offsets, None

    def bounds(self, offsets, data):
        return offsets, None

    def cut(self, data, spots, first, last):
        return data[first:last + self.length]


def decide_by_sorting(length):
    """For each window of a shard, the smallest document that holds the same bytes."""
    def decide(shard, context, low, many):
        del shard, many
        offsets = np.frombuffer(context.buffers()[1], np.int32)[context.offset:context.offset + len(context) + 1]
        data = np.frombuffer(context.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
        offsets = offsets.astype(np.int64) - offsets[0]
        n_windows = np.diff(offsets) - length + 1
        row = np.repeat(np.arange(len(n_windows)), n_windows)
        place = np.arange(len(row)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
        start = offsets[row] + place
        ordered, new = deep_shallow(data, start, length)
        window_at = np.zeros(len(data) + 1, np.int64)
        window_at[start] = np.arange(len(start))
        window = window_at[ordered]
        heads = np.flatnonzero(new)
        least = np.minimum.reduceat(low[row[window]], heads)
        lowest = np.empty(len(window), np.int64)
        lowest[window] = np.repeat(least, np.diff(np.append(heads, len(window))))
        begins = np.ones(len(row), bool)
        begins[1:] = (row[1:] != row[:-1]) | (lowest[1:] != lowest[:-1])
        first = np.flatnonzero(begins)
        last = np.append(first[1:], len(row)) - 1
        return row[first], place[first], place[last], lowest[first]
    return decide


def remove_repeated_bytes(docs, window=50, id_col="doc_id", text_col="text", anchor_bytes=20,
                          hot_chunks=repeats.HOT_CHUNKS, keep_columns=False, as_text=False):
    """Remove every byte that a window also found in a smaller doc_id covers.

    Texts are UTF-8 bytes, a window is `window` consecutive bytes of one document, all
    windows are judged on the input. Windows that may repeat gather in shards by their
    anchor; a shard sorts its suffixes deep-shallow, so equal windows stand together,
    and reads off the smallest document of each.

    Returns doc_id, n_bytes, n_removed, kept (the remaining bytes) and spans (removed
    byte runs, in order, maximal), one row per input row; with `keep_columns` also the
    struct `rest` of the other input columns; with `as_text` kept is a string, without
    the characters that a cut has left incomplete. A null or empty text is no bytes; a null
    doc_id counts as larger than all others; rows with the same doc_id never remove each
    other's bytes; an empty table gives no rows.
    """
    unit = ByteUnit(window, min(anchor_bytes, window))
    rows = repeats.chunked(docs, id_col, text_col, keep_columns)
    schema = ("doc_id long, n_bytes long, n_removed long, "
              f"kept {'string' if as_text else 'binary'}, spans array<struct<start:long,end:long>>")
    schema = StructType.fromDDL(schema)
    if keep_columns:
        schema = schema.add("rest", rows.schema["rest"].dataType)

    def finish(table, parts):
        n_bytes, n_removed, kept, spans = [], [], [], []
        for offsets, data, _, _, first, last in parts:
            start, end, doc = union_ranges(first, last + window, offsets)
            raw = data.tobytes()
            begins = np.searchsorted(doc, np.arange(len(offsets)))
            for i in range(len(offsets) - 1):
                own = [(int(s), int(e)) for s, e in zip(start[begins[i]:begins[i + 1]],
                                                        end[begins[i]:begins[i + 1]], strict=True)]
                at, pieces = int(offsets[i]), []
                for s, e in own:
                    pieces.append(raw[at:s])
                    at = e
                pieces.append(raw[at:offsets[i + 1]])
                text = b"".join(pieces)
                size = int(offsets[i + 1] - offsets[i])
                n_bytes.append(size)
                n_removed.append(size - len(text))
                kept.append(text.decode("utf-8", "ignore") if as_text else text)
                spans.append([{"start": s - int(offsets[i]), "end": e - int(offsets[i])} for s, e in own])
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        out = {"doc_id": table.column("doc_id"), "n_bytes": pa.array(n_bytes, pa.int64()),
               "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.string() if as_text else pa.binary()),
               "spans": pa.array(spans, span)}
        if keep_columns:
            out["rest"] = table.column("rest")
        return pa.table(out)

    return repeats.repeated_windows(rows, unit, decide_by_sorting(window), finish, schema,
                                    between_documents=True, hot_chunks=hot_chunks)

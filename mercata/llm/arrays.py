"""Arrow text columns as byte arrays: words, hashes, windows and sampled anchors.

A batch is worked on in slices of whole documents, about SLICE_BYTES of text each,
so memory follows the slice (or one very long document), not the batch.
"""

import ctypes
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
POSITION_BITS = 28  # positions inside a slice; the rest of a key is hash

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so powers can be inverted
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PRIME = (1 << 31) - 1
_P, _BITS = np.uint64(PRIME), np.uint64(31)
_BASES = np.random.default_rng(20260301).integers(1 << 30, PRIME, 2).tolist()
_POWERS = {}


def _folded(x):
    """The same number modulo the prime, 31 bits nearer to it."""
    return (x & _P) + (x >> _BITS)


def _prime_powers(base, n):
    table = np.ones(1, np.uint64)
    while len(table) < n:
        step = np.uint64(pow(base, len(table), PRIME))
        table = np.concatenate([table, _folded(_folded(table * step)) % _P])
    return table[:n].copy()


def _table(name, n, make):
    """A cached table of at least `n` entries, as long as a slice at least."""
    if len(_POWERS.get(name, ())) < n:
        _POWERS[name] = make(max(n, SLICE_BYTES + 1))
    return _POWERS[name]


def _wide_powers(base, n):
    table = np.full(n, base, np.uint64)
    table[0] = 1
    return np.multiply.accumulate(table)


def prime_powers(lane, up, n):
    """Powers of a base modulo the prime, or of its inverse."""
    base = _BASES[lane] if up else pow(_BASES[lane], -1, PRIME)
    return _table((lane, up), n, lambda size: _prime_powers(base, size).astype(np.uint32))


def forget():
    """Give what a task has used back to the system: tables of a very long text, free pages."""
    for name in [k for k, table in _POWERS.items() if len(table) > SLICE_BYTES + 1]:
        del _POWERS[name]
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


_TRIM = _trim()


def mix(x):
    """A bijective 64-bit finish: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def text_buffers(column):
    """(offsets, bytes) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets, data


def slices(column, limit=SLICE_BYTES):
    """(first row, offsets from 0, bytes) for runs of whole documents."""
    offsets, data = text_buffers(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, offsets[first:last + 1] - offsets[first], data[offsets[first]:offsets[last]]
        first = last


def batches_of(batch, rows=256):
    """A batch in parts of some rows."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def is_space(data):
    """Bytes 0x09-0x0D and 0x20."""
    return (data == 32) | ((data >= 9) & (data <= 13))


class Words(NamedTuple):
    start: np.ndarray  # first byte of a word
    end: np.ndarray  # byte after it
    offsets: np.ndarray  # first word of each document, and the end


def words(offsets, data):
    """Maximal runs of bytes that are not white space, inside each document."""
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(offsets), np.int64))
    solid = ~is_space(data)
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    inner = offsets[offsets < len(data)]
    before[inner] = False
    start = np.flatnonzero(solid & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    after[inner[inner > 0] - 1] = False
    end = np.flatnonzero(solid & ~after) + 1
    return Words(start, end, np.searchsorted(start, offsets))


def range_hashes(sums, start, end, down):
    """64-bit hashes of unit ranges, from the running sums of `running`.

    Two polynomials modulo a prime with random bases: unlike one modulo 2^64, no pair of
    texts is sure to agree in them, whatever its pattern.
    """
    value = (end - start).astype(np.uint64) * _BASE
    for lane, (total, back) in enumerate(zip(sums, down, strict=True)):
        part = _folded(_folded(_folded(_folded(total[end] - total[start])) * back[start]))
        part = _folded(part)
        value += np.where(part >= _P, part - _P, part) << np.uint64(31 * lane)
    return mix(value)


def _running(parts):
    n, sums = len(parts[0]), []
    for lane, x in enumerate(parts):
        x = x * prime_powers(lane, True, n + 1)[:n]
        high = x >> _BITS
        x &= _P
        x += high
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(x, out=total[1:])
        sums.append(total)
    return sums, [prime_powers(lane, False, n + 1) for lane in range(len(parts))]


def _parts(units):
    """31 bits of each unit for each base."""
    return [(units >> shift) & _P for shift in (np.uint64(33), np.uint64(2))]


_BYTE_PARTS = _parts(_BYTES)


def running(units):
    """Running sums of unit * base^position for each base, one longer than the units."""
    return _running(_parts(units))


def running_bytes(data):
    """The same as `running(byte_units(data))`."""
    return _running([table[data] for table in _BYTE_PARTS])


def gram_hashes(units, k):
    """Hashes of all k-grams for sampling; patterned texts may share some."""
    n = len(units)
    up = _table("up", n + 1, lambda size: _wide_powers(_BASE, size))
    down = _table("down", n + 1, lambda size: _wide_powers(_INVERSE, size))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(units * up[:n], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[:n - k + 1])


def byte_units(data):
    return _BYTES[data]


def word_units(data, w):
    """One 64-bit hash for each word."""
    sums, down = running_bytes(data)
    return range_hashes(sums, w.start, w.end, down)


def eights(data):
    """The eight bytes at each place as one number, the first one lowest; needs 8 spare bytes."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


def with_spare(data):
    return np.concatenate([data, np.zeros(8, np.uint8)])


def same_bytes(a, a_start, b, b_start, size):
    """Whether ranges of `a` and `b` hold the same bytes; both have 8 spare bytes."""
    a, b = eights(a), eights(b)
    same, rows, depth = np.ones(len(size), bool), np.flatnonzero(size > 0), 0
    while len(rows):
        left = size[rows] - depth
        spare = np.uint64(8) * (8 - np.minimum(left, 8)).astype(np.uint64)
        differ = (a[a_start[rows] + depth] ^ b[b_start[rows] + depth]) << spare
        same[rows[differ != 0]] = False
        rows, depth = rows[(differ == 0) & (left > 8)], depth + 8
    return same


class Runs(NamedTuple):
    """Consecutive windows of a document with the same anchor occurrence."""
    doc: np.ndarray  # row inside the slice
    first: np.ndarray  # first window start, in units of the slice
    last: np.ndarray  # last window start
    anchor: np.ndarray  # hash of the anchor
    content: np.ndarray  # hash of all units the windows cover, if asked for


def anchored_runs(units, offsets, length, k, contents=True):
    """Windows of `length` units, grouped by their anchor.

    The anchor of a window is its k-gram with the smallest hash, the leftmost of
    equals. It depends on the window's content only, so two equal windows have equal
    anchors; about 2 / (length - k + 2) of all positions are anchors.
    """
    n, none = len(units), np.zeros(0, np.int64)
    empty = Runs(none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    if n < length:
        return empty
    grams = gram_hashes(units, k)
    mask = np.uint64((1 << POSITION_BITS) - 1)
    if n > int(mask):
        raise ValueError(f"a document has more than {int(mask)} units")
    least = (grams & ~mask) | np.arange(n - k + 1, dtype=np.uint64)
    width, done = length - k + 1, 1
    while done * 2 <= width:  # minimum over windows of twice the width
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if done < width:
        least = np.minimum(least[:len(least) - (width - done)], least[width - done:])
    at = (least & mask).astype(np.int64)  # by window start
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(at)]
    whole = np.arange(len(at)) + length <= offsets[1:][doc]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | ~whole[:-1]
    first = np.flatnonzero(new & whole)
    if not len(first):
        return empty
    stop = np.ones(len(at), bool)
    stop[:-1] = new[1:] | ~whole[1:]
    last = np.flatnonzero(stop & whole)
    content = None
    if contents:
        sums, down = running(units)
        content = range_hashes(sums, first, last + length, down)
    return Runs(doc[first], first, last, grams[at[first]], content)


def union_ranges(start, end, offsets):
    """Sorted disjoint (start, end, document) of ranges; a document's own stay apart."""
    if not len(start):
        return start, end, start
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    doc = np.searchsorted(offsets, start, "right") - 1
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] > reach[:-1]) | (doc[1:] != doc[:-1])
    begins = np.flatnonzero(new)
    return start[begins], reach[np.append(begins[1:], len(start)) - 1], doc[begins]

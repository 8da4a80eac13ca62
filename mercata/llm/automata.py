"""Substring dedup: suffix automata of reference shards and matching statistics."""

import numpy as np
import pyarrow as pa
from pyspark.sql.types import StructType

from . import repeats
from .arrays import union_ranges, words, word_units


class SuffixAutomaton:
    """Automaton of all substrings of the added sequences, with occurrence counts."""

    def __init__(self):
        self.next, self.link, self.length, self.count = [{}], [-1], [0], [0]

    def _state(self, length, edges, link):
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.next) - 1

    def _split(self, p, symbol, q):
        """Give the short strings of state q a state of their own."""
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def add(self, sequence, weight):
        """Add a sequence that occurs `weight` times."""
        edges, link, length, count = self.next, self.link, self.length, self.count
        last = 0
        for symbol in sequence:
            q = edges[last].get(symbol)
            if q is not None:  # known from an earlier sequence
                last = q if length[q] == length[last] + 1 else self._split(last, symbol, q)
            else:
                new, p = self._state(length[last] + 1, {}, 0), last
                while p >= 0 and symbol not in edges[p]:
                    edges[p][symbol] = new
                    p = link[p]
                if p >= 0:
                    q = edges[p][symbol]
                    link[new] = q if length[q] == length[p] + 1 else self._split(p, symbol, q)
                last = new
            count[last] += weight

    def finish(self):
        """Counts of longer strings also count for their suffixes."""
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[state]] += self.count[state]
        self.count[0] = 0

    def matching(self, sequence, cap):
        """(length of the longest match that ends here, at most cap; its occurrences)."""
        edges, link, length, count = self.next, self.link, self.length, self.count
        state, matched = 0, 0
        for symbol in sequence:
            while state and symbol not in edges[state]:
                state = link[state]
                matched = length[state]
            if symbol in edges[state]:
                state = edges[state][symbol]
                matched += 1
            while state and length[link[state]] >= cap:
                state = link[state]
            matched = min(matched, length[state], cap)
            yield matched, count[state]


class WordUnit(repeats.Unit):
    def units(self, offsets, data):
        spots = words(offsets, data)
        return word_units(data, spots), spots.offsets, spots

    def bounds(self, offsets, data):
        spots = words(offsets, data)
        return spots.offsets, spots

    def cut(self, data, spots, first, last):
        return b" ".join(data[spots.start[first]:spots.end[last + self.length - 1]].split())


def decide_by_automaton(length):
    """Windows of a shard that occur at least twice, by matching statistics."""
    def decide(shard, context, low, many):
        del low
        rows, firsts, lasts = [], [], []
        texts = context.to_pylist()
        bounds = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])), len(shard)).tolist()
        for start, stop in zip(bounds[:-1], bounds[1:], strict=True):
            members = {}
            for i in range(start, stop):
                members.setdefault(texts[i], []).append(i)
            weight = {t: len(at) + any(many[i] for i in at) for t, at in members.items()}
            if len(members) == 1:  # nothing to match but itself
                spans = {t: [(0, t.count(b" ") + 1 - length)] if w > 1 else [] for t, w in weight.items()}
            else:
                reference = SuffixAutomaton()
                streams = {t: t.split(b" ") for t in members}
                for text, stream in streams.items():
                    reference.add(stream, weight[text])
                reference.finish()
                spans = {t: list(_spans(reference.matching(s, length), length)) for t, s in streams.items()}
            for text, at in members.items():
                for first, last in spans[text]:
                    rows += at
                    firsts += [first] * len(at)
                    lasts += [last] * len(at)
        row = np.array(rows, np.int64)
        return row, np.array(firsts, np.int64), np.array(lasts, np.int64), np.full(len(row), -repeats.LAST_ID)
    return decide


def _spans(statistics, length):
    """Runs of window starts whose window occurs at least twice."""
    begin = None
    end = -1
    for end, (matched, count) in enumerate(statistics):
        if matched >= length and count > 1:
            begin = end - length + 1 if begin is None else begin
        elif begin is not None:
            yield begin, end - length
            begin = None
    if begin is not None:
        yield begin, end - length + 1


def remove_repeated_words(docs, window=35, id_col="doc_id", text_col="text", anchor_words=8,
                          hot_chunks=repeats.HOT_CHUNKS, keep_columns=False):
    """Remove every word that a repeated window of `window` words covers.

    A window is repeated if its words, unchanged, also start anywhere else, in another
    document or in its own; all windows are judged on the input. Words are maximal runs
    of bytes other than 0x20 and 0x09-0x0D. Repeated windows gather in shards by their
    anchor; each shard of reference text becomes a suffix automaton with occurrence
    counts, past which the texts of the shard stream for their matching statistics.

    Returns doc_id, n_words, n_removed, kept (the other words joined by one space) and
    spans (first word and word after the last, in order, disjoint), one row per input
    row; with `keep_columns` also the struct `rest` of the other input columns. A null
    or empty text has no words; a null doc_id is kept as null; equal rows repeat each
    other; documents shorter than a window lose nothing; an empty table gives no rows.
    """
    unit = WordUnit(window, min(anchor_words, window))
    rows = repeats.chunked(docs, id_col, text_col, keep_columns)
    schema = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:long,end:long>>"
    schema = StructType.fromDDL(schema)
    if keep_columns:
        schema = schema.add("rest", rows.schema["rest"].dataType)

    def finish(table, parts):
        n_words, n_removed, kept, spans = [], [], [], []
        for offsets, data, spots, where, first, last in parts:
            start, end, doc = union_ranges(first, last + window, where)
            raw = data.tobytes()
            begins = np.searchsorted(doc, np.arange(len(where)))
            for i in range(len(where) - 1):
                n = int(where[i + 1] - where[i])
                a, b = begins[i], begins[i + 1]
                own = [(int(s - where[i]), int(e - where[i])) for s, e in zip(start[a:b], end[a:b], strict=True)]
                text = raw[offsets[i]:offsets[i + 1]].split()
                for s, e in reversed(own):
                    del text[s:e]
                n_words.append(n)
                n_removed.append(n - len(text))
                kept.append(b" ".join(text).decode("utf-8"))
                spans.append([{"start": s, "end": e} for s, e in own])
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        out = {"doc_id": table.column("doc_id"), "n_words": pa.array(n_words, pa.int64()),
               "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.string()),
               "spans": pa.array(spans, span)}
        if keep_columns:
            out["rest"] = table.column("rest")
        return pa.table(out)

    return repeats.repeated_windows(rows, unit, decide_by_automaton(window), finish, schema,
                                    between_documents=False, hot_chunks=hot_chunks)

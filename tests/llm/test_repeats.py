import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mercata.llm import arrays, automata, repeats, suffixes
from mercata.session import ship

from . import helpers as h


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    return h.with_clashes(spark, h.odd_documents())


def pairs():
    return [(r[0], r[1]) for r in h.odd_documents()]


@pytest.mark.parametrize("hot", [256, 2])
def test_repeated_words_equal_brute_force(docs, hot):
    got = automata.remove_repeated_words(docs, window=35, hot_chunks=hot)
    rows = [tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept").collect()]
    assert h.ordered(rows) == h.ordered(h.repeated_words(pairs(), 35))


@pytest.mark.parametrize("hot", [256, 2])
def test_repeated_bytes_equal_brute_force(docs, hot):
    got = suffixes.remove_repeated_bytes(docs, window=50, hot_chunks=hot)
    rows = [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got.collect()]
    assert h.ordered(rows) == h.ordered(h.repeated_bytes(pairs(), 50))


@pytest.mark.parametrize("name", ["words", "bytes"])
def test_test_table_equals_brute_force(spark, name):
    ship(spark)
    docs = spark.read.parquet(f"{h.SF}/documents.parquet")
    own = [(r.doc_id, r.text) for r in docs.collect()]
    if name == "words":
        got = automata.remove_repeated_words(docs).select("doc_id", "n_words", "n_removed", "kept")
        assert h.ordered(map(tuple, got.collect())) == h.ordered(h.repeated_words(own, 35))
    else:
        rows = [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept))
                for r in suffixes.remove_repeated_bytes(docs).collect()]
        assert h.ordered(rows) == h.ordered(h.repeated_bytes(own, 50))


@pytest.mark.parametrize("name", ["words", "bytes"])
def test_anchors_with_equal_leading_bits(spark, name):
    """Anchors in many chunks and in few that share their first 32 bits stay apart."""
    ship(spark)
    rng = random.Random(11)
    hot = h.passage(rng, 200)
    rows = []
    for i in range(24):
        pair = h.passage(rng, 45)
        start = hot if i < 10 else h.passage(rng, 45)
        rows += [(2 * i, f"{start} {h.passage(rng, 5)} {pair}"), (2 * i + 1, f"{h.passage(rng, 5)} {pair}")]
    base, length, k, decide = ((automata.WordUnit, 35, 8, automata.decide_by_automaton(35)) if name == "words"
                               else (suffixes.ByteUnit, 50, 20, suffixes.decide_by_sorting(50)))

    class Short(base):
        def runs_in(self, table, contents=False):
            for *parts, runs in super().runs_in(table, contents):
                yield *parts, runs._replace(anchor=runs.anchor >> np.uint64(48) << np.uint64(16))

    def finish(table, parts):
        removed = []
        for _, _, _, where, first, last in parts:
            start, end, doc = arrays.union_ranges(first, last + length, where)
            removed += np.bincount(doc, end - start, len(where) - 1).astype(int).tolist()
        return pa.table({"doc_id": table.column("doc_id"), "n_removed": pa.array(removed, pa.int64())})

    docs = repeats.chunked(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    got = repeats.repeated_windows(docs, Short(length, k), decide, finish, "doc_id long, n_removed long",
                                   between_documents=name == "bytes", hot_chunks=5)
    want = {r[0]: r[2] for r in (h.repeated_words if name == "words" else h.repeated_bytes)(rows, length)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # shards in tasks of their own
    try:
        found = {r.doc_id: r.n_removed for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert found == want


def test_patterned_words_are_told_apart(spark):
    """Long words with a pattern that simple rolling hashes confuse."""
    ship(spark)
    rows = []
    for n in (64, 1024, 4096):
        a, b = h.patterned(n)
        rng = random.Random(n)
        left, right = h.passage(rng, 30), h.passage(rng, 30)
        rows += [(n + i, f"{left} {w} {right}") for i, w in enumerate((a, b, a))]
        rows += [(n + 9 + i, f"x{w}") for i, w in enumerate((a, b))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = automata.remove_repeated_words(docs, window=35).collect()
    assert h.ordered((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == h.ordered(h.repeated_words(rows, 35))
    got = suffixes.remove_repeated_bytes(docs, window=50).collect()
    assert h.ordered((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept) for r in got) == h.ordered(h.repeated_bytes(rows, 50))


def test_other_columns_and_text_come_back(docs):
    got = suffixes.remove_repeated_bytes(docs, keep_columns=True, as_text=True).collect()
    assert len(got) == len(h.odd_documents())
    for r in got:
        assert r.rest["chunk"] == "chunk" and r.rest["doc_id"] == r.doc_id and "�" not in r.kept


@pytest.mark.parametrize("run", [automata.remove_repeated_words, suffixes.remove_repeated_bytes])
def test_empty_table(spark, run):
    ship(spark)
    assert run(spark.createDataFrame([], h.SCHEMA)).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.text("ab ", max_size=60), st.integers(1, 3)), min_size=1, max_size=4))
def test_automaton_counts_occurrences(texts):
    sequences = [(list(t), n) for t, n in texts]
    machine = automata.SuffixAutomaton()
    for s, n in sequences:
        machine.add(s, n)
    machine.finish()
    for s, _ in sequences:
        for end, (matched, count) in enumerate(machine.matching(s, 4)):
            assert matched == min(end + 1, 4)
            part = s[end + 1 - matched:end + 1]
            assert count == sum(n * sum(o[i:i + matched] == part for i in range(len(o) - matched + 1))
                                for o, n in sequences)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300).map(lambda b: bytes(x % 3 for x in b)), st.integers(1, 60))
def test_deep_shallow_order(data, length):
    starts = np.arange(max(len(data) - length + 1, 0))
    order, new = suffixes.deep_shallow(np.frombuffer(data, np.uint8), starts, length)
    own = [data[i:i + length] for i in order.tolist()]
    assert own == sorted(own)
    assert new.tolist() == [i == 0 or own[i] != own[i - 1] for i in range(len(own))]


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(3)
    units = arrays.mix(rng.integers(0, 4, 3000, dtype=np.uint64))
    offsets = np.array([0, 1000, 1010, 3000])
    runs = arrays.anchored_runs(units, offsets, 12, 4)
    anchor = {}
    seen = 0
    for a, b, key in zip(runs.first.tolist(), runs.last.tolist(), runs.anchor.tolist(), strict=True):
        for s in range(a, b + 1):
            seen += 1
            assert anchor.setdefault(tuple(units[s:s + 12].tolist()), key) == key
    assert seen == 1000 - 11 + 1990 - 11

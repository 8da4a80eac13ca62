import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mercata.llm import queries, tiling
from mercata.session import ship

from . import helpers as h


def plain_tiles(pattern, text, least):
    """Greedy string tiling by trying every pair of places."""
    p, t = list(pattern), list(text)
    used_p, used_t, total = [False] * len(p), [False] * len(t), 0
    while True:
        best = 0
        matches = []
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] \
                        and not used_p[i + n] and not used_t[j + n]:
                    n += 1
                if n > best:
                    best, matches = n, []
                if n == best and n:
                    matches.append((i, j))
        if best < least:
            return total
        for i, j in matches:
            if not any(used_p[i:i + best]) and not any(used_t[j:j + best]):
                used_p[i:i + best] = used_t[j:j + best] = [True] * best
                total += best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=30), st.lists(st.integers(1, 3), max_size=40), st.integers(1, 4))
def test_tiles_are_greedy(pattern, text, least):
    found = tiling.tiles(np.array(pattern, np.uint64), np.array(text, np.uint64), least)
    used_p, used_t = set(), set()
    for i, j, n in found:
        assert n >= least and pattern[i:i + n] == text[j:j + n]
        assert not used_p & set(range(i, i + n)) and not used_t & set(range(j, j + n))
        used_p |= set(range(i, i + n))
        used_t |= set(range(j, j + n))
    assert len(used_p) == plain_tiles(pattern, text, least)


ITEMS = "item_id long, text string"


def tables(spark):
    rng = random.Random(3)
    items = [h.passage(rng, 30) for _ in range(4)]
    one = items[0].split()
    moved = " ".join(one[15:] + one[:15])
    docs = [(1, h.passage(rng, 50) + " " + items[0] + " " + h.passage(rng, 50)),
            (2, h.passage(rng, 20) + " " + moved), (3, h.passage(rng, 200)), (4, None), (5, ""),
            (6, items[1].upper().replace(" ", ", ")), (7, " ".join(items[2].split()[:10])),
            (None, items[3]), (8, items[3]), (8, items[3]), (9, "who am i")]
    bench = [(n, t) for n, t in enumerate(items)] + [(90, None), (91, "..."), (92, "Who am I?"), (None, items[0]),
                                                     (93, items[3])]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, ITEMS)


@pytest.mark.parametrize("block", [1 << 20, 1])
def test_reordered_and_restyled_passages(spark, block):
    ship(spark)
    docs, bench = tables(spark)
    got = [(r.doc_id, r.item_id, r.coverage) for r in tiling.contaminated(docs, bench, block_bytes=block).collect()]
    assert h.ordered(got) == h.ordered([
        (1, 0, 1.0), (2, 0, 1.0), (6, 1, 1.0), (None, 3, 1.0), (8, 3, 1.0), (8, 3, 1.0), (9, 92, 1.0),
        (None, 93, 1.0), (8, 93, 1.0), (8, 93, 1.0)])


def test_clean_rows_keep_their_columns(spark):
    ship(spark)
    docs, bench = tables(spark)
    docs = docs.selectExpr("*", "1 AS item_id", "'x' AS _found", "2 AS coverage")
    kept = tiling.clean_documents(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == [-1, 3, 4, 5, 7]


def test_empty_tables(spark):
    ship(spark)
    docs, bench = tables(spark)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert tiling.contaminated(none, bench).collect() == []
    assert tiling.contaminated(docs, spark.createDataFrame([], ITEMS)).collect() == []
    assert tiling.clean_documents(docs, spark.createDataFrame([], ITEMS)).count() == docs.count()


def test_registered_query_equals_plain_tiling(spark):
    sf = "/root/testdata/sf0.001"

    def tokens(text):
        return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text.lower())
    items = {r.item_id: tokens(r.text) for r in queries.table(spark, sf, "benchmark").collect()}
    want = set()
    for r in queries.documents(spark, sf).where("text IS NOT NULL").collect():
        text = tokens(r.text)
        seeds = {tuple(text[i:i + 5]) for i in range(len(text) - 4)}
        for item_id, item in items.items():
            shared = sum(tuple(item[i:i + 5]) in seeds for i in range(len(item) - 4))
            if 5 * shared >= 0.5 * len(item):  # fewer seeds cannot cover half of it
                n = plain_tiles(item, text, 5)
                if n >= 0.5 * len(item):
                    want.add((r.doc_id, item_id, len(item), n))
    got = queries.QUERIES["op5_decontamination"](spark, sf).collect()
    assert {(r.doc_id, r.item_id, r.n_item_tokens, r.n_matched) for r in got} == want and want


def test_registered_query_finds_whole_passages(spark):
    found = {(r.doc_id, r.item_id) for r in queries.QUERIES["op5_decontamination"](spark, h.SF).collect()}
    docs = queries.documents(spark, h.SF).collect()
    items = queries.table(spark, h.SF, "benchmark").collect()
    whole = {(d.doc_id, i.item_id) for d in docs for i in items if i.text in d.text}
    assert whole and whole <= found

import random

import numpy as np
import pytest

from mercata.llm import components, queries, sketch
from mercata.session import ship

from . import helpers as h


def test_odd_documents(spark):
    ship(spark)
    rows = [r for r in h.odd_documents() if r[0] not in (None, 30)]
    docs = h.with_clashes(spark, rows + [r for r in h.odd_documents() if r[0] is None])
    got = sketch.near_duplicates(docs).collect()
    assert len(got) == len(rows) + 2
    want = h.near_groups([(r[0], r[1]) for r in rows])
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)


def test_same_doc_id_is_one_document(spark):
    ship(spark)
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "x y z"), (2, "x y z")], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in sketch.near_duplicates(docs).collect())
    assert got == [(1, 1), (1, 1), (2, 1)]


def test_rows_of_one_doc_id_link_their_texts(spark):
    """Document 9 is a near copy of 5 and a copy of 2; 7 has words in one row only."""
    ship(spark)
    rng = random.Random(1)
    near = h.passage(rng, 100)
    other = near.replace(near.split()[50], "CHANGED", 1)
    rows = [(5, near), (9, other), (9, "x y z"), (2, "x y z"), (7, ""), (7, "p q"), (7, None), (3, "p q"), (8, "")]
    got = {(r.doc_id, r.component_id) for r in sketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 2), (9, 2), (2, 2), (7, 3), (3, 3), (8, 8)}


def test_patterned_words_are_told_apart(spark):
    ship(spark)
    a, b = h.patterned()
    rows = [(1, a), (2, b), (3, a), (4, f"{a} one two three four"), (5, f"{b} one two three four")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in
           sketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == h.near_groups(rows)


def test_chains_bridges_and_hubs(spark):
    """Links between documents neither of which is linked with the smallest of the group."""
    ship(spark)
    rng = random.Random(9)
    rows, doc = [], 0
    for _ in range(6):
        base = h.passage(rng, 80).split()
        for step in range(9):  # each step moves on, so only neighbours are linked
            rows.append((doc := doc + 1, " ".join(base)))
            base = base[3:] + h.passage(rng, 3).split()
        rng.shuffle(rows)
    hub = h.passage(rng, 200).split()
    for _ in range(60):
        own = list(hub)
        for i in rng.sample(range(200), 3):
            own[i] = "changed" + str(rng.random())
        rows.append((doc := doc + 1, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in sketch.near_duplicates(docs).collect()}
    assert got == h.near_groups(rows)


def test_registered_query_equals_brute_force(spark):
    rows = queries.QUERIES["op3_near_dedup"](spark, h.SF).collect()
    want = h.near_groups([(r.doc_id, r.text) for r in queries.documents(spark, h.SF).collect()])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_empty_table(spark):
    ship(spark)
    assert sketch.near_duplicates(spark.createDataFrame([], h.SCHEMA)).collect() == []


@pytest.mark.parametrize("n", [1, 2, 7, 100, 3000])
def test_every_coordinate_fills(n):
    t = 192
    elements = np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64)
    made = sketch.sketch(elements, t, sketch._seeds(t))
    assert (made != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    assert (made == sketch.sketch(elements[::-1].copy(), t, sketch._seeds(t))).all()


def test_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    t = 192
    shares = []
    for _ in range(40):
        both = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
        a = np.concatenate([both, rng.integers(0, 1 << 63, 50, dtype=np.uint64)])
        b = np.concatenate([both, rng.integers(0, 1 << 63, 50, dtype=np.uint64)])
        shares.append((sketch.sketch(a, t, sketch._seeds(t)) == sketch.sketch(b, t, sketch._seeds(t))).mean())
    assert abs(np.mean(shares) - 0.75) < 0.02


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 3), (5, 6), (6, 5), (7, 7), (20, 10), (30, 20), (40, 30), (50, 40)]
    found = components.components(spark.createDataFrame(links, "a long, b long"), "a", "b")
    got = {r.node: r.component for r in found.collect()}
    assert got == {2: 1, 3: 1, 9: 1, 6: 5, 20: 10, 30: 10, 40: 10, 50: 10}

import collections
import math
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from mercata.llm import queries, ranking
from mercata.session import ship

from . import helpers as h

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def by_brute_force(docs, items, k=50):
    """Rows (item_id, rank, doc_id, score), item by item."""
    bags = [(i, collections.Counter(terms(t))) for i, t in docs]
    n_docs = sum(bool(b) for _, b in bags)
    n_terms = sum(b.total() for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    out = []
    for item_id, text in items:
        found = []
        for doc_id, bag in bags:
            score = 0
            for t in set(terms(text)) & bag.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                m = 100 - 50 + 50 * bag.total() * n_docs // n_terms
                score += w * (10**9 * bag[t] // (1000 * bag[t] + 20 * m))
            if score > 0:
                found.append((-score, doc_id is None, doc_id))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item_id, n + 1, d, -s) for n, (s, _, d) in enumerate(found[:k])]
    return out


def rows_of(df):
    return h.ordered(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


def test_query_equals_sql_and_brute_force(spark):
    sf = h.SF
    got = rows_of(queries.QUERIES["op11_lexical_search"](spark, sf))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS FROM '{sf}/{name}.parquet'")
    assert got == h.ordered(con.execute(queries.ORACLE["op11_lexical_search"]).fetchall())
    docs = [(r.doc_id, r.text) for r in queries.documents(spark, sf).collect()]
    items = [(r.item_id, r.text) for r in queries.table(spark, sf, "benchmark").collect()]
    assert got == h.ordered(by_brute_force(docs, items))


ITEMS = [(1, "one two three"), (2, None), (3, "... !!"), (4, "É日本 é日本 Line HERE"), (4, "line other one"), (None, "x zz a"),
         (5, "nowhere-to-be-found"), (6, "ab a b c d e f g h ha bc " * 3)]


@pytest.mark.parametrize(("k", "chunk", "span", "share", "block"), [(50, 1 << 24, 1024, 16, 1 << 20), (3, 2000, 2, 4, 130), (2, 1 << 24, 4, 1, 10)])
def test_odd_documents(spark, monkeypatch, k, chunk, span, share, block):
    """Small chunks, ranges and blocks, so that every path is taken."""
    for name, value in (("CHUNK_BYTES", chunk), ("DOC_RANGE", span), ("SHORT_SHARE", share)):
        monkeypatch.setattr(ranking, name, value)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("rank", F.lit("x"))
    docs = h.with_clashes(spark, h.odd_documents()).withColumn("item_id", F.lit(1))
    got = rows_of(ranking.rank(docs, items, top=k, block_bytes=block))
    assert got == h.ordered(by_brute_force([r[:2] for r in h.odd_documents()], ITEMS, k))


def test_skipping_never_changes_the_best():
    """Chunks of random lists against plain sums, thresholds carried from chunk to chunk."""
    rng = np.random.default_rng(4)
    for _ in range(40):
        n, n_items, k = 300, 5, int(rng.integers(1, 12))
        weight = rng.integers(0, 5, 12)
        asked = [np.unique(rng.integers(0, 12, 6)) for _ in range(n_items)]
        best, plain = [ranking.Top(k) for _ in asked], [[] for _ in asked]
        for part in range(3):
            lists = [np.sort(rng.choice(n, rng.integers(0, n), replace=False)) for _ in range(12)]
            freq = [rng.integers(1, 9, len(x)) for x in lists]
            held = [t for t in range(12) if len(lists[t])]
            row = {"docs": np.concatenate(lists).astype(np.int32).tobytes(), "freqs": np.concatenate(freq).astype(np.int64).tobytes(),
                   "doc_ids": (np.arange(n) + part * n).tobytes(), "no_id": np.zeros(n, bool).tobytes(),
                   "lengths": np.full(n, 9).tobytes(), "terms": held, "counts": [len(lists[t]) for t in held]}
            chunk = ranking.Chunk(row, weight, 900, 8100)
            for terms_, top, every in zip(asked, best, plain, strict=True):
                chunk.search(terms_, top)
                sums = collections.Counter()
                for t in terms_.tolist():
                    for d, f in zip(lists[t].tolist(), freq[t].tolist(), strict=True):
                        sums[d] += int(weight[t]) * (10**9 * f // (1000 * f + 20 * 100))
                every += [(-s, d + part * n) for d, s in sums.items() if s > 0]
        for top, every in zip(best, plain, strict=True):
            assert [(-s, d) for s, d in zip(top.score.tolist(), top.doc.tolist(), strict=True)] == sorted(every)[:k]


def test_terms_of_one_hash_are_told_apart():
    """Words of 1,024 letters that a plain polynomial modulo 2^64 confuses."""
    word = "".join("ab"[i.bit_count() & 1] for i in range(1024)).encode()
    other = word.translate(bytes.maketrans(b"ab", b"ba"))
    known = ranking.Vocabulary({word, other, b"c"})
    for text, want in ((word, word), (other, other), (b"c", b"c"), (b"d", None)):
        data = np.frombuffer(text, np.uint8)
        at, term = known.find(data, ranking.words(np.array([0, len(data)]), data))
        assert [known.terms[t] for t in term] == ([want] if want else [])


@pytest.mark.parametrize(("docs", "items"), [([], ITEMS), ([(1, None)], ITEMS), ([(1, "one")], []), ([(1, "one")], [(1, "!")])])
def test_nothing_found(spark, docs, items):
    ship(spark)
    got = ranking.rank(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0

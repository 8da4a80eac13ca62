import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mercata.operators import chat, picks, vector


@pytest.mark.parametrize("product_blocks,query_blocks", [(None, 1), (1, 1), (7, 3)])
def test_top_k_equals_brute_force_in_any_blocking(spark, product_blocks, query_blocks):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(120, 8)).astype("float32").astype("float64")
    m[40] = m[3]
    p = spark.createDataFrame([(i, [float(x) for x in v], "hot" if i % 3 else "cold")
                               for i, v in enumerate(m)] + [(999, None, "hot")],
                              "id long, embedding array<double>, scope string")
    q = spark.createDataFrame([(i, [float(x) for x in m[i]], None if i % 2 else "cold")
                               for i in range(30)],
                              "qid long, vector array<double>, scope string")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 12)
    got = {}
    for r in vector.top_k(p, q, 5, product_blocks=product_blocks, query_blocks=query_blocks).orderBy(
            "qid", "pos").collect():
        got.setdefault(r["qid"], []).append(r["id"])
    for i in range(30):
        ids = [j for j in range(120) if i % 2 or j % 3 == 0]
        assert got[i] == sorted(ids, key=lambda j: (-sims[i, j], j))[:5]
    hits = vector.match_products(p.withColumnRenamed("scope", "neighbourhood"),
                                 m[7].tolist(), 3, "hot").collect()
    assert hits[0]["id"] == 7 and len(hits) == 3


@pytest.mark.parametrize("block_rows", [20_000, 7])
def test_pruned_search_gives_the_same_answers(spark, block_rows):
    """On vectors in clusters most blocks are never visited."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 6))
    m = np.concatenate([centres[i % 12] + 0.03 * rng.normal(size=6) for i in range(300)]).reshape(300, 6)
    m[5], m[299] = m[4], m[3]
    odd = [(900, None, "a"), (901, [0.0] * 6, "a"), (902, [1.0, 2.0], "a"), (903, [1.0, None], None)]
    p = spark.createDataFrame([(i, v.tolist(), "a" if i % 3 else None) for i, v in enumerate(m)] + odd,
                              "id long, embedding array<double>, scope string")
    q = spark.createDataFrame([(i, m[i * 7].tolist(), None if i % 2 else "a") for i in range(40)]
                              + [(50, [2.0, 1.0], "a"), (51, [1.0], None), (52, [1.0] * 6, "nowhere")],
                              "qid long, vector array<double>, scope string")
    want = sorted(tuple(r) for r in vector.top_k(p, q, 8).select("qid", "id", "similarity", "pos").collect())
    hits, visits = vector.pruned_top_k(p, q, 8, pivots=24, block_rows=block_rows, report=True)
    assert sorted(tuple(r) for r in hits.select("qid", "id", "similarity", "pos").collect()) == want
    seen = visits.agg(F.sum("visited").alias("v"), F.sum("blocks").alias("b")).first()
    assert 0 < seen["v"] < 0.3 * seen["b"]


def test_top_k_takes_text_ids_and_odd_vectors(spark):
    p = spark.createDataFrame([("b", [1.0, 0.0], "s"), ("a", [2.0, 0.0], "s"), ("zero", [0.0, 0.0], "s"),
                               ("none", None, "s"), ("hole", [1.0, None], "s"), ("long", [1.0, 0.0, 0.0], "s"),
                               ("far", [-1.0, 0.0], None)],
                              "id string, embedding array<double>, scope string")
    q = spark.createDataFrame([("q1", [1.0, 0.0], None), ("q2", [1.0, 0.0], "s"), ("q3", [0.0, 0.0], None),
                               ("q4", [1.0], None), ("q5", None, "s")],
                              "qid string, vector array<double>, scope string")
    got = {}
    for r in vector.top_k(p, q, 5).orderBy("qid", "pos").collect():
        got.setdefault(r["qid"], []).append(r["id"])
    assert got == {"q1": ["a", "b", "far"], "q2": ["a", "b"]}
    near = vector.match_products(p, [1.0, 0.0], 5).collect()
    assert [r["id"] for r in near] == ["a", "b", "far"]
    zero = p.filter("id = 'zero'").select(vector.cosine("embedding", F.array(F.lit(1.0), F.lit(0.0))).alias("c"))
    assert zero.first()["c"] is None


def test_a_block_holds_few_similarities_at_a_time(spark):
    """One block of many queries and products, with ties over its cut."""
    rng = np.random.default_rng(8)
    m = rng.normal(size=(3000, 4))
    m[1500:] = m[:1500]
    ids = pa.array(range(3000))
    block = pa.array(m.tolist(), pa.list_(pa.float32()))
    tracemalloc.start()
    got = vector._block_top(5)(pa.table({"qid": ids, "vector": block}), pa.table({"id": ids, "embedding": block}))
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held < 60 << 20  # all similarities are 72 MB
    u = m.astype("float32").astype("float64")
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for i in (0, 7, 1600, 2999):
        sims = np.round(u[i] @ u.T, 12)
        assert [r["id"] for r in got.slice(i * 5, 5).to_pylist()] == sorted(range(3000), key=lambda j: (-sims[j], j))[:5]


def test_neither_side_of_a_search_is_copied_to_every_task(spark):
    q = spark.range(40_000)
    assert vector._grid(q, None, None, 200) == (14, 15)
    assert vector._grid(q.limit(10), None, None, 200) == (200, 1)
    assert vector._grid(q, 7, 3, 200) == (7, 3)


def test_zero_vector_stays(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], ["v"])
    assert [r["u"] for r in df.select(vector.normalise("v").alias("u")).collect()] == [
        [0.0, 0.0], [0.6, 0.8]]


def test_rerank(spark):
    rows = [(1, 0, 0.50, "Leche entera", [], 5), (1, 1, 0.60, "Batido", ["leche"], 0),
            (1, 2, 0.60, "Pan", [], 0), (1, 3, 0.60, "Pan Acme", [], 0)]
    df = spark.createDataFrame(rows, "qid int, pos int, similarity double, name string, "
                               "tags array<string>, stock_qty int").withColumns(
        {"item_name": F.lit("Léche"), "brand_hint": F.lit("ACME")})
    got = [(r["pos"], r["match_score"]) for r in vector.rerank(df, 3).orderBy("place").collect()]
    assert got == [(0, 0.85), (1, 0.75), (3, 0.7)]


def greedy(rows, limit):
    rest, out, last = sorted(rows, key=lambda r: (-r[2], r[0])), [], None
    while rest and len(out) < limit:
        best = next((r for r in rest if r[1] != last), rest[0])
        out.append(best[0])
        rest.remove(best)
        last = best[1]
    return out


def test_picks_equal_the_greedy_walk(spark):
    rng = random.Random(9)
    data = {}
    for n in range(12):
        cats = [f"c{i}" for i in range(rng.choice([1, 2, 3, 15]))]
        data[f"n{n}"] = [(f"i{j:03d}", "c0" if rng.random() < 0.6 else rng.choice(cats),
                          rng.choice([1.0, 2.0, 3.0])) for j in range(rng.randint(1, 60))]
    rows = [(n, *r, 1) for n, rs in data.items() for r in rs] + [("n0", "zzz", "c9", 99.0, 0)]
    df = spark.createDataFrame(rows, ["neighbourhood", "id", "category", "score", "qty"])
    for limit in (1, 5, 12):
        got = {}
        for r in picks.diverse_picks(df, limit).orderBy("neighbourhood", "pick").collect():
            got.setdefault(r["neighbourhood"], []).append(r["id"])
        assert got == {n: greedy(rs, limit) for n, rs in data.items()}
    assert "Python" not in picks.diverse_picks(df)._jdf.queryExecution().toString()


def test_suggestions(spark):
    products = spark.createDataFrame(
        [(1, 10, "Té", [], 1), (1, 11, "Leche Ñam", [], 0), (1, 12, "Pan integral", ["horno"], 2),
         (1, 13, "Pan", [], 2), (1, 14, "Pan", [], 2), (2, 20, "Leche Ñam", [], 1)],
        "store_id int, product_id int, name string, tags array<string>, qty int")
    turns = spark.createDataFrame(
        [(1, 1, "x", "Hay LECHE NAM y pan"), (2, 1, "algo integral del horno", "no"),
         (3, 1, "leche", "nada"), (4, 2, "pan", "leche ñam"), (5, 2, "tele", "empanada")],
        "turn_id int, store_id int, message string, reply string")
    got = {}
    for r in chat.suggestions(turns, products).orderBy("turn_id", "place").collect():
        got.setdefault((r["turn_id"], r["how"]), []).append(r["product_id"])
    assert got == {(1, "mentioned"): [11, 13, 14], (2, "keywords"): [12], (4, "mentioned"): [20]}


@pytest.mark.parametrize("texts,needles", [(20_000, 50_000), (3, 2)])
def test_occurrences_equal_a_plain_search(spark, monkeypatch, texts, needles):
    """Also with stores cut into parts of a few texts and needles."""
    monkeypatch.setattr(chat, "TEXTS_TOGETHER", texts)
    monkeypatch.setattr(chat, "NEEDLES_TOGETHER", needles)
    rng = random.Random(3)

    def word(n):
        return "".join(rng.choice("abñ 😀") for _ in range(n))
    rows = [(rng.randint(0, 2), i, word(rng.randint(0, 40))) for i in range(60)] + [(9, 99, "ab"), (0, 100, None)]
    wanted = [(s, word(n)) for s in range(4) for n in (0, 1, 1, 2, 3, 4)] + [(0, "ab"), (0, "ab")]
    got = chat.occurrences(spark.createDataFrame(rows, "store_id int, turn_id int, haystack string"),
                           spark.createDataFrame(wanted, "store_id int, needle string"), ["store_id"], "turn_id")
    want = {(s, i, w, t.index(w) + 1) for s, i, t in rows for o, w in wanted if o == s and t and w and w in t}
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(want) and set(found) == want


def test_history_and_digest(spark):
    turns = spark.createDataFrame([(c, t) for c in (1, 2) for t in range(c * 15)],
                                  ["conv_id", "turn"])
    kept = chat.last_turns(turns).groupBy("conv_id").agg(
        F.min("turn").alias("a"), F.count(F.lit(1)).alias("n")).orderBy("conv_id").collect()
    assert [(r["a"], r["n"]) for r in kept] == [(0, 15), (10, 20)]
    p = spark.createDataFrame([(1, i, f"p{i}", 1.5, i % 2) for i in range(5)],
                              "store_id int, product_id int, name string, price double, qty int")
    d = chat.store_digest(p, 3).first()
    assert d["digest"] == ("- p1 — 1.5€ (stock: 1)\n- p3 — 1.5€ (stock: 1)\n"
                           "- p0 — 1.5€ (stock: 0)\n…y 2 artículos más")


def test_interpreted(spark):
    from mercata.plans import semantic
    df = spark.createDataFrame([("pan", "Sol"), ("pan", None)], "item string, barrio string")
    got = [r["t"] for r in df.select(semantic.interpreted("item", "barrio").alias("t")).collect()]
    assert got == ["pan near Sol", "pan anywhere in Madrid"]


def test_only_products_of_asked_stores_are_looked_at(spark):
    from mercata.operators import chat
    products = spark.createDataFrame([(s, p) for s in range(9) for p in range(3)], "store_id long, product_id long")
    turns = spark.createDataFrame([(1, 4), (2, 4), (3, 7), (4, 99)], "turn_id long, store_id long")
    got = chat.asked_of(products, turns)
    assert sorted(tuple(r) for r in got.collect()) == [(s, p) for s in (4, 7) for p in range(3)]

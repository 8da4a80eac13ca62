import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mercata.llm import queries, whitening
from mercata.session import ship

from . import helpers as h

VECTORS = "vec_id long, embedding array<float>, label int"


def by_brute_force(rows, components=16, counts=False):
    """vec_id -> list of (component, n, deviation, whitened, explained); rows with distinct ids."""
    known = [(i, tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)) for i, v in rows
             if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = [x for _, x in known] if counts else sorted({x for _, x in known})
    n, dims = len(fit), len(fit[0])
    sums = [sum(x[d] for x in fit) for d in range(dims)]
    centred = np.array([[float(n * x[d] - sums[d]) / n for d in range(dims)] for x in fit])
    value, vector = np.linalg.eigh(centred.T @ centred / n)
    value, vector = value[::-1], vector[:, ::-1]
    out = {}
    for i, x in known:
        d = np.array([float(n * a - s) / n for a, s in zip(x, sums, strict=True)])
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        out[i] = [(c + 1, n, deviation, float(d @ vector[:, c] / math.sqrt(value[c])), float(value[c] / value.sum()))
                  for c in range(min(components, dims)) if value[c] > 1e-10 * value[0]]
    return out


def compare(got, want):
    found = {}
    for r in got:
        found.setdefault(r.vec_id, []).append(r)
    assert found.keys() == {i for i, v in want.items() if v}
    sign = {}
    for i, rows in found.items():
        rows.sort(key=lambda r: r.component)
        assert [(r.component, r.n, int(r.deviation)) for r in rows] == [w[:3] for w in want[i]]
        for r, w in zip(rows, want[i], strict=True):
            if abs(w[3]) > 1e-6:
                sign.setdefault(r.component, np.sign(r.whitened * w[3]))
            assert abs(r.whitened * sign.get(r.component, 1) - w[3]) < 1e-6
            assert abs(r.explained - w[4]) < 1e-9 and r.identity_error < 1e-9


def test_query_equals_brute_force(spark):
    rows = queries.table(spark, h.SF.replace("0.001", "0.01"), "embeddings")
    compare(queries.QUERIES["op13_embedding_whitening"](spark, "/root/testdata/sf0.01").collect(),
            by_brute_force([(r.vec_id, r.embedding) for r in rows.collect()]))


def odd_rows():
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(5).tolist(), 1) for i in range(40)]
    rows += [(100 + i, rows[0][1], 2) for i in range(30)]  # a hot vector
    rows += [(200, None, 1), (201, [1.0, None, 2.0, 3.0, 4.0], 1), (202, [float("nan")] * 5, 1),
             (203, [float("inf"), 0.0, 0.0, 0.0, 0.0], 1), (204, [-3000.5, 70.25, 1e6, -1e7, 0.0], 1), (205, [], None),
             (206, [0.0, -0.0, 1e-9, -1e-9, 5.0], 1)]
    return rows


@pytest.mark.parametrize("counts", [False, True])
def test_odd_rows_and_clashing_columns(spark, counts):
    ship(spark)
    docs = spark.createDataFrame(odd_rows(), VECTORS)
    for name in ("x", "key", "dims", "weight", "_v", "n", "i", "whitened"):
        docs = docs.withColumn(name, F.lit(name))
    got = whitening.whiten(docs, weights="counts" if counts else "one").collect()
    compare(got, by_brute_force([(i, v) for i, v, _ in odd_rows() if v != []], counts=counts))


def test_repeated_null_and_lone_rows(spark):
    ship(spark)
    rows = [(1, [0.0, 1.0], 1), (1, [0.0, 1.0], 1), (None, [1.0, 0.0], 1), (2, [5.0], 1), (3, [4.0, 4.0, 4.0], 1)]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    # two distinct vectors span one component; a length of one vector has none
    assert sorted((r.vec_id or 0, r.component, round(abs(r.whitened), 9)) for r in got) == [(0, 1, 1.0), (1, 1, 1.0), (1, 1, 1.0)]
    assert len({r.whitened for r in got if r.vec_id == 1}) == 1


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)]])
def test_nothing_to_whiten(spark, rows):
    ship(spark)
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS))
    assert got.count() == 0 and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviations_beyond_64_bits(spark):
    fit = whitening.Fit(3, [3 * (1 << 40), 1])
    assert fit.deviations(np.array([[1 << 50, 7]])) == [(3 * (1 << 50) - 3 * (1 << 40)) ** 2 + (21 - 1) ** 2]

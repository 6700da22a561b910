import math
from fractions import Fraction

import numpy as np
import pytest

from sievelight.llm.whitening import Centre, leading, minres, whiten


def integers(rows):
    return np.array([[math.floor(64 * float(np.float32(c))) + 1000000 for c in v] for v in rows], dtype=object)


def brute(x):
    """Eigenvalues and vectors by a dense solver on exactly centred rows."""
    n = len(x)
    centred = np.array([[float(Fraction(int(n * c) - int(s), n)) for c, s in zip(r, x.sum(axis=0), strict=True)] for r in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return centred, values[::-1], vectors[:, ::-1]


def test_minres_solves():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(30, 30))
    a = a + a.T
    b = rng.normal(size=(30, 3))
    theta = np.array([0.1, 5.0, -3.0])
    t = minres(lambda u: a @ u, lambda z: z, theta, b, 60)
    for j in range(3):
        assert np.linalg.norm((a - theta[j] * np.eye(30)) @ t[:, j] - b[:, j]) < 1e-6
    few = minres(lambda u: a @ u, lambda z: z, theta, b, 5)
    assert (np.linalg.norm(a @ few - theta * few - b, axis=0) < np.linalg.norm(b, axis=0)).all()


@pytest.mark.parametrize("shape", ["decay", "close", "equal", "flat"])
def test_leading_without_the_whole_space(shape):
    """Wide matrices, so that the basis is cut down and started anew."""
    width, rng = 300, np.random.default_rng(2)
    q = np.linalg.qr(rng.normal(size=(width, width)))[0]
    values = {"decay": 0.9 ** np.arange(width), "close": 2 - np.arange(width) / width, "equal": np.where(np.arange(width) < 20, 3.0, 1 / (1.0 + np.arange(width))), "flat": np.append(np.full(40, 1.0), np.full(width - 40, 0.5))}[shape]
    a = (q * values) @ q.T
    got, vectors, residual = leading(lambda u: a @ u, width, 24)
    assert residual < 1e-13
    assert np.abs(got - np.sort(values)[::-1][:24]).max() < 1e-12
    assert np.abs(vectors.T @ vectors - np.eye(24)).max() < 1e-13


def test_centre_is_exact():
    x = np.array([[10**6 + 1, 2**52], [10**6 + 2, -(2**52)], [10**6 + 4, 7]], np.int64)
    c = Centre(3, [int(s) for s in x.astype(object).sum(axis=0)])
    top = [[3 * int(v) - int(s) for v, s in zip(r, x.astype(object).sum(axis=0), strict=True)] for r in x]
    assert c.exact(x).tolist() == top
    assert c.deviations(x) == [d if d < 1 << 63 else None for d in (sum(v * v for v in r) for r in top)]
    assert c.rows(x[:, :1].repeat(2, axis=1) if False else x)[:, 0].tolist() == [r[0] / 3 for r in top]


def test_whiten(spark):
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(40, 40)) * 0.2
    rows = [(i, (rng.normal(size=40) @ mix).astype(np.float32).tolist()) for i in range(900)]
    rows += [(5000 + i, rows[0][1]) for i in range(300)] + [(None, rows[3][1]), (7, rows[7][1])]
    odd = [(9000, None), (9001, [None] * 40), (9002, [float("nan")] * 40), (9003, [float("inf")] + [0.0] * 39), (9004, [1.0]), (9005, []), (9006, [1e30] * 40)]
    table = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<float>, VEC_ID string").repartition(6)
    got = whiten(table).toPandas()
    x = integers([v for _, v in rows])
    centred, values, vectors = brute(x)
    n = len(rows)
    assert len(got) == n * 32 and set(got.n) == {n}
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-10
    share = got.groupby("component").explained.first().to_numpy()
    assert np.abs(share / (values[:32] / values.sum()) - 1).max() < 1e-10
    sums = [int(s) for s in x.sum(axis=0)]
    want = {i: sum((n * int(c) - s) ** 2 for c, s in zip(r, sums, strict=True)) for (i, _), r in zip(rows, x, strict=True) if i is not None}
    mine = got[got.vec_id.notna()].groupby("vec_id").deviation.first()
    assert all(mine[i] == d for i, d in want.items())
    first = np.array(sorted(i for i, _ in rows if i is not None and i < 900 and i != 7))
    table_ = got[got.vec_id.isin(first)].pivot(index="vec_id", columns="component", values="whitened").loc[first].to_numpy()
    true = (centred @ vectors[:, :32] / np.sqrt(values[:32]))[[i for i, (k, _) in enumerate(rows) if k is not None and k < 900 and k != 7]]
    signs = np.sign((table_ * true).sum(axis=0))
    assert np.abs(table_ * signs - true).max() < 1e-8


def test_few_equal_and_none(spark):
    two = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<float>")
    got = sorted((r.vec_id, r.component, round(abs(r.whitened), 12), r.n, r.deviation, round(r.explained, 12)) for r in whiten(two).collect())
    assert got == [(1, 1, 1.0, 2, 4096, 1.0), (2, 1, 1.0, 2, 4096, 1.0)]
    same = spark.createDataFrame([(i, [0.5, 0.25]) for i in range(5)], "vec_id long, embedding array<float>")
    assert whiten(same).count() == 0
    assert whiten(two.limit(1)).count() == 0
    assert whiten(two.limit(0)).count() == 0
    assert whiten(two.limit(0)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

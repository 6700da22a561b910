import math

import numpy as np
import pytest

from sievelight.llm.hard_negatives import Fields, mine


def brute(rows, width, every=50, positives=5, negatives=3):
    """rows: (vec_id, label, vector); one row for each vec_id."""
    good = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v):
            good[i] = (label, [math.floor(256 * float(np.float32(c))) for c in v])
    out = []
    for a, (label, x) in good.items():
        if a % every:
            continue
        score = {i: sum(p * q for p, q in zip(x, y, strict=True)) for i, (_, y) in good.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if good[i][0] == label][:positives]:
            fits = [i for i in order if good[i][0] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out += [(a, p, r, i, score[p], score[i]) for r, i in enumerate(fits[:negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize(("high", "count"), [(300, 2), (1 << 14, 1), (1 << 25, 4)])
def test_fields_are_exact(high, count):
    rng = np.random.default_rng(4)
    a, c = rng.integers(-high, high, (7, 16)), rng.integers(-high, high, (11, 16))
    f = Fields(int(c.min()), int(c.max()), int(np.abs(a).sum(axis=1).max()))
    assert f.count == count
    assert (f.scores(a, f.pack(c), len(c)) == a.astype(object) @ c.T.astype(object)).all()
    extreme = np.array([[high] * 16, [-high] * 16])
    f = Fields(-high, high, 16 * high)
    assert (f.scores(extreme, f.pack(extreme), 2) == extreme.astype(object) @ extreme.T.astype(object)).all()


def cloud(rng, n, width=12, labels=4):
    centre = rng.normal(size=width)
    return [(i, int(rng.integers(labels)), (0.3 * centre + 0.2 * rng.normal(size=width)).astype(np.float32).tolist()) for i in range(n)]


def test_mine(spark):
    rng = np.random.default_rng(5)
    rows = cloud(rng, 900)
    rows += [(2000 + i, i % 2, rows[50][2]) for i in range(500)]  # one vector in a third of the rows: ties
    rows += [(5000, None, rows[1][2]), (5050, 1, None), (5100, 1, [None] * 12), (5150, 1, [float("inf")] * 12), (5200, 1, [1.0]), (None, 1, rows[2][2]), (5250, 0, [0.0] * 12)]
    frame = spark.createDataFrame([(*r, "x") for r in rows + rows[:3]], "vec_id long, label int, embedding array<float>, LABEL string").repartition(5)
    for block in (4096, 5):
        got = sorted(tuple(r) for r in mine(frame, block=block).collect())
        assert got == brute(rows, 12)
    assert got


def test_wide_components(spark):
    rng = np.random.default_rng(6)
    rows = [(i, y, [float(np.float32(c * 1e5)) for c in v]) for i, y, v in cloud(rng, 300)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    assert sorted(tuple(r) for r in mine(frame).collect()) == brute(rows, 12)
    huge = [(0, 1, [1e30] * 12), *rows]
    frame = spark.createDataFrame(huge, "vec_id long, label int, embedding array<float>")
    assert mine(frame).count() > 0


def test_shared_ids_and_none(spark):
    rows = [(0, 1, [1.0, 0.0]), (0, 1, [0.9, 0.0]), (3, 2, [0.5, 0.0]), (3, 2, [0.6, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got = sorted(tuple(r) for r in mine(frame).collect())
    # each row of id 0 has the other one as its positive, and both rows of id 3 as negatives
    assert [(r[0], r[1], r[3]) for r in got] == [(0, 0, 3)] * 4
    assert {r[5] for r in got} == {256 * 128, 256 * 153, 230 * 128, 230 * 153}
    assert mine(frame.limit(0)).count() == 0
    assert mine(spark.createDataFrame([(1, 1, [1.0])], "vec_id long, label int, embedding array<float>")).count() == 0
    assert mine(spark.createDataFrame([(0, 1, [1.0])], "vec_id long, label int, embedding array<float>")).count() == 0

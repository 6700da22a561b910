"""Embedding whitening: leading principal components by a block Jacobi-Davidson method.

The covariance matrix is never formed.  Each product of it with a block of vectors is one Spark job over the centred rows: every task
multiplies its rows twice and sums, and Spark adds the tasks' sums by dimension.  The driver holds a basis of at most a few times
``count`` vectors and the small matrices of that basis; its memory grows with the width of the embeddings, not with their number.

1.  Each entry c becomes the integer x = floor(scale * c) + shift.  Sums and squared deviations are exact integers.  A row is centred as
    (n*x - S)/n, whose numerator is an exact integer, so the large shift costs no digits.
2.  Rayleigh-Ritz in the basis gives Ritz pairs; their residuals come from the stored products.  Pairs whose residual is at rounding level
    are locked.
3.  For the next pairs the correction equations (I - QQ')(V - theta I)(I - QQ') t = -r, Q the locked vectors and those of the block, are
    solved by some steps of MINRES, in step for the whole block, so each step is one product.  The corrections extend the basis; a basis that has
    grown too large is cut down to its best Ritz vectors, whose products are made anew.
4.  A last product with all locked vectors checks every residual anew, and one pass gives the covariance of the whitened rows.

Defined results: vectors that are null or hold a null or non-finite entry take no part, nor do those of another length than the most common
one (the shorter of equally common ones), nor those with an entry that is no exact integer (2**53 or more after scaling).  Rows with a null
vec_id and repeated rows are rows like all others.  Components whose variance is zero to working precision cannot be
whitened and are left out, so there may be fewer than ``count``; a single row or an empty table gives no rows.  A deviation
beyond 64 bits is null.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, written

EPS = np.finfo(np.float64).eps
EXACT = 1 << 53
BLOCK, BYTES = 2048, 1 << 21  # rows in one record of the stored matrix, and its size, at most


def _packer(scale: int, shift: int, width: int):
    """Rows in blocks: their ids and the matrix of integers as bytes."""
    rows = max(1, min(BLOCK, BYTES // (8 * width)))

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, rows):
                part = batch.slice(s, rows)
                v = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                x = np.floor(scale * v).astype(np.int64) + shift
                ids = part.column("vec_id")
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([x.tobytes()], pa.binary())], names=["ids", "x"])

    return run


def _matrices(batches, width: int):
    for batch in batches:
        for ids, x in zip(batch.column("ids"), batch.column("x"), strict=True):
            yield ids.values, np.frombuffer(x.as_buffer(), np.int64).reshape(-1, width)


def _sums(width: int):
    """Of each dimension, exactly: the sums of the entries' high and low parts."""

    def run(batches):
        high, low, n = np.zeros(width, np.int64), np.zeros(width, np.int64), 0
        for _, x in _matrices(batches, width):
            high += (x >> 26).sum(axis=0)
            low += (x & (1 << 26) - 1).sum(axis=0)
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(high), pa.array(low), pa.array(np.full(width, n))], names=["i", "high", "low", "n"])

    return run


class Centre:
    """n, the sums S as Python integers, and rows centred about their mean."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        means = [s // n for s in sums]
        self.mean = np.array(means, np.int64)
        self.rest = np.array([s - n * m for s, m in zip(sums, means, strict=True)], np.int64)  # n*x - S = n*(x - mean) - rest

    def exact(self, x: np.ndarray) -> np.ndarray:
        """n*x - S; as Python integers where 64 bits do not do."""
        y = x - self.mean
        wide = y.size and int(np.abs(y).max()) + 1 >= (1 << 62) // self.n
        return (y.astype(object) if wide else y) * self.n - self.rest

    def rows(self, x: np.ndarray) -> np.ndarray:
        top = self.exact(x)
        # from 2**53 on the numerator is no exact double: there, the fraction of the mean comes off last
        if top.dtype == object or top.size and np.abs(top).max() >= EXACT:
            return (x - self.mean).astype(np.float64) - self.rest / self.n
        return top / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        top = self.exact(x)
        if top.dtype != object and top.size and int(np.abs(top).max()) ** 2 * x.shape[1] >= 1 << 63:
            top = top.astype(object)
        return [int(d) if d < 1 << 63 else None for d in (top * top).sum(axis=1)]


def _product(centre: Centre, u: np.ndarray):
    """This task's part of X'X u, X the centred rows; and of the sum of all squares."""

    def run(batches):
        out, squares, any_ = np.zeros(u.shape), 0.0, False
        for _, x in _matrices(batches, len(u)):
            rows = centre.rows(x)
            out += rows.T @ (rows @ u)
            squares += np.einsum("ij,ij->", rows, rows)
            any_ = True
        if any_:
            share = np.zeros(len(u))
            share[0] = squares
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(u), dtype=np.int32)), pa.array(share), *[pa.array(c) for c in np.ascontiguousarray(out.T)]], names=["i", "squares", *[f"u{j}" for j in range(u.shape[1])]])

    return run


class Covariance:
    """Products with the covariance matrix, as Spark jobs."""

    def __init__(self, blocks: DataFrame, centre: Centre, width: int):
        self.blocks, self.centre, self.width, self.trace, self.jobs = blocks, centre, width, None, 0

    def __call__(self, u: np.ndarray) -> np.ndarray:
        names = [f"u{j}" for j in range(u.shape[1])]
        parts = self.blocks.mapInArrow(_product(self.centre, u), ", ".join(f"{x} {'int' if x == 'i' else 'double'}" for x in ["i", "squares", *names]))
        rows = parts.groupBy("i").agg(*[F.sum(x).alias(x) for x in ["squares", *names]]).toPandas().set_index("i").sort_index()
        self.trace = float(rows["squares"].sum()) / self.centre.n
        self.jobs += 1
        return rows[names].to_numpy() / self.centre.n


def _apart(t: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span what ``t`` adds to an orthonormal basis."""
    scale = np.linalg.norm(t, axis=0)
    t = t[:, scale > 0] / scale[scale > 0]
    for _ in range(3):
        t = t - basis @ (basis.T @ t)
    kept: list[np.ndarray] = []
    for j in range(t.shape[1]):
        c = t[:, j]
        for _ in range(2):
            for k in kept:
                c = c - k * (k @ c)
        size = np.linalg.norm(c)
        if size > 1e-8:
            kept.append(c / size)
    if not kept:
        return np.zeros((len(basis), 0))
    out = np.stack(kept, axis=1)
    out = out - basis @ (basis.T @ out)
    return np.linalg.qr(out)[0]


def minres(product, project, theta: np.ndarray, b: np.ndarray, steps: int, enough: float = 0.0) -> np.ndarray:
    """Steps of MINRES for each column of (V - theta I) t = b within the range of ``project``, all columns in step, until every residual
    is ``enough`` times its first size.

    Lanczos vectors with Givens rotations; a column whose Krylov space is exhausted stays as it is.
    """
    beta = np.linalg.norm(b, axis=0)
    live = beta > 0
    v, v_old = np.where(live, b / np.where(live, beta, 1), 0), np.zeros_like(b)
    d, d_old, t = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    phi, over = beta.copy(), np.zeros_like(beta)
    c1, s1, c2, s2 = np.ones_like(beta), np.zeros_like(beta), np.ones_like(beta), np.zeros_like(beta)
    first = beta.copy()
    for _ in range(steps):
        w = project(product(v) - theta * v) - over * v_old
        alpha = np.einsum("ij,ij->j", v, w)
        w = w - alpha * v
        under = np.linalg.norm(w, axis=0)
        # the two earlier rotations on the new column of the tridiagonal matrix, then the rotation that clears what is below
        e, f = s2 * over, c2 * over
        g, h = c1 * f + s1 * alpha, -s1 * f + c1 * alpha
        r = np.hypot(h, under)
        fine = live & (r > EPS * (np.abs(theta) + 1e-300))
        r_ = np.where(fine, r, 1)
        c, s = np.where(fine, h / r_, 1), np.where(fine, under / r_, 0)
        new = np.where(fine, (v - g * d - e * d_old) / r_, 0)
        t += np.where(fine, c * phi, 0) * new
        phi = np.where(fine, -s * phi, phi)
        d, d_old = new, d
        c2, s2, c1, s1 = c1, s1, c, s
        live = fine & (under > 1e-14 * first)
        v_old, v, over = v, np.where(live, w / np.where(live, under, 1), 0), np.where(live, under, 0)
        if not live.any() or (np.abs(phi) <= enough * first).all():
            break
    return t


def leading(product, width: int, count: int, block: int = 16, steps: int = 16, rounds: int = 200, seed: int = 13) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``count`` largest eigenvalues of a symmetric positive matrix given by its ``product``, their unit vectors, and the largest residual
    against the largest value, from a product of its own.  An error if they do not settle within ``rounds``."""
    count = min(count, width)
    most = min(width, max(3 * count, count + 4 * block))
    level = EPS * (16 + 2 * np.sqrt(width))  # a product's own rounding
    # at least ``count`` vectors, so that no value is missed however often it comes
    v = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, min(width, count + block))))[0]
    av = product(v)
    for _ in range(rounds):
        h = v.T @ av
        values, y = np.linalg.eigh((h + h.T) / 2)
        values, y = values[::-1], y[:, ::-1]
        u, au = v @ y, av @ y
        residual = (au - u * values)[:, :count]
        size = np.linalg.norm(residual, axis=0) / max(values[0], 1e-300)
        if (size <= level).all() or v.shape[1] == width:
            break
        if v.shape[1] + block > most:
            v = np.linalg.qr(u[:, : most - 2 * block])[0]
            av = product(v)
            continue
        locked, want = np.flatnonzero(size <= level), np.flatnonzero(size > level)[:block]
        q = u[:, np.append(locked, want)]
        project = lambda z, q=q: z - q @ (q.T @ z)
        t = minres(product, project, values[want], -project(residual[:, want]), steps, 0.02)
        room = min(block, width - v.shape[1])
        fresh = _apart(np.concatenate([t, residual[:, want]], axis=1), v)[:, :room]
        if not fresh.shape[1]:
            fresh = _apart(np.random.default_rng(seed + v.shape[1]).normal(size=(width, block)), v)[:, :room]
        v, av = np.concatenate([v, fresh], axis=1), np.concatenate([av, product(fresh)], axis=1)
    else:
        raise RuntimeError(f"the components did not settle: residual {size.max():.2e}")
    u = np.linalg.qr(u[:, :count])[0]
    au = product(u)
    values, y = np.linalg.eigh((u.T @ au + au.T @ u) / 2)
    values, y = values[::-1], y[:, ::-1]
    u, au = u @ y, au @ y
    return values, u, float(np.linalg.norm(au - u * values, axis=0).max() / max(values[0], 1e-300))


def _moments(centre: Centre, p: np.ndarray):
    """This task's part of W'W, W the whitened rows, and of their sum, one row for each component."""

    def run(batches):
        k = p.shape[1]
        out, total, any_ = np.zeros((k, k)), np.zeros(k), False
        for _, x in _matrices(batches, len(p)):
            w = centre.rows(x) @ p
            out += w.T @ w
            total += w.sum(axis=0)
            any_ = True
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(total), *[pa.array(c) for c in out]], names=["i", "total", *[f"w{j}" for j in range(k)]])

    return run


def _whitened(centre: Centre, p: np.ndarray):
    def run(batches):
        k = p.shape[1]
        for ids, x in _matrices(batches, len(p)):
            w, n = centre.rows(x) @ p, len(x)
            columns = [ids.take(pa.array(np.repeat(np.arange(n), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(centre.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(n), k))), pa.array(w.ravel())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "deviation", "whitened"])

    return run


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(table: DataFrame, count: int = 32, scale: int = 64, shift: int = 1000000) -> DataFrame:
    """Each row of ``table(vec_id, embedding)`` on the leading components of all rows' covariance, each over its standard deviation:
    ``(vec_id, component, n, deviation, whitened, explained, identity_error)``."""
    spark = table.sparkSession
    rows = pick(table, vec_id="long", embedding="array<double>").where("size(embedding) > 0")
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * scale < float(EXACT - shift)))
    rows = rows.where(fine).select("vec_id", F.col("embedding").alias("v"))
    empty = spark.createDataFrame([], RESULT)
    common = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if common is None:
        return empty
    width = common["width"]
    blocks = written(rows.where(F.size("v") == width).mapInArrow(_packer(scale, shift, width), "ids array<long>, x binary"))
    big = "decimal(38,0)"
    sums = blocks.mapInArrow(_sums(width), "i int, high long, low long, n long").groupBy("i").agg(F.sum(F.col("high").cast(big)).alias("high"), F.sum(F.col("low").cast(big)).alias("low"), F.sum("n").alias("n")).orderBy("i").collect()
    n = sums[0]["n"]
    centre = Centre(n, [(int(r["high"]) << 26) + int(r["low"]) for r in sums])
    covariance = Covariance(blocks, centre, width)
    values, vectors, _ = leading(covariance, width, count)
    some = values > max(values[0], 0) * width * EPS * 4
    if not some.any():
        return empty
    values, vectors = values[some], vectors[:, some]
    p = vectors / np.sqrt(values)
    k = len(values)
    parts = blocks.mapInArrow(_moments(centre, p), "i int, total double, " + ", ".join(f"w{j} double" for j in range(k)))
    m = parts.groupBy("i").agg(*[F.sum(x).alias(x) for x in ["total", *[f"w{j}" for j in range(k)]]]).toPandas().set_index("i").sort_index()
    mean = m["total"].to_numpy() / n
    error = float(np.abs(m[[f"w{j}" for j in range(k)]].to_numpy() / n - np.outer(mean, mean) - np.eye(k)).max())
    explained = F.element_at(F.array(*[F.lit(float(e)) for e in values / covariance.trace]), F.col("component"))
    out = blocks.mapInArrow(_whitened(centre, p), "vec_id long, component int, deviation long, whitened double")
    return out.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))

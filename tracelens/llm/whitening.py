"""Whitening of embeddings with principal axes from spectral divide and conquer.

Entries c become whole numbers floor(64 c) + 1,000,000, so sums over all rows are exact whatever the partitioning.
Tasks sum the numbers, then products of numbers from which the nearest whole mean is taken; what is left of the mean
(less than one) is taken from the sums. Only features^2 numbers reach the driver.

There the covariance A is split: QDWH, a QR-based iteration with dynamic weights, gives the polar factor U of A minus
a shift, (U + I) / 2 projects on the subspace of the eigenvalues above the shift, and A restricted to that
subspace and to its complement is split in turn until each part is one component. The axes over the
roots of their eigenvalues are shipped to tasks as one small matrix.

Defined cases: rows are left out whose vector is null, holds a null or non-finite entry, is empty, or has another
length than most vectors (the shorter of equally frequent ones); numbers beyond 2^62 count as that; a null id stays
null, repeated rows and ids count and are returned as often as they stand; other columns are left out; components whose
eigenvalue is zero to working precision have no whitened value and are left out; a table without usable
rows gives none; a ``deviation`` beyond 64 bits is null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT, COMPONENTS, MOST = 64, 1_000_000, 32, 1 << 62
EPS = np.finfo(float).eps


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix: its eigenvalues become their signs."""
    n = len(a)
    x = a / np.linalg.norm(a)
    try:
        low = 1 / (np.abs(np.linalg.inv(x)).sum(axis=0).max() * np.sqrt(n))
    except np.linalg.LinAlgError:
        low = EPS
    low = min(max(low, EPS), 1.0)
    for _ in range(30):
        d = np.cbrt(4 * (1 - low * low) / low ** 4)
        w = np.sqrt(1 + d) + np.sqrt(max(8 - 4 * d + 8 * (2 - low * low) / (low * low * np.sqrt(1 + d)), 0)) / 2
        b = (w - 1) ** 2 / 4
        c = w + b - 1
        q, _ = np.linalg.qr(np.vstack((np.sqrt(c) * x, np.eye(n))))
        new = b / c * x + (w - b / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        low = min(low * (w + b * low * low) / (1 + c * low * low), 1.0)
        moved, x = np.linalg.norm(new - x), new
        if 1 - low < 10 * EPS and moved < np.cbrt(EPS):
            break
    return x


def _halves(a: np.ndarray, scale: float) -> tuple[np.ndarray, int] | None:
    """An orthogonal basis whose first k columns span the upper eigenvalues; None where no shift splits them."""
    n, diagonal = len(a), np.sort(np.diag(a))
    spread = np.linalg.norm(a - np.eye(n) * diagonal.mean())
    rng = np.random.default_rng(n)
    best = None
    for shift in (np.median(diagonal), diagonal.mean(), *(diagonal.mean() + spread / np.sqrt(n) * np.array([0.1, -0.1, 0.45, -0.45, 0.8, -0.8]))):
        p = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
        k = int(round(np.trace(p)))
        if not 0 < k < n:
            continue
        q, _ = np.linalg.qr(p @ rng.standard_normal((n, k)))
        q, _ = np.linalg.qr(np.hstack((p @ q, rng.standard_normal((n, n - k)))))
        left = np.linalg.norm(q[:, k:].T @ a @ q[:, :k])
        if best is None or left < best[0]:
            best = left, q, k
        if left <= 4 * n * EPS * scale:
            break
    return best and best[1:] if best and best[0] <= 1e-10 * scale else None


def _rotations(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues too close for any shift to part them: cyclic plane rotations."""
    a, v = a.copy(), np.eye(len(a))
    for _ in range(60):
        if np.linalg.norm(a - np.diag(np.diag(a))) <= EPS * np.linalg.norm(a):
            break
        for i in range(len(a) - 1):
            for j in range(i + 1, len(a)):
                if a[i, j]:
                    t = 0.5 * np.arctan2(2 * a[i, j], a[i, i] - a[j, j])
                    r = np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])
                    a[:, [i, j]] = a[:, [i, j]] @ r
                    a[[i, j]] = r.T @ a[[i, j]]
                    v[:, [i, j]] = v[:, [i, j]] @ r
    return np.diag(a), v


def spectrum(a: np.ndarray, scale: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors, as columns, of a symmetric matrix."""
    n, whole = len(a), scale is None
    scale = np.linalg.norm(a) if whole else scale
    if n <= 1 or scale == 0 or np.linalg.norm(a - np.diag(np.diag(a))) <= EPS * scale:
        values, vectors = np.diag(a).copy(), np.eye(n)
    elif (parts := _halves(a, scale)) is None:
        values, vectors = _rotations(a)
    else:
        q, k = parts
        found = [spectrum((s := b.T @ a @ b) / 2 + s.T / 2, scale) for b in (q[:, :k], q[:, k:])]
        values = np.concatenate([f[0] for f in found])
        vectors = np.hstack((q[:, :k] @ found[0][1], q[:, k:] @ found[1][1]))
    if whole and n and scale:
        vectors, r = np.linalg.qr(vectors)  # orthogonal to the last bit
        values = np.einsum("ij,ik,kj->j", vectors, a, vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _numbers(column, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are used, and their numbers x - SHIFT as a matrix of whole numbers."""
    ok = pc.fill_null(pc.equal(pc.list_value_length(column), size), False).to_numpy(zero_copy_only=False)
    c = column.filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
    fine = np.isfinite(c).all(axis=1)
    ok[ok] = fine
    return ok, np.clip(np.floor(SCALE * c[fine]), -float(MOST), float(MOST)).astype(np.int64)


def _vectors(emb: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return emb.select(F.col(f"`{vec_col}`").cast("array<double>").alias("vec"), F.col(f"`{id_col}`").cast("long").alias("vec_id"))


def _length(rows: DataFrame) -> int:
    usable = rows.where(F.col("vec").isNotNull() & F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    most = usable.groupBy(F.size("vec").alias("size")).count().where("size > 0").orderBy(F.desc("count"), "size").first()
    return most["size"] if most else 0


def _sums(rows: DataFrame, size: int) -> tuple[int, list[int]]:
    """The number of used rows and the exact sum of each entry's numbers."""
    low = (1 << 20) - 1

    def add(batches):
        n, parts = 0, np.zeros((2, size), np.int64)
        for batch in batches:
            _, x = _numbers(batch.column(0), size)
            n += len(x)
            parts += np.stack(((x >> 20).sum(axis=0), (x & low).sum(axis=0)))
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array(parts[0]), pa.array(parts[1])], ["i", "n", "high", "low"])

    wide = "decimal(38,0)"
    total = rows.select("vec").mapInArrow(add, "i int, n long, high long, low long").groupBy("i").agg(
        F.sum("n").alias("n"), F.sum(F.col("high").cast(wide)).alias("high"), F.sum(F.col("low").cast(wide)).alias("low")).orderBy("i").collect()
    return total[0]["n"] or 0, [(int(r["high"]) << 20) + int(r["low"]) for r in total]


def _products(rows: DataFrame, width: int, values) -> np.ndarray:
    """The sum over all rows of v v' for v = (1, ``values`` of a batch): a row of the matrix per key, added in two steps."""
    def add(batches):
        total = np.zeros((width + 1, width + 1))
        for batch in batches:
            v = values(batch)
            v = np.column_stack((np.ones(len(v)), v))
            total += v.T @ v
        slot = int(np.random.default_rng().integers(256))
        yield pa.RecordBatch.from_arrays([pa.array(range(width + 1), pa.int32()), pa.array([slot] * (width + 1), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "slot", "v"])

    def merge(key, table):
        v = np.array(table["v"].to_pylist()).sum(axis=0)
        return pa.table({"i": [key[0].as_py()], "v": [v.tolist()]}, pa.schema([("i", pa.int32()), ("v", pa.list_(pa.float64()))]))

    parts = rows.mapInArrow(add, "i int, slot int, v array<double>")
    for keys in (("i", "slot"), ("i",)):
        parts = parts.groupBy(*keys).applyInArrow(merge, "i int, v array<double>")
    out = np.zeros((width + 1, width + 1))
    for r in parts.collect():
        out[r["i"]] = r["v"]
    return out


def fit_axes(emb: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = COMPONENTS) -> dict:
    """n, whole sums, covariance, eigenvalues, axes and the whitening matrix of at most ``most`` components."""
    rows = _vectors(emb, id_col, vec_col)
    size = _length(rows)
    n, sums = _sums(rows, size) if size else (0, [])
    if not n:
        return {"n": 0}
    middle = [s // n for s in sums]
    base = np.array(middle, np.int64)
    g = _products(rows.select("vec"), size, lambda batch: (_numbers(batch.column(0), size)[1] - base).astype(float))
    rest = np.array([(s - n * m) / n for s, m in zip(sums, middle)])
    v = g[1:, 1:] / n - np.outer(rest, rest)
    v = (v + v.T) / 2
    e, axes = spectrum(v)
    keep = min(most, int((e > 100 * size * EPS * max(e[0], 0)).sum()))
    return {"n": n, "size": size, "sums": sums, "covariance": v, "values": e, "axes": axes,
            "whiten": axes[:, :keep] / np.sqrt(e[:keep]), "explained": e[:keep] / np.trace(v) if keep else e[:0]}


def whiten(emb: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each used row and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = fit_axes(emb, id_col, vec_col, most)
    if not fit["n"] or not len(fit["explained"]):
        return emb.sparkSession.createDataFrame([], schema)
    n, size, w, explained = fit["n"], fit["size"], fit["whiten"], fit["explained"]
    middle = [s // n for s in fit["sums"]]
    base, left = np.array(middle, np.int64), np.array([s - n * m for s, m in zip(fit["sums"], middle)])
    k = len(explained)

    def gaps(x: np.ndarray) -> np.ndarray:
        """n x - S, exactly."""
        x = x - base
        return n * (x if n * (int(np.abs(x).max(initial=0)) + 1) < MOST else x.astype(object)) - left

    def scores(batch):
        return gaps(_numbers(batch.column(0), size)[1]).astype(float) / n @ w

    rows = _vectors(emb, id_col, vec_col)
    z = _products(rows.select("vec"), k, scores)
    mean = z[0, 1:] / n
    error = float(np.abs(z[1:, 1:] / n - np.outer(mean, mean) - np.eye(k)).max())

    def project(batches):
        for batch in batches:
            ok, x = _numbers(batch.column(0), size)
            d = gaps(x)
            wide = d if size * int(np.abs(d).max(initial=0)) ** 2 < MOST else d.astype(object)
            deviation = [int(v) if int(v) < 1 << 63 else None for v in (wide * wide).sum(axis=1)]
            m = len(x)
            ids = batch.column(1).filter(pa.array(ok)).take(pa.array(np.repeat(np.arange(m), k)))
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array((d.astype(float) / n @ w).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)

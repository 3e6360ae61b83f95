"""Embedding whitening by QDWH spectral divide and conquer.

1. Each entry c of a vector becomes the whole number floor(64 c) + 1000000.  The
   fit list is each distinct vector once; a vector that fills a third of the
   table is aggregated before it is shuffled.
2. Sums per dimension are exact; products are summed after centring.  Each task
   adds up its own, and what reaches the driver is one covariance (dimension by
   dimension).
3. ``spectral``: the polar factor U of V - sI, found by dynamically weighted
   Halley iterations on QR factors, gives the projector (U + I) / 2 onto the
   eigenvectors above s.  Its range and complement split V into two smaller
   covariances, and so on down to single components.
4. The components (at most ``COMPONENTS`` columns) go to all tasks, and every
   vector is projected where it lies.

Rows whose vector is null, empty, or holds a null or non-finite entry are left
out; so are rows whose vector has not the table's dimension, which is the most
frequent length (of equally frequent ones, the greatest).  Entries beyond 2**56
count as 2**56.  Repeated rows are whitened each, and fitted once.  Components
whose eigenvalue is zero up to rounding do not exist: fewer than two distinct
vectors, or an empty table, give no rows.  Ids may be null or repeat; other
columns are not looked at, whatever their names.  A deviation beyond a long is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shieldline.llm.tables import written

#: Steps to which entries are rounded, and what is added to them.
STEPS, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Rows that are projected at once.
ROWS = 8192


# the decomposition


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix."""
    n = len(a)
    x = a / np.linalg.norm(a)
    low, unit = 1e-17, np.eye(n)
    for _ in range(30):
        if low < 1:
            d = np.cbrt(4 * (1 - low**2) / low**4)
            wa = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + d)))
        else:
            wa = 3.0
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, unit]))
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        low = min(1.0, low * (wa + wb * low**2) / (1 + wc * low**2))
        moved = np.linalg.norm(new - x)
        x = new
        if abs(1 - low) < 1e-14 and moved < 1e-12 * np.sqrt(n):
            break
    return x


def _split(a: np.ndarray, scale: float) -> tuple[np.ndarray, int] | None:
    """(basis, k): the first k columns span the eigenvectors above a shift, the
    others those below; None if ``a`` is a multiple of the identity."""
    n = len(a)
    mean = np.trace(a) / n
    spread = np.linalg.norm(a - mean * np.eye(n))
    if spread <= 4e-16 * n * scale:
        return None
    rng = np.random.default_rng(n)
    shifts = [float(np.median(np.diag(a))), mean] + [mean + t * spread / n for t in rng.uniform(-1, 1, 40)]
    for shift in shifts:
        if not (m := a - shift * np.eye(n)).any():
            continue
        p = (polar(m) + np.eye(n)) / 2
        k = int(round(np.trace(p)))
        if not 0 < k < n or np.linalg.norm(p @ p - p) > 1e-11 * n:
            continue  # all on one side, or an eigenvalue on the shift
        basis = np.linalg.qr(p @ rng.standard_normal((n, k)))[0]
        for _ in range(2):
            basis = np.linalg.qr(p @ basis)[0]
        basis = np.linalg.qr(np.hstack([basis, rng.standard_normal((n, n - k))]))[0]
        rest = basis[:, k:] - p @ basis[:, k:]
        basis[:, k:] = np.linalg.qr(rest - basis[:, :k] @ (basis[:, :k].T @ rest))[0]
        if np.linalg.norm(basis[:, k:].T @ a @ basis[:, :k]) <= 1e-13 * n * scale:
            return basis, k
    if spread <= 1e-13 * n * scale:
        return None  # equal up to rounding: any basis is one of eigenvectors
    raise ArithmeticError(f"no shift splits a block of {n} components")


def spectral(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix."""
    v = (v + v.T) / 2
    scale = float(np.linalg.norm(v)) or 1.0
    done, open_ = [], [np.eye(len(v))]
    while open_:
        basis = open_.pop()
        a = basis.T @ v @ basis
        found = _split((a + a.T) / 2, scale) if len(a) > 1 else None
        if found is None:
            done.append(basis)
        else:
            parts, k = found
            open_ += [basis @ parts[:, :k], basis @ parts[:, k:]]
    vectors = np.linalg.qr(np.hstack(done))[0] if done else np.zeros((0, 0))
    values = np.einsum("ij,ij->j", vectors, v @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


# the jobs


def _vectors(table: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(vec_id, x) of the rows that count, and their dimension (0: no rows)."""
    rows = table.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("c")).where(F.coalesce(F.size("c"), F.lit(0)) > 0)
    rows = rows.where(F.forall("c", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))
    most = rows.groupBy(F.size("c").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if most is None:
        return rows.selectExpr("vec_id", "cast(null as array<bigint>) x"), 0
    most_entry = float(1 << 56)
    steps = F.transform("c", lambda e: F.floor(F.greatest(F.least(e * STEPS, F.lit(most_entry)), F.lit(-most_entry))).cast("bigint") + SHIFT)
    return rows.where(F.size("c") == most.d).select("vec_id", steps.alias("x")), most.d


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _added(fit: DataFrame, dim: int, parts) -> dict[tuple[int, int], float]:
    """Sums over the fit list: ``parts`` gives the matrix that a batch adds."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            for i in range(0, len(x), ROWS):
                own = parts(x[i : i + ROWS])
                total = own if total is None else total + own
        if total is not None:
            i, j = np.indices(total.shape)
            kind = pa.int64() if total.dtype == np.int64 else pa.float64()
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel(), kind)], names=["i", "j", "v"])

    kind = "bigint" if parts(np.zeros((1, dim), np.int64)).dtype == np.int64 else "double"
    return {(r.i, r.j): r.v for r in fit.mapInArrow(add, f"i int, j int, v {kind}").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}


def _square(sums: dict, d: int) -> np.ndarray:
    return np.array([[sums.get((i, j), 0) for j in range(d)] for i in range(d)], dtype=np.float64)


@dataclass
class Whitening:
    """What whitening is fitted to: n distinct vectors, exact sums, eigenvalues
    and unit components (columns), and how far the result is from white."""

    n: int
    sums: np.ndarray
    trace: float
    values: np.ndarray
    components: np.ndarray
    identity_error: float

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.sums / self.n) @ (self.components / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list:
        """Sums over dimensions of (n x - S)**2, in whole numbers."""
        far = float(np.abs(x - self.sums / self.n).max(initial=0)) + 1
        if (self.n * far) ** 2 * x.shape[1] < 2**62 and self.n * float(np.abs(x).max(initial=0)) < 2**62:
            return ((self.n * x - self.sums) ** 2).sum(axis=1).tolist()
        sums = [int(s) for s in self.sums]
        exact = [sum((self.n * int(e) - s) ** 2 for e, s in zip(row, sums)) for row in x.tolist()]
        return [v if v < 2**63 else None for v in exact]


def fit(vectors: DataFrame, dim: int, components: int = COMPONENTS) -> Whitening | None:
    """Fits to the distinct ``x`` of ``vectors``; None without components."""
    distinct = written(vectors.select("x").distinct(), "vectors")
    n = distinct.count()
    sums = _added(distinct, dim, lambda x: x.sum(axis=0, dtype=np.int64)[None, :])
    sums = np.array([sums.get((0, j), 0) for j in range(dim)], dtype=np.int64)
    if n < 2:
        return None
    mean = sums / n

    def products(x: np.ndarray) -> np.ndarray:
        z = x - mean
        return z.T @ z

    v = _square(_added(distinct, dim, products), dim) / n
    values, vectors_ = spectral(v)
    trace = float(np.trace(v))
    k = int((values[:components] > 2.3e-16 * dim * trace).sum())
    if not k:
        return None
    out = Whitening(n, sums, trace, values[:k], vectors_[:, :k], 0.0)

    def centre(x: np.ndarray) -> np.ndarray:
        return out.project(x).sum(axis=0)[None, :]

    means = _added(distinct, dim, centre)
    means = np.array([means[0, j] for j in range(k)]) / n

    def again(x: np.ndarray) -> np.ndarray:
        w = out.project(x) - means
        return w.T @ w

    out.identity_error = float(np.abs(_square(_added(distinct, dim, again), k) / n - np.eye(k)).max())
    return out


SCHEMA = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each vector that counts and each component: vec_id, component
    (from 1, by falling eigenvalue), n, deviation, whitened, explained, identity_error."""
    vectors, dim = _vectors(table, id_col, vector_col)
    model = fit(vectors, dim, components) if dim else None
    kind = dict(vectors.dtypes)["vec_id"]
    if model is None:
        empty = vectors.select("vec_id").limit(0)
        return empty.select("vec_id", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in SCHEMA.split(", ")])
    k = len(model.values)
    explained = model.values / model.trace

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                x = _matrix(part.column(1), dim)
                rows = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                    pa.array(np.full(len(rows), model.n), pa.int64()), pa.array(model.deviation(x), pa.int64()).take(pa.array(rows)),
                    pa.array(model.project(x).ravel()), pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(rows), model.identity_error))],
                    names=["vec_id", *[c.split()[0] for c in SCHEMA.split(", ")]])

    return vectors.mapInArrow(apply, f"vec_id {kind}, {SCHEMA}")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

"""Operator 11: whitening with float32 eigenvectors that are refined in double precision.

1. Every entry ``c`` becomes the integer ``floor(64 * c) + 1000000``; one pass
   adds rows and sums per dimension as exact integers.
2. A second pass centres each row before it multiplies: ``n * x - S`` is exact,
   its quotient by ``n`` enters the products. Tasks send the upper triangle of
   their share, and Spark adds the shares by cell.
3. The driver holds one matrix of dimension x dimension. Its eigenvectors are
   computed in float32 and corrected by rounds of matrix multiplications in
   float64 (Ogita and Aishima 2018). Eigenvalues that float32 cannot part form a
   cluster: its block is shifted by the mean of the cluster, which leaves only
   the spread, and solved by itself in the same way (their part II, 2019).
4. A third pass measures the covariance of the whitened rows against the
   identity, a last one returns them.

Nothing but sums per dimension, the covariance and the components reaches the
driver; their size depends on the dimension only.

Defined cases: rows whose vector is null, empty, of another length than most
(ties: the shorter), or holds a null, NaN or infinite entry are dropped, and so
are entries beyond 2**56, whose integer would not fit; repeated rows and null
ids count as they are; ``deviation`` is null where it does not fit a long;
components without variance (an eigenvalue of at most 1e-11 of the largest) are
returned with ``whitened`` null and take no part in ``identity_error``;
``explained`` is null if nothing varies; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simlattice.runtime import cut

SCALE, SHIFT = 64, 1_000_000
TOP = 32
FLAT = 1e-11  # share of the largest eigenvalue up to which a component counts as constant
CLOSE = 1e-5  # share of the largest entry below which two eigenvalues are a cluster
ROUNDS = 20


def whole(vector: Column) -> Column:
    """Whether a vector has entries, all of them present, finite and small enough for a long."""
    fits = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 2.0**56))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fits, F.lit(False))


def integers(column: pa.Array, dim: int) -> np.ndarray:
    c = np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)
    return np.floor(SCALE * c).astype(np.int64) + SHIFT


def exact_sum(x: np.ndarray) -> np.ndarray:
    """Sums of the columns as Python integers."""
    small = np.abs(x).max(initial=0) < 2**40
    return x.sum(axis=0).astype(object) if small else x.astype(object).sum(axis=0)


def deviations(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """``n * x - S``, exact: int64 where it fits, else Python integers."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, total)) < 2**62:
        return n * x - np.array(total, np.int64)
    return n * x.astype(object) - np.array(total, object)


def squares(d: np.ndarray) -> list[int | None]:
    """Sum of the squares of every row, exact; None where it does not fit a long."""
    if d.dtype != object and (not d.size or int(np.abs(d).max()) ** 2 * d.shape[1] < 2**63):
        return (d * d).sum(axis=1).tolist()
    return [s if s < 2**63 else None for s in (d.astype(object) ** 2).sum(axis=1)]


def clusters(values: np.ndarray, close: float) -> list[np.ndarray]:
    """Index groups of two or more values that are chained by gaps of at most ``close``."""
    order = np.argsort(values)
    apart = np.flatnonzero(np.diff(values[order]) > close) + 1
    return [g for g in np.split(order, apart) if len(g) > 1]


def correction(a: np.ndarray, x: np.ndarray, close: float) -> np.ndarray:
    """One round of matrix multiplications: better eigenvectors; pairs of close values are only made orthogonal."""
    r = np.eye(len(a)) - x.T @ x
    s = x.T @ (a @ x)
    values = np.diag(s) / (1 - np.diag(r))
    gap = values[None, :] - values[:, None]
    near = np.abs(gap) <= close
    return x + x @ np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1.0, gap))


def eigenvectors(a: np.ndarray, noise: float = 0.0) -> np.ndarray:
    """Orthogonal eigenvectors of a symmetric matrix whose entries are known up to ``noise``."""
    d, size = len(a), np.abs(a).max(initial=0.0)
    if d < 2 or size <= noise:
        return np.eye(d)
    a = a / size
    noise = max(noise / size, d * np.finfo(float).eps)
    x = np.linalg.qr(np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64))[0]
    before = np.inf
    for _ in range(ROUNDS):
        values = np.einsum("ij,ij->j", x, a @ x)
        for group in clusters(values, CLOSE):  # float32 cannot part them, but it can after a shift that leaves only their spread
            basis = x[:, group]
            inside = basis.T @ (a @ basis - values[group].mean() * basis)
            if len(group) < d:
                x[:, group] = basis @ eigenvectors((inside + inside.T) / 2, noise)
            else:  # all values are close: the shifted matrix is solved in the original frame
                return eigenvectors(a - np.trace(a) / d * np.eye(d), noise)
        x = np.linalg.qr(correction(a, x, CLOSE))[0]
        s = x.T @ (a @ x)
        left = np.abs(s - np.diag(np.diag(s))).max()
        if left <= 4 * noise or left > 0.5 * before:
            break
        before = left
    return x


def refined_eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and unit eigenvectors of a symmetric matrix to double precision."""
    a = (v + v.T) / 2
    x = eigenvectors(a)
    x = x / np.linalg.norm(x, axis=0)
    values = np.einsum("ij,ij->j", x, a @ x)
    residual = np.abs(a @ x - x * values).max(initial=0.0)
    if residual > 1e-12 * len(a) * np.abs(a).max(initial=0.0):
        raise ArithmeticError(f"eigenvectors did not converge: {residual}")
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order]


def column_sums(rows: DataFrame) -> tuple[int, int, list[int]]:
    """Dimension, rows and integer sums of the most frequent length; rows of that length are the fit list."""

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            vectors = batch.column("v")
            lengths = np.asarray(vectors.value_lengths())
            for size in np.unique(lengths).tolist():
                x = integers(vectors.filter(pa.array(lengths == size)), size)
                n, total = held.get(size, (0, 0))
                held[size] = n + len(x), total + exact_sum(x)
        out = [(size, i, n, Decimal(int(s))) for size, (n, total) in held.items() for i, s in enumerate(total)]
        kinds = pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["size", "i", "n", "s"])

    shares = rows.select("v").mapInArrow(run, "size int, i int, n long, s decimal(38,0)")
    totals = cut(shares.groupBy("size", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
    most = totals.filter("i = 0").orderBy(F.desc("n"), "size").first()
    if most is None:
        return 0, 0, []
    return most["size"], most["n"], [int(r["s"]) for r in totals.filter(F.col("size") == most["size"]).orderBy("i").collect()]


def cell_sums(rows: DataFrame, width: int, values) -> np.ndarray:
    """Sum of ``w.T @ w`` over all rows, with ``values`` giving the double matrix ``w`` of a batch."""

    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            w = values(batch)
            total += w.T @ w
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (i.astype(np.int32), j.astype(np.int32), total[i, j])], ["i", "j", "s"])

    out = np.zeros((width, width))
    for r in rows.mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["s"]
    return out


def whitened(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", top: int = TOP) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error`` of every row that takes part."""
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = rows.select(F.col(key).alias("id"), F.col(vector).alias("v")).filter(whole(F.col("v")))
    dim, n, total = column_sums(fit)
    if not n:
        return rows.sparkSession.createDataFrame([], schema)
    fit = fit.filter(F.size("v") == dim)

    def centred(batch) -> np.ndarray:
        return deviations(integers(batch.column("v"), dim), n, total).astype(np.float64) / n

    values, vectors = refined_eigen(cell_sums(fit.select("v"), dim, centred) / n)
    values, vectors, trace = values[:top], vectors[:, :top], float(values.sum())
    varies = values > FLAT * max(values[0], 0)
    turn = vectors[:, varies] / np.sqrt(values[varies])
    explained = [float(e) / trace if trace > 0 else None for e in values]
    error = None
    if varies.any():
        # The rows are centred; a column of ones brings the means along, which only rounding keeps from zero.
        sums = cell_sums(fit.select("v"), turn.shape[1] + 1, lambda b: np.pad(centred(b) @ turn, ((0, 0), (0, 1)), constant_values=1.0)) / n
        mean = sums[:-1, -1]
        error = float(np.abs(sums[:-1, :-1] - np.outer(mean, mean) - np.eye(len(mean))).max())
    count = len(values)
    place = np.flatnonzero(varies)

    def run(batches):
        for batch in (b.slice(i, 2048) for b in batches for i in range(0, len(b), 2048)):
            d = deviations(integers(batch.column("v"), dim), n, total)
            w = np.full((len(batch), count), np.nan)
            w[:, place] = (d.astype(np.float64) / n) @ turn
            rows_ = len(batch) * count
            at = pa.array(np.repeat(np.arange(len(batch)), count))
            yield pa.RecordBatch.from_arrays([
                batch.column("id").take(at), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(batch))), pa.array(np.full(rows_, n)),
                pa.array(squares(d), pa.int64()).take(at), pa.array(w.ravel(), mask=np.isnan(w.ravel())),
                pa.array(explained * len(batch), pa.float64()), pa.array([error] * rows_, pa.float64()),
            ], [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return fit.mapInArrow(run, schema)


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 32 whitened components of every embedding."""
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

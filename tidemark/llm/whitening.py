"""Embedding whitening by Chebyshev-filtered subspace iteration.

Entries c become whole numbers x = floor(1024 c) + 100000. The leading eigenvectors of the covariance of x come from passes over
the rows that return XᵀXQ for a thin block Q, X centred before it is multiplied: no covariance matrix is ever formed.

1. A few Lanczos passes with one vector bound the spectrum from below.
2. A Chebyshev polynomial, small on [that bound, smallest Ritz value of the block], grows the wanted directions: one pass a degree.
3. QR, one more pass, Rayleigh-Ritz. Rounds go on until the residuals of all wanted components are certified: below ``CERTIFIED``
   of the largest eigenvalue, and no longer falling.

A task returns one d x block sum; the driver holds d x block numbers (d is the length of a vector, whatever the rows).

Vectors that are null or empty, or hold null or non-finite entries, take no part, nor do those whose whole numbers pass ``WIDEST``
(their sums would not be exact). All vectors that count have one length, the most frequent (of equally frequent ones the longest).
Null ids are kept, repeated rows each count, extra columns are ignored. Directions without variance have no component, so fewer
than ``k`` may come out (none for a single vector or an empty table). ``deviation`` is null where it passes 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import table, written

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
WIDEST = 2**45
GUARD, DEGREE, LANCZOS = 24, 8, 10
CERTIFIED, ROUNDS = 1e-12, 200
#: Entries of the centred matrix a task multiplies at once.
AT_ONCE = 1 << 22


# --- whole numbers -----------------------------------------------------------------------------------------

def whole(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x): the vectors that count, as whole numbers."""
    def convert(batches):
        for batch in batches:
            v = batch.column(1)
            c = np.asarray(v.flatten().to_numpy(zero_copy_only=False), np.float64)
            lengths = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = lengths.cumsum()
            with np.errstate(all="ignore"):
                x = np.floor(c * SCALE) + SHIFT
                bad = np.concatenate(([0], (~(np.abs(x) <= WIDEST)).cumsum()))
            good = (lengths > 0) & (bad[ends] == bad[ends - lengths])
            x = np.where(np.abs(x) <= WIDEST, x, 0).astype(np.int64)[np.repeat(good, lengths)]
            offsets = np.concatenate(([0], lengths[good].cumsum())).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(x))], names=["vec_id", "x"])

    kind = vectors.schema[id_col].dataType.simpleString()
    x = written(vectors.select(F.col(id_col).alias("vec_id"), vector_col).mapInArrow(convert, f"vec_id {kind}, x array<bigint>"))
    lengths = x.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(2).collect()
    return x if len(lengths) < 2 else x.where(F.size("x") == lengths[0]["d"])


def _rows(batch: pa.RecordBatch, at: int, d: int):
    """The rows of a batch as matrices of bounded size."""
    x = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    step = max(1, AT_ONCE // max(d, 1))
    for k in range(0, len(x), step):
        yield x[k : k + step]


def _summed(x: DataFrame, d: int, part: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum of ``part(rows)``, ``size`` numbers, over all rows: summed in the task, then by Spark."""
    def sums(batches):
        total = np.zeros(size)
        for batch in batches:
            for rows in _rows(batch, 0, d):
                total += part(rows).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["at", "v"])

    out = np.zeros(size)
    for at, v in x.select("x").mapInArrow(sums, "at int, v double").groupBy("at").agg(F.sum("v")).collect():
        out[at] = v
    return out


def _exact_sums(x: DataFrame) -> tuple[int, list[int]]:
    """How many vectors, and the sum per dimension, exactly."""
    def sums(batches):
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                d = len(batch.column(0)[0])
                for rows in _rows(batch, 0, d):
                    for k in range(0, len(rows), 1 << 16):
                        s = rows[k : k + (1 << 16)].sum(0, dtype=np.int64).astype(object)
                        total = s if total is None else total + s
                n += batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total)), pa.int32()), pa.array([str(n), *map(str, total)])], names=["at", "v"])

    rows = x.select("x").mapInArrow(sums, "at int, v string").groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).sort("at").collect()
    return (int(rows[0]["v"]), [int(r["v"]) for r in rows[1:]]) if rows else (0, [])


# --- the eigenproblem --------------------------------------------------------------------------------------

def lowest(apply: Callable[[np.ndarray], np.ndarray], d: int, steps: int = LANCZOS) -> float:
    """An estimate from below of the smallest eigenvalue, by Lanczos."""
    rng = np.random.default_rng(7)
    basis, alpha, beta = [], [], []
    v = rng.standard_normal(d)
    for _ in range(min(steps, d)):
        v /= np.linalg.norm(v)
        basis.append(v)
        w = apply(v[:, None])[:, 0]
        alpha.append(float(v @ w))
        for b in basis:  # keep the basis orthogonal
            w = w - (b @ w) * b
        beta.append(float(np.linalg.norm(w)))
        if beta[-1] <= 1e-10 * max(alpha):
            break
        v = w
    t = np.diag(alpha) + np.diag(beta[:-1], 1) + np.diag(beta[:-1], -1)
    values, vectors = np.linalg.eigh(t)
    return max(0.0, float(values[0] - beta[-1] * abs(vectors[-1, 0])))


def chebyshev(apply, q: np.ndarray, aq: np.ndarray, low: float, cut: float, top: float, degree: int = DEGREE) -> np.ndarray:
    """The scaled Chebyshev polynomial of the matrix on ``q``: small on [low, cut], 1 in size at ``top``."""
    half, mid = max((cut - low) / 2, 1e-10 * top), (cut + low) / 2
    first = sigma = half / (top - mid)
    before, now = q, (aq - mid * q) * (sigma / half)
    for _ in range(1, degree):
        new = 1 / (2 / first - sigma)
        before, now = now, (apply(now) - mid * now) * (2 * new / half) - (sigma * new) * before
        sigma = new
    return now


def leading(apply: Callable[[np.ndarray], np.ndarray], d: int, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues and their unit eigenvectors (columns) of a symmetric matrix without negative eigenvalues."""
    block = min(d, k + GUARD)
    k = min(k, d)

    def ritz(q):
        aq = apply(q)
        h = q.T @ aq
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, aq = q @ turn, aq @ turn
        return values, q, aq, float(np.linalg.norm(aq[:, :k] - q[:, :k] * values[:k], axis=0).max(initial=0))

    q = np.linalg.qr(np.random.default_rng(11).standard_normal((d, block)))[0]
    values, q, aq, residual = ritz(q)
    if block == d or values[0] <= 0:
        return values[:k], q[:, :k]
    low = lowest(apply, d)
    for _ in range(ROUNDS):
        cut = max(float(values[-1]), 0.0)
        y = chebyshev(apply, q, aq, min(low, cut), cut, float(values[0]))
        last = residual
        values, q, aq, residual = ritz(np.linalg.qr(y)[0])
        if residual <= CERTIFIED * values[0] and residual > last / 2:
            return values[:k], q[:, :k]
    raise ArithmeticError(f"residual {residual} after {ROUNDS} rounds")


@dataclass
class Whitening:
    """What the fit leaves: small, whatever the number of rows."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray  # a column each
    trace: float


def fit(x: DataFrame, k: int = COMPONENTS) -> Whitening:
    """The leading components of the covariance of ``x`` (see ``whole``)."""
    n, sums = _exact_sums(x)
    d = len(sums)
    if n < 2:
        return Whitening(n, sums, np.empty(0), np.empty((d, 0)), 0.0)
    mean = np.array([s / n for s in sums])
    trace = float(_summed(x, d, lambda rows: ((rows - mean) ** 2).sum(0), d).sum()) / n
    if trace == 0:
        return Whitening(n, sums, np.empty(0), np.empty((d, 0)), 0.0)

    def apply(q: np.ndarray) -> np.ndarray:
        def part(rows):
            centred = rows - mean
            return centred.T @ (centred @ q)

        return _summed(x, d, part, q.size).reshape(q.shape) / n

    values, vectors = leading(apply, d, k)
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    some = values > 1e-12 * trace
    return Whitening(n, sums, values[some], vectors[:, some], trace)


def whitened(x: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, deviation, w): the exact squared distance from the sums, and the whitened components."""
    d, n = len(model.sums), model.n
    mean = np.array([s / n for s in model.sums]) if n else np.empty(0)
    turn = model.components / np.sqrt(model.values)
    k = turn.shape[1]
    sums, exact = np.array(model.sums, object), max(map(abs, model.sums), default=0) < 2**62
    kind = x.schema["vec_id"].dataType.simpleString()

    def deviations(rows):
        widest = int(np.abs(rows).max(initial=0))
        if exact and n * widest < 2**62:
            y = n * rows - sums.astype(np.int64)
            if int(np.abs(y).max(initial=0)) ** 2 * d < 2**63:
                return (y * y).sum(1).tolist()
        totals = (((n * rows.astype(object)) - sums) ** 2).sum(1)
        return [int(t) if t < 2**63 else None for t in totals]

    def project(batches):
        for batch in batches:
            dev, w = [], []
            for rows in _rows(batch, 1, d) if d else ():
                dev += deviations(rows)
                w.append((rows - mean) @ turn)
            flat = np.concatenate(w).ravel() if w else np.empty(0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * k), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dev, pa.int64()), lists], names=["vec_id", "deviation", "w"])

    return x.select("vec_id", "x").mapInArrow(project, f"vec_id {kind}, deviation bigint, w array<double>")


def identity_error(w: DataFrame, n: int, k: int) -> float:
    """The largest absolute entry of the covariance of the whitened rows minus the identity."""
    if not n or not k:
        return 0.0
    got = _summed(w.select(F.col("w").alias("x")), k, lambda rows: np.vstack([rows.sum(0), rows.T @ rows]), k * (k + 1)).reshape(k + 1, k) / n
    return float(np.abs(got[1:] - np.outer(got[0], got[0]) - np.eye(k)).max())


def op11(spark, sf_dir: str) -> DataFrame:
    """Per vector and component: the whitened value, with the exact deviation and what the component explains."""
    x = whole(table(spark, sf_dir, "embeddings"))
    model = fit(x)
    w = written(whitened(x, model))
    k = len(model.values)
    explained = F.array(*(F.lit(float(e / model.trace)) for e in model.values)) if k else F.array().cast("array<double>")
    rows = w.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                       F.get(explained, F.col("at")).alias("explained"), F.lit(identity_error(w, model.n, k)).alias("identity_error"))

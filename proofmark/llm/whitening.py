"""Whitening of embeddings by a one-sided Jacobi SVD.

The centred rows are never multiplied with each other: blocks of them are compressed to triangles by QR, in each task and
then up a tree, so that one triangle R of the columns' number is left, with the singular values of the whole table. Plane
rotations make R's columns orthogonal; the rotations together are the components, and the lengths of the columns the
standard deviations, small ones as accurate as large ones.
"""

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, merged, sliced, stored
from .vectors import commonest_length, finite, matrix

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
#: Where numbers end, so that they stay longs.
MOST = 1 << 60
COLUMNS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and right singular vectors, as columns, of a matrix.

    Its columns are turned in pairs until all are orthogonal. In each round every column is in one pair, so the pairs of a
    round are turned together; after as many rounds as there are columns each has met every other.
    """
    d = r.shape[1]
    even = d + d % 2
    a = np.zeros((len(r), even))
    a[:, :d] = r
    v = np.eye(even)
    order = np.arange(even)
    for _ in range(sweeps):
        turned = False
        for _ in range(max(1, even - 1)):
            p, q = order[: even // 2], order[even // 2 :][::-1]
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            todo = np.abs(gamma) > 1e-15 * np.sqrt(alpha * beta)
            if todo.any():
                turned = True
                zeta = (beta - alpha)[todo] / (2 * gamma[todo])
                t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1, zeta))
                c = 1 / np.hypot(1, t)
                s = c * t
                p, q = p[todo], q[todo]
                for m in (a, v):
                    m[:, p], m[:, q] = c * m[:, p] - s * m[:, q], s * m[:, p] + c * m[:, q]
            order[1:] = np.roll(order[1:], 1)
        if not turned:
            break
    values, v = np.sqrt((a * a).sum(axis=0))[:d], v[:d, :d]
    falling = np.argsort(-values, kind="stable")
    return values[falling], v[:, falling]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S of each number, exact: in 64 bits, or as Python's numbers where these could be too few."""
    most = max(int(np.abs(x).max(initial=0)), max(map(abs, sums), default=0) // max(1, n)) + 1
    if n * most < 2**62:
        return n * x - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def _deviations(y: np.ndarray) -> list[int | None]:
    """The sum of squares of each row, exact; null where it is no long."""
    if y.dtype != object and int(np.abs(y).max(initial=0)) ** 2 * max(1, y.shape[1]) < 2**63:
        return (y * y).sum(axis=1).tolist()
    return [total if (total := sum(int(v) ** 2 for v in row)) < 2**63 else None for row in y]


def _part(value: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([value], pa.binary())], names=["part"])


def _sums(d: int) -> Callable[[Batches], Batches]:
    """The number of rows and the sum of each dimension, as Python's numbers."""

    def run(batches: Batches) -> Batches:
        n, sums = 0, [0] * d
        for batch in sliced(batches):
            x = matrix(batch.column("x"), d)
            small = int(np.abs(x).max(initial=0)) < 2**48
            n += len(x)
            sums = [a + int(b) for a, b in zip(sums, x.sum(axis=0) if small else x.astype(object).sum(axis=0), strict=True)]
        yield _part(json.dumps([n, *sums]).encode())

    return run


def _add(a: bytes, b: bytes) -> bytes:
    return json.dumps([x + y for x, y in zip(json.loads(a), json.loads(b), strict=True)]).encode()


def _square(part: bytes) -> np.ndarray:
    flat = np.frombuffer(part)
    return flat.reshape(-1, int(len(flat) ** 0.5))


def _triangle(rows: np.ndarray) -> np.ndarray:
    """R of the QR of rows, as many rows as columns."""
    d = rows.shape[1]
    r = np.linalg.qr(rows, mode="r")
    return np.concatenate([r, np.zeros((d - len(r), d))]) if len(r) < d else r


def _triangles(d: int, n: int, sums: list[int]) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        r = np.zeros((d, d))
        for batch in sliced(batches):
            rows = centred(matrix(batch.column("x"), d), n, sums).astype(float) / n
            r = _triangle(np.concatenate([r, rows]))
        yield _part(r.tobytes())

    return run


def _moments(d: int, n: int, sums: list[int], to: np.ndarray) -> Callable[[Batches], Batches]:
    """How many whitened rows, their means, and the sums of products of what is left of them without their means."""

    def run(batches: Batches) -> Batches:
        total = None
        for batch in sliced(batches):
            w = centred(matrix(batch.column("x"), d), n, sums).astype(float) @ to / n
            if len(w):
                mean = w.mean(axis=0)
                part = np.concatenate([[len(w)], mean, ((w - mean).T @ (w - mean)).ravel()]).tobytes()
                total = part if total is None else _joined(total, part)
        if total is not None:
            yield _part(total)

    return run


def _joined(a: bytes, b: bytes) -> bytes:
    x, y = np.frombuffer(a), np.frombuffer(b)
    k = int((len(x) - 1) ** 0.5)
    apart = y[1 : k + 1] - x[1 : k + 1]
    n = x[0] + y[0]
    products = x[k + 1 :] + y[k + 1 :] + (np.outer(apart, apart) * (x[0] * y[0] / n)).ravel()
    return np.concatenate([[n], x[1 : k + 1] + apart * (y[0] / n), products]).tobytes()


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each kept row and component.

    Rows whose vector is null, or holds null or non-finite numbers, take no part; of vectors of several lengths those of the
    commonest one do (ties: the longest). Each number c becomes x = floor(scale c) + offset (scale c ends at 2^60 either way). Fitted is each distinct vector
    once, however often it occurs; n is their number. Components go by falling eigenvalue of the covariance of x, from 1 to
    at most `components`; directions in which all vectors agree (to rounding) can't be whitened and have no rows, so a table
    that is empty, or has one distinct vector, gives none. A deviation that is no long is null. vec_id may be null or
    repeated: every row has its results. Other columns are left out.

    Driver and tasks hold one matrix of length x length numbers (32 kB at 64); it grows with the vectors' length, not with
    their number.
    """
    spark = vectors.sparkSession
    most = F.lit(float(MOST))
    number = lambda c: F.floor(F.least(F.greatest(c.cast("double") * scale, -most), most)).cast("long") + offset
    rows = vectors.filter(finite(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", number).alias("x"))
    d = commonest_length(rows, "x")
    rows = rows.filter(F.size("x") == d)
    if d == 0:
        return spark.createDataFrame([], COLUMNS)
    fit = stored(rows.select("x").distinct(), "fit")
    n, *sums = json.loads(merged(fit.mapInArrow(_sums(d), "part binary"), _add))
    r = _square(merged(fit.mapInArrow(_triangles(d, n, sums), "part binary"), lambda a, b: _triangle(np.concatenate([_square(a), _square(b)])).tobytes()))
    values, directions = jacobi(r)
    rank = int((values > values[0] * d * 4 * np.finfo(float).eps).sum()) if values[0] > 0 else 0
    k = min(components, rank)
    if k == 0:
        return spark.createDataFrame([], COLUMNS)
    to = directions[:, :k] * (n**0.5 / values[:k])
    explained = values[:k] ** 2 / (values**2).sum()
    moments = np.frombuffer(merged(fit.mapInArrow(_moments(d, n, sums, to), "part binary"), _joined))
    error = float(np.abs(moments[k + 1 :].reshape(k, k) / moments[0] - np.eye(k)).max())

    def run(batches: Batches) -> Batches:
        for batch in sliced(batches):
            y = centred(matrix(batch.column("x"), d), n, sums)
            m = len(y)
            deviation = pa.array(_deviations(y), pa.int64())
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n)),
                    deviation.take(each),
                    pa.array((y.astype(float) @ to / n).ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, COLUMNS)

"""Operator 11. Whitening of embeddings by cyclic Jacobi rotations.

Three passes over the vectors, each an Arrow map without a shuffle of vectors:

1. Sums: the rows of each length, and per dimension their sum and extremes.
2. Scatter: products of the entries, centred by the nearest whole number to the mean. What is then left of the mean, less than
   one half, is taken out of the sums exactly. Entries are whole numbers; a task's products are exact as long as they stay
   under 2**53, so it sends a partial sum before they could grow beyond, and Spark adds these as decimals. The covariance
   doesn't depend on how rows are dealt, nor on tasks that run again.
3. Output: deviations and projections; the covariance of these is measured in a pass of its own (``identity_error``).

The driver gets a square matrix (its size follows from the dimensions alone), rotates it until every entry off the diagonal is
below rounding against *its own two* diagonal entries - that keeps small eigenvalues accurate where large ones are near - and
sends the sorted, scaled eigenvectors to the tasks: dimensions x 32 numbers.

Defined cases. A vector takes part if it isn't null, has no null or non-finite entry, and has the length that most of these
have (of equally many, the shorter); others give no rows. Fixed-point entries beyond 2**62 are held there.
Repeated rows and ids, also null ids, each give their rows. A direction in which the vectors don't vary, up to rounding, can't be
whitened and is left out; so one row, or equal rows, give no rows, nor does an empty table. Of equal eigenvalues any orthogonal
directions are right; the ones that are used are the same for all rows. A deviation that a 64-bit number can't hold is null.
Entries that differ by over 2**26 have products that are rounded to double precision. Other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm._common import release

#: Fixed point of the contract: entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000

#: Components that are kept, at most.
COMPONENTS = 32

#: Numbers that a task holds as doubles at once, and sweeps after which rotations must have converged.
SLICE_NUMBERS, SWEEPS = 1 << 20, 60

EXACT, LONGEST = 1 << 53, (1 << 63) - 1


def matrices(column: pa.Array, length: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows' places, vectors as whole numbers) of the usable vectors of an Arrow column, slice by slice: one length in each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    for n in [length] if length is not None else np.unique(lengths[lengths >= 0]).tolist():
        at = np.flatnonzero(lengths == n)
        for k in range(0, len(at), step := max(1, SLICE_NUMBERS // max(1, n))):
            rows = at[k : k + step]
            values = column.take(pa.array(rows)).flatten()
            x = values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), n)  # null becomes NaN
            good = np.isfinite(x).all(axis=1)
            yield rows[good], fixed_point(x[good])


def fixed_point(c: np.ndarray) -> np.ndarray:
    """floor(64 c) + 1000000 as longs; floor(64 c) is held within 2**62 either way."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(c * SCALE), -(2.0**62), 2.0**62).astype(np.int64) + SHIFT


def _decimals(values: np.ndarray) -> list[str]:
    return [str(int(v)) for v in values.ravel()]


@dataclass(frozen=True)
class Whitening:
    """n, per dimension the sum, and the unit eigenvectors as columns by falling eigenvalue."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray

    @property
    def length(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n x - S as exact whole numbers, x - S/n): objects where 64 bits are too few."""
        most = max(int(np.abs(x).max(initial=0)) * self.n, max(map(abs, self.sums), default=0))
        kind = np.int64 if most < LONGEST // 2 else object
        z = x.astype(kind) * self.n - np.array(self.sums, dtype=kind)
        return z, (z.astype(np.float64) if kind is np.int64 else np.array([[int(v) for v in row] for row in z], dtype=np.float64).reshape(z.shape)) / self.n

    def project(self, centred: np.ndarray) -> np.ndarray:
        return centred @ (self.vectors / np.sqrt(self.values))


def deviations(z: np.ndarray) -> list[int | None]:
    """The exact sum of squares of each row; None where it needs more than 64 bits."""
    most = max(abs(int(z.max(initial=0))), abs(int(z.min(initial=0))))
    if most * most * max(1, z.shape[1]) <= LONGEST:
        return (z.astype(np.int64) ** 2).sum(axis=1).tolist()
    found = (sum(int(v) * int(v) for v in row) for row in z)
    return [s if s <= LONGEST else None for s in found]


def rounds(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of n places as rounds of disjoint pairs, each pair once: the order of a round-robin tournament."""
    places = list(range(n + n % 2))
    out = []
    for _ in range(len(places) - 1):
        half = len(places) // 2
        pairs = [(min(a, b), max(a, b)) for a, b in zip(places[:half], reversed(places[half:]), strict=True) if max(a, b) < n]
        out.append((np.array([p for p, _ in pairs], dtype=np.int64), np.array([q for _, q in pairs], dtype=np.int64)))
        places = [places[0], places[-1], *places[1:-1]]
    return out


def jacobi(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, of a symmetric positive semidefinite matrix.

    A sweep rotates each pair of places once; the pairs of a round share no place, so their rotations are applied together.
    """
    a = np.array(a, dtype=np.float64)
    n = len(a)
    v, order = np.eye(n), rounds(n) if n > 1 else []
    eps, tiny = np.finfo(np.float64).eps, np.finfo(np.float64).tiny
    for _ in range(SWEEPS):
        turned = False
        for p, q in order:
            app, aqq, apq = a[p, p], a[q, q], a[p, q]
            on = np.abs(apq) > np.maximum(eps * np.sqrt(np.abs(app)) * np.sqrt(np.abs(aqq)), tiny)
            if not on.any():
                continue
            turned = True
            p, q, app, aqq, apq = p[on], q[on], app[on], aqq[on], apq[on]
            with np.errstate(over="ignore"):  # too far apart to need more than a turn of nothing
                theta = (aqq - app) / (2 * apq)
            t = np.where(theta >= 0, 1.0, -1.0) / (np.abs(theta) + np.hypot(theta, 1.0))
            c = 1 / np.hypot(t, 1.0)
            s = t * c
            turn = lambda m: (c[:, None] * m[p] - s[:, None] * m[q], s[:, None] * m[p] + c[:, None] * m[q])  # noqa: E731, B023
            a[p], a[q] = turn(a)
            a = np.ascontiguousarray(a.T)  # columns as rows: the next turn is theirs
            a[p], a[q] = turn(a)
            a[p, q] = a[q, p] = 0.0
            a[p, p], a[q, q] = app - t * apq, aqq + t * apq
            v[p], v[q] = turn(v)
        if not turned:
            break
    else:
        raise ArithmeticError("rotations have not converged")
    values = np.diag(a)
    by = np.argsort(-values, kind="stable")
    return values[by], v[by].T


def _tally(vectors: DataFrame, length: int | None = None) -> dict[int, tuple[int, list[int], list[int], list[int]]]:
    """By length: rows, and per dimension the sum, the least and the greatest entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for rows, x in matrices(batch.column(0)):
                if not len(rows):
                    continue
                held = found.setdefault(x.shape[1], [0, np.zeros(x.shape[1], dtype=object), None, None])
                held[0] += len(rows)
                high = int(np.abs(x).max(initial=0)) * len(rows) < LONGEST
                held[1] = held[1] + (x.sum(axis=0) if high else x.astype(object).sum(axis=0)).astype(object)
                low, top = x.min(axis=0), x.max(axis=0)
                held[2] = low if held[2] is None else np.minimum(held[2], low)
                held[3] = top if held[3] is None else np.maximum(held[3], top)
        for n, (rows, sums, low, top) in found.items():
            yield pa.RecordBatch.from_pydict({"length": [n], "rows": [rows], "sums": [_decimals(sums)], "low": [low.tolist()], "top": [top.tolist()]}, pa.schema([("length", pa.int32()), ("rows", pa.int64()), ("sums", pa.list_(pa.string())), ("low", pa.list_(pa.int64())), ("top", pa.list_(pa.int64()))]))
        release()

    partial = vectors.mapInArrow(run, "length int, rows long, sums array<string>, low array<long>, top array<long>")
    rows = {r["length"]: r["rows"] for r in partial.groupBy("length").agg(F.sum("rows").alias("rows")).collect()}
    if not rows:
        return {}
    length = max(rows, key=lambda n: (rows[n], -n))  # only this one's dimensions go to the driver
    each = partial.where(F.col("length") == length).select(F.posexplode(F.arrays_zip("sums", "low", "top")).alias("at", "x"))
    sums = each.groupBy("at").agg(F.sum(F.col("x.sums").cast("decimal(38,0)")).alias("sum"), F.min("x.low").alias("low"), F.max("x.top").alias("top")).orderBy("at").collect()
    return {length: (rows[length], [int(r["sum"]) for r in sums], [r["low"] for r in sums], [r["top"] for r in sums])}


def _scatter(vectors: DataFrame, centre: list[int], most: int) -> tuple[np.ndarray, bool]:
    """The sums of products of the entries less ``centre``, of at most ``most`` in size, and whether they are exact."""
    length, middle = len(centre), np.array(centre, dtype=np.int64)
    exact = most * most <= EXACT
    bound = max(1, EXACT // max(1, most * most)) if exact else 1 << 62
    upper = np.triu_indices(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = np.zeros((length, length)), 0

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([held[upper].tolist()], pa.list_(pa.float64()))], ["products"])

        for batch in batches:
            for _, x in matrices(batch.column(0), length):
                for k in range(0, len(x), bound):
                    part = x[k : k + bound]
                    if rows + len(part) > bound:
                        yield sent()
                        held, rows = np.zeros((length, length)), 0
                    y = part.astype(np.float64) - middle
                    held += y.T @ y
                    rows += len(part)
        if rows:
            yield sent()
        release()

    kind = "decimal(38,0)" if exact else "double"
    each = vectors.mapInArrow(run, "products array<double>").select(F.posexplode("products").alias("at", "x"))
    sums = each.groupBy("at").agg(F.sum(F.col("x").cast(kind)).alias("sum")).collect()
    out = np.zeros((length, length), dtype=object)
    for r in sums:
        i, j = upper[0][r["at"]], upper[1][r["at"]]
        out[i, j] = out[j, i] = int(r["sum"]) if exact else float(r["sum"])
    return out, exact


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """``vectors``: one column of arrays. None where there is nothing to whiten."""
    tally = _tally(vectors)
    if not tally:
        return None
    ((length, (n, sums, low, top)),) = tally.items()
    centre = [(2 * s + n) // (2 * n) for s in sums]
    most = max((max(t - c, c - b) for t, b, c in zip(top, low, centre, strict=True)), default=0)
    products, exact = _scatter(vectors, centre, most)
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]  # what is left of each sum, under n / 2 in size
    covariance = np.array([[(int(products[i, j]) * n - rest[i] * rest[j]) / (n * n) if exact else products[i, j] / n - rest[i] / n * (rest[j] / n) for j in range(length)] for i in range(length)], dtype=np.float64).reshape(length, length)
    values, found = jacobi(covariance)
    varied = values > (values[0] * length * np.finfo(np.float64).eps if length else 0)
    kept = min(components, int(varied.sum()))
    return Whitening(n, sums, float(np.trace(covariance)), values[:kept], found[:, :kept]) if kept else None


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """How far the covariance of all whitened vectors is from the identity: the largest entry, measured."""
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for _, x in matrices(batch.column(0), model.length):
                w = model.project(model.centred(x)[1])
                total += w.sum(axis=0)
                products += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([total, products.ravel()]).tolist()], pa.list_(pa.float64()))], ["sums"])
        release()

    each = vectors.mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("at", "x"))
    sums = np.array([r["x"] for r in each.groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").collect()])
    mean, products = sums[:k] / model.n, sums[k:].reshape(k, k) / model.n
    return float(np.abs(products - np.outer(mean, mean) - np.eye(k)).max())


SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(table: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each vector that takes part and each component: the id and the columns of ``SCHEMA``."""
    from pyspark.sql.types import StructType

    vectors = table.select(F.col(vector).cast("array<double>").alias("vector"))
    out = StructType([table.select(id_column).schema.fields[0], *StructType.fromDDL(SCHEMA).fields])
    model = fit(vectors, components)
    if model is None:
        return table.sparkSession.createDataFrame([], out)
    error = identity_error(vectors, model)
    sent = table.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        model, arrow = sent.value, to_arrow_schema(out)
        k = len(model.values)
        for batch in batches:
            for rows, x in matrices(batch.column(1), model.length):
                z, centred = model.centred(x)
                m = len(rows)
                columns = [
                    batch.column(0).take(pa.array(np.repeat(rows, k))),
                    np.tile(np.arange(1, k + 1, dtype=np.int32), m),
                    np.full(m * k, model.n),
                    pa.array(deviations(z), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    model.project(centred).ravel(),
                    np.tile(model.values / model.trace, m),
                    np.full(m * k, error),
                ]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
        release()

    return table.select(id_column, F.col(vector).cast("array<double>").alias("_vector")).mapInArrow(run, out)

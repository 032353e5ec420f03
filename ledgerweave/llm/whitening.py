"""Embedding whitening by a compensated covariance and a tridiagonal divide-and-conquer eigen-solve.

1. Entries become whole numbers on a grid; counts and sums by dimension are exact.
2. Each task centres its vectors in double-double (a number as the unevaluated sum of a high and a low double), multiplies
   with error-free products and adds the outer products up pairwise; tasks' high and low parts are merged in two levels.
   What reaches the driver is one covariance matrix: its size depends on the dimension alone.
3. The matrix is brought to tridiagonal form by reflections, torn in halves, and the halves' eigenvalues are joined by the
   secular equation, with deflation and recomputed weights, so that vectors are orthogonal.  Two steps of refinement in
   extended precision against the whole covariance follow.
4. Vectors are projected; the covariance of what comes out is taken by step 2 again, and its distance from the identity.

Defined results: rows whose vector is null, empty, holds a null or non-finite entry, or an entry beyond 2**30 (the grid's
sums stay exact up to there) are dropped, and rows whose length is not the most frequent one (ties: the longer); equal rows
and null ids are rows like others.  A deviation that passes a long is null.  Directions without variance are no
components, so one vector, or equal ones, give no rows, as does an empty table.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables

GRID, SHIFT, COMPONENTS = 1024, 100000, 8
LARGEST = 2.0**30
#: Numbers that are added up at once, and entries of a sum that one merging row holds.
AT_ONCE, SEGMENT = 1 << 16, 256
#: Groups of tasks whose sums are merged first.
GROUPS = 32
OUT_SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"

Wide = tuple[np.ndarray, np.ndarray]


def two_sum(a, b) -> Wide:
    """a + b, rounded, and what the rounding lost."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def halves(a) -> Wide:
    c = 134217729.0 * a
    high = c - (c - a)
    return high, a - high


def two_product(a, b, a_halves: Wide | None = None, b_halves: Wide | None = None) -> Wide:
    """a * b, rounded, and what the rounding lost."""
    (ah, al), (bh, bl) = a_halves or halves(a), b_halves or halves(b)
    p = a * b
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def add(a: Wide, b: Wide) -> Wide:
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def add_rows(a: Wide) -> Wide:
    """The sum of the rows, pairwise."""
    while len(a[0]) > 1:
        half = len(a[0]) // 2
        odd = tuple(x[2 * half :] for x in a)
        a = add(tuple(x[:half] for x in a), tuple(x[half : 2 * half] for x in a))
        if len(odd[0]):
            a = tuple(np.concatenate(x) for x in zip(a, odd))
    return a[0][0], a[1][0]


def outer_sum(a: Wide) -> Wide:
    """The sum of the rows' outer products, upper triangle row by row."""
    size = a[0].shape[1]
    i, j = np.triu_indices(size)
    total = np.zeros(len(i)), np.zeros(len(i))
    step = max(1, AT_ONCE // len(i))
    for k in range(0, len(a[0]), step):
        high, low = a[0][k : k + step], a[1][k : k + step]
        top, bottom = halves(high)
        p, e = two_product(high[:, i], high[:, j], (top[:, i], bottom[:, i]), (top[:, j], bottom[:, j]))
        total = add(total, add_rows(two_sum(p, e + (high[:, i] * low[:, j] + low[:, i] * high[:, j]))))
    return total


def wide(x: Fraction) -> tuple[float, float]:
    high = float(x)
    return high, float(x - Fraction(high))


def exact(high: float, low: float) -> Fraction:
    return Fraction(high) + Fraction(low)


def matrices(column: pa.Array, size: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of grid numbers) of the usable vectors, by length, or of one length."""
    edges = column.offsets.to_numpy()
    length = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(edges), 0)
    flat = column.values.to_numpy(zero_copy_only=False)
    for n in np.unique(length) if size is None else [size]:
        rows = np.flatnonzero(length == n)
        if n and len(rows):
            got = flat[edges[rows][:, None] + np.arange(n)]
            good = (np.abs(got) <= LARGEST).all(1)  # not so for NaN and null
            yield rows[good], (np.floor(GRID * got[good]) + SHIFT).astype(np.int64)


def _double(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).cast("array<double>").alias("v"))


def grid_sums(tables: Tables, df: DataFrame, vector_col: str) -> tuple[int, list[int]]:
    """How many vectors of the most frequent length there are, and their exact sums by dimension."""

    def run(batches):
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for _, x in matrices(batch.column(0)):
                n, s = sums.get(x.shape[1], (0, 0))
                sums[x.shape[1]] = n + len(x), s + x.sum(0).astype(object)
        for size, (n, s) in sums.items():
            columns = [pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array(map(str, s), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["size", "at", "n", "s"])

    parts = tables.write(_double(df, vector_col).mapInArrow(run, "size int, at int, n long, s string"))
    sums = parts.groupBy("size", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38, 0)")).alias("s"))
    best = sums.where("at = 0 AND n > 0").orderBy(F.desc("n"), F.desc("size")).first()
    if best is None:
        return 0, []
    return best["n"], [int(r["s"]) for r in sums.where(F.col("size") == best["size"]).orderBy("at").collect()]


def wide_sum(df: DataFrame, partial: Callable[[pa.RecordBatch], Wide | None]) -> Wide | None:
    """The sum over all batches of what ``partial`` gives for one (None: nothing), in double-double."""
    schema = "segment int, part int, high array<double>, low array<double>"

    def run(batches):
        total = None
        for batch in batches:
            got = partial(batch)
            if got is not None:
                total = got if total is None else add(total, got)
        if total is not None:
            cut = [[x[k : k + SEGMENT] for k in range(0, len(x), SEGMENT)] for x in total]
            task = TaskContext.get().partitionId()
            columns = [pa.array(range(len(cut[0])), pa.int32()), pa.array([task] * len(cut[0]), pa.int32()), *(pa.array([x.tolist() for x in c], pa.list_(pa.float64())) for c in cut)]
            yield pa.RecordBatch.from_arrays(columns, names=["segment", "part", "high", "low"])

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        high, low = add_rows(tuple(np.array(table.column(k).to_pylist()) for k in ("high", "low")))
        return pa.table({"segment": table.column("segment")[:1].cast(pa.int32()), "part": table.column("part")[:1].cast(pa.int32()), "high": pa.array([high.tolist()]), "low": pa.array([low.tolist()])})

    parts = df.mapInArrow(run, schema)
    for key in (["segment", F.pmod("part", F.lit(GROUPS))], ["segment"]):
        parts = parts.groupBy(*key).applyInArrow(merge, schema)
    rows = sorted(parts.collect(), key=lambda r: r["segment"])  # the entries of one matrix
    return (np.concatenate([r["high"] for r in rows]), np.concatenate([r["low"] for r in rows])) if rows else None


def square(a: Wide, size: int) -> np.ndarray:
    """The symmetric matrix of an upper triangle, in extended precision."""
    out = np.zeros((size, size), np.longdouble)
    out[np.triu_indices(size)] = a[0].astype(np.longdouble) + a[1]
    return out + np.triu(out, 1).T


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, side diagonal and orthogonal q with a = q t q', by reflections."""
    a, q = a.copy(), np.eye(len(a))
    for k in range(len(a) - 2):
        u = a[k + 1 :, k].copy()
        norm = np.linalg.norm(u)
        if norm == 0 or not u[1:].any():
            continue
        u[0] += np.copysign(norm, u[0])
        u /= np.linalg.norm(u)
        a[k + 1 :, :] -= 2 * np.outer(u, u @ a[k + 1 :, :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ u, u)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ u, u)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def secular(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of diag(d) + rho z z' for rising distinct d, nonzero z and positive rho.

    Each root lies between its d and the next; it is held as its distance from the nearer of the two, which keeps it
    exact next to them.
    """
    k = len(d)
    gap = np.append(np.diff(d), rho * (z @ z))
    value = lambda shift, mu: 1 + rho * (z * z / (shift - mu[:, None])).sum(1)
    from_left = d[None, :] - d[:, None]
    right_half = value(from_left, gap / 2) < 0
    right_half[-1] = False
    origin = np.arange(k) + right_half
    shift = d[None, :] - d[origin][:, None]
    low, high = np.where(right_half, -gap / 2, 0.0), np.where(right_half, 0.0, np.where(np.arange(k) == k - 1, gap, gap / 2))
    for _ in range(200):
        middle = (low + high) / 2
        inside = (middle != low) & (middle != high)
        if not inside.any():
            break
        with np.errstate(divide="ignore"):
            above = value(shift, middle) < 0
        low, high = np.where(inside & above, middle, low), np.where(inside & ~above, middle, high)
    mu = np.where(right_half, low, high)
    distance = -(shift - mu[:, None])  # root j less d of i
    # weights for which these roots are exact
    weight = np.empty(k)
    for i in range(k):
        others = np.delete(np.arange(k), i)
        paired = np.where(others < i, others, others - 1)  # root j goes with d of j, from i on with the next
        weight[i] = distance[k - 1, i] * np.prod(distance[paired, i] / (d[others] - d[i])) / rho
    weight = np.copysign(np.sqrt(np.abs(weight)), z)
    vectors = (weight[None, :] / distance).T
    return d[origin] + mu, vectors / np.linalg.norm(vectors, axis=0)


def divide_and_conquer(d: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, rising, and vectors of a tridiagonal matrix: both halves' are joined by a change of rank one."""
    n = len(d)
    if n == 1:
        return d.copy(), np.ones((1, 1))
    m = n // 2
    rho = abs(e[m - 1])
    left, right = d[:m].copy(), d[m:].copy()
    left[-1] -= rho
    right[0] -= rho
    (d1, q1), (d2, q2) = divide_and_conquer(left, e[: m - 1]), divide_and_conquer(right, e[m:])
    q = np.zeros((n, n))
    q[:m, :m], q[m:, m:] = q1, q2
    d, z = np.concatenate([d1, d2]), np.concatenate([q1[-1], np.copysign(1.0, e[m - 1]) * q2[0]])
    order = np.argsort(d, kind="stable")
    d, z, q = d[order], z[order], q[:, order]
    least = 8 * np.finfo(float).eps * max(np.abs(d).max(), rho)
    z[rho * np.abs(z) <= least] = 0
    last = None
    for i in np.flatnonzero(z):  # equal values: a rotation leaves one of the two out
        if last is not None and d[i] - d[last] <= least:
            r = np.hypot(z[last], z[i])
            c, s = z[i] / r, z[last] / r
            q[:, [last, i]] = q[:, [last, i]] @ np.array([[c, s], [-s, c]])
            z[last], z[i] = 0, r
        last = i
    live = np.flatnonzero(z)
    if len(live):
        d[live], vectors = secular(d[live], z[live], rho)
        q[:, live] = q[:, live] @ vectors
    order = np.argsort(d, kind="stable")
    return d[order], q[:, order]


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit vectors (columns; the entry of largest size is positive) of a symmetric matrix in extended precision."""
    scale = np.abs(a).max() or np.longdouble(1)
    a = a / scale
    d, e, q = tridiagonal(a.astype(float))
    values, vectors = divide_and_conquer(d, e)
    values, x = values.astype(np.longdouble), (q @ vectors).astype(np.longdouble)
    for _ in range(2):
        r, s = np.eye(len(a)) - x.T @ x, x.T @ a @ x
        values = np.diag(s) / (1 - np.diag(r))
        apart = values[None, :] - values[:, None]
        turn = s + values[None, :] * r
        close = np.abs(apart) <= 1e4 * np.maximum(np.abs(turn), np.abs(turn.T))  # too near each other for a small step: only made orthogonal
        x = x + x @ np.where(close, r / 2, turn / np.where(close, 1, apart))
    for _ in range(2):
        x = x + x @ (np.eye(len(a)) - x.T @ x) / 2
    order = np.argsort(-values, kind="stable")
    values, x = values[order], x[:, order]
    x = x / np.sqrt((x * x).sum(0)) * np.sign(x[np.abs(x).argmax(0), np.arange(len(a))])
    return (values * scale).astype(float), x.astype(float)


@dataclass
class Whitening:
    """n vectors with exact sums; components (columns) with eigenvalues, and the trace of their covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float

    def centre(self, x: np.ndarray) -> Wide:
        high, low = np.array([wide(Fraction(s, self.n)) for s in self.sums]).T
        a, b = two_sum(x.astype(float), -high)
        return two_sum(a, b - low)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n x - S)**2 by row, exact, None beyond a long."""
        largest = self.n * (np.abs(x).max(initial=0) + max(map(abs, self.sums)) // self.n + 1)
        if len(self.sums) * int(largest) ** 2 < 1 << 62:
            return ((self.n * x - np.array(self.sums)) ** 2).sum(1).tolist()
        out = ((self.n * x.astype(object) - np.array(self.sums, object)) ** 2).sum(1)
        return [v if v < 1 << 63 else None for v in out]


def fit(df: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """None if there is no vector, or no direction with variance."""
    n, sums = grid_sums(Tables(df.sparkSession, "whitening"), df, vector_col)
    if not n:
        return None
    size = len(sums)
    model = Whitening(n, sums, np.zeros((size, 0)), np.zeros(0), 0.0)

    def outer(batch: pa.RecordBatch) -> Wide | None:
        return next((outer_sum(model.centre(x)) for _, x in matrices(batch.column(0), size) if len(x)), None)

    covariance = square(wide_sum(_double(df, vector_col), outer), size) / n
    values, vectors = eigen(covariance)
    some = min(components, int((values > 8 * size * np.finfo(float).eps * values[0]).sum()))
    model.components, model.values, model.trace = vectors[:, :some], values[:some], float(np.trace(covariance))
    return model if some else None


def project(df: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, deviation, whitened (array by component) of every usable row."""
    to = model.components / np.sqrt(model.values)

    def run(batches):
        for batch in batches:
            for rows, x in matrices(batch.column(1), len(model.sums)):
                whitened = model.centre(x)[0] @ to
                edges = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * to.shape[1])
                columns = [batch.column(0).take(pa.array(rows)), pa.array(model.deviations(x), pa.int64()), pa.ListArray.from_arrays(edges, pa.array(whitened.ravel()))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "deviation", "whitened"])

    return df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def identity_error(whitened: DataFrame, n: int, size: int) -> float:
    """Largest distance of an entry of the covariance of ``whitened`` (arrays of one size) from the identity."""
    values = lambda batch: batch.column(0).flatten().to_numpy().reshape(-1, size)
    rows = whitened.select("whitened")
    sums = wide_sum(rows, lambda batch: add_rows((values(batch), np.zeros((batch.num_rows, size)))) if batch.num_rows else None)
    high, low = np.array([wide(exact(*x) / n) for x in zip(*sums)]).T

    def centred(batch: pa.RecordBatch) -> Wide:
        a, b = two_sum(values(batch), -high)
        return two_sum(a, b - low)

    covariance = square(wide_sum(rows, lambda batch: outer_sum(centred(batch)) if batch.num_rows else None), size) / n
    return float(np.abs(covariance - np.eye(size)).max())


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    model = fit(df, vector_col, components)
    if model is None:
        return df.sparkSession.createDataFrame([], OUT_SCHEMA)
    rows = Tables(df.sparkSession, "whitened").write(project(df, model, id_col, vector_col))
    error = identity_error(rows, model.n, len(model.values))
    explained = F.array(*(F.lit(float(v / model.trace)) for v in model.values))
    rows = rows.select("vec_id", F.posexplode("whitened").alias("at", "whitened"), "deviation")
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

"""Whitening of embeddings (operator 12).

Two passes over the vectors give exact whole-number sums: first counts and sums of each
dimension, then products of entries less the rounded mean of their dimension. The centred
covariance follows from them without rounding before the last division, so it depends neither
on partitioning nor on tasks run again. Its matrix, the only thing the driver sees, is of the
dimension's size: Householder reflections make it tridiagonal, Sturm counts bisect the leading
eigenvalues, inverse iteration gives their vectors, where close eigenvalues are made orthogonal
to each other again. The components go to the tasks as one small array.

An entry ``c`` counts as ``floor(scale * c) + shift``. Vectors that are null, empty, or hold null
or non-finite entries are left out, as are vectors of another length than the commonest (the
longest of several). Rows with null or repeated ids stay rows of their own; other columns are
ignored. Without vectors there are no rows. A component without variance (repeated rows only,
or fewer rows than dimensions) has null for ``whitened``, and components beyond the dimension do
not exist. Equal eigenvalues have some orthonormal basis of their space, the same for all rows.
Entries beyond 2**40 after scaling raise; so does a dimension over ``MOST_DIMENSIONS``.
``deviation`` is null where it does not fit 64 bits.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raremill.llm.tasks import map_rows

#: The driver holds matrices of this size squared.
MOST_DIMENSIONS = 1024
_MOST_ENTRY = float(1 << 40)
_EXACT = float(1 << 53)
_LONGEST = float((1 << 63) - 4096)
WHITE_SCHEMA = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


# --- vectors of a batch -----------------------------------------------------


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries as doubles (null as NaN), where each list starts, and its length (0 if null)."""
    if not pa.types.is_list(column.type):
        column = column.cast(pa.list_(column.type.value_type))
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    missing = column.is_null().to_numpy(zero_copy_only=False)
    return values, offsets[:-1], np.where(missing, 0, np.diff(offsets))


def whole_vectors(column: pa.Array, length: int, scale: float, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows that count, and their whole-number vectors."""
    values, starts, sizes = _lists(column)
    rows = np.nonzero(sizes == length)[0]
    found = values[starts[rows, None] + np.arange(length)] if length else np.empty((len(rows), 0))
    good = np.isfinite(found).all(axis=1) & (length > 0)
    rows, found = rows[good], np.floor(found[good] * scale)
    if found.size and np.abs(found).max() > _MOST_ENTRY:
        raise ValueError("entries beyond 2**40 after scaling cannot be summed exactly")
    return rows, found.astype(np.int64) + shift


def _sums_schema(kind: str) -> str:
    return f"{kind}, total decimal(38,0)"


def _exact(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


# --- sums -------------------------------------------------------------------


def _length_sums(vectors: DataFrame, scale: float, shift: int) -> DataFrame:
    """Per vector length and dimension (-1: the vectors themselves): exact totals."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            column = batch.column(0)
            lengths, dims, totals = [], [], []
            for length in np.unique(_lists(column)[2]):
                _, x = whole_vectors(column, int(length), scale, shift)
                if len(x):
                    lengths += [int(length)] * (length + 1)
                    dims += range(-1, int(length))
                    totals += [len(x), *x.sum(axis=0).tolist()]
            return pa.RecordBatch.from_arrays(
                [pa.array(lengths, pa.int32()), pa.array(dims, pa.int32()), _exact(totals)], ["size", "dim", "total"]
            )

        return step

    parts = map_rows(vectors, make, _sums_schema("size int, dim int"), rows=1024)
    return parts.groupBy("size", "dim").agg(F.sum("total").cast("decimal(38,0)").alias("total"))


def fit_sums(vectors: DataFrame, scale: float, shift: int) -> tuple[int, list[int]]:
    """Number of vectors of the commonest length and their sums (none: 0 and [])."""
    totals = _length_sums(vectors, scale, shift)
    sizes = totals.groupBy("size").agg(
        F.max(F.when(F.col("dim") == -1, F.col("total"))).alias("n"),
        F.array_sort(F.collect_list(F.when(F.col("dim") >= 0, F.struct("dim", "total")))).alias("sums"),
    )
    best = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    if best is None:
        return 0, []
    if best.size > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {best.size} dimensions; at most {MOST_DIMENSIONS} are whitened")
    return int(best.n), [int(s.total) for s in best.sums]


def _products(y: np.ndarray) -> np.ndarray:
    """Exact y.T @ y, by doubles in slices whose products and sums fit 53 bits."""
    top = float(np.abs(y).max(initial=1))
    total = np.zeros((y.shape[1], y.shape[1]), object)
    rows = int(_EXACT // (top * top))
    if rows == 0:
        whole = y.astype(object)
        return whole.T @ whole
    for at in range(0, len(y), rows):
        part = y[at : at + rows].astype(np.float64)
        total += (part.T @ part).astype(np.int64).astype(object)
    return total


def covariance(vectors: DataFrame, n: int, sums: list[int], scale: float, shift: int) -> np.ndarray:
    """Covariance with divisor ``n``, each entry correctly rounded but for the last division."""
    d = len(sums)
    middle = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    upper = np.triu_indices(d)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            _, x = whole_vectors(batch.column(0), d, scale, shift)
            if not len(x):
                return None
            total = _products(x - middle)[upper]
            return pa.RecordBatch.from_arrays(
                [pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), _exact(total)], ["i", "j", "total"]
            )

        return step

    parts = map_rows(vectors, make, _sums_schema("i int, j int"), rows=1024)
    cells = parts.groupBy("i", "j").agg(F.sum("total").cast("decimal(38,0)").alias("total"))
    # one row of d * (d + 1) / 2 numbers, d at most MOST_DIMENSIONS
    row = cells.agg(F.array_sort(F.collect_list(F.struct("i", "j", "total"))).alias("cells")).first()
    rest = [s - n * int(c) for s, c in zip(sums, middle, strict=True)]
    out = np.zeros((d, d))
    for cell in row.cells:
        out[cell.i, cell.j] = out[cell.j, cell.i] = (n * int(cell.total) - rest[cell.i] * rest[cell.j]) / (n * n)
    return out


# --- eigenvectors of a small symmetric matrix ---------------------------------


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and orthogonal q with q.T @ a @ q tridiagonal."""
    a, d = a.astype(np.float64).copy(), len(a)
    q = np.eye(d)
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        size = np.abs(v).max()
        if size == 0 or not np.any(v[1:]):
            continue
        v /= size
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        # a <- h a h with h = 1 - 2 v v', on the part that is left
        a[k + 1 :, k:] -= 2 * np.outer(v, v @ a[k + 1 :, k:])
        a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def sturm_count(main: np.ndarray, off: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix are below each of ``x``."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    least = max(tiny, np.finfo(float).eps ** 2 * float(np.abs(off).max(initial=0.0)))
    pivot = main[0] - x
    count = np.zeros(len(x), np.int64)
    for k in range(len(main)):
        if k:
            pivot = main[k] - x - off[k - 1] ** 2 / pivot
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        count += pivot < 0
    return count


def leading_eigenvalues(main: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues in falling order, bisected until doubles end."""
    d = len(main)
    edge = np.zeros(d)
    edge[1:] += np.abs(off)
    edge[:-1] += np.abs(off)
    reach = max(float(np.abs(main).max() + edge.max()), np.finfo(float).tiny)
    low, high = np.full(k, -2 * reach), np.full(k, 2 * reach)
    wanted = d - 1 - np.arange(k)  # the value with so many below it
    while True:
        middle = low + (high - low) / 2
        if np.all((middle <= low) | (middle >= high)) or np.all(high - low <= 1e-18 * reach):
            return middle
        above = sturm_count(main, off, middle) <= wanted
        low, high = np.where(above, middle, low), np.where(above, high, middle)


def _solve_shifted(main: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray, least: float) -> np.ndarray:
    """(T - shift) x = b by elimination with row exchanges."""
    d = len(main)
    diag, up, up2 = main - shift, np.append(off, 0.0), np.zeros(d)
    below, b = off.copy(), b.copy()
    for k in range(d - 1):
        if abs(below[k]) > abs(diag[k]):
            diag[k], below[k] = below[k], diag[k]
            up[k], diag[k + 1] = diag[k + 1], up[k]
            up2[k], up[k + 1] = up[k + 1], 0.0
            b[k], b[k + 1] = b[k + 1], b[k]
        if abs(diag[k]) < least:
            diag[k] = least
        factor = below[k] / diag[k]
        diag[k + 1] -= factor * up[k]
        up[k + 1] -= factor * up2[k]
        b[k + 1] -= factor * b[k]
    if abs(diag[-1]) < least:
        diag[-1] = least
    for k in range(d - 1, -1, -1):
        if k + 1 < d:
            b[k] -= up[k] * b[k + 1]
        if k + 2 < d:
            b[k] -= up2[k] * b[k + 2]
        b[k] /= diag[k]
        big = np.abs(b[k:]).max()
        if big > 1e150:
            b /= big
    return b


def leading_eigenpairs(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues in falling order and their unit vectors as rows, each
    with its largest entry positive."""
    d, k = len(a), min(k, len(a))
    if k == 0:
        return np.empty(0), np.empty((0, d))
    size = float(np.abs(a).max())
    if size == 0:
        return np.zeros(k), np.eye(d)[:k]
    main, off, q = tridiagonal(a / size)
    values = leading_eigenvalues(main, off, k)
    norm = max(float(np.abs(main).max()), float(np.abs(off).max(initial=0.0)))
    least, close = np.finfo(float).eps * norm, 1e-3 * norm
    draw, vectors, first = np.random.default_rng(12), np.empty((k, d)), 0
    for j in range(k):
        if j and values[j - 1] - values[j] > close:
            first = j  # a cluster starts here
        v = draw.standard_normal(d)
        for _ in range(6):
            v = _solve_shifted(main, off, values[j], v, least)
            v /= np.abs(v).max()
            for _ in range(2):
                v -= vectors[first:j].T @ (vectors[first:j] @ v)
            v /= np.linalg.norm(v)
        vectors[j] = v
    out = vectors @ q.T
    # one refinement in the full matrix keeps rows orthonormal to double precision
    out, _ = np.linalg.qr(out.T)
    out = out.T
    out *= np.sign(out[np.arange(k), np.abs(out).argmax(axis=1)])[:, None]
    return values * size, out


# --- projection ---------------------------------------------------------------


class Whitening:
    """What a fit found; small, and only arrays and numbers travel to the tasks."""

    def __init__(self, n, sums, values, vectors, trace, scale, shift):
        self.n, self.sums, self.scale, self.shift = n, sums, scale, shift
        self.values, self.vectors, self.trace = values, vectors, trace
        floor = len(sums) * np.finfo(float).eps * (values[0] if len(values) else 0.0)
        self.varies = values > max(floor, 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            root = np.where(self.varies, 1 / np.sqrt(np.where(self.varies, values, 1.0)), 0.0)
        self.scaled = vectors * root[:, None]


def fit(
    vectors: DataFrame, components: int = 8, scale: float = 1024.0, shift: int = 100_000, vector_col: str = "embedding"
) -> Whitening:
    """Sums, covariance and leading components of all vectors that count."""
    only = vectors.select(F.col(vector_col).alias("v"))
    n, sums = fit_sums(only, scale, shift)
    if n == 0:
        return Whitening(0, [], np.empty(0), np.empty((0, 0)), 0.0, scale, shift)
    found = covariance(only, n, sums, scale, shift)
    values, axes = leading_eigenpairs(found, components)
    return Whitening(n, sums, values, axes, float(np.trace(found)), scale, shift)


def _projector(model: Whitening):
    """A function of a list column: row numbers, n * x - sums, whitened values."""
    n, d, scale, shift = model.n, len(model.sums), model.scale, model.shift
    scaled = model.scaled
    if n * (_MOST_ENTRY + shift) < _LONGEST:
        sums = np.array(model.sums, np.int64)
    else:
        sums = np.array(model.sums, object)

    def project(column: pa.Array):
        rows, x = whole_vectors(column, d, scale, shift)
        off = n * x.astype(sums.dtype) - sums
        return rows, off, (off.astype(np.float64) / n) @ scaled.T

    return project


def identity_error(vectors: DataFrame, model: Whitening, vector_col: str = "embedding") -> float | None:
    """Largest absolute entry of the whitened vectors' covariance less the identity, over the
    components that vary; None without any."""
    k, varies = len(model.values), model.varies
    if not varies.any():
        return None
    project = _projector(model)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            rows, _, white = project(batch.column(0))
            if not len(rows):
                return None
            lead = np.hstack([np.ones((len(white), 1)), white])
            total = lead.T @ lead
            at = np.indices(total.shape).reshape(2, -1)
            return pa.RecordBatch.from_arrays(
                [pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(total.ravel())], ["i", "j", "total"]
            )

        return step

    parts = map_rows(vectors.select(F.col(vector_col).alias("v")), make, "i int, j int, total double", rows=1024)
    cells = parts.groupBy("i", "j").agg(F.sum("total").alias("total"))
    row = cells.agg(F.array_sort(F.collect_list(F.struct("i", "j", "total"))).alias("cells")).first()
    total = np.zeros((k + 1, k + 1))
    for cell in row.cells:
        total[cell.i, cell.j] = cell.total
    # the vectors were centred before; what is left of their mean is rounding
    mean = total[0, 1:] / model.n
    found = total[1:, 1:] / model.n - np.outer(mean, mean)
    return float(np.abs(found - np.eye(k))[np.ix_(varies, varies)].max())


def whiten(
    vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """A row for each vector that counts and each component."""
    n, k = model.n, len(model.values)
    project, error, varies = _projector(model), identity_error(vectors, model, vector_col), model.varies
    shares = [float(v) / model.trace if model.trace > 0 else None for v in model.values]

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            rows, off, white = project(batch.column(1))
            if not len(rows) or not k:
                return None
            rough = (off.astype(np.float64) ** 2).sum(axis=1)
            kept = rough < _LONGEST
            exact = (np.where(kept[:, None], off, 0) ** 2).sum(axis=1).astype(np.int64)
            m = len(rows)
            tall = lambda values: np.repeat(values, k)
            ids = batch.column(0).take(pa.array(tall(rows)))
            return pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    pa.array(np.full(m * k, n), pa.int64()),
                    pa.array(tall(exact), pa.int64(), mask=~tall(kept)),
                    pa.array(white.ravel(), pa.float64(), mask=np.tile(~varies, m)),
                    pa.array(shares * m, pa.float64()),
                    pa.array([error] * (m * k), pa.float64()),
                ],
                WHITE_NAMES,
            )

        return step

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    return map_rows(rows, make, WHITE_SCHEMA)


WHITE_NAMES = [part.split()[0] for part in WHITE_SCHEMA.split(", ")]


def whitened(
    vectors: DataFrame,
    components: int = 8,
    scale: float = 1024.0,
    shift: int = 100_000,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Fit on all vectors and whiten each of them."""
    model = fit(vectors, components, scale, shift, vector_col)
    return whiten(vectors, model, id_col, vector_col)

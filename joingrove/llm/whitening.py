"""Whitening of embeddings by eigenvectors found in single precision and refined by matrix products.

Sums and the centred covariance come from passes over the vectors in which each task adds up a matrix of its own;
only matrices meet. The covariance's eigenvectors are computed in float32 and corrected by the iteration of Ogita
and Aishima: products with the matrix, in extended precision, tell how far the columns are from orthonormal and
from diagonalising it, and give the correction, whose error is squared in each step. Eigenvalues that lie closer
than the step can tell apart are settled by an eigenproblem of their own within the space they span.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joingrove.llm.common import ship

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Entries beyond are taken as this large, so that sums of squares stay finite.
LARGEST = 1 << 40
STEPS = 10
#: How much farther apart than the step's error bound eigenvalues must lie for it to part them: the square of a
#: correction is what a step gets wrong.
CAREFUL = 1000
#: Vectors multiplied at once.
BLOCK = 4096
HIGH = np.longdouble


# ---------------------------------------------------------------- eigenvectors

def refined_eigenvectors(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, as doubles."""
    a = np.asarray(matrix, HIGH)
    n = len(a)
    scale = np.abs(a).max(initial=0)
    if not n or not scale > 0:
        return np.zeros(n), np.eye(n)
    a = a / scale
    _, x = np.linalg.eigh(a.astype(np.float32))
    x = x.astype(HIGH)
    # float32 columns are orthonormal to about 1e-6; the iteration needs no more
    for _ in range(STEPS):
        x, change = _step(a, x)
        if change < 1e-17:
            break
    values = (x * (a @ x)).sum(0) / (x * x).sum(0)
    order = np.argsort(-values, kind="stable")
    return (values[order] * scale).astype(float), x[:, order].astype(float)


def _step(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float]:
    """The columns after one correction, and its largest entry (of a cluster: what was off its diagonal)."""
    n = len(a)
    r = np.eye(n, dtype=HIGH) - x.T @ x
    s = x.T @ (a @ x)
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(values)
    near = CAREFUL * 2 * (_norm(off) + _norm(a) * _norm(r))  # values closer than this cannot be told apart yet
    gap = values[None, :] - values[:, None]
    apart = np.abs(gap) > near
    e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
    x = x + x @ e
    x = x + x @ ((np.eye(n, dtype=HIGH) - x.T @ x) / 2)  # what the square of a large correction has bent
    change = float(np.abs(e).max())
    for cluster in _clusters(values, near):
        x[:, cluster], turned = _settled(a, x[:, cluster])
        change = max(change, turned)
    return x, change


def _norm(m: np.ndarray) -> float:
    """A bound of the spectral norm of a symmetric matrix."""
    return float(np.sqrt((m * m).sum()))


def _clusters(values: np.ndarray, near: float) -> list[np.ndarray]:
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order]) > near) + 1
    return [c for c in np.split(order, cuts) if len(c) > 1]


def _settled(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float]:
    """The columns of a cluster turned within their space so that they diagonalise it.

    The common part of the eigenvalues is taken off first, so the small differences have all the digits of a double.
    """
    q = x + x @ ((np.eye(x.shape[1], dtype=HIGH) - x.T @ x) / 2)
    t = q.T @ (a @ q)
    t = (t + t.T) / 2
    centre = np.trace(t) / len(t)
    rest = t - centre * np.eye(len(t), dtype=HIGH)
    size = np.abs(rest).max()
    off = float(np.abs(rest - np.diag(np.diag(rest))).max())
    if size < 1e-18 or off < 1e-19:
        return q, 0.0  # equal to the last digit: any basis will do
    _, turn = np.linalg.eigh((rest / size).astype(float))
    turn = turn.astype(HIGH)
    turn = turn + turn @ ((np.eye(len(t), dtype=HIGH) - turn.T @ turn) / 2)
    return q @ turn, off


# ---------------------------------------------------------------- passes over the vectors

def _passes(vectors: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """mapInArrow of `fn`, which gets an iterator of (ids, list array) and yields dictionaries of columns."""
    ship(vectors.sparkSession)
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "array<long>": pa.list_(pa.int64())}
    arrow = pa.schema([pa.field(n, kinds[k]) for n, k in (c.split() for c in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn((b.column(0), b.column(1)) for b in batches):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return vectors.mapInArrow(run, schema)


def _scaled(vectors: pa.ListArray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are whole and have `dims` entries, and these as longs, a row each."""
    sizes = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    right = np.flatnonzero(sizes == dims)
    flat = vectors.take(pa.array(right)).flatten()  # nulls within become NaN
    c = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dims)
    whole = np.isfinite(c).all(1)
    return right[whole], np.clip(np.floor(c[whole] * SCALE), -LARGEST, LARGEST).astype(np.int64) + SHIFT


def _sums(vectors: DataFrame) -> tuple[int, int, list[int]]:
    """Number of entries of a vector, number of vectors, sum of each entry; exact."""
    def run(batches: Iterator[tuple]) -> Iterator[dict]:
        total: dict[int, np.ndarray] = {}
        for _, vectors in batches:
            for dims in {d for d in vectors.value_lengths().drop_null().unique().to_pylist() if d}:
                _, x = _scaled(vectors, dims)
                total[dims] = total.get(dims, 0) + np.concatenate([[len(x)], x.sum(0)])
        for dims, s in total.items():
            yield {"dims": [dims] * len(s), "i": list(range(len(s))), "s": s.tolist()}

    sums = _passes(vectors, run, "dims int, i int, s long").groupBy("dims", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    counts = sums.where("i = 0").orderBy(F.col("s").desc(), F.col("dims").desc())
    most = counts.first()
    if most is None or not most["s"]:
        return 0, 0, []
    s = {r["i"]: int(r["s"]) for r in sums.where(F.col("dims") == most["dims"]).collect()}
    return most["dims"], s[0], [s[i] for i in range(1, most["dims"] + 1)]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sum / n as doubles: whole parts are taken off as integers, so nothing is lost to the size of x."""
    whole = np.array([s // n for s in sums], np.int64)
    return (x - whole) - np.array([(s % n) / n for s in sums])


def _products(vectors: DataFrame, dims: int, width: int, rows_of: Callable[[pa.ListArray], np.ndarray]) -> np.ndarray:
    """The sum of the outer products of the rows that `rows_of` makes of a batch: a matrix (width, width)."""
    def run(batches: Iterator[tuple]) -> Iterator[dict]:
        total = np.zeros((width, width))
        for _, vectors in batches:
            z = rows_of(vectors)
            for i in range(0, len(z), BLOCK):
                total += z[i:i + BLOCK].T @ z[i:i + BLOCK]
        yield {"i": list(range(width)), "row": total.tolist()}

    added = (_passes(vectors, run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
             .groupBy("i", "j").agg(F.sum("v").alias("v")))
    out = np.zeros((width, width))
    for r in added.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("row")).collect():
        out[r["i"]] = [v["v"] for v in r["row"]]
    return (out + out.T) / 2


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: `components` rows (or one a dimension) per vector.

    Vectors that are null, empty or hold nulls or non-finite entries are left out, and so are those of another number of
    entries than most have (of two as frequent, the larger). Repeated rows and null ids are rows like others; an empty
    table gives no rows. deviation is null where it exceeds a long. A component whose eigenvalue is 0 up to rounding (the
    vectors do not vary along it) has a null whitened value and does not count in identity_error. Entries beyond
    LARGEST / SCALE in size count as that large. Other columns are not read.

    The table is read four times; what meets are matrices of the number of entries squared, one a task, and nothing
    that comes to the driver grows with the rows.
    """
    vectors = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    dims, n, sums = _sums(vectors)
    if not n:
        return embeddings.sparkSession.createDataFrame([], WHITENED)
    covariance = _products(vectors, dims, dims, lambda v: _centred(_scaled(v, dims)[1], n, sums)) / n
    values, axes = refined_eigenvectors(covariance)
    trace, kept = float(np.trace(covariance)), min(components, dims)
    values, axes = values[:kept], axes[:, :kept]
    real = values > dims * np.finfo(float).eps * max(values[0], 0)
    project = np.where(real, axes / np.sqrt(np.where(real, values, 1)), 0)
    explained = (values / trace if trace else values).tolist()

    gram = _products(vectors, dims, kept, lambda v: _centred(_scaled(v, dims)[1], n, sums) @ project) / n
    error = float(np.abs(gram - np.eye(kept))[np.ix_(real, real)].max(initial=0))

    def run(batches: Iterator[tuple]) -> Iterator[dict]:
        number = list(range(1, kept + 1))
        for ids, found in batches:
            for i in range(0, len(found), BLOCK):
                at, x = _scaled(found.slice(i, BLOCK), dims)
                mine = ids.slice(i, BLOCK).take(pa.array(at)).to_pylist()
                w = _centred(x, n, sums) @ project
                yield {"vec_id": [k for k in mine for _ in number], "component": number * len(x), "n": [n] * len(x) * kept,
                       "deviation": [d for d in _deviations(x, n, sums) for _ in number],
                       "whitened": [v if r else None for row in w.tolist() for v, r in zip(row, real)],
                       "explained": explained * len(x), "identity_error": [error] * len(x) * kept}

    return _passes(vectors, run, WHITENED)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Of each row the sum of (n x - sum)^2, exact; None where it exceeds a long."""
    rough = ((_centred(x, n, sums) * n) ** 2).sum(1)
    exact = np.zeros(len(x), object)
    small = rough < 2.0 ** 62
    s = np.array(sums, object)
    fits = max(map(abs, sums)) < 1 << 62 and n * (int(np.abs(x).max(initial=0)) + 1) < 1 << 62
    if fits:
        d = x[small] * n - np.array(sums, np.int64)
        exact[small] = (d * d).sum(1)
        small = ~small
    else:
        small[:] = True
    for i in np.flatnonzero(small):
        exact[i] = int(((x[i].astype(object) * n - s) ** 2).sum())
    return [int(d) if d < 1 << 63 else None for d in exact]

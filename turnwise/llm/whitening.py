"""Whitening of integer vectors by their leading principal components, without ever forming the covariance matrix.

One pass sums up n and each dimension exactly.  Then block subspace iteration: from an orthonormal block Q each pass over the rows computes
Xᵀ(XQ) / n on rows centred in integers (n * x - S, then divided by n); only a table of dimensions x block width is summed up.  A Rayleigh-Ritz step
turns the block to its best approximations, a component is certified when its residual is small against its gap to the others (or is
rounding), and the product, orthonormalised by QR, is the next block.  Residuals shrink by the ratio of the eigenvalue beyond the
block to the component's; if that foretells many passes, the block is doubled by random directions, up to the number of dimensions,
where one pass is enough.  A last pass measures the covariance of the whitened rows.

Scale: a pass reads rows once and shuffles (dimensions x block width) sums of each task; the driver holds matrices of dimensions x dimensions at most
and no rows.  Rows are written once as integers to the shared folder, so a lost executor repeats one pass over a part.

Defined results: vectors that are null or hold null or non-finite components take no part; all others must have one length (else an
error names the lengths); a null id stays null; repeated rows each count and each return; components of equal eigenvalues are any
basis of their space; only components whose variance isn't zero are returned, so equal vectors alone, or one vector,
give no rows, as does an empty table; other columns are not read.  The sign makes a component's largest entry positive.
deviation is null where it exceeds 64 bits; n * x must fit 62 bits (else an error).
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, prepare, table
from .topk import usable

COMPONENTS = 8
#: Width of the first block, in components, and the passes from which a wider block is cheaper.
WIDTH = 4
MANY = 6
PASSES = 100
#: A component's angle to its eigenvector, as certified by its residual and gap, unless the residual is rounding.
ANGLE = 1e-13
SEED = 20


def as_integers(vector: str, scale: int = 1024, offset: int = 100_000):
    """floor(scale * c) + offset of every component, as long."""
    return F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * scale).cast("long") + F.lit(offset).cast("long"))


def matrix(batch: pa.RecordBatch, name: str, dim: int) -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), dim)


def _summed(rows: DataFrame, dim: int, cells: int, f: Callable[[np.ndarray], np.ndarray], kind: str, exact: str) -> np.ndarray:
    """Sums of f(rows as a matrix), a vector of ``cells`` numbers, over all rows: added up in tasks, then by cell."""
    arrow = {"long": pa.int64(), "double": pa.float64()}[kind]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            if b.num_rows:
                total = total + f(matrix(b, "x", dim))
        if not isinstance(total, int):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells)), pa.array(total, arrow)], names=["cell", "value"])

    parts = rows.select("x").mapInArrow(add, f"cell long, value {kind}").groupBy("cell").agg(F.sum(F.col("value").cast(exact)).alias("value"))
    out = np.zeros(cells, object if kind == "long" else np.float64)
    for r in parts.collect():
        out[r.cell] = int(r.value) if kind == "long" else r.value
    return out


@dataclass(frozen=True)
class Whitening:
    """The fit: exact n and sums, unit components as columns by falling eigenvalue, the trace, and how they were found."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    passes: int
    width: int

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.n * x - self.sums) / self.n

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2, exact."""
        d = self.n * x - self.sums
        if float(np.abs(d).max(initial=0)) ** 2 * max(1, d.shape[1]) < 2.0**62:
            return (d * d).sum(1).tolist()
        return [v if (v := sum(a * a for a in row)) < 2**63 else None for row in d.tolist()]


def fit(rows: DataFrame, k: int = COMPONENTS) -> Whitening:
    """rows: (x array<long>), all of one length, read once for each pass."""
    shape = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most"), F.max(F.greatest(F.abs(F.array_min("x")), F.abs(F.array_max("x")))).alias("largest")).first()
    n, dim = shape.n, shape.most or 0
    if n and shape.least != shape.most:
        raise ValueError(f"vectors have {shape.least} to {shape.most} components: whitening needs one length")
    if not n or not dim:
        return Whitening(n, np.zeros(dim, np.int64), np.zeros((dim, 0)), np.zeros(0), 0.0, 0, 0)
    if 2 * n * shape.largest >= 2**62:
        raise ValueError(f"{n} rows with components up to {shape.largest} go beyond 64 bits")
    sums = _summed(rows, dim, dim, lambda x: x.sum(0), "long", "decimal(38,0)").astype(np.int64)

    def multiply(q: np.ndarray) -> tuple[np.ndarray, float]:
        """Covariance times q, and the covariance's trace, in one pass."""
        width = q.shape[1]

        def part(x: np.ndarray) -> np.ndarray:
            c = (n * x - sums) / n
            return np.append((c.T @ (c @ q)).ravel(), (c * c).sum())

        got = _summed(rows, dim, dim * width + 1, part, "double", "double") / n
        return got[:-1].reshape(dim, width), float(got[-1])

    return Whitening(n, sums, *subspace_iteration(multiply, dim, min(k, dim)))


def subspace_iteration(multiply: Callable[[np.ndarray], tuple[np.ndarray, float]], dim: int, k: int):
    """(components, eigenvalues, trace, passes, width of the last block) of a symmetric matrix that is known by its products."""
    rng = np.random.default_rng(SEED)
    width = min(dim, WIDTH * k)
    q = np.linalg.qr(rng.standard_normal((dim, width)))[0]
    for passes in range(1, PASSES + 1):
        z, trace = multiply(q)
        h = q.T @ z
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors, images = q @ turn, z @ turn
        residuals = np.linalg.norm(images[:, :k] - vectors[:, :k] * values[:k], axis=0)
        apart = np.abs(values[:k, None] - values[None, :])
        apart[np.arange(k), np.arange(k)] = np.inf
        gaps = np.where(np.isfinite(apart.min(1)), apart.min(1), 0.0)
        rounding = dim * np.finfo(float).eps * max(values[0], 0.0)
        allowed = np.maximum(ANGLE * gaps, rounding)
        if (residuals <= allowed).all():
            kept = values[:k] > max(rounding, dim * np.finfo(float).eps * trace)
            found = vectors[:, :k][:, kept]
            signs = np.sign(found[np.abs(found).argmax(0), np.arange(found.shape[1])])
            return found * signs, values[:k][kept], trace, passes, width
        grow = []
        if passes > 1 and width < dim:  # the first block is random and tells nothing
            rate = values[-1] / values[k - 1] if values[k - 1] > 0 else 0.0
            left = np.log((residuals / np.maximum(allowed, 1e-300)).max()) / -np.log(min(max(rate, 1e-6), 1 - 1e-12))
            if left > MANY:
                grow = [rng.standard_normal((dim, min(width, dim - width)))]
        q = np.linalg.qr(np.hstack([images / max(values[0], 1e-300), *grow]))[0]
        width = q.shape[1]
    raise ArithmeticError(f"residuals {residuals} after {PASSES} passes")


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the covariance of the whitened rows minus the identity, measured over all rows."""
    k = len(model.values)
    if not k:
        return 0.0

    def part(x: np.ndarray) -> np.ndarray:
        w = model.project(x)
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])

    got = _summed(rows, len(model.sums), k + k * k, part, "double", "double") / model.n
    return float(np.abs(got[k:].reshape(k, k) - np.outer(got[:k], got[:k]) - np.eye(k)).max())


def whiten(rows: DataFrame, model: Whitening, error: float) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of rows (vec_id long, x array<long>)."""
    k, dim, explained = len(model.values), len(model.sums), model.values / model.trace if model.trace else model.values
    out = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not k or not b.num_rows:
                continue
            x, m = matrix(b, "x", dim), b.num_rows
            ids = b.column("vec_id").take(pa.array(np.repeat(np.arange(m), k)))
            deviation = pa.array(model.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
            columns = [ids, np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, model.n), deviation, model.project(x).ravel(), np.tile(explained, m), np.full(m * k, error)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=out)

    return rows.select("vec_id", "x").mapInArrow(project, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op12_subspace_whitening(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    own = table(spark, sf_dir, "embeddings").filter(usable("embedding"))
    rows = cut(own.select(F.col("vec_id").cast("long").alias("vec_id"), as_integers("embedding").alias("x")), "whitening-rows")
    model = fit(rows)
    return whiten(rows, model, identity_error(rows, model))

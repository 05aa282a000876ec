"""Whitening of embeddings by shifted CholeskyQR.

An entry c becomes the integer x = floor(1024 c) + 100000.  The fit list is every
vector without nulls and non-finite entries; its n and per-dimension sums S are exact
integers, so a row is centred exactly, as (n x - S) / n, before anything is multiplied.

The centred rows A are orthogonalised by Gram passes over the table.  A pass gives
Q'Q of the rows Q orthogonalised so far, each row by triangular solves with the factors
found so far: tasks add up their own matrices of d x d numbers, and a shuffle adds those
cell by cell.  The driver takes the Cholesky factor of that d x d matrix (of the first
one after adding a shift a little above its rounding error, so that it exists for any table),
multiplies it onto R, and sends it out with the next pass, until Q'Q is the identity to
rounding.  Directions that have no length after the shifted pass are left out from there.
No pass squares the condition number again: R is as exact as a QR of the table itself, and
the singular value decomposition of R (d x d) gives the components, its singular values s
the eigenvalues s^2 / n.

What is sent to tasks and driver is d^2 numbers, d being the length of a vector,
however many rows there are; rows are only read, never moved.

Null vectors, vectors with a null, NaN or infinite entry, empty vectors, and vectors
whose length is not the commonest one (the longer on a tie) are dropped.  Scaled
entries beyond 2^52 take that value.  A component without variance (all
rows alike, fewer rows than dimensions) has whitened and explained 0 and stands
outside the identity error.  ``deviation`` is null where it is above 2^63 - 1.
Repeated rows count each, null ids stay, other columns are ignored, and an empty
table gives no rows.  Each component's largest entry is positive.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.llm.common import table

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: Gram passes at most; three do for a table of full rank.
PASSES = 8
#: Rows of a block of dense arithmetic.
_ROWS = 4096
_EPS = float(np.finfo(float).eps)
_EDGE = float(1 << 52)


class Fit(NamedTuple):
    n: int
    sums: list[int]  # exact
    eigenvalues: np.ndarray  # falling
    vectors: np.ndarray  # a column for each component
    trace: float


def usable(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, vector) of rows whose vector has the commonest length; nulls and entries
    that are not finite are left out block by block as vectors are read."""
    fine = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    given = df.select("vec_id", F.col(vector).alias("vector"))
    rows = given.filter(F.size("vector") > 0)
    sizes = rows.filter(fine).groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.filter(F.size("vector") == (sizes.d if sizes else 0))


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch, places of its usable rows, their integers x), at most ``_ROWS`` rows at a time."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("vector"))
        entries = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
        for lo in range(0, len(entries), _ROWS):
            part = entries[lo : lo + _ROWS]
            fine = np.flatnonzero(np.isfinite(part).all(axis=1))
            x = np.clip(np.floor(part[fine] * SCALE), -_EDGE, _EDGE).astype(np.int64) + OFFSET
            yield batch, lo + fine, x


def _centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(n x - S exactly, and divided by n)."""
    limit = (1 << 62) // max(n, 1)
    if max(map(abs, sums)) < 1 << 62 and (not x.size or max(int(x.max()), -int(x.min())) < limit):
        off = x * n - np.array(sums, dtype=np.int64)
    else:
        off = x.astype(object) * n - np.array(sums, dtype=object)
    return off, off.astype(float) / n


def exact_sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """(n, sum of x in each dimension); the sums are added as decimals of 38 digits."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * d, 0
        for _, _, x in _blocks(batches, d):
            low = (x & 0xFFFFFFFF).sum(axis=0)
            high = (x >> 32).sum(axis=0)
            total = [t + (int(h) << 32) + int(lo) for t, h, lo in zip(total, high, low, strict=True)]
            n += len(x)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(map(str, total), pa.string())], ["k", "n", "s"]
        )

    parts = rows.select("vector").mapInArrow(add, "k int, n bigint, s string")
    found = parts.groupBy("k").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("k").collect()
    return found[0].n, [int(r.s) for r in found]


class Step(NamedTuple):
    """Rows q become the solution of x ``matrix`` = q, or q ``matrix`` if not ``solve``."""

    matrix: np.ndarray
    solve: bool


def _advance(q: np.ndarray, steps: list[Step]) -> np.ndarray:
    """Solves with an upper triangle go forward, a column at a time for all rows."""
    for step in steps:
        if not step.solve:
            q = q @ step.matrix
            continue
        r, out = step.matrix, np.empty_like(q)
        for j in range(len(r)):
            out[:, j] = (q[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
        q = out
    return q


def gram(rows: DataFrame, n: int, sums: list[int], steps: list[Step]) -> np.ndarray:
    """Q'Q for the rows Q that ``steps`` make of the centred rows."""
    d = len(sums)
    width = steps[-1].matrix.shape[1] if steps else d

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for _, _, x in _blocks(batches, d):
            q = _advance(_centred(x, n, sums)[1], steps)
            total += q.T @ q
        yield pa.RecordBatch.from_arrays([pa.array(range(width * width), pa.int32()), pa.array(total.ravel())], ["k", "v"])

    cells = rows.select("vector").mapInArrow(add, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(width * width)
    for cell in cells:
        out[cell.k] = cell.v
    return out.reshape(width, width)


def _shifted_factor(g: np.ndarray, n: int) -> np.ndarray:
    """Upper R with R'R = g plus a shift that covers the rounding of blocked sums."""
    d = len(g)
    shift = 11 * (min(n, _ROWS) * d + d * (d + 1)) * _EPS / 2 * float(np.linalg.eigvalsh(g)[-1])
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift *= 10


def shifted_cholesky_qr(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R (rank x d) of the centred rows: R'R is their Gram matrix."""
    g = gram(rows, n, sums, [])
    lengths = np.sqrt(np.diag(g))
    if not lengths.max() > 0:
        return np.zeros((0, len(g)))
    scale = np.where(lengths > 0, lengths, 1.0)  # columns of length 1 first: entries of any size are alike
    r = _shifted_factor(g / scale[:, None] / scale[None, :], n)
    steps = [Step(np.diag(1 / scale), False), Step(r, True)]
    for turn in range(PASSES):
        g = gram(rows, n, sums, steps)
        if np.abs(g - np.eye(len(g))).max() < 8 * len(g) * _EPS:
            break
        if turn == 0:  # directions that the first, shifted factor leaves without any length have no variance
            size, basis = np.linalg.eigh(g)
            basis = basis[:, size > 16 * len(g) * _EPS * size[-1]]
            if basis.shape[1] < len(g):
                steps.append(Step(basis, False))
                g, r = basis.T @ g @ basis, basis.T @ r
        try:
            factor = np.linalg.cholesky(g).T
        except np.linalg.LinAlgError:
            factor = _shifted_factor(g, n)
        steps.append(Step(factor, True))
        r = factor @ r
    return r * scale[None, :]


def fit(rows: DataFrame) -> Fit | None:
    """Components of the rows that :func:`usable` gives; None without any row."""
    first = rows.select(F.size("vector").alias("d")).first()
    n, sums = exact_sums(rows, first.d) if first else (0, [])
    if not n:
        return None
    _, found, vt = np.linalg.svd(shifted_cholesky_qr(rows, n, sums))
    s = np.zeros(len(vt))
    s[: len(found)] = found
    largest = np.abs(vt).argmax(axis=1)
    vt = vt * np.where(vt[np.arange(len(vt)), largest] < 0, -1.0, 1.0)[:, None]
    return Fit(n, sums, s * s / n, vt.T, float((s * s).sum() / n))


def whiten(rows: DataFrame, found: Fit, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained) of each row and component."""
    n, sums, d = found.n, found.sums, len(found.sums)
    k = min(components, d)
    right = projection(found, k)
    explained = found.eigenvalues[:k] / found.trace if found.trace > 0 else np.zeros(k)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, places, x in _blocks(batches, d):
            if len(x):
                off, centred = _centred(x, n, sums)
                if off.dtype != object and float(np.abs(off).max(initial=0)) ** 2 * d < 2.0**62:
                    deviation = pa.array((off * off).sum(axis=1), pa.int64())
                else:
                    exact = [sum(int(v) ** 2 for v in row) for row in off.tolist()]
                    deviation = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
                rows_of = np.repeat(np.arange(len(x)), k)
                ids = batch.column(batch.schema.get_field_index("vec_id")).take(pa.array(places[rows_of]))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(x) * k, n, dtype=np.int64)),
                        deviation.take(pa.array(rows_of)),
                        pa.array((centred @ right).ravel()),
                        pa.array(np.tile(explained, len(x))),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained"],
                )

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(
        project, f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double"
    )


def projection(found: Fit, k: int) -> np.ndarray:
    """d x k: components over the square roots of their eigenvalues; 0 without variance."""
    e = found.eigenvalues[:k]
    return found.vectors[:, :k] * np.where(e > 0, 1 / np.sqrt(np.where(e > 0, e, 1.0)), 0.0)


def identity_error(rows: DataFrame, found: Fit, components: int = COMPONENTS) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, by a
    pass over the table."""
    k = int((found.eigenvalues[:components] > 0).sum())
    if not k:
        return 0.0
    return float(np.abs(gram(rows, found.n, found.sums, [Step(projection(found, k), False)]) / found.n - np.eye(k)).max())


def op12_embedding_whitening(spark: SparkSession, sf: str) -> DataFrame:
    rows = usable(table(spark, sf, "embeddings"))
    found = fit(rows)
    if found is None:
        empty = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
        return spark.createDataFrame([], empty)
    return whiten(rows, found).withColumn("identity_error", F.lit(identity_error(rows, found)))

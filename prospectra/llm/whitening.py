"""Whitening of embeddings: covariance by one aggregation over all pairs of dimensions, components by LAPACK."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

COMPONENTS = 16
#: Entries become whole numbers of this many steps a unit, moved by OFFSET.
SCALE = 64
OFFSET = 1_000_000
#: Whole numbers up to here are exact as double; entries beyond it stop there.
_EXACT = 1 << 53
#: Eigenvalues at or below this share of the largest are rounding errors of zero.
_ZERO = 1e-12


def quantised(vectors: DataFrame, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(vec_id, x): the entries of each usable vector as long, floor(scale * entry) + offset.

    Vectors that are null, empty or hold a null, a NaN or an infinity are dropped. So are those of another length than
    most vectors have (the shorter length on a tie).
    """
    entry = lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(float(_EXACT))), F.lit(float(-_EXACT)))) + offset
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    sound = vectors.select("vec_id", "embedding").where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(F.forall("embedding", finite))
    length = sound.groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").first()
    return sound.where(F.size("embedding") == (length["dims"] if length else 0)).select("vec_id", F.transform("embedding", entry).alias("x"))


def column_covariance(rows: DataFrame, columns: list[Column], centres: list[float]) -> np.ndarray:
    """Covariance (divisor n) of the numeric ``columns`` over ``rows``, from products of values minus ``centres``.

    One aggregation holds the count, the sums and the products of every pair of the upper triangle, so each task sends
    one row, whatever the number of rows. Centres near the means keep the products small; what they are off by is
    taken out of the products exactly as it went in.
    """
    d = len(columns)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    moved = rows.select(*((c.cast("double") - F.lit(m)).alias(f"c{i}") for i, (c, m) in enumerate(zip(columns, centres))))
    sums = [f"sum(c{i})" for i in range(d)]
    products = [f"sum(c{i} * c{j})" for i, j in pairs]
    got = list(moved.selectExpr("count(*)", *sums, *products).first())
    if not got[0]:
        return np.zeros((d, d))
    n, off = got[0], np.array(got[1 : d + 1], np.float64) / got[0]
    out = np.zeros((d, d))
    for (i, j), total in zip(pairs, got[d + 1 :]):
        out[i, j] = out[j, i] = total / n - off[i] * off[j]
    return out


def principal_components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as rows; each vector's greatest entry is positive.

    Eigenvalues that are zero up to rounding have no whitened form and are left out.
    """
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:most], vectors.T[::-1][:most]
    sound = values > _ZERO * max(values[:1].max(initial=0.0), 0.0)
    values, vectors = values[sound], vectors[sound]
    signs = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])
    return values, vectors * signs[:, None]


def exact_deviation(moved: np.ndarray, n: int, part: np.ndarray) -> pa.Array:
    """Sum over dimensions of (n * y + r)**2 for each row y of ``moved`` and the whole numbers r of ``part``, exactly; null beyond 38 digits."""
    if moved.size and (np.abs(moved).max() >= 1 << 26 or n >= 1 << 30):
        moved = moved.astype(object)
        linear = (moved * part).sum(axis=1)
    else:
        linear = (moved * part.astype(np.int64)).sum(axis=1)
    squares, fixed = (moved * moved).sum(axis=1), int((part * part).sum())
    totals = [n * n * s + 2 * n * t + fixed for s, t in zip(squares.tolist(), linear.tolist())]
    return pa.array([Decimal(v) if v < 10**38 else None for v in totals], pa.decimal128(38, 0))


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, x, deviation, whitened, n, eigenvalues, trace and identity_error for each usable row of ``vectors``.

    The fit list is each distinct quantised vector once. Means and products come from two aggregations over it; the
    driver gets one row of each, whose width is set by the dimensions. ``whitened`` holds one value per component:
    x minus the mean, projected, over the root of the eigenvalue. ``deviation`` is exact, null beyond 38 digits.
    ``identity_error`` measures the covariance of those very values over the fit list by another such aggregation.

    Unusable vectors (see ``quantised``) get no row; null and repeated ids and repeated rows keep one each. If all
    vectors are equal there is no component and ``whitened`` is empty. An empty table gives no rows. Other columns aren't read.
    """
    usable = quantised(vectors)
    fit = cut(usable.select("x").distinct())
    width = fit.select(F.size("x").alias("d")).first()
    d = width["d"] if width else 0
    entry = [F.col("x")[i] for i in range(d)]
    # exact sums of the upper and the lower 26 bits: no long runs over below 2**36 rows
    parts = [F.sum(part) for c in entry for part in (F.shiftright(c, 26), c.bitwiseAND((1 << 26) - 1))]
    n, *got = fit.agg(F.count("*"), *parts).first()
    sums = [(high << 26) + low for high, low in zip(got[::2], got[1::2])] if n else []
    centres = [round(Fraction(s, n)) for s in sums]
    off = [n * m - s for s, m in zip(sums, centres)]
    covariance = column_covariance(fit, entry, [float(m) for m in centres]) if n else np.zeros((0, 0))
    values, axes = principal_components(covariance, components) if n else (np.zeros(0), np.zeros((0, 0)))
    projection = (axes / np.sqrt(values)[:, None]).T if len(values) else np.zeros((d, 0))
    k, whole, part = len(values), np.array(centres, np.int64), np.array(off, object)
    rest = np.array([r / n for r in off], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d)
            moved = x - whole
            made = (moved.astype(np.float64) + rest) @ projection
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * k, pa.int32()), pa.array(made.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, exact_deviation(moved, n, part)], names=[*batch.schema.names, "whitened", "deviation"])

    def projected(rows: DataFrame) -> DataFrame:
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
        return rows.mapInArrow(run, f"{fields}, whitened array<double>, deviation decimal(38,0)")

    error = float(np.abs(column_covariance(projected(fit), [F.col("whitened")[i] for i in range(k)], [0.0] * k) - np.eye(k)).max()) if k else 0.0
    once = [F.lit(n).cast("long").alias("n"), F.array(*map(F.lit, values.tolist())).cast("array<double>").alias("eigenvalues"), F.lit(float(np.trace(covariance))).alias("trace"), F.lit(error).alias("identity_error")]
    return projected(usable).select("vec_id", "x", "deviation", "whitened", *once)


def whitened_components(vectors: DataFrame) -> DataFrame:
    """One row per usable row and component: vec_id, component, n, deviation, whitened, explained and identity_error."""
    made = whiten(vectors)
    rows = made.select("vec_id", F.posexplode("whitened").alias("place", "whitened"), "n", F.expr("try_cast(deviation AS BIGINT)").alias("deviation"), "eigenvalues", "trace", "identity_error")
    return rows.select("vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", "whitened", (F.get("eigenvalues", F.col("place")) / F.col("trace")).alias("explained"), "identity_error")

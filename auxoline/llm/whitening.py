"""PCA whitening of embeddings from exact variances of dimensions and of sums of two dimensions (polarisation).

Entries become whole numbers x = floor(1024 c) + 100000. One pass sums each dimension; a second sums, for every dimension i and every sum of two
dimensions i + j, the squares of the values centred at the floor of their mean. Squares are whole numbers, and what the floor leaves over is taken off
exactly:

    sum of (n y - Y)^2 = n (n sum of c^2 - (Y mod n)^2),    c = y - Y div n,  Y the sum of y,

so variances are exact for any number of rows. Cross-covariances follow from 2 cov(i, j) = var(i + j) - var(i) - var(j) in whole numbers too;
only the finished d x d matrix is rounded to doubles, for ``eigh``. Tasks send d (d + 1) / 2 sums each, never rows; the driver holds the matrix.

Rules: rows whose vector is null or has null or non-finite entries, or one with 1024 |c| of 2**62 or more, are dropped, as are rows whose vector has not
the commonest length (on ties the longer one counts). Repeated rows all count, null ids stay. A direction without variance cannot be scaled: its
``whitened`` is null, as is ``identity_error`` if there is none with variance, and ``explained`` if the trace is 0. Empty tables, and vectors without entries, give no rows. Other
columns are ignored.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auxoline.llm.frames import stored
from auxoline.llm.registry import query, table

SCALE, SHIFT = 1024, 100_000
#: Scaled entries of this size or more have no place among 64-bit numbers once shifted and added.
LARGEST = float(1 << 62)
COMPONENTS = 8
#: Whole sums travel as digits to this base, so that no total leaves the range of a decimal.
BASE = 10**18
#: Rows whose squares are summed at a time, and the largest value whose square sums stay within 64 bits then.
ROWS = 4096
SMALL = 1 << 25


def fit_list(vectors: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, int, int]:
    """vec_id and x, the vectors that are fitted as whole numbers; their number, and their length."""
    scaled = F.transform(F.col(embedding), lambda c: F.lit(float(SCALE)) * c.cast("double"))
    # Neither null, NaN nor infinite entries are below the bound.
    fine = F.forall(scaled, lambda e: F.coalesce(F.abs(e) < LARGEST, F.lit(False)))
    whole = F.transform(scaled, lambda e: F.floor(e).cast("bigint") + F.lit(SHIFT).cast("bigint"))
    given = vectors.select(F.col(vec_id).alias("vec_id"), F.when(fine, whole).alias("x")).filter("x IS NOT NULL")
    lengths = given.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(2).collect()
    if not lengths:
        return given, 0, 0
    n, d = lengths[0]["count"], lengths[0]["d"]
    return given if len(lengths) < 2 else given.filter(F.size("x") == d), n, d


def _blocks(column: pa.ListArray, d: int):
    """Matrices of whole numbers, ROWS rows at a time."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    for a in range(0, len(column), ROWS):
        yield flat[a * d : (a + ROWS) * d].reshape(-1, d)


def _digits(totals) -> list[pa.Array]:
    """Whole numbers (Python's, not negative or small) as three columns to BASE."""
    high = [int(t) // BASE for t in totals]
    return [pa.array([int(t) % BASE for t in totals], pa.int64()), pa.array([h % BASE for h in high], pa.int64()), pa.array([h // BASE for h in high], pa.int64())]


def _sum_up(parts: DataFrame, *keys: str) -> list:
    total = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("lo", "mid", "hi")]
    return [(*(r[k] for k in keys), int(r.lo) + BASE * (int(r.mid) + BASE * int(r.hi))) for r in parts.groupBy(*keys).agg(*total).collect()]


def dimension_sums(rows: DataFrame, d: int) -> list[int]:
    """The sum of each dimension of x."""

    def run(batches):
        totals = [0] * d
        for batch in batches:
            for x in _blocks(batch.column(0), d):
                whole = x.sum(0) if np.abs(x).max() < 1 << 50 else x.astype(object).sum(0)
                totals = [a + int(b) for a, b in zip(totals, whole, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), *_digits(totals)], names=["i", "lo", "mid", "hi"])

    sums = dict(_sum_up(rows.select("x").mapInArrow(run, "i int, lo long, mid long, hi long"), "i"))
    return [sums.get(i, 0) for i in range(d)]


def squared_sums(rows: DataFrame, n: int, sums: list[int]) -> dict[tuple[int, int], int]:
    """Sum of (n y - Y)^2 over all rows, for y = x_i at (i, i) and y = x_i + x_j at (i, j), i < j."""
    d = len(sums)
    floors = [[(sums[i] + sums[j] if i != j else sums[i]) // n for j in range(d)] for i in range(d)]

    def run(batches):
        totals = [[0] * (d - i) for i in range(d)]
        for batch in batches:
            for x in _blocks(batch.column(0), d):
                most = max(int(np.abs(x).max()), max(abs(s) for s in sums) // n) + 1
                if most >= 1 << 61:
                    x = x.astype(object)
                for i in range(d):
                    y = x[:, i:] + x[:, i : i + 1]
                    y[:, 0] = x[:, i]
                    y -= np.array(floors[i][i:], x.dtype)
                    if x.dtype != object and np.abs(y).max() >= SMALL:
                        y = y.astype(object)
                    squares = (y * y).sum(0)
                    totals[i] = [a + int(b) for a, b in zip(totals[i], squares, strict=True)]
        ij = [(i, i + k) for i in range(d) for k in range(d - i)]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in ij], pa.int32()), pa.array([p[1] for p in ij], pa.int32()), *_digits([t for row in totals for t in row])], names=["i", "j", "lo", "mid", "hi"])

    out = {}
    for i, j, squares in _sum_up(rows.select("x").mapInArrow(run, "i int, j int, lo long, mid long, hi long"), "i", "j"):
        rest = (sums[i] + sums[j] if i != j else sums[i]) % n
        out[i, j] = n * (n * squares - rest * rest)
    return out


def covariance(squares: dict[tuple[int, int], int], n: int, d: int) -> np.ndarray:
    """V from the squares by differences of variances, each entry rounded once."""
    v = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            cross = 2 * squares[i, i] if i == j else squares[i, j] - squares[i, i] - squares[j, j]
            v[i, j] = v[j, i] = cross / (2 * n**3)
    return v


def principal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by falling size and their unit eigenvectors (columns)."""
    values, vectors = np.linalg.eigh(v)
    return values[::-1].copy(), vectors[:, ::-1].copy()


def project(rows: DataFrame, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """vec_id, deviation (decimal, null beyond 38 digits) and ``w``: the whitened components, null where a direction has no variance."""
    d, k = vectors.shape
    floors, rests = [s // n for s in sums], [s % n for s in sums]
    # Below rounding a variance is none.
    some = values > max(float(values.max(initial=0.0)), 0.0) * d * np.finfo(float).eps
    scale = np.where(some, 1 / np.sqrt(np.where(some, values, 1)), np.nan)
    share = np.array([r / n for r in rests])
    id_type = rows.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            done = 0
            for x in _blocks(batch.column(1), d):
                big = int(np.abs(x).max()) >= 1 << 61 or max(abs(f) for f in floors) >= 1 << 61
                c = x.astype(object) - np.array(floors, object) if big else x - np.array(floors, np.int64)
                w = ((c.astype(float) - share) @ vectors) * scale
                if n * (int(np.abs(c).max()) + 1) < int((2**62 / d) ** 0.5):
                    z = c.astype(np.int64) * n - np.array(rests, np.int64)
                else:
                    z = c.astype(object) * n - np.array(rests, object)
                deviation = [Decimal(int(t)) if t < 10**38 else None for t in (z * z).sum(1)]
                flat = w.reshape(-1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, k), pa.int32()), pa.array(flat, pa.float64(), mask=np.isnan(flat)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(x)), pa.array(deviation, pa.decimal128(38, 0)), lists], names=["vec_id", "deviation", "w"])
                done += len(x)

    return rows.select("vec_id", "x").mapInArrow(run, f"vec_id {id_type}, deviation decimal(38,0), w array<double>")


def identity_error(whitened: DataFrame, given: np.ndarray) -> float | None:
    """Largest absolute entry of the whitened components' covariance minus the identity; ``given``: which components there are."""
    at = np.flatnonzero(given).tolist()
    pairs = [(i, j) for i in at for j in at if i <= j]
    if not pairs:
        return None
    found = whitened.select(*[F.covar_pop(F.col("w")[i], F.col("w")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(found, pairs, strict=True))


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per fitted vector and component: vec_id, component, n, deviation (decimal), whitened, explained, identity_error."""
    rows, n, d = fit_list(vectors, vec_id, embedding)
    k = min(components, d)
    out = "vec_id {}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double".format(vectors.schema[vec_id].dataType.simpleString())
    if not n or not k:
        return vectors.sparkSession.createDataFrame([], out)
    sums = dimension_sums(rows, d)
    v = covariance(squared_sums(rows, n, sums), n, d)
    values, directions = principal(v)
    whitened = stored(project(rows, n, sums, values[:k], directions[:, :k]))
    given = values[:k] > max(float(values[0]), 0.0) * d * np.finfo(float).eps
    error, trace = identity_error(whitened, given), float(np.trace(v))
    explained = F.array(*[F.lit(float(e) / trace if trace else None).cast("double") for e in values[:k]])
    each = whitened.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
        explained[F.col("at")].alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report over all embeddings; a deviation beyond a long is null."""
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))

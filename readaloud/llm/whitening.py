"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Entries become integers, ``floor(64 c) + 1000000``; the fit list holds each distinct
integer vector once. The leading eigenvectors of its covariance V are found
without forming V: a block Q of ``BLOCK`` vectors goes through a Chebyshev polynomial of V whose
three-term recurrence costs one pass over the fit list per degree (each pass gives VQ as
a sum of centred XᵀXQ over partitions). The polynomial is small on [lowest, cut],
the unwanted end of the spectrum, and grows fast above; QR, one more pass
and a Rayleigh-Ritz step follow, which also give the next cut. It ends when the residuals
of the wanted pairs are under ``TOLERANCE`` of the largest eigenvalue, or no longer fall and lie under ``ACCEPTED`` (rounding); it raises
if ``MAX_ROUNDS`` pass without that. A block as wide as the vectors needs no filter: one Rayleigh-Ritz step is exact.

**Scale.** The fit list is written once and read in each pass. A pass sends at most
dimensions x BLOCK doubles per task into an aggregate by dimension; the driver holds
such blocks alone (dimensions x BLOCK doubles, whatever the rows). Copies of one vector meet in a partial aggregate first. The
last projection is row-local: each task gets the components.

**Arithmetic.** Sums of the integers are exact, centring is ``(n x - S) / n`` with an exact numerator, and
``deviation`` is an integer (null where it is beyond a long).

**Rows.** Left out: vectors that are null, empty or hold a null or non-finite entry, and those whose length is not
the commonest one (the longer of two). Entries beyond 2 to the 40 count as that bound. Repeated rows and ids are a row each; the fit takes a vector once.
Components are at most 16 and at most the rank: directions without variance are not whitened, so equal vectors alone, or an empty table, give no rows.
The sign of a component is that of its largest entry. Other columns of the input are not read.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shipped, stored

COMPONENTS = 16
#: Vectors iterated: the wanted ones and as many beside them, which speed up the last ones.
BLOCK = 32
#: Degree of the polynomial, so the passes between two Rayleigh-Ritz steps.
DEGREE = 10
#: Passes that bound the spectrum from below.
LANCZOS = 8
#: Residuals relative to the largest eigenvalue: certified under the first, accepted under the second when they fall no more.
TOLERANCE = 1e-14
ACCEPTED = 1e-11
MAX_ROUNDS = 60
#: Eigenvalues under this share of the largest one are rounding, not variance.
NO_VARIANCE = 1e-12
_BOUND = 2 ** 40

Batches = Iterator[pa.RecordBatch]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The lists of a batch, all of one length, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def integer_vectors(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """The usable rows with ``x``, their integer vector."""
    x = F.transform(vector, lambda c: F.floor(F.least(F.greatest(c.cast("double"), F.lit(-_BOUND / 64)), F.lit(_BOUND / 64)) * 64).cast("bigint") + 1_000_000)
    fine = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(
        vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return table.where(F.coalesce(fine, F.lit(False))).withColumn("x", x)


def fit_list(rows: DataFrame) -> tuple[DataFrame, int]:
    """The distinct x of the commonest length, stored, and that length (0 without rows)."""
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"))
    width = lengths.agg(F.max_by("d", F.struct("n", "d")).alias("d")).first()["d"] or 0
    return stored(rows.where(F.size("x") == width).select("x").distinct(), "whitening-fit"), width


def _sums(width: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        total, n = np.zeros(width, np.int64), 0
        for batch in batches:
            rows = _matrix(batch["x"], width)
            total += rows.sum(axis=0)
            n += len(rows)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total), pa.array(np.full(width, n))], ["dim", "total", "n"])
    return run


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n from the exact integer n x - S."""
    return _numerators(x, n, sums).astype(np.float64) / n


def _numerators(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, in Python's integers where a long might not hold it."""
    top = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if n * top + int(np.abs(sums).max(initial=0)) < 2 ** 62:
        return n * x - sums
    return n * x.astype(object) - sums.astype(object)


def _covariance_product(q: np.ndarray, n: int, sums: np.ndarray) -> Callable[[Batches], Batches]:
    """A partition's share of V q, by dimension."""
    def run(batches: Batches) -> Batches:
        share = np.zeros(q.shape)
        for batch in batches:
            rows = _centred(_matrix(batch["x"], len(sums)), n, sums)
            share += rows.T @ (rows @ q)
        share /= n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(share))), pa.array(list(share), pa.list_(pa.float64()))], ["dim", "share"])
    return run


def multiply(fit: DataFrame, q: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """V q in one pass."""
    k = q.shape[1]
    shares = fit.mapInArrow(_covariance_product(q, n, sums), "dim bigint, share array<double>")
    rows = shares.groupBy("dim").agg(F.array(*[F.sum(F.get("share", F.lit(j))) for j in range(k)]).alias("row")).collect()
    out = np.zeros(q.shape)
    for row in rows:  # one row per dimension
        out[row["dim"]] = row["row"]
    return out


def _filtered(fit: DataFrame, q: np.ndarray, n: int, sums: np.ndarray, low: float, cut: float, top: float) -> np.ndarray:
    """The Chebyshev polynomial of degree DEGREE on [low, cut], scaled to about 1 at ``top``, applied to q."""
    half, middle = (cut - low) / 2, (cut + low) / 2
    scale = half / (top - middle)
    first = scale
    y = (multiply(fit, q, n, sums) - middle * q) * (scale / half)
    for _ in range(DEGREE - 1):
        following = 1 / (2 / first - scale)
        q, y = y, (multiply(fit, y, n, sums) - middle * y) * (2 * following / half) - scale * following * q
        scale = following
    return y


def lowest(fit: DataFrame, n: int, sums: np.ndarray) -> float:
    """A bound from below on V's eigenvalues: the least Ritz value of a few Lanczos passes, less the norm of what they leave."""
    basis = [np.random.default_rng(5).standard_normal(len(sums))]
    basis[0] /= np.linalg.norm(basis[0])
    diagonal, beside = [], []
    for _ in range(min(LANCZOS, len(sums))):
        w = multiply(fit, basis[-1][:, None], n, sums)[:, 0]
        diagonal.append(w @ basis[-1])
        for _ in range(2):  # against all earlier ones: there are few
            w = w - np.array(basis).T @ (np.array(basis) @ w)
        beside.append(np.linalg.norm(w))
        if beside[-1] <= 1e-12 * max(diagonal):
            break
        basis.append(w / beside[-1])
    ritz = np.linalg.eigvalsh(np.diag(diagonal) + np.diag(beside[:-1], 1) + np.diag(beside[:-1], -1))
    return max(0.0, float(ritz[0] - beside[-1]))


def leading_pairs(fit: DataFrame, n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, eigenvectors as columns, largest certified residual over the largest eigenvalue), at most COMPONENTS."""
    width = len(sums)
    k = min(BLOCK, width)
    wanted = min(COMPONENTS, width)
    q = np.linalg.qr(np.random.default_rng(11).standard_normal((width, k)))[0]
    low, before = lowest(fit, n, sums) if k < width else 0.0, np.inf
    for _ in range(MAX_ROUNDS):
        product = multiply(fit, q, n, sums)
        small = q.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, product = q @ turn, product @ turn
        top = max(values[0], 0.0)
        if top == 0:
            return values[:0], q[:, :0], 0.0
        residual = np.linalg.norm(product[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0).max() / top
        if k == width or residual <= TOLERANCE or (residual <= ACCEPTED and residual > before / 2):
            break
        before = residual
        cut = max(values[-1], low + top * 1e-9)
        q = np.linalg.qr(_filtered(fit, q, n, sums, low, cut, top))[0]
    else:
        raise RuntimeError(f"no certified pairs after {MAX_ROUNDS} rounds: residual {residual}")
    real = values[:wanted] > NO_VARIANCE * top
    vectors = q[:, :wanted][:, real]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values[:wanted][real], vectors * signs, float(residual)


def _moments(width: int, n: int, sums: np.ndarray, projector: np.ndarray) -> Callable[[Batches], Batches]:
    """A partition's sums of whitened rows and of their products."""
    def run(batches: Batches) -> Batches:
        k = projector.shape[1]
        total, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            rows = _centred(_matrix(batch["x"], width), n, sums) @ projector
            total += rows.sum(axis=0)
            products += rows.T @ rows
        table = np.vstack([total, products])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + 1)), pa.array(list(table), pa.list_(pa.float64()))], ["dim", "share"])
    return run


def identity_error(fit: DataFrame, n: int, sums: np.ndarray, projector: np.ndarray) -> float:
    """The largest entry of the whitened fit list's covariance minus the identity."""
    k = projector.shape[1]
    shares = fit.mapInArrow(_moments(len(sums), n, sums, projector), "dim bigint, share array<double>")
    rows = {r["dim"]: r["row"] for r in shares.groupBy("dim").agg(F.array(*[F.sum(F.get("share", F.lit(j))) for j in range(k)]).alias("row")).collect()}
    mean = np.array(rows[0]) / n
    covariance = np.array([rows[i + 1] for i in range(k)]) / n - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(k)).max())


def _whiten(n: int, sums: np.ndarray, projector: np.ndarray) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            if not batch.num_rows:
                continue
            over = _numerators(_matrix(batch["x"], len(sums)), n, sums)
            whitened = (over.astype(np.float64) / n) @ projector
            widest = max(abs(int(v)) for v in (over.max(initial=0), over.min(initial=0)))
            squares = over * over if over.dtype != object and widest ** 2 * len(sums) < 2 ** 63 else over.astype(object) ** 2
            deviation = [v if v < 2 ** 63 else None for v in squares.sum(axis=1).tolist()]
            at = batch.schema.get_field_index("x")
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), pa.array(deviation, pa.int64()),
                                              pa.array(list(whitened), pa.list_(pa.float64()))],
                                             [*(f for f in batch.schema.names if f != "x"), "deviation", "whitened"])
    return run


def whiten(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error and residual; see the module."""
    spark = table.sparkSession
    rows = integer_vectors(table.select(id_col, vector), vector).select(id_col, "x")
    fit, width = fit_list(rows)
    schema = f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}"
    shipped(fit)
    found = _fitted(spark, fit, width) if width else None
    if found is None:
        return spark.createDataFrame([], f"{schema}, component int, n bigint, deviation bigint, whitened double, explained double, "
                                         "identity_error double, residual double")
    n, sums, values, vectors, trace, residual = found
    projector = vectors / np.sqrt(values)
    error = identity_error(fit, n, sums, projector)
    out = rows.where(F.size("x") == width).mapInArrow(_whiten(n, sums, projector), f"{schema}, deviation bigint, whitened array<double>")
    explained = F.array(*[F.lit(float(v / trace)) for v in values])
    return out.select(id_col, "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        id_col, (F.col("at") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"), F.lit(residual).alias("residual"))


def _fitted(spark: SparkSession, fit: DataFrame, width: int) -> tuple | None:
    """n, S, the pairs, the trace and the residual; None without variance."""
    rows = fit.mapInArrow(_sums(width), "dim bigint, total bigint, n bigint").groupBy("dim").agg(
        F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    sums = np.zeros(width, np.int64)
    for row in rows:  # one row per dimension
        sums[row["dim"]] = row["total"]
    n = rows[0]["n"]
    spread = fit.mapInArrow(_spread(n, sums), "spread double").agg(F.sum("spread")).first()[0]
    trace = spread / n
    if trace <= 0:
        return None
    values, vectors, residual = leading_pairs(fit, n, sums)
    return (n, sums, values, vectors, trace, residual) if len(values) else None


def _spread(n: int, sums: np.ndarray) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        total = float(sum(np.square(_centred(_matrix(b["x"], len(sums)), n, sums)).sum() for b in batches))
        yield pa.RecordBatch.from_arrays([pa.array([total])], ["spread"])
    return run

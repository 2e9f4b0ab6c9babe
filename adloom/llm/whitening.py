"""Whitening of embeddings on their leading principal components, by Jacobi-Davidson.

Entries become whole numbers, so counts, sums and squared deviations are exact. The
covariance matrix is never formed: a product with it is one pass over the vectors, in
which each task centres its own rows before multiplying and Spark adds up the parts, a
small block per task. On the driver live only blocks of dimension x a few dozen numbers.

Each round finds Ritz pairs in a search space (Rayleigh-Ritz), locks those at the top
whose residual has reached double precision, and for each of the next ones solves the
correction equation, projected against the locked vectors and the pair itself, by a few
steps of MINRES; all pairs share the passes of these steps. The solutions widen the search
space, which shrinks to its leading Ritz vectors when it is full.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.workspace import materialize, release

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: Pairs that are worked on beyond the wanted ones, so that none is overtaken from below.
GUARD = 4
#: MINRES steps for each correction equation.
INNER = 3
#: A residual of this many times the largest eigenvalue is double precision; after
#: ``ROUNDS`` rounds, or when nothing improves any more, ``LOOSE`` is demanded.
TIGHT, LOOSE = 5e-14, 1e-10
ROUNDS = 60
#: An eigenvalue below this share of the trace counts as no variance at all.
NOTHING = 1e-12
_ROWS = 4096  # rows that are multiplied at once

Product = Callable[[np.ndarray], np.ndarray]


def _orthonormal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """Columns that span what ``new`` adds to ``against``; twice, to double precision."""
    for _ in range(2):
        for q in against:
            new = new - q @ (q.T @ new)
        left, size, _ = np.linalg.svd(new, full_matrices=False)
        new = left[:, size > 1e-12 * max(size.max(initial=0), 1e-300)]
    return new


def _in_place(found: np.ndarray, locked: np.ndarray) -> np.ndarray:
    """Nearly orthonormal columns, each corrected by rounding errors only."""
    found = found - locked @ (locked.T @ found)
    q, r = np.linalg.qr(found)
    return q * np.sign(np.diag(r))


def corrections(product: Product, locked: np.ndarray, u: np.ndarray, theta: np.ndarray, r: np.ndarray, steps: int) -> np.ndarray:
    """For each column an approximate t with (1 - QQ')(A - theta)(1 - QQ') t = -r, by MINRES.

    Q holds the locked vectors and the column's own Ritz vector. The columns run side by
    side, so a step costs one product for all of them.
    """

    def project(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x = x - locked @ (locked.T @ x)
            x = x - u * (u * x).sum(0)
        return x

    def safe(x: np.ndarray) -> np.ndarray:
        return np.where(np.abs(x) > 1e-300, x, 1.0)

    v_old, v = np.zeros_like(r), project(-r)
    beta = np.linalg.norm(v, axis=0)
    open_ = beta > 0
    v = v / safe(beta)
    eta, scale = beta.copy(), beta.copy()
    c, c_old = np.ones_like(beta), np.ones_like(beta)
    s, s_old = np.zeros_like(beta), np.zeros_like(beta)
    w, w_old, t = np.zeros_like(r), np.zeros_like(r), np.zeros_like(r)
    beta = np.zeros_like(beta)
    for _ in range(steps):
        if not open_.any():
            break
        av = project(product(v) - theta * v)
        alpha = (v * av).sum(0)
        av = av - alpha * v - beta * v_old
        beta_new = np.linalg.norm(av, axis=0)
        # Two old rotations, then a new one, make the tridiagonal matrix triangular.
        delta = c * alpha - c_old * s * beta
        rho_2, rho_3 = s * alpha + c_old * c * beta, s_old * beta
        rho = np.hypot(delta, beta_new)
        open_ &= rho > 1e-14 * np.abs(scale) / safe(scale)
        c_old, s_old = c, s
        c, s = delta / safe(rho), beta_new / safe(rho)
        w_old, w = w, (v - rho_3 * w_old - rho_2 * w) / safe(rho)
        t = t + np.where(open_, c * eta, 0.0) * w
        eta = -s * eta
        v_old, v, beta = v, av / safe(beta_new), beta_new
        open_ &= beta_new > 1e-14 * np.abs(theta).max(initial=0)
    return project(t)


def leading(product: Product, dim: int, k: int, seed: int = 5, inner: int = INNER) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric positive matrix, falling, and unit vectors."""
    k = min(k, dim)
    width = min(k + GUARD, dim)
    most = min(dim, 6 * width)  # of the search space
    space = _orthonormal(np.random.default_rng(seed).normal(size=(dim, width)))
    image = product(space)
    locked, values, best, still = np.zeros((dim, 0)), [], np.inf, 0
    for round_ in range(ROUNDS + 1):
        small = space.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        ritz, ritz_image = space @ turn, image @ turn
        wanted = min(width - len(values), ritz.shape[1])
        r = ritz_image[:, :wanted] - ritz[:, :wanted] * theta[:wanted]
        r -= locked @ (locked.T @ r)
        size = np.linalg.norm(r, axis=0)
        scale = max([*values, *theta[:1], 0.0])
        missing = k - len(values)
        full = space.shape[1] + len(values) >= dim
        worst = size[:missing].max(initial=0)
        still = 0 if worst < 0.5 * best else still + 1
        best = min(best, worst)
        last = full or round_ == ROUNDS or still >= 4
        done = 0  # from the top, so that numbers follow the eigenvalues
        while done < missing and size[done] <= (LOOSE if last else TIGHT) * scale:
            done += 1
        if done:
            values += theta[:done].tolist()
            locked = np.hstack([locked, _in_place(ritz[:, :done], locked)])
            best, still = np.inf, 0
        if len(values) >= k:
            break
        if last and not done:
            raise ArithmeticError(f"residual {worst:.1e} of {scale:.1e} after {round_} rounds")
        space, image = ritz[:, done:], ritz_image[:, done:]
        if not space.shape[1]:
            space = _orthonormal(np.random.default_rng(seed + round_).normal(size=(dim, width)), locked)
            image = product(space)
            continue
        if space.shape[1] + width > most:
            space, image = space[:, : 2 * width], image[:, : 2 * width]
        active = slice(done, wanted)
        t = corrections(product, locked, ritz[:, active], theta[active], r[:, active], inner)
        t = t[:, np.linalg.norm(t, axis=0) > 0]
        new = _orthonormal(t, locked, space)
        if not new.shape[1] and not full:  # an invariant subspace: look elsewhere too
            new = _orthonormal(np.random.default_rng(seed + round_ + 1).normal(size=(dim, width)), locked, space)
        if new.shape[1]:
            space, image = np.hstack([space, new]), np.hstack([image, product(new)])
    order = np.argsort(values)[::-1][:k]
    return np.array(values)[order], locked[:, order]


def usable(v: Column) -> Column:
    """Not null, and without null or non-finite entries."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & (F.size(v) > 0), F.lit(False))


def _blocks(batches: Iterator[pa.RecordBatch], column: int, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            yield part, part.column(column).flatten().to_numpy().reshape(-1, dim)


class Centred:
    """Vectors x (arrays of ``dim`` whole numbers) about their mean, and products with them."""

    def __init__(self, rows: DataFrame, dim: int):
        self.rows, self.dim = rows, dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
            total = np.zeros(dim + 1, np.int64)
            for _, x in _blocks(batches, 0, dim):
                total += np.append(x.sum(0), len(x))
            yield total

        total = self._added(run, "long")
        self.n, self.sums = int(total[-1]), total[:-1]

    def _added(self, run, kind: str) -> np.ndarray:
        """The sum over tasks of the one array that each of them yields."""

        def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in run(batches):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(part))), pa.array(part)], ["i", "x"])

        added = self.rows.select("x").mapInArrow(parts, f"i long, x {kind}").groupBy("i").agg(F.sum("x").alias("x"))
        return np.array([r["x"] for r in sorted(added.collect())])  # as many numbers as an array has

    def centre(self, x: np.ndarray) -> np.ndarray:
        """n * x - S is exact, so what is divided has all its digits."""
        return (self.n * x - self.sums) / self.n

    def sum_over(self, of_block: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """The sum of ``of_block`` over blocks of centred rows, for an array of ``size`` numbers."""
        dim, n, sums = self.dim, self.n, self.sums

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
            total = np.zeros(size)
            for _, x in _blocks(batches, 0, dim):
                total += of_block((n * x - sums) / n).ravel()
            yield total

        return self._added(run, "double")

    def product(self, block: np.ndarray) -> np.ndarray:
        """The covariance matrix times ``block``, in one pass."""
        return self.sum_over(lambda c: c.T @ (c @ block), block.size).reshape(block.shape) / self.n


def _whitened(rows: DataFrame, id_type: str, dim: int, k: int) -> DataFrame:
    data = Centred(rows, dim)
    n, sums = data.n, data.sums
    trace = float(data.sum_over(lambda c: (c**2).sum(0), dim).sum()) / n
    values, vectors = leading(data.product, dim, k)
    k = len(values)
    varies = values > NOTHING * trace
    scale = np.where(varies, 1 / np.sqrt(np.where(varies, values, 1.0)), np.nan)
    turn = vectors * np.where(varies, scale, 0.0)
    mean = data.sum_over(lambda c: (c @ turn).sum(0), k) / n

    def spread(c: np.ndarray) -> np.ndarray:
        z = c @ turn - mean
        return z.T @ z

    error = None
    if varies.any():
        off = data.sum_over(spread, k * k).reshape(k, k) / n - np.eye(k)
        error = float(np.abs(off[np.ix_(varies, varies)]).max())
    explained = (values / trace).tolist() if trace > 0 else [None] * k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, 1, dim):
            exact = n * x - sums
            z = (exact / n) @ vectors * scale
            if float(np.abs(exact).max(initial=0)) ** 2 * dim < 2**63:
                deviation = (exact**2).sum(1).tolist()
            else:  # whole numbers of any length; null where the sum is none of 64 bits
                deviation = [sum(e * e for e in row) for row in exact.tolist()]
                deviation = [d if d < 1 << 63 else None for d in deviation]
            m = len(x)
            columns = [
                part.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, n)),
                pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(z.ravel(), mask=np.tile(~varies, m)),
                pa.array(explained * m, pa.float64()),
                pa.array([error] * (m * k), pa.float64()),
            ]
            names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.select("vec_id", "x").mapInArrow(run, _schema(id_type))


def _schema(id_type: str) -> str:
    return (
        f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row per vector and component: ``vec_id``, ``component``, ``n``, ``deviation``,
    ``whitened``, ``explained``, ``identity_error``.

    Vectors that are null or empty, or hold a null or non-finite entry, drop out; null and
    repeated ids stay, and every row counts. Entry c becomes floor(1024 * c) + 100000.
    Components are numbered from 1 by falling eigenvalue, up to the vectors' length;
    ``deviation`` is the exact sum of squares of n * x - S (null beyond 64 bits),
    ``explained`` the eigenvalue's share of the trace, ``identity_error`` the largest
    entry by which the covariance of what is whitened misses the identity. A component
    without variance (fewer rows than components, equal rows) has a null ``whitened`` and
    no part in that error; with no variance at all ``explained`` and the error are null.
    Equal eigenvalues may share any basis. Vectors of each length are fitted and whitened
    among themselves. Extra columns are ignored; no usable rows give no rows.
    """
    spark = embeddings.sparkSession
    v = F.col("embedding").cast("array<double>")
    whole = F.transform("v", lambda c: F.floor(c * F.lit(float(SCALE))).cast("long") + F.lit(SHIFT))
    rows = embeddings.select("vec_id", v.alias("v")).where(usable(F.col("v")))
    rows = materialize(rows.select("vec_id", whole.alias("x")), "vectors")
    id_type = embeddings.schema["vec_id"].dataType.simpleString()
    lengths = [r["dim"] for r in rows.select(F.size("x").alias("dim")).distinct().orderBy("dim").collect()]
    result = spark.createDataFrame([], _schema(id_type))
    if not lengths:
        release(rows)
    for i, dim in enumerate(lengths):
        own = rows if len(lengths) == 1 else rows.where(F.size("x") == dim)
        made = _whitened(own, id_type, dim, components)
        result = made if i == 0 else result.unionByName(made)
    return result

"""Whitening of vectors by Chebyshev-filtered subspace iteration.

Entries become whole numbers, the distinct vectors are packed into blocks and frozen, and a pass multiplies the centred blocks
with a small matrix: each task adds up Yᵀ(YQ) of its blocks, a few tasks add those up, the driver holds d x p numbers.  A
subspace of p columns is filtered by the Chebyshev recurrence, which damps the spectrum under the subspace's smallest Ritz
value (its lower end from a short Lanczos run), then made orthogonal by QR and turned by Rayleigh-Ritz.  A pair whose
residual is at the level of rounding is certified, locked, and kept out of further filters.

Every value is centred as the whole number n*x - S before anything is multiplied, so a large mean costs no digits.

Defined results: vectors that are null or hold null or non-finite entries take no part; of several lengths the most frequent
counts (of equally frequent ones the longer), others take no part; entries beyond 2^40 count as 2^40; repeated rows are fitted
once and each get their rows; rows without id are kept; directions without variance have no component, so vectors that are all
equal, or an empty table, give no rows; a deviation beyond 64 bits is null; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import freeze

COMPONENTS = 16
#: Columns of the subspace beyond the components asked for.
SPARE = 24
#: Highest degree of the filter, and the most by which it may favour one column over another.
DEGREE, SPREAD = 12, 1e8
LANCZOS = 12
#: A residual, as a share of the largest eigenvalue, that certifies; one that does if rounding lets it fall no further.
CERTAIN, ROUNDED = 1e-14, 1e-11
ROUNDS = 60
#: Directions with less than this share of the largest eigenvalue have no variance.
NOTHING = 1e-12
BLOCK = 4096
#: Tasks that add up what the others found.
ADDERS = 16
SCALE, SHIFT, LARGEST = 64, 1_000_000, 1 << 40


@dataclass
class Model:
    n: int
    sums: list[int]
    vectors: np.ndarray  # a column per component
    values: np.ndarray
    trace: float
    identity_error: float
    passes: int
    residual: float


def whole(vector: Column) -> Column:
    """floor(64 * x) + 1000000 of each entry; null where the vector takes no part."""
    fits = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    entry = lambda x: F.floor(SCALE * F.greatest(F.least(x.cast("double"), F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("long") + SHIFT
    return F.when(fits, F.transform(vector, entry))


def _packed(x: np.ndarray) -> bytes:
    """A vector or block in the fewest bytes an entry, led by their number: equal vectors are equal strings."""
    y = x - SHIFT
    for size in (1, 2, 4):
        if np.array_equal(y.astype(f"<i{size}"), y):
            return bytes([size]) + y.astype(f"<i{size}").tobytes()
    return b"\x08" + y.astype("<i8").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).astype(np.int64) + SHIFT


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long lists as a matrix."""
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array([_packed(x) for x in _matrix(batch.column(0))], pa.binary())], names=["v"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matrices of whole numbers with their row counts and sums."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            x = np.stack([_unpacked(v) for v in batch.column(0).slice(at, BLOCK).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(x)], pa.int64()), pa.array([x.sum(axis=0).tolist()], pa.list_(pa.int64())), pa.array([_packed(x)], pa.binary())],
                names=["rows", "sums", "x"],
            )


class Centre:
    """Exact n*x - S, and its quotient by n."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.mean = [s // n for s in sums]  # whole part: what is left is below n

    def __call__(self, x: np.ndarray) -> np.ndarray:
        part = np.array([s - m * self.n for s, m in zip(self.sums, self.mean, strict=True)], np.int64)
        near = x - np.array(self.mean, np.int64)
        if np.abs(near).max(initial=0) < (1 << 62) // self.n:
            return (self.n * near - part).astype(np.float64) / self.n
        return near - part / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        near = x - np.array(self.mean, np.int64)
        part = [s - m * self.n for s, m in zip(self.sums, self.mean, strict=True)]
        most = int(np.abs(near).max(initial=0)) * self.n + self.n
        if most * most * max(x.shape[1], 1) < 1 << 63:
            return ((self.n * near - np.array(part, np.int64)) ** 2).sum(axis=1).tolist()
        found = [sum((self.n * v - p) ** 2 for v, p in zip(row, part, strict=True)) for row in near.tolist()]
        return [f if f < 1 << 63 else None for f in found]


class Passes:
    """Products of the centred fit list with small matrices, one Spark job each."""

    def __init__(self, blocks: DataFrame, n: int, sums: list[int]):
        self.blocks, self.n, self.d, self.centre, self.count = blocks, n, len(sums), Centre(n, sums), 0

    def _added(self, of) -> np.ndarray:
        """The sum over all blocks of an array made from each block's centred rows."""
        centre, d = self.centre, self.d

        def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for data in batch.column(0).to_pylist():
                    own = of(centre(_unpacked(data).reshape(-1, d)))
                    total = own if total is None else total + own
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], names=["sums"])

        def adders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for data in batch.column(0).to_pylist():
                    own = np.frombuffer(data, "<f8")
                    total = own.copy() if total is None else total + own
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        self.count += 1
        sums = self.blocks.select("x").mapInArrow(tasks, "sums binary")
        if self.blocks.rdd.getNumPartitions() > 4 * ADDERS:
            sums = sums.repartition(ADDERS).mapInArrow(adders, "sums binary")
        parts = [np.frombuffer(r.sums, "<f8") for r in sums.collect()]
        return np.sum(parts, axis=0)

    def covariance(self, q: np.ndarray) -> np.ndarray:
        """VQ for the covariance V of the fit list."""
        return self._added(lambda y: (y.T @ (y @ q)).ravel()).reshape(self.d, -1) / self.n

    def trace(self) -> float:
        return float(self._added(lambda y: np.array([np.einsum("ij,ij->", y, y)]))[0]) / self.n

    def identity_error(self, p: np.ndarray) -> float:
        """Largest absolute entry of the covariance of Yp less the identity."""
        k = p.shape[1]

        def moments(y):
            w = y @ p
            return np.concatenate([(w.T @ w).ravel(), w.sum(axis=0)])

        found = self._added(moments)
        mean = found[k * k:] / self.n
        return float(np.abs(found[:k * k].reshape(k, k) / self.n - np.outer(mean, mean) - np.eye(k)).max())


def lower_end(product, d: int, rng: np.random.Generator, steps: int = LANCZOS) -> float:
    """A number that the smallest eigenvalue hardly goes below: the smallest Ritz value of a Lanczos run less its residual."""
    q = rng.normal(size=d)
    basis, alphas, betas = [q / np.linalg.norm(q)], [], []
    for _ in range(min(steps, d)):
        w = product(basis[-1][:, None])[:, 0]
        alphas.append(float(basis[-1] @ w))
        for b in basis + basis:  # made orthogonal twice
            w = w - b * (b @ w)
        betas.append(float(np.linalg.norm(w)))
        if betas[-1] <= 1e-12 * max(map(abs, alphas)):
            break
        basis.append(w / betas[-1])
    values, vectors = np.linalg.eigh(np.diag(alphas) + np.diag(betas[:len(alphas) - 1], 1) + np.diag(betas[:len(alphas) - 1], -1))
    return max(0.0, float(values[0]) - abs(betas[len(alphas) - 1] * vectors[-1, 0]))


def chebyshev(product, x: np.ndarray, degree: int, low: float, high: float, top: float) -> np.ndarray:
    """The columns of ``x`` under the polynomial that is small on [low, high] and one at ``top``, by its recurrence."""
    centre, half = (low + high) / 2, (high - low) / 2
    first = sigma = half / (top - centre)
    before, now = x, (product(x) - centre * x) * (sigma / half)
    for _ in range(degree - 1):
        next_ = 1 / (2 / first - sigma)
        before, now = now, (product(now) - centre * now) * (2 * next_ / half) - before * (sigma * next_)
        sigma = next_
    return now


def subspace(product, d: int, k: int, *, spare: int = SPARE, seed: int = 1) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``k`` largest eigenvalues of a symmetric positive operator, their unit vectors, and the largest residual."""
    rng = np.random.default_rng(seed)
    k, p = min(k, d), min(k + spare, d)
    x = np.linalg.qr(rng.normal(size=(d, p)))[0]
    low = lower_end(product, d, rng) if p < d else 0.0
    locked, values, worst = np.zeros((d, 0)), np.zeros(0), 0.0
    last = np.full(p, np.inf)
    for _ in range(ROUNDS):
        vx = product(x)
        small, turn = np.linalg.eigh((x.T @ vx + vx.T @ x) / 2)
        theta, turn = small[::-1], turn[:, ::-1]
        x, vx = x @ turn, vx @ turn
        left = np.linalg.norm(vx - x * theta - locked @ (locked.T @ vx), axis=0)
        top = max(float(values[0]) if len(values) else float(theta[0]), 0.0)
        sure = (left <= CERTAIN * top) | ((left <= ROUNDED * top) & (left > last[:len(left)] / 2))
        done = int(np.argmin(np.append(sure, False)))
        done = min(done, k - len(values))
        if p == d:  # the subspace is the whole space: nothing is left to filter
            done = k
        worst = max(worst, float(left[:done].max(initial=0.0)) / top if top else 0.0)
        locked, values = np.hstack([locked, x[:, :done]]), np.append(values, theta[:done])
        last = left[done:]
        x, theta = x[:, done:], theta[done:]
        if len(values) >= k or top == 0.0:
            return values, locked, worst
        high = max(float(theta[-1]), low + 1e-9 * top)
        reach = lambda v: np.arccosh(max((2 * v - low - high) / (high - low), 1.0 + 1e-12))
        need = k - len(values)
        gap = reach(theta[0]) - reach(theta[min(need, len(theta)) - 1])
        degree = int(np.clip(np.log(SPREAD) / max(gap, 1e-9), 2, DEGREE))
        clear = lambda y: y - locked @ (locked.T @ y)
        # locked directions get the value the filter damps most; at zero, far off a narrow [low, high], their rounding would outgrow the rest
        still = lambda y: clear(product(y)) + (low + high) / 2 * (locked @ (locked.T @ y))
        x = chebyshev(still, x, degree, low, high, max(float(theta[0]), high * (1 + 1e-9)))
        x = np.linalg.qr(clear(np.linalg.qr(clear(x))[0]))[0]
    raise ArithmeticError(f"{len(values)} of {k} components certified in {ROUNDS} rounds")


def _usable(vectors: DataFrame, vector: str) -> tuple[Column, int]:
    """The condition for taking part, and the dimension."""
    x = whole(F.col(vector))
    found = vectors.select(F.size(x).alias("d")).filter("d > 0").groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    d = found.d if found else 0
    return x.isNotNull() & (F.size(x) == d), d


def fit(vectors: DataFrame, *, vector: str = "embedding", components: int = COMPONENTS, spare: int = SPARE) -> Model | None:
    """Components of the distinct vectors; None where there is nothing to fit."""
    usable, d = _usable(vectors, vector)
    if not d:
        return None
    distinct = freeze(vectors.filter(usable).select(whole(F.col(vector)).alias("v")).mapInArrow(_pack, "v binary").distinct())
    # a pass is a job, and there are some hundred: no more tasks than full blocks, whatever number the shuffle has left
    blocks = freeze(distinct.coalesce(-(-distinct.count() // BLOCK)).mapInArrow(_blocks, "rows long, sums array<long>, x binary"))
    exact = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(d)]
    n, *sums = blocks.agg(F.sum("rows"), *exact).first()
    passes = Passes(blocks, n, [int(s) for s in sums])
    trace = passes.trace()
    if trace == 0:
        return None
    values, q, residual = subspace(passes.covariance, d, components, spare=spare)
    some = values > NOTHING * values[0]
    values, q = values[some], q[:, some]
    q = q * np.where(q[np.abs(q).argmax(axis=0), np.arange(q.shape[1])] < 0, -1.0, 1.0)  # the largest entry is positive
    error = passes.identity_error(q / np.sqrt(values))
    return Model(n, [int(s) for s in sums], q, values, trace, error, passes.count, residual)


def whiten(vectors: DataFrame, model: Model | None, *, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each vector and component: ``vec_id``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``."""
    kind = vectors.select(F.col(vec_id).alias("vec_id")).schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    d, k = model.vectors.shape
    centre, turn = Centre(model.n, model.sums), model.vectors / np.sqrt(model.values)
    explained = model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, BLOCK):
                batch = whole_batch.slice(at, BLOCK)
                x = _matrix(batch.column(1))
                m = len(x)
                rows = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, model.n)),
                     pa.array(centre.deviation(x), pa.int64()).take(rows), pa.array((centre(x) @ turn).ravel()), pa.array(np.tile(explained, m)),
                     pa.array(np.full(m * k, model.identity_error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    x = whole(F.col(vector))
    return vectors.filter(x.isNotNull() & (F.size(x) == d)).select(F.col(vec_id).alias("vec_id"), x.alias("x")).mapInArrow(run, schema)

"""Whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred vectors.

The rows never leave their tasks. A left vector u is X w for a short vector w that the driver
keeps, so each task makes its part of u anew from its rows, and what u has of another left
vector X w' is w'.(X'u): a step takes Xv and X'u by tasks, stores nothing that grows with the
rows, and makes u orthogonal to all left vectors before it from X'u alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import finite, materialize, shuffle_partitions

COMPONENTS = 16
#: Rows of a stored block: what a task turns into doubles at a time.
BLOCK_ROWS = 2048
#: What is left of a singular triplet, against the largest singular value, when it counts as found.
TOLERANCE = 1e-15
SEED = 11


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _pack(batches):
    """Rows of integers as blocks: the least value, the width of the rest in bytes, the bytes."""

    def block(rows):
        matrix = np.concatenate(rows)
        base = int(matrix.min())
        above = matrix.astype(np.uint64) - np.uint64(base % (1 << 64))  # right also past 2^63
        width = next(w for w in (1, 2, 4, 8) if int(above.max()) < 1 << 8 * w)
        data = above.astype(f"<u{width}").tobytes()
        return pa.RecordBatch.from_pydict(
            {"base": pa.array([base], pa.int64()), "width": pa.array([width], pa.int32()), "data": [data]}
        )

    rows, held = [], 0
    for batch in batches:
        matrix = _matrix(batch.column(0))
        for at in range(0, len(matrix), BLOCK_ROWS):
            rows.append(matrix[at : at + BLOCK_ROWS])
            held += len(rows[-1])
            if held >= BLOCK_ROWS:
                yield block(rows)
                rows, held = [], 0
    if rows:
        yield block(rows)


def _stored(batches, dim: int):
    """(base, matrix of what is above it) of each block."""
    for batch in batches:
        for base, width, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
            yield base, np.frombuffer(data, dtype=f"<u{width}").reshape(-1, dim)


def _whole(base: int, above: np.ndarray) -> np.ndarray:
    """The integers of a block."""
    return (above.astype(np.uint64) + np.uint64(base % (1 << 64))).view(np.int64)


class Centre:
    """Subtracts the mean, held as a whole number and a rest, so that no digits are lost."""

    def __init__(self, n: int, sums: list[int]):
        self.whole = np.array([s // n for s in sums], dtype=np.int64)
        self.rest = np.array([s % n / n for s in sums])

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        return (rows - self.whole) - self.rest

    def block(self, base: int, above: np.ndarray) -> np.ndarray:
        if above.itemsize == 8:
            return self(_whole(base, above))
        # whole numbers of 32 bits and their shift are exact as doubles
        rows = above.astype(np.float64)
        rows += (base - self.whole).astype(np.float64)
        rows -= self.rest
        return rows


class FitList:
    """Distinct integer vectors, in blocks, with what is known of them."""

    def __init__(self, blocks: DataFrame, dim: int):
        self.blocks, self.dim = blocks, dim
        sums = self._exact_sums()
        self.n, self.sums = sums.pop(), sums
        self.centred = Centre(self.n, sums) if self.n else None

    def _exact_sums(self) -> list[int]:
        """Sum of each dimension, then the number of rows."""
        dim = self.dim

        def run(batches):
            sums = [0] * (dim + 1)
            for base, above in _stored(batches, dim):
                rows = _whole(base, above)
                safe = int(np.abs(rows.astype(float)).max()) < 2**62 // len(rows)
                own = (rows if safe else rows.astype(object)).sum(axis=0)
                sums = [a + int(b) for a, b in zip(sums, [*own, len(rows)])]
            yield pa.RecordBatch.from_pydict({"i": list(range(dim + 1)), "s": [str(s) for s in sums]})

        parts = self.blocks.mapInArrow(run, "i long, s string")
        found = parts.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
        sums = {r.i: int(r.s) for r in found}
        return [sums.get(i, 0) for i in range(dim + 1)]

    def total(self, fn: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """Sum over all blocks of ``fn`` of the centred rows, an array of ``size`` doubles.

        A task adds up its blocks; the tasks' sums are added by a shuffle, so the driver
        receives one array whatever the number of tasks.
        """
        dim, centred = self.dim, self.centred

        def run(batches):
            out = np.zeros(size)
            for base, above in _stored(batches, dim):
                out += fn(centred.block(base, above))
            yield pa.RecordBatch.from_pydict({"i": np.arange(size), "s": out})

        parts = self.blocks.mapInArrow(run, "i long, s double")
        out = np.zeros(size)
        for r in parts.groupBy("i").agg(F.sum("s").alias("s")).collect():
            out[r.i] = r.s
        return out


def fit_list(vectors: DataFrame, column: str, dim: int) -> FitList:
    """Each distinct vector once, written out in blocks that are dealt evenly."""
    distinct = vectors.select(column).distinct()
    blocks = distinct.mapInArrow(_pack, "base long, width int, data binary")
    return FitList(materialize(blocks.repartition(shuffle_partitions(vectors)), "fitlist"), dim)


def _orthogonal(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    if basis:
        q = np.array(basis)
        for _ in range(2):
            v = v - q.T @ (q @ v)
    return v


def bidiagonalise(fit: FitList, k: int, seed: int = SEED):
    """(right vectors as rows, bidiagonal matrix) that hold the k leading singular triplets.

    Each step takes X v, then X'u. Left vectors are made orthogonal to all before them by
    distributed products, twice; right ones on the driver, twice. When the k leading triplets
    stand, a random start orthogonal to all right vectors goes on until it changes nothing, so
    that equal singular values are found as often as they occur; so it does when a step ends in
    a space that X keeps to itself. After as many steps as dimensions nothing is left to find.
    """
    dim, rng = fit.dim, np.random.default_rng(seed)
    start = rng.normal(size=dim)
    right, w, products, alphas, betas = [start / np.linalg.norm(start)], [], [], [], []
    scale, beta, found = 0.0, 0.0, None
    while True:
        v = right[-1]
        s = v - beta * w[-1] if w else v
        left = np.array(w).reshape(-1, dim)
        if w:
            s = s - left.T @ (left @ fit.total(lambda x, s=s: x.T @ (x @ s), dim))

        def products_of(x, s=s):
            u = x @ s
            return np.append(x.T @ u, u @ u)

        *back, square = fit.total(products_of, dim + 1)
        again = left @ back  # what u still has of earlier left vectors
        alpha = math.sqrt(max(0.0, square - again @ again))
        scale = max(scale, alpha)
        if alpha > scale * dim * 1e-15:
            w.append((s - left.T @ again) / alpha)
            products.append((back - np.array(products).reshape(-1, dim).T @ again) / alpha)
        else:
            alpha = 0.0
            w.append(np.zeros(dim))
            products.append(np.zeros(dim))
        alphas.append(alpha)
        if len(right) == dim:
            break
        after = _orthogonal(products[-1] - alpha * v, right)
        beta = float(np.linalg.norm(after))
        matrix = np.diag(alphas) + np.diag(betas, 1)
        p, sigma, _ = np.linalg.svd(matrix)
        open_ = beta * np.abs(p[-1, :k]) > TOLERANCE * max(sigma[0], 1e-300)
        if len(sigma) >= k and not open_.any():
            if found is not None and np.allclose(found, sigma[:k], rtol=1e-13, atol=0):
                break
            found, beta = sigma[:k], 0.0
        if beta <= scale * dim * 1e-15:
            beta, after = 0.0, _orthogonal(rng.normal(size=dim), right)
        betas.append(beta)
        right.append(after / np.linalg.norm(after))
    return np.array(right), np.diag(alphas) + np.diag(betas, 1)


class Whitening:
    """Components of a fit list, and vectors in their terms."""

    def __init__(self, fit: FitList, k: int):
        self.fit = fit
        self.trace = float(fit.total(lambda x: np.array([(x * x).sum()]), 1)[0]) / fit.n
        right, matrix = bidiagonalise(fit, min(k, fit.dim))
        _, sigma, turned = np.linalg.svd(matrix)
        few = sigma[:k] > sigma[0] * max(fit.dim, 1) * 1e-15
        axes = (turned @ right)[:k][few]
        self.components = axes / np.linalg.norm(axes, axis=1)[:, None]
        self.deviations = sigma[:k][few] / math.sqrt(fit.n)
        self.explained = self.deviations**2 / self.trace if self.trace else self.deviations
        self.turn = (self.components / self.deviations[:, None]).T
        self.identity_error = self._identity_error() if len(self.deviations) else 0.0

    def _identity_error(self) -> float:
        turn, n, k = self.turn, self.fit.n, len(self.deviations)
        mean = self.fit.total(lambda x: (x @ turn).sum(axis=0), k) / n

        def covariance(x):
            y = x @ turn - mean
            return (y.T @ y).ravel()

        found = self.fit.total(covariance, k * k).reshape(k, k) / n
        return float(np.abs(found - np.eye(k)).max())

    def rows(self, rows: np.ndarray) -> tuple[list[int | None], np.ndarray]:
        """Deviation from the mean, exact and n^2 times the square, and whitened values."""
        n, sums = self.fit.n, self.fit.sums
        most = max(abs(n * int(v) - s) for v, s in zip([*rows.min(axis=0), *rows.max(axis=0)], [*sums, *sums]))
        if most * most * len(sums) < 1 << 63 and max(map(abs, sums)) < 1 << 62:
            apart = n * rows - np.array(sums, dtype=np.int64)
            deviations = (apart * apart).sum(axis=1).tolist()
        else:
            exact = (sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in rows.tolist())
            deviations = [d if d < 1 << 63 else None for d in exact]
        return deviations, self.fit.centred(rows) @ self.turn


def integers(column: str, scale: int, shift: int) -> Column:
    """Components as floor(scale * x) + shift; null if any is null or not finite."""
    whole = F.transform(column, lambda x: F.floor(scale * x.cast("double")).cast("long") + shift)
    return F.when(finite(column), whole)


def _common_dim(rows: DataFrame) -> int | None:
    sizes = rows.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n"))
    first = sizes.orderBy(F.desc("n"), F.desc("dim")).first()
    return None if first is None else first.dim


def whiten(vectors: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error).

    ``vectors`` has vec_id and x, an array of longs. Each distinct vector counts once in the
    mean and covariance, so copies weigh nothing. Components are numbered from 1 by falling
    variance; there are k at most, and none without variance. Every row comes back for each
    component, repeated rows and null ids too. n is the number of distinct vectors; deviation
    the sum of (n * x - sum)^2, null beyond a long; explained the share of all variance;
    identity_error the largest absolute entry of the covariance of whitened vectors minus the
    identity.

    Rows with a null or empty vector take no part, nor vectors that have another length than
    most. No rows, or a single distinct vector, give none. Other columns are ignored. The driver
    holds a few vectors for each step of the bidiagonalisation, at most as many as dimensions,
    and tasks a block of rows.
    """
    schema = (
        "vec_id long, n long, deviation long, whitened array<double>, explained array<double>, "
        "identity_error double"
    )
    rows = vectors.where("x IS NOT NULL AND size(x) > 0").select(F.col("vec_id").cast("long"), "x")
    dim = _common_dim(rows)
    if dim is None:
        empty = vectors.sparkSession.createDataFrame([], schema)
        return _by_component(empty)
    rows = rows.where(F.size("x") == dim)
    model = Whitening(fit_list(rows, "x", dim), k)
    n, error, shares = model.fit.n, model.identity_error, model.explained.tolist()

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            deviations, whitened = model.rows(_matrix(batch.column(1)))
            count = batch.num_rows
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array([n] * count, pa.int64()),
                    pa.array(deviations, pa.int64()),
                    pa.array(list(whitened), pa.list_(pa.float64())),
                    pa.array([shares] * count, pa.list_(pa.float64())),
                    pa.array([error] * count, pa.float64()),
                ],
                ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    model.fit.blocks = None  # tasks need the numbers only
    return _by_component(rows.mapInArrow(run, schema))


def _by_component(rows: DataFrame) -> DataFrame:
    each = F.explode(F.arrays_zip("whitened", "explained", F.sequence(F.lit(1), F.size("whitened")).alias("i")))
    return rows.where("size(whitened) > 0").select("*", each.alias("c")).select(
        "vec_id", F.col("c.i").alias("component"), "n", "deviation",
        F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error",
    )

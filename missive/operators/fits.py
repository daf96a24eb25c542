"""Linear models on sparse rows, fitted in batches: one pass over the rows serves all models at once.

Rows have ``idx`` and ``val``, the places and values of their features, ``y`` (0 or 1) and any fold
columns. A pass sums losses and gradients of all models in each task; the sums (features x models,
bounded by the vocabulary's cap and the number of settings) are added up in blocks and reach the
driver, which takes the next limited-memory quasi-Newton step of every model. Fitted models are plain arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missive.sources.scratch import written

#: Feature values that a task works on at once; numbers in a block of sums; bytes that tasks may send to the driver directly.
CHUNK, BLOCK, DIRECT_BYTES = 1 << 17, 1 << 16, 64 << 20
#: Steps remembered, passes at most, and the gradient's length at which a model is done.
MEMORY, PASSES, TOLERANCE = 8, 300, 3e-4


@dataclass(frozen=True)
class Problem:
    """A loss, its weight C against half the squared length of the weights, and the folds left out.

    balanced: rows count n / (classes * n_class); penalized_bias: the bias adds to the length too.
    """

    loss: str = "logistic"
    c: float = 1.0
    balanced: bool = True
    left_out: tuple[tuple[str, int], ...] = ()
    penalized_bias: bool = False


@dataclass
class Sparse:
    """Some rows: where each value belongs, and the rows' other columns."""

    row: np.ndarray
    idx: np.ndarray
    val: np.ndarray
    n: int
    other: dict[str, np.ndarray]

    def times(self, weights: np.ndarray) -> np.ndarray:
        """rows x columns of weights (features x columns)."""
        out = np.empty((self.n, weights.shape[1]))
        for j in range(weights.shape[1]):
            out[:, j] = np.bincount(self.row, weights=self.val * weights[self.idx, j], minlength=self.n)
        return out

    def back(self, numbers: np.ndarray, size: int) -> np.ndarray:
        """The transposed product: features x columns of numbers (rows x columns)."""
        out = np.empty((size, numbers.shape[1]))
        for j in range(numbers.shape[1]):
            out[:, j] = np.bincount(self.idx, weights=self.val * numbers[self.row, j], minlength=size)
        return out


def sparse(idx: pa.Array, val: pa.Array, other: dict[str, np.ndarray]) -> Sparse:
    counts = pc.fill_null(pc.list_value_length(idx), 0).to_numpy(zero_copy_only=False)
    return Sparse(np.repeat(np.arange(len(counts)), counts), idx.flatten().to_numpy(zero_copy_only=False), val.flatten().to_numpy(zero_copy_only=False), len(counts), other)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Sparse]:
    held, n = [], 0

    def chunk() -> Sparse:
        t = pa.Table.from_batches(held).combine_chunks()
        other = {c: t.column(c).to_numpy() for c in t.column_names if c not in ("idx", "val")}
        return sparse(t.column("idx").combine_chunks(), t.column("val").combine_chunks(), other)

    for batch in batches:
        held.append(batch)
        n += len(batch.column("idx").flatten()) + batch.num_rows
        if n >= CHUNK:
            yield chunk()
            held, n = [], 0
    if held:
        yield chunk()


def tasks(rows: DataFrame) -> int:
    """In how many tasks rows are read."""
    return rows.rdd.getNumPartitions()


def summed(rows: DataFrame, size: int, add: Callable[[Sparse, np.ndarray], None], n_parts: int = 0) -> np.ndarray:
    """The sum over all rows of what ``add`` adds to an array of so many numbers."""
    parts = n_parts or tasks(rows)
    direct = parts * size * 8 <= DIRECT_BYTES
    lanes = 1 if direct else max(1, min(32, parts // 64))  # first sums of tasks, then of lanes

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        seen = False
        for chunk in _chunks(batches):
            add(chunk, total)
            seen = True
        if seen:
            lane, starts = TaskContext.get().partitionId() % lanes, range(0, size, BLOCK)
            yield from batches_of((k, lane, total[a : a + BLOCK]) for k, a in enumerate(starts))

    def batches_of(found) -> Iterator[pa.RecordBatch]:
        for k, lane, numbers in found:
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([lane], pa.int32()), pa.array([numbers.tobytes()], pa.binary())], names=["block", "lane", "numbers"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, lane, raw in zip(*(c.to_pylist() for c in batch.columns)):
                numbers = np.frombuffer(raw)
                found[k, lane] = found[k, lane] + numbers if (k, lane) in found else numbers
        yield from batches_of((k, lane, v) for (k, lane), v in found.items())

    schema = "block int, lane int, numbers binary"
    sums = rows.mapInArrow(own, schema)
    if not direct:
        sums = sums.repartition("block", "lane").mapInArrow(together, schema)
        if lanes > 1:
            sums = sums.withColumn("lane", F.lit(0)).repartition("block").mapInArrow(together, schema)
    total = np.zeros(size)
    for r in sums.collect():  # bounded: the numbers of one array, or DIRECT_BYTES
        part = np.frombuffer(r["numbers"])
        total[r["block"] * BLOCK : r["block"] * BLOCK + len(part)] += part
    return total


@dataclass
class Models:
    """weights: features + 1 (the bias) x models."""

    weights: np.ndarray

    def margins(self, df: DataFrame, out: str = "margins") -> DataFrame:
        """df with an array of each row's margins, one number for each model."""
        weights = self.weights

        def run(idx: pa.Array, val: pa.Array) -> pa.Array:
            z = sparse(idx, val, {}).times(weights[:-1]) + weights[-1]
            return pa.FixedSizeListArray.from_arrays(pa.array(z.ravel()), z.shape[1]).cast(pa.list_(pa.float64()))

        run.__annotations__ = {"idx": pa.Array, "val": pa.Array, "return": pa.Array}
        return df.withColumn(out, F.arrow_udf(run, "array<double>")("idx", "val"))


def n_features(rows: DataFrame) -> int:
    return (rows.agg(F.max(F.array_max("idx"))).first()[0] or 0) + 1


def _seen(chunk: Sparse, problems: list[Problem]) -> np.ndarray:
    """rows x models: does the model learn from the row?"""
    out = np.ones((chunk.n, len(problems)), bool)
    for j, p in enumerate(problems):
        for column, fold in p.left_out:
            out[:, j] &= chunk.other[column] != fold
    return out


def _class_weights(rows: DataFrame, problems: list[Problem], columns: list[str]) -> np.ndarray:
    """models x (weight of class 0, of class 1)."""
    counts = rows.groupBy("y", *columns).agg(F.count(F.lit(1)).alias("n")).collect()  # two rows for each pair of folds
    out = np.ones((len(problems), 2))
    for j, p in enumerate(problems):
        n = np.zeros(2)
        for r in counts:
            if all(r[c] != k for c, k in p.left_out):
                n[int(r["y"])] += r["n"]
        if p.balanced:
            out[j] = n.sum() / (max(1, (n > 0).sum()) * np.maximum(n, 1))
    return out


def _loss(kind: np.ndarray, sign: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss and its slope in the margin; kind tells the models of logistic loss from those of squared hinge."""
    m = sign[:, None] * z
    hinge = np.maximum(0, 1 - m)
    losses = np.where(kind, np.logaddexp(0, -m), hinge * hinge)
    slopes = np.where(kind, -1 / (1 + np.exp(np.minimum(m, 700))), -2 * hinge)
    return losses, slopes * sign[:, None]


class Steps:
    """Limited-memory BFGS for one model: the direction at a point, and whether a trial point is taken."""

    def __init__(self, size: int):
        self.x, self.f, self.g = np.zeros(size), np.inf, np.zeros(size)
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.direction, self.length, self.done = np.zeros(size), 1.0, False

    def trial(self) -> np.ndarray:
        return self.x + self.length * self.direction

    def take(self, f: float, g: np.ndarray) -> None:
        """Value and gradient at the trial point."""
        if np.isfinite(self.f) and not f <= self.f + 1e-4 * self.length * (self.g @ self.direction) + 1e-12 * abs(self.f):
            self.length /= 2
            self.done = self.length < 1e-8
            return
        if np.isfinite(self.f):
            s, d = self.length * self.direction, g - self.g
            if s @ d > 1e-12 * (d @ d):
                self.pairs = [*self.pairs[1 - MEMORY :], (s, d)]
        self.x, self.f, self.g = self.trial(), f, g
        self.done = np.linalg.norm(g) <= TOLERANCE
        q, alphas = g.copy(), []
        for s, d in reversed(self.pairs):
            alphas.append((s @ q) / (s @ d))
            q -= alphas[-1] * d
        if self.pairs:
            s, d = self.pairs[-1]
            q *= (s @ d) / (d @ d)
        else:
            q /= max(1.0, np.linalg.norm(q))
        for (s, d), a in zip(self.pairs, reversed(alphas)):
            q += s * (a - (d @ q) / (s @ d))
        self.direction, self.length = -q, 1.0


def fit(rows: DataFrame, problems: list[Problem], size: int | None = None) -> Models:
    """One model for each problem; ``rows`` should be a written table, since each pass reads it."""
    columns = sorted({c for p in problems for c, _ in p.left_out})
    rows = rows.select("y", "idx", "val", *columns)
    size, parts = size or n_features(rows), tasks(rows)
    shares = _class_weights(rows, problems, columns)
    steps = [Steps(size + 1) for _ in problems]
    for _ in range(PASSES):
        active = [j for j, s in enumerate(steps) if not s.done]
        if not active:
            break
        some = [problems[j] for j in active]
        at = np.stack([steps[j].trial() for j in active], axis=1)
        kind = np.array([p.loss == "logistic" for p in some])
        share, n = shares[active], len(active)

        def add(chunk: Sparse, total: np.ndarray) -> None:
            y = chunk.other["y"]
            losses, slopes = _loss(kind, 2 * y - 1, chunk.times(at[:-1]) + at[-1])
            weight = _seen(chunk, some) * share[:, y.astype(int)].T
            slopes *= weight
            total[:n] += (losses * weight).sum(axis=0)
            total[n : 2 * n] += slopes.sum(axis=0)
            total[2 * n :] += chunk.back(slopes, size).ravel()

        total = summed(rows, n * (size + 2), add, parts)
        slopes = total[2 * n :].reshape(size, n)
        for k, (j, p) in enumerate(zip(active, some)):
            w = at[:, k].copy()
            w[-1] *= p.penalized_bias
            g = np.append(slopes[:, k], total[n + k]) * p.c + w
            steps[j].take(p.c * total[k] + w @ w / 2, g)
    return Models(np.stack([s.x for s in steps], axis=1))


def fit_sigmoids(rows: DataFrame, models: Models, problems: list[Problem]) -> np.ndarray:
    """models x (slope, intercept): logistic fits of each model's margins on the last fold that it leaves out.

    Targets are smoothed: (n1 + 1) / (n1 + 2) and 1 / (n0 + 2). Newton steps, a pass for all models each.
    """
    columns = sorted({c for p in problems for c, _ in p.left_out})
    m = len(problems)
    rows = models.margins(rows.select("y", "idx", "val", *columns))
    rows = written(rows.select("y", *columns, F.sequence(F.lit(0), F.lit(m - 1)).alias("idx"), F.col("margins").alias("val")))
    parts = tasks(rows)

    def held(chunk: Sparse) -> np.ndarray:
        out = np.empty((chunk.n, m), bool)
        for j, p in enumerate(problems):
            *others, (column, fold) = p.left_out
            out[:, j] = chunk.other[column] == fold
            for c, k in others:
                out[:, j] &= chunk.other[c] != k
        return out

    def count(chunk: Sparse, total: np.ndarray) -> None:
        mine = held(chunk)
        total[:m] += mine[chunk.other["y"] == 1].sum(axis=0)
        total[m:] += mine[chunk.other["y"] != 1].sum(axis=0)

    n1, n0 = summed(rows, 2 * m, count, parts).reshape(2, m)
    high, low = (n1 + 1) / (n1 + 2), 1 / (n0 + 2)

    def value(at: np.ndarray) -> np.ndarray:
        def add(chunk: Sparse, total: np.ndarray) -> None:
            x, y = chunk.val.reshape(chunk.n, m), chunk.other["y"] == 1
            mine = held(chunk).astype(float)
            z = x * at[0] + at[1]
            target = np.where(y[:, None], high, low)
            p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            h = mine * p * (1 - p)
            sums = [mine * (np.logaddexp(0, z) - target * z), mine * (p - target) * x, mine * (p - target), h * x * x, h * x, h]
            total += np.concatenate([s.sum(axis=0) for s in sums])

        return summed(rows, 6 * m, add, parts).reshape(6, m)

    x = np.stack([np.zeros(m), np.log((n1 + 1) / (n0 + 1))])
    found, step = value(x), None
    for _ in range(50):
        f, ga, gb, haa, hab, hbb = found
        haa, hbb = haa + 1e-10, hbb + 1e-10
        det = haa * hbb - hab * hab
        step = np.stack([hbb * ga - hab * gb, haa * gb - hab * ga]) / np.where(det > 0, det, 1)
        if np.abs(step).max(initial=0) < 1e-7:
            break
        length = np.ones(m)
        for _ in range(20):
            trial = value(x - length * step)
            worse = trial[0] > f + 1e-12 * np.abs(f)
            if not worse.any():
                break
            length[worse] /= 2
        x, found = x - length * step, trial
    none = n1 + n0 == 0
    x[:, none] = [[1.0], [0.0]]
    return x.T


def singular(rows: DataFrame, k: int, rounds: int = 5, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The k largest singular values of rows (idx, val), and their right vectors (features x k).

    A random subspace is turned by the matrix and its transpose some rounds (one pass each), then decomposed.
    """
    rows = rows.select("idx", "val")
    size, parts = n_features(rows), tasks(rows)
    wide = min(size, k + 20)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, wide)))[0]
    for _ in range(rounds):
        at = q

        def turn(chunk: Sparse, total: np.ndarray) -> None:
            total += chunk.back(chunk.times(at), size).ravel()

        q = np.linalg.qr(summed(rows, size * wide, turn, parts).reshape(size, wide))[0]

    def square(chunk: Sparse, total: np.ndarray) -> None:
        x = chunk.times(q)
        total += (x.T @ x).ravel()

    values, vectors = np.linalg.eigh(summed(rows, wide * wide, square, parts).reshape(wide, wide))
    order = np.argsort(-values)[:k]
    return np.sqrt(np.maximum(values[order], 0)), q @ vectors[:, order]

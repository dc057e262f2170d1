"""G7m: the cross-calibrated classifier of the largest margin, over many rows.

The linear classifiers of all calibration parts see the same mapped rows, each without its
own part.  Rows are mapped once and held as matrices, and all classifiers are fitted together,
so their sum is minimised, that is each of them: the objective and the scale of the columns are
those of the library's ``LinearSVC``.  A pass takes many small steps (Adam), as many tasks
as run at a time side by side, and averages where they end; the next pass goes on with a smaller rate
where the objective over all rows did not fall.  Each classifier's decision values on its own part
are then calibrated by a logistic fit (Platt, L-BFGS).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, functions as F

from mailspark.operators.network import MEANS, _added, descend

#: passes and steps at most; rows of a small step, its rate at first and at last, and the share by which a pass is to lower the objective
STEPS, STEP_ROWS, RATE, LEAST_RATE, GAIN = 100, 200, 0.01, 0.0005, 2e-3


def blocks(rows: DataFrame, cols: list[str], to) -> RDD:
    """``rows(label, fold, cols)`` as (mapped values and a one, +1 or -1, fold) matrices, kept where they are."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in cols])
                z = np.column_stack([to(x), np.ones(len(x))]).astype(np.float32)
                y, f = (batch.column(c).cast(pa.int64()).to_numpy(zero_copy_only=False) for c in ("label", "fold"))
                yield pa.RecordBatch.from_pydict({"z": [z.tobytes()], "y": [np.where(y > 0, 1, -1).astype(np.float32).tobytes()],
                                                  "f": [f.astype(np.int32).tobytes()]})

    def matrices(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        y = np.frombuffer(row.y, dtype=np.float32)
        return np.frombuffer(row.z, dtype=np.float32).reshape(len(y), -1), y, np.frombuffer(row.f, dtype=np.int32)
    return rows.select("label", "fold", *cols).mapInArrow(run, "z binary, y binary, f binary").rdd.map(matrices).persist(StorageLevel.MEMORY_AND_DISK)


def _moments(rdd: RDD, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of every part, and the standard deviations of the columns."""
    def of_task(held):
        n, s, q = np.zeros(k), 0.0, 0.0
        for z, _, f in held:
            wide = z.astype(np.float64)
            n, s, q = n + np.bincount(f, minlength=k), s + wide.sum(axis=0), q + (wide * wide).sum(axis=0)
        return n, s, q
    n, s, q = _added(rdd, of_task)
    return n, np.sqrt(np.maximum(q / n.sum() - (s / n.sum()) ** 2, 0.0))


def hinge(rdd: RDD, k: int, by: np.ndarray, c: float, rows: np.ndarray):
    """weights of all classifiers -> (sum of their objectives, its gradient): one pass.  The weights are those
    of columns times ``by``; the last column is the intercept."""
    rows = rows.sum() - rows

    def at(flat: np.ndarray) -> tuple[float, np.ndarray]:
        w = flat.reshape(k, -1) * by
        sent = w.astype(np.float32)

        def of_task(held):
            loss, grad = np.zeros(k), np.zeros(w.shape)
            for z, y, f in held:
                short = 1.0 - y[:, None] * (z @ sent.T)
                short[(f[:, None] == np.arange(k)) | (short < 0)] = 0.0
                loss += short.sum(axis=0, dtype=np.float64)
                grad -= (np.where(short > 0, y[:, None], np.float32(0)).T @ z).astype(np.float64)
            return loss, grad
        loss, grad = _added(rdd, of_task)
        length = w.copy()
        length[:, -1] = 0.0
        total = loss / rows + (length * length).sum(axis=1) / (2 * c * rows)
        return float(total.sum()), ((grad / rows[:, None] + length / (c * rows[:, None])) * by).ravel()
    return at


def _small_steps(rdd: RDD, state: tuple, k: int, by: np.ndarray, c: float, rows: np.ndarray, rate: float) -> tuple:
    """Weights, means of gradient and square, steps so far after a pass of small steps."""
    rows = rows.sum() - rows

    def of_task(held):
        n, (w, m, v), t = 0, (np.array(a) for a in state[:3]), state[3]
        pull = np.where(np.arange(len(by)) < len(by) - 1, by * by, 0.0) / (c * rows[:, None])
        for z, y, f in held:
            order = np.random.default_rng([n, len(y)]).permutation(len(y))
            for at in np.array_split(order, max(1, len(y) // STEP_ROWS)):
                x, sign, own = z[at] * by.astype(np.float32), y[at][:, None], f[at][:, None] == np.arange(k)
                short = (sign * (x @ w.astype(np.float32).T) < 1) & ~own
                grad = pull * w - (np.where(short, sign, np.float32(0)).T @ x) / np.maximum(1, (~own).sum(axis=0))[:, None]
                t += 1
                m += (1 - MEANS[0]) * (grad - m)
                v += (1 - MEANS[1]) * (grad * grad - v)
                w -= rate * (m / (1 - MEANS[0] ** t)) / (np.sqrt(v / (1 - MEANS[1] ** t)) + 1e-8)
            n += len(y)
        return n, n * w, n * m, n * v, n * t
    n, *sums = _added(rdd, of_task)
    return tuple(a / n for a in sums)


def _platt(rdd: RDD, w: np.ndarray, k: int) -> np.ndarray:
    """Slope and intercept for the decision values of each classifier on its own part."""
    sent = w.astype(np.float32)

    def decided(block):
        z, y, f = block
        return (z @ sent.T)[np.arange(len(f)), f].astype(np.float64), y, f
    own = rdd.map(decided).persist(StorageLevel.MEMORY_AND_DISK)

    def at(flat: np.ndarray) -> tuple[float, np.ndarray]:
        of = flat.reshape(k, 2)

        def of_task(held):
            n, loss, grad = np.zeros(k), np.zeros(k), np.zeros((k, 2))
            for d, y, f in held:
                m = y * (of[f, 0] * d + of[f, 1])
                n, loss = n + np.bincount(f, minlength=k), loss + np.bincount(f, np.logaddexp(0.0, -m), k)
                slope = -y * np.exp(-np.logaddexp(0.0, m))
                grad = grad + np.column_stack([np.bincount(f, slope * d, k), np.bincount(f, slope, k)])
            return n, loss, grad
        n, loss, grad = _added(own, of_task)
        n = np.maximum(n, 1.0)
        return float((loss / n).sum()), (grad / n[:, None]).ravel()
    of, _ = descend(at, np.tile([1.0, 0.0], k), STEPS)
    own.unpersist()
    return of.reshape(k, 2)


def fit(rows: DataFrame, cols: list[str], to, k: int, c: float):
    """matrix of ``cols`` -> probabilities of class 1, means over the classifiers of the ``k`` parts ``fold`` of ``rows``."""
    rdd = blocks(rows, cols, to)
    n, spread = _moments(rdd, k)
    by = np.where(spread > 0, 1.0 / np.where(spread > 0, spread, 1.0), 0.0)
    by[-1] = 1.0
    objective, dealt = hinge(rdd, k, by, c, n), rdd.coalesce(rows.sparkSession.sparkContext.defaultParallelism)
    state, rate = (*(np.zeros((k, len(by))) for _ in range(3)), 0.0), RATE
    best, w = objective(state[0].ravel())[0], state[0]
    for _ in range(STEPS):
        state = _small_steps(dealt, state, k, by, c, n, rate)
        value = objective(state[0].ravel())[0]
        if value > (1 - GAIN) * best:
            rate /= 3
        if value < best:
            best, w = value, state[0]
        if rate < LEAST_RATE:
            break
    w = w * by
    of = _platt(rdd, w, k)
    rdd.unpersist()

    def probability(x: np.ndarray) -> np.ndarray:
        d = to(x) @ w[:, :-1].T + w[:, -1]
        return np.exp(-np.logaddexp(0.0, -(d * of[:, 0] + of[:, 1]))).mean(axis=1)
    return probability

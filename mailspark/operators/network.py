"""G9m: training of a feed-forward network (logistic hidden layers, softmax) over all rows.

Training rows are held as matrices, one a batch.  A pass sends the weights to
the tasks; each sums loss and gradient over its matrices and Spark adds the sums.
The driver holds the weights and the last few steps only (L-BFGS).  Over many rows,
whose every part shows the way, a pass is many small steps instead (Adam): each task takes
them over its matrices, and the states that the tasks end with are averaged.  Start,
layout of the weights and tests of convergence are those of the library's
``MultilayerPerceptronClassifier``, which the weights become a model of.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

#: relative change of the loss at which the library stops, and steps that L-BFGS remembers
TOL, MEMORY = 1e-6, 10
#: rows of a matrix that go through the layers at a time, and tasks whose sums the driver adds itself
ROWS, FEW_TASKS = 256, 64
#: rows of a small step, its rate, and how long its means of the gradient and of its square last
STEP_ROWS, RATE, MEANS = 200, 0.003, (0.9, 0.999)


def blocks(rows: DataFrame) -> RDD:
    """``rows(label, features)`` as (features, labels) matrices, kept where they are."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({
                    "x": [batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64).tobytes()],
                    "y": [batch.column("y").to_numpy(zero_copy_only=False).astype(np.int64).tobytes()]})

    held = rows.select(F.col("label").cast("long").alias("y"), vector_to_array("features").alias("x")).mapInArrow(run, "x binary, y binary")

    def matrices(row) -> tuple[np.ndarray, np.ndarray]:
        y = np.frombuffer(row.y, dtype=np.int64)
        return np.frombuffer(row.x).reshape(len(y), -1), y
    return held.rdd.map(matrices).persist(StorageLevel.MEMORY_AND_DISK)


def _layers(weights: np.ndarray, layers: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for n_in, n_out in zip(layers, layers[1:]):
        out.append((weights[at:at + n_in * n_out].reshape(n_in, n_out), weights[at + n_in * n_out:at + (n_in + 1) * n_out]))
        at += (n_in + 1) * n_out
    return out


def _forward(x: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Values of all layers, the last one before its softmax."""
    seen = [x]
    for n, (m, b) in enumerate(parts, 1):
        z = seen[-1] @ m
        z += b
        if n < len(parts):
            with np.errstate(over="ignore"):
                np.exp(np.negative(z, out=z), out=z)
            z += 1.0
            np.reciprocal(z, out=z)
        seen.append(z)
    return seen


def gradient(x: np.ndarray, y: np.ndarray, weights: np.ndarray, layers: list[int]) -> tuple[float, np.ndarray]:
    """Sums over the rows of the cross entropy and of its gradient."""
    if len(y) and not 0 <= y.min() <= y.max() < layers[-1]:
        raise ValueError("a label is no class of the network")
    parts, loss, total = _layers(weights, layers), 0.0, np.zeros(len(weights))
    sums = _layers(total, layers)
    for a in range(0, len(x), ROWS):
        seen, of = _forward(x[a:a + ROWS], parts), y[a:a + ROWS]
        z = seen[-1] - seen[-1].max(axis=1, keepdims=True)
        log = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        loss -= float(log[np.arange(len(of)), of].sum())
        delta = np.exp(log)
        delta[np.arange(len(of)), of] -= 1.0
        for n in range(len(parts) - 1, -1, -1):
            sums[n][0][...] += seen[n].T @ delta
            sums[n][1][...] += delta.sum(axis=0)
            if n:
                delta = (delta @ parts[n][0].T) * seen[n] * (1.0 - seen[n])
    return loss, total


def _added(rdd: RDD, of_task) -> tuple:
    """Sums over all tasks of what ``of_task`` makes of their matrices."""
    def run(held):
        yield of_task(held)

    def add(a, b):
        return tuple(i + j for i, j in zip(a, b))
    sums = rdd.mapPartitions(run)
    return sums.reduce(add) if rdd.getNumPartitions() <= FEW_TASKS else sums.treeReduce(add)


def mean_loss(rdd: RDD, layers: list[int]):
    """weights -> (mean loss, its gradient) over all rows: one pass."""
    def at(weights: np.ndarray) -> tuple[float, np.ndarray]:
        def of_task(held):
            n, loss, total = 0, 0.0, np.zeros(len(weights))
            for x, y in held:
                part, grad = gradient(x, y, weights, layers)
                n, loss, total = n + len(y), loss + part, total + grad
            return n, loss, total
        n, loss, total = _added(rdd, of_task)
        if not n:
            raise ValueError("the network needs training rows")
        return loss / n, total / n
    return at


def accuracy(rdd: RDD, weights: np.ndarray, layers: list[int]) -> float:
    """Share of rows whose label has the largest output; 0 without rows."""
    def of_task(held):
        n, right, parts = 0, 0, _layers(weights, layers)
        for x, y in held:
            for a in range(0, len(x), ROWS):
                right += int((_forward(x[a:a + ROWS], parts)[-1].argmax(axis=1) == y[a:a + ROWS]).sum())
            n += len(y)
        return n, right
    n, right = _added(rdd, of_task)
    return right / n if n else 0.0


def descend(loss, weights: np.ndarray, steps: int, tol: float = TOL) -> tuple[np.ndarray, int]:
    """At most ``steps`` steps of L-BFGS; the weights and the steps taken."""
    value, grad = loss(weights)
    start, values, pairs = abs(value), deque([value], maxlen=MEMORY), deque(maxlen=MEMORY)
    for taken in range(steps):
        if np.linalg.norm(grad) <= max(tol * abs(value), 1e-8) or (
                len(values) > 1 and abs(value - sum(values) / len(values)) <= tol * start):
            return weights, taken
        way, shares = -grad, []
        for s, y in reversed(pairs):
            shares.append((s @ way) / (s @ y))
            way = way - shares[-1] * y
        if pairs:
            s, y = pairs[-1]
            way = way * ((s @ y) / (y @ y))
        for (s, y), share in zip(pairs, reversed(shares)):
            way = way + s * (share - (y @ way) / (s @ y))
        slope = grad @ way
        # a step that lowers the loss enough and leaves less slope: halved between the bounds found, else doubled
        step, low, high = 1.0 if pairs else 1.0 / np.linalg.norm(way), 0.0, np.inf
        for _ in range(30):
            new_value, new_grad = loss(weights + step * way)
            if not new_value <= value + 1e-4 * step * slope:
                high = step
            elif new_grad @ way < 0.9 * slope:
                low = step
            else:
                break
            step = (low + high) / 2 if np.isfinite(high) else 2 * step
        else:
            return weights, taken
        pairs.append((step * way, new_grad - grad))
        weights, value, grad = weights + step * way, new_value, new_grad
        values.append(value)
    return weights, steps


def start(weights: np.ndarray) -> tuple:
    """The state of a training by small steps: weights, means of the gradient and of its square, steps so far."""
    return weights, np.zeros_like(weights), np.zeros_like(weights), 0.0


def small_steps(rdd: RDD, state: tuple, layers: list[int], seed: int) -> tuple:
    """The state after a pass over all rows in steps of about ``STEP_ROWS`` rows."""
    def of_task(held):
        n, (w, m, v), t = 0, (np.array(a) for a in state[:3]), state[3]
        for x, y in held:
            # by the place of the matrix: the same in a task that runs again
            order = np.random.default_rng([seed, n, len(y)]).permutation(len(y))
            for at in np.array_split(order, max(1, len(y) // STEP_ROWS)):
                grad = gradient(x[at], y[at], w, layers)[1] / len(at)
                t += 1
                m += (1 - MEANS[0]) * (grad - m)
                v += (1 - MEANS[1]) * (grad * grad - v)
                w -= RATE * (m / (1 - MEANS[0] ** t)) / (np.sqrt(v / (1 - MEANS[1] ** t)) + 1e-8)
            n += len(y)
        return n, n * w, n * m, n * v, n * t
    n, *sums = _added(rdd, of_task)
    if not n:
        raise ValueError("the network needs training rows")
    return tuple(a / n for a in sums)

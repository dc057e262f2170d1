"""G11m: a nu-one-class model over Fourier features, solved over all rows.

The dual of the nu-one-class problem looks for the shortest vector
``w = sum(a_i z_i)`` with weights that add up to one and are at most
``1 / (nu n)`` each.  A round of the solver finds, among all feasible weightings, the
one that lowers the objective fastest: all weight on the ``nu n`` rows with
the smallest scores ``w . z``.  One aggregate gives it: tasks sum the feature
vectors of score bins, Spark adds the sums, and the bin on the border is
taken in part, which keeps the weighting feasible.  The driver then takes the
shortest vector in the hull of all mean vectors found so far (one per round)
and goes on until the duality gap is small.  The offset is the exact
nu-quantile of the training scores.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from mailspark.operators.clean import quantiles

#: score bins of a round below the border that is expected, and rounds at most
BINS, ROUNDS = 128, 40
#: duality gap, as a share of the objective, at which the solver stops
GAP = 1e-2


def _bin_sums(rows: DataFrame, cols: list[str], fourier, w: np.ndarray | None, edges: np.ndarray,
              whole: np.ndarray | None = None) -> list[tuple[int, np.ndarray]]:
    """(rows, sum of features) of every score bin, lowest scores first; rows
    with a null feature are left out.  Where the sum ``whole`` of all rows is known, tasks only
    count the last bin, which has most rows: its sum is what the others leave."""
    def run(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            x = np.column_stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in cols])
            z = fourier(x[~np.isnan(x).any(axis=1)])
            at = np.zeros(len(z), dtype=np.int64) if w is None else np.searchsorted(edges, z @ w, side="right")
            for b in np.unique(at).tolist():
                held, of = sums.setdefault(b, [0, np.zeros(z.shape[1])]), np.flatnonzero(at == b)
                held[0] += len(of)
                if whole is None or b < len(edges):
                    held[1] = held[1] + z[of].sum(axis=0)
        yield pa.RecordBatch.from_pylist([{"bin": b, "n": n, "s": s.tolist()} for b, (n, s) in sums.items()], schema=pa.schema(
            [("bin", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.float64()))]))

    found = rows.select(*cols).mapInArrow(run, "bin int, n bigint, s array<double>").groupBy("bin").agg(
        F.sum("n").alias("n"), Summarizer.sum(array_to_vector(F.col("s"))).alias("s")).collect()
    bins = {r.bin: (r.n, r.s.toArray()) for r in found}
    if whole is not None and len(edges) in bins:
        bins[len(edges)] = bins[len(edges)][0], whole - sum(s for b, (_, s) in bins.items() if b < len(edges))
    return [bins[b] for b in sorted(bins)]


def _shortest(hull: np.ndarray, steps: int = 4000) -> np.ndarray:
    """Shortest vector in the convex hull of a few vectors (pairwise steps)."""
    gram = hull @ hull.T
    weight = np.full(len(hull), 1.0 / len(hull))
    for _ in range(steps):
        grad = gram @ weight
        to, out = int(grad.argmin()), int(np.where(weight > 0, grad, -np.inf).argmax())
        bend = gram[to, to] + gram[out, out] - 2 * gram[to, out]
        if grad[out] - grad[to] <= 1e-12 or bend <= 0:
            break
        move = min(weight[out], (grad[out] - grad[to]) / bend)
        weight[to] += move
        weight[out] -= move
    return weight @ hull


def solve(rows: DataFrame, cols: list[str], nu: float, fourier, rounds: int = ROUNDS, gap: float = GAP) -> tuple[np.ndarray, list[tuple[int, float, float]]]:
    """Weights, and (round, objective, gap) of every round.  ``rows`` are read
    once a round; round 0 is the mean of all features."""
    n, total = next(iter(_bin_sums(rows, cols, fourier, None, np.zeros(0))), (0, None))
    if not n:
        raise ValueError("the one-class model needs rows of class 0")
    w = total / n
    hull, history = [w], []
    for k in range(rounds):
        length = math.sqrt(float(w @ w))
        edges = np.linspace(-math.sqrt(2) * length, length * length + 0.1 * length, BINS + 1)
        left, tail = nu * n, np.zeros_like(w)
        for count, s in _bin_sums(rows, cols, fourier, w, edges, total):
            share = min(1.0, left / count)
            tail, left = tail + share * s, left - share * count
            if left <= 0:
                break
        tail /= nu * n
        open_gap = float(w @ w - w @ tail)
        history.append((k, float(w @ w) / 2, open_gap))
        if open_gap <= gap * float(w @ w):
            break
        hull.append(tail)
        w = _shortest(np.array(hull))
    return w, history


def offset(scored: DataFrame, nu: float) -> float:
    """The exact nu-quantile of ``_s``."""
    return quantiles(scored, ["_s"], nu)["_s"]

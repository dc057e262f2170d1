"""The one-class solver's cosines and bin sums."""

import numpy as np

from mailspark.operators import models as MD
from mailspark.operators import one_class


def test_cosines_equal_numpys():
    z = np.random.default_rng(6).normal(size=(700, 256)) * 40
    z[0, :4] = 0.0, np.pi, -np.pi, 2 * np.pi
    assert np.abs(MD._cosine(z.copy()) - np.cos(z)).max() < 1e-13
    z[1, 0] = np.nan
    assert np.isnan(MD._cosine(z)[1, 0]) and MD._cosine(np.zeros((0, 3))).shape == (0, 3)


def test_sum_of_the_last_bin_is_what_the_others_leave(spark):
    x = np.random.default_rng(7).normal(size=(300, 2))
    rows = spark.createDataFrame([*[tuple(map(float, r)) for r in x], (None, 1.0)], "a double, b double").coalesce(2)
    fourier = MD._fourier(2, 32, 0.5)
    (n, total), = one_class._bin_sums(rows, ["a", "b"], fourier, None, np.zeros(0))
    w = total / n
    edges = np.quantile(fourier(x) @ w, [0.05, 0.1, 0.2])
    old, new = (one_class._bin_sums(rows, ["a", "b"], fourier, w, edges, t) for t in (None, total))
    assert n == 300 and [b[0] for b in new] == [b[0] for b in old] and sum(b[0] for b in new) == 300
    assert all(np.abs(a[1] - b[1]).max() < 1e-9 for a, b in zip(new, old)) and len(new) == 4

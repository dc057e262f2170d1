"""Column -> Column primitives."""

from __future__ import annotations

import functools

from pyspark import SparkContext


def per_context(fn):
    """Memoise a builder of unresolved Column expressions for the active
    SparkContext: the expressions only name columns, so they can be reused
    by every DataFrame; building them costs thousands of JVM calls."""
    cache: dict = {}

    @functools.wraps(fn)
    def wrapper(*args):
        sc = SparkContext._active_spark_context
        key = (id(sc), args)
        if key not in cache:
            if cache and next(iter(cache))[0] != id(sc):
                cache.clear()  # a new context: expressions of the old one are stale
            cache[key] = fn(*args)
        return cache[key]
    return wrapper

"""A keyed bijection of row numbers, for shuffles that need no sort.

A number below ``n`` is two digits in base ``a = ceil(sqrt(n))``.  Four rounds
of a Feistel network mix the digits; the result is a bijection of the numbers
below ``a * a``.  A result of ``n`` or more is mixed again until it is below
``n`` (cycle walking), which leaves a bijection of the numbers below ``n``.
Less than ``2 / sqrt(n)`` of the numbers walk at all, so a fixed number of steps
ends every walk; one that did not would raise an error.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

#: multipliers and modulus of the round function
MULTIPLY, AGAIN, MODULUS = 48_271, 69_621, 2_147_483_647
ROUNDS = 4
WALK = 64


def keys(seed: int, stream: int) -> list[int]:
    """Round keys of a seed's ``stream``."""
    return [(seed * 1_000_003 + stream * 8191 + r * 131_071 + 12_345) % MODULUS for r in range(ROUNDS)]


def base(n: int) -> int:
    return math.isqrt(max(n, 1) - 1) + 1


def shuffled(i: Column, n: int, round_keys: list[int]) -> Column:
    """Where number ``i`` (0 to n - 1) goes."""
    a = F.lit(base(n)).cast("bigint")
    ks = F.array(*[F.lit(k).cast("bigint") for k in round_keys])

    def mix(x: Column) -> Column:
        def one(s: Column, k: Column) -> Column:
            low, high = s % a, F.floor(s / a).cast("bigint")
            return low * a + (high + ((low * MULTIPLY + k) * AGAIN) % MODULUS) % a
        return F.aggregate(ks, x, one)

    walk = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, min(WALK, base(n) ** 2 - n)))), mix(i.cast("bigint")),
                       lambda s, _: F.when(s < n, s).otherwise(mix(s)))
    return F.when(walk < n, walk).otherwise(F.raise_error(F.lit("a cycle walk did not end")).cast("bigint"))


def shuffled_sql(i: str, n: str, round_keys: list[int]) -> str:
    """The same in DuckDB's SQL; ``i`` and ``n`` are expressions."""
    a = f"CAST(ceil(sqrt({n})) AS BIGINT)"

    def mix(x: str) -> str:
        return (f"list_reduce([{x}, {', '.join(map(str, round_keys))}], lambda s, k: (s % {a}) * {a} + "
                f"((s // {a}) + (((s % {a}) * {MULTIPLY} + k) * {AGAIN}) % {MODULUS}) % {a})")
    return f"list_reduce(list_prepend({mix(i)}, range({WALK})), lambda w, j: CASE WHEN w < {n} THEN w ELSE {mix('w')} END)"

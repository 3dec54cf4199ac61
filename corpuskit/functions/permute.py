"""A keyed permutation of 0 .. size-1 as a column expression.

A Feistel network over the mixed base (a, b), a = ceil(sqrt(size)), b =
ceil(size / a): a value is a digit pair and every round adds a keyed function of
one digit to the other, so it can be undone.  The domain a*b exceeds ``size`` by
less than a; a value that lands in the excess is permuted again until it doesn't
(cycle walking), at most once more than the excess holds values.  So every
position of a shuffled buffer follows from the row's own position: no sort, no
shuffle, and the way back is an expression too.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The round function's prime and multipliers (any seed gives its own permutation).
PRIME, SEED_STEP, WINDOW_STEP, ROUND_STEP, MIX = 2_147_483_647, 1_000_003, 7_368_787, 40_503, 48_271
ROUNDS = 6


def base(size: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(0, size - 1)) + 1 if size > 1 else 1)
    return a, max(1, -(-size // a))


def shuffle_key(seed, window) -> Column:
    """The key of one window's permutation, from a seed (number or column) and the window id."""
    s = F.lit(seed) if isinstance(seed, int) else seed
    mod = lambda c, n: F.pmod(c.cast("bigint"), F.lit(n))
    return mod(mod(s, PRIME) * SEED_STEP + mod(window, PRIME) * WINDOW_STEP, PRIME)


def _rounds(x: Column, size: int, key: Column, inverse: bool) -> Column:
    a, b = base(size)

    def mixed(digit: Column, r: Column) -> Column:
        t = (digit + key + (r + 1) * ROUND_STEP) % PRIME
        return (t * t % PRIME * MIX + r) % PRIME

    def step(s: Column, r: Column) -> Column:
        low = s % b
        high = F.floor((s - low) / b)
        add = lambda digit, other, n: F.pmod(digit - mixed(other, r) if inverse else digit + mixed(other, r), F.lit(n))
        return F.when(r % 2 == 0, add(high, low, a) * b + low).otherwise(high * b + add(low, high, b)).cast("bigint")

    order = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)
    return F.aggregate(F.array(*[F.lit(r).cast("bigint") for r in order]), x.cast("bigint"), step)


def permuted(x: Column, size: int, key: Column, inverse: bool = False) -> Column:
    """Where ``x`` (0 .. size-1) goes; with ``inverse`` where it comes from."""
    a, b = base(size)
    out = _rounds(x, size, key, inverse)
    if a * b == size:
        return out
    again = F.sequence(F.lit(1), F.lit(a * b - size))
    return F.aggregate(again, out, lambda s, _: F.when(s < size, s).otherwise(_rounds(s, size, key, inverse)))

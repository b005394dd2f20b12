"""A seeded integer hash that any SQL engine can replay bit for bit.

``xxhash64`` cannot be replayed outside Spark, so sampling, splits and
resampling use this small mixer.  A lane is a linear step modulo a prime, then
the fractional part of a square root (IEEE ``sqrt`` is correctly rounded, so
every engine gets the same bits), twice: 31 bits.  A hash joins two lanes with
different primes and constants to 62 bits, so ids that agree modulo one prime
still differ.  Each stage reads the previous one exactly once, so the expression
stays small wherever the optimizer inlines it, and every product stays below
2**62 (no overflow under ANSI mode, whatever the size of the ids).

Replicates (permutations, bootstrap draws) hash the row once and mix the
replicate number into both lanes; two rows share a draw with a chance of 2**-31,
in each replicate anew.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the mixer.
LANES = (
    (2147483647, 1103515245, 12345, 40503, 48271, 2654435),     # modulus, then the constants of the two steps
    (2147483629, 1140671485, 12820163, 69069, 69621, 1013904),
)
LANE = 2147483648       # output range of a lane (2**31)
RANGE = LANE * LANE     # output range of a hash (2**62)
REP_A, REP_B, REP_C = 1597334677, 1099087573, 747796405


def _frac_sqrt(h: Column) -> Column:
    s = F.sqrt(h.cast("double") + F.lit(0.5))
    return F.floor((s - F.floor(s)) * F.lit(float(LANE))).cast("long")


def _lane(xc: Column, sc: Column, lane: tuple) -> Column:
    p, a1, b1, s1, a3, b3 = lane
    h = F.pmod(F.pmod(xc.cast("long"), F.lit(p)) * F.lit(a1)
               + F.pmod(sc.cast("long"), F.lit(p)) * F.lit(s1) + F.lit(b1), F.lit(p))
    return _frac_sqrt(F.pmod(_frac_sqrt(h) * F.lit(a3) + F.lit(b3), F.lit(p)))


def mix_col(x, seed=0) -> Column:
    """Pseudo-random integer in [0, 2**62) from an integer column and a seed (int or Column)."""
    xc = F.col(x) if isinstance(x, str) else x
    sc = F.lit(int(seed)) if isinstance(seed, int) else seed
    hi, lo = (_lane(xc, sc, lane) for lane in LANES)
    return hi * F.lit(LANE) + lo


def with_mix(df, out: str, x, seed=0):
    """``df`` plus column ``out`` = ``mix_col(x, seed)``."""
    return df.withColumn(out, mix_col(x, seed))


def with_replicate_mix(df, out: str, h: str, rep: str):
    """``df`` plus column ``out`` in [0, 2**31): the draw of replicate ``rep``
    from a row's hash ``h``."""
    p = F.lit(LANES[0][0])
    hi, lo = F.shiftright(h, 31), F.col(h).bitwiseAND(F.lit(LANE - 1))
    rep_mix = F.pmod(F.col(rep).cast("long") * F.lit(REP_A) + F.lit(REP_B), p)
    mixed = F.pmod(F.pmod(hi, p) * rep_mix + F.pmod(lo, p) * F.lit(REP_C) + F.lit(LANES[0][2]), p)
    return df.withColumn(out, _frac_sqrt(F.pmod(_frac_sqrt(mixed) * F.lit(LANES[0][4]) + F.lit(LANES[0][5]), p)))


class ReplicateMix:
    """``with_replicate_mix`` for an array of row hashes, replicate by replicate."""

    def __init__(self, h: np.ndarray):
        p = LANES[0][0]
        self.hi, self.lo = (h >> 31) % p, ((h & (LANE - 1)) % p * REP_C + LANES[0][2]) % p

    def draw(self, rep: int) -> np.ndarray:
        p, a3, b3 = LANES[0][0], LANES[0][4], LANES[0][5]
        return _frac_sqrt_of(_mersenne(_frac_sqrt_of(_mersenne(self.hi * ((rep * REP_A + REP_B) % p) + self.lo)) * a3 + b3))


def _mersenne(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1, for 0 <= x < 2**63."""
    p = LANES[0][0]
    x = (x & p) + (x >> 31)
    x = (x & p) + (x >> 31)
    x[x >= p] -= p
    return x


def _frac_sqrt_of(h: np.ndarray) -> np.ndarray:
    s = np.sqrt(h + 0.5)
    return ((s - np.floor(s)) * float(LANE)).astype(np.int64)


def bucket_col(h, n_buckets: int, bits: int = 62) -> Column:
    """floor(h * n_buckets / 2**bits) of a hash (62 bits) or a draw (31)."""
    top = F.shiftright(h, 31) if bits == 62 else h
    return F.floor(top * F.lit(n_buckets) / F.lit(float(LANE))).cast("long")

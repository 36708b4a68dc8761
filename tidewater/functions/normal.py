"""The normal distribution as column expressions, and Keccak-256 of short keys."""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hart's rational approximation of the normal tail, highest power first.
_ABOVE = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_BELOW = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def density(x: Column, mean: Column, deviation: Column) -> Column:
    z = (x - mean) / deviation
    return F.exp(-0.5 * z * z) / (deviation * math.sqrt(2 * math.pi))


def cumulative(z: Column) -> Column:
    """The share of a standard normal below z, to about 1e-14."""
    a = F.abs(z)
    power = lambda cs: reduce(lambda p, c: p * a + c, cs[1:], F.lit(cs[0]))
    near = power(_ABOVE) / power(_BELOW)
    far = 1 / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / math.sqrt(2 * math.pi)
    tail = F.exp(-0.5 * a * a) * F.when(a < 7.07106781186547, near).otherwise(far)
    return F.when(z > 0, 1 - tail).otherwise(tail)


@F.pandas_udf(T.DoubleType())
def quantile(p: pd.Series) -> pd.Series:
    """The standard normal's value at p, infinite at 0 and 1."""
    at = NormalDist().inv_cdf
    return p.map(lambda x: None if x is None or x != x else at(x) if 0 < x < 1 else math.copysign(math.inf, x - 0.5))


def keccak256(data: bytes) -> bytes:
    """Keccak-256 with the original padding; for the few keys of a query, on the driver."""
    rate, mask = 136, (1 << 64) - 1
    turn = lambda x, n: (x << n % 64 | x >> 64 - n % 64) & mask if n % 64 else x
    padded = bytearray(data + bytes(rate - len(data) % rate))
    padded[len(data)] ^= 0x01
    padded[-1] ^= 0x80
    s = [[0] * 5 for _ in range(5)]
    for at in range(0, len(padded), rate):
        for i in range(rate // 8):
            s[i % 5][i // 5] ^= int.from_bytes(padded[at + 8 * i : at + 8 * i + 8], "little")
        lfsr = 1
        for _ in range(24):
            c = [s[x][0] ^ s[x][1] ^ s[x][2] ^ s[x][3] ^ s[x][4] for x in range(5)]
            s = [[s[x][y] ^ c[x - 1] ^ turn(c[(x + 1) % 5], 1) for y in range(5)] for x in range(5)]
            x, y, held = 1, 0, s[1][0]
            for t in range(24):
                x, y = y, (2 * x + 3 * y) % 5
                held, s[x][y] = s[x][y], turn(held, (t + 1) * (t + 2) // 2)
            s = [[s[x][y] ^ ~s[(x + 1) % 5][y] & mask & s[(x + 2) % 5][y] for y in range(5)] for x in range(5)]
            for j in range(7):
                if lfsr & 1:
                    s[0][0] ^= 1 << (1 << j) - 1
                lfsr = lfsr << 1 ^ (0x171 if lfsr & 0x80 else 0)
    return b"".join(s[i % 5][i // 5].to_bytes(8, "little") for i in range(4))

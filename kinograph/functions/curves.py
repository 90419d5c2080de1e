"""Curves as column expressions: easing, interpolation, snapping, windows, exact frame times."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def smoothstep(lo: Column | float, hi: Column | float, x: Column) -> Column:
    lo, hi = (v if isinstance(v, Column) else F.lit(v) for v in (lo, hi))
    t = clamp((x - lo) / (hi - lo), 0.0, 1.0)
    return t * t * (F.lit(3.0) - F.lit(2.0) * t)


def half_up(x: Column) -> Column:
    """Rounding half towards plus infinity."""
    return F.floor(x + 0.5)


def snap(t: Column, grid: float) -> Column:
    return half_up(t / F.lit(grid)) * F.lit(grid)


def cubic(s: Column, a: float, b: float) -> Column:
    """Cubic Bezier from 0 to 1 with inner control values a and b."""
    r = F.lit(1.0) - s
    return F.lit(3.0) * r * r * s * F.lit(a) + F.lit(3.0) * r * s * s * F.lit(b) + s * s * s


def bezier(u: Column, x1: float = 0.0, y1: float = 0.0, x2: float = 1.0, y2: float = 1.0, steps: int = 8) -> Column:
    """Easing curve with control points (x1, y1), (x2, y2): solves x(s) = u by Newton steps, gives y(s)."""

    def step(s: Column, _: Column) -> Column:
        r = F.lit(1.0) - s
        slope = F.lit(3.0) * r * r * F.lit(x1) + F.lit(6.0) * r * s * F.lit(x2 - x1) + F.lit(3.0) * s * s * F.lit(1.0 - x2)
        return F.when(F.abs(slope) < 1e-6, s).otherwise(clamp(s - (cubic(s, x1, x2) - u) / slope, 0.0, 1.0))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), u, step, lambda s: cubic(s, y1, y2))


def hann(i: Column, n: int) -> Column:
    return F.lit(0.5) * (F.lit(1.0) - F.cos(F.lit(2 * math.pi) * i / F.lit(float(n - 1))))


def hamming(i: Column, n: int) -> Column:
    return F.lit(0.54) - F.lit(0.46) * F.cos(F.lit(2 * math.pi) * i / F.lit(float(n - 1)))


def blackman_harris(i: Column, n: int) -> Column:
    turn = F.lit(2 * math.pi) * i / F.lit(float(n - 1))
    return F.lit(0.35875) - F.lit(0.48829) * F.cos(turn) + F.lit(0.14128) * F.cos(turn * 2) - F.lit(0.01168) * F.cos(turn * 3)


def bessel_i0(x: Column, terms: int = 20) -> Column:
    """Modified Bessel function of order zero by its series."""
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(acc: Column, k: Column) -> Column:
        term = acc["term"] * (x / 2 / k) * (x / 2 / k)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(terms - 1)), start, add, lambda acc: acc["total"])


def kaiser(i: Column, n: int, beta: float = 6.0) -> Column:
    x = F.lit(2.0) * i / F.lit(float(n - 1)) - F.lit(1.0)
    return bessel_i0(F.lit(beta) * F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - x * x))) / bessel_i0(F.lit(beta))


def sinc(x: Column) -> Column:
    return F.when(F.abs(x) < 1e-9, F.lit(1.0)).otherwise(F.sin(F.lit(math.pi) * x) / (F.lit(math.pi) * x))


#: Rates within a hundredth of these count as the exact fractions broadcasters use.
BROADCAST_RATES = {29.97: (30000, 1001), 23.976: (24000, 1001), 59.94: (60000, 1001)}


def rate_fraction(fps: float) -> tuple[int, int]:
    for near, fraction in BROADCAST_RATES.items():
        if abs(fps - near) < 0.01:
            return fraction
    return (int(fps), 1) if float(fps).is_integer() else (round(fps * 1000), 1000)


def frame_micros(frame: Column, fps: float) -> Column:
    """Start of a frame in whole microseconds, in exact integer arithmetic."""
    num, den = rate_fraction(fps)
    return F.call_function("div", frame.cast("long") * F.lit(1_000_000 * den), F.lit(num).cast("long"))


def gcd(a: Column, b: Column, steps: int = 92) -> Column:
    """Greatest common divisor by Euclid's steps; no two longs need more than 92."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    turn = lambda p, _: F.when(p["b"] == 0, p).otherwise(F.struct(p["b"].alias("a"), (p["a"] % p["b"]).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, turn, lambda p: p["a"])


def sign_extend(value: Column, bits: int = 24) -> Column:
    return F.when(value >= 2 ** (bits - 1), value - 2**bits).otherwise(value)


def pcm_int16(x: Column) -> Column:
    """Samples to 16-bit integers: clamped, negative values times 32768, others times 32767, cut towards zero."""
    c = clamp(x, -1.0, 1.0)
    return F.when(c < 0, c * 32768).otherwise(c * 32767).cast("int")

"""Per-pixel colour algebra as column expressions over channels from 0 to 1."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinograph.functions.curves import clamp, smoothstep


def _overlay(a: Column, b: Column) -> Column:
    return F.when(a < 0.5, a * b * 2).otherwise(F.lit(1.0) - (F.lit(1.0) - a) * (F.lit(1.0) - b) * 2)


#: Blend modes: base and blend channel to the mixed channel.
BLENDS: dict[str, Callable[[Column, Column], Column]] = {
    "multiply": lambda a, b: a * b,
    "screen": lambda a, b: F.lit(1.0) - (F.lit(1.0) - a) * (F.lit(1.0) - b),
    "overlay": _overlay,
    "darken": lambda a, b: F.least(a, b),
    "lighten": lambda a, b: F.greatest(a, b),
    "color-dodge": lambda a, b: F.when(b >= 1.0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), a / F.greatest(F.lit(1e-9), F.lit(1.0) - b))),
    "color-burn": lambda a, b: F.when(b <= 0.0, F.lit(0.0)).otherwise(F.lit(1.0) - F.least(F.lit(1.0), (F.lit(1.0) - a) / F.greatest(F.lit(1e-9), b))),
    "hard-light": lambda a, b: _overlay(b, a),
    "soft-light": lambda a, b: F.when(b < 0.5, a * b * 2 + a * a * (F.lit(1.0) - b * 2)).otherwise(F.sqrt(a) * (b * 2 - 1) + a * 2 * (F.lit(1.0) - b)),
    "difference": lambda a, b: F.abs(a - b),
    "exclusion": lambda a, b: a + b - a * b * 2,
    "add": lambda a, b: F.least(F.lit(1.0), a + b),
}


def blend(mode: str, base: Column, top: Column, opacity: float | Column = 1.0) -> Column:
    mixed = BLENDS.get(mode, BLENDS["screen"])(base, top)
    share = opacity if isinstance(opacity, Column) else F.lit(float(opacity))
    return base + (mixed - base) * share


def over(bottom: Column, top: Column, alpha: Column) -> Column:
    return bottom * (F.lit(1.0) - alpha) + top * alpha


#: Fixed values of the standards: luma weights (Kr, Kb) for each colour space.
LUMA = {"bt601": (0.299, 0.114), "bt709": (0.2126, 0.0722), "bt2020": (0.2627, 0.0593)}


def luma(r: Column, g: Column, b: Column, space: str = "bt709") -> Column:
    kr, kb = LUMA[space]
    return r * F.lit(kr) + g * F.lit(1.0 - kr - kb) + b * F.lit(kb)


def yuv_to_rgb(y: Column, u: Column, v: Column, space: str = "bt709", full: bool = False) -> tuple[Column, Column, Column]:
    """8-bit Y, U, V to 8-bit channels, rounded half to even and clamped. Unknown spaces count as BT.709."""
    kr, kb = LUMA.get(space, LUMA["bt709"])
    kg = 1.0 - kr - kb
    light = y / F.lit(255.0) if full else (y - 16) / F.lit(219.0)
    cb, cr = ((c - 128) / F.lit(255.0 if full else 224.0) for c in (u, v))
    red = light + cr * F.lit(2 * (1 - kr))
    blue = light + cb * F.lit(2 * (1 - kb))
    green = light - cb * F.lit(2 * (1 - kb) * kb / kg) - cr * F.lit(2 * (1 - kr) * kr / kg)
    return tuple(clamp(F.rint(c * 255), 0.0, 255.0) for c in (red, green, blue))


def chroma_distance(r: Column, g: Column, b: Column, target: tuple[int, int, int]) -> Column:
    return F.sqrt(sum(((c - t) * (c - t) for c, t in zip((r, g, b), target)), F.lit(0.0)))


def grade(c: Column, grey: Column, lift: float, gamma: float, gain: float, saturation: float) -> Column:
    """Lift, gain and gamma of one channel, then saturation around the graded grey."""

    def tone(x: Column) -> Column:
        return F.pow(F.greatest(F.lit(0.0), x * F.lit(gain) + F.lit(lift) * (F.lit(1.0) - x)), F.lit(1.0 / gamma))

    return clamp(tone(grey) + (tone(c) - tone(grey)) * F.lit(saturation), 0.0, 1.0)


def aces(x: Column, exposure: float = 1.0) -> Column:
    """Filmic tone curve; its five constants are fixed values."""
    a, b, c, d, e = 2.51, 0.03, 2.43, 0.59, 0.14
    v = x * F.lit(exposure)
    return clamp((v * (v * F.lit(a) + F.lit(b))) / (v * (v * F.lit(c) + F.lit(d)) + F.lit(e)), 0.0, 1.0)


def luma_key(r: Column, g: Column, b: Column, threshold: float, softness: float) -> Column:
    return smoothstep(threshold - softness, threshold + softness, luma(r, g, b))


def fit_rect(sw: Column, sh: Column, w: float, h: float, mode: str) -> tuple[Column, Column, Column, Column]:
    """Place a source of sw x sh in a frame of w x h: x, y, width, height for contain, cover or stretch."""
    if mode == "stretch":
        return F.lit(0.0), F.lit(0.0), F.lit(float(w)), F.lit(float(h))
    pick = F.least if mode == "contain" else F.greatest
    scale = pick(F.lit(float(w)) / sw, F.lit(float(h)) / sh)
    return (F.lit(float(w)) - sw * scale) / 2, (F.lit(float(h)) - sh * scale) / 2, sw * scale, sh * scale

"""Angle columns. Contract degrees: 0 = +x turning toward +y. Compass: 0 = +y clockwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap_deg(a: Column) -> Column:
    """Into [0, 360); a value that rounds up to 360 becomes 0."""
    w = F.pmod(a, F.lit(360.0))
    return F.when(w >= 360.0, F.lit(0.0)).otherwise(w)


def turn_deg(a: Column, b: Column) -> Column:
    """Signed shortest turn from a to b, in (-180, 180]."""
    d = wrap_deg(b - a)
    return F.when(d > 180.0, d - 360.0).otherwise(d)


def compass_flip(a: Column) -> Column:
    """Compass bearing to contract angle, and back: the map is its own inverse."""
    return F.pmod(F.lit(90.0) - a, F.lit(360.0))


def heading(dx: Column, dy: Column) -> Column:
    return wrap_deg(F.degrees(F.atan2(dy, dx)))


def bearing(dx: Column, dy: Column) -> Column:
    """Compass bearing of a displacement."""
    return wrap_deg(F.degrees(F.atan2(dx, dy)))


def blend_angle(a: Column, b: Column, u: Column, smooth: bool = False) -> Column:
    """Interpolate the short way; ``smooth`` eases in and out."""
    k = u * u * (F.lit(3.0) - F.lit(2.0) * u) if smooth else u
    return wrap_deg(a + turn_deg(a, b) * k)

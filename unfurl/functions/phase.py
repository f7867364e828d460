"""Scalar phase arithmetic and edge-quality measures as Column expressions.

All of them stay inside whole-stage code generation. Divisions are guarded: ANSI
mode raises on a zero divisor where IEEE arithmetic gives NaN or infinity."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PI, TWO_PI = math.pi, 2 * math.pi
#: Number of quality bins; factor of the weakest edge per measure.
BINS, FLOOR = 256, 0.1


def nan() -> Column:
    return F.lit(float("nan"))


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != float("inf"))


def wrap_once(x: Column, single: bool = False) -> Column:
    """Adds or subtracts 2 pi once; NaN stays NaN. In single precision 2 pi is rounded
    to it, while pi, which is only compared with, is not."""
    if single:
        x, turn = x.cast("float"), F.lit(TWO_PI).cast("float")
        return F.when(x < -PI, x + turn).when(x > PI, x - turn).otherwise(x)
    return F.when(x < -PI, x + TWO_PI).when(x > PI, x - TWO_PI).otherwise(x)


def wrap_full(x: Column) -> Column:
    """Remainder to the nearest multiple of 2 pi, ties to even."""
    return x - TWO_PI * F.rint(x / TWO_PI)


def unwrap_to(new: Column, old: Column) -> Column:
    """new shifted by the multiple of 2 pi that brings it closest to old."""
    return new - TWO_PI * F.rint((new - old) / TWO_PI)


def echo_reference(previous: Column, te: float, te_ref: float) -> Column:
    return previous * F.lit(te / te_ref)


def quantise(w: Column) -> Column:
    """[0, 1] to 255..1, best first; anything else, NaN too, to 0 (no edge)."""
    return F.when((w >= 0) & (w <= 1), F.greatest(F.rint((1 - w) * (BINS - 1)), F.lit(1.0))).otherwise(F.lit(0.0)).cast("short")


def edge_id(idx: Column, dim: Column) -> Column:
    return idx * 3 + dim


def edge_dim(edge: Column) -> Column:
    return (edge % 3).cast("int")


def edge_voxel(edge: Column) -> Column:
    return F.floor(edge / F.lit(3)).cast("long")


def coherence(a: Column, b: Column) -> Column:
    return 1 - F.abs(wrap_once(a - b) / PI)


def gradient_coherence(a: Column, b: Column, a2: Column, b2: Column, te_ratio: float) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.abs(wrap_once(a - b) - wrap_once(a2 - b2) * te_ratio))


def linearity(a: Column, b: Column, c: Column) -> Column:
    return F.nanvl(F.greatest(F.lit(0.0), 1 - F.abs(wrap_full(a - 2 * b + c) / 2)), F.lit(0.5))


def edge_linearity(before: Column, a: Column, b: Column, after: Column) -> Column:
    """Both second differences of an edge; 0.9 where a neighbour is missing."""
    return F.when(before.isNull() | after.isNull(), F.lit(0.9)).otherwise(linearity(before, a, b) * linearity(a, b, after))


def smaller(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a) | F.isnan(b), nan()).otherwise(F.least(a, b))


def larger(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a) | F.isnan(b), nan()).otherwise(F.greatest(a, b))


def ieee_ratio(a: Column, b: Column) -> Column:
    """a / b as IEEE arithmetic has it."""
    inf = F.lit(float("inf"))
    return F.when(b != 0, a / F.when(b != 0, b)).when(a > 0, inf).when(a < 0, -inf).otherwise(nan())


def mag_coherence(a: Column, b: Column) -> Column:
    q = ieee_ratio(smaller(a, b), larger(a, b))
    return q * q


def mag_weight(a: Column, b: Column, maxmag: Column) -> Column:
    """Penalises low magnitude."""
    return 0.5 + 0.5 * F.least(F.lit(1.0), ieee_ratio(smaller(a, b), 0.5 * maxmag))


def mag_weight_high(a: Column, b: Column, maxmag: Column) -> Column:
    """Penalises magnitude far above the typical maximum."""
    return 0.5 + 0.5 * F.least(F.lit(1.0), ieee_ratio(0.5 * maxmag, larger(a, b)))


def combine(measures: list[Column]) -> Column:
    out = F.lit(1.0)
    for q in measures:
        out = out * (FLOOR + (1 - FLOOR) * q)
    return out

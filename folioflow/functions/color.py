"""Colour, matrix and function arithmetic over Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> Column:
    return F.struct(((1 - c) * (1 - k)).alias("r"), ((1 - m) * (1 - k)).alias("g"), ((1 - y) * (1 - k)).alias("b"))


def matrix_concat(m: list[Column], n: list[Column]) -> list[Column]:
    """m then n, of six numbers each."""
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return [a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u]


def matrix_apply(m: list[Column], x: Column, y: Column) -> Column:
    a, b, c, d, e, f = m
    return F.struct((x * a + y * c + e).alias("x"), (x * b + y * d + f).alias("y"))


def _clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x))


def exponential(x: Column, c0: float, c1: float, n: float, domain: tuple[float, float] = (0.0, 1.0)) -> Column:
    """A type 2 function of one output."""
    return F.lit(float(c0)) + F.pow(_clamp(x, *domain), F.lit(float(n))) * (float(c1) - float(c0))


def sampled(x: Column, samples: list[float], domain: tuple[float, float] = (0.0, 1.0)) -> Column:
    """A type 0 function of one input and output, linear between samples."""
    at = (_clamp(x, *domain) - domain[0]) / (domain[1] - domain[0]) * (len(samples) - 1)
    lo = F.least(F.floor(at).cast("int"), F.lit(len(samples) - 1))
    hi = F.least(lo + 1, F.lit(len(samples) - 1))
    table = F.array(*[F.lit(float(s)) for s in samples])
    a, b = F.element_at(table, lo + 1), F.element_at(table, hi + 1)
    return a + (b - a) * (at - lo)


def stitching(x: Column, pieces: list, bounds: list[float], encode: list[tuple[float, float]], domain: tuple[float, float] = (0.0, 1.0)) -> Column:
    """A type 3 function: pieces are functions of a Column, each on its part of the domain, mapped to its encode range."""
    v = _clamp(x, *domain)
    edges = [domain[0], *bounds, domain[1]]

    def piece(k: int) -> Column:
        lo, hi = edges[k], edges[k + 1]
        e0, e1 = encode[k]
        return pieces[k](F.lit(float(e0)) if hi == lo else F.lit(float(e0)) + (v - lo) * ((e1 - e0) / (hi - lo)))

    cases = reduce(lambda w, k: w.when(v < bounds[k], piece(k)), range(1, len(bounds)), F.when(v < bounds[0], piece(0))) if bounds else None
    return piece(0) if cases is None else cases.otherwise(piece(len(bounds)))

"""Scalar column functions: clamps, circular time, distances, grades, log sanitising."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Centres of countries in degrees.
COUNTRY_CENTRES = {
    "NG": (9.0820, 8.6753),
    "US": (39.8283, -98.5795),
    "RU": (61.5240, 105.3188),
    "NL": (52.1326, 5.2913),
    "SG": (1.3521, 103.8198),
    "DE": (51.1657, 10.4515),
    "GB": (55.3781, -3.4360),
    "BR": (-14.2350, -51.9253),
    "ZA": (-30.5595, 22.9375),
    "JP": (36.2048, 138.2529),
}
HIGH_RISK_COUNTRIES = ("RU", "CN", "KP", "IR", "SY")
EARTH_KM = 6371.0


def clamp01(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))


def flag(condition: Column) -> Column:
    """1.0 where the condition holds, 0.0 where it doesn't or is unknown."""
    return F.when(condition, 1.0).otherwise(0.0)


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    angle = value * (2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def fractional_hour(ts: Column) -> Column:
    return F.hour(ts) + F.minute(ts) / 60.0


def angular_distance(a: Column, b: Column, circle: float = 360.0) -> Column:
    d = F.pmod(F.abs(a - b), F.lit(circle))  # the other way round a negative difference would be rounded once more
    return F.least(d, circle - d)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda x, y: F.pow(F.sin(F.radians(y - x) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)))


def country_distance_km(a: Column, b: Column) -> Column:
    """Kilometres between two countries' centres; 0 if either is unknown."""

    def of(code: Column, part: int) -> Column:
        return F.element_at(F.create_map(*[x for k, v in COUNTRY_CENTRES.items() for x in (F.lit(k), F.lit(v[part]))]), code)

    return F.coalesce(haversine_km(of(a, 0), of(a, 1), of(b, 0), of(b, 1)), F.lit(0.0))


def median(sorted_values: Column) -> Column:
    """The median of a sorted array, null if it is empty."""
    n = F.size(sorted_values)
    middle = F.get(sorted_values, F.floor(n / 2).cast("int"))
    return F.when(n % 2 == 1, middle).otherwise((F.get(sorted_values, F.floor(n / 2).cast("int") - 1) + middle) / 2)


def between(low: Column, high: Column, share: Column) -> Column:
    """low * (1 - share) + high * share as a fused multiply-add gives it: the first product isn't rounded on its own.

    Its rounding error is found by halves of the factors (Dekker), that of the
    sum by what the sum lost (Knuth), and both are added back.
    """

    def halves(x: Column) -> tuple[Column, Column]:
        big = x * 134217729.0
        top = big - (big - x)
        return top, x - top

    rest, added = 1.0 - share, high * share
    product = low * rest
    (a, b), (c, d) = halves(low), halves(rest)
    lost = ((a * c - product) + a * d + b * c) + b * d
    total = product + added
    part = total - product
    return total + (((product - (total - part)) + (added - part)) + lost)


def risk_grade(rate: Column, least: Column) -> Column:
    """A to F by the rate of anomalies and the lowest score."""
    limits = ((0.5, -0.5, "F"), (0.3, -0.3, "D"), (0.15, -0.15, "C"), (0.05, -0.05, "B"))
    found = None
    for high, low, grade in limits:
        hit = (rate > high) | (least < low)
        found = F.when(hit, grade) if found is None else found.when(hit, grade)
    return found.otherwise("A")


def case_severity(score: Column, events: Column) -> Column:
    return F.when((score >= 0.85) | (events >= 8), "critical").when((score >= 0.7) | (events >= 5), "high").when((score >= 0.55) | (events >= 3), "medium").otherwise("low")


def confidence_band(score: Column) -> Column:
    return F.when(score >= 0.85, "very_high").when(score >= 0.7, "high").when(score >= 0.55, "medium").otherwise("low")


def log_safe(text: Column, most: int = 256) -> Column:
    """A value for a log line: line breaks out, backslash, equals sign and bar escaped, cut to ``most`` characters."""
    one_line = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\r\n]+", " ")
    return F.substring(F.regexp_replace(one_line, r"([\\=|])", r"\\$1"), 1, most)


def bessel_log_i0(x: Column) -> Column:
    """log I0 in double precision: the power series up to 20, the asymptotic one beyond."""
    series = [1.0]
    for j in range(1, 46):
        series.append(series[-1] / (j * j))
    beyond = [1.0]
    for k in range(1, 31):
        beyond.append(beyond[-1] * (2 * k - 1) ** 2 / (8 * k))
    poly = lambda c, t: F.aggregate(F.array(*[F.lit(v) for v in reversed(c)]), F.lit(0.0), lambda total, v: total * t + v)
    a = F.abs(x)
    return F.when(a < 20, F.log(poly(series, a * a / 4))).otherwise(a - F.log(2 * math.pi * a) / 2 + F.log(poly(beyond, 1 / a)))


def bessel_ratio(x: Column) -> Column:
    """I1/I0 of a non-negative argument by a continued fraction of fixed depth, which converges for all of them."""
    depth = F.sequence(F.lit(60), F.lit(1), F.lit(-1))
    tail = F.aggregate(depth, F.lit(0.0), lambda a, k: x / (2 * k + x * a))
    return F.when(x > 50, 1 - 1 / (2 * x) - 1 / (8 * x * x) - 1 / (8 * x * x * x)).otherwise(tail)


def concentration(length: Column, steps: int = 12, most: float = 200.0) -> Column:
    """The von Mises concentration of a mean resultant length: Newton steps on I1/I0 from the usual start, at most ``most``."""
    r = F.least(F.greatest(length, F.lit(0.0)), F.lit(1 - 1e-9))
    start = r * (2 - r * r) / (1 - r * r)

    def step(k: Column, _: Column) -> Column:
        a = bessel_ratio(k)
        slope = 1 - a * a - a / F.greatest(k, F.lit(1e-9))
        return F.least(F.greatest(k - (a - r) / F.when(F.abs(slope) < 1e-12, 1e-12).otherwise(slope), F.lit(0.0)), F.lit(most))

    return F.when(r < 1e-9, 0.0).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.least(start, F.lit(most)), step))

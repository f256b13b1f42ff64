"""Picture-quality expressions over scores and row-major luma arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stabilising constants of the field similarity measure.
SSIM_C1 = 6.5025
SSIM_C2 = 58.5225

# Severity bands used when a profile names none.
DEFAULT_BANDS = {"mild": 40.0, "moderate": 55.0, "severe": 70.0}


def violation_confidence(value: Column, limit: Column) -> Column:
    """0 at the limit, 1 from a distance of 20 on, two decimals."""
    return F.round(F.least(F.abs(value - limit) / 20.0, F.lit(1.0)), 2)


def classify_severity(score: Column, mild=40.0, moderate=55.0, severe=70.0) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return (
        F.when(score < 0, "UNKNOWN")
        .when(score >= as_col(severe), "SEVERE")
        .when(score >= as_col(moderate), "MODERATE")
        .when(score >= as_col(mild), "MILD")
        .otherwise("CLEAN")
    )


def psnr(mean_square: Column) -> Column:
    """Peak signal-to-noise ratio of 8-bit samples in dB; identical means 100."""
    return F.when(mean_square == 0, F.lit(100.0)).otherwise(20.0 * F.log10(255.0 / F.sqrt(mean_square)))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc + x)


def abs_difference(a: Column, b: Column) -> Column:
    """Sum of absolute sample differences."""
    return _total(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("long")))


def changed_samples(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda d: d))


def variance(px: Column) -> Column:
    """Population variance from exact integer sums."""
    n = F.size(px)
    mean = _total(F.transform(px, lambda x: x.cast("long"))) / n
    return _total(F.transform(px, lambda x: (x * x).cast("long"))) / n - mean * mean


def valid_frame(px: Column, width: Column, min_side: int = 32, min_variance: float = 1.0) -> Column:
    """Large enough and not a flat colour, so that a quality score makes sense."""
    big = (width >= min_side) & (F.size(px) / width >= min_side)
    return F.coalesce(big & (variance(px) >= min_variance), F.lit(False))


def field(px: Column, width: Column, parity: int) -> Column:
    """Rows 0, 2, 4, ... (parity 0) or 1, 3, 5, ... (parity 1) of a picture.

    An odd last row has no partner and is left out.
    """
    paired = F.floor(F.size(px) / width / 2) * 2
    row = lambda i: F.floor(i / width)
    return F.filter(px, lambda _, i: (row(i) % 2 == parity) & (row(i) < paired))


def field_sums(even: Column, odd: Column) -> Column:
    """Exact sums over a pair of fields: n, e, o, ee, oo, eo, dd."""
    z = F.lit(0).cast("long")
    names = ("n", "e", "o", "ee", "oo", "eo", "dd")
    start = F.struct(*[z.alias(c) for c in names])

    def add(acc: Column, p: Column) -> Column:
        x, y = p["x"].cast("long"), p["y"].cast("long")
        more = {"n": F.lit(1), "e": x, "o": y, "ee": x * x, "oo": y * y, "eo": x * y, "dd": (x - y) * (x - y)}
        return F.struct(*[(acc[c] + more[c]).cast("long").alias(c) for c in names])

    pairs = F.zip_with(even, odd, lambda a, b: F.struct(a.alias("x"), b.alias("y")))
    return F.aggregate(pairs, start, add)


def ssim(s: Column) -> Column:
    """Whole-field similarity from the sums of :func:`field_sums`."""
    m1, m2 = s["e"] / s["n"], s["o"] / s["n"]
    v1, v2 = s["ee"] / s["n"] - m1 * m1, s["oo"] / s["n"] - m2 * m2
    cov = s["eo"] / s["n"] - m1 * m2
    return ((2 * m1 * m2 + SSIM_C1) * (2 * cov + SSIM_C2)) / ((m1 * m1 + m2 * m2 + SSIM_C1) * (v1 + v2 + SSIM_C2))

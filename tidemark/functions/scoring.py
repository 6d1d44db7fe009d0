"""Scalar feature functions over arrays, ratios and risk factors, all as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trailing(periods: Column, n: int, by: str = "period", value: str = "taxable_income") -> Column:
    """The last n values of an array of structs, sorted by its period.  Sorting is dear: take the longest once, as a column,
    and shorter ones from it by `last`."""
    ordered = F.array_sort(F.transform(periods, lambda p: F.struct(p[by].alias("by"), p[value].cast("double").alias("value"))))
    return F.transform(last(ordered, n), lambda p: p["value"])


def last(xs: Column, n: int) -> Column:
    return F.slice(xs, F.greatest(F.size(xs) - n + 1, F.lit(1)), F.lit(n))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def fixed_mean(xs: Column, n: int) -> Column:
    """The sum over n, however many there are."""
    return total(xs) / float(n)


def spread(xs: Column) -> Column:
    """Population standard deviation; null for an empty array."""
    size = F.nullif(F.size(xs).cast("double"), F.lit(0.0))
    mean = total(xs) / size
    return F.sqrt(F.aggregate(F.transform(xs, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x) / size)


def trend(xs: Column) -> Column:
    """Of six trailing values: (mean of those after the third - mean of the first three) / mean, 0 without income."""
    mean = fixed_mean(xs, 6)
    older, recent = total(F.slice(xs, 1, 3)) / 3.0, total(F.slice(xs, 4, 3)) / 3.0
    return F.when(mean <= 0, F.lit(0.0)).otherwise((recent - older) / mean)


def count_positive(xs: Column) -> Column:
    return F.size(F.filter(xs, lambda x: x > 0))


def days_since(report_text: Column, last_text: Column, never: int = 9999) -> Column:
    """Whole days between two ISO texts by their own dates, `never` where there is no last one; null without a report's date."""
    return F.when(last_text.isNull(), F.lit(never)).otherwise(F.datediff(F.to_date(F.left(report_text, F.lit(10))), F.to_date(F.left(last_text, F.lit(10)))))


def round_exact(x: Column, digits: int = 6) -> Column:
    """A double rounded at its exact binary value, ties to even, where Spark's round() looks at its shortest decimal text.

    x times the scale is taken as a rounded product and its exact error (Dekker's product; the scale has few digits, so
    only x is split).  Above 2^32 six digits are beyond a double's, and x stays."""
    scale = 2.0 * 10**digits
    high = x * 134217729.0 - (x * 134217729.0 - x)
    twice = x * scale
    error = (high * scale - twice) + (x - high) * scale  # x * scale == twice + error
    low = F.floor(twice / 2).cast("double")
    rest = twice / 2 - low - 0.5
    even = low % 2 == 0
    whole = F.when((rest > 0) | ((rest == 0) & (error > 0)) | ((rest == 0) & (error == 0) & ~even), low + 1).otherwise(low)
    return F.when(F.abs(x) < float(1 << 32), whole / float(10**digits)).otherwise(x)


def round_scaled(x: Column, digits: int = 6) -> Column:
    """A double rounded as SQL engines in C do: the double product x * 10^digits to the nearest whole number, ties away from
    zero, and divided again; x where the product overflows."""
    scale = float(10**digits)
    product = x * scale
    near = F.rint(product)
    whole = F.when((product > 0) & (product - near == 0.5), near + 1).when((product < 0) & (product - near == -0.5), near - 1).otherwise(near)
    return F.when(F.abs(product) == float("inf"), x).otherwise(whole / scale)


def safe_ratio(x: Column, base: Column) -> Column:
    """x / base, null where the base is null or 0."""
    return F.try_divide(x, F.nullif(base, F.lit(0)))


def capped_ratio(x: Column, base: Column, cap: float = 10.0) -> Column:
    """x / base but `cap` at most, and where the base is not positive."""
    return F.when(base <= 0, F.lit(cap)).otherwise(F.least(x / F.nullif(base, F.lit(0)), F.lit(cap)))


def stability(mean: Column, std: Column, months: Column) -> Column:
    return F.when(mean <= 0, F.lit(0.0)).otherwise(F.lit(1.0) / (F.lit(1.0) + std / F.nullif(mean, F.lit(0.0))) * (months / 12.0))


def recent_delinquency(days: Column, worst: Column) -> Column:
    return F.when((days <= 180) & (worst >= 30), 1).otherwise(0)


def thin_file(loans: Column, sim_days: Column) -> Column:
    return F.when((loans == 0) | (sim_days < 365), 1).otherwise(0)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def blend(parts: list[tuple[Column, float]]) -> Column:
    """A weighted sum of factors, each clamped to 0..1."""
    out = F.lit(0.0)
    for col, weight in parts:
        out = out + clamp(col) * weight
    return out


def standardise(x: Column, mean: float, std: float) -> Column:
    return (x - float(mean)) / float(std or 1.0)


def logistic(margin: Column, limit: float = 60.0, digits: int = 6) -> Column:
    """Sigmoid of a margin held within +-limit."""
    held = F.greatest(F.lit(-limit), F.least(F.lit(limit), margin))
    return F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-held)), digits)


def decision(probability: Column, approve: float = 0.10, review: float = 0.30) -> Column:
    return F.when(probability < approve, "approve").when(probability < review, "review").otherwise("decline")

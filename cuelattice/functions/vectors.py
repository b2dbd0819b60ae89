"""Array expressions: vectors, token sequences, grids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vec: Column) -> Column:
    """Whether every element is a number."""
    return F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x))


def zeros(n: Column | int) -> Column:
    return F.array_repeat(F.lit(0.0), F.lit(n) if isinstance(n, int) else n)


def padded(vec: Column, n: Column | int) -> Column:
    """``vec`` with zeros at the end up to length n."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.concat(vec, zeros(F.greatest(n - F.size(vec), F.lit(0))))


def nan_as_zero(vec: Column) -> Column:
    return F.transform(vec, lambda x: F.nanvl(F.coalesce(x, F.lit(0.0)), F.lit(0.0)))


def pooled(vecs: Column, how: str = "mean") -> Column:
    """mean, first or last of an array of equally long vectors; null if it is empty."""
    if how in ("first", "last"):
        return F.try_element_at(vecs, F.lit(1 if how == "first" else -1))
    total = F.aggregate(F.slice(vecs, 2, F.size(vecs)), F.try_element_at(vecs, F.lit(1)), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return F.when(F.size(vecs) > 0, F.transform(total, lambda x: x / F.size(vecs)))


def find_run(big: Column, small: Column) -> Column:
    """First place (from 0) of an array within another, or -1."""
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(big) - F.size(small), F.lit(0))), lambda i: F.slice(big, i + 1, F.size(small)) == small)
    return F.when(F.size(small) > F.size(big), -1).otherwise(F.coalesce(F.get(places, F.lit(0)), F.lit(-1)))


def first_from(items: Column, item: Column, start: int = 0) -> Column:
    """First place (from 0) of an item at or after ``start``, or -1."""
    at = F.array_position(F.slice(items, start + 1, F.greatest(F.size(items) - start, F.lit(0))), item)
    return F.when(at > 0, at - 1 + start).otherwise(F.lit(-1))


def spans_overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (b_start < a_end)


def log_grid(low: float, high: float, n: int) -> Column:
    """n numbers from 10**low to 10**high, evenly spaced in their logarithm."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.pow(F.lit(10.0), F.lit(low) + i * F.lit((high - low) / max(n - 1, 1))))


def parsed(c: Column) -> Column:
    """A vector given as text such as ``[0.1, 2]``."""
    return F.from_json(c, "array<float>")

"""Order-stable numerics as Column expressions over sorted arrays: results do not depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def _zero() -> Column:
    return F.lit(0.0)


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` evaluated once, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def canonical_zero(value: Column) -> Column:
    """-0.0 becomes 0.0."""
    return value + F.lit(0.0)


def neumaier_sum(values: Column) -> Column:
    """Compensated sum of an array in its order."""

    def step(acc: Column, v: Column) -> Column:
        total = acc["s"] + v
        lost = F.when(F.abs(acc["s"]) >= F.abs(v), (acc["s"] - total) + v).otherwise((v - total) + acc["s"])
        return F.struct(total.alias("s"), (acc["c"] + lost).alias("c"))

    start = F.struct(_zero().alias("s"), _zero().alias("c"))
    return F.aggregate(values, start, step, lambda acc: acc["s"] + acc["c"])


def midpoint(low: Column, high: Column) -> Column:
    """Mean of two numbers without overflow."""
    return F.when((low < 0) == (high < 0), low + (high - low) * 0.5).otherwise(low * 0.5 + high * 0.5)


def sorted_median(values: Column) -> Column:
    """Exact median of a sorted array; null for an empty one."""
    n = F.size(values)
    half = F.floor(n / 2).cast("int")
    odd = F.get(values, half)
    even = midpoint(F.get(values, half - 1), odd)
    return F.when(n == 0, F.lit(None).cast("double")).otherwise(canonical_zero(F.when(n % 2 == 1, odd).otherwise(even)))


def array_median(values: Column) -> Column:
    return let(F.sort_array(values), sorted_median)


def median_and_mad(values: Column) -> Column:
    """``struct(median, mad)``: the exact median and the exact median of the distances from it."""

    def around(s: Column, m: Column) -> Column:
        return F.struct(m.alias("median"), array_median(F.transform(s, lambda v: F.abs(v - m))).alias("mad"))

    return let(F.sort_array(values), lambda s: let(sorted_median(s), lambda m: around(s, m)))

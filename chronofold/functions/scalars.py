"""Scalar column functions with the null rules that feature code relies on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

DAY = 86400.0
TINY = 1e-12


def number(c: Column) -> Column:
    """A lenient cast to double: what can't be read is null."""
    return c.try_cast("double")


def safe_div(left: Column, right: Column, epsilon: float = 1e-9) -> Column:
    """left / right, null where the divisor is within epsilon of zero."""
    return F.when(F.abs(right) > epsilon, left / right)


def clip(c: Column, lower: float | None = None, upper: float | None = None) -> Column:
    """c held between bounds; null stays null."""
    out = c
    if lower is not None:
        out = F.when(out < lower, F.lit(float(lower))).otherwise(out)
    if upper is not None:
        out = F.when(out > upper, F.lit(float(upper))).otherwise(out)
    return out


def log1p(c: Column) -> Column:
    """log(1 + c), null at or below -1."""
    return F.when(c > -1, F.log1p(c))


def days_between(later: Column, earlier: Column) -> Column:
    """Days from earlier to later, of whole seconds cut toward zero."""
    return F.timestamp_diff("SECOND", earlier, later) / F.lit(DAY)


def band(c: Column, edges: Sequence[float], names: Sequence[str]) -> Column:
    """The name of the half-open band [edge, next edge) that c is in; len(names) == len(edges) + 1."""
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for edge, name in zip(edges, names, strict=False):
        out = out.when(c < edge, F.lit(name))
    return out.otherwise(F.lit(names[-1]))


def average_rank(c: Column, group: WindowSpec) -> Column:
    """Rank from 1 with ties averaged, nulls left out."""
    ordered = group.orderBy(c.asc_nulls_last())
    ties = F.count(c).over(group.orderBy(c).rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(c.isNotNull(), F.rank().over(ordered) + (ties - 1) / F.lit(2.0))


def unit_rank(c: Column, group: WindowSpec) -> Column:
    """Average rank scaled to [0, 1], null in groups of one."""
    n = F.count(c).over(group)
    return F.when(n > 1, (average_rank(c, group) - 1) / (n - 1))


def share_of_total(c: Column, group: WindowSpec) -> Column:
    total = F.sum(c).over(group)
    return F.when(F.abs(total) > TINY, c / total)


def deviation(c: Column, group: WindowSpec) -> Column:
    return c - F.avg(c).over(group)


def zscore(c: Column, group: WindowSpec) -> Column:
    """Sample z-score, null where the spread is nil."""
    sd = F.stddev_samp(c).over(group)
    return F.when(sd > TINY, (c - F.avg(c).over(group)) / sd)


def nearest_rank(values: Column, q: float) -> Column:
    """The q quantile of an array by nearest rank; nulls are left out, halves go up."""
    kept = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    n = F.size(kept)
    return F.when(n > 0, F.element_at(kept, (F.floor(F.lit(q) * (n - 1) + 0.5) + 1).cast("int")))


def hashed_uniform(seed: int, *keys: Column) -> Column:
    """A draw from [0, 1) that depends on seed and keys only, whatever the partitions."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / F.lit(float(1 << 53))


def whole_days(c: Column) -> Column:
    return F.floor(c).cast("long")

"""Ranks and places within groups of any size.

A window over a whole group is one task's work, and some groups are the whole table. Here values are
counted first (equal ones come down to one row before anything is shuffled by group), and counts are
added up in two steps: within a bucket of neighbouring values, and over the buckets of a group. A bucket
is a fixed function of the value (steps of its logarithm), so no sample and no action on the driver is
needed, and a group has a bounded number of them however many rows it has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets an octave of values is cut into.
STEPS = 1024
_OCTAVES = 1100  # more than doubles have on either side of 1


def value_bucket(c: Column) -> Column:
    """A whole number that never falls as c rises; null for null."""
    x = c.cast("double")
    size = F.floor(F.greatest(F.lit(-_OCTAVES), F.least(F.log2(F.abs(x)), F.lit(_OCTAVES))) * STEPS) + (_OCTAVES * STEPS + 1)
    return F.when(F.isnan(x), 3 * _OCTAVES * STEPS).when(x > 0, size).when(x < 0, -size).when(x == 0, 0)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on keys that may be null; the right side's keys go."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(renamed[f"_right_{k}"])
    return left.join(renamed, condition, how).drop(*(f"_right_{k}" for k in keys))


def _ahead(cells: DataFrame, group: Sequence[str], bucket: str, order: Sequence[str], n: str, out: str) -> DataFrame:
    """Adds how many rows of the group come before each cell: those of earlier buckets, then of earlier cells."""
    buckets = cells.groupBy(*group, bucket).agg(F.sum(n).alias("_in_bucket"))
    over = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    heads = buckets.select(*group, bucket, F.coalesce(F.sum("_in_bucket").over(over), F.lit(0)).alias("_head"))
    within = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = cells.withColumn("_local", F.coalesce(F.sum(n).over(within), F.lit(0)))
    return null_safe_join(local, heads, [*group, bucket]).withColumn(out, F.col("_head") + F.col("_local")).drop("_head", "_local")


def rank_table(counts: DataFrame, group: Sequence[str], value: str, n: str = "n") -> DataFrame:
    """From one row a group and value with its number of rows: ``rank`` (from 1, ties averaged)."""
    placed = _ahead(counts.withColumn("_b", value_bucket(F.col(value))), group, "_b", [value], n, "_before")
    return placed.withColumn("rank", F.col("_before") + (F.col(n) + 1) / F.lit(2.0)).drop("_b", "_before")


def unit_ranks(frame: DataFrame, group: Sequence[str], columns: dict[str, str], least: int = 2) -> DataFrame:
    """Adds the average rank of columns (name -> output) scaled to [0, 1]; null below ``least`` values in the group."""
    out = frame
    for c, name in columns.items():
        counts = frame.where(F.col(c).isNotNull()).groupBy(*group, c).agg(F.count(F.lit(1)).alias("n"))
        totals = counts.groupBy(*group).agg(F.sum("n").alias("_all"))
        scaled = F.when(F.col("_all") >= max(2, least), (F.col("rank") - 1) / (F.col("_all") - 1))
        table = null_safe_join(rank_table(counts, group, c), totals, group).select(*group, c, scaled.alias(name))
        out = null_safe_join(out, table, [*group, c], "left")
    return out


def places(frame: DataFrame, group: Sequence[str], value: str, ties: Sequence[str], out: str) -> DataFrame:
    """Adds each row's place in its group, from 1, by value and then ``ties`` (the first of them a number).

    Rows of one value are dealt to cells by their first tie, so that neither a large group nor a frequent
    value is one task's work. Nulls come first.
    """
    keyed = frame.withColumns({"_b": F.coalesce(value_bucket(F.col(value)), F.lit(-4 * _OCTAVES * STEPS)), "_t": F.coalesce(value_bucket(F.col(ties[0])), F.lit(-4 * _OCTAVES * STEPS))})
    cell = [*group, "_b", value, "_t"]
    cells = keyed.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
    starts = _ahead(cells, group, "_b", [F.col(value).asc_nulls_first(), "_t"], "_n", "_start").drop("_n")
    within = Window.partitionBy(*cell).orderBy(*(F.col(t).asc_nulls_first() for t in ties))
    local = keyed.withColumn("_local", F.row_number().over(within))
    return null_safe_join(local, starts, cell).withColumn(out, (F.col("_start") + F.col("_local")).cast("long")).drop("_b", "_t", "_start", "_local")


def ntile(place: Column, n: Column, bins: int) -> Column:
    """The bin, from 1, of a place among n rows; the first bins take one row more where rows don't divide."""
    size, more = F.floor(n / bins), n % bins
    wide = more * (size + 1)
    return F.when(place <= wide, F.floor((place - 1) / (size + 1)) + 1).otherwise(more + F.floor((place - 1 - wide) / F.greatest(size, F.lit(1))) + 1).cast("int")

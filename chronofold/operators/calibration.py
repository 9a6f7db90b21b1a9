"""Scores of predictive distributions held as arrays: ``pmf_support_min`` and ``pmf``."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.functions.scalars import band, hashed_uniform
from chronofold.operators.metrics import PRICE_BANDS, PRICE_EDGES
from chronofold.operators.ranks import places

# Levels of pinball losses and of central intervals.
LEVELS = [0.1, 0.25, 0.5, 0.75, 0.9]
COVERAGES = [0.5, 0.8, 0.9, 0.95]


def mean_of(pmf: Column, low: Column) -> Column:
    return F.aggregate(F.transform(pmf, lambda p, i: p * (low + i)), F.lit(0.0), lambda s, x: s + x)


def variance_of(pmf: Column, low: Column) -> Column:
    m = mean_of(pmf, low)
    return F.aggregate(F.transform(pmf, lambda p, i: p * (low + i) * (low + i)), F.lit(0.0), lambda s, x: s + x) - m * m


def cdf_at(pmf: Column, low: Column, x: Column) -> Column:
    """Probability of x or less; 0 below the support, 1 above it."""
    k = F.greatest(F.lit(0), F.least(F.size(pmf), x - low + 1)).cast("int")
    return F.least(F.lit(1.0), F.aggregate(F.slice(pmf, F.lit(1), k), F.lit(0.0), lambda s, p: s + p))


def cumulative(pmf: Column) -> Column:
    zero = F.array().cast("array<double>")
    return F.aggregate(pmf, zero, lambda s, p: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0.0)) + p)))


def quantile_of(pmf: Column, low: Column, q: float) -> Column:
    """The smallest value whose cumulative probability is q or more."""
    below = F.size(F.filter(cumulative(pmf), lambda c: c < q - 1e-12))
    return low + F.least(below, F.size(pmf) - 1)


def crps(pmf: Column, low: Column, y: Column) -> Column:
    """Sum over the lattice of (F(k) - 1{y <= k})**2, with what lies beyond the support."""
    steps = F.transform(cumulative(pmf), lambda c, i: F.pow(c - F.when(y <= low + i, 1.0).otherwise(0.0), 2))
    outside = F.greatest(F.lit(0), low - y) + F.greatest(F.lit(0), y - (low + F.size(pmf)))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) + outside


def pinball(q: Column, y: Column, level: float) -> Column:
    return F.when(y >= q, level * (y - q)).otherwise((1 - level) * (q - y))


def randomised_pit(pmf: Column, low: Column, y: Column, seed: int, *keys: Column) -> Column:
    """F(y - 1) + v p(y), v drawn by a hash of the keys."""
    below = cdf_at(pmf, low, y - 1)
    return below + hashed_uniform(seed, *keys) * (cdf_at(pmf, low, y) - below)


def score_distributions(frame: DataFrame, keys: list[str], seed: int = 20260727) -> DataFrame:
    """Each row with mean, sd, CRPS, pinball losses, interval hits and PIT (columns actual, pmf_support_min, pmf)."""
    pmf, low, y = F.col("pmf"), F.col("pmf_support_min"), F.col("actual")
    out = {"mean": mean_of(pmf, low), "sd": F.sqrt(F.greatest(F.lit(0.0), variance_of(pmf, low))), "crps": crps(pmf, low, y)}
    for q in LEVELS:
        out[f"pinball_{round(q * 100)}"] = pinball(quantile_of(pmf, low, q), y, q)
    for c in COVERAGES:
        lo, hi = quantile_of(pmf, low, (1 - c) / 2), quantile_of(pmf, low, (1 + c) / 2)
        out[f"inside_{round(c * 100)}"] = ((y >= lo) & (y <= hi)).cast("int")
        out[f"width_{round(c * 100)}"] = hi - lo
    out["pit"] = randomised_pit(pmf, low, y, seed, *(F.col(k) for k in keys))
    return frame.withColumns(out)


def coverage_report(scored: DataFrame, by: list[str]) -> DataFrame:
    """Share inside each interval with its 95% margin, and mean width."""
    columns = []
    for c in COVERAGES:
        name = round(c * 100)
        share = F.avg(f"inside_{name}")
        columns += [share.alias(f"coverage_{name}"), (1.96 * F.sqrt(share * (1 - share) / F.count(F.lit(1)))).alias(f"margin_{name}"), F.avg(f"width_{name}").alias(f"width_{name}")]
    return scored.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("crps").alias("crps"), *columns)


def pit_histogram(scored: DataFrame, bins: int = 20) -> DataFrame:
    return scored.groupBy(F.least(F.lit(bins - 1), F.floor(F.col("pit") * bins)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def cramer_von_mises(scored: DataFrame) -> DataFrame:
    """Distance of the PIT from uniform: 1/(12 n) + sum(((2 i - 1) / 2n - u_i)**2)."""
    size = scored.agg(F.count(F.lit(1)).alias("n"))
    placed = places(scored.select("pit"), [], "pit", ["pit"], "i").crossJoin(F.broadcast(size))
    return placed.select("n", F.pow((2 * F.col("i") - 1) / (2 * F.col("n")) - F.col("pit"), 2).alias("d")).agg((1 / (12 * F.max("n")) + F.sum("d")).alias("cvm"))


# The bands that forecasts are sliced by.
MINUTES_EDGES, MINUTES_BANDS = [1, 60], ["did not play", "cameo (1-59)", "started (60+)"]


def sliced(scored: DataFrame, key: str) -> DataFrame:
    """Each scored row once for every slice it is in: overall, appeared only, position, price band, minutes band and decile of prediction.

    Columns position, price, minutes and predicted each bring their slices; one that is absent brings none.
    Without minutes, whoever has points has appeared. The last decile takes the rows that don't divide.
    """
    has = set(scored.columns)
    appeared = F.col("minutes") > 0 if "minutes" in has else F.col("actual") != 0
    tags = [F.lit("overall"), F.when(appeared, F.lit("appeared only"))]
    if "position" in has:
        tags.append(F.concat(F.lit("position:"), F.col("position")))
    if "price" in has:
        tags.append(F.concat(F.lit("price:"), band(F.col("price"), PRICE_EDGES, PRICE_BANDS)))
    if "minutes" in has:
        tags.append(F.concat(F.lit("minutes:"), band(F.col("minutes"), MINUTES_EDGES, MINUTES_BANDS)))
    if "predicted" in has:
        size = scored.agg(F.count(F.lit(1)).alias("_rows"))
        scored = places(scored, [], "predicted", [key], "_place").crossJoin(F.broadcast(size))
        decile = F.least(F.lit(10), F.floor((F.col("_place") - 1) / F.greatest(F.lit(1), F.floor(F.col("_rows") / 10))) + 1)
        tags.append(F.when(F.col("_rows") >= 10, F.concat(F.lit("decile:"), decile.cast("string"))))
    return scored.withColumn("slice", F.explode(F.array_compact(F.array(*tags)))).drop("_place", "_rows")


def calibration_report(scored: DataFrame, key: str) -> DataFrame:
    """Coverage, margins, widths and CRPS of every slice, and whether its forecasts have no width."""
    out = sliced(scored, key)
    widest = out.groupBy("slice").agg((F.max("sd") < 1e-6).alias("degenerate"))
    return coverage_report(out, ["slice"]).join(widest, "slice")


def gaussian_pmf(frame: DataFrame, mean: str, sd: str, low: int, high: int) -> DataFrame:
    """Adds a Gaussian rounded to whole numbers from low to high (``pmf_support_min``, ``pmf``).

    There is no built-in error function, so this one step is a batch of numpy in pandas.
    """

    @F.pandas_udf("array<double>")
    def make(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for m, s in columns:
            rows = []
            for a, b in zip(m, s, strict=True):
                b = max(float(b), 1e-9)
                edges = [0.5 * (1 + math.erf((k - 0.5 - a) / (b * math.sqrt(2)))) for k in range(low, high + 2)]
                edges[0], edges[-1] = 0.0, 1.0
                rows.append([y - x for x, y in zip(edges, edges[1:], strict=False)])
            yield pd.Series(rows)

    return frame.withColumn("pmf_support_min", F.lit(low)).withColumn("pmf", make(mean, sd))


def inflate_zero(pmf: Column, low: Column, weight: Column) -> Column:
    """Mass ``weight`` moved to 0, the rest scaled down."""
    return F.transform(pmf, lambda p, i: p * (1 - weight) + F.when(low + i == 0, weight).otherwise(0.0))


def point_mass(value: Column) -> tuple[Column, Column]:
    """The support's beginning and the probabilities of one certain whole number."""
    return value.cast("int"), F.array(F.lit(1.0))

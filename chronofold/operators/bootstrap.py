"""Intervals of a mean by resampling whole blocks.

Blocks come down to one row each, sum and count, before anything is drawn. Up to ``FEW`` blocks, a resample draws as many
blocks as there are, with replacement: the resamples are rows dealt to tasks, and each adds up its own draws out of
the blocks' sums, which every task has. Beyond, a block counts in each resample as often as a Poisson variable of mean one says
(what drawing with replacement tends to as blocks grow in number); blocks are dealt to tasks, and each task adds up its blocks'
sums for all resamples before anything is shuffled. Draws are digits of an md5 sum of seed, resample and place, so
they don't depend on partitions, and other engines can make the same ones.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.sources.scratch import written

# Resamples of an interval, and the blocks below which conditions are resampled instead.
RESAMPLES, LEAST_BLOCKS = 10_000, 3
#: Blocks up to which resamples draw them one by one.
FEW = 512
#: Draws that one md5 sum gives: eight hexadecimal digits each.
DRAWS = 4
#: How likely a Poisson variable of mean one is at most 0, 1, 2, ..
POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(12)]


def uniforms(*key: Column) -> Column:
    """DRAWS numbers of [0, 1) that hang on the key's texts only."""
    digits = F.md5(F.concat_ws(":", *(k.cast("string") for k in key)).cast("binary"))
    return F.array(*(F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("double") / float(1 << 32) for k in range(DRAWS)))


def poisson(u: Column) -> Column:
    """How often a block counts, by its draw."""
    out = F.lit(0)
    for p in POISSON:
        out = out + F.when(u >= p, 1).otherwise(0)
    return out


def _drawn(blocks: DataFrame, count: int, resamples: int, seed: int) -> DataFrame:
    """The mean of each resample, its blocks drawn one by one."""
    table = blocks.agg(F.sort_array(F.collect_list(F.struct("_block", "_s", "_n"))).alias("_all"))  # at most FEW blocks
    rounds = F.sequence(F.lit(0), F.lit((count - 1) // DRAWS))
    places = F.slice(F.flatten(F.transform(rounds, lambda q: uniforms(F.lit(seed), F.col("id"), q))), 1, count)
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("n"))
    at = lambda u: F.element_at("_all", (F.floor(u * count) + 1).cast("int"))
    total = F.aggregate(places, start, lambda t, u: F.struct((t["s"] + at(u)["_s"]).alias("s"), (t["n"] + at(u)["_n"]).alias("n")))
    rows = blocks.sparkSession.range(resamples).crossJoin(F.broadcast(table)).select(total.alias("t"))
    return rows.where("t.n > 0").select((F.col("t.s") / F.col("t.n")).alias("_m"))


def _weighed(blocks: DataFrame, resamples: int, seed: int) -> DataFrame:
    """The mean of each resample, blocks weighed by Poisson variables."""
    rounds = -(-resamples // DRAWS)
    each = blocks.select("_s", "_n", "_block", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("_q"))
    u = each.select("_q", "_s", "_n", uniforms(F.lit(seed), F.col("_block"), F.col("_q")).alias("_u"))
    weights = [poisson(F.col("_u")[k]) for k in range(DRAWS)]
    sums = u.groupBy("_q").agg(*(F.sum(w * F.col(c)).alias(f"{c}{k}") for k, w in enumerate(weights) for c in ("_s", "_n")))
    flat = sums.select("_q", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"_s{k}").alias("s"), F.col(f"_n{k}").alias("n")) for k in range(DRAWS)))).alias("r"))
    return flat.where((F.col("_q") * DRAWS + F.col("r.k") < resamples) & (F.col("r.n") > 0)).select((F.col("r.s") / F.col("r.n")).alias("_m"))


def block_bootstrap(frame: DataFrame, block: str, value: str, resamples: int = RESAMPLES, seed: int = 20260727, low: float = 0.025, high: float = 0.975, condition: Sequence[str] = ()) -> DataFrame:
    """low, mean and high of the resamples' means, the number of blocks, and how they were drawn.

    Below LEAST_BLOCKS blocks the rows of one ``condition`` are a block, if given. Null values don't count. No blocks: nulls.
    """
    rows = frame.where(F.col(value).isNotNull())
    sums = [F.sum(F.col(value).cast("double")).alias("_s"), F.count(F.lit(1)).alias("_n")]
    blocks = written(rows.groupBy(F.col(block).cast("string").alias("_block")).agg(*sums))
    count = blocks.count()
    if count < LEAST_BLOCKS and condition:
        blocks = written(rows.groupBy(F.to_json(F.struct(*condition)).alias("_block")).agg(*sums))
        count = blocks.count()
    if not count:
        means, how = blocks.select(F.lit(None).cast("double").alias("_m")), "none"
    elif count <= FEW:
        means, how = _drawn(blocks, count, resamples, seed), "drawn"
    else:
        means, how = _weighed(blocks, resamples, seed), "weighed"
    out = means.agg(F.percentile("_m", low).alias("low"), F.avg("_m").alias("mean"), F.percentile("_m", high).alias("high"))
    return out.select("low", "mean", "high", F.lit(count).cast("long").alias("blocks"), F.lit(how).alias("how"))

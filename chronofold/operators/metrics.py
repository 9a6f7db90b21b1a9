"""Accuracy, ranking and run statistics of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.functions import scalars as S
from chronofold.operators.ranks import ntile, null_safe_join, places, rank_table

DEGENERATE = 1e-6
PRICE_EDGES, PRICE_BANDS = [55, 80, 110], ["budget", "mid", "premium", "elite"]


def spearman(frame: DataFrame, left: str, right: str, by: Sequence[str]) -> DataFrame:
    """Rank correlation in each group, with averaged ties and population spreads; 0 where a spread is nil.

    Pairs of values are counted before they are ranked, and no group is ranked in one task.
    """
    pairs = frame.where(F.col(left).isNotNull() & F.col(right).isNotNull()).groupBy(*by, F.col(left).alias("_l"), F.col(right).alias("_r")).agg(F.count(F.lit(1)).alias("n"))
    out = pairs
    for c in ("_l", "_r"):
        table = rank_table(pairs.groupBy(*by, c).agg(F.sum("n").alias("n")), by, c).drop("n").withColumnRenamed("rank", f"{c}_rank")
        out = null_safe_join(out, table, [*by, c])
    n, x, y = F.col("n"), F.col("_l_rank"), F.col("_r_rank")
    total = F.sum(n)
    mean = (total + 1) / F.lit(2.0)  # of ranks, on either side
    sums = out.groupBy(*by).agg((F.sum(n * x * y) / total - mean * mean).alias("_xy"), (F.sum(n * x * x) / total - mean * mean).alias("_xx"), (F.sum(n * y * y) / total - mean * mean).alias("_yy"))
    spread = (F.sqrt(F.greatest(F.lit(0.0), F.col("_xx"))) > DEGENERATE) & (F.sqrt(F.greatest(F.lit(0.0), F.col("_yy"))) > DEGENERATE)
    return sums.select(*by, F.when(spread, F.col("_xy") / F.sqrt(F.col("_xx") * F.col("_yy"))).otherwise(0.0).alias("spearman"))


def accuracy_slices(frame: DataFrame, by: Sequence[str], predicted: str = "predicted", actual: str = "actual") -> DataFrame:
    """n, MAE, RMSE, bias, rank correlation, spread, baseline and skill of each group; rows with nulls are left out.

    The baseline predicts the group's mean outcome. Constant predictions have no skill, however small their error.
    """
    p, a = F.col(predicted).cast("double"), F.col(actual).cast("double")
    rows = frame.where(p.isNotNull() & a.isNotNull())
    rows = null_safe_join(rows, rows.groupBy(*by).agg(F.avg(a).alias("_mean")), by)
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(p - a)).alias("mae"), F.sqrt(F.avg((p - a) * (p - a))).alias("rmse"), F.avg(p - a).alias("bias"), F.stddev_pop(p).alias("prediction_sd"), F.avg(F.abs(a - F.col("_mean"))).alias("baseline_mae"))
    out = null_safe_join(out, spearman(frame, predicted, actual, by), by)
    flat = (F.col("prediction_sd") < DEGENERATE) | (F.col("baseline_mae") < DEGENERATE)
    return out.withColumn("degenerate", F.col("prediction_sd") < DEGENERATE).withColumn("skill", F.when(flat, 0.0).otherwise(1.0 - F.col("mae") / F.col("baseline_mae")))


def accuracy_report(frame: DataFrame) -> DataFrame:
    """Slices by name: overall, played, positions and price bands (columns minutes, position, price)."""
    tags = F.array_compact(F.array(F.lit("overall"), F.when(F.col("minutes") > 0, F.lit("played")), F.concat(F.lit("position:"), F.col("position")), F.concat(F.lit("price:"), S.band(F.col("price"), PRICE_EDGES, PRICE_BANDS))))
    return accuracy_slices(frame.withColumn("slice", F.explode(tags)), ["slice"])


def top_k(frame: DataFrame, k: int, by: str, predicted: str = "predicted", actual: str = "actual", tiebreak: str = "player_code") -> DataFrame:
    """Mean overlap of predicted and actual top k within each ``by``, and its lift over chance."""
    p = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(predicted), tiebreak))
    a = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(actual), tiebreak))
    ranked = frame.where(F.col(predicted).isNotNull() & F.col(actual).isNotNull()).withColumn("_p", p).withColumn("_a", a)
    each = ranked.groupBy(by).agg(F.count_if((F.col("_p") <= k) & (F.col("_a") <= k)).alias("_both"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= k)
    return each.agg(F.lit(k).alias("k"), F.avg(F.col("_both") / F.lit(k)).alias("precision"), F.avg((F.col("_both") / F.lit(k)) / (F.lit(k) / F.col("_n"))).alias("lift"))


def running(frame: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Running sum, its peak so far (at least 0) and the fall below the peak."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = frame.withColumn("running", F.sum(value).over(w))
    return out.withColumn("peak", F.greatest(F.lit(0).cast("double"), F.max("running").over(w))).withColumn("drawdown", F.col("peak") - F.col("running"))


def run_metrics(frame: DataFrame, by: Sequence[str], order: Sequence[str], value: str, baseline: str) -> DataFrame:
    """Total, mean, spread, worst and best, win rate against a baseline, regret and deepest drawdown of each run."""
    w = running(frame, by, order, value)
    return w.groupBy(*by).agg(F.sum(value).alias("total"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.min(value).alias("worst"), F.max(value).alias("best"), F.avg((F.col(value) > F.col(baseline)).cast("int")).alias("win_rate"), F.sum(F.greatest(F.lit(0.0), F.col(baseline) - F.col(value))).alias("regret"), F.max("drawdown").alias("max_drawdown"))


def transitions(frame: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """Rows at which a key's value isn't what it was."""
    w = Window.partitionBy(key).orderBy(*order)
    return frame.withColumn("previous", F.lag(value).over(w)).where(F.col("previous").isNotNull() & (F.col("previous") != F.col(value)))


def ranking_churn(frame: DataFrame, week: str, entity: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(1 - rank correlation) / 2 between consecutive weeks, over the entities of both; within each ``by``, if given."""
    weeks = frame.select(*by, week).distinct().withColumn("next_week", F.lead(week).over(Window.partitionBy(*by).orderBy(week))).where("next_week IS NOT NULL")
    now = frame.select(*by, week, F.col(entity), F.col(value).alias("now")).join(weeks, [*by, week])
    then = frame.select(*by, F.col(week).alias("next_week"), F.col(entity), F.col(value).alias("then"))
    return spearman(now.join(then, [*by, "next_week", entity]), "now", "then", [*by, week]).withColumn("churn", (1 - F.col("spearman")) / 2)


def weighted_importance(frame: DataFrame) -> DataFrame:
    """Importance of each feature: mean weighted by rows, and its spread of rank over folds (feature, label, fold, delta, weight)."""
    rank = F.row_number().over(Window.partitionBy("fold", "label").orderBy(F.desc("delta"), "feature"))
    spread = frame.withColumn("_rank", rank).groupBy("feature", "label").agg(F.stddev_samp("_rank").alias("_sd")).groupBy("feature").agg(F.avg("_sd").alias("rank_spread"))
    return frame.groupBy("feature").agg((F.sum(F.col("delta") * F.col("weight")) / F.sum("weight")).alias("importance")).join(spread, "feature")


def family_importance(frame: DataFrame, families: DataFrame) -> DataFrame:
    """Importance summed by family, with the number of its features (families: feature, family; others are "other")."""
    each = weighted_importance(frame).join(families, "feature", "left")
    return each.groupBy(F.coalesce("family", F.lit("other")).alias("family")).agg(F.sum("importance").alias("importance"), F.count(F.lit(1)).alias("features"))


def label_importance(frame: DataFrame) -> DataFrame:
    """Mean importance of each feature for each label, over folds."""
    return frame.groupBy("feature", "label").agg(F.avg("delta").alias("importance"), F.count(F.lit(1)).alias("folds"))


def aggregate_runs(frame: DataFrame, by: Sequence[str], value: str, label: str) -> DataFrame:
    """Mean, median, population spread, percentiles, and the labels of worst and best."""
    q = lambda p: F.percentile(value, p)
    return frame.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), q(0.5).alias("median"), F.stddev_pop(value).alias("sd"), q(0.05).alias("p5"), q(0.25).alias("p25"), q(0.75).alias("p75"), q(0.95).alias("p95"), F.min_by(label, F.struct(value, label)).alias("worst"), F.max_by(label, F.struct(value, label)).alias("best"))


def paired_comparison(a: DataFrame, b: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Wins, losses, ties, mean difference and its standardised size over shared conditions."""
    return _differences(a, b, on, value).agg(*_comparison())


def _differences(a: DataFrame, b: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    return a.select(*on, F.col(value).alias("_a")).join(b.select(*on, F.col(value).alias("_b")), list(on)).withColumn("_d", F.col("_a") - F.col("_b"))


def _comparison() -> list[Column]:
    d = F.col("_d")
    return [F.count(F.lit(1)).alias("n"), F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"), F.count_if(d == 0).alias("ties"), F.avg("_d").alias("mean_difference"), F.when(F.stddev_samp("_d") > 0, F.avg("_d") / F.stddev_samp("_d")).alias("effect")]


def seed_sensitivity(a: DataFrame, b: DataFrame, on: Sequence[str], value: str, seed: str = "seed") -> DataFrame:
    """How far a comparison hangs on the draw: over seeds, the least, greatest and spread of the mean difference, and whether its sign holds."""
    each = _differences(a, b, on, value).groupBy(seed).agg(F.avg("_d").alias("m"))
    return each.agg(F.count(F.lit(1)).alias("seeds"), F.min("m").alias("least"), F.max("m").alias("greatest"), F.stddev_pop("m").alias("spread"), (F.min(F.signum("m")) == F.max(F.signum("m"))).alias("sign_holds"))


def subgroup_gain(frame: DataFrame, segment: str, base: str, full: str, actual: str, least: int = 200) -> DataFrame:
    """MAE of two predictions in each segment of enough rows, and the gain."""
    mae = lambda c: F.avg(F.abs(F.col(c) - F.col(actual)))
    return frame.groupBy(segment).agg(F.count(F.lit(1)).alias("n"), mae(base).alias("base_mae"), mae(full).alias("full_mae")).where(F.col("n") >= least).withColumn("gain", 1 - F.col("full_mae") / F.col("base_mae"))


def calibration_bins(frame: DataFrame, predicted: str, actual: str, bins: int = 10, order: Sequence[str] = ()) -> DataFrame:
    """Equal-count bins by prediction, ties by ``order`` (then by outcome); the first bins take one row more where rows don't divide."""
    placed = places(frame, [], predicted, [*order, actual], "_place")
    size = frame.agg(F.count(F.lit(1)).alias("_rows"))
    return placed.crossJoin(F.broadcast(size)).withColumn("bin", ntile(F.col("_place"), F.col("_rows"), bins)).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(predicted).alias("predicted"), F.avg(actual).alias("actual"))


def calibration_error(frame: DataFrame, predicted: str, actual: str, bins: int = 10, order: Sequence[str] = ()) -> DataFrame:
    """The mean distance of predictions and outcomes over equal-count bins, by rows; null below ``bins`` rows."""
    each = calibration_bins(frame, predicted, actual, bins, order)
    return each.agg(F.when(F.sum("n") >= bins, F.sum(F.col("n") * F.abs(F.col("predicted") - F.col("actual"))) / F.sum("n")).alias("calibration_error"))


def residual_weakness(frame: DataFrame, segment: str, predicted: str, actual: str, least: int = 200) -> DataFrame:
    """Each segment's MAE against the mean of segments' MAE, worst first; segments below ``least`` rows are left out."""
    each = frame.groupBy(segment).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col(predicted) - F.col(actual))).alias("mae")).where((F.col("n") >= least) & (F.col("mae") > 0))
    pooled = each.agg(F.avg("mae").alias("_pooled"))
    return each.crossJoin(F.broadcast(pooled)).select(segment, "n", "mae", (F.col("mae") / F.col("_pooled")).alias("relative_error")).orderBy(F.desc("relative_error"), segment)


def fold_stability(frame: DataFrame, by: Sequence[str], improvement: str) -> DataFrame:
    """Share of folds won, scaled down by how uneven the gains are; 0 below two folds or without a win."""
    x = F.col(improvement)
    won, mean, spread = F.avg((x > 0).cast("int")), F.avg(x), F.stddev_pop(x)
    value = won * F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), spread / (F.abs(mean) + 1e-9)))
    return frame.groupBy(*by).agg(F.count(F.lit(1)).alias("folds"), F.when(F.count(F.lit(1)) >= 2, value).otherwise(0.0).alias("stability"))


def fold_gains(frame: DataFrame, by: Sequence[str], predicted: str, actual: str, base: str) -> DataFrame:
    """Of each fold: MAE, its skill over ``base``; and as probabilities, the gains of log loss and Brier score over it."""
    p, y, b = F.col(predicted), F.col(actual), F.col(base)
    hit = (y > 0).cast("int")
    out = frame.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(p - y)).alias("mae"), F.avg(F.abs(b - y)).alias("base_mae"), F.avg(log_loss(p, hit)).alias("log_loss"), F.avg(log_loss(b, hit)).alias("base_log_loss"), F.avg((p - hit) * (p - hit)).alias("brier"), F.avg((b - hit) * (b - hit)).alias("base_brier"))
    gain = lambda c: F.when(F.col(f"base_{c}") > 0, 1 - F.col(c) / F.col(f"base_{c}"))
    return out.select(*by, "n", "mae", "log_loss", "brier", gain("mae").alias("skill"), gain("log_loss").alias("log_loss_gain"), gain("brier").alias("brier_gain"))


def log_loss(p: Column, y: Column, floor: float = 1e-15) -> Column:
    held = S.clip(p, floor, 1 - floor)
    return -(y * F.log(held) + (1 - y) * F.log(1 - held))


def poisson_deviance(predicted: Column, actual: Column) -> Column:
    mu = F.greatest(predicted, F.lit(1e-9))
    return 2 * (F.when(actual > 0, actual * F.log(actual / mu)).otherwise(0.0) - (actual - mu))

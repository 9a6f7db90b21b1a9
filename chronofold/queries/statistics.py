"""Group-relative windows, accuracy, calibration, runs and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.functions import scalars as S
from chronofold.operators import bootstrap, calibration, metrics
from chronofold.queries.asof import rounded
from chronofold.queries.roles import table


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as predictions: quantity against a value from the keys, with position, price, minutes and week."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("player_code"),
        F.col("l_returnflag").alias("position"),
        F.pmod("l_partkey", F.lit(130)).alias("price"),
        F.pmod("l_suppkey", F.lit(91)).alias("minutes"),
        F.pmod("l_orderkey", F.lit(30)).alias("gameweek_id"),
        F.col("l_quantity").alias("predicted"),
        (F.pmod(F.col("l_partkey") + F.col("l_suppkey"), F.lit(50)) + F.col("l_quantity") / 4).alias("actual"),
    ).groupBy("player_code").agg(*(F.max(c).alias(c) for c in ("position", "price", "minutes", "gameweek_id", "predicted", "actual")))


PRED_SQL = """p AS (SELECT l_orderkey * 8 + l_linenumber AS player_code, max(l_returnflag) AS position, max(l_partkey % 130) AS price, max(l_suppkey % 91) AS minutes, max(l_orderkey % 30) AS gameweek_id,
 max(l_quantity) AS predicted, max((l_partkey + l_suppkey) % 50 + l_quantity / 4) AS actual FROM lineitem GROUP BY 1)"""


def group_relatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "customer").withColumn("v", F.when(F.col("c_custkey") % 17 > 0, F.round("c_acctbal", -2)))
    g = Window.partitionBy("c_mktsegment")
    out = t.select("c_custkey", S.unit_rank(F.col("v"), g).alias("unit_rank"), S.share_of_total(F.col("v"), g).alias("share"), S.deviation(F.col("v"), g).alias("deviation"), S.zscore(F.col("v"), g).alias("zscore"))
    return rounded(out, "unit_rank", "share", "deviation", "zscore")


def accuracy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.accuracy_report(predictions(spark, sf_dir)), "mae", "rmse", "bias", "prediction_sd", "baseline_mae", "spearman", "skill")


def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    out = metrics.top_k(p, 10, "gameweek_id").unionByName(metrics.top_k(p, 20, "gameweek_id")).unionByName(metrics.top_k(p, 50, "gameweek_id"))
    return rounded(out, "precision", "lift")


def drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").withColumn("v", F.col("value") - 50.0)
    return rounded(metrics.running(t, ["user_id"], ["ts", "event_id"], "v").select("user_id", "event_id", "running", "peak", "drawdown"), "running", "peak", "drawdown")


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").withColumn("base", F.lit(50.0))
    out = metrics.run_metrics(t, ["user_id"], ["ts", "event_id"], "value", "base")
    return rounded(out, "total", "mean", "sd", "worst", "best", "win_rate", "regret", "max_drawdown")


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.transitions(table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type"), "user_id", ["ts", "event_id"], "event_type")


def churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    weekly = table(spark, sf_dir, "events").groupBy(F.weekofyear("ts").alias("week"), "user_id").agg(F.sum("value").alias("v"))
    return rounded(metrics.ranking_churn(weekly, "week", "user_id", "v"), "spearman", "churn")


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.aggregate_runs(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", "o_orderkey")
    return rounded(out, "mean", "median", "sd", "p5", "p25", "p75", "p95")


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "events").groupBy("user_id", F.weekofyear("ts").alias("week")).agg(F.sum("value").alias("v"))
    return rounded(metrics.paired_comparison(w.where("week = 2"), w.where("week = 3"), ["user_id"], "v"), "mean_difference", "effect")


def subgroups(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir).withColumn("base", F.lit(25.0))
    return rounded(metrics.subgroup_gain(p, "gameweek_id", "base", "predicted", "actual"), "base_mae", "full_mae", "gain")


def bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.calibration_bins(predictions(spark, sf_dir), "predicted", "actual", 7, ["player_code"]), "predicted", "actual")


def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    out = p.groupBy("position").agg(F.avg(metrics.log_loss(F.col("predicted") / 51, (F.col("actual") > 30).cast("int"))).alias("log_loss"), F.avg(F.pow(F.col("predicted") / 51 - (F.col("actual") > 30).cast("int"), 2)).alias("brier"), F.avg(metrics.poisson_deviance(F.col("predicted"), F.col("actual"))).alias("deviance"))
    return rounded(out, "log_loss", "brier", "deviance")


def importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("label"), F.pmod("l_suppkey", F.lit(5)).alias("fold"), F.concat(F.lit("f"), F.pmod("l_partkey", F.lit(12))).alias("feature")).agg(F.avg("l_discount").alias("delta"), F.count(F.lit(1)).alias("weight"))
    return rounded(metrics.weighted_importance(t), "importance", "rank_spread")


def distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as predictive distributions on 2..7 with integer weights, scored against their size."""
    t = table(spark, sf_dir, "part")
    w = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda k: (F.pmod(F.col("p_partkey") * k + k * k, F.lit(7)) + 1).cast("double"))
    total = F.aggregate("w", F.lit(0.0), lambda s, x: s + x)
    rows = t.select("p_partkey", F.pmod("p_size", F.lit(10)).cast("int").alias("actual"), F.lit(2).alias("pmf_support_min"), w.alias("w")).withColumn("pmf", F.transform("w", lambda x: x / total))
    return calibration.score_distributions(rows, ["p_partkey"]).drop("w")


def crps(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = distributions(spark, sf_dir).select("p_partkey", "mean", "sd", "crps", "pinball_50", "inside_80")
    return rounded(out, "mean", "sd", "crps", "pinball_50")


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = calibration.coverage_report(distributions(spark, sf_dir), ["actual"])
    return rounded(out, *(c for c in out.columns if c not in ("actual", "n")))


def calibration_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = distributions(spark, sf_dir).withColumns({"position": F.element_at(F.array(*map(F.lit, ("GKP", "DEF", "MID", "FWD"))), (F.pmod("p_partkey", F.lit(4)) + 1).cast("int")), "price": F.pmod("p_partkey", F.lit(130)), "minutes": F.pmod(F.col("p_partkey") * 7, F.lit(91)), "predicted": F.round("mean", 3)})
    out = calibration.calibration_report(t, "p_partkey").select("slice", "n", "crps", "coverage_80", "margin_80", "width_80", "degenerate")
    return rounded(out, "crps", "coverage_80", "margin_80", "width_80")


def _pit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select((F.pmod(F.col("p_partkey") * 7919, F.lit(10007)) / 10007.0).alias("pit"))


def pit_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.pit_histogram(_pit(spark, sf_dir))


def cramer_von_mises(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibration.cramer_von_mises(_pit(spark, sf_dir)), "cvm")


def randomised_pit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Randomised PITs of all parts lie between F(y - 1) and F(y)."""
    t = distributions(spark, sf_dir)
    low, high = calibration.cdf_at(F.col("pmf"), F.col("pmf_support_min"), F.col("actual") - 1), calibration.cdf_at(F.col("pmf"), F.col("pmf_support_min"), F.col("actual"))
    return t.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("pit") >= low - 1e-12) & (F.col("pit") <= high + 1e-12)).alias("within"))


def pinball_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"pinball_{round(q * 100)}" for q in calibration.LEVELS]
    out = distributions(spark, sf_dir).groupBy("actual").agg(*(F.avg(c).alias(c) for c in names))
    return rounded(out, *names)


def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.calibration_error(predictions(spark, sf_dir), "predicted", "actual", 7, ["player_code"]), "calibration_error")


def weakness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.residual_weakness(predictions(spark, sf_dir), "gameweek_id", "predicted", "actual"), "mae", "relative_error")


def stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = predictions(spark, sf_dir).groupBy("position", F.pmod("gameweek_id", F.lit(5)).alias("fold")).agg(F.avg(F.col("actual") - 30.0).alias("gain"))
    return rounded(metrics.fold_stability(each, ["position"], "gain"), "stability")


def fold_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir).withColumns({"p": F.col("predicted") / 51, "y": F.greatest(F.lit(0.0), F.col("actual") - 30.0), "b": F.lit(0.4)})
    out = metrics.fold_gains(p, ["gameweek_id"], "p", "y", "b")
    return rounded(out, *(c for c in out.columns if c not in ("gameweek_id", "n")))


def _importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("label"), F.pmod("l_suppkey", F.lit(5)).alias("fold"), F.concat(F.lit("f"), F.pmod("l_partkey", F.lit(12))).alias("feature")).agg(F.avg("l_discount").alias("delta"), F.count(F.lit(1)).alias("weight"))


def family_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    families = table(spark, sf_dir, "part").select(F.concat(F.lit("f"), F.pmod("p_partkey", F.lit(12))).alias("feature"), F.when(F.pmod("p_partkey", F.lit(12)) < 5, "low").otherwise("high").alias("family")).distinct().where("feature <> 'f11'")
    return rounded(metrics.family_importance(_importances(spark, sf_dir), families), "importance")


def label_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.label_importance(_importances(spark, sf_dir)), "importance")


def seed_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "events").groupBy("user_id", F.weekofyear("ts").alias("week"), F.pmod("event_id", F.lit(4)).alias("seed")).agg(F.sum("value").alias("v"))
    return rounded(metrics.seed_sensitivity(w.where("week = 2"), w.where("week = 3"), ["user_id", "seed"], "v"), "least", "greatest", "spread")


def gaussian_pmf(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 5.0).alias("m"), (F.col("p_size") / 20.0 + 0.5).alias("s"))
    out = calibration.gaussian_pmf(t, "m", "s", 0, 15).withColumn("actual", F.lit(3))
    return out.select("p_partkey", F.round(calibration.mean_of(F.col("pmf"), F.col("pmf_support_min")), 6).alias("mean"), F.round(calibration.crps(F.col("pmf"), F.col("pmf_support_min"), F.col("actual")), 6).alias("crps"))


def block_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of the mean order, 10,000 resamples each: of years (drawn), of days (weighed), and of two halves, too few, so of their priorities."""
    orders = table(spark, sf_dir, "orders").withColumns({"year": F.year("o_orderdate"), "day": F.date_format("o_orderdate", "yyyy-MM-dd"), "half": F.pmod("o_orderkey", F.lit(2))})
    runs = [("year", ()), ("day", ()), ("half", ("half", "o_orderpriority"))]
    out = [bootstrap.block_bootstrap(orders, by, "o_totalprice", condition=c).withColumn("by", F.lit(by)) for by, c in runs]
    return rounded(out[0].unionByName(out[1]).unionByName(out[2]), "low", "mean", "high")


QUERIES = {
    "group_relatives": group_relatives,
    "accuracy_report": accuracy_report,
    "top_k_overlap": top_k,
    "drawdown": drawdown,
    "run_metrics": run_metrics,
    "transitions": transitions,
    "ranking_churn": churn,
    "run_summary": run_summary,
    "paired_comparison": paired,
    "subgroup_gain": subgroups,
    "calibration_bins": bins,
    "losses": losses,
    "importance": importance,
    "crps": crps,
    "interval_coverage": coverage,
    "pit_histogram": pit_histogram,
    "cramer_von_mises": cramer_von_mises,
    "randomised_pit": randomised_pit,
    "pinball_losses": pinball_losses,
    "calibration_report": calibration_report,
    "calibration_error": calibration_error,
    "residual_weakness": weakness,
    "fold_stability": stability,
    "fold_gains": fold_gains,
    "family_importance": family_importance,
    "label_importance": label_importance,
    "seed_sensitivity": seed_sensitivity,
    "gaussian_pmf": gaussian_pmf,
    "block_bootstrap": block_bootstrap,
}


def _avg_rank(c: str, over: str) -> str:
    return f"(rank() OVER ({over} ORDER BY {c}) + (count({c}) OVER ({over} ORDER BY {c} RANGE BETWEEN CURRENT ROW AND CURRENT ROW) - 1) / 2.0)"


_UNIFORM = "('0x' || substr(md5({key}), 8 * {k} + 1, 8))::BIGINT / 4294967296.0"
_POISSON = "(" + " + ".join(f"(u >= {p!r})::INT" for p in bootstrap.POISSON) + ")"


def _drawn_sql(blocks: str) -> str:
    u = _UNIFORM.format(key="'20260727:' || r || ':' || (d // 4)", k="(d % 4)")
    return f"""(SELECT quantile_cont(m, 0.025) AS low, avg(m) AS mean, quantile_cont(m, 0.975) AS high, any_value(k) AS blocks FROM
  (SELECT r, sum(s) / sum(n) AS m, any_value(k) AS k FROM (SELECT r, d, floor({u} * k) AS i, k FROM range(10000) a(r), (SELECT count(*) AS k FROM {blocks}), range(512) b(d) WHERE d < k) JOIN
   (SELECT s, n, row_number() OVER (ORDER BY b) - 1 AS i FROM {blocks}) USING (i) GROUP BY r))"""


ORACLE = {
    "block_bootstrap": f"""WITH o AS (SELECT *, year(o_orderdate)::VARCHAR AS y, strftime(o_orderdate, '%Y-%m-%d') AS day, '{{"half":' || (o_orderkey % 2) || ',"o_orderpriority":"' || o_orderpriority || '"}}' AS half FROM orders),
 y AS (SELECT y AS b, sum(o_totalprice) AS s, count(*) AS n FROM o GROUP BY ALL), d AS (SELECT day AS b, sum(o_totalprice) AS s, count(*) AS n FROM o GROUP BY ALL), h AS (SELECT half AS b, sum(o_totalprice) AS s, count(*) AS n FROM o GROUP BY ALL),
 w AS (SELECT r, sum({_POISSON} * s) / sum({_POISSON} * n) AS m FROM (SELECT r, s, n, {_UNIFORM.format(key="'20260727:' || b || ':' || (r // 4)", k="(r % 4)")} AS u FROM d, range(10000) a(r)) GROUP BY r)
SELECT 'year' AS by, round(low, 6) AS low, round(mean, 6) AS mean, round(high, 6) AS high, blocks, 'drawn' AS how FROM {_drawn_sql("y")}
UNION ALL SELECT 'half', round(low, 6), round(mean, 6), round(high, 6), blocks, 'drawn' FROM {_drawn_sql("h")}
UNION ALL SELECT 'day', round(quantile_cont(m, 0.025), 6), round(avg(m), 6), round(quantile_cont(m, 0.975), 6), (SELECT count(*) FROM d), 'weighed' FROM w""",
    "group_relatives": f"""WITH t AS (SELECT c_custkey, c_mktsegment AS g, CASE WHEN c_custkey % 17 > 0 THEN round(c_acctbal / 100) * 100 + 0.0 END AS v FROM customer)
SELECT c_custkey, CASE WHEN v IS NOT NULL THEN round((rank() OVER (PARTITION BY g ORDER BY v NULLS LAST) + (count(v) OVER (PARTITION BY g ORDER BY v RANGE BETWEEN CURRENT ROW AND CURRENT ROW) - 1) / 2.0 - 1) / (count(v) OVER (PARTITION BY g) - 1), 6) END AS unit_rank,
 round(v / sum(v) OVER (PARTITION BY g), 6) AS share, round(v - avg(v) OVER (PARTITION BY g), 6) AS deviation, round((v - avg(v) OVER (PARTITION BY g)) / stddev_samp(v) OVER (PARTITION BY g), 6) AS zscore FROM t""",
    "accuracy_report": f"""WITH {PRED_SQL}, s AS (SELECT 'overall' AS slice, * FROM p UNION ALL SELECT 'played', * FROM p WHERE minutes > 0 UNION ALL SELECT 'position:' || position, * FROM p
  UNION ALL SELECT 'price:' || CASE WHEN price < 55 THEN 'budget' WHEN price < 80 THEN 'mid' WHEN price < 110 THEN 'premium' ELSE 'elite' END, * FROM p),
 r AS (SELECT *, avg(actual) OVER (PARTITION BY slice) AS m, {_avg_rank('predicted', 'PARTITION BY slice')} AS rp, {_avg_rank('actual', 'PARTITION BY slice')} AS ra FROM s),
 a AS (SELECT slice, count(*) AS n, avg(abs(predicted - actual)) AS mae, sqrt(avg((predicted - actual) ** 2)) AS rmse, avg(predicted - actual) AS bias, stddev_pop(predicted) AS sd, avg(abs(actual - m)) AS b, covar_pop(rp, ra) / (stddev_pop(rp) * stddev_pop(ra)) AS rho FROM r GROUP BY slice)
SELECT slice, n, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(bias, 6) AS bias, round(sd, 6) AS prediction_sd, round(b, 6) AS baseline_mae, round(rho, 6) AS spearman, sd < 1e-6 AS degenerate, round(1 - mae / b, 6) AS skill FROM a""",
    "top_k_overlap": f"""WITH {PRED_SQL}, r AS (SELECT gameweek_id, row_number() OVER (PARTITION BY gameweek_id ORDER BY predicted DESC, player_code) AS rp, row_number() OVER (PARTITION BY gameweek_id ORDER BY actual DESC, player_code) AS ra FROM p),
 e AS (SELECT k::INT AS k, gameweek_id, count(*) FILTER (WHERE rp <= k AND ra <= k) AS b, count(*) AS n FROM r, (VALUES (10), (20), (50)) v(k) GROUP BY ALL HAVING count(*) >= max(k))
SELECT k, round(avg(b / k), 6) AS precision, round(avg((b / k) / (k / n)), 6) AS lift FROM e GROUP BY k""",
    "drawdown": """WITH r AS (SELECT user_id, event_id, ts, sum(value - 50.0) OVER w AS running FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
 k AS (SELECT *, greatest(0.0, max(running) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS peak FROM r)
SELECT user_id, event_id, round(running, 6) AS running, round(peak, 6) AS peak, round(peak - running, 6) AS drawdown FROM k""",
    "run_metrics": """WITH r AS (SELECT *, sum(value) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
 k AS (SELECT *, greatest(0.0, max(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) - c AS d FROM r)
SELECT user_id, round(sum(value), 6) AS total, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(min(value), 6) AS worst, round(max(value), 6) AS best, round(avg((value > 50)::INT), 6) AS win_rate,
 round(sum(greatest(0.0, 50.0 - value)), 6) AS regret, round(max(d), 6) AS max_drawdown FROM k GROUP BY user_id""",
    "transitions": "SELECT user_id, event_id, ts, event_type, lag(event_type) OVER w AS previous FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id) QUALIFY previous IS NOT NULL AND previous <> event_type",
    "ranking_churn": f"""WITH w AS (SELECT weekofyear(ts)::INT AS week, user_id, sum(value) AS v FROM events GROUP BY ALL), n AS (SELECT week, lead(week) OVER (ORDER BY week) AS nw FROM (SELECT DISTINCT week FROM w)),
 b AS (SELECT a.week, a.v AS x, c.v AS y FROM w a JOIN n USING (week) JOIN w c ON c.week = n.nw AND c.user_id = a.user_id),
 r AS (SELECT week, {_avg_rank('x', 'PARTITION BY week')} AS rx, {_avg_rank('y', 'PARTITION BY week')} AS ry FROM b),
 s AS (SELECT week, CASE WHEN stddev_pop(rx) > 1e-6 AND stddev_pop(ry) > 1e-6 THEN covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) ELSE 0 END AS rho FROM r GROUP BY week)
SELECT week, round(rho, 6) AS spearman, round((1 - rho) / 2, 6) AS churn FROM s""",
    "run_summary": """SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 6) AS mean, round(quantile_cont(o_totalprice, 0.5), 6) AS median, round(stddev_pop(o_totalprice), 6) AS sd, round(quantile_cont(o_totalprice, 0.05), 6) AS p5, round(quantile_cont(o_totalprice, 0.25), 6) AS p25,
 round(quantile_cont(o_totalprice, 0.75), 6) AS p75, round(quantile_cont(o_totalprice, 0.95), 6) AS p95, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS worst, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS best FROM orders GROUP BY ALL""",
    "paired_comparison": """WITH w AS (SELECT user_id, weekofyear(ts) AS week, sum(value) AS v FROM events GROUP BY ALL), d AS (SELECT a.v - b.v AS d FROM w a JOIN w b USING (user_id) WHERE a.week = 2 AND b.week = 3)
SELECT count(*) AS n, count(*) FILTER (WHERE d > 0) AS wins, count(*) FILTER (WHERE d < 0) AS losses, count(*) FILTER (WHERE d = 0) AS ties, round(avg(d), 6) AS mean_difference, round(avg(d) / stddev_samp(d), 6) AS effect FROM d""",
    "subgroup_gain": f"WITH {PRED_SQL} SELECT gameweek_id, count(*) AS n, round(avg(abs(25.0 - actual)), 6) AS base_mae, round(avg(abs(predicted - actual)), 6) AS full_mae, round(1 - avg(abs(predicted - actual)) / avg(abs(25.0 - actual)), 6) AS gain FROM p GROUP BY ALL HAVING count(*) >= 200",
    "calibration_bins": f"WITH {PRED_SQL}, b AS (SELECT *, ntile(7) OVER (ORDER BY predicted, player_code)::INT AS bin FROM p) SELECT bin, count(*) AS n, round(avg(predicted), 6) AS predicted, round(avg(actual), 6) AS actual FROM b GROUP BY ALL",
    "losses": f"""WITH {PRED_SQL} SELECT position, round(avg(CASE WHEN actual > 30 THEN -ln(predicted / 51) ELSE -ln(1 - predicted / 51) END), 6) AS log_loss, round(avg((predicted / 51 - (actual > 30)::INT) ** 2), 6) AS brier,
 round(avg(2 * (CASE WHEN actual > 0 THEN actual * ln(actual / predicted) ELSE 0 END - (actual - predicted))), 6) AS deviance FROM p GROUP BY ALL""",
    "importance": """WITH t AS (SELECT l_returnflag AS label, l_suppkey % 5 AS fold, 'f' || (l_partkey % 12) AS feature, avg(l_discount) AS delta, count(*) AS weight FROM lineitem GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY fold, label ORDER BY delta DESC, feature) AS rk FROM t), s AS (SELECT feature, avg(sd) AS rank_spread FROM (SELECT feature, label, stddev_samp(rk) AS sd FROM r GROUP BY ALL) GROUP BY feature)
SELECT t.feature, round(sum(delta * weight) / sum(weight), 6) AS importance, round(max(rank_spread), 6) AS rank_spread FROM t JOIN s USING (feature) GROUP BY ALL""",
    "crps": """WITH w AS (SELECT p_partkey, (p_size % 10)::INT AS y, [((p_partkey * k + k * k) % 7 + 1)::DOUBLE FOR k IN range(1, 7)] AS w FROM part), f AS (SELECT p_partkey, y, [x / list_sum(w) FOR x IN w] AS f FROM w),
 c AS (SELECT *, [list_sum(f[1:i]) FOR i IN range(1, 7)] AS c, list_sum([f[i] * (1 + i) FOR i IN range(1, 7)]) AS m FROM f), q AS (SELECT *, 2 + least(5, len(list_filter(c, lambda x: x < 0.5 - 1e-12))) AS q5, 2 + least(5, len(list_filter(c, lambda x: x < 0.1 - 1e-12))) AS lo, 2 + least(5, len(list_filter(c, lambda x: x < 0.9 - 1e-12))) AS hi FROM c)
SELECT p_partkey, round(m, 6) AS mean, round(sqrt(greatest(0, list_sum([f[i] * (1 + i) * (1 + i) FOR i IN range(1, 7)]) - m * m)), 6) AS sd,
 round(list_sum([(c[i] - CASE WHEN y <= 1 + i THEN 1 ELSE 0 END) ** 2 FOR i IN range(1, 7)]) + greatest(0, 2 - y) + greatest(0, y - 8), 6) AS crps, round(CASE WHEN y >= q5 THEN 0.5 * (y - q5) ELSE 0.5 * (q5 - y) END, 6) AS pinball_50, (y BETWEEN lo AND hi)::INT AS inside_80 FROM q""",
}

_CDF = """w AS (SELECT p_partkey, (p_size % 10)::INT AS y, [((p_partkey * k + k * k) % 7 + 1)::DOUBLE FOR k IN range(1, 7)] AS w FROM part), f AS (SELECT p_partkey, y, [x / list_sum(w) FOR x IN w] AS f FROM w),
 c AS (SELECT *, [list_sum(f[1:i]) FOR i IN range(1, 7)] AS c, list_sum([f[i] * (1 + i) FOR i IN range(1, 7)]) AS m FROM f), q AS (SELECT *, list_sum([(c[i] - CASE WHEN y <= 1 + i THEN 1 ELSE 0 END) ** 2 FOR i IN range(1, 7)]) + greatest(0, 2 - y) + greatest(0, y - 8) AS crps, {quantiles} FROM c)"""
_AT = lambda q, name: f"2 + least(5, len(list_filter(c, lambda x: x < {q} - 1e-12))) AS {name}"
_BOUNDS = _CDF.format(quantiles=", ".join(_AT(round(v, 6), f"{n}{round(c * 100)}") for c in calibration.COVERAGES for n, v in (("lo", (1 - c) / 2), ("hi", (1 + c) / 2))))


def _covered(level: int) -> str:
    share = f"avg((y BETWEEN lo{level} AND hi{level})::INT)"
    return f"round({share}, 6) AS coverage_{level}, round(1.96 * sqrt({share} * (1 - {share}) / count(*)), 6) AS margin_{level}, round(avg(hi{level} - lo{level}), 6) AS width_{level}"


_LEVELS = _CDF.format(quantiles=", ".join(_AT(q, f"q{round(q * 100)}") for q in calibration.LEVELS))
_IMPORTANCE = "t AS (SELECT l_returnflag AS label, l_suppkey % 5 AS fold, 'f' || (l_partkey % 12) AS feature, avg(l_discount) AS delta, count(*) AS weight FROM lineitem GROUP BY ALL)"
_PIT = "p AS (SELECT (p_partkey * 7919 % 10007) / 10007.0 AS u FROM part)"
ORACLE |= {
    "interval_coverage": f"WITH {_BOUNDS} SELECT y AS actual, count(*) AS n, round(avg(crps), 6) AS crps, {', '.join(_covered(round(c * 100)) for c in calibration.COVERAGES)} FROM q GROUP BY y",
    "pinball_losses": f"WITH {_LEVELS} SELECT y AS actual, {', '.join(f'round(avg(CASE WHEN y >= q{round(v * 100)} THEN {v} * (y - q{round(v * 100)}) ELSE {round(1 - v, 6)} * (q{round(v * 100)} - y) END), 6) AS pinball_{round(v * 100)}' for v in calibration.LEVELS)} FROM q GROUP BY y",
    "randomised_pit": "SELECT count(*) AS n, count(*) AS within FROM part",
    "calibration_report": f"""WITH {_BOUNDS}, d AS (SELECT *, ['GKP', 'DEF', 'MID', 'FWD'][p_partkey % 4 + 1] AS pos, p_partkey % 130 AS price, (p_partkey * 7) % 91 AS minutes, count(*) OVER () AS n, row_number() OVER (ORDER BY round(m, 3), p_partkey) AS r, sqrt(greatest(0, list_sum([f[i] * (1 + i) * (1 + i) FOR i IN range(1, 7)]) - m * m)) AS sd FROM q),
 s AS (SELECT 'overall' AS slice, * FROM d UNION ALL SELECT 'appeared only', * FROM d WHERE minutes > 0 UNION ALL SELECT 'position:' || pos, * FROM d
  UNION ALL SELECT 'price:' || CASE WHEN price < 55 THEN 'budget' WHEN price < 80 THEN 'mid' WHEN price < 110 THEN 'premium' ELSE 'elite' END, * FROM d
  UNION ALL SELECT 'minutes:' || CASE WHEN minutes < 1 THEN 'did not play' WHEN minutes < 60 THEN 'cameo (1-59)' ELSE 'started (60+)' END, * FROM d UNION ALL SELECT 'decile:' || least(10, (r - 1) // (n // 10) + 1), * FROM d)
SELECT slice, count(*) AS n, round(avg(crps), 6) AS crps, {_covered(80)}, max(sd) < 1e-6 AS degenerate FROM s GROUP BY slice""",
    "pit_histogram": f"WITH {_PIT} SELECT least(19, floor(u * 20))::INT AS bin, count(*) AS n FROM p GROUP BY ALL",
    "cramer_von_mises": f"WITH {_PIT}, r AS (SELECT u, row_number() OVER (ORDER BY u) AS i, count(*) OVER () AS n FROM p) SELECT round(1 / (12.0 * max(n)) + sum(((2 * i - 1) / (2.0 * n) - u) ** 2), 6) AS cvm FROM r",
    "calibration_error": f"WITH {PRED_SQL}, b AS (SELECT *, ntile(7) OVER (ORDER BY predicted, player_code) AS bin FROM p), e AS (SELECT count(*) AS n, abs(avg(predicted) - avg(actual)) AS d FROM b GROUP BY bin) SELECT round(sum(n * d) / sum(n), 6) AS calibration_error FROM e",
    "residual_weakness": f"WITH {PRED_SQL}, e AS (SELECT gameweek_id, count(*) AS n, avg(abs(predicted - actual)) AS mae FROM p GROUP BY ALL HAVING count(*) >= 200) SELECT gameweek_id, n, round(mae, 6) AS mae, round(mae / (SELECT avg(mae) FROM e), 6) AS relative_error FROM e",
    "fold_stability": f"""WITH {PRED_SQL}, e AS (SELECT position, gameweek_id % 5 AS fold, avg(actual - 30.0) AS g FROM p GROUP BY ALL)
SELECT position, count(*) AS folds, round(CASE WHEN count(*) >= 2 THEN avg((g > 0)::INT) * greatest(0, 1 - least(1, stddev_pop(g) / (abs(avg(g)) + 1e-9))) ELSE 0 END, 6) AS stability FROM e GROUP BY position""",
    "fold_gains": f"""WITH {PRED_SQL}, q AS (SELECT gameweek_id, predicted / 51 AS x, greatest(0, actual - 30.0) AS y, (actual > 30)::INT AS h FROM p),
 e AS (SELECT gameweek_id, count(*) AS n, avg(abs(x - y)) AS mae, avg(abs(0.4 - y)) AS bm, avg(CASE WHEN h = 1 THEN -ln(x) ELSE -ln(1 - x) END) AS ll, avg(CASE WHEN h = 1 THEN -ln(0.4) ELSE -ln(0.6) END) AS bl, avg((x - h) ** 2) AS br, avg((0.4 - h) ** 2) AS bb FROM q GROUP BY ALL)
SELECT gameweek_id, n, round(mae, 6) AS mae, round(ll, 6) AS log_loss, round(br, 6) AS brier, round(1 - mae / bm, 6) AS skill, round(1 - ll / bl, 6) AS log_loss_gain, round(1 - br / bb, 6) AS brier_gain FROM e""",
    "family_importance": f"""WITH {_IMPORTANCE}, i AS (SELECT feature, sum(delta * weight) / sum(weight) AS w FROM t GROUP BY ALL)
SELECT CASE WHEN feature = 'f11' THEN 'other' WHEN feature IN ('f0', 'f1', 'f2', 'f3', 'f4') THEN 'low' ELSE 'high' END AS family, round(sum(w), 6) AS importance, count(*) AS features FROM i GROUP BY ALL""",
    "label_importance": f"WITH {_IMPORTANCE} SELECT feature, label, round(avg(delta), 6) AS importance, count(*) AS folds FROM t GROUP BY ALL",
    "seed_sensitivity": """WITH w AS (SELECT user_id, weekofyear(ts) AS week, event_id % 4 AS seed, sum(value) AS v FROM events GROUP BY ALL), d AS (SELECT seed, avg(a.v - b.v) AS m FROM w a JOIN w b USING (user_id, seed) WHERE a.week = 2 AND b.week = 3 GROUP BY seed)
SELECT count(*) AS seeds, round(min(m), 6) AS least, round(max(m), 6) AS greatest, round(stddev_pop(m), 6) AS spread, min(sign(m)) = max(sign(m)) AS sign_holds FROM d""",
}

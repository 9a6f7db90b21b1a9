"""Feature families, feature programs, leakage checks, deadlines and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.operators import families, leakage, rolling
from chronofold.plans import compile as C
from chronofold.plans import folds
from chronofold.plans.nodes import Arith, ClusterRel, EwmMean, FeatureProgram, GroupRel, Lag, Rolling, ShrunkRate, Source, TimeSince, Trend, Unary
from chronofold.queries.asof import rounded
from chronofold.queries.roles import ORDER_SQL, YEARLY_SQL, order_history, yearly_entities


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_history(spark, sf_dir)


def team_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = _history(spark, sf_dir).withColumn("expected_goals_conceded", F.col("expected_goals") / 2)
    return rounded(families.team_totals(stats, ["opponent_team_id", "season", "gameweek_id"]), "team_xg_for", "team_xg_against")


def opponent_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(families.opponent_strength(_history(spark, sf_dir).drop("fixture_id")), "conceded_xg")


def opponent_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = yearly_entities(spark, sf_dir).drop("position")
    strength = families.opponent_strength(_history(spark, sf_dir))
    return rounded(families.opponent_features(entities, strength), *(f"opponent_{m}_mean_{w}" for m in families.OPPONENT_METRICS for w in families.OPPONENT_WINDOWS))


def _opponent_sql() -> str:
    cols = ", ".join(f"round(avg({m}) FILTER (WHERE k <= {w}), 6) AS opponent_{m}_mean_{w}" for w in families.OPPONENT_WINDOWS for m in families.OPPONENT_METRICS)
    return f"""WITH {ORDER_SQL}, {YEARLY_SQL}, s AS (
      SELECT opponent_team_id, season, gameweek_id, fixture_id, sum(expected_goals) AS conceded_xg, sum(goals_scored)::DOUBLE AS conceded_goals, sum(total_points)::DOUBLE AS conceded_points,
        max(clean_sheets)::DOUBLE AS clean_sheets_against, max(available_time) AS a, max(kickoff_time) AS o FROM hist GROUP BY ALL), r AS (
      SELECT e.player_code, e.opponent_team_id, e.was_home, e.prediction_timestamp, s.conceded_xg, s.conceded_goals, s.conceded_points, s.clean_sheets_against,
        row_number() OVER (PARTITION BY e.player_code, e.prediction_timestamp ORDER BY s.a DESC, s.o DESC, s.season DESC, s.gameweek_id DESC, s.fixture_id DESC) AS k
      FROM ents e LEFT JOIN s ON s.opponent_team_id = e.opponent_team_id AND s.a <= e.prediction_timestamp)
    SELECT player_code, opponent_team_id, was_home, prediction_timestamp, {cols}, was_home::INT::DOUBLE AS is_home FROM r GROUP BY ALL"""


def career(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = _history(spark, sf_dir)
    out = families.career_features(yearly_entities(spark, sf_dir).select("player_code", "prediction_timestamp"), stats, floor_minutes=100, rates={"goals": "goals_scored", "points": "total_points"})
    return rounded(out, *(c for c, t in out.dtypes if t == "double"))


def recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = families.recency_features(yearly_entities(spark, sf_dir).select("player_code", "prediction_timestamp"), _history(spark, sf_dir), ["player_code", "prediction_timestamp"])
    return rounded(out, *(c for c, t in out.dtypes if t == "double"))


def deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.deadlines(_history(spark, sf_dir))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.labels(_history(spark, sf_dir), ["minutes", "total_points", "goals_scored"])


def training_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = _history(spark, sf_dir)
    out = families.training_frame(families.deadlines(stats), stats, ["minutes", "total_points"], {"points_mean_5": ("total_points", "mean", 5), "minutes_sum_3": ("minutes", "sum", 3)})
    return rounded(out, "points_mean_5")


def actuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points and minutes of all players and weeks, and their number of fixtures."""
    return families.actuals(_history(spark, sf_dir), ["minutes", "total_points"])


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.timeline(_history(spark, sf_dir)).groupBy("season", "gameweek_id", "timeline").agg(F.count(F.lit(1)).alias("n"))


def last_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = _history(spark, sf_dir).withColumn("value", F.when(F.col("minutes") % 3 > 0, F.col("fixture_id")))
    return families.last_value(stats, ["player_code", "season"], "value", ["kickoff_time", "fixture_id"])


def season_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.season_lines(_history(spark, sf_dir), ["minutes", "goals_scored", "total_points"])


def fold_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = families.timeline(_history(spark, sf_dir))
    times = [r[0] for r in frame.select("timeline").distinct().orderBy("timeline").collect()]
    rows = folds.fold_rows(frame, folds.walk_forward(times, 100, 50, embargo=4))
    return rows.groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("total_points").alias("points"))


def programs() -> list[FeatureProgram]:
    points, minutes, goals = Source("total_points"), Source("minutes"), Source("goals_scored")
    return [
        FeatureProgram("rate_x_minutes", Arith("mul", ShrunkRate("goals_scored", "minutes", 5), Rolling(minutes, 5))),
        FeatureProgram("since_goal", TimeSince("goals_scored")),
        FeatureProgram("lag_2", Lag(points, 2)),
        FeatureProgram("median_5", Rolling(points, 5, "median")),
        FeatureProgram("p75_8", Rolling(points, 8, "percentile", quantile=0.75)),
        FeatureProgram("std_6", Rolling(points, 6, "std", min_periods=3)),
        FeatureProgram("ewm_6", EwmMean(points, 6, 2.0)),
        FeatureProgram("trend_5", Trend(points, 5)),
        FeatureProgram("ratio", Arith("safe_div", Rolling(goals, 10, "sum"), Rolling(Arith("add", minutes, points), 10, "sum"))),
        FeatureProgram("log_clip", Unary("log1p", Unary("clip", Rolling(points, 3), 1.0, 8.0))),
        FeatureProgram("position_z", GroupRel("zscore", "position", Rolling(points, 5))),
        FeatureProgram("position_share", GroupRel("share", "position", Rolling(points, 5))),
        FeatureProgram("opponent_rank", GroupRel("rank", "opponent", Rolling(points, 5))),
        FeatureProgram("all_dev", GroupRel("dev_from_mean", "all", Rolling(points, 5))),
        FeatureProgram("batch_rank", Unary("percentile_rank", Rolling(points, 5))),
        FeatureProgram("nested", GroupRel("dev_from_mean", "position", GroupRel("rank", "opponent", Rolling(points, 5)))),
    ]


def feature_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen programs of all kinds of nodes, compiled to one plan.

    Sums over a group differ in their last digit by the order of rows, so what they give is rounded a little
    above each half (some are exact halves at six places).
    """
    out = C.compile_programs(yearly_entities(spark, sf_dir).drop("was_home"), _history(spark, sf_dir), programs())
    out = out.withColumns({c: F.col(c) + 1e-9 for c in ("position_z", "position_share", "all_dev", "nested")})
    return rounded(out, *(p.name for p in programs())).withColumn("trend_5", F.col("trend_5") + 0.0)  # no negative zero


def cluster_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs relative to clusters; a customer's memberships come from its number."""
    ids = yearly_entities(spark, sf_dir).select("player_code").distinct()
    members = ids.select("player_code", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("cluster_id")).withColumn("membership_probability", F.pmod(F.col("player_code") * (F.col("cluster_id") + 3), F.lit(11)) / 11.0).withColumn("cluster_model_version", F.lit("v1"))
    base = Rolling(Source("total_points"), 5)
    ps = [FeatureProgram("gated", ClusterRel("gate", base, "v1", 1)), FeatureProgram("cluster_dev", ClusterRel("dev_from_centroid", base, "v1")), FeatureProgram("cluster_rank", ClusterRel("rank", base, "v1"))]
    out = C.compile_programs(yearly_entities(spark, sf_dir).select("player_code", "prediction_timestamp"), _history(spark, sf_dir), ps, C.Context(memberships=members))
    return rounded(out, "gated", "cluster_dev", "cluster_rank")


_RANKED = f"""WITH {ORDER_SQL}, {YEARLY_SQL}, r AS (
  SELECT e.player_code, e.opponent_team_id, e.position, e.prediction_timestamp, h.minutes, h.total_points AS p, h.goals_scored AS g,
    row_number() OVER (PARTITION BY e.player_code, e.prediction_timestamp ORDER BY h.available_time DESC, h.kickoff_time DESC, h.season DESC, h.gameweek_id DESC, h.fixture_id DESC) - 1 AS k
  FROM ents e LEFT JOIN hist h ON h.player_code = e.player_code AND h.available_time <= e.prediction_timestamp)"""


def _unit_rank(c: str, group: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL AND count({c}) OVER ({group}) > 1 THEN (rank() OVER ({group} ORDER BY {c} NULLS LAST) + (count({c}) OVER ({group} ORDER BY {c} RANGE BETWEEN CURRENT ROW AND CURRENT ROW) - 1) / 2.0 - 1) / (count({c}) OVER ({group}) - 1) END"


_PROGRAMS_SQL = f"""{_RANKED}, a AS (
 SELECT player_code, opponent_team_id, position, prediction_timestamp,
  coalesce(sum(g) FILTER (WHERE k < 5), 0) / (coalesce(sum(minutes) FILTER (WHERE k < 5), 0) + 270.0) * 90 AS rate, avg(minutes) FILTER (WHERE k < 5) AS m5,
  max(p) FILTER (WHERE k = 1)::DOUBLE AS lag_2, median(p) FILTER (WHERE k < 5) AS median_5,
  list_sort(list(p) FILTER (WHERE k < 8 AND p IS NOT NULL)) AS l8, count(p) FILTER (WHERE k < 6) AS n6, stddev_samp(p) FILTER (WHERE k < 6) AS sd6,
  sum(p * power(0.5, k / 2.0)) FILTER (WHERE k < 6) / sum(power(0.5, k / 2.0)) FILTER (WHERE k < 6 AND p IS NOT NULL) AS ewm_6,
  count(p) FILTER (WHERE k < 5) AS n5, regr_slope(p, -k) FILTER (WHERE k < 5) AS slope,
  sum(g) FILTER (WHERE k < 10)::DOUBLE AS g10, sum(minutes + p) FILTER (WHERE k < 10)::DOUBLE AS mp10, avg(p) FILTER (WHERE k < 3) AS p3, avg(p) FILTER (WHERE k < 5) AS p5
 FROM r GROUP BY ALL), since AS (
 SELECT e.player_code, e.prediction_timestamp, date_diff('second', max(h.kickoff_time), e.prediction_timestamp) / 86400.0 AS since_goal
 FROM ents e JOIN hist h ON h.player_code = e.player_code AND h.available_time < e.prediction_timestamp AND h.goals_scored > 0 GROUP BY e.player_code, e.prediction_timestamp), w AS (
 SELECT a.*, since_goal,
  CASE WHEN stddev_samp(p5) OVER pos > 1e-12 THEN (p5 - avg(p5) OVER pos) / stddev_samp(p5) OVER pos END AS position_z, p5 / sum(p5) OVER pos AS position_share,
  {_unit_rank('p5', 'PARTITION BY prediction_timestamp, opponent_team_id')} AS opponent_rank, p5 - avg(p5) OVER (PARTITION BY prediction_timestamp) AS all_dev,
  {_unit_rank('p5', 'PARTITION BY prediction_timestamp')} AS batch_rank
 FROM a LEFT JOIN since USING (player_code, prediction_timestamp) WINDOW pos AS (PARTITION BY prediction_timestamp, position))
SELECT player_code, opponent_team_id, position, prediction_timestamp, round(rate * m5, 6) AS rate_x_minutes, round(since_goal, 6) AS since_goal, lag_2, round(median_5, 6) AS median_5,
 l8[1 + floor(0.75 * (len(l8) - 1) + 0.5)::INT]::DOUBLE AS p75_8, CASE WHEN n6 >= 3 THEN round(sd6, 6) END AS std_6, round(ewm_6, 6) AS ewm_6,
 CASE WHEN n5 >= 3 THEN round(slope, 6) + 0.0 END AS trend_5, round(CASE WHEN abs(mp10) > 1e-6 THEN g10 / mp10 END, 6) AS ratio, CASE WHEN p3 IS NOT NULL THEN round(ln(1 + greatest(1, least(8, p3))), 6) END AS log_clip,
 round(position_z + 1e-9, 6) AS position_z, round(position_share + 1e-9, 6) AS position_share, round(opponent_rank, 6) AS opponent_rank, round(all_dev + 1e-9, 6) AS all_dev, round(batch_rank, 6) AS batch_rank,
 round(opponent_rank - avg(opponent_rank) OVER (PARTITION BY prediction_timestamp, position) + 1e-9, 6) AS nested FROM w"""

QUERIES = {
    "team_totals": team_totals,
    "opponent_strength": opponent_strength,
    "opponent_features": opponent_features,
    "career_features": career,
    "recency_features": recency,
    "deadlines": deadlines,
    "labels": labels,
    "training_frame": training_frame,
    "timeline": timeline,
    "actuals": actuals,
    "last_price": last_price,
    "season_lines": season_lines,
    "walk_forward_folds": fold_counts,
    "feature_programs": feature_programs,
    "cluster_programs": cluster_programs,
}
ORACLE = {
    "team_totals": f"WITH {ORDER_SQL} SELECT opponent_team_id, season, gameweek_id, round(sum(expected_goals), 6) AS team_xg_for, round(max(expected_goals / 2), 6) AS team_xg_against, max(available_time) AS available_time FROM hist GROUP BY ALL",
    "opponent_strength": f"WITH {ORDER_SQL} SELECT opponent_team_id, season, gameweek_id, round(sum(expected_goals), 6) AS conceded_xg, sum(goals_scored)::BIGINT AS conceded_goals, sum(total_points)::BIGINT AS conceded_points, max(clean_sheets) AS clean_sheets_against, max(available_time) AS available_time, max(kickoff_time) AS kickoff_time FROM hist GROUP BY ALL",
    "opponent_features": _opponent_sql(),
    "career_features": f"""WITH {ORDER_SQL}, {YEARLY_SQL}, s AS (SELECT player_code, season, sum(minutes) AS m, sum(goals_scored) AS g, sum(total_points) AS p, max(available_time) AS t FROM hist GROUP BY ALL HAVING sum(minutes) >= 100),
 a AS (SELECT e.player_code, e.prediction_timestamp, count(s.m) AS n, sum(s.m) AS m, avg(s.m) AS am, sum(s.g) AS g, sum(s.p) AS p, max(s.p) AS best, stddev_samp(s.g / s.m * 90.0) AS gs, stddev_samp(s.p / s.m * 90.0) AS ps
  FROM ents e LEFT JOIN s ON s.player_code = e.player_code AND s.t < e.prediction_timestamp GROUP BY ALL),
 b AS (SELECT *, g / m * 90.0 AS gr, p / m * 90.0 AS pr FROM a), c AS (SELECT *, coalesce(avg(gr) OVER w, 0) AS gc, coalesce(avg(pr) OVER w, 0) AS pc FROM b WINDOW w AS (PARTITION BY prediction_timestamp))
SELECT player_code, prediction_timestamp, n AS career_seasons, coalesce(m, 0)::BIGINT AS career_minutes_total, round(am, 6) AS career_minutes_per_season, round(gs, 6) AS career_goals_season_std, round(ps, 6) AS career_points_season_std,
 best::BIGINT AS career_best_season_points, round(gr, 6) AS career_goals_per90, round(pr, 6) AS career_points_per90,
 CASE WHEN n > 0 THEN round((coalesce(gr, gc) * n + gc * 2) / (n + 2), 6) END AS career_goals_per90_shrunk, CASE WHEN n > 0 THEN round((coalesce(pr, pc) * n + pc * 2) / (n + 2), 6) END AS career_points_per90_shrunk,
 CASE WHEN n >= 2 THEN round(1 / (1 + coalesce(ps, 0) / (abs(pr) + 1e-6)), 6) END AS career_points_consistency, (n >= 3)::INT::DOUBLE AS career_is_proven FROM c""",
    "recency_features": f"""WITH {ORDER_SQL}, {YEARLY_SQL}, v AS (
  SELECT e.player_code, e.prediction_timestamp, h.minutes, date_diff('second', h.kickoff_time, e.prediction_timestamp) / 86400.0 AS age,
   row_number() OVER (PARTITION BY e.player_code, e.prediction_timestamp ORDER BY h.available_time DESC, h.kickoff_time DESC, h.minutes DESC) AS k,
   row_number() OVER (PARTITION BY e.player_code, e.prediction_timestamp, h.minutes > 0 ORDER BY h.available_time DESC, h.kickoff_time DESC, h.minutes DESC) AS pk
  FROM ents e LEFT JOIN hist h ON h.player_code = e.player_code AND h.available_time < e.prediction_timestamp)
SELECT player_code, prediction_timestamp, round(coalesce(min(age), 999), 6) AS days_since_last_match, (coalesce(min(age), 999) >= 42)::INT::DOUBLE AS form_is_stale, round(coalesce(min(age) FILTER (WHERE minutes > 0), 999), 6) AS days_since_last_appearance,
 (count(*) FILTER (WHERE age <= 30))::DOUBLE AS matches_last_30_days, (count(*) FILTER (WHERE age <= 90))::DOUBLE AS matches_last_90_days, coalesce(sum(minutes) FILTER (WHERE age <= 30), 0)::DOUBLE AS minutes_last_30_days,
 round(avg(minutes) FILTER (WHERE minutes > 0 AND pk <= 3), 6) AS minutes_when_played_mean_3, round(avg(minutes) FILTER (WHERE minutes > 0 AND pk <= 5), 6) AS minutes_when_played_mean_5, round(avg(minutes) FILTER (WHERE minutes > 0 AND pk <= 10), 6) AS minutes_when_played_mean_10,
 round(coalesce(avg((minutes > 0)::INT) FILTER (WHERE k <= 10 AND age IS NOT NULL), 0), 6) AS appearance_rate_10 FROM v GROUP BY ALL""",
    "deadlines": f"WITH {ORDER_SQL} SELECT season, gameweek_id, min(kickoff_time) - INTERVAL 90 MINUTE AS deadline FROM hist GROUP BY ALL",
    "labels": f"""WITH {ORDER_SQL} SELECT player_code, season, gameweek_id, sum(minutes)::BIGINT AS label_minutes, sum(total_points)::BIGINT AS label_total_points, sum(goals_scored)::BIGINT AS label_goals_scored,
 CASE WHEN sum(minutes) >= 60 THEN 2 WHEN sum(minutes) > 0 THEN 1 ELSE 0 END AS label_minutes_class FROM hist GROUP BY ALL""",
    "training_frame": f"""WITH {ORDER_SQL}, d AS (SELECT season, gameweek_id, min(kickoff_time) - INTERVAL 90 MINUTE AS t FROM hist GROUP BY ALL),
 l AS (SELECT player_code, season, gameweek_id, sum(minutes)::BIGINT AS label_minutes, sum(total_points)::BIGINT AS label_total_points FROM hist GROUP BY ALL),
 r AS (SELECT l.*, d.t, h.total_points AS p, h.minutes AS m, row_number() OVER (PARTITION BY l.player_code, l.season, l.gameweek_id ORDER BY h.available_time DESC, h.kickoff_time DESC, h.season DESC, h.gameweek_id DESC, h.fixture_id DESC) AS k
  FROM l JOIN d USING (season, gameweek_id) LEFT JOIN hist h ON h.player_code = l.player_code AND h.available_time <= d.t)
SELECT season, gameweek_id, player_code, label_minutes, label_total_points, CASE WHEN label_minutes >= 60 THEN 2 WHEN label_minutes > 0 THEN 1 ELSE 0 END AS label_minutes_class, t AS prediction_timestamp,
 round(avg(p) FILTER (WHERE k <= 5), 6) AS points_mean_5, sum(m) FILTER (WHERE k <= 3)::DOUBLE AS minutes_sum_3 FROM r GROUP BY ALL""",
    "actuals": f"WITH {ORDER_SQL} SELECT player_code, season, gameweek_id, sum(minutes)::BIGINT AS actual_minutes, sum(total_points)::BIGINT AS actual_total_points, count(DISTINCT fixture_id) AS fixtures FROM hist GROUP BY ALL",
    "timeline": f"WITH {ORDER_SQL} SELECT season, gameweek_id, ((SELECT count(DISTINCT season) FROM hist h2 WHERE h2.season < hist.season) * 100 + gameweek_id)::BIGINT AS timeline, count(*) AS n FROM hist GROUP BY season, gameweek_id",
    "last_price": f"WITH {ORDER_SQL} SELECT player_code, season, arg_max(fixture_id, (kickoff_time, fixture_id)) AS value FROM hist WHERE minutes % 3 > 0 GROUP BY ALL",
    "season_lines": f"WITH {ORDER_SQL} SELECT * FROM (SELECT player_code, season, count(*) AS appearances, sum(minutes)::BIGINT AS minutes, sum(goals_scored)::BIGINT AS goals_scored, sum(total_points)::BIGINT AS total_points FROM hist WHERE minutes > 0 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY player_code ORDER BY season DESC) <= 3",
    "walk_forward_folds": f"""WITH {ORDER_SQL}, t AS (SELECT *, (dense_rank() OVER (ORDER BY season) - 1) * 100 + gameweek_id AS tl FROM hist), g AS (SELECT tl, row_number() OVER (ORDER BY tl) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT tl FROM t)),
 f AS (SELECT (x)::INT AS fold FROM range(100) r(x) WHERE 100 + 50 * x + 54 <= (SELECT max(n) FROM g))
SELECT fold, part, count(*) AS n, sum(total_points)::BIGINT AS points FROM t JOIN g USING (tl), f, (VALUES ('train'), ('validate')) p(part)
WHERE CASE WHEN part = 'train' THEN i < 100 + 50 * fold ELSE i BETWEEN 104 + 50 * fold AND 153 + 50 * fold END GROUP BY ALL""",
    "feature_programs": _PROGRAMS_SQL,
    "cluster_programs": f"""{_RANKED}, a AS (SELECT player_code, prediction_timestamp, avg(p) FILTER (WHERE k < 5) AS p5 FROM r GROUP BY ALL),
 m AS (SELECT *, (player_code * 4 % 11) / 11.0 AS p1, CASE WHEN player_code * 3 % 11 >= player_code * 4 % 11 AND player_code * 3 % 11 >= player_code * 5 % 11 THEN 0 WHEN player_code * 4 % 11 >= player_code * 5 % 11 THEN 1 ELSE 2 END AS c FROM a)
SELECT player_code, prediction_timestamp, round(p5 * p1, 6) AS gated, round(p5 - avg(p5) OVER (PARTITION BY prediction_timestamp, c), 6) AS cluster_dev, round({_unit_rank('p5', 'PARTITION BY prediction_timestamp, c')}, 6) AS cluster_rank FROM m""",
}

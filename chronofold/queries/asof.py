"""As-of joins, rolling windows, shrunken rates and the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.operators import asof, rolling
from chronofold.operators.catalogue import catalogue_specs
from chronofold.queries.roles import ORDER_SQL, WEEKLY_SQL, YEARLY_SQL, event_history, order_history, weekly_entities, yearly_entities


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def asof_latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.asof_join(weekly_entities(spark, sf_dir), event_history(spark, sf_dir), ["user_id"])


def asof_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.asof_join(weekly_entities(spark, sf_dir), event_history(spark, sf_dir), ["user_id"], bucket=F.date_trunc("week", F.col("_t")))


def asof_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = order_history(spark, sf_dir).select("player_code", "fixture_id", "minutes", F.date_trunc("month", "kickoff_time").cast("timestamp_ntz").alias("available_time"))
    return asof.point_in_time_join(yearly_entities(spark, sf_dir).select("player_code", "prediction_timestamp"), facts, ["player_code"], ["minutes", "fixture_id"])


def asof_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = order_history(spark, sf_dir).select("player_code", "fixture_id", F.date_trunc("year", "kickoff_time").cast("timestamp_ntz").alias("available_time"))
    return asof.asof_join(yearly_entities(spark, sf_dir).select("player_code", "prediction_timestamp"), facts, ["player_code"], strict=True)


def asof_integer_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last price of an earlier week of the same season, by week number."""
    prices = order_history(spark, sf_dir).groupBy("player_code", "season", F.col("gameweek_id").alias("price_gameweek")).agg(F.max("fixture_id").alias("value"))
    labels = order_history(spark, sf_dir).select("player_code", F.col("season").alias("label_season"), F.col("gameweek_id").alias("label_gameweek")).distinct().withColumn("last_week", F.col("label_gameweek") - 1)
    return asof.asof_join(labels, prices, ["player_code", "label_season"], source_keys=["player_code", "season"], prediction_time="last_week", available_time="price_gameweek")


def visible_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    cutoff = F.expr("timestamp_ntz '2024-01-10 00:00:00'")
    return asof.filter_available(event_history(spark, sf_dir), cutoff).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("available_time").alias("newest"))


def stage_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = asof.stage_window(weekly_entities(spark, sf_dir), event_history(spark, sf_dir), ["user_id"], window=3, row_key=["user_id", "prediction_timestamp"], order_col="event_id")
    return out.select("user_id", "prediction_timestamp", "rank", "event_id", "event_type", "value", "available_time")


def rolling_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    how = {f"{h}_5": ("value", h) for h in ("mean", "sum", "min", "max", "std", "median", "count")}
    out = rolling.rolling_as_of(weekly_entities(spark, sf_dir), event_history(spark, sf_dir), ["user_id"], how, window=5, min_periods=3, order_col="event_id")
    return rounded(out, "mean_5", "sum_5", "min_5", "max_5", "std_5", "median_5")


def shrunk_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    args = {"numerator": "expected_goals", "denominator": "minutes", "window": 10, "prior_strength": 3.0, "order_col": "kickoff_time"}
    entities, history = yearly_entities(spark, sf_dir).select("player_code", "prediction_timestamp"), order_history(spark, sf_dir)
    out = rolling.shrunk_rate_as_of(entities, history, ["player_code"], output="fixed_prior", prior_value=0.4, **args)
    out = rolling.shrunk_rate_as_of(out, history, ["player_code"], output="pooled_prior", **args)
    return rounded(out, "fixed_prior", "pooled_prior")


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue of 57 aggregates over five windows in one pass."""
    metrics = ["minutes", "goals_scored", "assists", "total_points"]
    specs = [rolling.FeatureSpec(f"{m}_mean_{w}", m, w, "mean") for m in metrics for w in (1, 3, 5, 10, 20)]
    specs += [rolling.FeatureSpec(f"{m}_sum_{w}", m, w, "sum") for m in ("minutes", "total_points") for w in (3, 5, 10, 20)]
    specs += [rolling.FeatureSpec(f"{m}_per90_{w}", m, w, "shrunk_rate", denominator="minutes") for m in (*metrics[1:], "expected_goals") for w in (3, 5, 10, 20)]
    specs += [rolling.FeatureSpec(f"{m}_std_{w}", m, w, "std", 3) for m in ("minutes", "total_points") for w in (5, 10, 20)]
    specs += [rolling.FeatureSpec(f"total_points_{h}_{w}", "total_points", w, h) for w in (5, 10) for h in ("max", "min")]
    out = rolling.build_catalogue(yearly_entities(spark, sf_dir).select("player_code", "prediction_timestamp"), order_history(spark, sf_dir).drop("season", "gameweek_id", "opponent_team_id", "clean_sheets"), specs, ["player_code"])
    return rounded(out, *(s.name for s in specs))


def _catalogue_sql() -> str:
    ranked = """WITH %s, %s, r AS (
      SELECT e.player_code, e.prediction_timestamp, h.minutes, h.goals_scored, h.assists, h.total_points, h.expected_goals,
        row_number() OVER (PARTITION BY e.player_code, e.prediction_timestamp ORDER BY h.available_time DESC, h.kickoff_time DESC, h.assists DESC, h.expected_goals DESC, h.goals_scored DESC, h.minutes DESC, h.total_points DESC) AS k
      FROM ents e LEFT JOIN hist h ON h.player_code = e.player_code AND h.available_time <= e.prediction_timestamp)""" % (ORDER_SQL, YEARLY_SQL)
    cols = [f"round(avg({m}) FILTER (WHERE k <= {w}), 6) AS {m}_mean_{w}" for m in ("minutes", "goals_scored", "assists", "total_points") for w in (1, 3, 5, 10, 20)]
    cols += [f"round(sum({m}::DOUBLE) FILTER (WHERE k <= {w}), 6) AS {m}_sum_{w}" for m in ("minutes", "total_points") for w in (3, 5, 10, 20)]
    cols += [f"round(coalesce(sum({m}::DOUBLE) FILTER (WHERE k <= {w}), 0) / (coalesce(sum(minutes::DOUBLE) FILTER (WHERE k <= {w}), 0) + 270) * 90, 6) AS {m}_per90_{w}" for m in ("goals_scored", "assists", "total_points", "expected_goals") for w in (3, 5, 10, 20)]
    cols += [f"round(CASE WHEN count({m}) FILTER (WHERE k <= {w}) >= 3 THEN stddev_samp({m}) FILTER (WHERE k <= {w}) END, 6) AS {m}_std_{w}" for m in ("minutes", "total_points") for w in (5, 10, 20)]
    cols += [f"round({h}(total_points::DOUBLE) FILTER (WHERE k <= {w}), 6) AS total_points_{h}_{w}" for w in (5, 10) for h in ("max", "min")]
    return f"{ranked} SELECT player_code, prediction_timestamp, {', '.join(cols)} FROM r GROUP BY ALL"


METRICS = sorted({c for spec in catalogue_specs() for c in (spec.column, spec.denominator) if c})
#: A metric's values by its place in the list: multiplier, modulus, and every which row lacks it (0: none does).
_MADE = {m: (2 * k + 3, 4 + k % 9, 0 if m == "minutes" else (0, 11, 13)[k % 3]) for k, m in enumerate(METRICS)}


def whole_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 180 declared aggregates of every customer at three cutoffs, in one pass."""
    k = F.col("o_orderkey")
    made = {m: (F.pmod(k * a, F.lit(b)) if m != "minutes" else F.pmod(k * 7, F.lit(91))).cast("double") for m, (a, b, _) in _MADE.items()}
    columns = [F.when(k % gap > 0, made[m]).alias(m) if gap else made[m].alias(m) for m, (_, _, gap) in _MADE.items()]
    history = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("player_code"), F.col("o_orderdate").alias("kickoff_time"), (F.col("o_orderdate") + F.expr("INTERVAL 3 HOURS")).alias("available_time"), *columns)
    specs = catalogue_specs()
    out = rolling.build_catalogue(yearly_entities(spark, sf_dir).select("player_code", "prediction_timestamp"), history, specs, ["player_code"])
    return rounded(out, *(x.name for x in specs))


def _whole_catalogue_sql() -> str:
    made = ", ".join(f"{f'CASE WHEN o_orderkey % {gap} > 0 THEN ' if gap else ''}((o_orderkey * {7 if m == 'minutes' else a}) % {91 if m == 'minutes' else b})::DOUBLE{' END' if gap else ''} AS {m}" for m, (a, b, gap) in _MADE.items())
    order = ", ".join(f"h.{m} DESC NULLS LAST" for m in METRICS)

    def value(x: rolling.FeatureSpec) -> str:
        within = f"FILTER (WHERE k <= {x.window})"
        if x.how == "shrunk_rate":
            return f"coalesce(sum({x.column}) {within}, 0) / (coalesce(sum({x.denominator}) {within}, 0) + {x.prior_strength} * {x.scale}) * {x.scale}"
        f = {"mean": "avg", "std": "stddev_samp"}.get(x.how, x.how)
        return f"CASE WHEN count({x.column}) {within} >= {x.min_periods} THEN {f}({x.column}) {within} END"

    columns = ", ".join(f"round({value(x)}, 6) AS {x.name}" for x in catalogue_specs())
    return f"""WITH {YEARLY_SQL}, h AS (SELECT o_custkey AS player_code, o_orderdate AS kickoff_time, o_orderdate + INTERVAL 3 HOUR AS available_time, {made} FROM orders),
 r AS (SELECT e.player_code, e.prediction_timestamp, h.* EXCLUDE (player_code), row_number() OVER (PARTITION BY e.player_code, e.prediction_timestamp ORDER BY h.available_time DESC NULLS LAST, h.kickoff_time DESC NULLS LAST, {order}) AS k
  FROM ents e LEFT JOIN h ON h.player_code = e.player_code AND h.available_time <= e.prediction_timestamp)
SELECT player_code, prediction_timestamp, {columns} FROM r GROUP BY player_code, prediction_timestamp"""


QUERIES = {
    "asof_latest_event": asof_latest_event,
    "asof_bucketed": asof_bucketed,
    "asof_ties": asof_ties,
    "asof_strict": asof_strict,
    "asof_integer_price": asof_integer_price,
    "filter_available": visible_events,
    "stage_window": stage_window,
    "rolling_aggregates": rolling_aggregates,
    "shrunk_rate": shrunk_rate,
    "catalogue": catalogue,
    "whole_catalogue": whole_catalogue,
}

_LATEST = f"""WITH {WEEKLY_SQL}
SELECT e.user_id, e.prediction_timestamp, h.ts AS available_time, h.event_id, h.event_type, h.value
FROM ents e ASOF LEFT JOIN events h ON e.user_id = h.user_id AND h.ts <= e.prediction_timestamp"""
_SHRUNK = f"""WITH {ORDER_SQL}, {YEARLY_SQL}, r AS (
  SELECT e.player_code, e.prediction_timestamp, h.expected_goals AS x, h.minutes AS m,
    row_number() OVER (PARTITION BY e.player_code, e.prediction_timestamp ORDER BY h.available_time DESC, h.kickoff_time DESC, h.season DESC, h.gameweek_id DESC, h.fixture_id DESC) AS k
  FROM ents e LEFT JOIN hist h ON h.player_code = e.player_code AND h.available_time <= e.prediction_timestamp),
 s AS (SELECT player_code, prediction_timestamp, coalesce(sum(x) FILTER (WHERE k <= 10), 0) AS n, coalesce(sum(m) FILTER (WHERE k <= 10), 0)::DOUBLE AS d FROM r GROUP BY ALL),
 p AS (SELECT prediction_timestamp, CASE WHEN sum(d) > 0 THEN sum(n) / sum(d) * 90 ELSE 0 END AS prior FROM s GROUP BY ALL)
SELECT player_code, prediction_timestamp, round((n + 0.4 * 3) / (d + 270) * 90, 6) AS fixed_prior_raw,
  n, d, prior FROM s JOIN p USING (prediction_timestamp)"""
ORACLE = {
    "asof_latest_event": _LATEST,
    "asof_bucketed": _LATEST,
    "asof_ties": f"""WITH {ORDER_SQL}, {YEARLY_SQL}
SELECT e.player_code, e.prediction_timestamp, h.t AS available_time, h.minutes, h.fixture_id FROM ents e
LEFT JOIN (SELECT *, date_trunc('month', kickoff_time)::TIMESTAMP AS t FROM hist) h ON e.player_code = h.player_code AND h.t <= e.prediction_timestamp
QUALIFY row_number() OVER (PARTITION BY e.player_code, e.prediction_timestamp ORDER BY h.t DESC, h.minutes DESC, h.fixture_id DESC) = 1""",
    "asof_strict": f"""WITH {ORDER_SQL}, {YEARLY_SQL}
SELECT e.player_code, e.prediction_timestamp, h.t AS available_time, h.fixture_id FROM ents e
LEFT JOIN (SELECT *, date_trunc('year', kickoff_time)::TIMESTAMP AS t FROM hist) h ON e.player_code = h.player_code AND h.t < e.prediction_timestamp
QUALIFY row_number() OVER (PARTITION BY e.player_code, e.prediction_timestamp ORDER BY h.t DESC, h.fixture_id DESC) = 1""",
    "asof_integer_price": f"""WITH {ORDER_SQL}, p AS (SELECT player_code, season, gameweek_id AS price_gameweek, max(fixture_id) AS value FROM hist GROUP BY ALL),
 l AS (SELECT DISTINCT player_code, season AS label_season, gameweek_id AS label_gameweek, gameweek_id - 1 AS last_week FROM hist)
SELECT l.*, p.price_gameweek, p.value FROM l ASOF LEFT JOIN p ON l.player_code = p.player_code AND l.label_season = p.season AND p.price_gameweek <= l.last_week""",
    "filter_available": "SELECT event_type, count(*) AS n, max(ts) AS newest FROM events WHERE ts <= TIMESTAMP '2024-01-10' GROUP BY ALL",
    "stage_window": f"""WITH {WEEKLY_SQL}, j AS (
  SELECT e.user_id, e.prediction_timestamp, h.event_id, h.event_type, h.value, h.ts AS available_time FROM ents e LEFT JOIN events h USING (user_id)),
 v AS (SELECT *, (row_number() OVER (PARTITION BY user_id, prediction_timestamp ORDER BY available_time DESC NULLS LAST, event_id DESC NULLS LAST) - 1)::INT AS rank
  FROM j WHERE available_time IS NULL OR available_time <= prediction_timestamp)
SELECT * FROM v WHERE rank < 3""",
    "rolling_aggregates": f"""WITH {WEEKLY_SQL}, j AS (
  SELECT e.user_id, e.prediction_timestamp, h.value, row_number() OVER (PARTITION BY e.user_id, e.prediction_timestamp ORDER BY h.ts DESC, h.event_id DESC) AS k
  FROM ents e LEFT JOIN events h ON h.user_id = e.user_id AND h.ts <= e.prediction_timestamp),
 s AS (SELECT user_id, prediction_timestamp, count(value) AS n, avg(value) AS a, sum(value) AS s, min(value) AS lo, max(value) AS hi, stddev_samp(value) AS sd, median(value) AS md FROM j WHERE k <= 5 GROUP BY ALL)
SELECT user_id, prediction_timestamp, CASE WHEN n >= 3 THEN round(a, 6) END AS mean_5, CASE WHEN n >= 3 THEN round(s, 6) END AS sum_5, CASE WHEN n >= 3 THEN round(lo, 6) END AS min_5,
 CASE WHEN n >= 3 THEN round(hi, 6) END AS max_5, CASE WHEN n >= 3 THEN round(sd, 6) END AS std_5, CASE WHEN n >= 3 THEN round(md, 6) END AS median_5, CASE WHEN n >= 3 THEN n END AS count_5 FROM s""",
    "shrunk_rate": f"""SELECT player_code, prediction_timestamp, CASE WHEN d = 0 AND n = 0 THEN 0.4 ELSE round((n + 0.4 * 3) / (d + 270) * 90, 6) END AS fixed_prior,
 round(CASE WHEN d = 0 AND n = 0 THEN prior ELSE (n + prior * 3) / (d + 270) * 90 END, 6) AS pooled_prior FROM ({_SHRUNK})""",
    "catalogue": _catalogue_sql(),
    "whole_catalogue": _whole_catalogue_sql(),
}

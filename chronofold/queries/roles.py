"""The test tables in the roles of history, entities and cutoffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as facts: key user_id, available at ts, ordered by event_id."""
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", F.col("ts").alias("available_time"))


def weekly_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user at five weekly cutoffs."""
    events = table(spark, sf_dir, "events")
    first = events.agg(F.date_trunc("day", F.min("ts")).cast("timestamp_ntz").alias("t0"))
    cutoffs = first.select(F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"), "t0").select((F.col("t0") + F.make_dt_interval(F.col("k") * 7)).alias("prediction_timestamp"))
    return events.select("user_id").distinct().crossJoin(F.broadcast(cutoffs))


WEEKLY_SQL = """
 ents AS (SELECT u.user_id, c.prediction_timestamp FROM (SELECT DISTINCT user_id FROM events) u,
   (SELECT (SELECT date_trunc('day', min(ts)) FROM events)::TIMESTAMP + to_days(7 * k::INT) AS prediction_timestamp FROM range(5) r(k)) c)"""


def order_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as matches: a player is a customer, minutes come from the priority, points from the price."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_custkey").alias("player_code"),
        F.year("o_orderdate").cast("string").alias("season"),
        F.weekofyear("o_orderdate").cast("long").alias("gameweek_id"),
        F.col("o_orderkey").alias("fixture_id"),
        (F.pmod("o_orderkey", F.lit(20))).alias("opponent_team_id"),
        F.pmod(F.col("o_orderkey") * 7, F.lit(91)).alias("minutes"),
        F.pmod("o_orderkey", F.lit(4)).alias("goals_scored"),
        F.pmod(F.col("o_orderkey") * 3, F.lit(3)).alias("assists"),
        F.pmod(F.col("o_orderkey") * 5, F.lit(13)).alias("total_points"),
        F.pmod("o_orderkey", F.lit(2)).alias("clean_sheets"),
        (F.col("o_totalprice") / 70001.0).alias("expected_goals"),
        F.col("o_orderdate").alias("kickoff_time"),
        (F.col("o_orderdate") + F.expr("INTERVAL 3 HOURS")).alias("available_time"),
    )


ORDER_SQL = """
 hist AS (SELECT o_custkey AS player_code, year(o_orderdate)::VARCHAR AS season, weekofyear(o_orderdate)::BIGINT AS gameweek_id, o_orderkey AS fixture_id,
   o_orderkey % 20 AS opponent_team_id, (o_orderkey * 7) % 91 AS minutes, o_orderkey % 4 AS goals_scored, (o_orderkey * 3) % 3 AS assists,
   (o_orderkey * 5) % 13 AS total_points, o_orderkey % 2 AS clean_sheets, o_totalprice / 70001.0 AS expected_goals,
   o_orderdate AS kickoff_time, o_orderdate + INTERVAL 3 HOUR AS available_time FROM orders)"""


def yearly_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer at the beginning of 1997, 1999 and 2001."""
    cutoffs = spark.createDataFrame([(1997,), (1999,), (2001,)], "y int").select(F.expr("make_timestamp_ntz(y, 1, 1, 0, 0, 0)").alias("prediction_timestamp"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("player_code"), F.pmod("c_custkey", F.lit(20)).alias("opponent_team_id"), (F.pmod("c_custkey", F.lit(2)) == 0).alias("was_home"), F.col("c_mktsegment").alias("position"))
    return customers.crossJoin(F.broadcast(cutoffs))


YEARLY_SQL = """
 ents AS (SELECT c_custkey AS player_code, c_custkey % 20 AS opponent_team_id, c_custkey % 2 = 0 AS was_home, c_mktsegment AS position, t AS prediction_timestamp
   FROM customer, (VALUES (TIMESTAMP '1997-01-01'), (TIMESTAMP '1999-01-01'), (TIMESTAMP '2001-01-01')) v(t))"""

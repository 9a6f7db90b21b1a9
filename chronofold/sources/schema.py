"""Canonical table schemas and conforming to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType, TimestampType

# The canonical tables' columns.
_DDL = {
    "players": "player_code long, element_id long, season string, web_name string, first_name string, second_name string, position string, team_id long, team_code long, current_price long, status string, chance_of_playing_next_round long, chance_of_playing_this_round long, news string, news_added timestamp, selected_by_percent double, available_time timestamp",
    "teams": "team_id long, team_code long, season string, name string, short_name string, available_time timestamp",
    "gameweeks": "gameweek_id long, season string, deadline_time timestamp, finished boolean, is_current boolean, is_next boolean, available_time timestamp",
    "fixtures": "fixture_id long, gameweek_id long, season string, home_team_id long, away_team_id long, kickoff_time timestamp, finished boolean, home_score long, away_score long, home_difficulty long, away_difficulty long, available_time timestamp",
    "player_gameweek_stats": "player_code long, gameweek_id long, season string, fixture_id long, opponent_team_id long, was_home boolean, minutes long, starts long, goals_scored long, assists long, clean_sheets long, goals_conceded long, saves long, yellow_cards long, red_cards long, own_goals long, penalties_saved long, penalties_missed long, bonus long, bps long, total_points long, expected_goals double, expected_assists double, expected_goal_involvements double, expected_goals_conceded double, defensive_contribution long, value long, selected long, transfers_in long, transfers_out long, transfers_balance long, influence double, creativity double, threat double, ict_index double, kickoff_time timestamp, available_time timestamp",
    "players_history": "player_code long, season string, web_name string, position string, team_name string, opening_price long",
}
_TYPES = {"long": LongType(), "double": DoubleType(), "string": StringType(), "boolean": BooleanType(), "timestamp": TimestampType()}


def struct(ddl: str) -> StructType:
    """A schema of plain columns from text; unlike Spark's own parser, this needs no session."""
    return StructType([StructField(name, _TYPES[kind]) for name, kind in (c.split(" ") for c in ddl.split(", "))])


CANONICAL: dict[str, StructType] = {name: struct(ddl) for name, ddl in _DDL.items()}


def conform(frame: DataFrame, schema: StructType) -> DataFrame:
    """The declared columns in order: leniently cast, absent ones as nulls, others left out."""
    have = set(frame.columns)
    return frame.select(*((F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields))


def empty(spark: SparkSession, schema: StructType) -> DataFrame:
    return spark.createDataFrame([], schema)

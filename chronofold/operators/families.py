"""Feature families over match history: team and opponent strength, career, recency, labels and deadlines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.functions.scalars import days_between, number
from chronofold.operators.rolling import aggregate, attach, history_frame, last_rows

# Fixed values.
OPPONENT_METRICS = ["conceded_xg", "conceded_goals", "conceded_points", "clean_sheets_against"]
OPPONENT_WINDOWS = [3, 5, 10]
CAREER_RATES = {"goals": "goals_scored", "assists": "assists", "xgi": "expected_goal_involvements", "points": "total_points", "bps": "bps"}
SEASON_FLOOR_MINUTES, PRIOR_SEASONS, PROVEN_SEASONS = 900, 2.0, 3
APPEARANCE_WINDOWS, STALE_DAYS, NEVER = [3, 5, 10], 42.0, 999.0


def _total(c: str) -> Column:
    """A sum that is 0 where every value is null."""
    return F.coalesce(F.sum(c), F.lit(0))


def team_totals(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A team's expected goals (sum over players) and conceded ones (already a team value: the largest)."""
    return stats.groupBy(*keys).agg(_total("expected_goals").alias("team_xg_for"), F.max("expected_goals_conceded").alias("team_xg_against"), F.max("available_time").alias("available_time"))


def opponent_strength(stats: DataFrame) -> DataFrame:
    """What was done against each team, a row a match: the group-by is by the opponent."""
    keys = [c for c in ("opponent_team_id", "season", "gameweek_id", "fixture_id") if c in stats.columns]
    rows = stats.where("opponent_team_id IS NOT NULL").groupBy(*keys)
    return rows.agg(_total("expected_goals").alias("conceded_xg"), _total("goals_scored").alias("conceded_goals"), _total("total_points").alias("conceded_points"), F.max("clean_sheets").alias("clean_sheets_against"), F.max("available_time").alias("available_time"), F.max("kickoff_time").alias("kickoff_time"))


def opponent_features(entities: DataFrame, strength: DataFrame, prediction_time: str = "prediction_timestamp") -> DataFrame:
    """Twelve rolling means of the coming opponent's record, and ``is_home`` if the venue is known."""
    history = history_frame(["opponent_team_id"], "available_time", "kickoff_time", strength.columns)
    features = {f"opponent_{m}_mean_{w}": aggregate(F.col(m).cast("double"), "mean", last_rows(history, w)) for w in OPPONENT_WINDOWS for m in OPPONENT_METRICS}
    out = attach(entities, strength, features, ["opponent_team_id"], history, prediction_time=prediction_time)
    home = F.col("was_home").cast("int").cast("double") if "was_home" in entities.columns else F.lit(None).cast("double")
    return out.withColumn("is_home", home)


def career_features(entities: DataFrame, stats: DataFrame, prediction_time: str = "prediction_timestamp", floor_minutes: int = SEASON_FLOOR_MINUTES, rates: dict[str, str] | None = None, batch: Sequence[str] | None = None) -> DataFrame:
    """Aggregates over whole past seasons of at least ``floor_minutes``, each visible after its last record.

    Rates are drawn to the mean of the rows of the same ``batch`` (by default: cutoff), by seasons seen.
    """
    rates = rates or CAREER_RATES
    totals = [F.sum(c).alias(f"season_{n}") for n, c in rates.items()]
    seasons = stats.groupBy("player_code", "season").agg(F.sum("minutes").alias("season_minutes"), *totals, F.max("available_time").alias("season_available_time")).where(F.col("season_minutes") >= floor_minutes)
    history = history_frame(["player_code"], "season_available_time", None, seasons.columns)
    so_far = history.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    features = {"career_seasons": F.count(F.lit(1)).over(so_far), "career_minutes_total": F.sum("season_minutes").over(so_far), "career_minutes_per_season": F.avg("season_minutes").over(so_far)}
    for n in rates:
        features[f"_total_{n}"] = F.sum(f"season_{n}").over(so_far)
        features[f"career_{n}_season_std"] = F.stddev_samp(F.col(f"season_{n}") / F.col("season_minutes") * 90.0).over(so_far)
    features["career_best_season_points"] = F.max("season_points").over(so_far)
    out = attach(entities, seasons, features, ["player_code"], history, prediction_time=prediction_time, available_time="season_available_time", strict=True)
    out = out.withColumns({f"career_{n}_per90": F.col(f"_total_{n}") / F.col("career_minutes_total") * 90.0 for n in rates})
    group = Window.partitionBy(*(batch or [prediction_time]))
    weight = F.col("career_seasons").cast("double")
    for n in rates:
        rate, centre = F.col(f"career_{n}_per90"), F.coalesce(F.avg(f"career_{n}_per90").over(group), F.lit(0.0))
        out = out.withColumn(f"career_{n}_per90_shrunk", (F.coalesce(rate, centre) * weight + centre * PRIOR_SEASONS) / (weight + PRIOR_SEASONS))
    spread = F.coalesce("career_points_season_std", F.lit(0.0)) / (F.abs("career_points_per90") + 1e-6)
    out = out.withColumn("career_points_consistency", F.when(F.col("career_seasons") >= 2, 1.0 / (1.0 + spread)))
    out = out.withColumn("career_is_proven", F.coalesce((F.col("career_seasons") >= PROVEN_SEASONS).cast("int").cast("double"), F.lit(0.0)))
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("career_seasons", "career_minutes_total")}).drop(*(f"_total_{n}" for n in rates))


def recency_features(entities: DataFrame, stats: DataFrame, row_key: Sequence[str], prediction_time: str = "prediction_timestamp") -> DataFrame:
    """How long ago and how often: days since the last match and appearance, matches and minutes of late, rates.

    Facts count strictly before the cutoff. Matches are taken to become available in the order of their
    kick-offs. Counts of the last 90 days meet matches by 90-day buckets, so a row fans out to two
    buckets of its key and not to its history.
    """
    played = F.col("minutes") > 0
    narrow = stats.select("player_code", "kickoff_time", "available_time", "minutes")
    history = history_frame(["player_code"], "available_time", "kickoff_time", narrow.columns)
    so_far = history.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = {"_last_match": F.max("kickoff_time").over(so_far), "appearance_rate_10": F.avg(played.cast("int")).over(last_rows(history, 10))}
    out = attach(entities, narrow, every, ["player_code"], history, prediction_time=prediction_time, strict=True)
    seen = {"_last_played": F.max("kickoff_time").over(so_far), **{f"minutes_when_played_mean_{w}": F.avg("minutes").over(last_rows(history, w)) for w in APPEARANCE_WINDOWS}}
    out = attach(out, narrow.where(played), seen, ["player_code"], history, prediction_time=prediction_time, strict=True)
    bucket = lambda c: F.floor(F.unix_date(F.to_date(c)) / 90)
    matches = narrow.withColumn("_b", F.explode(F.array(bucket("kickoff_time"), bucket("kickoff_time") + 1))).select(F.col("player_code").alias("_p"), "_b", "kickoff_time", "available_time", F.col("minutes").alias("_m"))
    rows = entities.select(*dict.fromkeys([*row_key, "player_code", prediction_time])).distinct()
    age = days_between(F.col(prediction_time), F.col("kickoff_time"))
    met = rows.withColumn("_eb", bucket(prediction_time)).join(matches, (F.col("player_code") == F.col("_p")) & (F.col("_eb") == F.col("_b"))).where(F.col("available_time") < F.col(prediction_time)).withColumn("_age", age)
    late = met.groupBy(*row_key).agg(F.count_if(F.col("_age") <= 30).cast("double").alias("matches_last_30_days"), F.count_if(F.col("_age") <= 90).cast("double").alias("matches_last_90_days"), F.sum(F.when(F.col("_age") <= 30, F.col("_m"))).cast("double").alias("minutes_last_30_days"))
    out = out.join(late, list(row_key), "left")
    since = lambda c: days_between(F.col(prediction_time), F.col(c))
    out = out.withColumn("days_since_last_match", F.coalesce(since("_last_match"), F.lit(NEVER))).withColumn("days_since_last_appearance", F.coalesce(since("_last_played"), F.lit(NEVER)))
    out = out.withColumn("form_is_stale", (F.col("days_since_last_match") >= STALE_DAYS).cast("int").cast("double"))
    zero = ("matches_last_30_days", "matches_last_90_days", "minutes_last_30_days", "appearance_rate_10")
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in zero}).drop("_last_match", "_last_played")


def deadlines(fixtures: DataFrame, keys: Sequence[str] = ("season", "gameweek_id"), lead_minutes: int = 90) -> DataFrame:
    """The time until which choices may be made: some minutes before the first kick-off."""
    return fixtures.groupBy(*keys).agg((F.min("kickoff_time") - F.expr(f"INTERVAL {lead_minutes} MINUTES")).alias("deadline"))


def labels(stats: DataFrame, components: Sequence[str], keys: Sequence[str] = ("player_code", "season", "gameweek_id")) -> DataFrame:
    """Sums by player and gameweek, and the class of the minutes: 0 none, 1 below 60, 2 from 60 on."""
    out = stats.groupBy(*keys).agg(*(F.sum(c).alias(f"label_{c}") for c in components))
    minutes = F.col("label_minutes")
    return out.withColumn("label_minutes_class", F.when(minutes >= 60, 2).when(minutes > 0, 1).otherwise(0)) if "minutes" in components else out


def actuals(stats: DataFrame, components: Sequence[str], keys: Sequence[str] = ("player_code", "season", "gameweek_id"), fixture: str = "fixture_id") -> DataFrame:
    """What took place: sums by player and gameweek, and in how many fixtures."""
    return stats.groupBy(*keys).agg(*(F.sum(c).alias(f"actual_{c}") for c in components), F.count_distinct(fixture).alias("fixtures"))


def timeline(frame: DataFrame, season: str = "season", gameweek: str = "gameweek_id") -> DataFrame:
    """``timeline``: one number that orders gameweeks over seasons."""
    seasons = frame.select(F.col(season).alias("_s")).distinct().withColumn("_i", F.row_number().over(Window.orderBy("_s")) - 1)
    return frame.join(seasons, F.col(season) == F.col("_s")).withColumn("timeline", (F.col("_i") * 100 + F.col(gameweek)).cast("long")).drop("_s", "_i")


def training_frame(deadline_rows: DataFrame, stats: DataFrame, components: Sequence[str], features: dict[str, tuple[str, str, int]]) -> DataFrame:
    """Features as of each label's deadline, with the label: one entity table holds all deadlines.

    ``features`` maps names to (column, aggregate, window).
    """
    rows = labels(stats, components).join(deadline_rows, ["season", "gameweek_id"]).withColumnRenamed("deadline", "prediction_timestamp")
    history = history_frame(["player_code"], "available_time", "kickoff_time", stats.columns)
    return attach(rows, stats, {n: aggregate(F.col(c).cast("double"), how, last_rows(history, w)) for n, (c, how, w) in features.items()}, ["player_code"], history)


def last_value(stats: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """The last value that isn't null, by ``order``."""
    return stats.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def season_lines(stats: DataFrame, columns: Sequence[str], most: int = 3) -> DataFrame:
    """A player's last ``most`` seasons with minutes: matches and sums; unplayed seasons are left out."""
    lines = stats.where("minutes > 0").groupBy("player_code", "season").agg(F.count(F.lit(1)).alias("appearances"), *(F.sum(c).alias(c) for c in columns))
    order = Window.partitionBy("player_code").orderBy(F.desc("season"))
    return lines.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def lenient(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    return frame.withColumns({c: number(F.col(c)) for c in columns})

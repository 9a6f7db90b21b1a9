"""From raw JSON and CSV to canonical tables."""

from __future__ import annotations

import hashlib
import json
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.operators.scoring import Rules
from chronofold.sources import files
from chronofold.sources.schema import CANONICAL, conform, struct

# Fixed values.
POSITIONS = {1: "GKP", 2: "DEF", 3: "MID", 4: "FWD"}
SETTLED = "INTERVAL 3 HOURS"

_ELEMENT = "code long, id long, web_name string, first_name string, second_name string, element_type int, team long, team_code long, now_cost long, status string, chance_of_playing_next_round long, chance_of_playing_this_round long, news string, news_added string, selected_by_percent string"
_BOOTSTRAP = f"elements array<struct<{', '.join(x.replace(' ', ': ', 1) for x in _ELEMENT.split(', '))}>>, teams array<struct<id: long, code: long, name: string, short_name: string>>, events array<struct<id: long, deadline_time: string, finished: boolean, is_current: boolean, is_next: boolean>>"


def utc(c: Column) -> Column:
    """An ISO time, null if it can't be read."""
    return F.try_to_timestamp(c)


def position_name(c: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in POSITIONS.items() for x in pair])[c]


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Bootstrap payloads, one JSON document a file, with the known shape; no inference."""
    return spark.read.schema(_BOOTSTRAP).option("multiLine", True).json(path)


def parse_payload(frame: DataFrame, column: str) -> DataFrame:
    """The same from a column of JSON text."""
    return frame.withColumn("_p", F.from_json(column, _BOOTSTRAP)).select(*frame.drop(column).columns, "_p.*")


def players(payload: DataFrame, season: str, available: Column) -> DataFrame:
    e = payload.select(F.explode("elements").alias("e")).select("e.*")
    out = e.select(
        F.col("code").alias("player_code"),
        F.col("id").alias("element_id"),
        F.lit(season).alias("season"),
        "web_name",
        "first_name",
        "second_name",
        position_name(F.col("element_type")).alias("position"),
        F.col("team").alias("team_id"),
        "team_code",
        F.col("now_cost").alias("current_price"),
        "status",
        "chance_of_playing_next_round",
        "chance_of_playing_this_round",
        F.nullif("news", F.lit("")).alias("news"),
        utc(F.col("news_added")).alias("news_added"),
        F.col("selected_by_percent").try_cast("double").alias("selected_by_percent"),
        available.alias("available_time"),
    )
    return conform(out, CANONICAL["players"])


def teams(payload: DataFrame, season: str, available: Column) -> DataFrame:
    t = payload.select(F.explode("teams").alias("t")).select("t.*")
    return conform(t.select(F.col("id").alias("team_id"), F.col("code").alias("team_code"), F.lit(season).alias("season"), "name", "short_name", available.alias("available_time")), CANONICAL["teams"])


def gameweeks(payload: DataFrame, season: str, available: Column) -> DataFrame:
    g = payload.select(F.explode("events").alias("g")).select("g.*")
    return conform(g.select(F.col("id").alias("gameweek_id"), F.lit(season).alias("season"), utc(F.col("deadline_time")).alias("deadline_time"), "finished", "is_current", "is_next", available.alias("available_time")), CANONICAL["gameweeks"])


def fixtures(rows: DataFrame, season: str, available: Column) -> DataFrame:
    """Fixtures from rows with the source's names."""
    names = {"id": "fixture_id", "event": "gameweek_id", "team_h": "home_team_id", "team_a": "away_team_id", "team_h_score": "home_score", "team_a_score": "away_score", "team_h_difficulty": "home_difficulty", "team_a_difficulty": "away_difficulty"}
    out = rows.withColumnsRenamed(names).withColumn("season", F.lit(season)).withColumn("available_time", available).withColumn("kickoff_time", utc(F.col("kickoff_time")))
    return conform(out, CANONICAL["fixtures"])


def match_history(rows: DataFrame, season: str, snapshot: Column) -> DataFrame:
    """Per-match facts: available three hours after kick-off, or with the snapshot if that is unknown."""
    kickoff = utc(F.col("kickoff_time"))
    names = {"round": "gameweek_id", "fixture": "fixture_id", "opponent_team": "opponent_team_id"}
    out = rows.withColumnsRenamed({k: v for k, v in names.items() if k in rows.columns}).withColumn("season", F.lit(season)).withColumn("available_time", F.coalesce(kickoff + F.expr(SETTLED), snapshot)).withColumn("kickoff_time", kickoff)
    return conform(out, CANONICAL["player_gameweek_stats"])


def past_seasons(rows: DataFrame) -> DataFrame:
    """Totals of past seasons; a season that can't be read (YYYY/YY) is left out; available on 30 June of its end."""
    start = F.regexp_extract("season_name", r"^(\d{4})/(\d{2})$", 1)
    good = rows.where(start != "").withColumn("_y", start.cast("int"))
    season = F.concat(F.col("_y").cast("string"), F.lit("-"), F.lpad((F.col("_y") + 1) % 100, 2, "0"))
    return good.withColumn("season", season).withColumn("available_time", F.make_timestamp(F.col("_y") + 1, F.lit(6), F.lit(30), F.lit(0), F.lit(0), F.lit(0))).drop("_y")


def archive_season(rows: DataFrame, elements: DataFrame, season: str) -> tuple[DataFrame, DataFrame]:
    """Archive rows with their lasting player codes, and one row of counts of what was left out and why."""
    codes = element_codes(elements)
    managers = F.col("position") == "AM"
    kickoff = utc(F.col("kickoff_time"))
    joined = rows.join(codes, rows["element"].try_cast("long") == codes["_id"], "left").withColumn("_k", kickoff)
    reason = F.when(managers, "manager").when(F.col("player_code").isNull(), "unresolved").when(F.col("_k").isNull(), "no_kickoff").otherwise("kept")
    marked = joined.withColumn("_why", reason)
    counts = marked.agg(*(F.count_if(F.col("_why") == w).alias(w) for w in ("kept", "manager", "unresolved", "no_kickoff")))
    names = {"round": "gameweek_id", "fixture": "fixture_id", "opponent_team": "opponent_team_id"}
    kept = marked.where("_why = 'kept'").withColumnsRenamed({k: v for k, v in names.items() if k in rows.columns}).withColumn("season", F.lit(season)).withColumn("kickoff_time", F.col("_k")).withColumn("available_time", F.col("_k") + F.expr(SETTLED))
    return conform(kept, CANONICAL["player_gameweek_stats"]), counts


def element_codes(elements: DataFrame) -> DataFrame:
    """Season's element id to lasting code; where an id repeats, the smallest code."""
    return elements.select(F.col("id").try_cast("long").alias("_id"), F.col("code").try_cast("long").alias("player_code")).where("_id IS NOT NULL").groupBy("_id").agg(F.min("player_code").alias("player_code"))


def players_history(rows: DataFrame) -> DataFrame:
    """What a player was at a season's first match: name, position, team, opening price."""
    first = F.min_by(F.struct(F.col("name").alias("web_name"), relabelled(F.col("position")).alias("position"), F.col("team").alias("team_name"), F.col("value").cast("long").alias("opening_price")), F.struct("kickoff_time", "fixture_id")).alias("f")
    return rows.groupBy("player_code", "season").agg(first).select("player_code", "season", "f.*")


def relabelled(position: Column) -> Column:
    return F.when(position == "GK", "GKP").otherwise(position)


# Columns of a season's archive files.
ARCHIVE = {
    "matches": "element long, name string, position string, team string, round long, fixture long, opponent_team long, was_home boolean, minutes long, starts long, goals_scored long, assists long, clean_sheets long, goals_conceded long, saves long, yellow_cards long, red_cards long, own_goals long, penalties_saved long, penalties_missed long, bonus long, bps long, total_points long, expected_goals double, expected_assists double, expected_goal_involvements double, expected_goals_conceded double, value long, selected long, transfers_in long, transfers_out long, transfers_balance long, influence double, creativity double, threat double, ict_index double, kickoff_time string",
    "players": "id long, code long, web_name string, first_name string, second_name string, element_type int, team long, now_cost long",
}


def read_archive(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A season's CSV files (``matches`` or ``players``) by their header's names; values that can't be read are null, rows stay.

    Columns are found by name, so their order and further ones don't matter; absent ones are null.
    """
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    return conform(raw, struct(ARCHIVE[kind].replace(" int", " long")))


def backfill(seasons: dict[str, tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Seasons of (archive rows, elements) as one table, and a row a season of what was left out and why."""
    kept = counts = None
    for season, (rows, elements) in sorted(seasons.items()):
        some, why = archive_season(rows, elements, season)
        why = why.withColumn("season", F.lit(season))
        kept, counts = (some, why) if kept is None else (kept.unionByName(some), counts.unionByName(why))
    return kept, counts


def tag_payloads(payloads: DataFrame, key: str = "element_id", body: str = "payload") -> DataFrame:
    """JSON bodies with their key inside (``_element_id``), as the source's bodies don't say whom they describe."""
    return payloads.withColumn(body, F.concat(F.lit('{"_element_id":'), F.col(key).cast("string"), F.when(F.regexp_replace(body, r"\s", "") == "{}", "").otherwise(","), F.regexp_replace(body, r"^\s*\{", "")))


def latest_summaries(snapshots: DataFrame, match: str, body: str = "payload", available: str = "available_time") -> DataFrame:
    """Match rows of each key's newest tagged body (``match``: DDL of one row of its ``history``); keys never seen give none."""
    parsed = snapshots.withColumn("_p", F.from_json(body, f"_element_id long, history array<struct<{match}>>"))
    newest = parsed.groupBy(F.col("_p._element_id").alias("element_id")).agg(F.max_by("_p.history", F.struct(available, body)).alias("h")).where("element_id IS NOT NULL")
    return newest.select("element_id", F.explode("h").alias("r")).select("element_id", "r.*")


def read_squad(spark: SparkSession, path: str) -> DataFrame:
    """Picks of a squad file: element, position, purchase price and who leads."""
    payload = spark.read.schema("picks array<struct<element: long, position: int, purchase_price: long, is_captain: boolean, is_vice_captain: boolean>>").option("multiLine", True).json(path)
    return payload.select(F.explode("picks").alias("p")).select("p.*")


def mapped_clubs(frame: DataFrame, clubs: DataFrame, name: str = "team_name") -> tuple[DataFrame, DataFrame]:
    """The frame with ``team_id`` by club name, and one row: how many rows met no club, and their share."""
    out = frame.join(clubs.select(name, "team_id"), name, "left")
    missing = F.count_if(F.col("team_id").isNull())
    return out, out.agg(missing.alias("unmapped"), F.try_divide(missing, F.count(F.lit(1))).alias("share"))


def population_means(frame: DataFrame, columns: list[str], points: str = "expected_points", price: str = "price") -> DataFrame:
    """One row: the mean of each column over its values, and the mean of points per million over those with a price."""
    efficiency = F.avg(F.when(F.col(price) > 0, F.col(points) / (F.col(price) / 10.0)))
    return frame.agg(*(F.avg(c).alias(f"{c}_mean") for c in columns), efficiency.alias("points_per_million"))


def ownership_before(players: DataFrame, stats: DataFrame, season: str, gameweek: int, selected: str = "selected") -> DataFrame:
    """Players with what was owned of them in the gameweek before (0 if nothing): that week's own figure comes after its deadline."""
    prior = stats.where((F.col("season") == season) & (F.col("gameweek_id") == gameweek - 1)).groupBy("player_code").agg(F.max(selected).alias("_s"))
    return players.join(prior, "player_code", "left").withColumn("selected", F.coalesce("_s", F.lit(0))).drop("_s")


def club_ids(rows: DataFrame, name: str = "team_name") -> DataFrame:
    """Clubs numbered from 1 by name."""
    from pyspark.sql import Window

    return rows.select(name).where(F.col(name).isNotNull()).distinct().withColumn("team_id", F.row_number().over(Window.orderBy(name)))


def with_season_attribute(frame: DataFrame, history: DataFrame, column: str) -> DataFrame:
    """An attribute of the row's season, else the player's latest."""
    exact = history.select("player_code", "season", F.col(column).alias("_e"))
    latest = history.groupBy("player_code").agg(F.max_by(column, "season").alias("_l"))
    return frame.join(exact, ["player_code", "season"], "left").join(latest, "player_code", "left").withColumn(column, F.coalesce("_e", "_l")).drop("_e", "_l")


def stratified_sample(rows: DataFrame, strata: list[str], key: str, quota: Column, seed: int) -> DataFrame:
    """The first ``quota`` of each stratum by a hash of seed and key."""
    from pyspark.sql import Window

    w = Window.partitionBy(*strata).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= quota).drop("_n")


def quota_sample(rows: DataFrame, key: str, seed: int, quotas: dict[tuple[str, ...], int]) -> DataFrame:
    """A sample that keeps at most so many rows of each stratum, by a hash of seed and key; quotas are applied in order, each to what the ones before left."""
    out = rows
    for strata, most in quotas.items():
        out = stratified_sample(out, list(strata), key, F.lit(most), seed)
    return out


def read_rules(spark: SparkSession, path: str, pin: str | None = None) -> Rules:
    """Scoring rules out of a JSON file on any store; where a pin (the SHA-256 of its bytes) is given, another file is refused.

    Keys are those of ``Rules``; ``per_event`` and tables by position are merged over the defaults, and unknown keys are an error.
    """
    payload = files.read(spark, path)
    found = hashlib.sha256(payload).hexdigest()
    if pin is not None and found != pin:
        raise ValueError(f"{path} has the sum {found}, not {pin}")
    given, rules = json.loads(payload), Rules()
    unknown = sorted(set(given) - {"goals", "clean_sheets", "conceded", "defensive", "defensive_from", "per_event"})
    if unknown:
        raise ValueError(f"{path} has keys that no rule goes by: {unknown}")
    return replace(rules, **{k: {**getattr(rules, k), **v} for k, v in given.items()})

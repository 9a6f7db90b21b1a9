"""Numbers behind a choice: what parts an expected score has, and where two elevens of a squad differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.operators.scoring import Rules, _by_position

# Below this a term isn't worth a line; how far terms may be from their total; what the armband multiplies by.
LEAST_TERM, TOLERANCE, CAPTAIN = 0.005, 1e-6, 2


def terms(rules: Rules = Rules(), position: str = "position") -> Column:
    """The terms of ``scoring.expected_points``: an array of (component, expectation, rate, points).

    Appearing has two branches, so its rate is what both come to for each chance of playing; conceded goals and saves are paid by pairs and
    threes, so their rates are a part of a point.
    """
    p = F.col(position)
    number = lambda c: F.col(c).cast("double")
    playing = number("p_short") + number("p_long")
    appearing = number("p_short") * rules.short_play + number("p_long") * rules.long_play
    lines = [
        ("appearing", playing, F.when(playing > 0, appearing / playing).otherwise(0.0)),
        ("goals", number("expected_goals"), _by_position(p, rules.goals)),
        ("assists", number("expected_assists"), F.lit(rules.per_event["assists"])),
        ("clean_sheet", number("p_clean_sheet"), _by_position(p, rules.clean_sheets)),
        ("conceded", number("expected_conceded"), _by_position(p, rules.conceded) / rules.conceded_per),
        ("saves", number("expected_saves"), F.lit(rules.saves_points / rules.saves_per)),
        ("bonus", number("expected_bonus"), F.lit(1)),
        ("cards", number("expected_yellow"), F.lit(rules.per_event["yellow_cards"])),
        ("defence", number("p_defensive"), _by_position(p, rules.defensive)),
    ]
    return F.array(*(F.struct(F.lit(n).alias("component"), x.alias("expectation"), r.cast("double").alias("rate"), (x * r).alias("points")) for n, x, r in lines))


def derivation(frame: DataFrame, total: Column, rules: Rules = Rules(), position: str = "position") -> DataFrame:
    """Adds ``terms`` (those worth a line, largest first) and ``reconciles``: whether all terms come to ``total``."""
    every = terms(rules, position)
    out = frame.withColumn("_terms", every)
    summed = F.aggregate("_terms", F.lit(0.0), lambda s, x: s + x["points"])
    worth = F.filter("_terms", lambda x: F.abs(x["points"]) >= LEAST_TERM)
    order = F.transform(worth, lambda x: F.struct((-F.abs(x["points"])).alias("o"), x.alias("x")))
    listed = F.transform(F.array_sort(order), lambda y: y["x"])
    return out.withColumns({"terms": listed, "reconciles": F.coalesce(F.abs(summed - total) <= TOLERANCE, F.lit(False))}).drop("_terms")


def lineup_swaps(yours: DataFrame, ours: DataFrame) -> DataFrame:
    """squad_id, position, place, player_out, player_in, points_out, points_in and delta of each swap from one eleven to another.

    Both: squad_id, player_code, position, points. Who leaves and who enters are paired by rank within their position; a change of
    shape leaves some on one side alone. An eleven is eleven rows, so nothing here grows but the number of squads.
    """
    key = ["squad_id", "player_code"]
    rank = F.row_number().over(Window.partitionBy("squad_id", "position").orderBy(F.desc("points"), "player_code"))
    side = lambda a, b, code, points: a.join(b.select(*key), key, "left_anti").select("squad_id", "position", rank.alias("place"), F.col("player_code").alias(code), F.col("points").cast("double").alias(points))
    out = side(yours, ours, "player_out", "points_out").join(side(ours, yours, "player_in", "points_in"), ["squad_id", "position", "place"], "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return out.select("squad_id", "position", "place", "player_out", "player_in", zero("points_out").alias("points_out"), zero("points_in").alias("points_in"), (zero("points_in") - zero("points_out")).alias("delta"))


def lineup_difference(yours: DataFrame, ours: DataFrame, captains: DataFrame) -> DataFrame:
    """squad_id, yours_points, ours_points, swaps, swap_delta, captain_delta, shape_delta, yours_shape and ours_shape.

    ``captains``: squad_id, yours and ours, each of its own eleven (null: nobody counts twice). What swaps and the armband don't account for is
    named as ``shape_delta``, and isn't hidden in either.
    """
    def side(eleven: DataFrame, name: str) -> DataFrame:
        shape = F.concat_ws("-", *(F.count_if(F.col("position") == p).cast("string") for p in ("DEF", "MID", "FWD")))
        total = eleven.groupBy("squad_id").agg(F.sum(F.col("points").cast("double")).alias("_base"), shape.alias(f"{name}_shape"))
        armed = captains.select("squad_id", F.col(name).alias("player_code")).join(eleven, ["squad_id", "player_code"]).select("squad_id", (F.col("points").cast("double") * (CAPTAIN - 1)).alias(f"_{name}_armband"))
        joined = total.join(armed, "squad_id", "left")
        return joined.select("squad_id", f"{name}_shape", F.coalesce(f"_{name}_armband", F.lit(0.0)).alias(f"_{name}_armband"), (F.col("_base") + F.coalesce(f"_{name}_armband", F.lit(0.0))).alias(f"{name}_points"))

    swaps = lineup_swaps(yours, ours).groupBy("squad_id").agg(F.count(F.lit(1)).alias("swaps"), F.sum("delta").alias("swap_delta"))
    both = side(yours, "yours").join(side(ours, "ours"), "squad_id").join(swaps, "squad_id", "left")
    armband = F.col("_ours_armband") - F.col("_yours_armband")
    moved = F.coalesce("swap_delta", F.lit(0.0))
    return both.select("squad_id", "yours_points", "ours_points", F.coalesce("swaps", F.lit(0)).alias("swaps"), moved.alias("swap_delta"), armband.alias("captain_delta"), F.round(F.col("ours_points") - F.col("yours_points") - moved - armband, 9).alias("shape_delta"), "yours_shape", "ours_shape")

"""Points under given rules, expected points, and adjustments of predictions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.functions.scalars import band, clip
from chronofold.operators.metrics import PRICE_BANDS, PRICE_EDGES


@dataclass(frozen=True)
class Rules:
    """Scoring rules as read from a rules file; the defaults are one season's fixed values."""

    goals: dict = field(default_factory=lambda: {"GKP": 10, "DEF": 6, "MID": 5, "FWD": 4})
    clean_sheets: dict = field(default_factory=lambda: {"GKP": 4, "DEF": 4, "MID": 1, "FWD": 0})
    conceded: dict = field(default_factory=lambda: {"GKP": -1, "DEF": -1, "MID": 0, "FWD": 0})
    defensive: dict = field(default_factory=lambda: {"GKP": 0, "DEF": 2, "MID": 2, "FWD": 2})
    defensive_from: dict = field(default_factory=lambda: {"GKP": 12, "DEF": 10, "MID": 12, "FWD": 12})
    per_event: dict = field(default_factory=lambda: {"assists": 3, "yellow_cards": -1, "red_cards": -3, "own_goals": -2, "penalties_saved": 5, "penalties_missed": -2, "bonus": 1})
    conceded_per, saves_per, saves_points = 2, 3, 1
    short_play, long_play, long_minutes = 1, 2, 60


def _by_position(position: Column, table: dict) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[position], F.lit(0))


def realised_points(rules: Rules = Rules(), position: str = "position") -> Column:
    """Exact points of a match from its counts. A null defensive contribution means that there was no such rule."""
    p = F.col(position)
    total = F.when(F.col("minutes") >= rules.long_minutes, rules.long_play).when(F.col("minutes") > 0, rules.short_play).otherwise(0)
    total = total + F.col("goals_scored") * _by_position(p, rules.goals) + F.col("clean_sheets") * _by_position(p, rules.clean_sheets)
    total = total + F.expr(f"goals_conceded div {rules.conceded_per}") * _by_position(p, rules.conceded) + F.expr(f"saves div {rules.saves_per}") * rules.saves_points
    for c, points in rules.per_event.items():
        total = total + F.col(c) * points
    threshold = _by_position(p, rules.defensive_from)
    return (total + F.when(F.col("defensive_contribution") >= threshold, _by_position(p, rules.defensive)).otherwise(0)).cast("long")


def expected_points(rules: Rules = Rules(), position: str = "position") -> Column:
    """The sum of expected terms: minutes, goals, assists, clean sheet, conceded, saves, bonus, cards, defence."""
    p = F.col(position)
    total = F.col("p_short") * rules.short_play + F.col("p_long") * rules.long_play
    total = total + F.col("expected_goals") * _by_position(p, rules.goals) + F.col("expected_assists") * rules.per_event["assists"]
    total = total + F.col("p_clean_sheet") * _by_position(p, rules.clean_sheets) + F.col("expected_conceded") / rules.conceded_per * _by_position(p, rules.conceded)
    total = total + F.col("expected_saves") / rules.saves_per * rules.saves_points + F.col("expected_bonus")
    return total + F.col("expected_yellow") * rules.per_event["yellow_cards"] + F.col("p_defensive") * _by_position(p, rules.defensive)


def combine_fixtures(predictions: DataFrame, keys: tuple[str, ...] = ("player_code", "gameweek_id")) -> DataFrame:
    """A gameweek's matches added up: points as a sum, spreads in quadrature."""
    return predictions.groupBy(*keys).agg(F.sum("expected_points").alias("expected_points"), F.sqrt(F.sum(F.col("sd") * F.col("sd"))).alias("sd"), F.count("fixture_id").alias("fixtures"))


def availability(chance: str = "chance", points: str = "expected_points", sd: str = "sd") -> dict[str, Column]:
    """Points scaled by the chance to play (null: certain), and the wider spread that goes with doubt."""
    f = clip(F.coalesce(F.col(chance) / 100.0, F.lit(1.0)), 0.0, 1.0)
    return {points: F.col(points) * f, sd: F.col(sd) * (1 + 2 * f * (1 - f))}


# Mean error (predicted less actual), number of rows and rank correlation by price band, and how they are used.
PRICE_BAND_ERRORS = {"budget": (-0.141, 18066, 0.67), "mid": (-0.241, 7100, 0.69), "premium": (-0.351, 520, 0.60), "elite": (0.098, 64, 0.31)}
LEAST_SAMPLE, ORDERED = 100, 0.6


def price_calibration(errors: dict[str, tuple[float, int, float]] = PRICE_BAND_ERRORS, price: str = "price", points: str = "expected_points", sd: str = "sd") -> dict[str, Column]:
    """Points with a band's measured shortfall added back, and a wider spread where the band is hardly put in order.

    Only bands that were predicted too low, on LEAST_SAMPLE rows or more, are added to. Rows without a price
    stay as they are, and so do points of zero.
    """
    shortfall = {b: -bias if bias < 0 and n >= LEAST_SAMPLE else 0.0 for b, (bias, n, _) in errors.items()}
    wider = {b: 1.0 + max(0.0, ORDERED - max(rho, 0.0)) / ORDERED for b, (_, _, rho) in errors.items()}
    here = band(F.col(price), PRICE_EDGES, PRICE_BANDS)
    of_band = lambda table, other: F.coalesce(F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[here], F.lit(other))
    return {points: F.col(points) + F.when(F.abs(points) > 1e-9, of_band(shortfall, 0.0)).otherwise(0.0), sd: F.col(sd) * of_band(wider, 1.0)}


def form_factor(signal: Column, most: float = 0.15) -> Column:
    return 1 + clip(F.coalesce(signal, F.lit(0.0)), -most, most)


def belief_factor(beliefs: DataFrame, key: str = "player_code", most: float = 0.25) -> DataFrame:
    """One factor a player from all beliefs (effect, age_weeks, halflife): decayed, summed, held to bounds."""
    weight = F.pow(F.lit(0.5), F.col("age_weeks") / F.col("halflife"))
    return beliefs.groupBy(key).agg((1 + clip(F.sum(F.col("effect") * weight), -most, most)).alias("belief_factor"))


def believed(predictions: DataFrame, beliefs: DataFrame, key: str = "player_code") -> DataFrame:
    """Predictions priced anew by beliefs; ``raw_points`` keeps what they were, players without beliefs stay."""
    out = predictions.join(belief_factor(beliefs, key), key, "left").withColumn("belief_factor", F.coalesce("belief_factor", F.lit(1.0)))
    return out.withColumn("raw_points", F.col("expected_points")).withColumn("expected_points", F.col("raw_points") * F.col("belief_factor"))


def adjusted(predictions: DataFrame, errors: dict[str, tuple[float, int, float]] = PRICE_BAND_ERRORS) -> DataFrame:
    """The fixed order of adjustments: price, then availability, then form; the raw value stays."""
    out = predictions.withColumn("raw_points", F.col("expected_points")).withColumns(price_calibration(errors))
    out = out.withColumns(availability())
    return out.withColumn("expected_points", F.col("expected_points") * form_factor(F.col("form")))


def horizon_value(predictions: DataFrame, start: Column, weeks: int = 5, discount: float = 0.85) -> DataFrame:
    """Discounted points over the coming weeks; a week without a match counts nothing."""
    i = F.col("gameweek_id") - start
    return predictions.where((i >= 0) & (i < weeks)).groupBy("player_code").agg(F.sum(F.col("expected_points") * F.pow(F.lit(discount), i)).alias("horizon_value"))


@dataclass(frozen=True)
class Objective:
    """What a manager is after. ``ownership`` is 1 to hold what others hold, -1 to differ, 0 for neither; ``metric`` is the first aim."""

    uncertainty: float = 0.0
    ownership: int = 0
    captaincy: float = 0.0
    team_value: float = 0.0
    metric: str = "expected_points"


# Fixed values of the objective.
OWNERSHIP_WEIGHT, CEILING_SPREADS, COMMON_SHARE, RARE_BONUS = 0.5, 1.5, 0.25, 0.3


def objective_value(objective: Objective, points: Column, sd: Column, share: Column, *, captain: Column | None = None, p_long: Column | None = None, momentum: Column | None = None) -> Column:
    """What a player is worth to this objective.

    Spread costs (or, with a negative weight, pays); ownership pays or costs in proportion to points, and
    nothing where it isn't known; a captain is worth his ceiling if he lasts an hour. The downside aim
    halves the way to points less a spread, at least 0; the differential aim pays for what few own.
    """
    value = points - objective.uncertainty * sd + F.coalesce(objective.ownership * share * points * OWNERSHIP_WEIGHT, F.lit(0.0))
    if captain is not None and p_long is not None:
        value = value + F.when(captain, objective.captaincy * ((points + CEILING_SPREADS * sd) * p_long - points)).otherwise(0.0)
    if momentum is not None:
        value = value + objective.team_value * F.coalesce(momentum, F.lit(0.0))
    if objective.metric == "downside_protection":
        value = 0.5 * value + 0.5 * F.greatest(F.lit(0.0), points - sd)
    if objective.metric == "differential_yield":
        value = value * F.coalesce(1 + (1 - F.least(F.lit(1.0), share / COMMON_SHARE)) * RARE_BONUS, F.lit(1.0))
    return value


def horizon_repriced(weekly: DataFrame, predictions: DataFrame, discount: float = 0.85, key: str = "player_code") -> DataFrame:
    """Predictions worth the discounted sum of their weeks (weekly: key, week from 0, points), their spread grown by 10% a further week.

    Players without weeks stay as they are.
    """
    sums = weekly.groupBy(key).agg(F.sum(F.col("points") * F.pow(F.lit(discount), F.col("week"))).alias("_total"), F.count(F.lit(1)).alias("_weeks"))
    out = predictions.join(sums, key, "left")
    return out.withColumns({"expected_points": F.coalesce("_total", "expected_points"), "sd": F.col("sd") * (1 + 0.1 * (F.coalesce("_weeks", F.lit(1)) - 1))}).drop("_total", "_weeks")


def skill_shrunk(predicted: Column, skill: Column, mean: Column) -> Column:
    """A prediction drawn to the mean by how little skill its model has shown (held to [0, 1])."""
    weight = clip(F.coalesce(skill, F.lit(0.0)), 0.0, 1.0)
    return weight * predicted + (1 - weight) * mean


def selling_price(purchase: Column, current: Column, fee: float = 0.5) -> Column:
    """A loss is taken in full; of a profit the fee's share, rounded down, is kept."""
    return F.when(current > purchase, purchase + F.floor((current - purchase) * fee)).otherwise(current).cast("long")


def transfer_ledger(moves: DataFrame, most_free: int = 5, hit: int = 4) -> DataFrame:
    """Free transfers and points lost, week by week (owner, gameweek_id, transfers).

    A week's free transfers depend on all weeks before it, so weeks are folded in order within an array
    of each owner's weeks (at most a season's).
    """
    weeks = moves.groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("gameweek_id", "transfers"))).alias("w"))
    zero = F.struct(F.lit(1).alias("free"), F.array().cast("array<struct<gameweek_id: bigint, transfers: bigint, free: int, hits: bigint>>").alias("rows"))

    def step(s: Column, x: Column) -> Column:
        left = F.greatest(F.lit(0), s["free"] - x["transfers"]).cast("int")
        row = F.struct(x["gameweek_id"].cast("long").alias("gameweek_id"), x["transfers"].cast("long").alias("transfers"), s["free"].alias("free"), (F.greatest(F.lit(0), x["transfers"] - s["free"]) * hit).cast("long").alias("hits"))
        return F.struct(F.least(F.lit(most_free), left + 1).alias("free"), F.concat(s["rows"], F.array(row)).alias("rows"))

    return weeks.select("owner", F.explode(F.aggregate("w", zero, step)["rows"]).alias("r")).select("owner", "r.*")


# Fixed values of the closed-form prediction: the prior of a player without a history, league rates, bounds.
NO_HISTORY = {"p_appearance": 0.35, "p_start": 0.15, "expected_minutes": 18.0, "p_long": 0.12, "minutes_sd": 25.0}
CLEAN_SHEET_RATE, CONCEDED_RATE, SAVE_RATE, YELLOW_RATE, RED_RATE = 0.28, 1.35, 2.6, 0.12, 0.004
FIXTURE_BOUNDS = (0.8, 1.25)


def minutes_outlook(mean: Column, start_rate: Column) -> dict[str, Column]:
    """Chances to appear, start and last an hour, expected minutes and their spread, from recent means."""
    m, r = clip(mean, 0.0, 90.0), clip(F.coalesce(start_rate, F.lit(0.0)), 0.0, 1.0)
    appear = F.least(F.lit(1.0), m / 70.0)
    start = F.least(r, appear)
    hour = clip(F.least(appear, start * 0.9 + F.greatest(F.lit(0.0), (m - 60) / 30) * 0.1), 0.0)
    known = {"p_appearance": appear, "p_start": start, "expected_minutes": m, "p_long": hour, "minutes_sd": 30 * (1 - F.abs(m - 45) / 45) + 6}
    return {k: F.when(mean.isNull(), NO_HISTORY[k]).otherwise(F.round(v, 6)) for k, v in known.items()}


def closed_form(frame: DataFrame, league_team_xg: float, rules: Rules = Rules()) -> DataFrame:
    """Adds ``expected_points`` and ``sd`` of one match from eight features, all within one projection.

    Columns: position, minutes_mean_5, start_rate_5, xg_per90_shrunk, xa_per90_shrunk, bonus_per90_shrunk,
    team_xg_for_mean_5.
    """
    given = frame.columns
    out = frame.withColumns(minutes_outlook(F.col("minutes_mean_5"), F.col("start_rate_5")))
    share = F.col("expected_minutes") / 90.0
    relative = clip(F.col("team_xg_for_mean_5") / league_team_xg, *FIXTURE_BOUNDS) if league_team_xg > 0 else F.lit(1.0)
    fixture = F.coalesce(relative, F.lit(1.0))
    rate = lambda c: F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0.0)))
    out = out.withColumns(
        {
            "p_short": F.greatest(F.lit(0.0), F.col("p_appearance") - F.col("p_long")),
            "expected_goals": rate("xg_per90_shrunk") * share * fixture,
            "expected_assists": rate("xa_per90_shrunk") * share * fixture,
            "expected_bonus": rate("bonus_per90_shrunk") * share,
            "p_clean_sheet": F.least(F.lit(1.0), CLEAN_SHEET_RATE * F.col("p_long")),
            "expected_conceded": CONCEDED_RATE * share,
            "expected_saves": F.when(F.col("position") == "GKP", SAVE_RATE * share).otherwise(0.0),
            "expected_yellow": YELLOW_RATE * share,
            "p_defensive": F.lit(0.0),
        }
    )
    total = expected_points(rules) + RED_RATE * share * rules.per_event["red_cards"]
    out = out.withColumn("expected_points", total)
    return out.withColumn("sd", F.greatest(F.lit(0.5), F.abs("expected_points") * F.col("minutes_sd") / 90.0 + 0.8)).select(*given, "expected_points", "sd")


# When form is stale, and the minutes of a match.
STALE_DAYS, FULL_MATCH = 42.0, 90.0


def from_models(frame: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Adds ``expected_points`` and ``sd`` of one match from models' outputs (label_* columns) and the recency features.

    Where form is stale, minutes and starts are at least what the player's record when playing implies.
    Minutes and start chance come from two models, so they are brought in line before points are put together.
    """
    given = frame.columns
    have = lambda c: F.col(c) if c in given else F.lit(None).cast("double")
    floor = F.when((have("minutes_when_played_mean_5") > 0) & (have("appearance_rate_10") > 0), have("minutes_when_played_mean_5") * have("appearance_rate_10"))
    stale = (F.coalesce(have("form_is_stale"), F.lit(0.0)) >= 0.5) | (F.coalesce(have("days_since_last_match"), F.lit(0.0)) >= STALE_DAYS)
    raised = F.coalesce(stale & (floor > F.col("label_minutes")), F.lit(False))
    minutes = F.when(raised, floor).otherwise(F.col("label_minutes"))
    starts = F.when(raised, F.greatest(F.col("label_starts"), F.least(F.lit(1.0), floor / FULL_MATCH))).otherwise(F.col("label_starts"))
    out = frame.withColumns({"_m": clip(minutes, 0.0, FULL_MATCH), "_s": clip(starts, 0.0, 1.0)})
    out = out.withColumn("_a", F.greatest(F.col("_s"), F.when(F.col("_m") < 70.0, F.least(F.lit(1.0), F.col("_m") / 70.0)).otherwise(1.0)))
    hour = F.round(F.greatest(F.lit(0.0), F.least(F.col("_a"), F.col("_s") * 0.9 + F.greatest(F.lit(0.0), (F.col("_m") - 60.0) / 30.0) * 0.1)), 6)
    positive = lambda c: F.greatest(F.lit(0.0), F.coalesce(have(c), F.lit(0.0)))
    out = out.withColumn("p_long", hour)
    out = out.withColumns(
        {
            "p_short": F.greatest(F.lit(0.0), F.round("_a", 6) - F.col("p_long")),
            "expected_goals": positive("label_goals_scored"),
            "expected_assists": positive("label_assists"),
            "expected_bonus": positive("label_bonus"),
            "p_clean_sheet": F.least(F.lit(1.0), positive("label_clean_sheets") * F.col("p_long")),
            "expected_conceded": positive("label_goals_conceded"),
            "expected_saves": positive("label_saves"),
            "expected_yellow": positive("label_yellow_cards"),
            "p_defensive": F.lit(0.0),
        }
    )
    out = out.withColumn("expected_points", expected_points(rules))
    minutes_sd = F.round(30.0 * (1.0 - F.abs(F.col("_m") - 45.0) / 45.0) + 6.0, 6)
    return out.withColumn("sd", F.round(F.greatest(F.lit(0.5), F.abs("expected_points") * (minutes_sd / FULL_MATCH) + 0.8), 6)).select(*given, "expected_points", "sd")

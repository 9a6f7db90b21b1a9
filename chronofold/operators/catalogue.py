"""The declared feature catalogue: which columns are summed up how, over which windows."""

from __future__ import annotations

from chronofold.operators.rolling import FeatureSpec

# The columns and windows of each group.
MEANS = ["minutes", "starts", "goals_scored", "assists", "clean_sheets", "goals_conceded", "saves", "yellow_cards", "bonus", "bps", "total_points", "defensive_contribution", "selected", "transfers_in", "transfers_out", "transfers_balance"]
MEAN_WINDOWS = [1, 3, 5, 10, 20]
SUMS = ["minutes", "total_points", "bonus", "transfers_balance"]
RATES = ["goals_scored", "assists", "expected_goals", "expected_assists", "expected_goal_involvements", "expected_goals_conceded", "bonus", "bps", "total_points", "saves", "threat", "creativity", "influence", "ict_index", "defensive_contribution"]
LONG_WINDOWS = [3, 5, 10, 20]
SPREADS, SPREAD_WINDOWS, SPREAD_PERIODS = ["total_points", "minutes", "bps", "threat"], [5, 10, 20], 3
EXTREMES, EXTREME_WINDOWS = ["total_points", "bps", "minutes"], [5, 10]


def catalogue_specs() -> list[FeatureSpec]:
    """All 180 specs in declared order."""
    out = [FeatureSpec(f"{m}_mean_{w}", m, w, "mean", family="mean") for m in MEANS for w in MEAN_WINDOWS]
    out += [FeatureSpec(f"{m}_sum_{w}", m, w, "sum", family="sum") for m in SUMS for w in LONG_WINDOWS]
    out += [FeatureSpec(f"{m}_per90_{w}", m, w, "shrunk_rate", denominator="minutes", family="rate") for m in RATES for w in LONG_WINDOWS]
    out += [FeatureSpec(f"{m}_std_{w}", m, w, "std", SPREAD_PERIODS, family="spread") for m in SPREADS for w in SPREAD_WINDOWS]
    return out + [FeatureSpec(f"{m}_{how}_{w}", m, w, how, family="extreme") for m in EXTREMES for w in EXTREME_WINDOWS for how in ("max", "min")]

"""Seeded feature programs."""

from __future__ import annotations

from chronofold.plans.nodes import Arith, EwmMean, FeatureProgram, GroupRel, Node, Rolling, ShrunkRate, Source, TimeSince, Trend, Unary


def rate(column: str) -> Node:
    return ShrunkRate(column, "minutes", 5)


def rolling(column: str, window: int, agg: str = "mean", **options) -> Node:
    return Rolling(Source(column), window, agg, **options)


def entity(column: str) -> Node:
    return Source(column, "entity")


def seeded() -> list[FeatureProgram]:
    """Fifteen programs over match history and what is known of the coming match."""
    # Names and trees of the seeded programs.
    trees = {
        "xg_x_expected_minutes": Arith("mul", rate("expected_goals"), rolling("minutes", 5)),
        "xg_x_opponent_weakness": Arith("mul", rate("expected_goals"), entity("opponent_conceded_xg_mean_5")),
        "rest_x_minutes_load": Arith("mul", TimeSince("minutes"), rolling("minutes", 5)),
        "creativity_x_opponent_solidity": Arith("mul", rate("creativity"), entity("opponent_conceded_xg_mean_5")),
        "threat_share_of_team": GroupRel("share", "team", rolling("threat", 5)),
        "transfer_momentum_5": Arith("safe_div", rolling("transfers_balance", 5), rolling("selected", 5)),
        "home_x_attacking_output": Arith("mul", entity("is_home"), rate("expected_goal_involvements")),
        "ceiling_x_start_security": Arith("mul", rolling("total_points", 5, "max"), rolling("starts", 5)),
        "points_vs_position_norm": GroupRel("zscore", "position", rolling("total_points", 5)),
        "opponent_chance_quality": Arith("safe_div", entity("opponent_conceded_xg_mean_5"), entity("opponent_conceded_goals_mean_5")),
        "points_volatility_10": rolling("total_points", 10, "std", min_periods=3),
        "threat_above_team_mean": GroupRel("dev_from_mean", "team", rolling("threat", 5)),
        "xg_rank_within_team": GroupRel("rank", "team", rate("expected_goals")),
        "minutes_trend_x_congestion": Arith("mul", Trend(Source("minutes"), 5), Unary("clip", TimeSince("minutes"), 0.0, 14.0)),
        "points_ewm_10": EwmMean(Source("total_points"), 10, 3.0),
    }
    return [FeatureProgram(name, root) for name, root in trees.items()]


# Mechanisms by which a metric may explain what is left over.
MECHANISMS = {
    "x_minutes": lambda m: Arith("mul", rate(m), rolling("minutes", 5)),
    "x_opponent": lambda m: Arith("mul", rate(m), entity("opponent_conceded_xg_mean_5")),
    "x_home": lambda m: Arith("mul", rate(m), entity("is_home")),
    "vs_position": lambda m: GroupRel("zscore", "position", rolling(m, 5)),
    "trend": lambda m: Trend(Source(m), 5),
    "ceiling": lambda m: rolling(m, 5, "max"),
}


def residual_programs(metrics: list[str]) -> list[FeatureProgram]:
    """Each mechanism over each metric."""
    return [FeatureProgram(f"{m}_{name}", make(m)) for m in metrics for name, make in MECHANISMS.items()]

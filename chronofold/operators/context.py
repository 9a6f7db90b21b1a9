"""A manager's situation as a vector of fixed width, for any number of managers.

Situations, squads, beliefs and fixture loads are tables; each comes down to one row a manager before they meet, and
the vector is one expression. Nothing of it hangs on what players are expected to score. The layout is declared
once, as blocks of names in order, and has a version: a hash of it, so a model that was fitted under another layout is
told apart. What isn't known (no squad, no fixtures) is zero where it stands and said in the mask of blocks.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.operators.squads import BUDGET, CLUB_CAP, ELEVEN, QUOTA, SQUAD_SIZE

# Aims in order, the most free transfers, and what horizons, hits and beliefs are scaled by.
METRICS = ("expected_points", "expected_rank_gain", "downside_protection", "team_value_growth", "captaincy_upside", "differential_yield", "transfer_flexibility", "conservative")
MOST_TRANSFERS, HORIZON, HITS, BELIEFS, OUTFIELD = 5, 10.0, 8.0, 5.0, 10.0
# Blocks and their names.
BLOCKS = {
    "objective": [*(f"objective_metric_{m}" for m in METRICS), "objective_signed_uncertainty_penalty", "objective_ownership_sign", "objective_planning_horizon", "objective_team_value_weight", "objective_captaincy_weight", "objective_transfer_cost_weight"],
    "transfer_freedom": ["transfer_free_transfers", "transfer_max_bound", "transfer_is_bounded", "transfer_max_points_hit", "transfer_allows_hits"],
    "slot_pressure": [f"slot_pressure_{p.lower()}" for p in QUOTA],
    "club_pressure": ["club_max_concentration", "club_locked_concentration", "club_share_at_ceiling"],
    "budget": ["budget_bank_share", "budget_headroom_per_open_slot", "budget_squad_value_share", "budget_minimum_bank_share", "budget_bank_is_binding", "budget_sell_on_drag"],
    "formation": ["formation_defenders", "formation_midfielders", "formation_forwards", "formation_is_fixed", "formation_reachable_share"],
    "fixture": ["fixture_locked_load", "fixture_sellable_load", "fixture_load_gap", "fixture_outlook_available"],
    "belief": ["belief_count", "belief_mean_signed_confidence", "belief_squad_share"],
}
NAMES = [n for names in BLOCKS.values() for n in names]
#: Block -> where it begins in the vector, and how long it is.
OFFSETS = {b: (sum(len(n) for n in list(BLOCKS.values())[:k]), len(names)) for k, (b, names) in enumerate(BLOCKS.items())}
#: Beliefs that speak against a player.
AGAINST = ("underperform_model", "will_not_start")
SHAPES = [(d, m, 10 - d - m) for d in range(ELEVEN["DEF"][0], ELEVEN["DEF"][1] + 1) for m in range(ELEVEN["MID"][0], ELEVEN["MID"][1] + 1) if ELEVEN["FWD"][0] <= 10 - d - m <= ELEVEN["FWD"][1]]
#: Places that fingerprints round to.
PLACES = 9


def version(names: list[str] = NAMES) -> str:
    """The layout's name; it changes when a name comes, goes or moves."""
    return "context-" + hashlib.sha256("\n".join(names).encode()).hexdigest()[:12]


def check(layout: str) -> None:
    """Refuse a model that was fitted under another layout."""
    if layout != version():
        raise ValueError(f"fitted under {layout}, and this is {version()}")


def block(vector: Column, name: str) -> Column:
    """A block of a vector, as an array."""
    start, length = OFFSETS[name]
    return F.slice(vector, start + 1, length)


def value(vector: Column, name: str) -> Column:
    return F.element_at(vector, NAMES.index(name) + 1)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def _loads(loads: DataFrame, horizons: DataFrame) -> DataFrame:
    """manager_id, team_id and the mean load of the club's next fixtures within the manager's horizon (loads: team_id, ahead from 1, load)."""
    by_club = loads.groupBy("team_id").agg(F.sort_array(F.collect_list(F.struct("ahead", F.col("load").cast("double").alias("load")))).alias("_loads"))
    near = horizons.join(by_club, "team_id")
    first = F.slice("_loads", F.lit(1), F.greatest(F.lit(0), F.col("planning_horizon").cast("int")))
    mean = F.aggregate(first, F.lit(0.0), lambda s, x: s + x["load"]) / F.size(first)
    return near.where(F.size(first) > 0).select("manager_id", "team_id", mean.alias("_load"))


def _squad_rows(contexts: DataFrame, squads: DataFrame, loads: DataFrame | None) -> DataFrame:
    """One row a manager with a squad: counts, money and loads of frozen and sellable picks."""
    limits = contexts.select("manager_id", "locked_players", "locked_positions", "planning_horizon")
    has = lambda c, x: F.coalesce(F.array_contains(F.col(c), F.col(x)), F.lit(False))
    picks = squads.join(limits, "manager_id").withColumn("_frozen", has("locked_players", "player_code") | has("locked_positions", "position"))
    if loads is not None:
        per_club = _loads(loads, picks.select("manager_id", "team_id", "planning_horizon").distinct())
        picks = picks.join(per_club, ["manager_id", "team_id"], "left")
    else:
        picks = picks.withColumn("_load", F.lit(None).cast("double"))
    clubs = picks.groupBy("manager_id", "team_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("_frozen").alias("f"))
    clubs = clubs.groupBy("manager_id").agg(F.max("n").alias("_most"), F.max("f").alias("_most_frozen"), F.count_if(F.col("n") >= CLUB_CAP).alias("_full"))
    free, price, selling = ~F.col("_frozen"), F.col("price").cast("double"), F.col("selling_price").cast("double")
    rows = picks.groupBy("manager_id").agg(
        F.count(F.lit(1)).alias("_size"),
        *(F.count_if(F.col("_frozen") & (F.col("position") == p)).alias(f"_frozen_{p}") for p in QUOTA),
        F.sum(selling).alias("_value"),
        F.count_if(free).alias("_open"),
        F.coalesce(F.sum(F.when(free, selling)), F.lit(0.0)).alias("_sellable"),
        F.coalesce(F.avg(F.when(free, _ratio(price - selling, price))), F.lit(0.0)).alias("_drag"),
        F.coalesce(F.avg(F.when(~free, F.col("_load"))), F.lit(0.0)).alias("_frozen_load"),
        F.coalesce(F.avg(F.when(free, F.col("_load"))), F.lit(0.0)).alias("_free_load"),
        F.collect_set("player_code").alias("_held"),
    )
    return rows.join(clubs, "manager_id")


def encode(contexts: DataFrame, squads: DataFrame, beliefs: DataFrame, loads: DataFrame | None = None) -> DataFrame:
    """manager_id, vector (an array as NAMES), mask (block -> whether it was known), version and fingerprint of each manager.

    contexts: manager_id, primary_metric, uncertainty_penalty, ownership_sign, planning_horizon, team_value_weight,
    captaincy_weight, transfer_cost_weight, max_transfers, max_points_hit, minimum_bank, bank, free_transfers, formation
    (as 4-4-2, or null), locked_players and locked_positions (arrays, or null). squads: manager_id, player_code,
    position, team_id, price, selling_price. beliefs: manager_id, player_code, proposition, confidence. loads: team_id, ahead, load.
    Managers without picks have no squad. Nulls among numbers count as zero, a null max_transfers as unbounded, free_transfers as one.
    """
    n = lambda c, other=0.0: F.coalesce(F.col(c).cast("double"), F.lit(other))
    base = contexts.join(_squad_rows(contexts, squads, loads), "manager_id", "left")
    signed = F.col("confidence").cast("double") * F.when(F.col("proposition").isin(*AGAINST), -1.0).otherwise(1.0)
    said = beliefs.groupBy("manager_id").agg(F.count(F.lit(1)).alias("_beliefs"), F.avg(signed).alias("_signed"), F.collect_set("player_code").alias("_about"))
    base = base.join(said, "manager_id", "left")
    here = F.col("_size").isNotNull()
    bank, least = n("bank"), n("minimum_bank")
    value_of_squad = n("_value") + bank
    spendable = bank + n("_sellable") - least
    headroom = F.when(n("_open") > 0, spendable / n("_open")).otherwise(0.0)
    shape = [F.try_element_at(F.split("formation", "-"), F.lit(k)).try_cast("int") for k in (1, 2, 3)]
    fixed = F.col("formation").isNotNull()
    reachable = F.lit(0.0)
    for d, m, f in SHAPES:
        reachable = reachable + F.when((shape[0] == d) & (shape[1] == m) & (shape[2] == f), 1.0 / len(SHAPES)).otherwise(0.0)
    touched = F.when(n("_size") > 0, F.size(F.array_intersect("_about", "_held")) / n("_size")).otherwise(0.0)
    known_loads = here & F.lit(loads is not None)
    bound = F.coalesce(F.col("max_transfers").cast("double"), F.lit(float(MOST_TRANSFERS)))
    blocks = {
        "objective": [*((F.col("primary_metric") == m).cast("double") for m in METRICS), n("uncertainty_penalty"), n("ownership_sign"), n("planning_horizon") / HORIZON, n("team_value_weight"), n("captaincy_weight"), n("transfer_cost_weight")],
        "transfer_freedom": [F.when(here, n("free_transfers", 1.0)).otherwise(1.0) / MOST_TRANSFERS, bound / MOST_TRANSFERS, F.col("max_transfers").isNotNull().cast("double"), F.least(n("max_points_hit") / HITS, F.lit(1.0)), (n("max_points_hit") > 0).cast("double")],
        "slot_pressure": [n(f"_frozen_{p}") / q for p, q in QUOTA.items()],
        "club_pressure": [n("_most") / CLUB_CAP, n("_most_frozen") / CLUB_CAP, n("_full") / (SQUAD_SIZE / CLUB_CAP)],
        "budget": [
            F.when(here, _ratio(bank, bank + value_of_squad)).otherwise(1.0),
            F.when(here, F.least(headroom / (BUDGET / SQUAD_SIZE), F.lit(1.0))).otherwise(1.0),
            F.when(here, value_of_squad / BUDGET).otherwise(0.0),
            least / BUDGET,
            F.when(here & (bank <= least), 1.0).otherwise(0.0),
            n("_drag"),
        ],
        "formation": [*(F.when(fixed, s / OUTFIELD).otherwise(0.0) for s in shape), fixed.cast("double"), F.when(fixed, reachable).otherwise(1.0)],
        "fixture": [*(F.when(known_loads, x).otherwise(0.0) for x in (n("_frozen_load"), n("_free_load"), n("_frozen_load") - n("_free_load"))), known_loads.cast("double")],
        "belief": [F.least(n("_beliefs") / BELIEFS, F.lit(1.0)), n("_signed"), touched],
    }
    flat = [F.coalesce(c.cast("double"), F.lit(0.0)) for b in BLOCKS for c in blocks[b]]
    if len(flat) != len(NAMES):
        raise ValueError("the encoding and its names have diverged")
    squad_blocks = {"slot_pressure", "club_pressure", "budget"}
    mask = F.create_map(*[x for b in BLOCKS for x in (F.lit(b), here if b in squad_blocks else known_loads if b == "fixture" else F.lit(True))])
    vector = F.array(*flat)
    text = F.concat_ws("|", F.lit(version()), F.array_join(F.transform(vector, lambda x: F.round(x * 10**PLACES).cast("long").cast("string")), ","))
    return base.select("manager_id", vector.alias("vector"), mask.alias("mask"), F.lit(version()).alias("version"), F.sha2(text.cast("binary"), 256).alias("fingerprint"))

"""Situation vectors against plain arithmetic."""

import pytest
from pyspark.sql import functions as F

from chronofold.operators import context

CONTEXT = "manager_id long, primary_metric string, uncertainty_penalty double, ownership_sign int, planning_horizon int, team_value_weight double, captaincy_weight double, transfer_cost_weight double, max_transfers int, max_points_hit int, minimum_bank long, bank long, free_transfers int, formation string, locked_players array<long>, locked_positions array<string>"
SQUAD = "manager_id long, player_code long, position string, team_id long, price long, selling_price long"
BELIEF = "manager_id long, player_code long, proposition string, confidence double"
LOAD = "team_id long, ahead int, load double"


def tables(spark):
    contexts = spark.createDataFrame(
        [
            (1, "expected_rank_gain", -0.2, -1, 3, 1.0, 1.4, 0.5, None, 4, 10, 25, 2, "4-4-2", [100, 999], ["FWD"]),
            (2, "expected_points", None, None, None, None, None, None, 1, 0, None, None, None, None, None, None),
            (3, None, 0.1, 1, 1, 0.0, 0.0, 0.0, 0, 40, 30, 30, 5, "9-9-9", [], []),
        ],
        CONTEXT,
    )
    positions = ["GKP"] * 2 + ["DEF"] * 5 + ["MID"] * 5 + ["FWD"] * 3
    squads = [(1, 100 + k, p, k % 4, 50 + k, 50 + k - k % 3) for k, p in enumerate(positions)] + [(3, 7, "GKP", 1, 0, 0), (3, 8, "DEF", 1, 40, 41)]
    beliefs = [(1, 100, "will_start", 0.8), (1, 500, "will_not_start", 0.6), (2, 1, "will_return", 0.5)]
    loads = [(t, a, float(t + a)) for t in range(3) for a in range(1, 6)]
    return contexts, spark.createDataFrame(squads, SQUAD), spark.createDataFrame(beliefs, BELIEF), spark.createDataFrame(loads, LOAD), squads


def vectors(frame):
    return {r.manager_id: (dict(zip(context.NAMES, r.vector, strict=True)), r) for r in frame.collect()}


def test_vectors(spark):
    contexts, squads, beliefs, loads, rows = tables(spark)
    got = vectors(context.encode(contexts, squads, beliefs, loads))
    one, row = got[1]
    assert sum(one[f"objective_metric_{m}"] for m in context.METRICS) == 1 and one["objective_metric_expected_rank_gain"] == 1
    assert [one[k] for k in ("objective_signed_uncertainty_penalty", "objective_ownership_sign", "objective_planning_horizon")] == [-0.2, -1, 0.3]
    assert [one[k] for k in context.BLOCKS["transfer_freedom"]] == [0.4, 1.0, 0.0, 0.5, 1.0]
    assert [one[k] for k in context.BLOCKS["slot_pressure"]] == [0.5, 0, 0, 1.0]
    mine = [r for r in rows if r[0] == 1]
    frozen = [r for r in mine if r[1] == 100 or r[2] == "FWD"]
    free = [r for r in mine if r not in frozen]
    held = [sum(r[3] == t for r in mine) for t in range(4)]
    assert [one[k] for k in context.BLOCKS["club_pressure"]] == pytest.approx([max(held) / 3, max(sum(r[3] == t for r in frozen) for t in range(4)) / 3, sum(h >= 3 for h in held) / 5])
    worth = sum(r[5] for r in mine) + 25
    money = [25 / (25 + worth), min(1, (25 + sum(r[5] for r in free) - 10) / len(free) / (1000 / 15)), worth / 1000, 0.01, 0.0, sum((r[4] - r[5]) / r[4] for r in free) / len(free)]
    assert [one[k] for k in context.BLOCKS["budget"]] == pytest.approx(money)
    assert [one[k] for k in context.BLOCKS["formation"]] == pytest.approx([0.4, 0.4, 0.2, 1, 1 / len(context.SHAPES)])
    load = lambda some: sum(r[3] + 2 for r in some if r[3] < 3) / sum(r[3] < 3 for r in some)
    assert [one[k] for k in context.BLOCKS["fixture"]] == pytest.approx([load(frozen), load(free), load(frozen) - load(free), 1])
    assert [one[k] for k in context.BLOCKS["belief"]] == pytest.approx([0.4, 0.1, 1 / 15])
    assert all(row.mask.values())


def test_what_is_not_known(spark):
    contexts, squads, beliefs, loads, _ = tables(spark)
    got = vectors(context.encode(contexts, squads, beliefs))
    two, row = got[2]
    assert row.mask == {b: b in ("objective", "transfer_freedom", "formation", "belief") for b in context.BLOCKS}
    assert [two[k] for k in context.BLOCKS["budget"]] == [1, 1, 0, 0, 0, 0] and [two[k] for k in context.BLOCKS["fixture"]] == [0, 0, 0, 0]
    assert [two[k] for k in context.BLOCKS["transfer_freedom"]] == [0.2, 0.2, 1, 0, 0] and two["formation_reachable_share"] == 1
    three, _ = got[3]
    assert three["budget_bank_is_binding"] == 1 and three["budget_sell_on_drag"] == pytest.approx(-1 / 80) and three["formation_reachable_share"] == 0 and three["transfer_max_points_hit"] == 1
    assert context.encode(contexts.limit(0), squads, beliefs).count() == 0


def test_layout(spark):
    contexts, squads, beliefs, loads, _ = tables(spark)
    frame = context.encode(contexts, squads, beliefs, loads)
    r = frame.select("version", context.block(F.col("vector"), "club_pressure").alias("b"), context.value(F.col("vector"), "club_max_concentration").alias("v"), "fingerprint").where("manager_id = 1").first()
    assert r.b[0] == r.v and len(r.b) == 3 and sum(n for _, n in context.OFFSETS.values()) == len(context.NAMES) == len(set(context.NAMES))
    again = context.encode(contexts, squads.repartition(7), beliefs, loads).where("manager_id = 1").first()
    other = context.encode(contexts.withColumn("bank", F.col("bank") + 1), squads, beliefs, loads).where("manager_id = 1").first()
    assert again.fingerprint == r.fingerprint != other.fingerprint
    context.check(r.version)
    with pytest.raises(ValueError):
        context.check(context.version(context.NAMES[::-1]))

"""What scores are made of, and where elevens differ."""

import pytest
from pyspark.sql import functions as F

from chronofold.operators import explain, scoring


def test_terms_come_to_the_total(spark):
    names = ["p_short", "p_long", "expected_goals", "expected_assists", "p_clean_sheet", "expected_conceded", "expected_saves", "expected_bonus", "expected_yellow", "p_defensive"]
    rows = [("DEF", 0.1, 0.8, 0.2, 0.1, 0.4, 1.2, 0.0, 0.3, 0.1, 0.5), ("FWD", 0.0, 0.0, *[0.0] * 8), ("GKP", 0.0, 1.0, 0.0, 0.0, 0.3, 1.0, 4.0, 0.2, 0.0, 0.0)]
    frame = spark.createDataFrame(rows, ["position", *names])
    got = explain.derivation(frame, scoring.expected_points()).collect()
    assert all(r.reconciles for r in got)
    defender = {t.component: (t.expectation, t.rate, t.points) for t in got[0].terms}
    assert defender["goals"] == pytest.approx((0.2, 6, 1.2)) and defender["conceded"] == pytest.approx((1.2, -0.5, -0.6)) and "saves" not in defender
    assert defender["appearing"] == pytest.approx((0.9, 1.7 / 0.9, 1.7)) and [abs(t.points) for t in got[0].terms] == sorted((abs(t.points) for t in got[0].terms), reverse=True)
    assert got[1].terms == []
    assert not explain.derivation(frame, scoring.expected_points() + 1).first().reconciles


ELEVEN = "squad_id long, player_code long, position string, points double"


def test_swaps_are_paired_within_positions(spark):
    yours = [(1, 1, "GKP", 3.0), (1, 2, "DEF", 2.0), (1, 3, "DEF", 1.0), (1, 4, "MID", 5.0), (1, 5, "FWD", 4.0), (2, 9, "GKP", 1.0)]
    ours = [(1, 1, "GKP", 3.0), (1, 6, "DEF", 4.0), (1, 4, "MID", 5.0), (1, 7, "MID", 4.5), (1, 5, "FWD", 4.0), (2, 9, "GKP", 1.0)]
    y, o = spark.createDataFrame(yours, ELEVEN), spark.createDataFrame(ours, ELEVEN)
    got = {(r.position, r.place): (r.player_out, r.player_in, r.delta) for r in explain.lineup_swaps(y, o).collect()}
    assert got == {("DEF", 1): (2, 6, 2.0), ("DEF", 2): (3, None, -1.0), ("MID", 1): (None, 7, 4.5)}
    captains = spark.createDataFrame([(1, 5, 4), (2, None, None)], "squad_id long, yours long, ours long")
    diff = {r.squad_id: r for r in explain.lineup_difference(y, o, captains).collect()}
    one = diff[1]
    assert (one.yours_points, one.ours_points, one.swaps, one.swap_delta, one.captain_delta, one.shape_delta) == (19.0, 25.5, 3, 5.5, 1.0, 0.0)
    assert (one.yours_shape, one.ours_shape) == ("2-1-1", "1-2-1") and diff[2].swaps == 0 and diff[2].captain_delta == 0.0
    assert explain.lineup_swaps(y.limit(0), o.limit(0)).count() == 0 and y.select(F.count("*")).first()[0] == 6

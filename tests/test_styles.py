"""Archetypes within positions."""

import numpy as np
from pyspark.sql import functions as F

from chronofold.operators import decisions


def test_styles_of_planted_clusters(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(400):
        p, c = ("MID", "FWD")[k % 2], k // 2 % 4
        rows.append((k, p, float(c % 2 * 8 + rng.normal()), float(c // 2 * 8 + rng.normal()) if k % 50 else None, 3.0, float(rng.normal(100, 1))))
    rows += [(900 + k, "GKP", float(k), float(-k), 1.0, 1.0) for k in range(10)]
    frame = spark.createDataFrame(rows, "player_code long, position string, shots double, passes double, flat double, weight double")
    styles, placed = decisions.fit_styles(frame.repartition(5), ["shots", "passes", "flat", "weight"], {"shots": ("shooter", "shy")})
    assert set(styles.axes) == {"MID", "FWD"} and styles.axes["MID"] == ["shots", "passes"]
    got = placed.collect()
    assert len(got) == 400 and {len(set(x)) for x in styles.labels.values()} == {4}
    own = {}
    for r in got:
        if r.player_code % 50:
            own.setdefault((r.position, r.label), set()).add(r.player_code // 2 % 4)
    assert len(own) == 8 and all(len(v) == 1 for v in own.values())
    assert {label.rsplit(" ", 1)[0] for label in styles.labels["MID"]} == {f"{a}, {b}" if f"{a}, {b} MID" in styles.labels["MID"] else f"{b}, {a}" for a in ("shooter", "shy") for b in ("high passes", "low passes")}
    again, _ = decisions.fit_styles(frame, ["shots", "passes", "flat", "weight"], {"shots": ("shooter", "shy")})
    assert np.allclose(again.centres["MID"], styles.centres["MID"]) and again.labels == styles.labels


def test_labels_widen_until_they_differ_and_are_numbered_when_nothing_tells_them_apart():
    words = {}
    assert decisions.style_labels("MID", [[2, 1, 0.9], [2, 1, -0.9], [0, 0.1, 0]], ["a", "b", "c"], words) == ["high a, high b, high c MID", "high a, high b, low c MID", "typical MID"]
    assert decisions.style_labels("MID", [[2, 0, 0], [2, 0, 0], [0, 0, 0]], ["a", "b", "c"], words) == ["high a MID", "high a MID (2)", "typical MID"]


def test_no_position_with_enough_players(spark):
    frame = spark.createDataFrame([(1, "MID", 1.0, 2.0)], "player_code long, position string, a double, b double")
    assert decisions.archetypes(frame, ["a", "b"]).count() == 0 and decisions.archetypes(frame.limit(0), ["a", "b"]).select(F.count("*")).first()[0] == 0

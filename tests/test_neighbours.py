"""Exact neighbours against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold.operators import neighbours


def plain(rows, k):
    out = []
    for key, g, v in rows:
        if v is None or g is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        near = sorted((float(((np.array(v) - np.array(w)) ** 2).sum()), other) for other, h, w in rows if h == g and other != key and w is not None and all(x is not None and np.isfinite(x) for x in w))
        out += [(key, other, place + 1, pytest.approx(d2, abs=1e-9)) for place, (d2, other) in enumerate(near[:k])]
    return sorted(out, key=lambda r: (r[0], r[2]))


def got(spark, rows, k):
    frame = spark.createDataFrame(rows, "id long, kind string, v array<double>").repartition(3)
    return sorted(map(tuple, neighbours.neighbours(frame, "id", "kind", "v", k).collect()), key=lambda r: (r[0], r[2]))


def clustered(n, dims=4, centres=12, seed=3):
    rng = np.random.default_rng(seed)
    at = rng.normal(0, 30, (centres, dims))
    return [(k, "a" if k % 4 else "b", (at[k % centres] + rng.normal(0, 1, dims)).tolist()) for k in range(n)]


@pytest.mark.parametrize(("block", "whole"), [(5, 10), (64, 0), (64, 2048)])
def test_neighbours_are_those_of_all_pairs(spark, monkeypatch, block, whole):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "WHOLE", whole)
    monkeypatch.setattr(neighbours, "PART", 70)
    rows = clustered(400)
    rows += [(1000 + k, "a", rows[5][2]) for k in range(9)]  # copies of one vector
    rows += [(2000, "lone", [1.0, 2.0, 3.0, 4.0]), (2001, "pair", [0.0] * 4), (2002, "pair", [1.0] * 4), (2003, "a", None), (2004, None, [0.0] * 4), (2005, "a", [float("nan")] * 4), (2006, "a", [None, 1.0, 1.0, 1.0])]
    assert got(spark, rows, 4) == plain(rows, 4)


def test_ties_go_to_the_smaller_key(spark):
    rows = [(x * 10 + y, "g", [float(x), float(y)]) for x in range(10) for y in range(10)]
    assert got(spark, rows, 5) == plain(rows, 5)


def test_a_group_of_copies_and_an_empty_table(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "HOT", 10)
    rows = [(k, "g", [1.0, 1.0]) for k in range(60)] + [(99, "g", [2.0, 1.0])]
    assert got(spark, rows, 3) == plain(rows, 3)
    assert got(spark, [], 3) == []


def test_most_pairs_of_clustered_rows_are_never_compared(spark):
    rows = clustered(3000, dims=3, centres=60)
    unique = neighbours.unique_vectors(spark.createDataFrame(rows, "id long, kind string, v array<double>"), "id", "kind", "v", 4)
    _, _, met = neighbours.visits(unique, 4)
    compared = met.agg(F.sum("rows")).first()[0]
    every = sum(n * n for n in (sum(r[1] == g for r in rows) for g in "ab"))
    assert compared < every / 6


def test_spread_rows_meet_in_tiles_and_no_table_has_a_row_for_each_pair(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(k, "g", rng.normal(0, 1, 16).tolist()) for k in range(1200)]
    rows += [(k + 5000, "far", (1e7 + rng.normal(0, 1, 3)).tolist()) for k in range(90)]
    rows += [(9000 + k, "even", [float(k == i) for i in range(40)]) for k in range(40)]  # all equally far from each other
    for name, value in (("WHOLE", 10), ("BLOCK", 8), ("TILE", 200), ("FOLLOW", 300)):
        monkeypatch.setattr(neighbours, name, value, raising=False)
    sizes, write = [], neighbours.written

    def counted(df):
        out = write(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(neighbours, "written", counted)
    assert got(spark, rows, 3) == plain(rows, 3)
    assert max(sizes) <= 2 * len(rows)

"""Squads that are filled in an order."""

import random

import pytest
from pyspark.sql import functions as F

from chronofold.operators import squad_fill, squads

SCHEMA = "player_code long, position string, team_id long, price long"
POSITIONS = ("GKP", "DEF", "MID", "FWD")


def market(spark, n=200, clubs=11, price=lambda k: 40 + k * 7 % 61):
    return spark.createDataFrame([(k, POSITIONS[k % 4], k % clubs, price(k)) for k in range(n)], SCHEMA)


def draws(spark, n):
    return spark.range(n).withColumnRenamed("id", "squad_id")


def issues(filled):
    return {r.squad_id: list(r.issues) for r in squads.legality(squad_fill.squads_of(filled)).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_squads_keep_the_rules_and_differ(spark, seed):
    filled = squad_fill.fill_random(market(spark), draws(spark, 12), seed)
    assert issues(filled) == {k: [] for k in range(12)}
    picks = {r.squad_id: tuple(sorted(p.player_code for p in r.picks)) for r in filled.collect()}
    assert len(set(picks.values())) == 12
    assert picks == {r.squad_id: tuple(sorted(p.player_code for p in r.picks)) for r in squad_fill.fill_random(market(spark).repartition(5), draws(spark, 12), seed).collect()}


def test_a_draw_that_gets_stuck_is_repaired(spark):
    # Few players, three clubs of which are dear: most walks run into the budget or the caps.
    tight = market(spark, 44, 6, lambda k: 45 + (k * 13) % 30)
    assert issues(squad_fill.fill_random(tight, draws(spark, 20), 3)) == {k: [] for k in range(20)}


def test_a_market_without_a_legal_squad_says_what_is_short(spark):
    dear = squad_fill.fill_random(market(spark, price=lambda k: 90), draws(spark, 2)).collect()
    assert len(dear) == 2 and all(r.short and not r.picks for r in dear)
    one_club = squad_fill.fill_random(market(spark, clubs=1), draws(spark, 1)).first()
    assert one_club.short and len(one_club.picks) <= 3
    no_keeper = squad_fill.fill_random(market(spark).where("position <> 'GKP'"), draws(spark, 1)).first()
    assert "GKP" in no_keeper.short
    assert squad_fill.fill_random(market(spark).limit(0), draws(spark, 1)).first().picks == []


def test_nulls_and_repeated_players(spark):
    odd = spark.createDataFrame([(900, "GKP", None, 40), (901, "DEF", 1, None), (None, "MID", 1, 40), (902, "XXX", 1, 40), (4, "GKP", 4, 68)], SCHEMA)
    filled = squad_fill.fill_random(market(spark).union(odd), draws(spark, 5))
    assert issues(filled) == {k: [] for k in range(5)}


def plain_ranked(rows, order, least):
    """The greedy fill, one player at a time."""
    picks = []
    for p in squad_fill.ORDER:
        for code, pos, team, price in sorted(rows, key=lambda r: (-order(r), r[0])):
            have = sum(x[1] == p for x in picks)
            if pos != p or have == squads.QUOTA[p] or sum(x[2] == team for x in picks) >= 3:
                continue
            left = {q: squads.QUOTA[q] - sum(x[1] == q for x in picks) - (q == p) for q in squads.QUOTA}
            if sum(x[3] for x in picks) + price + sum(least[q][left[q]] for q in left) <= 1000:
                picks.append((code, pos, team, price))
    return sorted(x[0] for x in picks)


def test_ranked_fill_is_the_greedy_one(spark):
    rng = random.Random(6)
    rows = [(k, POSITIONS[k % 4], rng.randrange(12), rng.randrange(38, 130)) for k in range(400)]
    players = spark.createDataFrame(rows, SCHEMA)
    least = squad_fill.Market(players).least
    got = squad_fill.fill_ranked(players, F.col("price")).first()
    assert sorted(p.player_code for p in got.picks) == plain_ranked(rows, lambda r: r[3], least) and not got.short
    got = squad_fill.fill_ranked(players, F.pmod(F.col("player_code") * 37, F.lit(101))).first()
    assert sorted(p.player_code for p in got.picks) == plain_ranked(rows, lambda r: r[0] * 37 % 101, least)

"""Market queries whose work must follow the tables and not squads times candidates."""

from pyspark.sql import functions as F

from chronofold.operators import squads

PICKS = [(s, s * 15 + k, ("GKP", "DEF", "MID", "FWD")[k % 4], k % 5) for s in range(3) for k in range(15)]


def test_buyable_is_counted_as_bans_are_listed(spark):
    picks = spark.createDataFrame(PICKS, "squad_id long, player_code long, position string, team_id long")
    pool = spark.createDataFrame([(k, ("GKP", "DEF", "MID", "FWD")[k % 4], None if k == 50 else k % 5) for k in range(60)], "player_code long, position string, team_id long")
    limits = spark.createDataFrame([(0, [1, 50, 999, 50], [2, 3, 3]), (1, None, [77]), (2, [], None)], "squad_id long, excluded_players array<long>, excluded_teams array<long>").withColumns({"locked_players": F.array(F.lit(4)), "locked_positions": F.array(F.lit("GKP"))})
    _, bans = squads.constrained(picks, pool, limits)
    left = {r.squad_id: 60 - r["count"] for r in bans.groupBy("squad_id").count().collect()}
    counts = squads.buyable_counts(picks, pool, limits)
    assert {r.squad_id: r.buyable for r in counts.collect()} == left


def test_weeks_of_entities_agree_with_their_rows(spark):
    players = spark.createDataFrame([(1, "s", 1), (2, "s", 1), (2, "s", 3), (3, "s", 9), (4, "t", 1)], "player_code long, season string, team_id long")
    fixtures = spark.createDataFrame([("s", g, f, f, a, b, 1, 2) for f, (g, a, b) in enumerate([(1, 1, 2), (1, 3, 1), (2, 1, 3), (2, 1, 1), (3, 2, 4)])], "season string, gameweek_id long, fixture_id long, kickoff_time long, home_team_id long, away_team_id long, home_difficulty long, away_difficulty long")
    rows = squads.build_entities(players, fixtures, F.lit("2024")).groupBy("player_code", "gameweek_id").agg(F.max("fixture_index").alias("last_index"), F.max("fixture_count").alias("fixture_count"))
    assert sorted(map(str, squads.entity_weeks(players, fixtures).collect())) == sorted(map(str, rows.collect()))


def test_opportunity_cost_meets_prices_and_not_candidates(spark):
    pool = [(k, "DEF" if k % 2 else "MID", 40 + k % 7, (k * 37 % 11) / 2) for k in range(90)] + [(500, "DEF", None, 99.0), (501, "DEF", 40, None)]
    locked = [(s, k, "DEF" if k % 2 else "MID", 39 + s % 9, (k * 37 % 11) / 2) for s, k in enumerate(range(40))]
    got = squads.opportunity_cost(spark.createDataFrame(locked, "squad_id long, player_code long, position string, budget long, value double"), spark.createDataFrame(pool, "player_code long, position string, price long, value double"))
    want = set()
    for s, k, p, budget, v in locked:
        better = [(-w, c) for c, q, price, w in pool if q == p and price is not None and w is not None and price <= budget and w > v and c != k]
        want.add((s, k, min(better)[1] if better else None, round(-min(better)[0] - v, 6) if better else 0.0))
    assert {tuple(r) for r in got.collect()} == want
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_leaks_are_found_whichever_users_they_touch(spark, tmp_path):
    from chronofold.queries import market

    # The first events by number, and all that come after the cutoff, are of users beyond the first 400.
    rows = [(u, f"2024-01-{1 + u % 3:02d} 08:00:00", 600 - u, 1.0) for u in range(600)] + [(1000 + u, "2024-01-25 08:00:00", u, 2.0) for u in range(500, 600)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, value double").selectExpr("event_id", "CAST(ts AS timestamp_ntz) AS ts", "user_id", "'a' AS event_type", "value")
    events.write.parquet(f"{tmp_path}/events.parquet")
    assert sorted(map(tuple, market.leakage_found(spark, str(tmp_path)).collect())) == [("leaky", "all_events"), ("made", "all_events")]


def test_picked_moves_are_the_best_of_all_moves(spark):
    import random

    from chronofold.operators import frontier

    rng = random.Random(4)
    spots = ["GKP"] * 2 + ["DEF"] * 5 + ["MID"] * 5 + ["FWD"] * 3
    picks = [(s, s * 15 + k, spots[k], rng.randrange(6), rng.randrange(40, 70), rng.randrange(40) / 4, rng.choice([0.5, 1.0])) for s in range(5) for k in range(15 if s < 4 else 9)]
    pool = [(c, rng.choice(spots), rng.choice([*range(6), None]), rng.choice([*range(38, 72), None]), rng.choice([x / 4 for x in range(40)] + [None]), rng.choice([0.5, 1.0, 1.5] * 9 + [None])) for c in range(240)]
    kind = "player_code long, position string, team_id int, {} int, expected_points double, sd double"
    picks = spark.createDataFrame(picks, "squad_id long, " + kind.format("selling_price"))
    pool = spark.createDataFrame(pool, kind.format("price"))
    state = spark.createDataFrame([(s, s, s % 2) for s in range(5)], "squad_id long, bank int, free_transfers int")
    everything = squads.legal_transfers(picks, pool, state).cache()
    few = frontier.best_incoming(picks, pool, state, squads.BOARD_SIZE)
    assert few.groupBy("squad_id", "out_code").count().where(f"count > {squads.BOARD_SIZE}").count() == 0
    some = squads.legal_transfers(picks, pool, state, picked=few).cache()
    board = lambda moves: sorted(map(str, squads.transfer_board(moves).drop("hold_points", "position").collect()))
    assert board(some) == board(everything)
    assert some.count() < everything.count()
    incoming = pool.select(F.col("player_code").alias("in_code"), F.col("expected_points").alias("in_points"), F.col("price").alias("in_price"))
    by = few.unionByName(frontier.best_incoming(picks, pool, state, by="expected_points")).unionByName(frontier.best_incoming(picks, pool, state, by="price")).distinct()
    policies = lambda moves: sorted(map(str, squads.policy_moves(moves, incoming).where("policy <> 'random'").collect()))
    assert policies(squads.legal_transfers(picks, pool, state, picked=by)) == policies(everything)


def test_a_squads_best_moves_are_chosen_before_they_are_rows(spark, monkeypatch):
    import random

    from chronofold.operators import frontier

    monkeypatch.setattr(frontier, "WINDOW", 20)
    rng = random.Random(8)
    spots = ["GKP"] * 2 + ["DEF"] * 5 + ["MID"] * 5 + ["FWD"] * 3
    picks = [(s, s * 15 + k, spots[k], rng.randrange(6), rng.randrange(40, 70), rng.randrange(40) / 4, rng.choice([0.5, 1.0])) for s in range(6) for k in range(15 if s < 5 else 9)]
    pool = [(c, rng.choice(spots), rng.choice([*range(7), None]), rng.choice([*range(38, 72), None]), rng.choice([x / 4 for x in range(40)]), rng.choice([0.5, 1.0, 1.5])) for c in range(400)]
    kind = "player_code long, position string, team_id int, {} int, expected_points double, sd double"
    picks, pool = spark.createDataFrame(picks, "squad_id long, " + kind.format("selling_price")), spark.createDataFrame(pool, kind.format("price"))
    state = spark.createDataFrame([(s, s, s % 2) for s in range(6)], "squad_id long, bank int, free_transfers int")
    everything = squads.legal_transfers(picks, pool, state).cache()
    few = frontier.best_incoming(picks, pool, state, squads.BOARD_SIZE, each="squad")
    assert few.groupBy("squad_id").count().agg(F.max("count")).first()[0] <= squads.BOARD_SIZE
    rows = lambda frame: sorted(map(str, frame.drop("hold_points", "position").collect()))
    assert rows(squads.transfer_board(squads.legal_transfers(picks, pool, state, picked=few))) == rows(squads.transfer_board(everything))
    one = {by: frontier.best_incoming(picks, pool, state, by=by, each="squad") for by in ("net_gain", "expected_points", "price")}
    best = squads.legal_transfers(picks, pool, state, picked=one["net_gain"])
    assert rows(squads.recommendation(picks, best, state)) == rows(squads.recommendation(picks, everything, state))
    incoming = pool.select(F.col("player_code").alias("in_code"), F.col("expected_points").alias("in_points"), F.col("price").alias("in_price"))
    some = squads.legal_transfers(picks, pool, state, picked=one["net_gain"].unionByName(one["expected_points"]).unionByName(one["price"]).distinct())
    assert rows(squads.policy_moves(some, incoming).where("policy <> 'random'")) == rows(squads.policy_moves(everything, incoming).where("policy <> 'random'"))

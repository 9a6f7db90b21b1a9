"""Squad rules, best elevens, single transfers, substitutions and fixtures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Quotas of a squad, bounds of an eleven, limits.
QUOTA = {"GKP": 2, "DEF": 5, "MID": 5, "FWD": 3}
ELEVEN = {"GKP": (1, 1), "DEF": (3, 5), "MID": (2, 5), "FWD": (1, 3)}
CLUB_CAP, BUDGET, SQUAD_SIZE = 3, 1000, 15


def legality(squads: DataFrame) -> DataFrame:
    """Issues of each squad (squad_id, player_code, position, team_id, price): size, duplicates, quotas, clubs, budget."""
    clubs = squads.groupBy("squad_id", "team_id").count().groupBy("squad_id").agg(F.max("count").alias("most"))
    quotas = [F.when(F.count_if(F.col("position") == p) != n, f"quota:{p}") for p, n in QUOTA.items()]
    issues = F.array_compact(F.array(F.when(F.count(F.lit(1)) != SQUAD_SIZE, "size"), F.when(F.count_distinct("player_code") != F.count(F.lit(1)), "duplicate"), *quotas, F.when(F.sum("price") > BUDGET, "budget")))
    out = squads.groupBy("squad_id").agg(issues.alias("issues")).join(clubs, "squad_id")
    return out.select("squad_id", F.when(F.col("most") > CLUB_CAP, F.concat("issues", F.array(F.lit("club")))).otherwise(F.col("issues")).alias("issues"))


def formations(spark: SparkSession) -> DataFrame:
    """All legal shapes of an eleven."""
    rows = [(d, m, f) for d in range(ELEVEN["DEF"][0], ELEVEN["DEF"][1] + 1) for m in range(ELEVEN["MID"][0], ELEVEN["MID"][1] + 1) for f in range(ELEVEN["FWD"][0], ELEVEN["FWD"][1] + 1) if 1 + d + m + f == 11]
    return spark.createDataFrame(rows, "n_def int, n_mid int, n_fwd int")


def best_eleven(squads: DataFrame, points: str = "expected_points") -> DataFrame:
    """Best shape and total of each squad, the best player counted twice.

    A player's value adds to every shape that has room for its place in its position; shapes are a dozen
    rows, and a squad is fifteen.
    """
    w = Window.partitionBy("squad_id", "position").orderBy(F.desc(points), "player_code")
    ranked = squads.withColumn("place", F.row_number().over(w))
    shapes = F.broadcast(formations(squads.sparkSession))
    room = F.when(F.col("position") == "GKP", 1).when(F.col("position") == "DEF", F.col("n_def")).when(F.col("position") == "MID", F.col("n_mid")).otherwise(F.col("n_fwd"))
    inside = ranked.join(shapes, F.col("place") <= room)
    totals = inside.groupBy("squad_id", "n_def", "n_mid", "n_fwd").agg(F.count(F.lit(1)).alias("n"), (F.sum(points) + F.max(points)).alias("total"), F.max_by("player_code", F.struct(F.col(points), -F.col("player_code"))).alias("captain")).where("n = 11")
    best = F.max_by(F.struct("n_def", "n_mid", "n_fwd", "total", "captain"), F.struct("total", "n_def", "n_mid", "n_fwd")).alias("b")
    return totals.groupBy("squad_id").agg(best).select("squad_id", "b.*")


# How much of both spreads a move costs, the points of a hit, the least gain worth a move, moves on a board.
RISK_WEIGHT, HIT_COST, LEAST_GAIN, BOARD_SIZE = 0.25, 4, 0.15, 8


def position_lists(squads: DataFrame, points: str = "expected_points") -> DataFrame:
    """One row a squad with its points by position, best first (at most a squad's players)."""
    return squads.groupBy("squad_id").agg(*(F.sort_array(F.collect_list(F.when(F.col("position") == p, F.col(points).cast("double"))), asc=False).alias(f"_{p}") for p in QUOTA))


def eleven_points(lists: dict[str, Column]) -> Column:
    """Points of the best legal eleven with its best player counted twice; null if there is none."""
    shapes = [(1, d, m, 10 - d - m) for d in range(ELEVEN["DEF"][0], ELEVEN["DEF"][1] + 1) for m in range(ELEVEN["MID"][0], ELEVEN["MID"][1] + 1) if ELEVEN["FWD"][0] <= 10 - d - m <= ELEVEN["FWD"][1]]
    total = lambda c, n: F.when(F.size(c) >= n, F.aggregate(F.slice(c, 1, n), F.lit(0.0), lambda s, x: s + x))
    sums = {(p, n): total(lists[p], n) for p, (low, high) in ELEVEN.items() for n in range(low, high + 1)}
    best = F.greatest(*(sums["GKP", g] + sums["DEF", d] + sums["MID", m] + sums["FWD", f] for g, d, m, f in shapes))
    # Every shape fields each position's best, so the captain is the best of them whatever the shape.
    return best + F.greatest(*(F.try_element_at(c, F.lit(1)) for c in lists.values()))


def swapped(points: Column, out: Column, incoming: Column) -> Column:
    """A list of points, best first, with one for another."""
    at = F.array_position(points, out).cast("int")
    rest = F.concat(F.slice(points, F.lit(1), at - 1), F.slice(points, at + 1, F.size(points)))
    return F.sort_array(F.concat(rest, F.array(incoming)), asc=False)


def known_worth(points: str, sd: str) -> Column:
    """Whether a candidate's points and spread are numbers."""
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return number(points) & number(sd)


def legal_transfers(squads: DataFrame, candidates: DataFrame, state: DataFrame, spread: int = 16, picked: DataFrame | None = None) -> DataFrame:
    """Every legal single transfer with its gains.

    squads: squad_id, player_code, position, team_id, selling_price, expected_points, sd and optionally sellable.
    candidates: player_code, position, team_id, price, expected_points, sd. state: squad_id, bank, free_transfers.
    A move keeps the position, costs at most the selling price and the bank, keeps the club cap and brings
    nobody who is owned. Its gross gain is what the best eleven scores after it less what it scores before:
    only the moved position's list changes. Net gain takes off the hit (none while a transfer is free) and
    RISK_WEIGHT of both spreads. Positions are few, so both sides of the join are dealt to ``spread`` parts each.
    With ``picked`` (squad_id, out_code, in_code) only these moves are met, and those to candidates without points or sd.
    """
    owned = squads.select("squad_id", F.col("player_code").alias("out_code"), "position", F.col("team_id").alias("out_team"), F.col("selling_price"), F.col("expected_points").cast("double").alias("out_points"), F.col("sd").alias("out_sd"), *(["sellable"] if "sellable" in squads.columns else []))
    owned = owned.where("sellable").drop("sellable") if "sellable" in squads.columns else owned
    lists = position_lists(squads)
    before = lists.join(state, "squad_id").withColumn("hold_points", eleven_points({p: F.col(f"_{p}") for p in QUOTA}))
    left = owned.join(before, "squad_id").withColumn("_part", F.pmod(F.xxhash64("squad_id", "out_code"), F.lit(spread)).cast("int"))
    pool = candidates.select(F.col("player_code").alias("in_code"), "position", F.col("team_id").alias("in_team"), F.col("price").alias("in_price"), F.col("expected_points").cast("double").alias("in_points"), F.col("sd").alias("in_sd"))
    dealt = pool if picked is None else pool.where(~known_worth("in_points", "in_sd"))
    meet = lambda: left.join(dealt.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))), ["position", "_part"])
    if picked is None:
        pairs = meet()
    else:
        pairs = left.join(picked, ["squad_id", "out_code"]).join(pool.where(known_worth("in_points", "in_sd")), ["position", "in_code"])
        # Every pick would be shuffled for candidates whose worth isn't known; mostly there are none.
        pairs = pairs if dealt.isEmpty() else pairs.unionByName(meet())
    pairs = pairs.where(F.col("in_price") <= F.col("selling_price") + F.col("bank"))
    pairs = pairs.join(squads.select("squad_id", F.col("player_code").alias("in_code")), ["squad_id", "in_code"], "left_anti")
    clubs = squads.groupBy("squad_id", F.col("team_id").alias("in_team")).agg(F.count(F.lit(1)).alias("_held"))
    pairs = pairs.join(clubs, ["squad_id", "in_team"], "left").where(F.coalesce("_held", F.lit(0)) - F.when(F.col("out_team") == F.col("in_team"), 1).otherwise(0) < CLUB_CAP)
    # Lists after the move are columns of their own, so that they are made once and not for each shape that reads them.
    pairs = pairs.withColumns({f"_after_{p}": F.when(F.col("position") == p, swapped(F.col(f"_{p}"), F.col("out_points"), F.col("in_points"))).otherwise(F.col(f"_{p}")) for p in QUOTA})
    after = eleven_points({p: F.col(f"_after_{p}") for p in QUOTA})
    # Nine places, so that moves of one worth tie whatever the order their points were added in.
    moves = pairs.withColumn("gross_gain", F.round(after - F.col("hold_points"), 9)).withColumn("hit_cost", F.when(F.col("free_transfers") >= 1, 0).otherwise(HIT_COST)).withColumn("risk_penalty", RISK_WEIGHT * (F.col("in_sd") + F.col("out_sd")))
    return moves.withColumn("net_gain", F.round(F.col("gross_gain") - F.col("hit_cost") - F.col("risk_penalty"), 9)).select("squad_id", "out_code", "in_code", "position", "gross_gain", "hit_cost", "risk_penalty", "net_gain", (F.col("selling_price") - F.col("in_price")).alias("bank_after"), "hold_points")


def transfer_board(moves: DataFrame, size: int = BOARD_SIZE) -> DataFrame:
    """The ``size`` best moves of each squad: by net gain, then incoming and outgoing player."""
    order = Window.partitionBy("squad_id").orderBy(F.desc("net_gain"), "in_code", "out_code")
    return moves.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size)


def best_moves(moves: DataFrame, by: Sequence[str]) -> DataFrame:
    """The best move of each ``by`` and how many were legal."""
    best = F.min_by(F.struct("out_code", "in_code", "gross_gain", "hit_cost", "risk_penalty", "net_gain", "bank_after"), F.struct(-F.col("net_gain"), "in_code", "out_code")).alias("_m")
    return moves.groupBy(*by).agg(best, F.count(F.lit(1)).alias("legal_replacements")).select(*by, *(F.col(f"_m.{c}") for c in ("out_code", "in_code", "gross_gain", "hit_cost", "risk_penalty", "net_gain", "bank_after") if c not in by), "legal_replacements")


def shortfall(squads: DataFrame, candidates: DataFrame, state: DataFrame, spread: int = 16) -> DataFrame:
    """squad_id, out_code and the money that the cheapest better player who isn't owned costs beyond the budget.

    Null where one can be afforded (money isn't what stops) or there is none.
    """
    owned = squads.groupBy("squad_id").agg(F.collect_set("player_code").alias("_owned"))
    picks = squads.join(state, "squad_id").join(owned, "squad_id").select("squad_id", F.col("player_code").alias("out_code"), "position", "_owned", F.col("expected_points").alias("_points"), (F.col("selling_price") + F.col("bank")).alias("_budget"), F.pmod(F.xxhash64("squad_id", "player_code"), F.lit(spread)).cast("int").alias("_part"))
    pool = candidates.select(F.col("player_code").alias("in_code"), "position", F.col("price").alias("_price"), F.col("expected_points").alias("_better"), F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("_part"))
    met = picks.join(pool, ["position", "_part"]).where(F.col("_better") > F.col("_points")).where(~F.coalesce(F.array_contains("_owned", F.col("in_code")), F.lit(False)))
    return met.groupBy("squad_id", "out_code").agg((F.min("_price") - F.max("_budget")).alias("_short")).select("squad_id", "out_code", F.when(F.col("_short") > 0, F.col("_short")).alias("shortfall"))


def every_pick(squads: DataFrame, moves: DataFrame, candidates: DataFrame, state: DataFrame, least: float = LEAST_GAIN, counts: DataFrame | None = None, short: DataFrame | None = None) -> DataFrame:
    """One row a pick: its best move if that is worth it, and else why there is none: held, no legal move, or too little gain.

    Where ``moves`` are those of a frontier only, ``counts`` (squad_id, out_code, legal_replacements) says how many were legal.
    ``short`` is the shortfall where it is known already.
    """
    best = best_moves(moves, ["squad_id", "out_code"])
    best = best if counts is None else best.drop("legal_replacements").join(counts, ["squad_id", "out_code"], "full")
    held = ~F.col("sellable") if "sellable" in squads.columns else F.lit(False)
    rows = squads.withColumn("_held", held).select("squad_id", F.col("player_code").alias("out_code"), "position", "_held").join(best, ["squad_id", "out_code"], "left").join(shortfall(squads, candidates, state) if short is None else short, ["squad_id", "out_code"], "left")
    worth = F.col("net_gain") >= least
    outcome = F.when(F.col("_held"), "held").when(worth, "move").when(F.col("in_code").isNull(), "none legal").otherwise("too little")
    return rows.select("squad_id", "out_code", "position", outcome.alias("outcome"), F.when(worth, F.col("in_code")).alias("in_code"), F.col("net_gain").alias("best_gain"), F.coalesce("legal_replacements", F.lit(0)).alias("legal_replacements"), F.when(outcome.isin("none legal", "too little"), F.col("shortfall")).alias("shortfall"))


def recommendation(squads: DataFrame, moves: DataFrame, state: DataFrame, least: float = LEAST_GAIN) -> DataFrame:
    """Each squad's best move, or to hold, with the points of holding and of the choice."""
    hold = position_lists(squads).select("squad_id", eleven_points({p: F.col(f"_{p}") for p in QUOTA}).alias("hold_points"))
    rows = hold.join(state, "squad_id").join(best_moves(moves, ["squad_id"]), "squad_id", "left")
    worth = F.coalesce(F.col("net_gain") >= least, F.lit(False))
    gain = F.when(worth, F.col("gross_gain") - F.col("hit_cost")).otherwise(0.0)
    return rows.select("squad_id", F.when(worth, "transfer").otherwise("hold").alias("action"), F.when(worth, F.col("out_code")).alias("out_code"), F.when(worth, F.col("in_code")).alias("in_code"), "hold_points", (F.col("hold_points") + gain).alias("expected_points"), F.when(worth, F.col("risk_penalty")).otherwise(0.0).alias("risk_score"), (F.col("bank") + F.when(worth, F.col("bank_after")).otherwise(0)).alias("bank"))


def policy_moves(moves: DataFrame, incoming: DataFrame, seed: int = 20260727, least: float = LEAST_GAIN) -> DataFrame:
    """Each squad's move under five policies; a policy without a move gives no row for that squad (so ``hold`` gives none).

    model: best net gain, if worth it. random: any legal move, by hash. highest_form: the highest points coming
    in. most_expensive: the dearest coming in. incoming: in_code, in_points, in_price.
    """
    rows = moves.join(incoming, "in_code")
    move = F.struct("out_code", "in_code", "net_gain")
    by = {"model": F.struct(-F.col("net_gain"), "in_code", "out_code"), "random": F.struct(F.xxhash64(F.lit(seed), "squad_id", "out_code", "in_code")), "highest_form": F.struct(-F.col("in_points"), -F.col("net_gain"), "in_code", "out_code"), "most_expensive": F.struct(-F.col("in_price"), -F.col("net_gain"), "in_code", "out_code")}
    each = rows.groupBy("squad_id").agg(*(F.min_by(move, order).alias(name) for name, order in by.items()))
    picks = F.array(*(F.struct(F.lit(name).alias("policy"), F.col(name).alias("m")) for name in by))
    out = each.select("squad_id", F.explode(picks).alias("p")).select("squad_id", "p.policy", "p.m.*")
    return out.where((F.col("policy") != "model") | (F.col("net_gain") >= least))


def sellable(squads: DataFrame, constraints: DataFrame) -> DataFrame:
    """Squads with ``sellable``: neither the player nor its position is locked."""
    has = lambda c, x: F.coalesce(F.array_contains(F.col(c), F.col(x)), F.lit(False))
    return squads.join(constraints, "squad_id", "left").withColumn("sellable", ~(has("locked_players", "player_code") | has("locked_positions", "position"))).select(*squads.columns, "sellable")


def constrained(squads: DataFrame, candidates: DataFrame, constraints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Squads with ``sellable``, and (squad_id, player_code) of the candidates that each may not buy: owned, excluded, or of an excluded club.

    constraints: squad_id and arrays locked_players, locked_positions, excluded_players, excluded_teams (null: none).
    What is forbidden is few beside what isn't, so bans are listed and moves are anti-joined with them.
    """
    empty = lambda c: F.coalesce(c, F.array())
    known = candidates.select("player_code", "team_id").distinct()
    named = squads.join(constraints.select("squad_id"), "squad_id").select("squad_id", "player_code").unionByName(constraints.select("squad_id", F.explode(empty(F.col("excluded_players"))).alias("player_code")))
    clubs = constraints.select("squad_id", F.explode(empty(F.col("excluded_teams"))).alias("team_id"))
    bans = named.join(known.select("player_code"), "player_code", "left_semi").select("squad_id", "player_code").unionByName(clubs.join(known, "team_id").select("squad_id", "player_code"))
    return sellable(squads, constraints), bans.distinct()


def buyable_counts(squads: DataFrame, candidates: DataFrame, constraints: DataFrame) -> DataFrame:
    """squad_id and ``buyable``: how many candidates ``constrained`` leaves, by clubs' sizes, without meeting those of an excluded club."""
    sizes = candidates.groupBy("player_code", "team_id").agg(F.count(F.lit(1)).alias("_n"))
    clubs = constraints.select("squad_id", F.explode("excluded_teams").alias("team_id")).distinct()
    by_club = clubs.join(sizes.groupBy("team_id").agg(F.sum("_n").alias("_n")), "team_id").select("squad_id", "_n")
    owned = squads.join(constraints.select("squad_id"), "squad_id", "left_semi").select("squad_id", "player_code")
    named = owned.unionByName(constraints.select("squad_id", F.explode("excluded_players").alias("player_code"))).distinct()
    by_name = named.join(sizes, "player_code").join(clubs, ["squad_id", "team_id"], "left_anti").select("squad_id", "_n")
    banned = by_club.unionByName(by_name).groupBy("squad_id").agg(F.sum("_n").alias("_banned"))
    counts = squads.select("squad_id").distinct().join(banned, "squad_id", "left").crossJoin(F.broadcast(candidates.agg(F.count(F.lit(1)).alias("_all"))))
    return counts.select("squad_id", (F.col("_all") - F.coalesce("_banned", F.lit(0))).alias("buyable"))


def opportunity_cost(locked: DataFrame, candidates: DataFrame, value: str = "value") -> DataFrame:
    """What holding each locked pick gives up: the best affordable alternative of its position and the value forgone.

    locked: squad_id, player_code, position, budget and ``value``; candidates: player_code, position, price and ``value``.
    A pick's alternative is one of the two best players that its budget buys, as one may be itself. These are found for each
    price, then for each budget; budgets are whole tenths, so there are few.
    """
    pool = candidates.select("position", F.col("price").alias("_price"), F.col("player_code").alias("_alt"), F.col(value).alias("_value")).where("_price IS NOT NULL AND _alt IS NOT NULL AND _value IS NOT NULL")

    def two_best(rows: DataFrame, *by: str) -> DataFrame:
        each = rows.groupBy(*by, "_alt").agg(F.max("_value").alias("_value"))
        return each.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_value"), "_alt"))).where("_n <= 2").drop("_n")

    levels = two_best(pool, "position", "_price")
    asked = locked.select("position", "budget").distinct()
    best = two_best(asked.join(levels, "position").where(F.col("_price") <= F.col("budget")), "position", "budget")
    best = best.groupBy("position", "budget").agg(F.sort_array(F.collect_list(F.struct(F.col("_value"), (-F.col("_alt")).alias("_order"), F.col("_alt"))), asc=False).alias("_two"))
    rows = locked.join(best, ["position", "budget"], "left")
    found = F.try_element_at(F.filter("_two", lambda x: (x["_alt"] != F.col("player_code")) & (x["_value"] > F.col(value))), F.lit(1))
    return rows.select("squad_id", "player_code", found["_alt"].alias("alternative"), F.round(F.coalesce(found["_value"] - F.col(value), F.lit(0.0)), 6).alias("forgone"))


def fixture_sides(fixtures: DataFrame) -> DataFrame:
    """Each fixture once for each side."""
    side = lambda team, other, home, difficulty: F.struct(F.col(team).alias("team_id"), F.col(other).alias("opponent_team_id"), F.lit(home).alias("was_home"), F.col(difficulty).alias("difficulty"))
    both = F.array(side("home_team_id", "away_team_id", True, "home_difficulty"), side("away_team_id", "home_team_id", False, "away_difficulty"))
    return fixtures.select("season", "gameweek_id", "fixture_id", "kickoff_time", F.explode(both).alias("s")).select("season", "gameweek_id", "fixture_id", "kickoff_time", "s.*")


def build_entities(players: DataFrame, fixtures: DataFrame, cutoff) -> DataFrame:
    """Rows to predict: a player for each match of its team (none keeps a row), with index and number of matches."""
    rows = players.join(fixture_sides(fixtures), ["season", "team_id"], "left").withColumn("prediction_timestamp", cutoff)
    w = Window.partitionBy("player_code", "gameweek_id")
    return rows.withColumn("fixture_index", F.row_number().over(w.orderBy("kickoff_time", "fixture_id")) - 1).withColumn("fixture_count", F.count("fixture_id").over(w))


def entity_weeks(players: DataFrame, fixtures: DataFrame) -> DataFrame:
    """player_code, gameweek_id, last_index and fixture_count: what ``build_entities`` comes to by week, out of its teams' matches.

    A team's week is counted once for all its players, so that no player meets each match.
    """
    weeks = fixture_sides(fixtures).groupBy("season", "team_id", "gameweek_id").agg(F.count(F.lit(1)).alias("_rows"), F.count("fixture_id").alias("_n"))
    rows = players.join(weeks, ["season", "team_id"], "left").groupBy("player_code", "gameweek_id")
    return rows.agg((F.sum(F.coalesce("_rows", F.lit(1))) - 1).cast("int").alias("last_index"), F.sum(F.coalesce("_n", F.lit(0))).alias("fixture_count"))


def fixture_run(sides: DataFrame, first: int, weeks: int = 5) -> DataFrame:
    """The coming weeks of each team: matches, blanks, doubles and mean difficulty."""
    grid = sides.select("team_id").distinct().withColumn("gameweek_id", F.explode(F.sequence(F.lit(first), F.lit(first + weeks - 1))))
    each = sides.groupBy("team_id", "gameweek_id").agg(F.count(F.lit(1)).alias("n"), F.sum("difficulty").alias("d"))
    joined = grid.join(each, ["team_id", "gameweek_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.groupBy("team_id").agg(F.sum("n").alias("matches"), F.count_if(F.col("n") == 0).alias("blanks"), F.count_if(F.col("n") > 1).alias("doubles"), F.try_divide(F.sum("d"), F.sum("n")).alias("mean_difficulty"))


def autosubs(picks: DataFrame, keys: Sequence[str] = ("squad_id", "gameweek_id")) -> DataFrame:
    """``multiplier`` of every pick after automatic substitutions: 0 on the bench, 1 in the field, 2 for who leads it.

    ``picks`` have place (1 to 15), position, minutes, is_captain, is_vice. Absent starters, by place, are
    replaced by the first of the bench who played, isn't in yet and keeps the shape legal; captaincy moves
    to the vice. Each starter's choice hangs on those before, so a squad's week (fifteen picks) is one
    array that is folded in order.
    """
    rest = [c for c in picks.columns if c not in keys]
    squad = picks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", *(c for c in rest if c != "place")))).alias("_p"))
    bench = F.filter("_p", lambda p: p["place"] > 11)
    absent = F.filter("_p", lambda p: (p["place"] <= 11) & (p["minutes"] == 0))
    fielded = lambda pos: F.size(F.filter("_p", lambda p: (p["place"] <= 11) & (p["position"] == pos)))
    start = F.struct(*(fielded(pos).alias(pos) for pos in ELEVEN), F.array().cast("array<int>").alias("on"), F.array().cast("array<int>").alias("off"))

    def moved(s: Column, pos: str, out: Column, sub: Column) -> Column:
        return s[pos] - F.when(out["position"] == pos, 1).otherwise(0) + F.when(sub["position"] == pos, 1).otherwise(0)

    def step(s: Column, out: Column) -> Column:
        def fits(sub: Column) -> Column:
            ok = (sub["minutes"] > 0) & ~F.array_contains(s["on"], sub["place"])
            for pos, (low, high) in ELEVEN.items():
                ok = ok & moved(s, pos, out, sub).between(low, high)
            return ok

        sub = F.try_element_at(F.filter(bench, fits), F.lit(1))
        after = F.struct(*(moved(s, pos, out, sub).alias(pos) for pos in ELEVEN), F.concat(s["on"], F.array(sub["place"])).alias("on"), F.concat(s["off"], F.array(out["place"])).alias("off"))
        return F.when(sub.isNull(), s).otherwise(after)

    settled = squad.withColumn("_s", F.aggregate(absent, start, step))
    played = lambda p: ((p["place"] <= 11) & ~F.array_contains("_s.off", p["place"])) | F.array_contains("_s.on", p["place"])
    leads = lambda mark: F.try_element_at(F.filter("_p", lambda p: played(p) & p[mark] & (p["minutes"] > 0)), F.lit(1))["place"]
    each = settled.withColumn("_lead", F.coalesce(leads("is_captain"), leads("is_vice"))).select(*keys, "_s", "_lead", F.explode("_p").alias("_one"))
    multiplier = F.when(played(F.col("_one")), F.when(F.col("_one.place") == F.col("_lead"), 2).otherwise(1)).otherwise(0).cast("int")
    return each.select(*keys, *(F.col(f"_one.{c}").alias(c) for c in rest), multiplier.alias("multiplier")).select(*picks.columns, "multiplier")


# Points of a plain appearance, appearances on each side of a venue split, the least gap worth telling.
PLAIN_POINTS, VENUE_SAMPLE, VENUE_GAP = 2.0, 3, 1.0


def history_notes(stats: DataFrame, coming: DataFrame) -> DataFrame:
    """A player's record against the coming opponent, in the same gameweek of other seasons, and at the coming venue.

    coming: player_code, opponent_team_id, was_home, gameweek_id, prediction_timestamp. One row a note that
    there is enough to say for (kind, appearances, goals, assists, returning, points_mean, other_mean,
    strength), the most notable first by ``place``. Only matches played and known before the time count.
    A gameweek without any return never speaks for a player.
    """
    ahead = coming.select("player_code", "prediction_timestamp", F.col("opponent_team_id").alias("_opponent"), F.col("was_home").alias("_home"), F.col("gameweek_id").alias("_week"))
    met = ahead.join(stats, "player_code").where((F.col("available_time") < F.col("prediction_timestamp")) & (F.col("minutes") > 0))
    sides = {"opponent": F.col("opponent_team_id") == F.col("_opponent"), "gameweek": F.col("gameweek_id") == F.col("_week"), "venue": F.col("was_home") == F.col("_home")}
    back = (F.col("goals_scored") > 0) | (F.col("assists") > 0)
    sums = []
    for kind, here in sides.items():
        sums += [F.count_if(here).alias(f"{kind}_n"), F.coalesce(F.sum(F.when(here, F.col("goals_scored"))), F.lit(0)).alias(f"{kind}_g"), F.coalesce(F.sum(F.when(here, F.col("assists"))), F.lit(0)).alias(f"{kind}_a"), F.count_if(here & back).alias(f"{kind}_r"), F.avg(F.when(here, F.col("total_points"))).alias(f"{kind}_p")]
    elsewhere = F.col("was_home") != F.col("_home")
    each = met.groupBy("player_code", "prediction_timestamp").agg(*sums, F.count_if(elsewhere).alias("_away_n"), F.avg(F.when(elsewhere, F.col("total_points"))).alias("_away_p"))
    weak = F.col("gameweek_p") - PLAIN_POINTS
    strength = {"opponent": F.col("opponent_p") - PLAIN_POINTS, "gameweek": F.when(F.col("gameweek_r") == 0, -F.greatest(F.abs(weak), F.lit(1.0))).otherwise(weak), "venue": F.col("venue_p") - F.col("_away_p")}
    enough = {"opponent": F.col("opponent_n") >= 1, "gameweek": F.col("gameweek_n") >= 2, "venue": (F.col("venue_n") >= VENUE_SAMPLE) & (F.col("_away_n") >= VENUE_SAMPLE) & (F.abs(strength["venue"]) >= VENUE_GAP)}
    other = {"venue": F.col("_away_p")}
    note = lambda k: F.struct(F.lit(k).alias("kind"), F.col(f"{k}_n").alias("appearances"), F.col(f"{k}_g").alias("goals"), F.col(f"{k}_a").alias("assists"), F.col(f"{k}_r").alias("returning"), F.col(f"{k}_p").alias("points_mean"), other.get(k, F.lit(None).cast("double")).alias("other_mean"), strength[k].alias("strength"))
    notes = each.select("player_code", "prediction_timestamp", F.explode(F.array_compact(F.array(*(F.when(enough[k], note(k)) for k in sides)))).alias("n")).select("player_code", "prediction_timestamp", "n.*")
    order = Window.partitionBy("player_code", "prediction_timestamp").orderBy(F.desc(F.abs("strength")), F.desc("kind"))
    return notes.withColumn("place", F.row_number().over(order))


def note_text(opponent: Column) -> Column:
    """One sentence for a row of ``history_notes``."""
    games = F.concat(F.col("appearances").cast("string"), F.when(F.col("appearances") == 1, " appearance").otherwise(" appearances"))
    record = F.concat(F.col("goals").cast("string"), F.lit(" goals and "), F.col("assists").cast("string"), F.lit(" assists in "), games, F.lit(", "), F.format_number("points_mean", 1), F.lit(" points a match"))
    venue = F.concat(F.when(F.col("strength") > 0, "Better").otherwise("Worse"), F.lit(" at this venue: "), F.format_number("points_mean", 1), F.lit(" points a match against "), F.format_number("other_mean", 1))
    return F.when(F.col("kind") == "opponent", F.concat(F.lit("Against "), opponent, F.lit(": "), record)).when(F.col("kind") == "gameweek", F.concat(F.lit("In this gameweek of earlier seasons: "), record)).otherwise(venue)

"""Legal squads filled in an order: random ones, one for each row of a table of draws, and those of one ranking.

A fill is a fold over candidates: its state is who was taken and the money spent. A candidate is taken if its position has a
slot, its club has room, and the money left still pays for the other slots at what the cheapest players of their
positions cost. Each position's players are numbered once, and a draw walks a position's numbers in an order of its
own (a start and a step by hash), ``CHUNK`` of them a round, so a draw meets a few hundred players and never the
market. A draw that is still short after ``ROUNDS`` is repaired: it keeps as many of its picks, in order, as a fill from the
cheapest can complete. Only where the cheapest players themselves make no legal squad does it stay short, and says which positions are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.operators.ranks import places
from chronofold.operators.squads import BUDGET, CLUB_CAP, QUOTA, SQUAD_SIZE
from chronofold.sources.scratch import written

#: Numbers of a position that a draw walks in a round, and rounds.
CHUNK, ROUNDS = 48, 4
#: The cheapest players of a position that a repair chooses from.
CHEAPEST = 48
#: Positions in the order in which they are filled: most slots first.
ORDER = sorted(QUOTA, key=lambda p: -QUOTA[p])
_PICK = "struct<position:string,team_id:long,price:long,player_code:long>"
_STATE = f"struct<spent:long,picks:array<{_PICK}>>"


class Market:
    """What a fill must know of all players: their number and cheapest prices by position, and the cheapest of them."""

    def __init__(self, players: DataFrame, cap: int = CLUB_CAP, budget: int = BUDGET) -> None:
        self.cap, self.budget = cap, budget
        known = players.where(F.col("price").isNotNull() & F.col("team_id").isNotNull() & F.col("player_code").isNotNull() & F.col("position").isin(*QUOTA))
        self.players = written(known.select("position", F.col("team_id").cast("long").alias("team_id"), F.col("price").cast("long").alias("price"), F.col("player_code").cast("long").alias("player_code")).distinct())
        self.numbers = {r.position: r.n for r in self.players.groupBy("position").agg(F.count(F.lit(1)).alias("n")).collect()}  # four rows
        # The cheapest of a position, of one club no more than may be taken: a fill from them is short only if the market is.
        club = F.row_number().over(Window.partitionBy("position", "team_id").orderBy("price", "player_code"))
        place = F.row_number().over(Window.partitionBy("position").orderBy("price", "player_code"))
        few = self.players.withColumn("_c", club).where(F.col("_c") <= cap).withColumn("_p", place).where(F.col("_p") <= CHEAPEST)
        rows = few.select("position", "team_id", "price", "player_code").collect()  # 4 x CHEAPEST rows
        self.cheapest = sorted((tuple(r) for r in rows), key=lambda r: (ORDER.index(r[0]), r[2], r[3]))
        prices = {p: sorted(r[2] for r in self.cheapest if r[0] == p) for p in ORDER}
        #: Position -> what 0, 1, .. slots of it cost at least.
        self.least = {p: [sum(prices[p][:k]) + (10**9 if k > len(prices[p]) else 0) for k in range(n + 1)] for p, n in QUOTA.items()}

    def reserve(self, held: dict[str, Column]) -> Column:
        """What the slots that are open beside ``held`` players of each position cost at least."""
        total = F.lit(0).cast("long")
        for p, n in QUOTA.items():
            costs = F.array(*(F.lit(c).cast("long") for c in self.least[p]))
            total = total + F.element_at(costs, (F.greatest(F.lit(0), n - held[p]) + 1).cast("int"))
        return total

    def take(self, state: Column, c: Column) -> Column:
        """The state after a candidate came by."""
        picks = state["picks"]
        held = {p: F.size(F.filter(picks, _at(p))) for p in QUOTA}
        after = {p: held[p] + F.when(c["position"] == p, 1).otherwise(0) for p in QUOTA}
        room = F.lit(False)
        for p, n in QUOTA.items():
            room = room | ((c["position"] == p) & (held[p] < n))
        club = F.size(F.filter(picks, lambda x: x["team_id"] == c["team_id"])) < self.cap
        new = ~F.exists(picks, lambda x: x["player_code"] == c["player_code"])
        money = state["spent"] + c["price"] + self.reserve(after) <= self.budget
        taken = F.struct((state["spent"] + c["price"]).cast("long").alias("spent"), F.array_append(picks, c).alias("picks")).cast(_STATE)
        return F.when(room & club & new & money, taken).otherwise(state)

    def fold(self, candidates: Column, state: Column) -> Column:
        return F.aggregate(candidates, state.cast(_STATE), self.take)

    def repaired(self, state: Column) -> Column:
        """The state that keeps most of the picks, in their order, and is completed from the cheapest; the state itself if none can be."""
        cheap = F.array(*(F.struct(F.lit(p).alias("position"), F.lit(t).cast("long").alias("team_id"), F.lit(c).cast("long").alias("price"), F.lit(k).cast("long").alias("player_code")) for p, t, c, k in self.cheapest))
        spent = lambda some: F.aggregate(some, F.lit(0).cast("long"), lambda s, x: s + x["price"])
        start = lambda n: F.struct(spent(F.slice(state["picks"], 1, n)).alias("spent"), F.slice(state["picks"], 1, n).alias("picks"))
        tries = F.transform(F.sequence(F.size(state["picks"]), F.lit(0)), lambda n: self.fold(cheap, start(n)))
        whole = F.filter(tries, lambda s: F.size(s["picks"]) == SQUAD_SIZE)
        return F.when(F.size(whole) > 0, F.element_at(whole, 1)).otherwise(state)


def _at(position: str):
    return lambda x: x["position"] == position


def _empty() -> Column:
    return F.struct(F.lit(0).cast("long").alias("spent"), F.array().cast(f"array<{_PICK}>").alias("picks")).cast(_STATE)


def _filled(draws: DataFrame, names: Sequence[str], market: Market) -> DataFrame:
    """Draw columns, spent, picks and ``short``, the positions with open slots."""
    missing = F.array_compact(F.array(*(F.when(F.size(F.filter("state.picks", _at(p))) < n, F.lit(p)) for p, n in QUOTA.items())))
    return draws.select(*names, "state.spent", "state.picks", missing.alias("short"))


def fill_random(players: DataFrame, draws: DataFrame, seed: int = 20260727, cap: int = CLUB_CAP, budget: int = BUDGET) -> DataFrame:
    """One fill a row of ``draws``: its columns, spent, picks (position, team_id, price, player_code) and short."""
    market, names = Market(players, cap, budget), list(draws.columns)
    state = written(draws.dropDuplicates().withColumn("state", _empty()))
    if len(market.numbers) == len(QUOTA):
        placed = places(market.players.withColumn("_u", (F.xxhash64(F.lit(seed), "player_code") % 1_000_003).cast("double")), ["position"], "_u", ["player_code"], "_i").drop("_u")
        numbered = written(placed.withColumn("_i", F.col("_i") - 1))
        for turn in range(ROUNDS):
            if turn * CHUNK >= max(market.numbers.values()):
                break
            walks = []
            for p in ORDER:
                n = market.numbers[p]
                h = lambda k, p=p: F.pmod(F.xxhash64(F.lit(seed + k), F.lit(p), *names), F.lit(1 << 31))
                # A step prime to the number of players walks all of them before it comes back to one.
                steps = [s for s in _primes(2 * n + 64) if n % s][-64:] or [1]
                step = F.element_at(F.array(*map(F.lit, steps)), (F.pmod(h(1), F.lit(len(steps))) + 1).cast("int")).cast("long")
                ahead = F.sequence(F.lit(turn * CHUNK).cast("long"), F.lit(min(n, (turn + 1) * CHUNK) - 1).cast("long")) if turn * CHUNK < n else F.array().cast("array<long>")
                walks.append(_walk(ahead, p, n, h(2), step))
            open_now = state.where(F.size("state.picks") < SQUAD_SIZE)
            asked = open_now.select(*names, F.explode(F.flatten(F.array(*walks))).alias("w")).select(*names, "w.position", "w._i", "w.turn")
            met = asked.join(numbered, ["position", "_i"])
            order = F.element_at(F.create_map(*[F.lit(x) for k, p in enumerate(ORDER) for x in (p, k)]), F.col("position"))
            listed = met.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct(order.alias("_o"), "turn", "position", "team_id", "price", "player_code"))).alias("_c"))
            candidates = F.transform("_c", lambda x: F.struct(x["position"].alias("position"), x["team_id"].alias("team_id"), x["price"].alias("price"), x["player_code"].alias("player_code")))
            same = F.lit(True)
            for name in names:
                same = same & F.col(name).eqNullSafe(F.col(f"_r_{name}"))
            right = listed.select(*(F.col(n).alias(f"_r_{n}") for n in names), candidates.alias("_c"))
            state = written(state.join(right, same, "left").select(*names, F.when(F.col("_c").isNull(), F.col("state")).otherwise(market.fold(F.coalesce("_c", F.array().cast(f"array<{_PICK}>")), F.col("state"))).alias("state")))
        state = state.withColumn("state", F.when(F.size("state.picks") < SQUAD_SIZE, market.repaired(F.col("state"))).otherwise(F.col("state")))
    return _filled(state, names, market)


def _walk(ahead: Column, position: str, n: int, start: Column, step: Column) -> Column:
    return F.transform(ahead, lambda j: F.struct(F.lit(position).alias("position"), F.pmod(start + j * step, F.lit(n)).cast("long").alias("_i"), j.alias("turn")))


def _primes(most: int) -> list[int]:
    """Some primes up to ``most`` (the last few hundred candidates are tried)."""
    return [k for k in range(max(2, most - 2000), most + 1) if all(k % d for d in range(2, int(k**0.5) + 1))]


def fill_ranked(players: DataFrame, order: Column, cap: int = CLUB_CAP, budget: int = BUDGET) -> DataFrame:
    """The fill by falling ``order`` (ties by player_code), as one row: spent, picks and short.

    Whoever can't be afforded or whose club is full is left out before the next ``CHUNK`` are taken, so each round takes one player at least.
    """
    market = Market(players, cap, budget)
    ranked = players.select("position", F.col("team_id").cast("long").alias("team_id"), F.col("price").cast("long").alias("price"), F.col("player_code").cast("long").alias("player_code"), order.cast("double").alias("_order"))
    ranked = written(ranked.where(F.col("_order").isNotNull()).join(market.players.select("player_code").distinct(), "player_code", "left_semi"))
    picks: list[tuple] = []
    for p in ORDER:
        for _ in range(QUOTA[p]):
            held = {q: sum(x[0] == q for x in picks) for q in QUOTA}
            if held[p] == QUOTA[p] or not market.numbers.get(p):
                break
            spent = sum(x[2] for x in picks)
            rest = lambda: sum(market.least[q][QUOTA[q] - sum(x[0] == q for x in picks) - (q == p)] for q in QUOTA)
            full = [t for t in {x[1] for x in picks} if sum(x[1] == t for x in picks) >= cap]
            able = ranked.where((F.col("position") == p) & (F.col("price") <= budget - spent - rest()))
            able = able.where(~F.col("team_id").isin(full)) if full else able
            able = able.where(~F.col("player_code").isin([x[3] for x in picks])) if picks else able
            some = able.orderBy(F.desc("_order"), "player_code").limit(CHUNK).collect()
            if not some:
                break
            for r in some:
                one = (r.position, r.team_id, r.price, r.player_code)
                spent, have = sum(x[2] for x in picks), sum(x[0] == p for x in picks)
                if have < QUOTA[p] and sum(x[1] == one[1] for x in picks) < cap and spent + one[2] + rest() <= budget:
                    picks.append(one)
    spark = players.sparkSession
    state = spark.createDataFrame([((sum(x[2] for x in picks), picks),)], f"state {_STATE}")
    state = state.withColumn("state", F.when(F.size("state.picks") < SQUAD_SIZE, market.repaired(F.col("state"))).otherwise(F.col("state"))) if market.cheapest else state
    return _filled(state, [], market)


def squads_of(filled: DataFrame) -> DataFrame:
    """One row a pick of the squads that aren't short: their columns, player_code, position, team_id and price."""
    names = [c for c in filled.columns if c not in ("spent", "picks", "short")]
    whole = filled.where(F.size("short") == 0)
    return whole.select(*names, F.explode("picks").alias("p")).select(*names, "p.player_code", "p.position", "p.team_id", "p.price")

"""Change detection between snapshots, event ordering and registries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Thresholds of how loudly a change is reported, and orders of statuses.
MATERIAL_OWNERSHIP, MATERIAL_POINTS, CHANCE_STEP = 2.0, 4.5, 25
STATUS_ORDER = {"a": 3, "d": 2, "i": 1, "s": 1, "u": 0, "n": 0}
LOUDNESS = {"critical": 0, "material": 1, "minor": 2}


def _lookup(c: Column, table: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[c]


def availability_direction(before: Column, after: Column) -> Column:
    """1 for better, -1 for worse, 0 for as good."""
    return F.signum(_lookup(after, STATUS_ORDER) - _lookup(before, STATUS_ORDER)).cast("int")


def materiality(in_squad: Column, ownership: Column, points: Column) -> Column:
    """critical in the squad, material if owned or promising enough, else minor."""
    return F.when(in_squad, "critical").when(ownership >= MATERIAL_OWNERSHIP, "material").when(points >= MATERIAL_POINTS, "material").otherwise("minor")


def snapshot_diff(previous: DataFrame, current: DataFrame, key: str = "code") -> DataFrame:
    """Events between two snapshots: joined, departed, availability, chance, news and price.

    Columns besides the key: status, chance, news, price. One full join; each pair of rows yields its
    events as an array, and whole-row events exclude the others.
    """
    names = ["status", "chance", "news", "price"]
    a = previous.select(key, *(F.col(c).alias(f"_a_{c}") for c in names), F.lit(True).alias("_in_a"))
    b = current.select(key, *(F.col(c).alias(f"_b_{c}") for c in names), F.lit(True).alias("_in_b"))
    both = a.join(b, key, "full")
    was, now = (lambda c: F.col(f"_a_{c}")), (lambda c: F.col(f"_b_{c}"))
    text = lambda c: c.cast("string")
    event = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), text(x).alias("before"), text(y).alias("after"))
    nothing = F.lit(None).cast("string")
    stayed = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    chance_moved = F.abs(F.coalesce(now("chance"), F.lit(100)) - F.coalesce(was("chance"), F.lit(100))) >= CHANCE_STEP
    events = F.array_compact(
        F.array(
            F.when(F.col("_in_a").isNull(), event("joined", nothing, now("status"))),
            F.when(F.col("_in_b").isNull(), event("departed", was("status"), nothing)),
            F.when(stayed & ~was("status").eqNullSafe(now("status")), event("availability", was("status"), now("status"))),
            F.when(stayed & was("status").eqNullSafe(now("status")) & chance_moved, event("chance", was("chance"), now("chance"))),
            F.when(stayed & was("status").eqNullSafe(now("status")) & ~chance_moved & ~was("news").eqNullSafe(now("news")), event("news", was("news"), now("news"))),
            F.when(stayed & ~was("price").eqNullSafe(now("price")), event("price", was("price"), now("price"))),
        )
    )
    return both.select(key, F.explode(events).alias("e")).select(key, "e.*")


def loudest_first(events: DataFrame, key: str = "code") -> DataFrame:
    return events.orderBy(_lookup(F.col("materiality"), LOUDNESS), key, "kind")


def registry_upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows replace old ones of the same key; columns may be added."""
    from chronofold.sources.tables import upsert_keep_last

    return upsert_keep_last(existing, new, list(keys))


def latest_verdicts(evaluations: DataFrame, keys: Sequence[str] = ("feature", "objective"), when: str = "evaluated_at") -> DataFrame:
    """The last evaluation of each key; ties by all other columns."""
    rest = [c for c in evaluations.columns if c not in keys and c != when]
    newest = F.max(F.struct(when, *rest)).alias("_r")
    return evaluations.groupBy(*keys).agg(newest).select(*keys, "_r.*")


def live_signals(signals: DataFrame, at: Column, key: str = "player_code") -> DataFrame:
    """The last signal of each key that is out and hasn't expired."""
    rest = [c for c in signals.columns if c != key]
    live = signals.where((F.col("available_time") <= at) & (F.col("expires_time") > at))
    return live.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("available_time", "expires_time")).alias("_r")).select(key, "_r.*")


# Verdicts in the order they are reported, those that let a feature be used, the pool of all players.
VERDICT_ORDER = {"accepted": 0, "experimental": 1, "revise": 2, "insufficient": 3, "rejected": 4, "deprecated": 5}
USABLE, GLOBAL_POOL = ("accepted", "experimental"), "global"


def usable_features(evaluations: DataFrame, pool: str | None = None, keys: Sequence[str] = ("feature", "objective")) -> DataFrame:
    """The features that may be used, with ``measured_here``.

    Without a pool, those whose last verdict is usable. With one, those with a usable verdict of exactly
    that pool, and else of the global pool; another narrow pool's verdict is never carried over.
    """
    if pool is None:
        return latest_verdicts(evaluations, keys).where(F.col("verdict").isin(*USABLE)).select(*keys, F.lit(True).alias("measured_here"))
    found = evaluations.where(F.col("verdict").isin(*USABLE)).groupBy(*keys).agg(F.bool_or(F.col("pool") == pool).alias("_here"), F.bool_or(F.col("pool") == GLOBAL_POOL).alias("_global"))
    return found.where("_here OR _global").select(*keys, F.col("_here").alias("measured_here"))


def acceptance_report(evaluations: DataFrame, names: DataFrame, objective: str) -> DataFrame:
    """Every feature's last verdict under an objective: in the order of verdicts, then best utility first."""
    last = latest_verdicts(evaluations.where(F.col("objective") == objective))
    order = F.coalesce(_lookup(F.col("verdict"), VERDICT_ORDER), F.lit(9))
    return names.join(last, "feature").withColumn("place", F.row_number().over(Window.orderBy(order, F.desc("utility"), "feature")))


def registry_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """Number of rows of each table."""
    parts = [t.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows") for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def news_shortlist(players: DataFrame, most: int, skip_flagged: bool = True) -> DataFrame:
    """Whose news could change a choice: own players first, then by ownership and points (in_squad, status, ownership, expected_points)."""
    rows = players.where(F.coalesce("status", F.lit("a")) == "a") if skip_flagged else players
    return rows.orderBy(F.desc("in_squad"), F.desc(F.coalesce("ownership", F.lit(0.0))), F.desc(F.coalesce("expected_points", F.lit(0.0))), "player_code").limit(most)


# The least projection worth asking about, and what an owned player's counts for.
RELEVANT_POINTS, OWNED_WEIGHT = 1.5, 2.0


def refresh_plan(players: DataFrame, budget: int, *, affordable: int | None = None, least: float = RELEVANT_POINTS, stale_within: str = "INTERVAL 3 DAYS", at: Column | None = None) -> DataFrame:
    """The teams to look up: weights summed over players that matter and aren't covered, the first ``budget``.

    players: player_code, team_id, expected_points, price, owned and optionally expires_time of a live signal.
    Owned players always matter and count OWNED_WEIGHT times; others from ``least`` points on, if they can
    be afforded or their price isn't known. A signal that lasts longer than ``stale_within`` covers its player.
    """
    relevant = F.col("owned") | (F.col("expected_points") >= least)
    if affordable is not None:
        relevant = F.col("owned") | ((F.col("expected_points") >= least) & F.coalesce(F.col("price") <= affordable, F.lit(True)))
    rows = players.where(F.col("team_id").isNotNull() & relevant)
    if "expires_time" in players.columns and at is not None:
        rows = rows.where(F.coalesce(F.col("expires_time") - F.expr(stale_within) <= at, F.lit(True)))
    weight = F.col("expected_points") * F.when(F.col("owned"), OWNED_WEIGHT).otherwise(1.0)
    return rows.groupBy("team_id").agg(F.sum(weight).alias("priority"), F.count(F.lit(1)).alias("players"), F.count_if("owned").alias("owned")).orderBy(F.desc("priority"), "team_id").limit(budget)


def purchase_prices(log: DataFrame, opening: DataFrame) -> DataFrame:
    """What is paid for what each owner holds: the last buy that wasn't sold since, else the opening price.

    ``log`` has owner, element, at, kind (buy or sell) and price; ``opening`` has owner, element, price.
    """
    last = log.groupBy("owner", "element").agg(F.max_by(F.struct("kind", "price"), F.struct("at", "kind", "price")).alias("_l"))
    return opening.join(last, ["owner", "element"], "full").where("_l IS NULL OR _l.kind = 'buy'").select("owner", "element", F.coalesce("_l.price", "price").alias("purchase_price"))


def rule_drift(before: dict, after: dict, prefix: str = "") -> list[tuple[str, object, object]]:
    """Fields of nested rules that differ."""
    out = []
    for k in sorted(set(before) | set(after)):
        a, b = before.get(k), after.get(k)
        if isinstance(a, dict) and isinstance(b, dict):
            out += rule_drift(a, b, f"{prefix}{k}.")
        elif a != b:
            out.append((prefix + k, a, b))
    return out


def latest_by(frame: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row a key: the last by a declared order."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return frame.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")

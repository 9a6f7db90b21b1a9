"""What a ranking is worth for choices: pick metrics, reachable pools, evidence, styles and name lookups."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.functions import scalars as S
from chronofold.operators.embeddings import squared_distance
from chronofold.operators.ranks import unit_ranks
from chronofold.operators.squads import CLUB_CAP, QUOTA
from chronofold.sources.scratch import written

# Bands of the share of a pool that is reachable and of what a slot may cost; the last of each has no end.
SHARE_BANDS = [(0.05, "under_5pc"), (0.15, "5_15pc"), (0.35, "15_35pc"), (0.6, "35_60pc"), (0.85, "60_85pc"), (None, "over_85pc")]
BUDGET_BANDS = [(40, "under_4.0"), (60, "4.0_6.0"), (80, "6.0_8.0"), (110, "8.0_11.0"), (None, "over_11.0")]
# Fixed values.
PICKS, TEMPLATE_SHARE, LEAST_POPULATION = 20, 0.1, 8
STYLE_LEAST_PLAYERS, STYLE_LEAST_SPREAD, STYLE_CLUSTERS, STYLE_DEFINING, STYLE_WORDS = 24, 0.05, 4, 0.45, 4
#: Rows of a position that first centres are sought in, starts, and the most steps.
STYLE_SAMPLE, STYLE_STARTS, STYLE_STEPS = 2048, 8, 30


def pick_metrics(frame: DataFrame, keys: Sequence[str], k: int = PICKS, template_share: float = TEMPLATE_SHARE) -> DataFrame:
    """One row of metrics of the k highest predictions (predicted, actual, ownership share, gameweek_id).

    Mean points, points weighted by who doesn't own the pick, the tenth percentile, points of picks below
    ``template_share``, and the mean over weeks of each week's highest prediction. ``keys`` break ties.
    """
    picks = frame.orderBy(F.desc("predicted"), *keys).limit(k)
    share = S.clip(F.col("ownership"), 0.0, 1.0)
    captains = frame.groupBy("gameweek_id").agg(F.max_by("actual", F.struct(F.col("predicted"), *(-F.col(c) for c in keys))).alias("c")).agg(F.avg("c").alias("captaincy"))
    rare = F.avg(F.when(F.col("ownership") < template_share, F.col("actual")))
    one = picks.agg(F.coalesce(F.avg("actual"), F.lit(0.0)).alias("points"), F.coalesce(F.avg(F.col("actual") * (1 - share)), F.lit(0.0)).alias("rank_gain"), F.coalesce(F.percentile("actual", 0.1), F.lit(0.0)).alias("downside"), F.coalesce(rare, F.lit(0.0)).alias("differential"))
    return one.crossJoin(F.broadcast(captains))


def positional_percentiles(frame: DataFrame, columns: Sequence[str], position: str = "position", least: int = LEAST_POPULATION) -> DataFrame:
    """Adds ``{column}_percentile``: the place within the position, ties sharing the middle; null below ``least`` values."""
    return unit_ranks(frame, [position], {c: f"{c}_percentile" for c in columns}, least)


def evidence(frame: DataFrame, columns: Sequence[str], position: str = "position") -> DataFrame:
    """Adds ``evidence``: an array of (feature, value, percentile)."""
    out = positional_percentiles(frame, columns, position)
    panel = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"), F.col(f"{c}_percentile").alias("percentile")) for c in columns))
    return out.withColumn("evidence", panel).drop(*(f"{c}_percentile" for c in columns))


def reachable(frame: DataFrame, *, excluded: Sequence[int] = (), locked: Sequence[int] = (), positions: Sequence[str] | None = None, most_price: int | None = None, full_clubs: Sequence[int] = (), key: str = "player_code") -> DataFrame:
    """Adds ``reachable``: whether a row meets every constraint, or is locked in. A price that isn't known doesn't exclude."""
    ok: Column = F.lit(True)
    if excluded:
        ok = ok & ~F.col(key).isin(*excluded)
    if positions is not None:
        ok = ok & F.col("position").isin(*positions)
    if most_price is not None:
        ok = ok & F.coalesce(F.col("price") <= most_price, F.lit(True))
    if full_clubs:
        ok = ok & ~F.coalesce(F.col("team_id").isin(*full_clubs), F.lit(False))
    return frame.withColumn("reachable", ok | F.col(key).isin(*locked) if locked else ok)


def _banded(value: Column, bands: Sequence[tuple[float | None, str]]) -> Column:
    out = F.lit(bands[-1][1])
    for ceiling, label in reversed(bands[:-1]):
        out = F.when(value < ceiling, label).otherwise(out)
    return out


def pool_signatures(limits: DataFrame, squads: DataFrame, candidates: DataFrame) -> DataFrame:
    """What part of the market each squad's situation leaves within reach, as a signature that evidence may be filed under.

    limits: squad_id, bank, minimum_bank and locked_players; squads: squad_id, player_code, position, team_id, selling_price;
    candidates: player_code, position, team_id, price. A position whose slots are all locked is closed; an open slot may cost what the money
    of the sellable picks allows once the others get the market's cheapest; a club is full with a squad's cap of locked picks. Gives squad_id,
    positions_open, slot_budget, budget_band, reachable, pool_share_band and club_restricted. Candidates are counted by price once, and no squad meets any.
    """
    lock = F.coalesce(F.array_contains(F.col("locked_players"), F.col("player_code")), F.lit(False))
    picks = squads.join(limits, "squad_id").withColumn("_locked", lock)
    closed = F.array_compact(F.array(*(F.when(F.count_if(F.col("_locked") & (F.col("position") == p)) >= n, F.lit(p)) for p, n in QUOTA.items())))
    market = candidates.agg(F.min("price").alias("_cheapest"), F.count(F.lit(1)).alias("_all"))
    money = picks.groupBy("squad_id").agg(closed.alias("_closed"), F.count_if(~F.col("_locked")).alias("_open"), F.coalesce(F.sum(F.when(~F.col("_locked"), F.col("selling_price"))), F.lit(0)).alias("_sells"), F.first(F.coalesce("bank", F.lit(0))).alias("_bank"), F.first(F.coalesce("minimum_bank", F.lit(0))).alias("_least")).crossJoin(market)
    ceiling = F.col("_bank") + F.col("_sells") - F.col("_least") - F.col("_cheapest") * (F.col("_open") - 1)
    money = written(money.withColumn("slot_budget", F.when((F.col("_open") > 0) & (ceiling > 0), ceiling)))
    full = picks.where("_locked").groupBy("squad_id", "team_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= CLUB_CAP).select("squad_id", "team_id")
    levels = candidates.groupBy("position", "team_id", "price").agg(F.count(F.lit(1)).alias("n"))
    # Budgets are whole tenths: there are few, and each is counted once for all squads that have it.
    budgets = money.select(F.coalesce("slot_budget", F.lit(1 << 40)).alias("_b")).distinct()
    counted = written(budgets.join(levels, F.coalesce(F.col("price"), F.lit(0)) <= F.col("_b")).groupBy("_b", "position", "team_id").agg(F.sum("n").alias("n")))
    by_position = counted.groupBy("_b").agg(*(F.coalesce(F.sum(F.when(F.col("position") == p, F.col("n"))), F.lit(0)).alias(f"_{p}") for p in QUOTA))
    keyed = money.withColumn("_b", F.coalesce("slot_budget", F.lit(1 << 40)))
    barred = full.join(keyed.select("squad_id", "_b", "_closed"), "squad_id").join(counted, ["_b", "team_id"]).where(~F.array_contains("_closed", F.col("position"))).groupBy("squad_id").agg(F.sum("n").alias("_barred"))
    restricted = full.select("squad_id").distinct().withColumn("club_restricted", F.lit(True))
    out = keyed.join(by_position, "_b", "left").join(barred, "squad_id", "left").join(restricted, "squad_id", "left")
    within = F.lit(0)
    for p in QUOTA:
        within = within + F.when(F.array_contains("_closed", p), 0).otherwise(F.coalesce(F.col(f"_{p}"), F.lit(0)))
    reachable_ = within - F.coalesce("_barred", F.lit(0))
    positions = F.filter(F.array(*map(F.lit, QUOTA)), lambda p: ~F.array_contains("_closed", p))
    return out.select("squad_id", positions.alias("positions_open"), "slot_budget", F.when(F.col("slot_budget").isNull(), "global").otherwise(_banded(F.col("slot_budget"), BUDGET_BANDS)).alias("budget_band"), reachable_.cast("long").alias("reachable"), _banded(reachable_ / F.col("_all"), SHARE_BANDS).alias("pool_share_band"), F.coalesce("club_restricted", F.lit(False)).alias("club_restricted"))


def style_axes(frame: DataFrame, columns: Sequence[str], position: str = "position") -> dict[str, list[str]]:
    """Of each position with enough players, the columns whose relative spread is worth an axis (a row a position)."""
    rows = frame.groupBy(position).agg(F.count(F.lit(1)).alias("n"), *(a for c in columns for a in (F.stddev_pop(c).alias(f"s_{c}"), F.avg(c).alias(f"m_{c}")))).collect()
    kept = {r[position]: [c for c in columns if r[f"s_{c}"] is not None and r[f"s_{c}"] / (abs(r[f"m_{c}"]) + 1e-9) >= STYLE_LEAST_SPREAD] for r in rows if r.n >= STYLE_LEAST_PLAYERS}
    return {p: axes for p, axes in kept.items() if len(axes) >= 2}


@dataclass(frozen=True)
class Styles:
    """Archetypes of each position: its axes, how they are scaled, centres (in scaled values of all columns) and labels."""

    columns: tuple[str, ...]
    axes: dict[str, list[str]]
    scale: dict[str, dict[str, tuple[float, float]]]
    centres: dict[str, list[list[float]]]
    labels: dict[str, list[str]]

    def vectors(self, frame: DataFrame, key: str, position: str) -> DataFrame:
        """key, position and embedding of the rows of clustered positions; columns that are no axis of a position are zero there, and so are unknown values."""
        parts = []
        for c in self.columns:
            value = F.lit(0.0)
            for p, axes in self.axes.items():
                if c in axes:
                    mean, sd = self.scale[p][c]
                    value = F.when(F.col(position) == p, F.coalesce((F.col(c).cast("double") - mean) / sd, F.lit(0.0))).otherwise(value)
            parts.append(value)
        return frame.where(F.col(position).isin(*self.axes)).select(key, position, F.array(*parts).alias("embedding"))

    def place(self, vectors: DataFrame, position: str) -> DataFrame:
        """Adds cluster_id, distance_to_centroid and label."""
        centres = F.create_map(*[x for p, rows in self.centres.items() for x in (F.lit(p), F.array(*(F.array(*map(F.lit, c)) for c in rows)))])[F.col(position)]
        names = F.create_map(*[x for p, rows in self.labels.items() for x in (F.lit(p), F.array(*map(F.lit, rows)))])[F.col(position)]
        near = vectors.withColumn("_d", F.transform(centres, lambda c: squared_distance(F.col("embedding"), c)))
        at = F.array_position("_d", F.array_min("_d")).cast("int")
        return near.select(*vectors.columns, (at - 1).alias("cluster_id"), F.sqrt(F.array_min("_d")).alias("distance_to_centroid"), F.element_at(names, at).alias("label"))


def _seeded_centres(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """The best of some k-means runs over a sample: starts far apart, then means of what is nearest."""
    best, least = sample[:k], np.inf
    for turn in range(STYLE_STARTS):
        rng = np.random.default_rng([seed, turn])
        centres = [sample[rng.integers(len(sample))]]
        while len(centres) < k:
            gaps = np.min([((sample - c) ** 2).sum(1) for c in centres], axis=0)
            centres.append(sample[rng.choice(len(sample), p=gaps / gaps.sum()) if gaps.sum() > 0 else 0])
        at = np.array(centres)
        for _ in range(STYLE_STEPS):
            own = ((sample[:, None] - at[None]) ** 2).sum(2).argmin(1)
            moved = np.array([sample[own == c].mean(0) if (own == c).any() else at[c] for c in range(k)])
            if np.allclose(moved, at):
                break
            at = moved
        cost = ((sample[:, None] - at[None]) ** 2).sum(2).min(1).sum()
        if cost < least - 1e-9:
            best, least = at, cost
    return best[np.lexsort(np.round(best, 6).T[::-1])]


def style_labels(position: str, centres: Sequence[Sequence[float]], columns: Sequence[str], words: dict[str, tuple[str, str]]) -> list[str]:
    """A name for each centre from the axes it is extreme on, as many as tell the position's centres apart; those that nothing tells apart are numbered."""
    def named(centre: Sequence[float], most: int) -> str:
        far = sorted((k for k in range(len(columns)) if abs(centre[k]) >= STYLE_DEFINING), key=lambda k: (-round(abs(centre[k]), 6), columns[k]))[:most]
        said = [words.get(columns[k], (f"high {columns[k]}", f"low {columns[k]}"))[0 if centre[k] > 0 else 1] for k in far]
        return f"{', '.join(said)} {position}" if said else f"typical {position}"

    for most in range(2, STYLE_WORDS + 1):
        names = [named(c, most) for c in centres]
        if len(set(names)) == len(names):
            return names
    return [n if names[:k].count(n) == 0 else f"{n} ({names[:k].count(n) + 1})" for k, n in enumerate(names)]


def fit_styles(frame: DataFrame, columns: Sequence[str], words: dict[str, tuple[str, str]] | None = None, position: str = "position", key: str = "player_code", seed: int = 20260728) -> tuple[Styles, DataFrame]:
    """Archetypes of all positions together, and every player's place: key, position, embedding, cluster_id, distance_to_centroid, label.

    One pass finds axes and scales, a bounded sample of each position gives first centres, and each further pass moves all
    positions' centres to the means of what is nearest, sums being taken where the rows are. A position of any size is no one task's work.
    """
    axes = style_axes(frame, columns, position)
    if not axes:
        none = Styles(tuple(columns), {}, {}, {}, {})
        return none, frame.limit(0).select(key, position, F.array().cast("array<double>").alias("embedding"), F.lit(0).alias("cluster_id"), F.lit(0.0).alias("distance_to_centroid"), F.lit("").alias("label"))
    rows = frame.where(F.col(position).isin(*axes))
    stats = {r[position]: r for r in rows.groupBy(position).agg(F.count(F.lit(1)).alias("n"), *(a for c in columns for a in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")))).collect()}
    scale = {p: {c: (float(stats[p][f"m_{c}"]), float(stats[p][f"s_{c}"]) or 1.0) for c in cs} for p, cs in axes.items()}
    styles = Styles(tuple(columns), axes, scale, {}, {})
    vectors = written(styles.vectors(rows, key, position))
    order = Window.partitionBy(position).orderBy(F.xxhash64(key), key)
    sample = vectors.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= STYLE_SAMPLE).select(position, "embedding").toPandas()
    centres = {}
    for p in axes:
        some = np.array(sample.loc[sample[position] == p, "embedding"].tolist())
        centres[p] = _seeded_centres(some, max(1, min(STYLE_CLUSTERS, stats[p].n // 6)), seed).tolist()
    for _ in range(STYLE_STEPS):
        placed = Styles(styles.columns, axes, scale, centres, {p: [""] * len(c) for p, c in centres.items()}).place(vectors, position)
        means = placed.groupBy(position, "cluster_id").agg(*(F.avg(F.col("embedding")[k]).alias(f"v{k}") for k in range(len(columns)))).collect()  # positions x clusters rows
        moved = {p: [list(c) for c in rows_] for p, rows_ in centres.items()}
        for r in means:
            moved[r[position]][r.cluster_id] = [r[f"v{k}"] for k in range(len(columns))]
        done = all(np.allclose(moved[p], centres[p], atol=1e-9) for p in centres)
        centres = moved
        if done:
            break
    labels = {p: style_labels(p, c, columns, words or {}) for p, c in centres.items()}
    fitted = Styles(styles.columns, axes, scale, centres, labels)
    return fitted, fitted.place(vectors, position)


def archetypes(frame: DataFrame, columns: Sequence[str], position: str = "position", key: str = "player_code", words: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Position, cluster, distance and label of each player, clustered within positions on standardised axes."""
    return fit_styles(frame, columns, words, position, key)[1].select(key, position, "cluster_id", "distance_to_centroid", "label")


def name_index(players: DataFrame, names: Sequence[str], key: str = "player_code") -> DataFrame:
    """Names in lower case that mean one player only, with that player."""
    each = players.select(key, F.explode(F.array(*(F.lower(F.trim(F.col(c))) for c in names))).alias("name")).where("name <> ''")
    return each.groupBy("name").agg(F.count_distinct(key).alias("n"), F.min(key).alias(key)).where("n = 1").drop("n")


def ranked_page(frame: DataFrame, by: str, key: str, page: int = 0, size: int = 20) -> DataFrame:
    """One page of a ranking."""
    return frame.orderBy(F.desc_nulls_last(by), key).offset(page * size).limit(size)

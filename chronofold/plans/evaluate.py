"""Scoring feature sets over folds, with controls, importance, search and acceptance.

Folds are scored by ridge regressions whose moments Spark sums, a fold, part and column at a time; the
driver solves systems of columns squared numbers and never sees a row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.functions.scalars import hashed_uniform
from chronofold.operators.ranks import null_safe_join, places
from chronofold.plans.folds import Fold, fold_rows

ROOT_SEED = 20260727


def derive_seed(root: int, *names: object) -> int:
    """A child seed that depends on root and names only."""
    import hashlib

    return int.from_bytes(hashlib.sha256(":".join(map(str, (root, *names))).encode()).digest()[:4], "big")


def noise(seed: int, *keys: str) -> Column:
    """Standard normal draws by hash (Box-Muller), the same on every run and partitioning."""
    u = F.greatest(hashed_uniform(seed, *(F.col(k) for k in keys)), F.lit(1e-12))
    v = hashed_uniform(seed + 1, *(F.col(k) for k in keys))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * np.pi * v)


def shuffled(frame: DataFrame, column: str, within: Sequence[str], keys: Sequence[str], seed: int, out: str) -> DataFrame:
    """``column`` dealt anew among the rows of each ``within``: the control that keeps its distribution."""
    return dealt(frame, {column: out}, within, keys, seed)


def dealt(frame: DataFrame, columns: dict[str, str], within: Sequence[str], keys: Sequence[str], seed: int) -> DataFrame:
    """Columns (name -> output) dealt anew among the rows of each ``within``, all by one deal.

    Rows and values are put in two orders by hash, and rows take the value of their place; places are
    counted in ranges of the hash, so that no ``within`` is one task's work.
    """
    draw = lambda k: hashed_uniform(seed + k, *(F.col(c) for c in keys))
    here = places(frame.withColumn("_u", draw(0)), within, "_u", ["_u", *keys], "_i").drop("_u")
    values = frame.select(*within, *dict.fromkeys([*keys, *columns])).withColumn("_u", draw(1))
    there = places(values, within, "_u", ["_u", *keys], "_i").select(*within, *(F.col(c).alias(out) for c, out in columns.items()), "_i")
    return null_safe_join(here, there, [*within, "_i"]).drop("_i")


@dataclass(frozen=True)
class FoldModel:
    fold: int
    mean: np.ndarray
    weights: np.ndarray
    intercept: float


def fit_folds(frame: DataFrame, folds: Sequence[Fold], features: Sequence[str], label: str, ridge: float = 1.0, time: str = "timeline") -> list[FoldModel]:
    """A ridge regression on each fold's training rows; missing features take the training mean."""
    rows = fold_rows(frame, folds, time).where("part = 'train'").where(F.col(label).isNotNull())
    means = {r.fold: r for r in rows.groupBy("fold").agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in features), F.avg(label).alias("_y")).collect()}
    centre = lambda c: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for f, r in means.items() for x in (f, float(r[c]))]), F.col("fold")), F.lit(0.0))
    x = [F.coalesce(F.col(c).cast("double") - centre(c), F.lit(0.0)) for c in features]
    y = F.col(label) - centre("_y")
    k = len(features)
    sums = rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *(F.sum(x[i] * x[j]).alias(f"x{i}_{j}") for i in range(k) for j in range(i, k)), *(F.sum(x[i] * y).alias(f"y{i}") for i in range(k))).collect()
    out = []
    for s in sums:
        gram = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                gram[i, j] = gram[j, i] = s[f"x{i}_{j}"]
        w = np.linalg.solve(gram + ridge * np.eye(k), np.array([s[f"y{i}"] for i in range(k)])) if k else np.zeros(0)
        out.append(FoldModel(s.fold, np.array([means[s.fold][c] for c in features]), w, means[s.fold]["_y"]))
    return sorted(out, key=lambda m: m.fold)


def predict_folds(frame: DataFrame, folds: Sequence[Fold], models: Sequence[FoldModel], features: Sequence[str], time: str = "timeline") -> DataFrame:
    """Validation rows of every fold with ``predicted``."""
    rows = fold_rows(frame, folds, time).where("part = 'validate'")
    predicted = F.lit(None).cast("double")
    for m in models:
        value = F.lit(float(m.intercept))
        for c, mean, w in zip(features, m.mean, m.weights, strict=True):
            value = value + F.coalesce(F.col(c).cast("double") - float(mean), F.lit(0.0)) * float(w)
        predicted = F.when(F.col("fold") == m.fold, value).otherwise(predicted)
    return rows.withColumn("predicted", predicted)


def score(frame: DataFrame, folds: Sequence[Fold], features: Sequence[str], label: str, time: str = "timeline") -> DataFrame:
    """MAE of each fold's validation rows, and of predicting the mean outcome of training."""
    models = fit_folds(frame, folds, features, label, time=time)
    rows = predict_folds(frame, folds, models, features, time).where(F.col(label).isNotNull())
    base = F.create_map(*[F.lit(x) for m in models for x in (m.fold, float(m.intercept))])[F.col("fold")]
    return rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("predicted") - F.col(label))).alias("mae"), F.avg(F.abs(base - F.col(label))).alias("baseline_mae"))


def weighted_mae(scores: DataFrame) -> float:
    return scores.agg((F.sum(F.col("mae") * F.col("n")) / F.sum("n")).alias("m")).first().m


class Scorer:
    """MAE of feature sets over the same folds; a set is scored once, in whatever order its columns come."""

    def __init__(self, frame: DataFrame, folds: Sequence[Fold], label: str, time: str = "timeline") -> None:
        self.frame, self.folds, self.label, self.time = frame, folds, label, time
        self.known: dict[tuple[str, ...], float] = {}

    def __call__(self, features: Sequence[str]) -> float:
        key = tuple(sorted(features))
        if key not in self.known:
            self.known[key] = weighted_mae(score(self.frame, self.folds, list(key), self.label, self.time))
        return self.known[key]


def max_noise_control(frame: DataFrame, folds: Sequence[Fold], features: Sequence[str], label: str, keys: Sequence[str], trials: int = 8, most: int = 40, seed: int = ROOT_SEED, time: str = "timeline") -> tuple[float, int]:
    """The best MAE that one column of noise beside ``features`` reaches in ``trials`` draws, and how many were made.

    A candidate that was picked as the best of many must beat the best of as many draws, not their mean.
    """
    ran = max(1, min(trials, most))
    drawn = frame.withColumns({f"_noise_{k}": noise(derive_seed(seed, "max_noise", k), *keys) for k in range(ran)})
    return min(weighted_mae(score(drawn, folds, [*features, f"_noise_{k}"], label, time)) for k in range(ran)), ran


def permutation_importance(frame: DataFrame, folds: Sequence[Fold], features: Sequence[str], label: str, keys: Sequence[str], repeats: int = 3, seed: int = ROOT_SEED, time: str = "timeline") -> DataFrame:
    """How much worse each fold's MAE gets when a feature is dealt anew among its validation rows."""
    models = fit_folds(frame, folds, features, label, time=time)
    base = predict_folds(frame, folds, models, features, time).groupBy("fold").agg(F.avg(F.abs(F.col("predicted") - F.col(label))).alias("base"))
    parts = []
    for c in features:
        for r in range(repeats):
            mixed = shuffled(fold_rows(frame, folds, time).where("part = 'validate'"), c, ["fold"], keys, derive_seed(seed, c, r), "_mixed").withColumn(c, F.col("_mixed")).drop("fold", "part", "_mixed").distinct()
            rows = predict_folds(mixed, folds, models, features, time)
            parts.append(rows.groupBy("fold").agg(F.avg(F.abs(F.col("predicted") - F.col(label))).alias("mae")).withColumn("feature", F.lit(c)))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.join(base, "fold").groupBy("feature", "fold").agg(F.avg(F.col("mae") - F.col("base")).alias("delta"), F.coalesce(F.stddev_pop(F.col("mae") - F.col("base")), F.lit(0.0)).alias("sd"))


@dataclass(frozen=True)
class Search:
    """Chosen features, the cost after each, and whether the search ended at a cap with candidates left."""

    chosen: list[str]
    costs: list[float]
    truncated: bool

    def __iter__(self):
        return iter((self.chosen, self.costs))


def _costs(cost: Callable[[tuple[str, ...]], float], sets: Sequence[tuple[str, ...]]) -> list[float]:
    """The sets' costs; a cost function with ``many`` (as a ``MomentScorer``) is asked once for all of them."""
    many = getattr(cost, "many", None)
    return many(sets) if many else [cost(s) for s in sets]


def greedy_search(candidates: Sequence[str], cost: Callable[[tuple[str, ...]], float], min_gain: float = 0.0, most: int = 8, most_evaluations: int = 600, required: Sequence[str] = ()) -> Search:
    """Adds to ``required`` the feature that lowers the cost most, while it does by ``min_gain``."""
    chosen: list[str] = []
    candidates = [c for c in dict.fromkeys(candidates) if c not in required]
    costs, evaluations = _costs(cost, [tuple(required)]), 1
    while len(chosen) < most:
        rest = [c for c in candidates if c not in chosen]
        if evaluations + len(rest) > most_evaluations:
            return Search(chosen, costs, True)
        trials = sorted(zip(_costs(cost, [(*required, *chosen, c) for c in rest]), rest, strict=True))
        evaluations += len(rest)
        if not trials or costs[-1] - trials[0][0] <= min_gain:
            return Search(chosen, costs, False)
        chosen.append(trials[0][1])
        costs.append(trials[0][0])
    return Search(chosen, costs, len(chosen) < len(candidates))


@dataclass(frozen=True)
class Beam:
    """The best set met and its cost, and whether the search ended at its depth with larger sets left to try."""

    best: tuple[str, ...]
    cost: float
    truncated: bool

    def __iter__(self):
        return iter((self.best, self.cost))

    def __getitem__(self, k: int):
        return (self.best, self.cost)[k]


def beam_search(candidates: Sequence[str], cost: Callable[[tuple[str, ...]], float], width: int = 3, depth: int = 4, most_evaluations: int = 600) -> Beam:
    """The best set met while the ``width`` best sets of each size are extended."""
    beam = [((), _costs(cost, [()])[0])]
    best, evaluations = beam[0], 1
    for _ in range(depth):
        grown = sorted({tuple(sorted((*s, c))) for s, _ in beam for c in candidates if c not in s})
        if not grown:
            return Beam(*best, False)
        if evaluations + len(grown) > most_evaluations:
            return Beam(*best, True)
        evaluations += len(grown)
        beam = sorted(zip(grown, _costs(cost, grown), strict=True), key=lambda x: (x[1], x[0]))[:width]
        best = min(best, beam[0], key=lambda x: x[1])
    return Beam(*best, depth < len(dict.fromkeys(candidates)))


@dataclass(frozen=True)
class Acceptance:
    """What a feature must show; the defaults are fixed values."""

    folds: int = 3
    win_rate: float = 0.6
    incremental: float = 0.002
    recent_degradation: float = 0.01
    missingness: float = 0.5
    turnover: float = 0.9

    def verdict(self, *, folds: int, win_rate: float, incremental: float, recent_degradation: float, missingness: float, turnover: float, beats_controls: bool, leaks: bool) -> tuple[str, list[str]]:
        """accepted, experimental, revise, insufficient or rejected, and why."""
        if leaks:
            return "rejected", ["leaks"]
        if folds < self.folds:
            return "insufficient", [f"{folds} folds"]
        if not beats_controls:
            return "rejected", ["no better than controls"]
        why = [t for ok, t in ((missingness <= self.missingness, "missing too often"), (turnover <= self.turnover, "unstable")) if not ok]
        if why:
            return "revise", why
        soft = [t for ok, t in ((win_rate >= self.win_rate, "wins too few folds"), (incremental >= self.incremental, "gains too little"), (recent_degradation <= self.recent_degradation, "worse of late")) if not ok]
        return ("accepted", []) if not soft else ("experimental", soft) if incremental > 0 else ("rejected", soft)


# What each term of a feature's utility weighs.
GAINS = {"prediction": 1.0, "decision": 1.0, "objective": 1.0, "stability": 0.5, "complementarity": 1.0}
PENALTIES = {"complexity": 0.1, "missingness": 0.5, "turnover": 0.2, "leakage": 10.0}


def relative_gain(candidate: float | None, baseline: float | None, lower_is_better: bool = False) -> float | None:
    """How much better than the baseline, as a share of it; None where either wasn't measured."""
    if candidate is None or baseline is None:
        return None
    better = baseline - candidate if lower_is_better else candidate - baseline
    return better / max(abs(baseline), 1e-9)


def utility(gains: dict[str, float | None], *, complexity: int = 1, missingness: float = 0.0, turnover: float | None = 0.0, leakage: float = 0.0) -> tuple[float, dict[str, float], list[str]]:
    """The total, every weighed term, and the terms that weren't measured (None), which count nothing.

    ``gains`` may name prediction, decision, objective, stability and complementarity. Size is charged by its
    logarithm; shares are held to [0, 1].
    """
    share = lambda x: max(0.0, min(1.0, x))
    terms = {k: w * gains[k] for k, w in GAINS.items() if gains.get(k) is not None}
    charges = {"complexity": float(np.log1p(max(0, complexity - 1))), "missingness": share(missingness), "turnover": None if turnover is None else share(turnover), "leakage": share(leakage)}
    terms |= {k: -w * charges[k] for k, w in PENALTIES.items() if charges[k] is not None}
    return sum(terms.values()), terms, [k for k in (*GAINS, *PENALTIES) if k not in terms]


def complementarity(*, leaks: bool, folds: int, incremental: float, stability: float, win_rate: float, clusters: Sequence[tuple[int, float]] = (), segments: Sequence[tuple[int, float]] = (), objective_gain: float | None = None, global_gain: float | None = None, policy: Acceptance = Acceptance(), least_rows: int = 200) -> str:
    """What kind of value a feature adds: everywhere, for some clusters or segments (rows, gain), for an objective, none, or none that can be told."""
    if leaks:
        return "leakage_suspected"
    if folds < policy.folds:
        return "insufficient_history"
    if incremental >= policy.incremental:
        return "unstable" if stability < 0.3 else "globally_complementary"
    if any(n >= least_rows and gain >= policy.incremental for n, gain in (*clusters, *segments)):
        return "cluster_specific"
    if objective_gain is not None and global_gain is not None and objective_gain >= policy.incremental > global_gain:
        return "objective_specific"
    return "unstable" if stability < 0.3 and win_rate >= 0.4 else "redundant"

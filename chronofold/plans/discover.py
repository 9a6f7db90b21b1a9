"""One discovery run: programs proposed, proven, computed in one plan, scored against controls, judged and recorded."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofold.operators.leakage import prove_programs
from chronofold.operators.metrics import ranking_churn
from chronofold.plans import evaluate
from chronofold.plans.compile import Context, compile_programs
from chronofold.plans.folds import Fold
from chronofold.plans.moments import MomentScorer
from chronofold.plans.nodes import FeatureProgram
from chronofold.sources.scratch import written

RECORD = "feature string, version string, verdict string, complementarity string, utility double, incremental double, win_rate double, stability double, missingness double, turnover double, decision_gain double, objective_gain double, control_gain double, leakage_passed boolean, reason string"
#: Picks a week whose realised outcome a prediction's decisions are judged by.
PICKS = 20


@dataclass(frozen=True)
class Setting:
    """What a run measures with: labelled rows (row key, timeline, label), their history, base features and folds.

    ``entity`` is the column that rankings are followed by from one time to the next. ``objective`` is a column that holds what
    the objective itself counts for a pick (null: not measured), else the label.
    """

    rows: DataFrame
    history: DataFrame
    row_key: tuple[str, ...]
    label: str
    base: tuple[str, ...]
    folds: tuple[Fold, ...]
    context: Context = Context()
    policy: evaluate.Acceptance = evaluate.Acceptance()
    noise_trials: int = 3
    seed: int = evaluate.ROOT_SEED
    entity: str | None = None
    objective: str | None = None
    picks: int = PICKS


def stability(gains: Sequence[float]) -> float:
    """Share of folds won, scaled down by how uneven the gains are; 0 below two folds or without a win."""
    x = np.array(gains)
    if len(x) < 2 or not (x > 0).any():
        return 0.0
    return float((x > 0).mean() * max(0.0, 1 - min(1.0, x.std() / (abs(x.mean()) + 1e-9))))


def decisions(predictions: DataFrame, sets: Sequence[str], s: Setting) -> dict[str, dict[str, float | None]]:
    """Of each named prediction: what the ``picks`` highest of each fold and time came to (by label and by objective), and its ranking's churn."""
    outcome = [F.col(s.label).alias("_actual"), (F.col(s.objective).cast("double") if s.objective else F.lit(None).cast("double")).alias("_objective")]
    kept = predictions.where(F.col(s.label).isNotNull()).select("fold", "timeline", *s.row_key, *([s.entity] if s.entity and s.entity not in s.row_key else []), *outcome, F.explode(F.array(*(F.struct(F.lit(n).alias("set"), F.col(n).alias("predicted")) for n in sets))).alias("_p"))
    flat = kept.select("*", "_p.set", "_p.predicted").drop("_p").where("predicted IS NOT NULL")
    # Spark keeps a task's best of every (set, fold, time) before it shuffles, so a week of any size sends few rows.
    order = Window.partitionBy("set", "fold", "timeline").orderBy(F.desc("predicted"), *s.row_key)
    picked = flat.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= s.picks)
    each = picked.groupBy("set").agg(F.avg("_actual").alias("decision"), F.avg("_objective").alias("objective"))
    out = {r.set: {"decision": r.decision, "objective": r.objective, "turnover": None} for r in each.collect()}
    if s.entity:
        churn = ranking_churn(flat, "timeline", s.entity, "predicted", ["set", "fold"])
        for r in churn.where(F.col("churn").isNotNull()).groupBy("set").agg(F.avg("churn").alias("c")).collect():
            out[r.set]["turnover"] = r.c
    return out


def discover(s: Setting, programs: Sequence[FeatureProgram]) -> DataFrame:
    """One row a program (RECORD): what was measured and what follows from it.

    Programs that read the future, or can't be proven not to, are rejected before anything is scored. The
    others are columns of one plan, and so are columns of noise and the programs' values dealt anew among rows. One matrix
    of moments and one pass over the validation rows score them all: each is added alone to the base features, and
    must beat the best column of noise and its own dealt values. Two further jobs judge picks and rankings. What isn't
    measured (no entity, no objective) is null in the record and counts nothing.
    """
    proofs = prove_programs(programs, s.rows, s.history, s.row_key, s.context)
    clean = [p for p in programs if proofs[p.name][0]]
    none = (0.0, 0.0, 0.0, 0.0, 0.0, None, None, None, 0.0, False)
    out = [(p.name, p.version(), "rejected", "leakage_suspected", *none, proofs[p.name][2]) for p in programs if not proofs[p.name][0]]
    if clean:
        names = [p.name for p in clean]
        noise = {f"_noise_{k}": evaluate.noise(evaluate.derive_seed(s.seed, "max_noise", k), *s.row_key) for k in range(s.noise_trials)}
        base = list(s.base)
        keep = [*s.row_key, *([s.entity] if s.entity else []), *([s.objective] if s.objective else [])]
        # Only what is scored goes through the deal's shuffles; noise follows from the row's key behind them.
        used = dict.fromkeys(["timeline", s.label, *keep, *base, *names])
        frame = written(compile_programs(s.rows, s.history, clean, s.context).select(*used))
        frame = evaluate.dealt(frame, {n: f"_dealt_{n}" for n in names}, ["timeline"], list(s.row_key), evaluate.derive_seed(s.seed, "dealt")).withColumns(noise)
        scorer = MomentScorer(frame, s.folds, s.label, [*base, *names, *noise, *(f"_dealt_{n}" for n in names)], keep=tuple(dict.fromkeys(keep)))
        sets = [base, *([*base, n] for n in names), *([*base, c] for c in noise), *([*base, f"_dealt_{n}"] for n in names)]
        mae = dict(zip(map(tuple, sets), scorer.many(sets), strict=True))
        base_mae = mae[tuple(base)]
        gain = lambda *more: 1 - mae[(*base, *more)] / base_mae if base_mae else 0.0
        noise_gain = max(gain(c) for c in noise) if noise else -np.inf
        missing = scorer.rows.agg(*(F.avg(F.col(n).isNull().cast("int")).alias(n) for n in names)).first()
        labels = {"base": base, **{f"with_{k}": [*base, n] for k, n in enumerate(names)}}
        judged = decisions(scorer.predictions(labels), list(labels), s)
        before = scorer.by_fold(base)
        for k, p in enumerate(clean):
            now = scorer.by_fold([*base, p.name])
            gains = [1 - now[f][1] / before[f][1] if before[f][1] else 0.0 for f in sorted(now)]
            won, steady, incremental = float(np.mean([g > 0 for g in gains])) if gains else 0.0, stability(gains), gain(p.name)
            control = max(noise_gain, gain(f"_dealt_{p.name}"))
            beats = incremental > control
            mine, plain = judged.get(f"with_{k}", {}), judged.get("base", {})
            decision = evaluate.relative_gain(mine.get("decision"), plain.get("decision"))
            objective = evaluate.relative_gain(mine.get("objective"), plain.get("objective")) if beats else (0.0 if s.objective else None)
            turnover = mine.get("turnover")
            verdict, why = s.policy.verdict(folds=len(gains), win_rate=won, incremental=incremental, recent_degradation=max(0.0, -gains[-1]) if gains else 0.0, missingness=missing[p.name], turnover=turnover or 0.0, beats_controls=beats, leaks=False)
            kind = evaluate.complementarity(leaks=False, folds=len(gains), incremental=incremental, stability=steady, win_rate=won, objective_gain=objective, global_gain=incremental, policy=s.policy)
            total, _, _ = evaluate.utility({"prediction": incremental, "decision": decision, "objective": objective, "stability": steady, "complementarity": max(0.0, incremental - control)}, complexity=p.node_count, missingness=missing[p.name], turnover=turnover)
            out.append((p.name, p.version(), verdict, kind, float(total), float(incremental), won, steady, float(missing[p.name]), turnover, decision, objective, float(control), True, "; ".join(why)))
    return s.rows.sparkSession.createDataFrame(out, RECORD)

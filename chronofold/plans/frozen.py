"""What must hold before an experiment is scored: nothing was fitted, chosen or tuned on what it is judged by."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass, field

from chronofold.plans.folds import Fold


class FreezeViolation(AssertionError):
    """An experiment that isn't frozen."""


@dataclass(frozen=True)
class Check:
    name: str
    detail: str = ""
    fatal: bool = True

    @property
    def passed(self) -> bool:
        return not self.detail


@dataclass(frozen=True)
class Artifact:
    """What is known of a fitted model: the (season, gameweek) pairs it saw, what it is and which columns it takes."""

    trained_on: frozenset[tuple[str, int]]
    fingerprint: str = ""
    columns: tuple[str, ...] = ()
    folds: tuple[Fold, ...] = ()
    embargo: int = 0


@dataclass(frozen=True)
class Pinned:
    """A model as the experiment names it; what isn't pinned isn't checked."""

    fingerprint: str | None = None
    columns_hash: str | None = None
    price_calibration: bool = False


@dataclass(frozen=True)
class Experiment:
    """windows: (season, first gameweek, last gameweek). hashes: what inputs (data, rules) were when it was written."""

    windows: tuple[tuple[str, int, int], ...]
    models: dict[str, Pinned] = field(default_factory=dict)
    calibrated_on: tuple[str, ...] = ()
    tuned_on: tuple[str, ...] = ()
    hashes: dict[str, str] = field(default_factory=dict)


def columns_hash(columns: Sequence[str]) -> str:
    return hashlib.sha256("|".join(columns).encode()).hexdigest()


def freeze_checks(experiment: Experiment, artifacts: dict[str, Artifact | None], hashes: dict[str, str] | None = None) -> list[Check]:
    """All checks in order. An artifact of None is a closed form, which has nothing to freeze."""
    fitted = {name: a for name, a in artifacts.items() if a is not None}
    seasons = sorted({s for s, _, _ in experiment.windows})
    late = [f"{n} was fitted on {s}" for n, a in fitted.items() for s in sorted({s for s, _ in a.trained_on}) if any(s >= e for e in seasons)]
    overlap = [f"{n} saw {s} {g}" for n, a in fitted.items() for s, g in sorted(a.trained_on) if any(s == w and low <= g <= high for w, low, high in experiment.windows)]
    other = [f"{n} is another model" for n, p in experiment.models.items() if p.fingerprint is not None and n in fitted and fitted[n].fingerprint != p.fingerprint]
    wider = [f"{n} takes other columns" for n, p in experiment.models.items() if p.columns_hash is not None and n in fitted and columns_hash(fitted[n].columns) != p.columns_hash]
    measured = sorted(set(experiment.calibrated_on) & set(seasons))
    using = [n for n, p in experiment.models.items() if p.price_calibration]
    tuned = sorted(set(experiment.tuned_on) & set(seasons))
    backward = [f"{n} fold {f.index}" for n, a in fitted.items() for f in a.folds if f.validate[0] < f.train[1] + 1 + a.embargo]
    moved = [f"{k} isn't what was pinned" for k, v in experiment.hashes.items() if v and (hashes or {}).get(k) and hashes[k] != v]
    return [
        Check("train_seasons_precede_test", "; ".join(late)),
        Check("no_model_overlap_with_evaluation_period", "; ".join(overlap)),
        Check("architecture_and_hyperparameters_frozen", "; ".join(other)),
        Check("feature_selection_frozen", "; ".join(wider)),
        Check("calibration_not_fitted_on_test", f"{using} use a calibration measured on {measured}" if measured and using else ""),
        Check("thresholds_not_selected_on_test", f"tuned on {tuned}" if tuned else ""),
        Check("folds_are_walk_forward", "; ".join(backward)),
        Check("inputs_are_pinned", "; ".join(moved)),
    ]


def assert_frozen(experiment: Experiment, artifacts: dict[str, Artifact | None], hashes: dict[str, str] | None = None) -> list[Check]:
    """The checks, or an error at the first fatal one that fails."""
    checks = freeze_checks(experiment, artifacts, hashes)
    for c in checks:
        if c.fatal and not c.passed:
            raise FreezeViolation(f"{c.name}: {c.detail}")
    return checks

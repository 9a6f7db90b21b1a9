"""Component models: counts, chances, classes and amounts, all folds and labels fitted together.

A head is one label and its family. Each Newton step is one pass over the training rows: tasks sum gradient, curvature and
loss of every fold and head in Arrow batches, Spark adds the sums up, and the driver solves systems of the
size of the features. It never sees a row. A step that raises a head's loss is halved, heads advance each at
their own pace, and a pass serves all that are still under way.

Missing features take their fold's training mean, and features are scaled by what spreads them there. Rows whose label is null
don't train that head. A label with one value only in a fold's training rows has no model there, and no
prediction (null), rather than one that is sure of a constant.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from chronofold.operators.metrics import log_loss, poisson_deviance
from chronofold.plans.folds import Fold, fold_rows
from chronofold.sources.scratch import written

FAMILIES = ("squared", "poisson", "binary", "classes")
#: A fold that trains on every row and validates on none: what is fitted for use.
WHOLE = Fold(-1, (-(1 << 62), 1 << 62), (1, 0))
_FAR = 30.0
LEAST_CHANCE = 1e-12


@dataclass(frozen=True)
class Head:
    """A label and how it is modelled: ``classes`` counts the values 0, 1, .. of a class label."""

    label: str
    family: str = "squared"
    classes: int = 2

    def __post_init__(self) -> None:
        if self.family not in FAMILIES:
            raise ValueError(f"family {self.family!r} is none of {FAMILIES}")

    @property
    def rows(self) -> int:
        """Rows of its weight matrix: one, or one for each class but the first."""
        return self.classes - 1 if self.family == "classes" else 1

    @property
    def outputs(self) -> list[str]:
        """Columns that it predicts."""
        return [f"predicted_{self.label}_{k}" for k in range(self.classes)] if self.family == "classes" else [f"predicted_{self.label}"]

    def target(self, y: np.ndarray) -> np.ndarray:
        """What is fitted: counts from 0 on, whether an event took place, or the value itself."""
        return np.maximum(y, 0) if self.family == "poisson" else (y > 0).astype(float) if self.family == "binary" else y

    def mean(self, eta: np.ndarray) -> np.ndarray:
        """Predictions (columns as ``outputs``) from linear predictors (rows x self.rows)."""
        if self.family == "squared":
            return eta
        if self.family == "poisson":
            return np.exp(np.clip(eta, -_FAR, _FAR))
        if self.family == "binary":
            return 1 / (1 + np.exp(-np.clip(eta, -_FAR, _FAR)))
        full = np.column_stack([np.zeros(len(eta)), eta])
        full = np.exp(full - full.max(1, keepdims=True))
        return full / full.sum(1, keepdims=True)

    def sums(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Loss, gradient and curvature over rows at weights w (rows x columns of x), end to end."""
        eta, y = x @ w.T, self.target(y)
        p = self.mean(eta)
        if self.family == "classes":
            hot = (y[:, None] == np.arange(self.classes)).astype(float)
            loss = -np.log(np.maximum((p * hot).sum(1), 1e-300)).sum()
            off = (p - hot)[:, 1:]
            q = p[:, 1:]
            blocks = [[(x * ((q[:, a] * ((a == b) - q[:, b]))[:, None])).T @ x for b in range(self.rows)] for a in range(self.rows)]
            return np.concatenate(([loss], (off.T @ x).ravel(), np.block(blocks).ravel()))
        mu, e = p[:, 0], eta[:, 0]
        if self.family == "poisson":
            loss, curve = (mu - y * np.clip(e, -_FAR, _FAR)).sum(), mu
        elif self.family == "binary":
            loss, curve = (np.logaddexp(0, e) - y * e).sum(), mu * (1 - mu)
        else:
            loss, curve = 0.5 * ((y - e) ** 2).sum(), np.ones(len(y))
        return np.concatenate(([loss], x.T @ (mu - y), ((x * curve[:, None]).T @ x).ravel()))


@dataclass
class Fitted:
    """A head's weights in one fold (the intercept last), for features centred and scaled as in its training rows."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    rows: int
    label_mean: float
    loss: float = np.inf
    steps: int = 0
    converged: bool = False
    #: Where the last accepted step began, and what it was: a step that fails is halved.
    base: np.ndarray | None = None
    step: np.ndarray | None = None
    gradient: float = np.inf

    def matrix(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.nan_to_num((x - self.mean) / self.scale), np.ones(len(x))])


@dataclass
class ComponentModels:
    features: tuple[str, ...]
    heads: tuple[Head, ...]
    fitted: dict[tuple[int, str], Fitted] = field(default_factory=dict)

    def coefficients(self, fold: int, label: str) -> np.ndarray:
        """Weights on the features as they come, intercept last."""
        m = self.fitted[fold, label]
        w = m.weights[:, :-1] / m.scale
        return np.column_stack([w, m.weights[:, -1] - w @ m.mean])


def _matrix(batch: pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
    return np.column_stack([np.asarray(batch.column(c).to_numpy(zero_copy_only=False), float) for c in columns]) if columns else np.zeros((batch.num_rows, 0))


def _advance(m: Fitted, head: Head, total: np.ndarray, ridge: float, tolerance: float) -> None:
    """Take in the sums at the current weights: go on from there, or halve the step that led there."""
    size = m.weights.size
    penalty = np.full(m.weights.shape, ridge)
    penalty[:, -1] = 0
    loss = total[0] + 0.5 * (penalty * m.weights**2).sum()
    gradient = total[1 : 1 + size] + (penalty * m.weights).ravel()
    curve = total[1 + size :].reshape(size, size) + np.diag(penalty.ravel())
    m.steps += 1
    if m.base is not None and not loss <= m.loss + 1e-12 * abs(m.loss):
        m.step = m.step / 2
        if np.abs(m.step).max() < 1e-14:
            m.weights, m.converged = m.base, True
        else:
            m.weights = m.base - m.step
        return
    step = np.linalg.lstsq(curve, gradient, rcond=1e-13)[0]
    m.loss, m.gradient = loss, float(np.abs(gradient).max(initial=0.0))
    if gradient @ step <= tolerance * max(1.0, m.rows):
        m.converged = True
        return
    m.base, m.step = m.weights, step.reshape(m.weights.shape)
    m.weights = m.base - m.step


def fit(frame: DataFrame, folds: Sequence[Fold], features: Sequence[str], heads: Sequence[Head], ridge: float = 1.0, most_steps: int = 40, tolerance: float = 1e-14, time: str = "timeline") -> ComponentModels:
    """Models of all heads in all folds; one pass over the training rows a step."""
    number = lambda c: F.col(c).cast("double").alias(c)
    labels = [h.label for h in heads]
    narrow = written(fold_rows(frame.select(time, *(number(c) for c in dict.fromkeys([*features, *labels]))), folds, time).where("part = 'train'").select("fold", *dict.fromkeys([*features, *labels])))
    spread = lambda c: F.coalesce(F.stddev_pop(F.when(~F.isnan(c), F.col(c))), F.lit(0.0)).alias(f"s_{c}")
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    described = narrow.groupBy("fold").agg(
        *(F.coalesce(F.avg(known(c)), F.lit(0.0)).alias(f"m_{c}") for c in features),
        *(spread(c) for c in features),
        *(f(F.when(F.lit(h.family == "binary"), (F.col(h.label) > 0).cast("double")).otherwise(F.col(h.label))).alias(f"{n}_{h.label}") for h in heads for n, f in (("a", F.avg), ("lo", F.min), ("hi", F.max), ("n", F.count))),
    )
    models = ComponentModels(tuple(features), tuple(heads))
    for r in described.collect():  # one row a fold
        scale = np.array([r[f"s_{c}"] or 1.0 for c in features])
        for h in heads:
            if not r[f"n_{h.label}"] or r[f"lo_{h.label}"] == r[f"hi_{h.label}"]:
                continue
            w = np.zeros((h.rows, len(features) + 1))
            average = float(r[f"a_{h.label}"])
            if h.family in ("poisson", "squared"):
                w[0, -1] = np.log(max(average, 1e-6)) if h.family == "poisson" else average
            models.fitted[r.fold, h.label] = Fitted(np.array([r[f"m_{c}"] for c in features]), scale, w, r[f"n_{h.label}"], average)
    for _ in range(most_steps):
        open_now = {k: m for k, m in models.fitted.items() if not m.converged}
        if not open_now:
            break
        for key, total in _pass(narrow, models, open_now).items():
            _advance(models.fitted[key], next(h for h in heads if h.label == key[1]), total, ridge, tolerance)
    return models


def _pass(narrow: DataFrame, models: ComponentModels, open_now: dict[tuple[int, str], Fitted]) -> dict[tuple[int, str], np.ndarray]:
    """The sums of every open fold and head over the training rows."""
    features, heads = models.features, models.heads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            x, fold = _matrix(batch, features), batch.column("fold").to_numpy(zero_copy_only=False)
            for f in np.unique(fold).tolist():
                for k, h in enumerate(heads):
                    m = open_now.get((f, h.label))
                    if m is None:
                        continue
                    y = np.asarray(batch.column(h.label).to_numpy(zero_copy_only=False), float)
                    at = (fold == f) & ~np.isnan(y)
                    got = h.sums(m.matrix(x[at]), y[at], m.weights)
                    totals[f, k] = totals[f, k] + got if (f, k) in totals else got
        keys = list(totals)
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in keys], pa.int32()), pa.array([k for _, k in keys], pa.int32()), pa.array([totals[k].tolist() for k in keys], pa.list_(pa.float64()))], ["fold", "head", "sums"])

    parts = narrow.mapInArrow(run, "fold int, head int, sums array<double>").select("fold", "head", F.posexplode("sums").alias("i", "v"))
    out: dict[tuple[int, str], np.ndarray] = {}
    for r in parts.groupBy("fold", "head", "i").agg(F.sum("v").alias("v")).collect():  # folds x heads x weights squared numbers
        key = (r.fold, heads[r.head].label)
        if key not in out:
            size = open_now[key].weights.size
            out[key] = np.zeros(1 + size + size * size)
        out[key][r.i] = r.v
    return out


def predict(frame: DataFrame, folds: Sequence[Fold], models: ComponentModels, time: str = "timeline") -> DataFrame:
    """Validation rows of every fold with the heads' predictions; null where a fold has no model of a label."""
    return predicted(fold_rows(frame, folds, time).where("part = 'validate'"), models)


def predicted(rows: DataFrame, models: ComponentModels) -> DataFrame:
    """Rows with a column ``fold`` (the model's) and the heads' predictions."""
    features, heads = models.features, models.heads
    names = [c for h in heads for c in h.outputs]
    inputs = {c: f"_x{k}" for k, c in enumerate(features)}
    ready = rows.withColumns({x: F.col(c).cast("double") for c, x in inputs.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, fold = _matrix(batch, list(inputs.values())), batch.column("fold").to_numpy(zero_copy_only=False)
            out = {n: np.full(batch.num_rows, np.nan) for n in names}
            for f in np.unique(fold).tolist():
                at = fold == f
                for h in heads:
                    m = models.fitted.get((f, h.label))
                    if m is not None:
                        for n, p in zip(h.outputs, h.mean(m.matrix(x[at]) @ m.weights.T).T, strict=True):
                            out[n][at] = p
            kept = [c for c in batch.schema.names if c not in inputs.values()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(out[n], from_pandas=True) for n in names)], [*kept, *names])

    return ready.mapInArrow(run, StructType([*rows.schema.fields, *(StructField(n, DoubleType()) for n in names)]))


def class_log_loss(chances: Sequence[Column], truth: Column) -> Column:
    """Minus the logarithm of the chance given to what took place."""
    taken = F.element_at(F.array(*chances), (truth + 1).cast("int"))
    return -F.log(F.least(F.greatest(taken, F.lit(LEAST_CHANCE)), F.lit(1.0)))


def brier(chances: Sequence[Column], truth: Column) -> Column:
    """Squared distance of the chances from what took place."""
    parts = [(p - F.when(truth == k, 1.0).otherwise(0.0)) ** 2 for k, p in enumerate(chances)]
    return sum(parts[1:], parts[0])


def reconciled_states(minutes: Column, p_start: Column) -> list[Column]:
    """Chances of no, a short and a long appearance, from expected minutes and the chance to start: what the class head must beat."""
    # 90, 70, 60 and 30 minutes, and the shares 0.9 and 0.1.
    mean, start = F.greatest(F.lit(0.0), F.least(minutes, F.lit(90.0))), F.greatest(F.lit(0.0), F.least(p_start, F.lit(1.0)))
    plays = F.greatest(start, F.least(F.lit(1.0), mean / 70.0))
    long = F.greatest(F.lit(0.0), F.least(plays, start * 0.9 + F.greatest(F.lit(0.0), (mean - 60.0) / 30.0) * 0.1))
    return [1 - plays, plays - long, long]


def fold_reports(rows: DataFrame, models: ComponentModels) -> DataFrame:
    """fold, label, train_rows, rows, mae, baseline_mae, loss, predicted_sd, predicted_mean and actual_mean of each head but class ones.

    ``baseline_mae`` is of predicting the mean of training; ``loss`` is the deviance of counts, the log loss of events, else the squared error.
    """
    out = None
    for h in models.heads:
        if h.family == "classes":
            continue
        y = F.when(F.lit(h.family == "binary"), (F.col(h.label) > 0).cast("double")).otherwise(F.col(h.label).cast("double"))
        p = F.greatest(F.col(h.outputs[0]), F.lit(0.0)) if h.family == "squared" else F.col(h.outputs[0])
        loss = poisson_deviance(p, y) if h.family == "poisson" else log_loss(p, y) if h.family == "binary" else (y - p) ** 2
        of = {f: m for (f, label), m in models.fitted.items() if label == h.label}
        if not of:
            continue
        fixed = lambda g: F.create_map(*[F.lit(v) for f, m in of.items() for v in (f, g(m))])[F.col("fold")]
        known = rows.where(F.col(h.label).isNotNull() & F.col(h.outputs[0]).isNotNull())
        part = known.groupBy("fold").agg(
            F.lit(h.label).alias("label"),
            F.first(fixed(lambda m: int(m.rows))).alias("train_rows"),
            F.count(F.lit(1)).alias("rows"),
            F.avg(F.abs(p - y)).alias("mae"),
            F.avg(F.abs(fixed(lambda m: float(m.label_mean)) - y)).alias("baseline_mae"),
            F.avg(loss).alias("loss"),
            F.stddev_pop(p).alias("predicted_sd"),
            F.avg(p).alias("predicted_mean"),
            F.avg(y).alias("actual_mean"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def state_reports(rows: DataFrame, state: Head, minutes: str, starts: str) -> DataFrame:
    """fold, rows, log_loss, brier, baseline_log_loss, baseline_brier and share_0.. of a class head, beside states made of two other heads."""
    truth, mine = F.col(state.label).cast("int"), [F.col(c) for c in state.outputs]
    other = reconciled_states(F.greatest(F.col(f"predicted_{minutes}"), F.lit(0.0)), F.col(f"predicted_{starts}"))
    known = rows.where(truth.isNotNull() & mine[0].isNotNull() & F.col(f"predicted_{minutes}").isNotNull() & F.col(f"predicted_{starts}").isNotNull())
    return known.groupBy("fold").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(class_log_loss(mine, truth)).alias("log_loss"),
        F.avg(brier(mine, truth)).alias("brier"),
        F.avg(class_log_loss(other, truth)).alias("baseline_log_loss"),
        F.avg(brier(other, truth)).alias("baseline_brier"),
        *(F.avg((truth == k).cast("double")).alias(f"share_{k}") for k in range(state.classes)),
    )

"""Scoring any number of feature sets from one matrix of moments.

The training rows of all folds are cut at the folds' bounds into stretches of time, and each row adds to the
moments of the one stretch that it lies in: sums and products of all candidate columns, their presence
and the label, in one pass. A fold's moments are the sum of its stretches', and the ridge regression of any
set of columns is solved from their sub-block, missing values at the fold's mean included. Then one pass over the validation
rows scores as many sets as there are. A search makes one such pass a step, whatever the number of candidates.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from chronofold.plans.evaluate import FoldModel
from chronofold.plans.folds import Fold, fold_rows
from chronofold.sources.scratch import written


def _columns(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    return np.column_stack([np.asarray(batch.column(c).to_numpy(zero_copy_only=False), float) for c in names]) if names else np.zeros((batch.num_rows, 0))


class MomentScorer:
    """MAE of feature sets over the same folds; a set is scored once, in whatever order its columns come.

    ``columns`` are all that any set may hold, ``keep`` further ones that ``predictions`` returns.
    ``moment_jobs`` and ``score_jobs`` count the passes made.
    """

    def __init__(self, frame: DataFrame, folds: Sequence[Fold], label: str, columns: Sequence[str], keep: Sequence[str] = (), ridge: float = 1.0, time: str = "timeline") -> None:
        self.folds, self.label, self.time, self.ridge = list(folds), label, time, ridge
        self.columns, self.keep = tuple(dict.fromkeys(columns)), tuple(c for c in keep if c not in (time, label))
        number = lambda c: F.col(c).cast("double").alias(c)
        self.rows = written(frame.select(F.col(time).cast("long").alias(time), number(label), *(F.col(c) for c in self.keep if c not in self.columns), *(number(c) for c in self.columns if c != label)))
        self.known: dict[tuple[str, ...], dict[int, tuple[int, float, float]]] = {}
        self.moment_jobs = self.score_jobs = 0
        self._folds_moments: dict[int, np.ndarray] | None = None
        self._shift: np.ndarray | None = None

    def _moments(self) -> dict[int, np.ndarray]:
        """Each fold's products of (1, label, presences, values), values less a common shift."""
        if self._folds_moments is not None:
            return self._folds_moments
        known = lambda c: F.when(~F.isnan(c), F.col(c))
        about = self.rows.agg(*(F.coalesce(F.avg(known(c)), F.lit(0.0)) for c in [self.label, *self.columns])).first()
        self._shift = shift = np.array(list(about), float)
        cuts = sorted({b for f in self.folds for b in (f.train[0], f.train[1] + 1)})
        time, names = self.time, [self.label, *self.columns]
        size = 2 + 2 * len(self.columns)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                values = _columns(batch, names) - shift
                stretch = np.searchsorted(np.array(cuts), batch.column(time).to_numpy(zero_copy_only=False), side="right")
                for s in np.unique(stretch).tolist():
                    at = (stretch == s) & ~np.isnan(values[:, 0])
                    here = ~np.isnan(values[at, 1:])
                    z = np.column_stack([np.ones(at.sum()), values[at, 0], here.astype(float), np.nan_to_num(values[at, 1:])])
                    sums[s] = sums.get(s, 0) + z.T @ z
            keys = list(sums)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([sums[k].ravel().tolist() for k in keys], pa.list_(pa.float64()))], ["stretch", "m"])

        parts = self.rows.mapInArrow(run, "stretch int, m array<double>").select("stretch", F.posexplode("m").alias("i", "v"))
        self.moment_jobs += 1
        stretches: dict[int, np.ndarray] = {}
        for r in parts.groupBy("stretch", "i").agg(F.sum("v").alias("v")).collect():  # folds x columns squared numbers
            stretches.setdefault(r.stretch, np.zeros(size * size))[r.i] = r.v
        empty = np.zeros(size * size)
        out = {}
        for f in self.folds:
            inside = range(bisect_right(cuts, f.train[0]), bisect_right(cuts, f.train[1]) + 1)
            out[f.index] = sum((stretches.get(s, empty) for s in inside), empty).reshape(size, size)
        self._folds_moments = out
        return out

    def models(self, features: Sequence[str]) -> list[FoldModel]:
        """The set's ridge regression in every fold that has training rows."""
        where = np.array([self.columns.index(c) for c in features], int)
        k, out = len(self.columns), []
        for index, m in self._moments().items():
            n = m[0, 0]
            if not n:
                continue
            here, value = 2 + where, 2 + k + where
            count, total, y = m[0, here], m[0, value], m[0, 1] / n
            mean = np.divide(total, count, out=-self._shift[1 + where], where=count > 0)
            # Products of what is present, both sides less their means.
            both, half = m[np.ix_(value, value)], m[np.ix_(value, here)]
            gram = both - half * mean[None, :] - half.T * mean[:, None] + np.outer(mean, mean) * m[np.ix_(here, here)]
            cross = m[value, 1] - mean * m[here, 1] - y * (total - mean * count)
            weights = np.linalg.solve(gram + self.ridge * np.eye(len(where)), cross) if len(where) else np.zeros(0)
            out.append(FoldModel(index, mean + self._shift[1 + where], weights, float(y + self._shift[0])))
        return sorted(out, key=lambda f: f.fold)

    def _weights(self, sets: Sequence[tuple[str, ...]]) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
        """Of each fold: the columns' means, their weights (columns x sets) and the label's mean."""
        out: dict[int, tuple[np.ndarray, np.ndarray, float]] = {}
        for j, s in enumerate(sets):
            where = [self.columns.index(c) for c in s]
            for f in self.models(s):
                mean, weights, _ = out.setdefault(f.fold, (np.zeros(len(self.columns)), np.zeros((len(self.columns), len(sets))), f.intercept))
                mean[where], weights[where, j] = f.mean, f.weights
        return out

    def many(self, sets: Sequence[Sequence[str]]) -> list[float]:
        """MAE of each set, weighted by rows; those not known yet are scored in one pass."""
        keys = [tuple(sorted(set(s))) for s in sets]
        new = [k for k in dict.fromkeys(keys) if k not in self.known]
        if new:
            self._score(new)
        out = []
        for k in keys:
            rows = sum(n for n, _, _ in self.known[k].values())
            out.append(sum(n * mae for n, mae, _ in self.known[k].values()) / rows if rows else float("inf"))
        return out

    def __call__(self, features: Sequence[str]) -> float:
        return self.many([features])[0]

    def by_fold(self, features: Sequence[str]) -> dict[int, tuple[int, float, float]]:
        """Fold -> validation rows, MAE, and MAE of the mean of training."""
        self.many([features])
        return self.known[tuple(sorted(set(features)))]

    def _score(self, sets: list[tuple[str, ...]]) -> None:
        fitted, columns, label = self._weights(sets), self.columns, self.label

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                fold = batch.column("fold").to_numpy(zero_copy_only=False)
                x, y = _columns(batch, columns), _columns(batch, [label])[:, 0]
                for f in np.unique(fold).tolist():
                    if f not in fitted:
                        continue
                    mean, weights, intercept = fitted[f]
                    at = (fold == f) & ~np.isnan(y)
                    errors = np.abs(intercept + np.nan_to_num(x[at] - mean) @ weights - y[at, None]).sum(0)
                    got = np.concatenate(([at.sum(), np.abs(intercept - y[at]).sum()], errors))
                    sums[f] = sums.get(f, 0) + got
            keys = list(sums)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([sums[k].tolist() for k in keys], pa.list_(pa.float64()))], ["fold", "m"])

        rows = fold_rows(self.rows, self.folds, self.time).where("part = 'validate'")
        parts = rows.mapInArrow(run, "fold int, m array<double>").select("fold", F.posexplode("m").alias("i", "v"))
        self.score_jobs += 1
        got: dict[int, dict[int, float]] = {}
        for r in parts.groupBy("fold", "i").agg(F.sum("v").alias("v")).collect():  # folds x sets numbers
            got.setdefault(r.fold, {})[r.i] = r.v
        for j, s in enumerate(sets):
            self.known[s] = {f: (int(v[0]), v[2 + j] / v[0], v[1] / v[0]) for f, v in sorted(got.items()) if v[0]}

    def predictions(self, sets: dict[str, Sequence[str]]) -> DataFrame:
        """Validation rows of every fold (fold, time, label, ``keep``) with a column for each named set's prediction."""
        names, fitted, columns = list(sets), self._weights([tuple(s) for s in sets.values()]), self.columns
        kept = [self.time, self.label, *self.keep]
        inputs = [f"_x{k}" for k in range(len(columns))]
        rows = fold_rows(self.rows, self.folds, self.time).where("part = 'validate'").select("fold", *kept, *(F.col(c).alias(x) for c, x in zip(columns, inputs, strict=True)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fold, x = batch.column("fold").to_numpy(zero_copy_only=False), _columns(batch, inputs)
                out = np.full((batch.num_rows, len(names)), np.nan)
                for f in np.unique(fold).tolist():
                    if f in fitted:
                        mean, weights, intercept = fitted[f]
                        out[fold == f] = intercept + np.nan_to_num(x[fold == f] - mean) @ weights
                yield pa.RecordBatch.from_arrays([batch.column("fold"), *(batch.column(c) for c in kept), *(pa.array(c, from_pandas=True) for c in out.T)], ["fold", *kept, *names])

        schema = StructType([f for f in rows.schema.fields if f.name not in inputs] + [StructField(n, DoubleType()) for n in names])
        return rows.mapInArrow(run, schema)

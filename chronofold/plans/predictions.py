"""Fold predictions that are kept: fitted once for a fold, a feature set and the facts that they came from.

A fold's predictions are a table whose name is a hash of all that decides them: the fold's bounds, label, sorted
columns, model, and a manifest of the facts. A manifest is a sum of row hashes for each column, taken in one pass over
stretches of time between the folds' bounds, so it doesn't depend on the order of rows or on partitions; a fold is named
by its own stretches only. So facts that come later leave earlier folds' predictions good, a changed fact
makes just those folds be fitted that hold it, and a column counts only for sets that use it.

Tables get their names when complete and never over another one, so any number of runs may share a store.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.plans.folds import Fold
from chronofold.plans.moments import MomentScorer
from chronofold.sources import files


def manifests(frame: DataFrame, folds: Sequence[Fold], columns: Sequence[str], row_key: Sequence[str], time: str = "timeline") -> dict[int, dict[str, list]]:
    """Fold -> column -> rows and hash sums of its training and its validation part."""
    cuts = sorted({b for f in folds for low, high in (f.train, f.validate) for b in (low, high + 1)})
    stretch = F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c <= F.col(time))).alias("stretch")
    total = lambda c, k: F.sum(F.xxhash64(F.lit(k), F.col(time), *(F.col(r) for r in row_key), F.col(c)).cast("decimal(38,0)"))
    sums = frame.where(F.col(time).isNotNull()).groupBy(stretch).agg(F.count(F.lit(1)).alias("n"), *(total(c, k).alias(f"{k}_{i}") for i, c in enumerate(columns) for k in (0, 1)))
    rows = {r.stretch: r for r in sums.collect()}  # one row a stretch

    def part(bounds: tuple[int, int], i: int) -> list:
        low, high = bounds
        inside = [r for s, r in rows.items() if s > cuts.index(low) and s <= cuts.index(high + 1)]
        return [sum(r.n for r in inside), *(str(sum(int(r[f"{k}_{i}"]) for r in inside)) for k in (0, 1))]

    return {f.index: {c: [part(f.train, i), part(f.validate, i)] for i, c in enumerate(columns)} for f in folds}


class PredictionStore:
    """Predictions below ``path``; ``fits`` and ``reads`` count the (fold, set) pairs fitted and found."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.fits = self.reads = 0

    def name(self, fold: Fold, facts: dict[str, list], columns: Sequence[str], label: str, row_key: Sequence[str], model: str) -> str:
        """The table's name for one fold and set."""
        used = sorted({*columns, label})
        said = {"fold": [fold.train, fold.validate], "columns": sorted(set(columns)), "label": label, "key": list(row_key), "model": model, "facts": {c: facts[c] for c in used}}
        return hashlib.sha256(json.dumps(said, sort_keys=True).encode()).hexdigest()

    def predictions(self, frame: DataFrame, folds: Sequence[Fold], label: str, sets: dict[str, Sequence[str]], row_key: Sequence[str], ridge: float = 1.0, time: str = "timeline") -> DataFrame:
        """set, fold, time, row key, label and predicted of every validation row; only pairs of fold and set that aren't there are fitted, all of them at once."""
        columns = list(dict.fromkeys(c for s in sets.values() for c in s))
        facts = manifests(frame, folds, list(dict.fromkeys([*columns, label])), row_key, time)
        model = f"ridge:{ridge}"
        wanted = {(f.index, s): self.name(f, facts[f.index], cs, label, row_key, model) for f in folds for s, cs in sets.items()}
        there = set(files.names(self.spark, self.path))
        missing = {k: n for k, n in wanted.items() if n not in there}
        self.reads += len(wanted) - len(missing)
        self.fits += len(missing)
        if missing:
            self._fit(frame, [f for f in folds if any(f.index == i for i, _ in missing)], label, {s: sets[s] for _, s in missing}, row_key, ridge, time, missing)
        out = None
        kinds = {n: t for n, t in frame.dtypes}
        schema = ", ".join(["fold int", f"`{time}` long", *(f"`{k}` {kinds[k]}" for k in row_key if k != time), f"`{label}` double", "predicted double"])
        for s in sets:
            paths = [f"{self.path}/{wanted[f.index, s]}" for f in folds]
            part = self.spark.read.schema(schema).parquet(*paths).withColumn("set", F.lit(s))
            out = part if out is None else out.unionByName(part)
        return out

    def _fit(self, frame: DataFrame, folds: Sequence[Fold], label: str, sets: dict[str, Sequence[str]], row_key: Sequence[str], ridge: float, time: str, missing: dict[tuple[int, str], str]) -> None:
        columns = list(dict.fromkeys(c for s in sets.values() for c in s))
        scorer = MomentScorer(frame, folds, label, columns, keep=row_key, ridge=ridge, time=time)
        labels = {f"p{k}": s for k, s in enumerate(sets)}
        wide = scorer.predictions({p: sets[s] for p, s in labels.items()})
        kept = [time, *(k for k in row_key if k != time), label]
        pairs = F.explode(F.array(*(F.struct(F.lit(s).alias("set"), F.col(p).alias("predicted")) for p, s in labels.items()))).alias("_p")
        long = wide.select("fold", *kept, pairs).select("fold", *kept, "_p.predicted", "_p.set")
        names = F.create_map(*[F.lit(v) for (f, s), n in missing.items() for v in (f"{f}:{s}", n)])
        staged = f"{self.path}/.staged-{uuid.uuid4().hex}"
        named = long.withColumn("name", names[F.concat_ws(":", F.col("fold").cast("string"), "set")]).where("name IS NOT NULL").drop("set")
        named.write.partitionBy("name").parquet(staged)
        for name in missing.values():
            part = f"{staged}/name={name}"
            if not files.exists(self.spark, part):  # a fold without validation rows
                named.drop("name").limit(0).write.parquet(part)
            files.publish_folder(self.spark, part, f"{self.path}/{name}")
        files.remove(self.spark, staged)

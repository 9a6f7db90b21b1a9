"""Walk-forward folds over a timeline."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Fold:
    index: int
    train: tuple[int, int]
    validate: tuple[int, int]


def walk_forward(times: Sequence[int], train: int, validate: int, embargo: int = 0, step: int | None = None, sliding: bool = False) -> list[Fold]:
    """Folds whose validation lies strictly after their training and an embargo; times must rise."""
    if any(b <= a for a, b in zip(times, times[1:], strict=False)):
        raise ValueError("times must rise strictly")
    if train < 1 or validate < 1 or embargo < 0:
        raise ValueError("sizes must be positive")
    out, end = [], train
    while end + embargo + validate <= len(times):
        first = end - train if sliding else 0
        out.append(Fold(len(out), (times[first], times[end - 1]), (times[end + embargo], times[end + embargo + validate - 1])))
        end += step or validate
    return out


def split(frame: DataFrame, fold: Fold, time: str = "timeline", holdout: Sequence[str] = (), season: str = "season") -> tuple[DataFrame, DataFrame]:
    """Training and validation rows of a fold, without the seasons held out."""
    kept = frame.where(~F.col(season).isin(*holdout)) if holdout else frame
    return kept.where(F.col(time).between(*fold.train)), kept.where(F.col(time).between(*fold.validate))


def fold_rows(frame: DataFrame, folds: Sequence[Fold], time: str = "timeline") -> DataFrame:
    """Every row once for each fold and part it is in: one plan for all folds."""
    table = frame.sparkSession.createDataFrame([(f.index, part, *r) for f in folds for part, r in (("train", f.train), ("validate", f.validate))], "fold int, part string, low long, high long")
    return frame.join(F.broadcast(table), F.col(time).between(F.col("low"), F.col("high"))).drop("low", "high")

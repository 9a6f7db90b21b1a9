"""Rolling aggregates as of a time, shrunken rates and the declared catalogue of them.

What is to be known of the newest w facts at a cutoff is a frame of w rows that ends at the newest
visible fact. So aggregates are computed once along each key's history, all windows and columns over one
sort, and cutoffs pick them up by one as-of join; the catalogue's many aggregates are computed where the cutoffs themselves
stand in the history. Nothing fans out, and neither the number of specs nor the longest window adds a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from chronofold.operators.asof import asof_join

AGGREGATES = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_samp, "count": F.count}


def history_frame(entity_keys: Sequence[str], available_time: str, order_col: str | None, columns: Sequence[str]) -> WindowSpec:
    """A key's history, oldest first; ties by ``order_col``, then by every other column."""
    ties = [F.col(order_col).asc_nulls_first()] if order_col else []
    rest = [c for c in columns if c not in (available_time, order_col, *entity_keys)]
    return Window.partitionBy(*entity_keys).orderBy(F.col(available_time).asc_nulls_first(), *ties, *(F.col(c).asc_nulls_first() for c in rest))


def last_rows(history: WindowSpec, window: int) -> WindowSpec:
    return history.rowsBetween(-(window - 1), Window.currentRow)


def aggregate(c: Column, how: str, frame: WindowSpec, min_periods: int = 1) -> Column:
    """An aggregate over the frame, null below ``min_periods`` values."""
    if how == "median":
        values = F.array_sort(F.collect_list(c).over(frame))
        n = F.size(values)
        value = F.when(n > 0, (F.element_at(values, F.floor((n + 1) / 2).cast("int")) + F.element_at(values, F.ceil((n + 1) / 2).cast("int"))) / 2)
    else:
        value = AGGREGATES[how](c).over(frame)
    return F.when(F.count(c).over(frame) >= min_periods, value)


def shrunk(numerator: Column, denominator: Column, frame: WindowSpec, prior_strength: float, scale: float, prior_value: float = 0.0) -> Column:
    """(sum of numerator + prior) / (sum of denominator + prior mass) * scale; no values count as zero."""
    num, den = F.coalesce(F.sum(numerator).over(frame), F.lit(0.0)), F.coalesce(F.sum(denominator).over(frame), F.lit(0.0))
    return F.try_divide(num + prior_value * prior_strength, den + prior_strength * scale) * scale


def attach(entities: DataFrame, source: DataFrame, features: dict[str, Column], entity_keys: Sequence[str], history: WindowSpec, *, prediction_time: str = "prediction_timestamp", available_time: str = "available_time", strict: bool = False) -> DataFrame:
    """Entity rows with expressions over ``history``, as they stood at the newest visible fact."""
    clash = [n for n in features if n in entities.columns]
    if clash:
        raise ValueError(f"already on the entities: {clash}")
    # The place in history comes first among the values, so facts of one time count in that order.
    place = F.row_number().over(history).alias("_place")
    states = source.select(*entity_keys, F.col(available_time).alias("_state_time"), place, *(c.alias(n) for n, c in features.items()))
    out = asof_join(entities, states, entity_keys, prediction_time=prediction_time, available_time="_state_time", strict=strict)
    return out.drop("_state_time", "_place")


def rolling_as_of(entities: DataFrame, source: DataFrame, entity_keys: Sequence[str], aggregations: dict[str, tuple[str, str]], *, window: int, min_periods: int = 1, order_col: str | None = None, prediction_time: str = "prediction_timestamp", available_time: str = "available_time") -> DataFrame:
    """``aggregations`` maps an output name to (column, aggregate) over the newest ``window`` visible facts."""
    history = history_frame(entity_keys, available_time, order_col, source.columns)
    frame = last_rows(history, window)
    features = {name: aggregate(F.col(c) if how == "count" else F.col(c).cast("double"), how, frame, min_periods) for name, (c, how) in aggregations.items()}
    return attach(entities, source, features, entity_keys, history, prediction_time=prediction_time, available_time=available_time)


def shrunk_rate_as_of(entities: DataFrame, source: DataFrame, entity_keys: Sequence[str], *, numerator: str, denominator: str, window: int, prior_strength: float, output: str, prior_value: float | None = None, scale: float = 90.0, order_col: str | None = None, prediction_time: str = "prediction_timestamp", available_time: str = "available_time") -> DataFrame:
    """A rate over the newest ``window`` visible facts, drawn to a prior by how little was seen; the prior where nothing was.

    Without ``prior_value`` the prior is the pooled rate of all rows' windows at the same cutoff, so a
    table of several cutoffs never lends later facts to earlier rows.
    """
    if prior_strength < 0:
        raise ValueError("prior_strength must not be negative")
    history = history_frame(entity_keys, available_time, order_col, source.columns)
    frame = last_rows(history, window)
    sums = {"_num": F.sum(F.col(numerator).cast("double")).over(frame), "_den": F.sum(F.col(denominator).cast("double")).over(frame)}
    out = attach(entities, source, sums, entity_keys, history, prediction_time=prediction_time, available_time=available_time)
    if prior_value is None:
        pooled = out.groupBy(F.col(prediction_time).alias("_cut")).agg(F.sum("_num").alias("_n"), F.sum("_den").alias("_d")).select("_cut", F.when(F.col("_d") > 0, F.col("_n") / F.col("_d") * scale).otherwise(0.0).alias("_prior"))
        out = out.join(pooled, out[prediction_time].eqNullSafe(pooled["_cut"]), "left").drop("_cut")
    else:
        out = out.withColumn("_prior", F.lit(float(prior_value)))
    rate = F.try_divide(F.coalesce("_num", F.lit(0.0)) + F.col("_prior") * prior_strength, F.coalesce("_den", F.lit(0.0)) + prior_strength * scale) * scale
    return out.withColumn(output, F.coalesce(F.when(F.col("_num").isNull() & F.col("_den").isNull(), F.col("_prior")).otherwise(rate), F.col("_prior"))).drop("_num", "_den", "_prior")


@dataclass(frozen=True)
class FeatureSpec:
    """One declared aggregate: ``how`` of a column over the newest ``window`` facts, or a shrunken rate."""

    name: str
    column: str
    window: int
    how: str
    min_periods: int = 1
    denominator: str | None = None
    prior_strength: float = 3.0
    scale: float = 90.0
    family: str = ""


class _Newest:
    """Values of the newest facts of some entity rows, and what is summed up of them, in the order that facts came in."""

    def __init__(self, values: np.ndarray, known: np.ndarray, ends: np.ndarray, seen: np.ndarray, longest: int, columns: Sequence[str]) -> None:
        self.seen, self.at = seen, {c: i for i, c in enumerate(columns)}
        back = np.arange(longest)
        rows = np.maximum(ends[:, None] - 1 - back, 0).T
        self.known = known[rows] & (back[:, None] < seen)[:, :, None] if len(values) else np.zeros((longest, len(ends), len(columns)), bool)
        self.values = np.where(self.known, values[rows] if len(values) else 0.0, 0.0)
        self.sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def total(self, column: str, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Sum and number of values."""
        if window not in self.sums:
            total = np.zeros(self.values.shape[1:])
            for j in reversed(range(window)):
                total = total + self.values[j]
            self.sums[window] = total, self.known[:window].sum(0)
        i = self.at[column]
        return tuple(x[:, i] for x in self.sums[window])

    def each(self, column: str, window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Values and whether they are there, oldest first."""
        i = self.at[column]
        return ((self.values[j, :, i], self.known[j, :, i]) for j in reversed(range(window)))

    def extreme(self, column: str, window: int, how: str) -> np.ndarray:
        out, had = np.zeros(len(self.seen)), np.zeros(len(self.seen), bool)
        for x, there in self.each(column, window):
            # A value that is no number is above all others.
            better = (x > out) | np.isnan(x) if how == "max" else (x < out) | np.isnan(out)
            out, had = np.where(there & (better | ~had), x, out), had | there
        return out

    def spread(self, column: str, window: int) -> np.ndarray:
        n, mean, squares = (np.zeros(len(self.seen)) for _ in range(3))
        for x, there in self.each(column, window):
            step = x - mean
            part = step / (n + 1)
            n, mean, squares = n + there, np.where(there, mean + part, mean), np.where(there, squares + step * (step - part), squares)
        return np.sqrt(squares / (n - 1))

    def median(self, column: str, window: int) -> np.ndarray:
        i = self.at[column]
        x, there = self.values[:window, :, i], self.known[:window, :, i]
        ranked = np.take_along_axis(x, np.lexsort((x, ~there), axis=0), 0)
        n, row = there.sum(0), np.arange(len(self.seen))
        return (ranked[np.maximum((n + 1) // 2 - 1, 0), row] + ranked[np.minimum(n // 2, window - 1), row]) / 2

    def of(self, s: FeatureSpec) -> tuple[np.ndarray, np.ndarray]:
        """The aggregate of each row, and where it is null."""
        total, n = self.total(s.column, s.window)
        none = self.seen == 0
        if s.how == "shrunk_rate":
            below = self.total(s.denominator, s.window)[0] + s.prior_strength * s.scale
            return total / below * s.scale, none | (below == 0)
        none = none | (n < s.min_periods)
        if s.how == "count":
            return n, none
        none = none | (n < (2 if s.how == "std" else 1))
        if s.how in ("max", "min"):
            return self.extreme(s.column, s.window, s.how), none
        return {"sum": lambda: total, "mean": lambda: total / n, "std": lambda: self.spread(s.column, s.window), "median": lambda: self.median(s.column, s.window)}[s.how](), none


def build_catalogue(entities: DataFrame, source: DataFrame, specs: Sequence[FeatureSpec], entity_keys: Sequence[str], *, order_col: str | None = "kickoff_time", prediction_time: str = "prediction_timestamp", available_time: str = "available_time") -> DataFrame:
    """All declared aggregates of every entity row; rates without any history are 0.

    Entity rows stand among the facts of their key, in order: only the columns that are summed up are sorted and shuffled, and the
    aggregates, of which there may be hundreds, are taken in arrays and only where an entity row stands.
    """
    needed = {c for s in specs for c in (s.column, s.denominator) if c}
    missing = sorted(needed - set(source.columns))
    if missing:
        raise KeyError(f"the history has no {missing}")
    clash = [s.name for s in specs if s.name in entities.columns]
    if clash:
        raise ValueError(f"already on the entities: {clash}")
    values = list(dict.fromkeys([*([order_col] if order_col else []), *sorted(needed)]))
    keys = [f"_k{i}" for i in range(len(entity_keys))]
    named = [F.col(c).alias(k) for c, k in zip(entity_keys, keys, strict=True)]
    facts = source
    for c in entity_keys:
        facts = facts.where(F.col(c).isNotNull())
    facts = facts.select(*named, F.col(available_time).alias("_t"), F.lit(0).alias("_side"), *values, F.lit(None).cast(entities.schema).alias("_row"))
    rows = entities.select(*named, F.col(prediction_time).alias("_t"), F.lit(1).alias("_side"), *(F.lit(None).cast(facts.schema[c].dataType).alias(c) for c in values), F.struct(*entities.columns).alias("_row"))
    # Entity rows stand behind the facts of their time, and know how many facts of their key came before; without a dated one they see none.
    order = Window.partitionBy(*keys).orderBy(F.col("_t").asc_nulls_first(), "_side", *(F.col(c).asc_nulls_first() for c in values if c != available_time)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fact = F.col("_side") == 0
    dated = F.count(F.when(fact, F.col("_t"))).over(order)
    seen = facts.unionByName(rows).withColumn("_seen", F.when(dated > 0, F.count(F.when(fact, 1)).over(order)).otherwise(0))
    longest, columns, names = max((s.window for s in specs), default=1), sorted(needed), entities.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = np.zeros((0, len(columns))), np.zeros((0, len(columns)), bool)
        for batch in batches:
            entity = batch.column("_side").to_numpy(zero_copy_only=False) == 1
            come = [batch.column(f"_v{i}").filter(pa.array(~entity)) for i in range(len(columns))]
            held = np.concatenate([held, np.column_stack([np.asarray(c.to_numpy(zero_copy_only=False), float) for c in come])])
            known = np.concatenate([known, np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in come])])
            ends = (len(held) - (~entity).sum() + np.cumsum(~entity))[entity]
            with np.errstate(all="ignore"):
                newest = _Newest(held, known, ends, batch.column("_seen").to_numpy(zero_copy_only=False)[entity], longest, columns)
                found = [pa.array(x, pa.int64() if s.how == "count" else pa.float64(), mask=none) for s in specs for x, none in [newest.of(s)]]
            row = batch.column("_row").filter(pa.array(entity))
            yield pa.RecordBatch.from_arrays([row, *found], ["_row", *(s.name for s in specs)])
            held, known = held[-longest:], known[-longest:]

    schema = StructType([StructField("_row", entities.schema), *(StructField(s.name, LongType() if s.how == "count" else DoubleType()) for s in specs)])
    sent = seen.select("_side", "_seen", "_row", *(F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)))
    out = sent.mapInArrow(run, schema).select(*(F.col(f"_row.`{c}`").alias(c) for c in names), *(s.name for s in specs))
    rates = [s.name for s in specs if s.how == "shrunk_rate"]
    return out.withColumns({n: F.coalesce(n, F.lit(0.0)) for n in rates}) if rates else out

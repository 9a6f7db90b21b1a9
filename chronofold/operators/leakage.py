"""Mechanical leakage checks: rebuild with future records and see whether anything moved."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Builder = Callable[[DataFrame, DataFrame], DataFrame]


class LeakageError(AssertionError):
    """Features changed when records from after the cutoff were added."""


def find_leakage(entities: DataFrame, source: DataFrame, future: DataFrame, build: Builder, row_key: Sequence[str], tolerance: float = 1e-9) -> list[str]:
    """Columns whose values differ with and without the future records; ``*rows*`` if rows came or went."""
    if future.limit(1).count() == 0:
        raise ValueError("no future records: the check would prove nothing")
    plain, exposed = build(entities, source), build(entities, source.unionByName(future, allowMissingColumns=True))
    columns = [c for c in plain.columns if c not in row_key]
    kinds = dict(plain.dtypes)
    left, right = plain.select(*row_key, *(F.col(c).alias(f"_a_{c}") for c in columns)), exposed.select(*row_key, *(F.col(c).alias(f"_b_{c}") for c in columns))
    left, right = left.withColumn("_in_a", F.lit(1)), right.withColumn("_in_b", F.lit(1))
    condition = None
    for k in row_key:
        same = left[k].eqNullSafe(right[k])
        condition = same if condition is None else condition & same
    both = left.join(right, condition, "full")

    def moved(c: str) -> Column:
        a, b = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        if kinds[c] in ("double", "float"):
            # Sums may differ in their last digits from run to run.
            return ~(a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= tolerance * F.greatest(F.lit(1.0), F.abs(a)), F.lit(False)))
        return ~a.eqNullSafe(b)

    matched = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    row = both.agg(F.count_if(~matched).alias("*rows*"), *(F.count_if(matched & moved(c)).alias(c) for c in columns)).first().asDict()
    return [c for c in ["*rows*", *columns] if row[c]]


def assert_no_leakage(*args, **kwargs) -> None:
    found = find_leakage(*args, **kwargs)
    if found:
        raise LeakageError(f"changed by future records: {found}")


def assert_detects_leakage(entities: DataFrame, source: DataFrame, future: DataFrame, leaky: Builder, row_key: Sequence[str]) -> list[str]:
    """The negative control: a builder that leaks must be caught."""
    found = find_leakage(entities, source, future, leaky, row_key)
    if not found:
        raise LeakageError("a builder that leaks was not caught, so the check proves nothing")
    return found


def make_future_records(source: DataFrame, at: Column, order: Sequence[str], n: int = 50, times: Sequence[str] = ("available_time", "kickoff_time"), keep: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` records by ``order``, moved to a later time and with numbers that stand out."""
    out = source.orderBy(*order).limit(n)
    for c, kind in source.dtypes:
        if c in times:
            out = out.withColumn(c, at.cast(kind))
        elif c not in keep and kind in ("int", "bigint", "double", "float"):
            out = out.withColumn(c, (F.col(c) * 10 + 999).cast(kind))
    return out


def leakage_split(entities: DataFrame, source: DataFrame, most_rows: int | None = 400, prediction_time: str = "prediction_timestamp", available_time: str = "available_time", order: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities of the median cutoff (the first ``most_rows`` by ``order``; None: all), the records up to it and those after it."""
    cutoffs = entities.select(prediction_time).distinct()
    n = cutoffs.count()
    if not n:
        raise ValueError("no cutoffs")
    # One of them comes to the driver, however many there are.
    middle = cutoffs.orderBy(prediction_time).offset(n // 2).limit(1).first()[0]
    cut = F.lit(middle).cast(entities.schema[prediction_time].dataType)
    rows = entities.where(F.col(prediction_time) == cut)
    if most_rows is not None:
        rows = rows.orderBy(*(order or entities.columns)).limit(most_rows)
    return rows, source.where(F.col(available_time) <= cut), source.where(F.col(available_time) > cut)


def prove_program(program, entities: DataFrame, history: DataFrame, row_key: Sequence[str], context=None) -> tuple[bool, tuple[str, ...], str]:
    """Whether a feature program is free of the future, which checks ran, and why not.

    What can't be checked isn't taken for clean: without records after the median cutoff, or if the program
    can't be compiled, only the static check counts as run and the proof fails.
    """
    from chronofold.plans import compile as programs
    from chronofold.plans.nodes import ProgramError

    context = context or programs.Context()
    issues = programs.validate(program, history.columns, entities.columns)
    if issues:
        return False, ("static",), f"{issues[0][0]}: {issues[0][1]}"
    try:
        rows, source, future = leakage_split(entities, history, prediction_time=context.prediction_time, available_time=context.available_time, order=row_key)
        build = lambda e, h: programs.compile_programs(e, h, [program], context).select(*row_key, program.name)
        found = find_leakage(rows, source, future, build, row_key)
    except (ProgramError, ValueError, KeyError) as problem:
        return False, ("static",), f"not proven: {problem}"
    return not found, ("static", "point_in_time"), f"changed by future records: {found}" if found else ""


def prove_programs(programs: Sequence, entities: DataFrame, history: DataFrame, row_key: Sequence[str], context=None) -> dict[str, tuple[bool, tuple[str, ...], str]]:
    """``prove_program`` of each, name -> proof; those that pass the static check are computed and compared in one plan.

    Only if that plan can't be made are they tried one at a time, so that one bad program doesn't spoil the others' proofs.
    """
    from chronofold.plans import compile as plans
    from chronofold.plans.nodes import ProgramError

    context = context or plans.Context()
    issues = {p.name: plans.validate(p, history.columns, entities.columns) for p in programs}
    out = {n: (False, ("static",), f"{found[0][0]}: {found[0][1]}") for n, found in issues.items() if found}
    sound = [p for p in programs if not issues[p.name]]
    if not sound:
        return out
    try:
        rows, source, future = leakage_split(entities, history, prediction_time=context.prediction_time, available_time=context.available_time, order=row_key)
        build = lambda e, h: plans.compile_programs(e, h, sound, context).select(*row_key, *(p.name for p in sound))
        moved = set(find_leakage(rows, source, future, build, row_key))
    except (ProgramError, ValueError, KeyError):
        return out | {p.name: prove_program(p, entities, history, row_key, context) for p in sound}
    for p in sound:
        found = sorted(moved & {"*rows*", p.name})
        out[p.name] = (not found, ("static", "point_in_time"), f"changed by future records: {found}" if found else "")
    return out


# What is known only after the match.
FORBIDDEN_PREFIXES = ("label_", "actual_", "target_")


def forbidden_columns(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c.startswith(FORBIDDEN_PREFIXES)]

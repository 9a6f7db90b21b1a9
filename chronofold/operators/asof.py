"""As-of joins: for each entity row, the newest fact that was available at its time.

Both sides are put in one table and ordered by time within the entity key, and each entity row takes the
last fact before it. That is one shuffle and one sort, whatever the number of cutoffs: no row meets
more than its neighbours, where a join on the key would meet the whole history at every cutoff. A key
with very many rows can be dealt to time buckets; each bucket then begins with what the ones before
it carry over.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filter_available(source: DataFrame, cutoff: Column, available_time: str = "available_time") -> DataFrame:
    """Facts that were available at the cutoff, inclusive."""
    return source.where(F.col(available_time) <= cutoff)


def asof_join(
    entities: DataFrame,
    source: DataFrame,
    entity_keys: Sequence[str],
    *,
    prediction_time: str = "prediction_timestamp",
    available_time: str = "available_time",
    value_columns: Sequence[str] | None = None,
    source_keys: Sequence[str] | None = None,
    suffix: str = "_src",
    strict: bool = False,
    bucket: Column | None = None,
) -> DataFrame:
    """Every entity row with the values of the newest fact at or before (``strict``: before) its time.

    Facts that tie in time count in the rising order of all their values, nulls first, so the last is the
    same on every run. Rows without a fact keep nulls; null keys meet nothing. The time columns may be of
    any ordered type. Columns that both sides have get ``suffix`` on the facts' side. ``bucket`` is an
    expression over column ``_t`` (the time) that splits hot keys.
    """
    source_keys = list(source_keys or entity_keys)
    values = [c for c in (value_columns or source.columns) if c not in source_keys and c != available_time]
    shown = {c: c + suffix if c in entities.columns else c for c in [available_time, *values]}
    keys = [f"_k{i}" for i in range(len(source_keys))]
    payload = F.struct(F.col(available_time), *(F.col(c) for c in values))
    facts = source.where(F.col(available_time).isNotNull())
    for c in source_keys:
        facts = facts.where(F.col(c).isNotNull())
    # At equal times a fact comes before the entity row if it counts for it.
    facts = facts.select(*(F.col(c).alias(k) for c, k in zip(source_keys, keys, strict=True)), F.col(available_time).alias("_t"), F.lit(1 if strict else 0).alias("_side"), payload.alias("_fact"), F.lit(None).cast(entities.schema).alias("_row"))
    rows = entities.select(*(F.col(c).alias(k) for c, k in zip(entity_keys, keys, strict=True)), F.col(prediction_time).alias("_t"), F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast(facts.schema["_fact"].dataType).alias("_fact"), F.struct(*entities.columns).alias("_row"))
    both = facts.unionByName(rows)
    parts = keys
    if bucket is not None:
        both = both.withColumn("_bucket", bucket)
        parts = [*keys, "_bucket"]
    order = Window.partitionBy(*parts).orderBy("_t", "_side", F.col("_fact").asc_nulls_first())
    seen = both.withColumn("_last", F.last("_fact", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = seen.where(F.col("_row").isNotNull())
    if bucket is not None:
        ends = both.where(F.col("_fact").isNotNull()).groupBy(*parts).agg(F.max(F.struct("_t", "_fact")).alias("_end"))
        # One row a key and bucket; buckets in which only entity rows lie need what came before them too.
        grid = both.select(*parts).distinct().join(ends, parts, "left")
        before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        carried = grid.select(*parts, F.last("_end", ignorenulls=True).over(before)["_fact"].alias("_carried"))
        condition = [out[c].eqNullSafe(carried[c]) for c in parts]
        out = out.join(carried, condition, "left").withColumn("_last", F.coalesce("_last", "_carried"))
    return out.select(*(F.col(f"_row.`{c}`").alias(c) for c in entities.columns), *(F.col(f"_last.`{c}`").alias(s) for c, s in shown.items()))


def point_in_time_join(entities: DataFrame, source: DataFrame, entity_keys: Sequence[str], value_columns: Sequence[str], **options) -> DataFrame:
    """``asof_join`` on some of the facts' columns."""
    missing = [c for c in value_columns if c not in source.columns]
    if missing:
        raise KeyError(f"not in the source: {missing}")
    return asof_join(entities, source, entity_keys, value_columns=value_columns, **options)


def stage_window(
    entities: DataFrame,
    source: DataFrame,
    entity_keys: Sequence[str],
    *,
    window: int,
    row_key: Sequence[str],
    prediction_time: str = "prediction_timestamp",
    available_time: str = "available_time",
    order_col: str | None = None,
) -> DataFrame:
    """Each entity row with its newest ``window`` visible facts, ``rank`` 0 the newest.

    A key without any fact keeps one row of nulls with rank 0; a key whose facts all come later gives no
    row. ``row_key`` names an entity row. Facts are numbered once by key; the number at the cutoff is
    found as of it, and ranks are met by an equi join on (key, number): a row fans out to ``window``
    facts and no further.
    """
    ties = [F.col(order_col).asc_nulls_first()] if order_col else []
    rest = [c for c in source.columns if c not in (available_time, order_col, *entity_keys)]
    order = Window.partitionBy(*entity_keys).orderBy(F.col(available_time).asc_nulls_first(), *ties, *(F.col(c).asc_nulls_first() for c in rest))
    numbered = source.withColumn("_seq", F.row_number().over(order))
    marks = numbered.select(*entity_keys, available_time, "_seq")
    placed = asof_join(entities.select(*dict.fromkeys([*row_key, *entity_keys, prediction_time])), marks, entity_keys, prediction_time=prediction_time, available_time=available_time, value_columns=["_seq"], suffix="_fact")
    fact_time = available_time + "_fact" if available_time in placed.columns and available_time + "_fact" in placed.columns else available_time
    known = source.select(*entity_keys).distinct().withColumn("_known", F.lit(True))
    placed = placed.drop(fact_time).join(known, list(entity_keys), "left").where("_seq IS NOT NULL OR _known IS NULL")
    ranks = placed.withColumn("rank", F.explode(F.sequence(F.lit(0), F.least(F.lit(window - 1), F.coalesce(F.col("_seq") - 1, F.lit(0)))))).withColumn("_want", F.col("_seq") - F.col("rank")).drop("_seq", "_known")
    facts = numbered.select(*(F.col(c).alias(f"_e_{c}") for c in entity_keys), F.col("_seq").alias("_have"), *(F.col(c).alias(c if c not in ranks.columns else c + "_src") for c in source.columns if c not in entity_keys))
    condition = [ranks[c] == facts[f"_e_{c}"] for c in entity_keys] + [ranks["_want"] == facts["_have"]]
    return ranks.join(facts, condition, "left").drop("_want", "_have", *(f"_e_{c}" for c in entity_keys))

"""Mixing sources to target weights, with DataFrame functions only.

Sources, in code-point order with null last, weigh ``weights`` in turn. They share the corpus' words
by weight; a target above ``most_epochs`` times its source's size is held there and the excess shared
anew by weight among the others, until none is above. Within a source documents are ordered by a hash
of their doc_id. That order is dealt to ranges of the hash, as many as the source's rows need, so that
a source with a third of all rows is a third of the ranges and not one task; word counts are summed
within each range and over the ranges before it, and the source is cut at its exact budget: whole
passes over it (epochs) first, then documents in hash order up to the last word of the budget.

Null and empty texts have no words and are taken 0 words. Repeated rows are counted as copies of one
row before anything is ordered, and get their copies back at the end. A null doc_id is hashed as
the empty string. An empty table gives no rows. Other columns are left aside. Reruns agree, as no draw
depends on partitions. Per source one row is held in one place (the list of targets).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.llm import storage

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
#: Bounds of the rows that a range of a source is meant to hold; between them, a quarter of a task's share.
RANGE_ROWS = (1_000, 50_000)
#: Tables up to this size in memory are broadcast.
BROADCAST_BYTES = 64 << 20
#: Copies of one row that are made at once.
COPIES = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size and target from one row a source (source, source_size, n_rows).

    A target is held where ``most_epochs * size / weight`` is below the common level. In rising order of
    that ratio the held ones come first, so a source is held if the level that its predecessors leave
    is above its own ratio, and each predecessor is held too.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    so_far, before = by_ratio.rowsBetween(Window.unboundedPreceding, 0), by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    held_sum, open_weight = "held_sum", "open_weight"
    level = F.col(held_sum).cast("double") / F.col(open_weight)
    return (
        sizes.withColumn("w", weight)
        .withColumn("most", F.col("source_size") * most_epochs)
        .withColumn("ratio", F.col("most").cast("double") / F.col("w"))
        .withColumn(held_sum, F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0)))
        .withColumn(open_weight, F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("held", F.min(F.when(level > F.col("ratio"), 1).otherwise(0)).over(so_far) == 1)
        .withColumn("rest", F.sum("source_size").over(everything) - F.coalesce(F.sum(F.when(F.col("held"), F.col("most"))).over(everything), F.lit(0)))
        .withColumn("rest_weight", F.sum(F.when(~F.col("held"), F.col("w"))).over(everything))
        .withColumn("target", F.when(F.col("held"), F.col("most").cast("double")).otherwise(F.col("rest").cast("double") * F.col("w") / F.col("rest_weight")))
        .select("source", "source_size", "n_rows", "target")
    )


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most_epochs: int = MOST_EPOCHS, seed: str = "mix", range_rows: int | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every row.

    ``taken`` words are ``epoch`` whole passes and a rest; columns ``epochs`` and ``rest`` tell them apart.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text").cast("string")).alias("size"))
    # The texts are counted once; what follows reads three narrow columns.
    rows, _ = storage.materialise(sized, "mix-sizes")
    copies = rows.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("copies"))
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    plan = targets(sums, weights, most_epochs)
    # A row a source; more than fit in BROADCAST_BYTES meet the rows by a shuffle.
    plan, plan_path = storage.materialise(plan, "mix-targets")
    small = storage.fits(plan, plan_path, BROADCAST_BYTES)
    if range_rows is None:
        share = plan.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0] // (4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        range_rows = max(RANGE_ROWS[0], min(RANGE_ROWS[1], share))
    plan = plan.select(F.col("source").alias("p_source"), "source_size", "n_rows", "target")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    keyed = copies.join(F.broadcast(plan) if small else plan, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source").withColumn("key", key)
    # The hash is uniform, so ranges of its first 48 bits are even without any sample.
    share = F.conv(F.substring("key", 1, 12), 16, 10).cast("double") / float(1 << 48)
    ranged = keyed.withColumn("range", F.floor(share * F.ceil(F.col("n_rows") / range_rows)))
    in_range = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    over_ranges = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.col("size") * F.col("copies")
    heads = ranged.groupBy("source", "range").agg(F.sum(whole).alias("words")).select(F.col("source").alias("h_source"), F.col("range").alias("h_range"), F.coalesce(F.sum("words").over(over_ranges), F.lit(0)).alias("ahead"))
    local = ranged.withColumn("before", F.coalesce(F.sum(whole).over(in_range), F.lit(0)))
    placed = local.join(heads, F.col("source").eqNullSafe(F.col("h_source")) & (F.col("range") == F.col("h_range"))).drop("h_source", "h_range")
    budget = F.floor("target")
    # In two steps, so that no array is as long as a row has copies.
    chunks = placed.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))))
    each = chunks.withColumn("copy", F.explode(F.sequence(F.col("chunk") * COPIES, F.least((F.col("chunk") + 1) * COPIES, F.col("copies")) - 1))).drop("chunk")
    place = F.col("ahead") + F.col("before") + F.col("copy") * F.col("size")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    return (
        each.withColumn("epochs", epochs)
        .withColumn("rest", F.least("size", F.greatest(F.lit(0), budget - F.col("epochs") * F.col("source_size") - place)))
        .select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("rest")).alias("taken"), "epochs", "rest")
    )


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """The rows of the mix with all their columns, whole documents, each as often as the mix passes over it.

    A document that the cut falls into is in if half of its words or more are. Rows with one doc_id
    and source are taken alike, as often as the first of them.
    """
    taken = mix(docs, weights, most_epochs)
    times = F.col("epochs") + F.when((F.col("rest") > 0) & (2 * F.col("rest") >= F.col("size")), 1).otherwise(0)
    chosen = taken.withColumn("times", times.cast("int")).groupBy(F.col("doc_id").alias("m_doc"), F.col("source").alias("m_source")).agg(F.max("times").alias("m_times")).where("m_times > 0")
    chosen, path = storage.materialise(chosen, "mix-choice")
    small = storage.fits(chosen, path, BROADCAST_BYTES)
    condition = docs["doc_id"].cast("long").eqNullSafe(chosen["m_doc"]) & docs["source"].cast("string").eqNullSafe(chosen["m_source"])
    joined = docs.join(F.broadcast(chosen) if small else chosen, condition)
    repeated = joined.select(*(docs[c] for c in docs.columns), F.explode(F.sequence(F.lit(1), chosen["m_times"])).alias("_mix_copy"))
    return repeated.drop("_mix_copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: all documents mixed to source weights 5, 2, 1, repeating."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, length(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, list_extract([5, 2, 1], 1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT)::BIGINT AS w
  FROM sized GROUP BY source
), rounds AS (
  SELECT 0 AS round, source, source_size, w, FALSE AS held FROM sources
  UNION ALL
  SELECT round + 1, source, source_size, w,
         held OR (sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (WHERE held) OVER (), 0))::DOUBLE * w
                 / (sum(w) FILTER (WHERE NOT held) OVER ()) > 3 * source_size
  FROM rounds WHERE round < 40
), plan AS (
  SELECT source, source_size,
         CASE WHEN held THEN (3 * source_size)::DOUBLE
              ELSE (sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (WHERE held) OVER (), 0))::BIGINT::DOUBLE * w
                   / (sum(w) FILTER (WHERE NOT held) OVER ())::BIGINT END AS target
  FROM rounds WHERE round = 40
), placed AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, floor(p.target)::BIGINT AS budget,
         (sum(s.size) OVER (PARTITION BY s.source ORDER BY md5('mix:' || s.doc_id::VARCHAR), s.doc_id) - s.size)::BIGINT AS place
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0
            ELSE (budget // source_size) * size + least(size, greatest(0, budget - (budget // source_size) * source_size - place)) END::BIGINT AS taken
FROM placed
"""

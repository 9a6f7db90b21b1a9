"""Connected components of a link table, by smallest label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm import storage


def connected_components(links: DataFrame) -> DataFrame:
    """v and component (the smallest vertex reachable) of every vertex of ``links`` (a, b: long).

    Each round a vertex takes the smallest label among its own and its neighbours', then its label's
    label; so labels also travel along the pointers they make, and a star is done in two rounds.
    Nothing is gathered by vertex, only minima are, so that a vertex may have any number of links.
    Every round is a written table. An empty link table gives no rows.
    """
    spark = links.sparkSession
    pairs = links.where("a <> b").select("a", "b")
    edges, edges_path = storage.materialise(pairs.union(pairs.select("b", "a")).distinct(), "cc-edges")
    labels, path = storage.materialise(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "v"), "cc-labels")
    while True:
        near = edges.join(labels, edges.b == labels.v).groupBy("a").agg(F.min("label").alias("low"))
        better = labels.join(near, labels.v == near.a, "left").select("v", F.col("label").alias("was"), F.least("label", F.coalesce("low", "label")).alias("label"))
        ahead = labels.select(F.col("v").alias("w"), F.col("label").alias("further"))
        jumped = better.join(ahead, better.label == F.col("w"), "left").select("v", "was", F.least("label", F.coalesce("further", "label")).alias("label"))
        new, new_path = storage.materialise(jumped, "cc-labels")
        changed = new.where("label <> was").limit(1).count()
        storage.remove(spark, path)
        labels, path = new.select("v", "label"), new_path
        if not changed:
            storage.remove(spark, edges_path)
            return labels.select("v", F.col("label").alias("component"))

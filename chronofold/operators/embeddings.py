"""Embeddings, clusters and nearest neighbours of feature vectors."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.operators.neighbours import neighbours

SEED, TEMPERATURE, COMPONENTS = 20260728, 0.5, 8
#: Rows that one task of a clustering reads.
CLUSTER_PART = 500_000


@dataclass(frozen=True)
class Embedding:
    """Means, scales and loadings of a fit; applied as they are, never refitted."""

    columns: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    loadings: tuple[tuple[float, ...], ...]

    def transform(self, frame: DataFrame, out: str = "embedding") -> DataFrame:
        """Adds an array of components; missing values take the fitted mean."""
        z = F.array(*((F.coalesce(F.col(c).cast("double"), F.lit(m)) - m) / s for c, m, s in zip(self.columns, self.mean, self.scale, strict=True)))
        parts = [F.aggregate(F.zip_with(F.col("_z"), F.array(*map(F.lit, axis)), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for axis in self.loadings]
        return frame.withColumn("_z", z).withColumn(out, F.array(*parts)).drop("_z")

    def report(self, most: int = 3) -> list[list[str]]:
        """The columns that weigh most on each axis."""
        return [[self.columns[i] for i in np.argsort(-np.abs(axis), kind="stable")[:most]] for axis in self.loadings]


def fit_embedding(frame: DataFrame, columns: list[str], components: int = COMPONENTS) -> Embedding:
    """Mean-imputed, scaled principal components. Spark sums the moments; the driver sees columns squared numbers."""
    n_columns = len(columns)
    moments = frame.agg(*(a for c in columns for a in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))), F.count(F.lit(1)).alias("n")).first()
    mean = [moments[f"m_{c}"] or 0.0 for c in columns]
    # The spread after imputation: missing values add nothing to it.
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(m)) - m for c, m in zip(columns, mean, strict=True)]
    products = frame.agg(*(F.sum(filled[i] * filled[j]).alias(f"p_{i}_{j}") for i in range(n_columns) for j in range(i, n_columns))).first()
    gram = np.zeros((n_columns, n_columns))
    for i in range(n_columns):
        for j in range(i, n_columns):
            gram[i, j] = gram[j, i] = products[f"p_{i}_{j}"] or 0.0
    n = max(1, moments["n"])
    sd = np.sqrt(np.diag(gram) / n)
    scale = np.where(sd <= 1e-9, 1.0, sd)
    values, vectors = np.linalg.eigh(gram / np.outer(scale, scale) / n)
    order = np.argsort(-values, kind="stable")[: min(components, n_columns, max(1, n - 1))]
    axes = [v * (1 if v[np.argmax(np.abs(v))] > 0 else -1) for v in vectors[:, order].T]
    return Embedding(tuple(columns), tuple(map(float, mean)), tuple(map(float, scale)), tuple(tuple(map(float, a)) for a in axes))


def fit_clusters(frame: DataFrame, k: int, vector: str = "embedding", seed: int = SEED) -> list[list[float]]:
    """Centroids by distributed k-means. Every pass reads vectors as objects, so a task's share is bounded by rows and not by the files' size."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = frame.select(vector)
    n = rows.count()
    if n > CLUSTER_PART:
        rows = rows.repartition(max(math.ceil(n / CLUSTER_PART), frame.sparkSession.sparkContext.defaultParallelism))
    model = KMeans(k=k, seed=seed, maxIter=100, featuresCol="_v").fit(rows.select(array_to_vector(vector).alias("_v")))
    return [c.tolist() for c in model.clusterCenters()]


def silhouette(frame: DataFrame, label: str = "cluster_id", vector: str = "embedding") -> float:
    """Mean silhouette by squared distance."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    return ClusteringEvaluator(predictionCol=label, featuresCol="_v").evaluate(frame.select(label, array_to_vector(vector).alias("_v")))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def assign(frame: DataFrame, centroids: list[list[float]], vector: str = "embedding", temperature: float = TEMPERATURE) -> DataFrame:
    """Nearest cluster, distance to it and soft memberships softmax(-d2 / temperature)."""
    d2 = F.array(*(squared_distance(F.col(vector), F.array(*map(F.lit, c))) for c in centroids))
    out = frame.withColumn("_d", d2).withColumn("_m", F.array_min("_d"))
    raw = F.transform("_d", lambda d: F.exp(-(d - F.col("_m")) / temperature))
    out = out.withColumn("_e", raw).withColumn("cluster_id", (F.array_position("_d", F.col("_m")) - 1).cast("int")).withColumn("distance_to_centroid", F.sqrt("_m"))
    total = F.aggregate("_e", F.lit(0.0), lambda s, x: s + x)
    return out.withColumn("memberships", F.transform("_e", lambda x: x / total)).drop("_d", "_m", "_e")


def rand_index(frame: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two labelings over all pairs, from the table of counts."""
    pairs = lambda n: n * (n - 1) / 2.0
    cells = frame.groupBy(a, b).count()
    both = cells.agg(F.sum(pairs(F.col("count"))).alias("same"), F.sum("count").alias("n"))
    rows = cells.groupBy(a).agg(F.sum("count").alias("c")).agg(F.sum(pairs(F.col("c"))).alias("ra"))
    columns = cells.groupBy(b).agg(F.sum("count").alias("c")).agg(F.sum(pairs(F.col("c"))).alias("rb"))
    out = both.crossJoin(rows).crossJoin(columns)
    return out.select(((pairs(F.col("n")) + 2 * F.col("same") - F.col("ra") - F.col("rb")) / pairs(F.col("n"))).alias("rand_index"))


# Least rows of a clustering and of a supervised projection, the least share of a cluster, the weights of what chooses their number.
LEAST_ROWS, LEAST_SUPERVISED, LEAST_SHARE = 60, 800, 0.04
SILHOUETTE_WEIGHT, STABILITY_WEIGHT, UTILITY_WEIGHT = 0.4, 0.3, 0.3
# The columns that each aim stresses, and by how much.
EMPHASIS = {
    "rank_gain": {"total_points_max_5": 2.2, "total_points_std_10": 2.2, "threat_per90_5": 2.2, "selected_mean_5": 2.0, "transfers_balance_mean_5": 2.0, "expected_goals_per90_5": 1.6, "opponent_conceded_xg_mean_5": 1.6},
    "differential_yield": {"selected_mean_5": 2.5},
    "downside_protection": {"minutes_mean_5": 2.2, "minutes_mean_20": 2.2, "starts_mean_5": 2.2, "appearance_rate_10": 2.2, "minutes_when_played_mean_5": 2.2, "total_points_std_10": 1.8, "selected_mean_5": 1.5},
    "team_value_growth": {"transfers_balance_mean_5": 2.4, "selected_mean_5": 2.4, "value_mean_1": 2.4, "total_points_mean_5": 1.4},
    "captaincy_upside": {"total_points_max_5": 2.0, "expected_goals_per90_5": 2.0, "threat_per90_5": 2.0, "minutes_mean_5": 1.6, "starts_mean_5": 1.6},
    "transfer_flexibility": {"value_mean_1": 2.0, "minutes_mean_20": 2.0, "appearance_rate_10": 2.0},
    "ownership": {"selected_mean_5": 2.2},
    "long_horizon": {"minutes_mean_20": 1.5, "total_points_mean_5": 1.5},
    "broke": {"value_mean_1": 2.4},
    "thin_budget": {"value_mean_1": 1.7},
    "frozen": {"minutes_mean_20": 2.2, "appearance_rate_10": 2.2, "starts_mean_5": 2.2},
    "heavily_locked": {"minutes_mean_20": 1.6, "appearance_rate_10": 1.6},
}


def column_weights(aims: Sequence[str], columns: Sequence[str]) -> list[float]:
    """How much each column counts in a distance: 1, or the most that one of the aims (and constraints) gives it."""
    return [max([1.0, *(EMPHASIS[a].get(c, 1.0) for a in aims)]) for c in columns]


def component_weights(embedding: Embedding, weights: Sequence[float]) -> list[float]:
    """Column weights carried to components: their mean by the size of each component's loadings."""
    size = np.abs(np.array(embedding.loadings))
    return (size @ np.array(weights) / np.maximum(size.sum(1), 1e-12)).tolist()


def weighted(frame: DataFrame, weights: Sequence[float], vector: str = "embedding") -> DataFrame:
    return frame.withColumn(vector, F.zip_with(F.col(vector), F.array(*map(F.lit, weights)), lambda a, b: a * b))


def supervised_projection(frame: DataFrame, target: str, width: int = 4, ridge: float = 1.0, vector: str = "embedding", least: int = LEAST_SUPERVISED) -> list[list[float]] | None:
    """Axes that predict a target: its ridge direction, then the principal axes of what that leaves. None if there is too little.

    Spark sums the products of components; the driver solves systems of components squared numbers.
    """
    rows = frame.where(F.col(target).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)))
    first = rows.select(F.size(vector).alias("k")).first()
    if first is None or not first.k:
        return None
    k, x = first.k, [F.element_at(vector, i + 1) for i in range(first.k)]
    s = rows.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(target).alias("sd"), *(F.sum(x[i] * x[j]).alias(f"x{i}_{j}") for i in range(k) for j in range(i, k)), *(F.sum(x[i] * F.col(target)).alias(f"y{i}") for i in range(k))).first()
    if s.n < least or not s.sd or s.sd < 1e-9:
        return None
    gram = np.array([[s[f"x{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    beta = np.linalg.solve(gram + ridge * np.eye(k), np.array([s[f"y{i}"] for i in range(k)]))
    direction = beta / max(float(np.linalg.norm(beta)), 1e-12)
    # The products of x less its part along the direction follow from those of x.
    off = np.eye(k) - np.outer(direction, direction)
    values, axes = np.linalg.eigh(off @ gram @ off)
    rest = [axes[:, i] for i in np.argsort(-values, kind="stable")]
    return [a.tolist() for a in [direction, *rest][: min(width, k)]]


def projected(frame: DataFrame, axes: Sequence[Sequence[float]], vector: str = "embedding") -> DataFrame:
    parts = [F.aggregate(F.zip_with(F.col(vector), F.array(*map(F.lit, axis)), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for axis in axes]
    return frame.withColumn(vector, F.array(*parts))


def choose_k(frame: DataFrame, ks: Sequence[int] = (3, 4, 5, 6, 7, 8), vector: str = "embedding", seed: int = SEED, utilities: dict[int, float] | None = None) -> tuple[int, dict[int, float]]:
    """The number of clusters by silhouette, agreement of two seeds (Rand index) and measured utility; a cluster below LEAST_SHARE costs 1.

    The silhouette is by squared distance.
    """
    n, values = frame.count(), {}
    for k in (k for k in ks if k < n):
        placed = assign(frame, fit_clusters(frame, k, vector, seed), vector).select(vector, "cluster_id")
        both = assign(placed.withColumnRenamed("cluster_id", "_first"), fit_clusters(frame, k, vector, seed + 977), vector)
        sizes = [r["count"] for r in placed.groupBy("cluster_id").count().collect()]
        small = len(sizes) < k or min(sizes) < LEAST_SHARE * n
        stability = rand_index(both, "_first", "cluster_id").first().rand_index
        values[k] = SILHOUETTE_WEIGHT * silhouette(placed, vector=vector) + STABILITY_WEIGHT * stability + UTILITY_WEIGHT * (utilities or {}).get(k, 0.0) - (1.0 if small else 0.0)
    if not values:
        raise ValueError(f"no number of clusters fits {n} rows")
    return max(values, key=lambda k: (values[k], -k)), values


@dataclass(frozen=True)
class Clusters:
    """A fit: how rows become vectors, and the centroids they are assigned to; never refitted when used."""

    embedding: Embedding
    centroids: tuple[tuple[float, ...], ...]
    weights: tuple[float, ...] | None
    axes: tuple[tuple[float, ...], ...] | None

    def version(self) -> str:
        import hashlib

        return hashlib.sha256(repr((self.embedding, self.centroids, self.weights, self.axes)).encode()).hexdigest()[:12]

    def place(self, frame: DataFrame) -> DataFrame:
        out = self.embedding.transform(frame)
        out = projected(out, self.axes) if self.axes else weighted(out, self.weights) if self.weights else out
        return assign(out, [list(c) for c in self.centroids])


def fit_cluster_model(frame: DataFrame, columns: list[str], *, aims: Sequence[str] = (), target: str | None = None, k: int | None = None, components: int = COMPONENTS, seed: int = SEED, least: int = LEAST_ROWS) -> Clusters:
    """Clusters of training rows: in the space of an aim's target if there is enough to fit it on, else weighed by the aims."""
    if frame.limit(least).count() < least:
        raise ValueError(f"fewer than {least} rows describe these rows and not a population")
    embedding = fit_embedding(frame, columns, components)
    rows = embedding.transform(frame)
    axes = supervised_projection(rows, target) if target else None
    weights = None if axes else component_weights(embedding, column_weights(aims, columns)) if aims else None
    rows = projected(rows, axes) if axes else weighted(rows, weights) if weights else rows
    k = k or choose_k(rows, seed=seed)[0]
    centroids = fit_clusters(rows, k, seed=seed)
    return Clusters(embedding, tuple(map(tuple, centroids)), tuple(weights) if weights else None, tuple(map(tuple, axes)) if axes else None)


def rolling_assignments(model: Clusters, frame: DataFrame, keys: Sequence[str] = ("player_code", "label_season", "label_gameweek")) -> DataFrame:
    """Each row's cluster from its own features, so that movement between clusters shows week by week."""
    placed = model.place(frame)
    own = F.element_at("memberships", F.col("cluster_id") + 1)
    return placed.select(*keys, F.lit(model.version()).alias("cluster_model_version"), "cluster_id", F.round(own, 6).alias("membership_probability"), F.round("distance_to_centroid", 6).alias("distance_to_centroid"))


def cluster_summaries(model: Clusters, frame: DataFrame, phrases: dict[str, tuple[str, str]] | None = None, most: int = 5, least: float = 0.25) -> DataFrame:
    """Size, mean own membership and the columns each cluster is extreme on (standardised means), with a label from them alone."""
    e = model.embedding
    z = {c: (F.coalesce(F.col(c).cast("double"), F.lit(m)) - m) / s for c, m, s in zip(e.columns, e.mean, e.scale, strict=True)}
    own = F.element_at("memberships", F.col("cluster_id") + 1)
    centres = model.place(frame).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), F.round(F.avg(own), 4).alias("stability"), *(F.round(F.avg(v), 4).alias(f"_z_{c}") for c, v in z.items()))
    words = phrases or {}
    entry = lambda c: F.struct((-F.abs(F.col(f"_z_{c}"))).alias("order"), F.lit(c).alias("feature"), F.col(f"_z_{c}").alias("value"), F.when(F.col(f"_z_{c}") > 0, words.get(c, (f"high {c}", ""))[0]).otherwise(words.get(c, ("", f"low {c}"))[1]).alias("word"))
    ranked = F.filter(F.slice(F.array_sort(F.array(*(entry(c) for c in e.columns))), 1, most), lambda x: F.abs(x["value"]) >= least)
    out = centres.select("cluster_id", "size", "stability", ranked.alias("_r"))
    label = F.when(F.size("_r") == 0, "unremarkable").otherwise(F.array_join(F.transform(F.slice("_r", 1, 3), lambda x: x["word"]), ", "))
    return out.select("cluster_id", "size", "stability", F.transform("_r", lambda x: F.struct(x["feature"].alias("feature"), x["value"].alias("value"))).alias("dominant"), label.alias("label"))


def comparables(frame: DataFrame, key: str, group: str, vector: str, k: int = 4) -> DataFrame:
    """The k nearest others of each row in its group, by squared distance: key, other, place and d2."""
    return neighbours(frame, key, group, vector, k)

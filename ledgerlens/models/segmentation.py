"""KMeans customer segments on standardised RFM (+ behavioural) features."""
from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .fitting import cached, side_by_side

BASE_FEATURES = ["recency", "frequency", "monetary"]
EXTRA_FEATURES = ["avg_order_value", "unique_categories", "avg_days_between_orders"]
# Cluster labels, best centroid score first (fixed values).
CLUSTER_LABELS = ["Champions", "Loyal", "Potential", "At Risk"]


def _filled(rfm: DataFrame, features: list[str]) -> DataFrame:
    return rfm.select("customer_id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])


def _scaled(filled: DataFrame, features: list[str]):
    vec = VectorAssembler(inputCols=features, outputCol="_raw").transform(filled)
    scaler = StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True).fit(vec)
    return scaler.transform(vec), scaler


def _prepared(rfm: DataFrame, features: list[str]):
    return _scaled(_filled(rfm, features), features)


def _best_start(data: DataFrame, k: int, seed: int, n_init: int):
    """The k-means model of lowest cost among ``n_init`` starts (seeds ``seed``, ``seed`` + 1, ...; ties: the first)."""
    def start(i: int):
        return lambda: KMeans(k=k, seed=seed + i, featuresCol="features", predictionCol="cluster").fit(data)
    return min(side_by_side([start(i) for i in range(n_init)]), key=lambda m: m.summary.trainingCost)


def run_kmeans(rfm: DataFrame, n_clusters: int = 4, seed: int = 42, n_init: int = 10):
    """Fit k-means ``n_init`` times side by side and keep the lowest cost; label
    clusters by the centroid score monetary - .3 recency + 2 frequency in original
    units. Returns (scored DataFrame, written to the checkpoint folder; model; centroids)."""
    ensure_checkpoint_dir(rfm.sparkSession)
    features = BASE_FEATURES + [f for f in EXTRA_FEATURES if f in rfm.columns]
    rows, filled = cached(_filled(rfm, features))
    try:
        data, scaler = _scaled(filled, features)
        held, vectors = cached(data.select("customer_id", "features"))
        try:
            model = _best_start(vectors, n_clusters, seed, n_init)
            placed = model.transform(vectors).select("customer_id", "cluster").checkpoint()
        finally:
            held.unpersist()
    finally:
        rows.unpersist()
    mean, std = np.array(scaler.mean.toArray()), np.array(scaler.std.toArray())
    centroids = [mean + std * np.array(c) for c in model.clusterCenters()]
    idx = {f: i for i, f in enumerate(features)}
    score = [c[idx["monetary"]] - 0.3 * c[idx["recency"]] + 2 * c[idx["frequency"]] for c in centroids]
    order = list(np.argsort(score)[::-1])
    labels = {int(cluster): CLUSTER_LABELS[rank] if rank < len(CLUSTER_LABELS) else f"Cluster {rank}"
              for rank, cluster in enumerate(order)}
    mapping = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return placed.withColumn("segment", mapping[F.col("cluster")]), model, centroids


def silhouette_k_sweep(rfm: DataFrame, k_values=range(2, 9), seed: int = 42, n_init: int = 10) -> DataFrame:
    """k, inertia (lowest training cost of ``n_init`` starts) and silhouette (squared Euclidean) per k;
    all starts of a k side by side, on features computed once."""
    rows, filled = cached(_filled(rfm, BASE_FEATURES))
    held, data = cached(_scaled(filled, BASE_FEATURES)[0].select("customer_id", "features"))
    evaluator = ClusteringEvaluator(featuresCol="features", predictionCol="cluster")
    try:
        models = {int(k): _best_start(data, k, seed, n_init) for k in k_values}
        scores = side_by_side([lambda m=m: float(evaluator.evaluate(m.transform(data))) for m in models.values()])
    finally:
        held.unpersist()
        rows.unpersist()
    found = [(k, float(m.summary.trainingCost), s) for (k, m), s in zip(models.items(), scores)]
    return rfm.sparkSession.createDataFrame(found, "k int, inertia double, silhouette double")

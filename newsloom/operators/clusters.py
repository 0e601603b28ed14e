"""Clustering (section F): MLlib KMeans and evaluator, plus a radius-based density clustering.

The k search (F4) fits all its models in shared passes (``ksearch``).  Centroid tables are k rows: the only
things ever brought to the driver are the k centres and the k-score list.
"""

from __future__ import annotations

import warnings

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import ensure_checkpoint_dir
from . import ksearch
from .similarity import core_links, neighbour_sum


MAX_ITER = 300  # of a KMeans fit; one that stops there is reported as not converged


def stable_input(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Repeatable KMeans input without funnelling it through one task: rows are hash-partitioned by id, adaptive
    execution sizes the partitions to the data, and rows are sorted within them, so the same data gives the same
    partitions in the same order, and the seeded fit is reproducible."""
    return df.repartition(id_col).sortWithinPartitions(id_col)


def _fit(feats: DataFrame, k: int, seed: int, max_iter: int) -> KMeansModel:
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster", maxIter=max_iter).fit(feats)
    if model.hasSummary and model.summary.numIter >= max_iter:
        warnings.warn(f"KMeans with k={k} stopped after {max_iter} iterations without converging", stacklevel=3)
    return model


def to_features(df: DataFrame, vec: str = "v", out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(vec)))


def fit_kmeans(df: DataFrame, k: int, seed: int = 42, vec: str = "v", id_col: str = "doc_id",
               max_iter: int = MAX_ITER):
    """(model, labels (id, cluster), centroids (cluster, centroid)); Euclidean KMeans (k-means||)."""
    feats = to_features(df.select(id_col, vec), vec)
    model = _fit(feats, k, seed, max_iter)
    labels = model.transform(feats).select(id_col, F.col("cluster").cast("int").alias("cluster"))
    return model, labels, centroid_table(model)


def centroid_table(model: KMeansModel) -> DataFrame:
    """k rows (cluster, centroid) from the fitted model -- bounded by k."""
    spark = model.summary.predictions.sparkSession if model.hasSummary else None
    from pyspark.sql import SparkSession

    spark = spark or SparkSession.getActiveSession()
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return spark.createDataFrame(rows, "cluster int, centroid array<double>")


def predict_cluster(df: DataFrame, centroids: DataFrame, vec: str = "v", out: str = "cluster") -> DataFrame:
    """nearest centre (Euclidean) for new rows; the k centres are folded into one value, no join."""
    cs = centroids.select(F.sort_array(F.collect_list(F.struct(F.col("cluster").cast("int").alias("c"),
                                                               F.col("centroid").alias("m")))).alias("cs")).scalar()
    d = df.withColumn("_cs", cs)
    dist = F.transform("_cs", lambda s: F.struct(
        V.sumsq(F.zip_with(F.col(vec), s["m"], lambda a, b: a - b)).alias("d"), s["c"].alias("c")))
    return d.withColumn(out, F.array_min(dist)["c"]).drop("_cs")


def silhouette_cosine(df: DataFrame, vec: str = "v", cluster_col: str = "cluster") -> float:
    """mean silhouette with cosine distance (MLlib ClusteringEvaluator)."""
    ev = ClusteringEvaluator(featuresCol="features", predictionCol=cluster_col, distanceMeasure="cosine",
                             metricName="silhouette")
    return float(ev.evaluate(to_features(df.select(vec, F.col(cluster_col).cast("double").alias(cluster_col)), vec)))


def silhouette_table(df: DataFrame, vec: str = "v", cluster_col: str = "cluster") -> DataFrame:
    """F3 as a one-row table (score)."""
    s = silhouette_cosine(df, vec, cluster_col)
    return df.sparkSession.createDataFrame([(s,)], "silhouette double")


def find_optimal_k(df: DataFrame, k_min: int = 3, k_max: int = 10, vec: str = "v", id_col: str = "doc_id",
                   max_iter: int = MAX_ITER):
    """silhouette (cosine) per k; best k is the highest score, ties -> smallest k.

    Returns (best_k, scores_table(k, silhouette)).  All models share their passes over the vectors (see ``ksearch``).
    """
    best_k, scores, _models, _vectors = ksearch.search_k(df, k_min, k_max, id_col, vec, max_iter)
    return best_k, scores


def cluster_sizes(labels: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    """F5."""
    return labels.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("n"))


def kmeans_inertia(df: DataFrame, centroids: DataFrame, vec: str = "v", cluster_col: str = "cluster") -> DataFrame:
    """sum of squared distances to the assigned centre (one aggregate; centres are k rows)."""
    j = df.join(F.broadcast(centroids.withColumnRenamed("centroid", "_c")), cluster_col)
    sq = V.sumsq(F.zip_with(F.col(vec), F.col("_c"), lambda a, b: a - b))
    return j.agg(F.sum(sq).alias("inertia"))


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label) with label = smallest id of the component; ``edges`` (src, dst) hold both directions.

    Each round: min-label propagation over the edges (one join + one partial aggregate), then pointer jumping
    (a node also takes the label of its label, one more join), which shortcuts long chains so the number of
    rounds grows with the log of the diameter.  Labels are always ids of the same component, so the fixed point
    is the component minimum; rounds go on until none changes a label.  Every round ends in a reliable checkpoint in
    the shared folder: a round reads the previous labels several times, so without cutting the lineage the query
    plan would double each round; with it, each round is a constant-size plan and restarts from the last round
    after an executor loss.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    edges = edges.checkpoint()
    labels = nodes.select(F.col("id"), F.col("id").alias("label")).checkpoint()
    changed = 1
    while changed:
        msgs = edges.join(labels.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), "label")
        best = msgs.unionByName(labels).groupBy("id").agg(F.min("label").alias("label"))
        hop = best.select(F.col("id").alias("label"), F.col("label").alias("_ll"))
        best = best.join(hop, "label", "left").select("id", F.least("label", F.coalesce("_ll", "label")).alias("label"))
        best = best.checkpoint()
        changed = best.join(labels.withColumnRenamed("label", "_old"), "id").where(F.col("label") != F.col("_old")).count()
        labels = best
    return labels


HOT_PARTS = 1000  # a vector with more than 1/HOT_PARTS of the rows is joined by broadcast: fewer than HOT_PARTS vectors


def density_clusters(df: DataFrame, threshold: float, min_pts: int, id_col: str = "doc_id", vec: str = "v",
                     blocks: int | None = None) -> DataFrame:
    """fixed-radius density clustering with noise = -1.

    Neighbours: cosine > threshold (E5); a zero vector has cosine 0, also to its copies.  Core: at least ``min_pts``
    points in the neighbourhood, itself included.  Core points connected through core-core neighbourhoods share a
    label (smallest member id); a border point takes the smallest label among its core neighbours; the rest is noise.

    Exact copies are first collapsed to one representative per distinct vector, with its multiplicity.  The vectors
    pass through the pruned block join twice: once for the degrees, once for the links (a spanning forest per group
    plus the few core neighbours of each border point); the label rounds work on ids only.
    """
    ensure_checkpoint_dir(df.sparkSession)
    ids = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec).alias("_v")).checkpoint()
    groups = ids.groupBy("_v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("mult")).checkpoint()  # partial aggregate
    hot = groups.where(F.col("mult") * HOT_PARTS > ids.count()).select("_v", F.col("rep").alias("_hot"))
    tagged = ids.join(F.broadcast(hot), "_v", "left")          # all copies of one vector must not meet in one task
    member = (tagged.where("_hot is not null").select("id", F.col("_hot").alias("rep"))
              .unionByName(tagged.where("_hot is null").select("id", "_v").join(groups, "_v").select("id", "rep")))
    alike = F.when(V.sumsq("_v") > 0, F.lit(1.0)).otherwise(F.lit(0.0)) > F.lit(float(threshold))
    own = F.when(alike, F.col("mult") - 1).otherwise(0)
    reps = groups.select(F.col("rep").alias("id"), F.col("_v").alias("v"), "mult", own.alias("own")).checkpoint()
    deg = neighbour_sum(reps, threshold, "mult", id_col="id", blocks=blocks)
    flagged = (reps.join(deg.withColumnRenamed("value", "_deg"), "id", "left")
               .select("id", "v", (F.coalesce("_deg", F.lit(0)) + F.col("own") + 1 >= min_pts).alias("core"))).checkpoint()
    links = core_links(flagged, threshold, "core", id_col="id", blocks=blocks).checkpoint()
    joined = links.where("core").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    labels = connected_components(flagged.where("core").select("id"),
                                  joined.unionByName(joined.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    border = (links.where(~F.col("core")).join(labels.withColumnRenamed("id", "b"), "b")
              .groupBy(F.col("a").alias("id")).agg(F.min("label").alias("label")))
    labels = labels.unionByName(border).withColumnRenamed("id", "rep")
    return (member.join(labels, "rep", "left")
            .select(F.col("id").alias(id_col), F.coalesce("label", F.lit(-1)).cast("long").alias("cluster")))

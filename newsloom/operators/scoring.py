"""Article scores (section I): one projection or one aggregate each, no pairs.

Per-cluster means use the identity mean_j cos(i, j) = u_i . mean_j(u_j) over unit
vectors, so novelty is O(n.d) with one partial aggregate instead of n^2 pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V

# ---- fixed values (must equal the reference's) ---------------------------------
SOURCE_WEIGHTS = {
    "TechCrunch": 1.0,
    "Hugging Face Blog": 0.9,
    "AWS ML Blog": 0.85,
    "Xataka": 0.7,
    "Wired ES": 0.6,
}
DEFAULT_SOURCE_WEIGHT = 0.5
DECAY_DAYS = 30
# -------------------------------------------------------------------------------

MICROS_PER_DAY = 86_400_000_000


def weights_table(spark: SparkSession, weights: dict | None = None) -> DataFrame:
    w = weights if weights is not None else SOURCE_WEIGHTS
    return spark.createDataFrame([(k, float(v)) for k, v in w.items()], "source string, weight double")


def score_lookup(df: DataFrame, lookup: DataFrame, key: str, value: str, out: str, default) -> DataFrame:
    """H4: dictionary map with default = left join to a broadcast lookup table (fixed, tiny)."""
    lk = F.broadcast(lookup.select(F.col(key).alias("_lk_key"), F.col(value).alias("_lk_val")))
    j = df.join(lk, df[key] == lk["_lk_key"], "left")
    return j.withColumn(out, F.coalesce(F.col("_lk_val"), F.lit(default))).drop("_lk_key", "_lk_val")


def source_score(df: DataFrame, spark: SparkSession | None = None, weights: dict | None = None,
                 default: float = DEFAULT_SOURCE_WEIGHT, source_col: str = "source", out: str = "source_score") -> DataFrame:
    """I1. The lookup is a handful of rows; expressed as a literal map it needs no join at all."""
    w = weights if weights is not None else SOURCE_WEIGHTS
    m = F.create_map(*[x for k, v in w.items() for x in (F.lit(k), F.lit(float(v)))])
    return df.withColumn(out, F.coalesce(F.try_element_at(m, F.col(source_col)), F.lit(float(default))))


def recency_expr(ts_col: str, as_of: str, decay_days: float = DECAY_DAYS):
    days = F.floor((F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col(ts_col).cast("timestamp")))
                   / F.lit(MICROS_PER_DAY))
    return F.exp(-days / F.lit(float(decay_days)))


def recency_score(df: DataFrame, as_of: str, ts_col: str = "scraping_date", decay_days: float = DECAY_DAYS,
                  out: str = "recency_score") -> DataFrame:
    """exp(-whole_days/decay); future dates score above 1."""
    return df.withColumn(out, recency_expr(ts_col, as_of, decay_days))


def cluster_means(df: DataFrame, cluster_col: str, vec: str, dim: int | None, out: str = "_cmean") -> DataFrame:
    """Mean of the unit vectors of each cluster (partial aggregate, k rows out)."""
    u = df.select(F.col(cluster_col), V.l2_normalize(vec).alias("_u"))
    return V.mean_vectors(u, [cluster_col], "_u", out=out, dim=dim)


def novelty_score(df: DataFrame, cluster_col: str = "cluster", vec: str = "v", dim: int | None = None,
                  out: str = "novelty_score") -> DataFrame:
    """1 - mean cosine to every member of its own cluster, itself included."""
    means = cluster_means(df, cluster_col, vec, dim)
    # one row per cluster: bounded by k (the clustering parameter), so it is broadcast
    j = df.join(F.broadcast(means), cluster_col, "left")
    return j.withColumn(out, F.lit(1.0) - V.dot(V.l2_normalize(vec), "_cmean")).drop("_cmean")


def similarity_to_centroid(df: DataFrame, centroids: DataFrame, cluster_col: str = "cluster", vec: str = "v",
                           centroid_col: str = "centroid", out: str = "similarity_to_centroid") -> DataFrame:
    """cosine(article, centroid of its cluster); centroids are k rows (bounded by k) -> broadcast."""
    c = F.broadcast(centroids.select(F.col(cluster_col), F.col(centroid_col).alias("_centroid")))
    j = df.join(c, cluster_col, "left")
    return j.withColumn(out, V.cosine(vec, "_centroid")).drop("_centroid")


def novelty_centroid(df: DataFrame, sim_col: str = "similarity_to_centroid", out: str = "novelty_score") -> DataFrame:
    """I4."""
    return df.withColumn(out, F.lit(1.0) - F.col(sim_col))


def semantic_score(df: DataFrame, vec: str = "v", dim: int | None = None, out: str = "semantic_score") -> DataFrame:
    """Mean cosine of each article to all, itself included = u_i . mean(u).

    The global mean is a scalar subquery (one aggregate, inlined once), not a join.
    """
    u = df.select(V.l2_normalize(vec).alias("_u"))
    g = V.mean_vectors(u.withColumn("_g", F.lit(0)), ["_g"], "_u", out="_gm", dim=dim).select("_gm")
    # bind the subquery to a column first: subqueries may not sit inside higher-order functions
    return (df.withColumn("_gm", g.scalar()).withColumn(out, V.dot(V.l2_normalize(vec), "_gm")).drop("_gm"))


def novelty_global(df: DataFrame, vec: str = "v", dim: int | None = None, out: str = "novelty_score") -> DataFrame:
    """1 - semantic_score."""
    s = semantic_score(df, vec, dim, out="_sem")
    return s.withColumn(out, F.lit(1.0) - F.col("_sem")).drop("_sem")


def length_score(df: DataFrame, content_col: str = "content", out: str = "length_score") -> DataFrame:
    """Length / max length (global max as a scalar subquery)."""
    mx = df.select(F.max(F.length(content_col))).scalar()
    return df.withColumn(out, F.length(content_col) / mx)


def source_flag(df: DataFrame, sources=("OpenAI", "AWS"), source_col: str = "source", out: str = "source_flag") -> DataFrame:
    """I7."""
    return df.withColumn(out, F.coalesce(F.col(source_col).isin(*sources), F.lit(False)).cast("int"))


def final_score(df: DataFrame, w_similarity: float = 0.4, w_novelty: float = 0.3, w_recency: float = 0.2,
                w_source: float = 0.1, out: str = "final_score") -> DataFrame:
    """I8: weighted sum; a null input gives null."""
    e = (F.lit(w_similarity) * F.col("similarity_to_centroid") + F.lit(w_novelty) * F.col("novelty_score")
         + F.lit(w_recency) * F.col("recency_score") + F.lit(w_source) * F.col("source_score"))
    return df.withColumn(out, e)


def final_score_simple(df: DataFrame, out: str = "final_score") -> DataFrame:
    """0.5 novelty + 0.3 length share + 0.2 source flag."""
    e = F.lit(0.5) * F.col("novelty_score") + F.lit(0.3) * F.col("length_score") + F.lit(0.2) * F.col("source_flag")
    return df.withColumn(out, e)


def ensemble_scores(models: DataFrame, model_clusters: DataFrame, model_centroids: DataFrame,
                    dim: int | None = None) -> DataFrame:
    """Novelty and centroid similarity per model (each with its own clusters), averaged over models.

    models: (doc_id, model, v); model_clusters: (doc_id, model, cluster); model_centroids: (model, cluster, centroid).
    Output: (doc_id, novelty_score, similarity_to_centroid).
    """
    m = models.join(model_clusters, ["doc_id", "model"])
    u = m.select("model", "cluster", V.l2_normalize("v").alias("_u"))
    means = V.mean_vectors(u, ["model", "cluster"], "_u", out="_cmean", dim=dim)
    m = m.join(F.broadcast(means), ["model", "cluster"], "left")  # models x k rows
    m = m.join(F.broadcast(model_centroids.withColumnRenamed("centroid", "_centroid")), ["model", "cluster"], "left")
    per_model = m.select("doc_id", (F.lit(1.0) - V.dot(V.l2_normalize("v"), "_cmean")).alias("nov"),
                         V.cosine("v", "_centroid").alias("sim"))
    return per_model.groupBy("doc_id").agg(F.avg("nov").alias("novelty_score"), F.avg("sim").alias("similarity_to_centroid"))

"""Composed article tables shared by many queries: valid articles with vectors, and scored articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import areas, embed, scoring
from . import fixtures as X


def with_vectors(spark: SparkSession, sf_dir: str, articles: DataFrame) -> DataFrame:
    """Attach (cluster, v) from ``embeddings`` with one equi-join on vec_id = doc_id % n."""
    e = X.table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("cluster"),
                                                     V.as_double("embedding").alias("v"))
    n = X.embeddings_count(spark, sf_dir)
    return articles.withColumn("vec_id", F.col("doc_id") % n).join(e, "vec_id").drop("vec_id")


def normalized_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C5 over the fixture: length, word count, validity (language taken from ``lang``)."""
    a = X.articles_v(spark, sf_dir)
    return (a.withColumn("content_length", T.content_length("content").cast("long"))
            .withColumn("word_count", T.word_count("content").cast("long"))
            .withColumn("is_valid", T.is_valid("word_count", "language")))


def valid_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized_articles(spark, sf_dir).where("is_valid")


def valid_with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_vectors(spark, sf_dir, valid_articles(spark, sf_dir))


LABELS = 1 << 21  # rows of (vec_id, label) that are broadcast


def valid_with_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``valid_with_vectors`` without the vectors: up to LABELS labels, counted before, are broadcast, so texts stay where
    they are read."""
    e = X.table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("cluster"))
    n = X.embeddings_count(spark, sf_dir)
    small = e.limit(LABELS + 1).count() <= LABELS
    return valid_articles(spark, sf_dir).withColumn("vec_id", F.col("doc_id") % n).join(F.broadcast(e) if small else e, "vec_id").drop("vec_id")


def scored_articles(spark: SparkSession, sf_dir: str, as_of: str = X.AS_OF, dim: int | None = None,
                    w_similarity: float = 0.4, w_novelty: float = 0.3, w_recency: float = 0.2,
                    w_source: float = 0.1, with_area: bool = True) -> DataFrame:
    """Valid articles with cluster (= label), all score columns, final score and area."""
    dim = dim or X.vector_dim(spark, sf_dir)
    x = valid_with_vectors(spark, sf_dir)
    x = scoring.source_score(x)
    x = scoring.recency_score(x, as_of)
    x = scoring.novelty_score(x, "cluster", "v", dim)
    x = scoring.similarity_to_centroid(x, X.centroids_v(spark, sf_dir, dim))
    x = scoring.final_score(x, w_similarity, w_novelty, w_recency, w_source)
    return with_area_column(spark, x) if with_area else x


def with_area_column(spark: SparkSession, articles: DataFrame) -> DataFrame:
    """Area of each article, its text and the profile texts under the same encoder.  The encoder is Python: selections that
    do not depend on the area are cut first."""
    x = articles.withColumn("text_for_embedding", T.text_for_embedding("title", "content"))
    x = embed.embed_text(x, "md5-64", out="_text_v")
    return areas.assign_area(x, X.profiles_v(spark), vec="_text_v").drop("text_for_embedding", "_text_v")

"""Composed runs (section M): batch run, weekly incremental run, full retrain, curated newsletter.

Each is one lazy plan per sink; the only eager barriers are the KMeans fits
(iterative, on a cached input) and the writes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import areas, clusters, curate, digest, embed, ksearch, scoring, select, similarity, terms
from ..sources import files, pages
from ..streaming import streams
from ..session import ensure_checkpoint_dir, scratch_path
from . import fixtures as X
from . import slices

CSV_SCHEMA = "doc_id long, source string, url string, title string, content string, scraping_date timestamp"
# ---- fixed values (must equal the reference's) ---------------------------------
RETRAIN_SOURCES = ("Xataka", "Hugging Face Blog", "TechCrunch", "AWS Blog")  # the full retrain's corpus
# -------------------------------------------------------------------------------
MODELS = tuple(embed.ENSEMBLE)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written once, compressed, below the shared checkpoint folder and read back."""
    return terms.stored(df, name)


def batch_run(spark: SparkSession, csv_path: str, out_dir: str, as_of: str, k: int = 6, model: str = "hashing",
              run_date: str = "20240401", top_terms: int = 10, centroids: DataFrame | None = None) -> DataFrame:
    """M3: CSV -> text -> embed -> KMeans(k) -> centroid similarity -> terms, names -> scores -> CSV + Parquet.

    With ``centroids`` (cluster, centroid; in the encoder's space) rows go to the nearest of them instead of a fit."""
    a = files.read_articles_csv(spark, csv_path, CSV_SCHEMA)
    a = a.withColumn("text_for_embedding", T.text_for_embedding("title", "content"))
    a = embed.embed_text(a, model).drop("text_for_embedding")
    if centroids is None:
        a = stored(a, "batch-vectors")            # the fit reads the vectors many times
        _m, labels, cents = clusters.fit_kmeans(a, k)
        x = a.join(labels, "doc_id")
    else:
        cents, x = centroids, clusters.predict_cluster(a, centroids)
    # texts, vectors and clusters are written once; the CSV is parsed and the encoder runs in that one pass
    x = stored(scoring.similarity_to_centroid(x, cents), "batch-clusters")
    docs = terms.token_ngrams(terms.materialize(terms.clean_tokens(
        embed.detect_language(x.select("doc_id", "cluster", "content"))).select("doc_id", "cluster", "tokens")))
    # one row a cluster, read by both sinks
    names = stored(terms.name_clusters(terms.top_terms_per_cluster(terms.tfidf(docs), docs.select("doc_id", "cluster"),
                                                                   top_terms)), "batch-names")
    x = terms.attach_cluster_name(x, names)
    x = scoring.novelty_score(x, "cluster", "v", embed.ENCODERS[model][1])
    x = scoring.recency_score(x, as_of)
    x = scoring.source_score(x)
    x = scoring.final_score(x, 0.4, 0.3, 0.2, 0.5)
    files.write_articles_parquet(x, f"{out_dir}/parquet", run_date, mode="overwrite")
    out = spark.read.parquet(f"{out_dir}/parquet").where(F.col("run_date") == run_date)
    files.write_articles_csv(out.select(*x.columns).drop("v"), f"{out_dir}/csv")
    return out


def weekly_run(spark: SparkSession, pages_df: DataFrame, centroids: DataFrame, as_of: str, out_path: str,
               ledger_root: str, version: str, generated_at: str, model: str = "hashing", top_n: int = 3) -> DataFrame:
    """M4: new links only -> articles -> normalise -> embed -> nearest centre -> scores -> append -> ledger -> digest.

    The same body runs per micro-batch in ``streams.stream_ingest`` (L1).
    """
    rules = pages.source_rules(spark)
    streams.ingest_batch(pages_df, rules, centroids, lambda d: embed.embed_text(d, model), as_of, out_path,
                         ledger_root, version, dim=embed.ENCODERS[model][1])
    # copies of one text tie: compare scores at 12 decimals, so the order of a sum cannot decide
    combined = spark.read.parquet(out_path).withColumn("final_score", F.round("final_score", 12))
    return digest.digest_weekly(combined, generated_at, top_n, key="page_id")


def full_retrain(spark: SparkSession, corpus: DataFrame, model_root: str, corpus_root: str, as_of_stamp: str,
                 k_min: int = 4, k_max: int = 12, model: str = "hashing", top_terms: int = 12) -> DataFrame:
    """M5: corpus (four sources) -> text -> embed -> best k -> KMeans -> TF-IDF on the preprocessed content -> terms ->
    model, embeddings, vocabulary and terms of this version, corpus snapshot with clusters, metadata row (K7)."""
    c = corpus.where(F.col("source").isin(*RETRAIN_SOURCES))
    c = c.withColumn("text_for_embedding", T.text_for_embedding("title", "content"))
    # the search, the labels and the stored embeddings read the slim (id, v) only; texts stay where they are
    best_k, scores, models, vectors = ksearch.search_k(embed.embed_text(c, model).select("doc_id", "v"), k_min, k_max)
    labels = ksearch.assign(vectors, models[best_k]).checkpoint()
    docs = terms.ngrams(terms.materialize(c.select("doc_id", T.basic_preprocess("content").alias("text_tfidf"))))
    tf = terms.stored_counts(docs)                # the weights and the vocabulary read one count
    vocab = terms.stored_vocabulary(docs, tf=tf)
    top = terms.top_terms_per_cluster(terms.tfidf(docs, tf=tf, vocab=vocab), labels, top_terms)
    files.save_centroid_version(ksearch.centroid_table(spark, models[best_k]), model_root, as_of_stamp)
    top.write.mode("overwrite").parquet(f"{model_root}/terms/v={as_of_stamp}")
    vocab.select("term", "idf").write.mode("overwrite").parquet(f"{model_root}/vocabulary/v={as_of_stamp}")
    files.save_embeddings_version(vectors.withColumnRenamed("id", "doc_id"), f"{model_root}/embeddings", as_of_stamp)
    files.write_articles_parquet(terms.by_document(c, labels), corpus_root, as_of_stamp, mode="overwrite")
    return digest.retrain_metadata(spark, best_k, scores, model, as_of_stamp)


def curated_scores(spark: SparkSession, sf_dir: str, threshold: float = 0.85, as_of: str = X.AS_OF,
                   dim: int | None = None, w_novelty: float = 0.3) -> tuple[DataFrame, list[tuple[str, DataFrame]]]:
    """M6 up to the scores: D9 -> three models (E3) -> clusters (fixed: the labels) -> E6 -> H2 -> I10 -> I1, I2 ->
    I8 -> J2.  Returns the scored table and the named stages (for K2)."""
    dim = dim or X.vector_dim(spark, sf_dir)
    v = slices.valid_with_vectors(spark, sf_dir)
    # every later branch (models, pairs, losers, centroids, scores) starts here: materialise it once in the
    # shared checkpoint folder instead of re-reading and re-counting the texts per branch
    ensure_checkpoint_dir(spark)
    f = select.exclude_source(v).select("doc_id", "source", "url", "title", "content", "language", "scraping_date",
                                        "cluster", "word_count", "v").checkpoint()
    models = X.models_v(spark, sf_dir, f.select("doc_id", "v"))
    mclusters = models.select("doc_id", "model").join(f.select("doc_id", "cluster"), "doc_id")
    # centroids are fitted before duplicates are removed, then used after
    cents = V.mean_vectors(models.join(mclusters, ["doc_id", "model"]), ["model", "cluster"], "v", out="centroid", dim=dim)
    curated = curate.near_duplicates(f, threshold, models=models)  # best neighbour per article, no pair list
    cm = models.join(curated.select("doc_id"), "doc_id", "left_semi")
    es = scoring.ensemble_scores(cm, mclusters, cents, dim)
    x = curated.join(es, "doc_id")
    x = scoring.source_score(x)
    x = scoring.recency_score(x, as_of)
    x = scoring.final_score(x, 0.4, w_novelty, 0.2, 0.1)
    x = x.join(areas.assign_area_ensemble(X.text_models(x, MODELS), X.profiles_v(spark, MODELS)).select("doc_id", "area"), "doc_id")
    return x, [("filtered", f), ("curated", curated), ("scored", x)]


def curated_newsletter(spark: SparkSession, sf_dir: str, threshold: float = 0.85, top_n: int = 3,
                       as_of: str = X.AS_OF, w_novelty: float = 0.3) -> DataFrame:
    """M6 (flagship composition): curated, scored articles -> best ``top_n`` per area -> one digest per area.  The two
    known forms of this run differ in the weight of novelty (0.3 and 0.4)."""
    x, _ = curated_scores(spark, sf_dir, threshold, as_of, w_novelty=w_novelty)
    return digest.digest_by_area(x, X.profiles_v(spark), top_n)

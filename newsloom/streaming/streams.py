"""Structured Streaming forms of the incremental run (section L).

* L1 ``stream_ingest``: pages arriving as files -> extract, normalise, drop URLs
  already seen, assign cluster, score, append -- one ``foreachBatch`` per
  micro-batch, restartable from its checkpoint (``trigger(availableNow=True)``
  for scheduled catch-up runs).
* L2 ``stream_url_dedupe``: ``dropDuplicatesWithinWatermark`` on url.
* L3 ``stream_feedback_counts``: weekly tumbling windows starting Monday
  06:00 with a watermark; rows later than the watermark are dropped (judged, as Spark does for chained
  stateful operators, against the previous micro-batch's watermark).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import clusters, scoring
from ..sources import files, pages

PAGES_SCHEMA = "page_id long, url string, html string"
FEEDBACK_STREAM_SCHEMA = "event_id long, url string, rating string, ts timestamp"
WEEK = "7 days"
# 1970-01-01 is a Thursday: shifting by 4 days 6 hours starts every window on Monday 06:00
MONDAY_0600 = "4 days 6 hours"


def pages_stream(spark: SparkSession, folder: str, max_files_per_trigger: int | None = 1) -> DataFrame:
    r = spark.readStream.schema(PAGES_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(folder)


def page_language(html_col: str = "html"):
    """Declared page language (<html lang="..">), lower case primary subtag."""
    return F.lower(F.nullif(F.regexp_extract(F.col(html_col), r'(?i)<html[^>]*\blang="([A-Za-z]+)', 1), F.lit("")))


def ingest_batch(batch: DataFrame, rules: DataFrame, centroids: DataFrame, embed, as_of: str, out_path: str,
                 ledger_root: str, version: str, dim: int | None = None, weights: dict | None = None) -> None:
    """The body of the weekly incremental run for one micro-batch (also usable as a plain batch job).

    ``embed`` maps a DataFrame with ``text_for_embedding`` to one with a ``v`` column (E1).
    """
    spark = batch.sparkSession
    ledger = files.ledger_before(spark, ledger_root, version)  # replay-safe: never the batch's own ledger
    fresh = batch.join(ledger, "url", "left_anti")
    # of the pages of one url always the one with the smallest id, whatever the order of the rows
    fresh = fresh.groupBy("url").agg(F.min(F.struct("page_id", "html")).alias("p")).select("p.page_id", "url", "p.html")
    arts = pages.build_articles(fresh, rules, as_of)
    arts = arts.join(fresh.select("page_id", page_language("html").alias("language")), "page_id")
    arts = (arts.withColumn("content_length", T.content_length("content"))
            .withColumn("word_count", T.word_count("content"))
            .withColumn("is_valid", T.is_valid("word_count", "language"))
            .where("is_valid")
            .withColumn("text_for_embedding", T.text_for_embedding("title", "content")))
    arts = embed(arts)
    arts = clusters.predict_cluster(arts, centroids)
    arts = scoring.source_score(arts, weights=weights)
    arts = scoring.similarity_to_centroid(arts, centroids)
    arts = scoring.novelty_score(arts, "cluster", "v", dim)
    arts = scoring.recency_score(arts, as_of)
    arts = scoring.final_score(arts, 0.4, 0.3, 0.2, 0.5).persist()
    try:
        # idempotent on replay: a batch owns its folder and overwrites it; the ledger version is the batch's too
        arts.write.mode("overwrite").parquet(f"{out_path}/batch_id={version}")
        files.append_processed_urls(spark, ledger_root, arts.select("url"), version)
    finally:
        arts.unpersist()


def stream_ingest(spark: SparkSession, folder: str, rules: DataFrame, centroids: DataFrame, embed, as_of: str,
                  out_path: str, ledger_root: str, checkpoint: str, dim: int | None = None):
    """L1: run the incremental ingest over every page file available now; returns the finished query."""
    def run(batch: DataFrame, epoch: int):
        ingest_batch(batch, rules, centroids, embed, as_of, out_path, ledger_root, f"{epoch:06d}", dim)

    q = (pages_stream(spark, folder).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def stream_url_dedupe(stream: DataFrame, ts_col: str = "ts", delay: str = "1 day", url_col: str = "url") -> DataFrame:
    """L2: each url once while it is within the watermark."""
    return stream.withWatermark(ts_col, delay).dropDuplicatesWithinWatermark([url_col])


def weekly_windows(df: DataFrame, ts_col: str = "ts", key: str = "rating") -> DataFrame:
    """Batch twin of L3 (feedback_weekly): counts per Monday-06:00 week and rating."""
    w = F.window(F.col(ts_col), WEEK, WEEK, MONDAY_0600)
    return df.groupBy(w.alias("week"), key).agg(F.count(F.lit(1)).alias("n"))


def stream_feedback_counts(stream: DataFrame, ts_col: str = "ts", delay: str = "7 days", key: str = "rating") -> DataFrame:
    """L3: weekly counts per rating with a watermark; rows later than the watermark are dropped."""
    return weekly_windows(stream.withWatermark(ts_col, delay), ts_col, key)


def run_to_table(stream_df: DataFrame, path: str, checkpoint: str, output_mode: str = "append"):
    """Drive a streaming DataFrame to a Parquet table with availableNow; each batch lands in ``batch_id=<epoch>``."""
    def sink(batch: DataFrame, epoch: int):
        # foreachBatch is at-least-once: each epoch overwrites its own folder, so a replayed batch is not doubled
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={epoch}")

    q = (stream_df.writeStream.outputMode(output_mode).foreachBatch(sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q

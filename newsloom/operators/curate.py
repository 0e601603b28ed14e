"""Joins and set operations used for curation (section H)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import ensure_checkpoint_dir
from .similarity import best_neighbours, stacked_models


def new_links(links: DataFrame, ledger: DataFrame, url_col: str = "url") -> DataFrame:
    """H1: links not yet in the ledger (anti join; the ledger is never collected)."""
    return links.join(ledger.select(F.col(url_col)).distinct(), url_col, "left_anti")


def losers_from_best(best: DataFrame, articles: DataFrame, id_col: str = "doc_id", wc_col: str = "word_count") -> DataFrame:
    """x is dropped iff some neighbour outranks it: more words, or as many words and an earlier id (= the pair rule
    applied to every pair, non-transitively)."""
    a = articles.select(F.col(id_col).cast("long").alias("id"), F.col(wc_col).alias("_wc"))
    j = best.join(a, "id")
    lost = (F.col("best_wc") > F.col("_wc")) | ((F.col("best_wc") == F.col("_wc")) & (F.col("best_id") < F.col("id")))
    return j.where(lost).select(F.col("id").alias(id_col))


def near_duplicates(articles: DataFrame, threshold: float, id_col: str = "doc_id", vec: str = "v",
                    wc_col: str = "word_count", models: DataFrame | None = None, blocks: int | None = None) -> DataFrame:
    """H2: drop near duplicates: of each pair above the threshold the one with fewer words, a tie drops the later.

    No pair list is built: each article only needs its best-ranked neighbour (E5 similarity, or E6 when ``models``
    (long form) are given).  Not transitive and not greedy: an article already dropped still knocks out others.
    """
    wc = articles.select(F.col(id_col).cast("long").alias("id"), F.col(wc_col).cast("long").alias("wc"))
    if models is None:
        vectors = articles.select(F.col(id_col).cast("long").alias("id"), F.col(vec).alias("v"))
    else:
        vectors = stacked_models(models, id_col, "model", "v").select(F.col(id_col).cast("long").alias("id"), "v")
    ensure_checkpoint_dir(articles.sparkSession)
    rows = vectors.join(wc, "id").checkpoint()
    alike, rest = _one_per_vector(rows, threshold)
    best = best_neighbours(rest, threshold, "id", "v", "wc", blocks, normalize=models is None)
    lost = losers_from_best(best, rest, "id", "wc").unionByName(alike).withColumnRenamed("id", id_col)
    return articles.join(lost, id_col, "left_anti")


def _one_per_vector(rows: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(ids that an equal vector's row outranks, all other rows).  Copies have one set of neighbours, so the best ranked of
    them decides for all: a third of all rows alike cost one aggregate, not their pairs."""
    if threshold >= 1.0 - 1e-9:                      # not even copies are above it
        return rows.limit(0).select("id"), rows
    ranked = rows.where(rows.wc.isNotNull() & (V.sumsq("v") > 0))
    top = ranked.groupBy("v").agg(F.max(F.struct("wc", (-F.col("id")).alias("nid"))).alias("t"), F.count("*").alias("n"))
    top = top.where("n > 1").select((-F.col("t.nid")).alias("id"), "v").checkpoint()        # of repeated vectors only
    alike = ranked.join(top.select("v"), "v", "left_semi").join(top.select("id"), "id", "left_anti").select("id").checkpoint()
    return alike, rows.join(alike, "id", "left_anti")

"""Filters, selection, ordering and top-k (section D).

Top-k per group uses ``row_number() <= n`` which Catalyst plans as a partial
``WindowGroupLimit`` before the shuffle: each map task forwards at most n rows
per group, so a hot cluster or area cannot pile its rows into one reducer.
Global top-k uses ``orderBy().limit()`` (``TakeOrderedAndProject``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import regex_contains_ci

# ---- fixed values (must equal the reference's) ---------------------------------
PAGE_COLUMNS = ["title", "url", "source", "cluster", "final_score", "scraping_date"]  # API page projection
ALL = "Todas"  # the "no filter" facet value
# -------------------------------------------------------------------------------


def filter_source_regex(df: DataFrame, pattern: str, source_col: str = "source") -> DataFrame:
    """Source contains ``pattern`` (a regex), case-insensitive; null source never matches."""
    return df.where(regex_contains_ci(source_col, pattern))


def filter_date_range(df: DataFrame, start_date: str | None = None, end_date: str | None = None,
                      ts_col: str = "scraping_date") -> DataFrame:
    """D3: inclusive bounds; a date bound means midnight, so later hours of the end day are out."""
    if start_date:
        df = df.where(F.col(ts_col) >= F.to_timestamp(F.lit(start_date)))
    if end_date:
        df = df.where(F.col(ts_col) <= F.to_timestamp(F.lit(end_date)))
    return df


def exclude_source(df: DataFrame, pattern: str = "wired", source_col: str = "source") -> DataFrame:
    """Drop rows whose source contains ``pattern`` (case-insensitive); null sources are kept."""
    return df.where(~regex_contains_ci(source_col, pattern))


def _check(cond: bool, msg: str):
    if not cond:
        raise ValueError(msg)


def list_articles(df: DataFrame, skip: int = 0, limit: int = 10, source: str | None = None,
                  start_date: str | None = None, end_date: str | None = None, cluster: int | None = None,
                  key: str = "doc_id") -> DataFrame:
    """One page of articles with total / skip / limit / returned on every row.

    Filters are pushed into the scan by Catalyst; the total is a scalar subquery
    (one partial count), the page is ordered by the key and cut with offset/limit.
    """
    _check(isinstance(skip, int) and skip >= 0, "skip must be >= 0")
    _check(isinstance(limit, int) and 1 <= limit <= 100, "limit must be in 1..100")
    _check(cluster is None or cluster >= 0, "cluster must be >= 0")
    f = df
    if source:
        f = filter_source_regex(f, source)
    f = filter_date_range(f, start_date, end_date)
    if cluster is not None:
        f = f.where(F.col("cluster") == cluster)
    total = f.select(F.count(F.lit(1))).scalar()
    page = f.orderBy(key).offset(skip).limit(limit).select(key, *PAGE_COLUMNS).withColumn("total", total)
    returned = F.least(F.lit(limit).cast("long"), F.greatest(F.col("total") - skip, F.lit(0)))
    return page.select(F.lit(skip).alias("skip"), F.lit(limit).alias("limit"), "total", returned.alias("returned"), key, *PAGE_COLUMNS)


def top_articles(df: DataFrame, limit: int = 10, cluster: int | None = None, min_score: float = 0.0,
                 key: str = "doc_id") -> DataFrame:
    """Score >= min_score (and cluster), best ``limit`` by final_score desc; ties by key; total on every row."""
    _check(isinstance(limit, int) and 1 <= limit <= 50, "limit must be in 1..50")
    _check(0.0 <= min_score <= 1.0, "min_score must be in [0, 1]")
    _check(cluster is None or cluster >= 0, "cluster must be >= 0")
    f = df.where(F.col("final_score") >= F.lit(min_score))
    if cluster is not None:
        f = f.where(F.col("cluster") == cluster)
    total = f.select(F.count(F.lit(1))).scalar()
    top = f.orderBy(F.desc("final_score"), F.asc(key)).limit(limit).select(key, *PAGE_COLUMNS)
    return top.withColumn("total", total)


def top_n_per_group(df: DataFrame, group_col: str, n: int, score_col: str = "final_score", key: str = "doc_id",
                    rank_col: str = "rank") -> DataFrame:
    """Best n rows per group by score desc, ties by key (WindowGroupLimit-planned)."""
    w = Window.partitionBy(group_col).orderBy(F.desc(score_col), F.asc(key))
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


def top_n_per_cluster(df: DataFrame, n: int = 3, **kw) -> DataFrame:
    """D5."""
    return top_n_per_group(df, "cluster", n, **kw)


def top_n_per_area(df: DataFrame, n: int = 3, **kw) -> DataFrame:
    """D6."""
    return top_n_per_group(df, "area", n, **kw)


def dashboard_view(df: DataFrame, source: str = ALL, area: str = ALL, k: int = 10, key: str = "doc_id") -> DataFrame:
    """Equality filters unless 'Todas', then the best k by score."""
    f = df
    if source != ALL:
        f = f.where(F.col("source") == source)
    if area != ALL:
        f = f.where(F.col("area") == area)
    return f.orderBy(F.desc("final_score"), F.asc(key)).limit(k)


def facet_values(df: DataFrame, column: str) -> DataFrame:
    """D8: 'Todas' first, then the sorted distinct non-null values (pos, value).

    Only the distinct values (a handful of sources / areas) reach the final ordering.
    """
    vals = df.select(F.col(column).alias("value")).where(F.col("value").isNotNull()).distinct()
    ranked = vals.withColumn("pos", F.row_number().over(Window.orderBy("value")).cast("int"))
    head = df.sparkSession.range(1).select(F.lit(0).alias("pos"), F.lit(ALL).alias("value"))
    return head.unionByName(ranked.select("pos", "value"))


def top_k(df: DataFrame, k: int, score_col: str, key: str = "doc_id") -> DataFrame:
    """Global top-k (D12 and friends): TakeOrderedAndProject."""
    return df.orderBy(F.desc(score_col), F.asc(key)).limit(k)

"""Edge rules of normalisation, scores and selection on hand-made rows (FIXTURES §4 articles_edge)."""

import math

import pytest
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators import scoring, select

AS_OF = "2024-04-01 00:00:00"


def words(n):
    return " ".join(["word"] * n)


@pytest.fixture()
def edge(spark):
    rows = [
        (1, "TechCrunch", "u1", "T1", words(150), "en", "2024-03-31 23:00:00"),
        (2, "Wired ES", "u2", "T2", words(151), "es", "2024-03-01 00:00:00"),
        (3, "wIrEd", "u3", None, words(151), "fr", "2024-05-01 00:00:00"),  # future date, fr, null title
        (4, None, "u4", "T4", words(200), "en", "2024-03-01 08:00:00"),       # null source, after midnight
        (5, "AWS Blog", "u5", "T5", words(300), "en", "2024-03-01 00:00:00"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, source string, url string, title string, content string, "
                                     "language string, scraping_date string")
    return df.withColumn("scraping_date", F.to_timestamp("scraping_date"))


def test_validity_is_strictly_more_than_150_words(edge):
    v = edge.withColumn("wc", T.word_count("content")).withColumn("ok", T.is_valid("wc", "language"))
    got = {r.doc_id: r.ok for r in v.collect()}
    assert got == {1: False, 2: True, 3: False, 4: True, 5: True}


def test_text_for_embedding_null_title_gives_null(edge):
    got = {r.doc_id: r.t for r in edge.select("doc_id", T.text_for_embedding("title", "content").alias("t")).collect()}
    assert got[3] is None
    assert got[1].startswith("t1. word")


def test_recency_future_above_one_and_whole_days(edge):
    r = {x.doc_id: x.recency_score for x in scoring.recency_score(edge, AS_OF).collect()}
    assert r[3] > 1.0
    assert r[1] == pytest.approx(1.0)  # 1 hour ago: zero whole days
    assert r[2] == pytest.approx(math.exp(-31 / 30))


def test_source_weights_default_and_exact_names(edge):
    s = {x.doc_id: x.source_score for x in scoring.source_score(edge).collect()}
    assert s == {1: 1.0, 2: 0.6, 3: 0.5, 4: 0.5, 5: 0.5}


def test_regex_source_filter_and_exclusion_keep_nulls(edge):
    assert {r.doc_id for r in select.filter_source_regex(edge, "WIRED").collect()} == {2, 3}
    assert {r.doc_id for r in select.exclude_source(edge).collect()} == {1, 4, 5}


def test_end_date_is_midnight(edge):
    got = {r.doc_id for r in select.filter_date_range(edge, "2024-03-01", "2024-03-01").collect()}
    assert got == {2, 5}  # doc 4 is 08:00 on the end day: out


def test_final_score_null_in_null_out(spark):
    df = spark.createDataFrame([(1, 1.0, None, 1.0, 1.0)], "doc_id long, similarity_to_centroid double, "
                               "novelty_score double, recency_score double, source_score double")
    assert scoring.final_score(df).first().final_score is None


def test_top_n_ties_by_key(spark):
    df = spark.createDataFrame([(i, 0, 0.5) for i in range(5)], "doc_id long, cluster int, final_score double")
    got = [r.doc_id for r in select.top_n_per_cluster(df, 3).orderBy("rank").collect()]
    assert got == [0, 1, 2]


def test_top_n_is_planned_with_a_partial_group_limit(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("cluster"),
                                  F.rand(1).alias("final_score"))
    plan = select.top_n_per_cluster(df, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_list_articles_validates_arguments(spark, edge):
    df = edge.withColumn("cluster", F.lit(0)).withColumn("final_score", F.lit(0.5))
    with pytest.raises(ValueError):
        select.list_articles(df, skip=-1)
    with pytest.raises(ValueError):
        select.list_articles(df, limit=101)
    with pytest.raises(ValueError):
        select.top_articles(df, limit=51)
    page = select.list_articles(df, skip=1, limit=2).collect()
    assert [r.doc_id for r in page] == [2, 3] and page[0].total == 5 and page[0].returned == 2


def test_facets_start_with_todas(spark, edge):
    got = [r.value for r in select.facet_values(edge, "source").orderBy("pos").collect()]
    assert got == ["Todas", "AWS Blog", "TechCrunch", "Wired ES", "wIrEd"]


def test_title_case_like_python(spark):
    df = spark.createDataFrame([("machine / learning / x-ray 2nd",)], "s string")
    assert df.select(T.title_case("s")).first()[0] == "machine / learning / x-ray 2nd".title()


def test_parse_feed_date_drops_offset_and_rejects_named_zones(spark):
    df = spark.createDataFrame([("Mon, 01 Jan 2024 10:00:00 +0200",), ("Mon, 01 Jan 2024 10:00:00 GMT",), ("garbage",),
                                (None,)], "s string")
    got = [r[0] for r in df.select(F.date_format(T.parse_feed_date("s"), "yyyy-MM-dd HH:mm:ss")).collect()]
    assert got == ["2024-01-01 10:00:00", None, None, None]


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_flagship_invariant_to_partitioning(spark, parts):
    """Same result whatever the shuffle width."""
    from newsloom.plans import catalog
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = sorted(map(tuple, catalog.flagship(spark, "/root/testdata/sf0.001").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    want = sorted(map(tuple, catalog.flagship(spark, "/root/testdata/sf0.001").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == want


def test_scan_partitions_are_the_callers_choice(spark):
    from newsloom.plans.fixtures import spread

    df = spark.range(10).repartition(2)
    assert spread(df).rdd.getNumPartitions() == 2
    spark.conf.set("spark.newsloom.scanPartitions", "5")
    try:
        assert spread(df).rdd.getNumPartitions() == 5
    finally:
        spark.conf.unset("spark.newsloom.scanPartitions")

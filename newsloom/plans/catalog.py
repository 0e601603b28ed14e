"""Registered queries: each Spark query next to its DuckDB oracle SQL.

Every query reads the driver tables (through the fixture views) and runs over
whole tables.  Doubles leave rounded to 6 places and timestamps as strings on
both sides, so value hashes compare across engines.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import areas, clusters, curate, hierarchy, ksearch, scoring, select, similarity, terms
from . import fixtures as X
from . import ksearch_sql as KS
from . import slices
from ..operators import embed as EM
from ..operators import language as LG
from .oracle import AS_OF_SQL, area_sql, assigned, cosine, md5_encoded, mean_vec_sql, preprocess, source_weight, unit, with_views, word_count

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def r6(c) -> Column:
    return F.round(V.col(c).cast("double"), 6)


def ts(c) -> Column:
    return F.date_format(V.col(c), "yyyy-MM-dd HH:mm:ss")


def TS(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def dim_of(spark, sf):
    return X.vector_dim(spark, sf)


def emb_vectors(spark, sf) -> DataFrame:
    return X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("cluster"),
                                                   V.as_double("embedding").alias("v"))


# ================================ C: scalar functions ================================

@register("content_length", with_views("SELECT doc_id, CAST(length(content) AS BIGINT) AS content_length FROM articles_v",
                                       "articles_v"))
def q_content_length(spark, sf):
    return X.articles_v(spark, sf).select("doc_id", T.content_length("content").cast("long").alias("content_length"))


@register("word_count", with_views(f"SELECT doc_id, {word_count('content')} AS word_count FROM articles_v", "articles_v"))
def q_word_count(spark, sf):
    return X.articles_v(spark, sf).select("doc_id", T.word_count("content").cast("long").alias("word_count"))


@register("is_valid", with_views("SELECT doc_id, is_valid FROM norm_v", "norm_v"))
def q_is_valid(spark, sf):
    return slices.normalized_articles(spark, sf).select("doc_id", "is_valid")


@register("normalize_articles", with_views(
    "SELECT doc_id, content_length, word_count, language, is_valid FROM norm_v WHERE is_valid", "norm_v"))
def q_normalize_articles(spark, sf):
    return slices.valid_articles(spark, sf).select("doc_id", "content_length", "word_count", "language", "is_valid")


@register("basic_preprocess", with_views(f"SELECT doc_id, {preprocess('content')} AS text FROM articles_v", "articles_v"))
def q_basic_preprocess(spark, sf):
    return X.articles_v(spark, sf).select("doc_id", T.basic_preprocess("content").alias("text"))


@register("text_for_embedding", with_views(
    f"SELECT doc_id, {preprocess(chr(40) + 'title || ' + chr(39) + '. ' + chr(39) + ' || content' + chr(41))} AS text_for_embedding FROM articles_v",
    "articles_v"))
def q_text_for_embedding(spark, sf):
    return X.articles_v(spark, sf).select("doc_id", T.text_for_embedding("title", "content").alias("text_for_embedding"))


# RFC-822 strings derived from the events table: valid numeric offsets, a missing weekday, a named zone, garbage.
_RAW_DATE_SPARK = """CASE event_type
  WHEN 'error' THEN 'not a date'
  WHEN 'view' THEN date_format(ts, 'dd MMM yyyy HH:mm:ss') || ' +0000'
  WHEN 'click' THEN date_format(ts, 'EEE, dd MMM yyyy HH:mm:ss') || ' GMT'
  ELSE date_format(ts, 'EEE, dd MMM yyyy HH:mm:ss') || ' +0' || CAST(user_id % 10 AS STRING) || '00' END"""
_RAW_DATE_DUCK = """CASE event_type
  WHEN 'error' THEN 'not a date'
  WHEN 'view' THEN strftime(ts, '%d %b %Y %H:%M:%S') || ' +0000'
  WHEN 'click' THEN strftime(ts, '%a, %d %b %Y %H:%M:%S') || ' GMT'
  ELSE strftime(ts, '%a, %d %b %Y %H:%M:%S') || ' +0' || CAST(user_id % 10 AS VARCHAR) || '00' END"""


@register("parse_feed_date", f"""SELECT event_id, raw_date,
  {TS("try_strptime(nullif(regexp_extract(trim(raw_date), '" + T.RFC822_PATTERN.replace(chr(92), chr(92)) + "', 1), ''), '%d %b %Y %H:%M:%S')")} AS published
FROM (SELECT event_id, {_RAW_DATE_DUCK} AS raw_date FROM events)""")
def q_parse_feed_date(spark, sf):
    ev = X.table(spark, sf, "events").select("event_id", F.expr(_RAW_DATE_SPARK).alias("raw_date"))
    return ev.select("event_id", "raw_date", ts(T.parse_feed_date("raw_date")).alias("published"))


@register("truncate_summary", with_views("SELECT doc_id, substr(content, 1, 300) AS summary FROM articles_v", "articles_v"))
def q_truncate_summary(spark, sf):
    return X.articles_v(spark, sf).select("doc_id", T.truncate_summary("content").alias("summary"))


def _feed_cols():
    return [F.when(F.col("language") == "fr", F.lit("")).when(F.col("language") == "de", F.lit(None))
            .otherwise(F.col("content")).alias("feed_content"),
            F.when(F.col("language") == "es", F.lit(None)).otherwise(F.col("title")).alias("feed_summary")]


@register("feed_content", with_views("""SELECT doc_id, coalesce(nullif(feed_content, ''), feed_summary, '') AS rss_content FROM (
  SELECT doc_id, CASE WHEN language = 'fr' THEN '' WHEN language = 'de' THEN NULL ELSE content END AS feed_content,
    CASE WHEN language = 'es' THEN NULL ELSE title END AS feed_summary FROM articles_v)""", "articles_v"))
def q_feed_content(spark, sf):
    a = X.articles_v(spark, sf).select("doc_id", *_feed_cols())
    return a.select("doc_id", T.feed_content("feed_content", "feed_summary").alias("rss_content"))


@register("title_case_names", with_views("""SELECT doc_id,
  array_to_string(list_transform(regexp_extract_all(title, '(\\p{L}+|[^\\p{L}]+)'),
    lambda p: (CASE WHEN substr(p, 1, 1) = chr(223) THEN 'Ss' ELSE upper(substr(p, 1, 1)) END) || lower(substr(p, 2))), '') AS title_case
FROM articles_v""", "articles_v"))
def q_title_case(spark, sf):
    return X.articles_v(spark, sf).select("doc_id", T.title_case("title").alias("title_case"))


# ================================ D: selection ================================

PAGE_SQL = f"doc_id, title, url, source, cluster, round(final_score, 6) AS final_score, {TS('scraping_date')} AS scraping_date"


def page_cols(df: DataFrame) -> DataFrame:
    return df.withColumn("final_score", r6("final_score")).withColumn("scraping_date", ts("scraping_date"))


@register("list_articles", with_views(f"""WITH f AS (SELECT * FROM final_v
  WHERE coalesce(regexp_matches(source, 'o', 'i'), false)
    AND scraping_date >= TIMESTAMP '2024-01-15' AND scraping_date <= TIMESTAMP '2024-03-01'),
page AS (SELECT * FROM f ORDER BY doc_id LIMIT 20 OFFSET 5)
SELECT 5 AS skip, 20 AS "limit", (SELECT count(*) FROM f) AS total, (SELECT count(*) FROM page) AS returned, {PAGE_SQL}
FROM page""", "final_v"))
def q_list_articles(spark, sf):
    s = slices.scored_articles(spark, sf)
    return page_cols(select.list_articles(s, skip=5, limit=20, source="o", start_date="2024-01-15", end_date="2024-03-01"))


@register("filter_source_regex", with_views(
    "SELECT doc_id, source FROM articles_v WHERE coalesce(regexp_matches(source, 'face|CRUNCH', 'i'), false)", "articles_v"))
def q_filter_source_regex(spark, sf):
    return select.filter_source_regex(X.articles_v(spark, sf), "face|CRUNCH").select("doc_id", "source")


@register("filter_date_range", with_views(
    f"SELECT doc_id, {TS('scraping_date')} AS scraping_date FROM articles_v "
    "WHERE scraping_date >= TIMESTAMP '2024-02-01' AND scraping_date <= TIMESTAMP '2024-02-15'", "articles_v"))
def q_filter_date_range(spark, sf):
    f = select.filter_date_range(X.articles_v(spark, sf), "2024-02-01", "2024-02-15")
    return f.select("doc_id", ts("scraping_date").alias("scraping_date"))


@register("top_articles", with_views(f"""WITH f AS (SELECT * FROM final_v WHERE final_score >= 0.3)
SELECT {PAGE_SQL}, (SELECT count(*) FROM f) AS total FROM f ORDER BY final_score DESC, doc_id LIMIT 50""", "final_v"))
def q_top_articles(spark, sf):
    return page_cols(select.top_articles(slices.scored_articles(spark, sf), limit=50, min_score=0.3))


def _topn_sql(group: str, n: int) -> str:
    return with_views(f"""SELECT {group}, rank, doc_id, round(final_score, 6) AS final_score FROM (
  SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY final_score DESC, doc_id) AS rank FROM final_v)
WHERE rank <= {n}""", "final_v")


_SCORE_COLS = ["similarity_to_centroid", "novelty_score", "recency_score", "source_score", "final_score"]


@register("top_n_per_cluster", with_views(f"""SELECT cluster, rank, doc_id, title, source, area,
  {", ".join(f"round({c}, 6) AS {c}" for c in _SCORE_COLS)} FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY final_score DESC, doc_id) AS rank FROM final_v)
WHERE rank <= 3""", "final_v"))
def flagship(spark, sf):
    """Best 3 articles per cluster with their scores (the minimum end-to-end slice)."""
    top = select.top_n_per_cluster(slices.scored_articles(spark, sf, with_area=False), 3)
    t = slices.with_area_column(spark, top)
    return t.select("cluster", F.col("rank").cast("long").alias("rank"), "doc_id", "title", "source", "area",
                    *[r6(c).alias(c) for c in _SCORE_COLS])


@register("top_n_per_area", _topn_sql("area", 3))
def q_top_n_per_area(spark, sf):
    t = select.top_n_per_area(slices.scored_articles(spark, sf), 3)
    return t.select("area", F.col("rank").cast("long").alias("rank"), "doc_id", r6("final_score").alias("final_score"))


@register("dashboard_view", with_views("""SELECT doc_id, title, source, area, round(final_score, 6) AS final_score FROM final_v
WHERE source = 'TechCrunch' ORDER BY final_score DESC, doc_id LIMIT 15""", "final_v"))
def q_dashboard_view(spark, sf):
    d = select.dashboard_view(slices.scored_articles(spark, sf, with_area=False), source="TechCrunch", area="Todas", k=15)
    d = slices.with_area_column(spark, d)
    return d.select("doc_id", "title", "source", "area", r6("final_score").alias("final_score"))


@register("facet_values", with_views("""SELECT 0 AS pos, 'Todas' AS value
UNION ALL SELECT CAST(row_number() OVER (ORDER BY value) AS INTEGER) AS pos, value FROM (SELECT DISTINCT area AS value FROM final_v WHERE area IS NOT NULL)""",
                                     "final_v"))
def q_facet_values(spark, sf):
    return select.facet_values(slices.scored_articles(spark, sf), "area")


@register("exclude_source", with_views(
    "SELECT doc_id, source FROM articles_v WHERE NOT coalesce(regexp_matches(source, 'wired', 'i'), false)", "articles_v"))
def q_exclude_source(spark, sf):
    return select.exclude_source(X.articles_v(spark, sf)).select("doc_id", "source")


_SEMANTIC_SQL = f"""sem AS (SELECT u.doc_id, list_dot_product(u.u, g.m) AS semantic_score
  FROM valid_unit_v u, ({'SELECT list(val ORDER BY i) AS m FROM (SELECT i, avg(x) AS val FROM (SELECT unnest(range(1, len(u) + 1)) AS i, unnest(u) AS x FROM valid_unit_v) GROUP BY i)'}) g)"""


@register("semantic_top", with_views(f"""WITH {_SEMANTIC_SQL}
SELECT doc_id, round(semantic_score, 6) AS semantic_score FROM sem ORDER BY semantic_score DESC, doc_id LIMIT 10""",
                                     "valid_unit_v"))
def q_semantic_top(spark, sf):
    s = scoring.semantic_score(slices.valid_with_vectors(spark, sf).select("doc_id", "v"), "v", dim_of(spark, sf))
    return select.top_k(s, 10, "semantic_score").select("doc_id", r6("semantic_score").alias("semantic_score"))


# ================================ E: vectors ================================

@register("l2_normalize", f"""SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, round(x, 6) AS value FROM (
  SELECT vec_id, unnest(range(1, len(u) + 1)) AS i, unnest(u) AS x FROM (
    SELECT vec_id, {unit('CAST(embedding AS DOUBLE[])')} AS u FROM embeddings))""")
def q_l2_normalize(spark, sf):
    e = X.table(spark, sf, "embeddings").select("vec_id", V.l2_normalize(V.as_double("embedding")).alias("u"))
    return e.select("vec_id", F.posexplode("u").alias("pos", "value")).select("vec_id", "pos", r6("value").alias("value"))


@register("embedding_dims", with_views(
    "SELECT model, CAST(len(v) AS BIGINT) AS dims, count(*) AS n FROM emb_models_v GROUP BY ALL", "emb_models_v"))
def q_embedding_dims(spark, sf):
    m = X.models_v(spark, sf, emb_vectors(spark, sf))
    return m.groupBy("model", F.size("v").cast("long").alias("dims")).agg(F.count(F.lit(1)).alias("n"))


@register("cosine_pairs", f"""SELECT id_a, id_b, round(sim, 6) AS sim FROM (
  SELECT a.vec_id AS id_a, b.vec_id AS id_b,
    {cosine('CAST(a.embedding AS DOUBLE[])', 'CAST(b.embedding AS DOUBLE[])')} AS sim
  FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id) WHERE sim > 0.35""")
def q_cosine_pairs(spark, sf):
    p = similarity.cosine_pairs(emb_vectors(spark, sf), 0.35)
    return p.select("id_a", "id_b", r6("sim").alias("sim"))


@register("ensemble_similarity", with_views(f"""SELECT id_a, id_b, round(sim, 6) AS sim FROM (
  SELECT a.doc_id AS id_a, b.doc_id AS id_b, avg({cosine('a.v', 'b.v')}) AS sim
  FROM emb_models_v a JOIN emb_models_v b ON a.model = b.model AND a.doc_id < b.doc_id GROUP BY ALL) WHERE sim > 0.35""",
                                            "emb_models_v"))
def q_ensemble_similarity(spark, sf):
    m = X.models_v(spark, sf, emb_vectors(spark, sf))
    return similarity.ensemble_pairs(m, 0.35).select("id_a", "id_b", r6("sim").alias("sim"))


@register("semantic_score", with_views(f"""WITH {_SEMANTIC_SQL}
SELECT doc_id, round(semantic_score, 6) AS semantic_score FROM sem""", "valid_unit_v"))
def q_semantic_score(spark, sf):
    s = scoring.semantic_score(slices.valid_with_vectors(spark, sf).select("doc_id", "v"), "v", dim_of(spark, sf))
    return s.select("doc_id", r6("semantic_score").alias("semantic_score"))


@register("similarity_to_centroid", with_views(f"""SELECT v.doc_id, round({cosine('v.v', 'c.centroid')}, 6) AS similarity_to_centroid
FROM vec_v v LEFT JOIN centroids_v c USING (cluster)""", "vec_v", "centroids_v"))
def q_similarity_to_centroid(spark, sf):
    v = slices.with_vectors(spark, sf, X.articles_v(spark, sf).select("doc_id"))
    s = scoring.similarity_to_centroid(v, X.centroids_v(spark, sf, dim_of(spark, sf)))
    return s.select("doc_id", r6("similarity_to_centroid").alias("similarity_to_centroid"))


# ================================ H: joins ================================

@register("new_links", with_views("SELECT doc_id, url FROM articles_v WHERE url NOT IN (SELECT url FROM processed_v)",
                                  "articles_v", "processed_v"))
def q_new_links(spark, sf):
    return curate.new_links(X.articles_v(spark, sf).select("doc_id", "url"), X.processed_v(spark, sf))


@register("near_duplicates", with_views(f"""WITH u AS (SELECT doc_id, word_count, {unit('v')} AS u FROM valid_vec_v),
pairs AS (SELECT a.doc_id AS id_a, b.doc_id AS id_b, a.word_count AS wc_a, b.word_count AS wc_b
  FROM u a JOIN u b ON a.doc_id < b.doc_id WHERE list_dot_product(a.u, b.u) > 0.35),
losers AS (SELECT DISTINCT CASE WHEN wc_a >= wc_b THEN id_b ELSE id_a END AS doc_id FROM pairs)
SELECT doc_id, word_count FROM valid_vec_v WHERE doc_id NOT IN (SELECT doc_id FROM losers)""", "valid_vec_v"))
def q_near_duplicates(spark, sf):
    v = slices.valid_with_vectors(spark, sf).select("doc_id", "word_count", "v")
    return curate.near_duplicates(v, 0.35).select("doc_id", "word_count")


@register("score_lookup", with_views(f"""SELECT doc_id, source, {source_weight('source')} AS weight FROM articles_v""", "articles_v"))
def q_score_lookup(spark, sf):
    a = X.articles_v(spark, sf).select("doc_id", "source")
    return scoring.score_lookup(a, scoring.weights_table(spark), "source", "weight", "weight", 0.5)


# ================================ I: scores ================================

@register("source_score", with_views("SELECT doc_id, source, source_score FROM final_v", "final_v"))
def q_source_score(spark, sf):
    return slices.scored_articles(spark, sf, with_area=False).select("doc_id", "source", "source_score")


@register("recency_score", with_views(
    f"SELECT doc_id, round(exp(-floor((epoch_us({AS_OF_SQL}) - epoch_us(scraping_date)) / 86400000000) / 30.0), 6) AS recency_score FROM articles_v",
    "articles_v"))
def q_recency_score(spark, sf):
    r = scoring.recency_score(X.articles_v(spark, sf), X.AS_OF)
    return r.select("doc_id", r6("recency_score").alias("recency_score"))


@register("novelty_score", with_views("SELECT doc_id, cluster, round(novelty_score, 6) AS novelty_score FROM final_v", "final_v"))
def q_novelty_score(spark, sf):
    v = slices.valid_with_vectors(spark, sf)
    n = scoring.novelty_score(v, "cluster", "v", dim_of(spark, sf))
    return n.select("doc_id", "cluster", r6("novelty_score").alias("novelty_score"))


@register("novelty_centroid", with_views(f"""SELECT v.doc_id, round(1.0 - {cosine('v.v', 'c.centroid')}, 6) AS novelty_score
FROM vec_v v LEFT JOIN centroids_v c USING (cluster)""", "vec_v", "centroids_v"))
def q_novelty_centroid(spark, sf):
    v = slices.with_vectors(spark, sf, X.articles_v(spark, sf).select("doc_id"))
    s = scoring.novelty_centroid(scoring.similarity_to_centroid(v, X.centroids_v(spark, sf, dim_of(spark, sf))))
    return s.select("doc_id", r6("novelty_score").alias("novelty_score"))


@register("novelty_global", with_views(f"""WITH {_SEMANTIC_SQL}
SELECT doc_id, round(1.0 - semantic_score, 6) AS novelty_score FROM sem""", "valid_unit_v"))
def q_novelty_global(spark, sf):
    s = scoring.novelty_global(slices.valid_with_vectors(spark, sf).select("doc_id", "v"), "v", dim_of(spark, sf))
    return s.select("doc_id", r6("novelty_score").alias("novelty_score"))


@register("length_score", with_views(
    "SELECT doc_id, round(length(content) / (SELECT max(length(content)) FROM articles_v), 6) AS length_score FROM articles_v",
    "articles_v"))
def q_length_score(spark, sf):
    return scoring.length_score(X.articles_v(spark, sf)).select("doc_id", r6("length_score").alias("length_score"))


FLAG_SOURCES = ("OpenAI Blog", "AWS Blog")


@register("source_flag", with_views(
    "SELECT doc_id, CAST(coalesce(source IN ('OpenAI Blog', 'AWS Blog'), false) AS INTEGER) AS source_flag FROM articles_v",
    "articles_v"))
def q_source_flag(spark, sf):
    return scoring.source_flag(X.articles_v(spark, sf), FLAG_SOURCES).select("doc_id", "source_flag")


@register("final_score", with_views("SELECT doc_id, round(final_score, 6) AS final_score FROM final_v", "final_v"))
def q_final_score(spark, sf):
    return slices.scored_articles(spark, sf, with_area=False).select("doc_id", r6("final_score").alias("final_score"))


@register("final_score_simple", with_views(f"""WITH {_SEMANTIC_SQL}
SELECT v.doc_id, round(0.5 * (1.0 - s.semantic_score) + 0.3 * (length(v.content) / (SELECT max(length(content)) FROM valid_vec_v))
  + 0.2 * CAST(coalesce(v.source IN ('OpenAI Blog', 'AWS Blog'), false) AS INTEGER), 6) AS final_score
FROM valid_vec_v v JOIN sem s USING (doc_id)""", "valid_unit_v", "valid_vec_v"))
def q_final_score_simple(spark, sf):
    v = slices.valid_with_vectors(spark, sf)
    x = scoring.novelty_global(v, "v", dim_of(spark, sf))
    x = scoring.length_score(x)
    x = scoring.source_flag(x, FLAG_SOURCES)
    return scoring.final_score_simple(x).select("doc_id", r6("final_score").alias("final_score"))


def _valid_models(spark, sf) -> DataFrame:
    return X.models_v(spark, sf, slices.valid_with_vectors(spark, sf).select("doc_id", "v"))


@register("ensemble_scores", with_views(f"""WITH mc AS (SELECT m.doc_id, m.model, v.cluster, m.v, {unit('m.v')} AS u
  FROM valid_models_v m JOIN valid_vec_v v USING (doc_id)),
cm AS ({mean_vec_sql('mc', 'model, cluster', 'u')}),
cc AS ({mean_vec_sql('mc', 'model, cluster', 'v')})
SELECT doc_id, round(avg(1.0 - list_dot_product(mc.u, cm.m)), 6) AS novelty_score,
  round(avg({cosine('mc.v', 'cc.m')}), 6) AS similarity_to_centroid
FROM mc JOIN cm USING (model, cluster) JOIN cc USING (model, cluster) GROUP BY doc_id""", "valid_models_v", "valid_vec_v"))
def q_ensemble_scores(spark, sf):
    d = dim_of(spark, sf)
    vv = slices.valid_with_vectors(spark, sf).select("doc_id", "cluster", "v")
    models = X.models_v(spark, sf, vv.select("doc_id", "v"))
    mclusters = models.select("doc_id", "model").join(vv.select("doc_id", "cluster"), "doc_id")
    cents = V.mean_vectors(models.join(mclusters, ["doc_id", "model"]), ["model", "cluster"], "v", out="centroid", dim=d)
    e = scoring.ensemble_scores(models, mclusters, cents, dim=d)
    return e.select("doc_id", r6("novelty_score").alias("novelty_score"),
                    r6("similarity_to_centroid").alias("similarity_to_centroid"))


# ================================ J: areas ================================

@register("assign_area", with_views("SELECT doc_id, area FROM area_v", "area_v"))
def q_assign_area(spark, sf):
    v = X.text_models(slices.valid_articles(spark, sf))
    return areas.assign_area(v, X.profiles_v(spark)).select("doc_id", "area")


@register("assign_area_ensemble", with_views(area_sql("valid_v", list(EM.ENSEMBLE.values())), "valid_v", "profiles_v"))
def q_assign_area_ensemble(spark, sf):
    models = tuple(EM.ENSEMBLE)
    return areas.assign_area_ensemble(X.text_models(slices.valid_articles(spark, sf), models), X.profiles_v(spark, models)).select("doc_id", "area")


# ================================ K: aggregates ================================

@register("source_counts", with_views("SELECT source, count(*) AS n FROM articles_v GROUP BY source", "articles_v"))
def q_source_counts(spark, sf):
    return X.articles_v(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


# ================================ G: terms ================================

def _term_docs(spark, sf) -> DataFrame:
    v = slices.valid_with_labels(spark, sf).select("doc_id", "cluster", "content", "language")
    return terms.token_ngrams(terms.materialize(terms.clean_tokens(v).select("doc_id", "cluster", "tokens")))


@register("clean_for_tfidf", with_views("SELECT doc_id, text_tfidf FROM g_clean", "g_clean"))
def q_clean_for_tfidf(spark, sf):
    v = slices.valid_with_vectors(spark, sf).select("doc_id", "content", "language")
    return terms.clean_for_tfidf(v).select("doc_id", "text_tfidf")


@register("ngrams", with_views("SELECT term, count(*) AS n FROM (SELECT unnest(terms) AS term FROM g_terms) GROUP BY term",
                               "g_terms"))
def q_ngrams(spark, sf):
    return _term_docs(spark, sf).select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@register("doc_freq_bounds", with_views("SELECT term, df FROM g_vocab", "g_vocab"))
def q_doc_freq_bounds(spark, sf):
    return terms.doc_freq_bounds(_term_docs(spark, sf)).select("term", "df")


@register("tfidf", with_views("SELECT doc_id, term, round(weight, 6) AS weight FROM g_tfidf", "g_tfidf"))
def q_tfidf(spark, sf):
    return terms.tfidf(_term_docs(spark, sf)).select("doc_id", "term", r6("weight").alias("weight"))


def _cluster_terms(spark, sf, top_n=10):
    docs = _term_docs(spark, sf)
    return terms.top_terms_per_cluster(terms.tfidf(docs), docs.select("doc_id", "cluster"), top_n)


@register("top_terms_per_cluster", with_views(
    "SELECT cluster, rank, term, round(score, 6) AS score FROM g_top", "g_top"))
def q_top_terms_per_cluster(spark, sf):
    t = _cluster_terms(spark, sf)
    return t.select("cluster", F.col("rank").cast("long").alias("rank"), "term", r6("score").alias("score"))


@register("name_clusters", with_views("SELECT cluster, cluster_name FROM g_names", "g_names"))
def q_name_clusters(spark, sf):
    return terms.name_clusters(_cluster_terms(spark, sf, 3))


@register("attach_cluster_name", with_views(
    "SELECT v.doc_id, v.cluster, n.cluster_name FROM valid_vec_v v LEFT JOIN g_names n USING (cluster)", "g_names"))
def q_attach_cluster_name(spark, sf):
    names = terms.name_clusters(_cluster_terms(spark, sf, 3))
    v = slices.valid_with_vectors(spark, sf).select("doc_id", "cluster")
    return terms.attach_cluster_name(v, names).select("doc_id", "cluster", "cluster_name")


@register("top_terms_one_cluster", with_views("""SELECT rank, term, round(score, 6) AS score FROM (
  SELECT term, score, row_number() OVER (ORDER BY round(score, 12) DESC, term) AS rank FROM g_scores WHERE cluster = 3)
WHERE rank <= 10""", "g_scores"))
def q_top_terms_one_cluster(spark, sf):
    docs = _term_docs(spark, sf)
    t = terms.top_terms_one_cluster(terms.tfidf(docs), docs.select("doc_id", "cluster"), 3, 10)
    return t.select(F.col("rank").cast("long").alias("rank"), "term", r6("score").alias("score"))


# ================================ F: clustering ================================

_EMB_POINTS = "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"


@register("fit_kmeans", f"""WITH RECURSIVE {KS.fits(_EMB_POINTS, [6])}
SELECT id AS doc_id, CAST(j - 1 AS INTEGER) AS cluster, round(d, 6) AS distance FROM own""")
def q_fit_kmeans(spark, sf):
    """Labels and the distance to the own centre of a fit with k = 6; the oracle repeats the whole fit."""
    vectors = ksearch.slim_vectors(emb_vectors(spark, sf))
    centres = ksearch.fit_models(vectors, [6])[6]
    labels = ksearch.assign(vectors, centres).join(F.broadcast(ksearch.centroid_table(spark, centres)), "cluster")
    d = labels.join(vectors.withColumnRenamed("id", "doc_id"), "doc_id")
    away = F.sqrt(V.sumsq(F.zip_with("v", "centroid", lambda a, b: a - b)))
    return d.select("doc_id", "cluster", r6(away).alias("distance"))


@register("predict_cluster", with_views("""SELECT v.doc_id, first(c.cluster ORDER BY list_distance(v.v, c.centroid), c.cluster) AS cluster
FROM vec_v v CROSS JOIN centroids_v c GROUP BY v.doc_id""", "vec_v", "centroids_v"))
def q_predict_cluster(spark, sf):
    v = slices.with_vectors(spark, sf, X.articles_v(spark, sf).select("doc_id")).select("doc_id", "v")
    return clusters.predict_cluster(v, X.centroids_v(spark, sf, dim_of(spark, sf))).select("doc_id", "cluster")


_SIL_SQL = f"""WITH pts AS (SELECT vec_id, label, {unit('CAST(embedding AS DOUBLE[])')} AS u FROM embeddings),
cm AS ({mean_vec_sql('pts', 'label', 'u')}),
cn AS (SELECT label, count(*) AS n FROM pts GROUP BY label),
d AS (SELECT p.vec_id, p.label AS own, c.label, list_dot_product(p.u, c.m) AS dm FROM pts p CROSS JOIN cm c),
per AS (SELECT d.vec_id, max(CASE WHEN d.label = d.own THEN d.dm END) AS dm_own,
    min(CASE WHEN d.label <> d.own THEN 1 - d.dm END) AS b, any_value(o.n) AS n_own
  FROM d JOIN cn o ON o.label = d.own GROUP BY d.vec_id)
SELECT round(avg(CASE WHEN n_own <= 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette
FROM (SELECT *, (n_own - n_own * dm_own) / (n_own - 1) AS a FROM per)"""


@register("silhouette_cosine", _SIL_SQL)
def q_silhouette_cosine(spark, sf):
    t = clusters.silhouette_table(emb_vectors(spark, sf))
    return t.select(r6("silhouette").alias("silhouette"))


_K_SQL = f"""WITH RECURSIVE {KS.scores(_EMB_POINTS, range(4, 13))}
SELECT k, round(silhouette, 6) AS silhouette, k = best_k AS best FROM scores, best"""


@register("find_optimal_k", _K_SQL)
def q_find_optimal_k(spark, sf):
    """All scores and the choice; the oracle repeats the nine fits and scores them from the definition."""
    best, scores = clusters.find_optimal_k(emb_vectors(spark, sf), 4, 12)
    return scores.select("k", r6("silhouette").alias("silhouette"), (F.col("k") == best).alias("best"))


@register("cluster_sizes", "SELECT label AS cluster, count(*) AS n FROM embeddings GROUP BY label")
def q_cluster_sizes(spark, sf):
    return clusters.cluster_sizes(emb_vectors(spark, sf))


@register("kmeans_inertia", with_views("""SELECT round(sum(list_distance(CAST(e.embedding AS DOUBLE[]), c.centroid) ^ 2), 6) AS inertia
FROM embeddings e JOIN centroids_v c ON c.cluster = e.label""", "centroids_v"))
def q_kmeans_inertia(spark, sf):
    i = clusters.kmeans_inertia(emb_vectors(spark, sf), X.centroids_v(spark, sf, dim_of(spark, sf)))
    return i.select(r6("inertia").alias("inertia"))


@register("density_hierarchy")
def q_density_hierarchy(spark, sf):
    """Hierarchical density clustering of the embeddings; tests compare it with the textbook algorithm."""
    return hierarchy.density_hierarchy(emb_vectors(spark, sf), 5)


@register("density_clusters", f"""WITH RECURSIVE pts AS (SELECT vec_id AS id, {unit('CAST(embedding AS DOUBLE[])')} AS u FROM embeddings),
pairs AS (SELECT a.id AS a, b.id AS b FROM pts a JOIN pts b ON a.id < b.id WHERE list_dot_product(a.u, b.u) > 0.35),
nb AS (SELECT a AS src, b AS dst FROM pairs UNION ALL SELECT b, a FROM pairs),
core AS (SELECT p.id FROM pts p LEFT JOIN (SELECT src, count(*) AS deg FROM nb GROUP BY src) d ON d.src = p.id
  WHERE coalesce(d.deg, 0) + 1 >= 3),
ce AS (SELECT src, dst FROM nb WHERE src IN (SELECT id FROM core) AND dst IN (SELECT id FROM core)),
reach(id, root) AS (SELECT id, id FROM core UNION SELECT e.dst, r.root FROM reach r JOIN ce e ON e.src = r.id),
comp AS (SELECT id, min(root) AS label FROM reach GROUP BY id),
border AS (SELECT n.src AS id, min(c.label) AS label FROM nb n JOIN comp c ON c.id = n.dst
  WHERE n.src NOT IN (SELECT id FROM core) GROUP BY n.src)
SELECT p.id AS doc_id, CAST(coalesce(c.label, b.label, -1) AS BIGINT) AS cluster
FROM pts p LEFT JOIN comp c ON c.id = p.id LEFT JOIN border b ON b.id = p.id""")
def q_density_clusters(spark, sf):
    return clusters.density_clusters(emb_vectors(spark, sf), 0.35, 3)


# ================================ B: pages ================================
from ..sources import pages as P  # noqa: E402

_D_NOISE = "regexp_replace({h}, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', ' ', 'g')"
_D_HOST = "lower(regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_D_BASE = "regexp_extract({u}, '^([a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]*)', 1)"
_D_LINKS = ("list_transform(regexp_extract_all({h}, '" + P.LINK_PATTERN.replace("'", "''") + "', 1), "
            + "lambda x: trim(x, " + "'" + P.QUOTES.replace("'", "''") + "'))")


def _d_unescape(x: str) -> str:
    for ent, raw in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]:
        x = f"replace({x}, '{ent}', '{raw.replace(chr(39), chr(39) * 2)}')"
    return x


def _d_text(x: str) -> str:
    return f"trim(regexp_replace({_d_unescape(f'regexp_replace({x}, {chr(39)}<[^>]*>{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})')}, '\\s+', ' ', 'g'))"


def _d_paragraphs(h: str) -> str:
    segs = f"regexp_split_to_array({_D_NOISE.format(h=h)}, '(?i)<p(?:\\s[^>]*)?>')[2:]"
    return f"list_transform({segs}, lambda s: {_d_text(chr(114) + 'egexp_replace(s, ' + chr(39) + '(?is)(?:</p\\s*>|</article\\s*>|</body\\s*>).*$' + chr(39) + ', ' + chr(39) + chr(39) + ')')})"


def _d_lit(v):
    return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"


def _d_route_case(host: str, rules: list[dict]) -> str:
    whens = " ".join(f"WHEN contains({host}, lower({_d_lit(r['domain'])})) THEN {i}" for i, r in enumerate(rules))
    return f"CASE {whens} END"


def _d_list(values) -> str:
    return "[" + ", ".join(_d_lit(v) for v in values) + "]::VARCHAR[]" if values else "NULL::VARCHAR[]"


def _d_rules_table(rules: list[dict]) -> str:
    rows = [f"({i}, " + ", ".join([_d_lit(r["source"]), _d_lit(r.get("prefix")), _d_lit(r.get("alt_prefix")), _d_list(r.get("contains_any")),
                                    _d_list(r.get("excludes")), _d_lit(r.get("not_equal")),
                                    str(r["min_slashes"]) if r.get("min_slashes") is not None else "NULL", _d_list(r.get("allowed")),
                                    _d_lit(r.get("base")), _d_lit(r.get("title_default"))]) + ")" for i, r in enumerate(rules)]
    return ("SELECT * FROM (VALUES " + ", ".join(rows) +
            ") AS t(ord, source, prefix, alt_prefix, contains_any, excludes, not_equal, min_slashes, allowed, base, title_default)")


def _d_routed(pages: str = "pages", rules: list[dict] | None = None) -> str:
    rules = rules if rules is not None else P.rule_rows()
    return f"""routed AS MATERIALIZED (SELECT p.page_id, p.url, p.html, r.* FROM {pages} p JOIN ({_d_rules_table(rules)}) r
    ON r.ord = {_d_route_case(_D_HOST.format(u='p.url'), rules)})"""


_D_KEEP = """(coalesce(starts_with(href, prefix), true) OR coalesce(starts_with(href, alt_prefix), false))
  AND coalesce(len(list_filter(contains_any, lambda s: contains(href, s))) > 0, true)
  AND NOT coalesce(len(list_filter(excludes, lambda s: contains(href, s))) > 0, false)
  AND coalesce(href <> not_equal, true)
  AND coalesce(length(href) - length(replace(href, '/', '')) > min_slashes, true)"""


def _d_scope(rule: dict) -> str:
    """The link list of a page under a rule; containers of these pages hold no container of their own tag before
    their first link, so a pattern up to the first closing tag finds the same links."""
    if not rule.get("scope"):
        return _D_LINKS.format(h="html")
    opener, tag = P._css_regex(rule["scope"])
    opener = opener.replace("'", "''")
    pattern, group = (f"(?is){opener}", 0) if tag == "a" else (f"(?is){opener}(.*?)</{tag}\\s*>", 1)
    links = _D_LINKS.format(h="c") + ("[1:1]" if rule.get("first_only") else "")
    return f"flatten(list_transform(regexp_extract_all({_D_NOISE.format(h='html')}, '{pattern}', {group}), lambda c: {links}))"


def _d_kept(rules: list[dict]) -> str:
    """CTEs links and kept (page_id, source, pos, href, link)."""
    scopes: dict[str, list[str]] = {}
    for i, r in enumerate(rules):
        scopes.setdefault(_d_scope(r), []).append(str(i))
    parts = " UNION ALL ".join(f"SELECT *, {expr} AS l FROM routed WHERE ord IN ({', '.join(ords)})" for expr, ords in scopes.items())
    base = f"coalesce(base, {_D_BASE.format(u='url')})"
    return f"""links AS (SELECT *, CAST(i - 1 AS INTEGER) AS pos FROM (SELECT *, unnest(l) AS href, unnest(range(1, len(l) + 1)) AS i FROM ({parts}))),
kept AS (SELECT * FROM (SELECT page_id, source, pos, href, allowed,
    CASE WHEN starts_with(href, '/') THEN {base} || href WHEN starts_with(href, './') THEN {base} || substr(href, 2)
      WHEN allowed IS NOT NULL AND NOT starts_with(href, 'http') THEN regexp_replace({base}, '/+$', '') || '/' || href ELSE href END AS link
  FROM links WHERE {_D_KEEP}) WHERE coalesce(len(list_filter(allowed, lambda d: contains(link, d))) > 0, true))"""


@register("extract_links", with_views(f"""SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, href FROM (
  SELECT page_id, unnest(l) AS href, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, {_D_LINKS.format(h='html')} AS l FROM listing_v))""",
                                      "listing_v"))
def q_extract_links(spark, sf):
    return P.extract_links(X.listing_v(spark, sf))


@register("filter_links_by_rule", with_views(f"""WITH {_d_routed("listing_v")}, {_d_kept(P.rule_rows())}
SELECT page_id, source, pos, href FROM kept""", "listing_v"))
def q_filter_links_by_rule(spark, sf):
    return P.filter_links_by_rule(X.listing_v(spark, sf), P.source_rules(spark))


@register("resolve_links", with_views(f"""WITH {_d_routed("listing_v")}, {_d_kept(P.rule_rows())}
SELECT page_id, source, pos, link FROM kept""", "listing_v"))
def q_resolve_links(spark, sf):
    return P.resolve_links(X.listing_v(spark, sf), P.source_rules(spark))


@register("resolve_links_alternatives", with_views(
    f"""WITH {_d_routed("listing_v", P.rule_rows(alternatives=True))}, {_d_kept(P.rule_rows(alternatives=True))}
SELECT page_id, source, pos, link FROM kept""", "listing_v"))
def q_resolve_links_alternatives(spark, sf):
    """B2, B3 with the other rules of the sites (blog listing and earlier forms)."""
    return P.resolve_links(X.listing_v(spark, sf), P.source_rules(spark, alternatives=True))


@register("scoped_links", with_views(f"""SELECT page_id, CAST(ci - 1 AS INTEGER) AS container_pos, 0 AS pos, l[1] AS href FROM (
  SELECT page_id, ci, {_D_LINKS.format(h='chunk')} AS l FROM (
    SELECT page_id, unnest(c) AS chunk, unnest(range(1, len(c) + 1)) AS ci FROM (
      SELECT page_id, regexp_extract_all({_D_NOISE.format(h='html')}, '(?is)<h2\\b[^>]*>(.*?)</h2\\s*>', 1) AS c FROM listing_v)))
WHERE len(l) > 0""", "listing_v"))
def q_scoped_links(spark, sf):
    return P.scoped_links(X.listing_v(spark, sf), "h2", first_only=True).select("page_id", "container_pos", "pos", "href")


@register("link_dedupe", with_views(f"""SELECT page_id, href, CAST(min(i) - 1 AS INTEGER) AS pos FROM (
  SELECT page_id, unnest(l) AS href, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, {_D_LINKS.format(h='html')} AS l FROM listing_v))
GROUP BY page_id, href""", "listing_v"))
def q_link_dedupe(spark, sf):
    return P.link_dedupe(P.extract_links(X.listing_v(spark, sf)))


_D_H1 = "nullif(" + _d_text("regexp_extract({h}, '(?is)<h1[^>]*>(.*?)</h1>', 1)") + ", '')"
_D_OG = ", ".join("nullif(trim(" + _d_unescape("trim(regexp_extract({h}, '" + p.replace("'", "''") + "', 1), '" + P.QUOTES.replace("'", "''") + "')")
                  + "), '')" for p in P.OG_TITLE_PATTERNS)
_D_ANY_TITLE = f"coalesce({_D_H1}, {_D_OG})"
_D_TITLE = f"coalesce({_D_ANY_TITLE}, 'Sin título')"


@register("extract_title", with_views(f"SELECT page_id, {_D_TITLE.format(h='html')} AS title FROM pages_v", "pages_v"))
def q_extract_title(spark, sf):
    return X.pages_v(spark, sf).select("page_id", P.extract_title("html").alias("title"))


@register("extract_paragraphs", f"""SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, text FROM (
  SELECT page_id, unnest(ps) AS text, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT page_id, {_d_paragraphs('html')} AS ps FROM pages))""")
def q_extract_paragraphs(spark, sf):
    return X.table(spark, sf, "pages").select("page_id", F.posexplode(P.paragraphs_array("html")).alias("pos", "text"))


@register("clean_text", f"SELECT page_id, array_to_string({_d_paragraphs('html')}, ' ') AS content FROM pages")
def q_clean_text(spark, sf):
    return X.table(spark, sf, "pages").select("page_id", F.array_join(P.paragraphs_array("html"), " ").alias("content"))


@register("content_container", "SELECT page_id, " + _d_text(
    "regexp_extract(" + _D_NOISE.format(h="html") + ", '(?is)<article\\b[^>]*>(.*?)</article\\s*>', 1)") + " AS container_text FROM pages")
def q_content_container(spark, sf):
    pg = X.table(spark, sf, "pages")
    return pg.select("page_id", P.tag_text(P.content_container(F.col("html"), F.col("url"))).alias("container_text"))


@register("filter_paragraphs", f"""SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, text FROM (
  SELECT page_id, unnest(ps) AS text, unnest(range(1, len(ps) + 1)) AS i FROM (
    SELECT page_id, list_filter({_d_paragraphs('html')}, lambda t: length(t) > 40 AND NOT contains(lower(t), 'copyright')
      AND NOT contains(lower(t), 'all rights reserved') AND NOT contains(lower(t), 'compartir en')) AS ps FROM pages))""")
def q_filter_paragraphs(spark, sf):
    kept = P.filter_paragraphs(P.paragraphs_array("html"), "clean")
    return X.table(spark, sf, "pages").select("page_id", F.posexplode(kept).alias("pos", "text"))


@register("build_articles", with_views(f"""WITH {_d_routed("pages_v")}
SELECT page_id, source, url, title, array_to_string(ps, ' ') AS content, '2024-04-01 00:00:00' AS scraping_date FROM (
  SELECT page_id, source, url, coalesce({_D_ANY_TITLE.format(h='html')}, title_default) AS title, {_d_paragraphs('html')} AS ps FROM routed)
WHERE title IS NOT NULL AND len(ps) > 0""", "pages_v"))
def q_build_articles(spark, sf):
    a = P.build_articles(X.pages_v(spark, sf), P.source_rules(spark), X.AS_OF)
    return a.withColumn("scraping_date", ts("scraping_date"))


@register("route_url_to_source", with_views(f"""WITH {_d_routed("pages_v")} SELECT page_id, source FROM routed""", "pages_v"))
def q_route_url_to_source(spark, sf):
    return P.route_url_to_source(X.pages_v(spark, sf), P.source_rules(spark)).select("page_id", "source")


@register("normalize_host", f"SELECT page_id, regexp_replace({_D_HOST.format(u='url')}, 'www\\.', '', 'g') AS host FROM pages")
def q_normalize_host(spark, sf):
    return X.table(spark, sf, "pages").select("page_id", P.normalize_host("url").alias("host"))


# ================================ A9-A11, D10, D11, H3: feeds ================================
from ..sources import feeds as FD  # noqa: E402
from .oracle import view as _view  # noqa: E402

_FEED_DATE_SPARK = ("CASE WHEN page_id % 7 = 0 THEN 'not a date' ELSE date_format(timestamp'2024-03-01 06:00:00' + "
                    "make_dt_interval(0, cast(page_id * 5 as int), 0, 0), 'EEE, dd MMM yyyy HH:mm:ss') || ' +0000' END")
_FEED_DATE_DUCK = ("CASE WHEN page_id % 7 = 0 THEN 'not a date' ELSE strftime(TIMESTAMP '2024-03-01 06:00:00' + "
                   "to_hours(CAST(page_id * 5 AS INTEGER)), '%a, %d %b %Y %H:%M:%S') || ' +0000' END")


def feed_entries(spark, sf) -> DataFrame:
    """Feed entries derived from ``pages``: one entry per page, feed = the page's routed source."""
    pg = X.table(spark, sf, "pages")
    r = P.route_url_to_source(pg, P.source_rules(spark), keep_rule=True)
    paras = P.paragraphs_array("html")
    return r.select(
        "source", F.col("_rule.ord").alias("feed_ord"), F.col("page_id").alias("pos"),
        F.coalesce(P.extract_title("html", None), F.lit("")).alias("title"), "url",
        F.expr(_FEED_DATE_SPARK).alias("published"),
        F.coalesce(F.try_element_at(paras, F.lit(1)), F.lit("")).alias("summary"),
        F.when(F.col("page_id") % 3 == 0, F.array_join(paras, " ")).otherwise(F.lit("")).alias("content"),
    ).withColumn("date", T.parse_feed_date("published"))


def feed_xml(spark, sf) -> DataFrame:
    """One RSS document per feed entry (escaped), as a publisher would serve it."""
    e = feed_entries(spark, sf)
    xml = F.concat(F.lit("<rss><channel><title>"), FD.xml_escape("source"), F.lit("</title><item><title>"),
                   FD.xml_escape("title"), F.lit("</title><link>"), FD.xml_escape("url"), F.lit("</link><pubDate>"),
                   F.col("published"), F.lit("</pubDate><description>"), FD.xml_escape("summary"),
                   F.lit("</description><content:encoded>"), FD.xml_escape("content"),
                   F.lit("</content:encoded></item></channel></rss>"))
    return e.select("source", "feed_ord", F.col("pos").alias("entry_id"), xml.alias("xml"))


_view("feed_entries_v", [], f"""  SELECT r.source, r.ord AS feed_ord, p.page_id AS pos,
    coalesce(nullif({_d_text("regexp_extract(p.html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")}, ''), '') AS title, p.url,
    {_FEED_DATE_DUCK.replace('page_id', 'p.page_id')} AS published,
    coalesce({_d_paragraphs('p.html')}[1], '') AS summary,
    CASE WHEN p.page_id % 3 = 0 THEN array_to_string({_d_paragraphs('p.html')}, ' ') ELSE '' END AS content,
    try_strptime(nullif(regexp_extract(trim({_FEED_DATE_DUCK.replace('page_id', 'p.page_id')}), '{T.RFC822_PATTERN}', 1), ''), '%d %b %Y %H:%M:%S') AS date
  FROM pages p JOIN ({_d_rules_table(P.rule_rows())}) r ON r.ord = {_d_route_case(_D_HOST.format(u='p.url'), P.rule_rows())}""")

_ART = "regexp_extract(" + _D_NOISE.format(h="html") + ", '(?is)<article\\b[^>]*>(.*?)</article\\s*>', 1)"
_view("page_texts_v", [], f"""  SELECT url, {_D_TITLE.format(h='html')} AS title,
    array_to_string(list_filter({_d_paragraphs(_ART)}, lambda t: length(t) > 40 AND NOT contains(lower(t), 'copyright')
      AND NOT contains(lower(t), 'all rights reserved') AND NOT contains(lower(t), 'compartir en')), ' ') AS content
  FROM pages WHERE len({_d_paragraphs(_ART)}) > 0""")

_FEED_COLS_SQL = f"source, feed_ord, pos, title, url, published, summary, content, {TS('date')} AS date"


def _feed_out(df):
    return df.withColumn("date", ts("date"))


@register("feed_items", with_views(f"SELECT {_FEED_COLS_SQL} FROM feed_entries_v", "feed_entries_v"))
def q_feed_items(spark, sf):
    items = FD.feed_items(feed_xml(spark, sf), keep=("entry_id",))
    return _feed_out(items.select("source", "feed_ord", F.col("entry_id").alias("pos"), "title", "url", "published", "summary", "content", "date"))


@register("sitemap_urls", f"""SELECT page_id AS sitemap_id, CAST(i - 1 AS INTEGER) AS pos, href AS loc, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS rank FROM (
    SELECT page_id, unnest(l) AS href, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, {_D_LINKS.format(h='html')} AS l FROM pages))
  WHERE contains(href, 'th'))
WHERE rank <= 3""")
def q_sitemap_urls(spark, sf):
    """One sitemap per page, listing that page's links (a document bounded by its page)."""
    pg = X.table(spark, sf, "pages")
    xml = F.concat(F.lit("<urlset>"), F.array_join(F.transform(P.extract_links_array("html"), lambda u: F.concat(
        F.lit("<url><loc>"), FD.xml_escape(u), F.lit("</loc></url>"))), ""), F.lit("</urlset>"))
    s = FD.sitemap_urls(pg.select(F.col("page_id").alias("sitemap_id"), xml.alias("xml")), contains="th", max_urls=3)
    return s.select("sitemap_id", "pos", "loc", F.col("rank").cast("long").alias("rank"))


@register("api_posts", with_views(f"""SELECT title, 'https://huggingface.co/blog/post-' || CAST(doc_id AS VARCHAR) AS url,
  CASE WHEN language <> 'de' THEN source ELSE '' END AS author, strftime(scraping_date, '%Y-%m-%d') AS date,
  content AS summary, CASE WHEN language <> 'fr' THEN language || ',ai' ELSE '' END AS tags,
  doc_id % 50 AS likes
FROM articles_v WHERE scraping_date >= {AS_OF_SQL} - INTERVAL 30 DAY""", "articles_v"))
def q_api_posts(spark, sf):
    a = X.articles_v(spark, sf)
    post = F.struct(F.col("title").alias("title"), F.concat(F.lit("post-"), F.col("doc_id").cast("string")).alias("slug"),
                    F.when(F.col("language") != "de", F.struct(F.col("source").alias("name"))).alias("author"),
                    F.date_format("scraping_date", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("createdAt"),
                    F.col("content").alias("summary"),
                    F.when(F.col("language") != "fr", F.array(F.col("language"), F.lit("ai"))).alias("tags"),
                    (F.col("doc_id") % 50).alias("likesCount"))
    payloads = a.select(F.to_json(F.array(post)).alias("payload"))
    return FD.api_posts(payloads, X.AS_OF, days=30).withColumn("tags", F.array_join("tags", ","))


@register("feed_recent", with_views(f"""SELECT source, feed_ord, pos, title, url, substr(summary, 1, 300) AS summary,
  {TS('coalesce(date, ' + AS_OF_SQL + ')')} AS date
FROM feed_entries_v WHERE coalesce(date, {AS_OF_SQL}) >= {AS_OF_SQL} - INTERVAL 7 DAY""", "feed_entries_v"))
def q_feed_recent(spark, sf):
    r = FD.feed_recent(feed_entries(spark, sf), X.AS_OF, days=7)
    return _feed_out(r.select("source", "feed_ord", "pos", "title", "url", "summary", "date"))


@register("feed_collect", with_views(f"""SELECT e.source, e.feed_ord, e.pos, e.title, e.url, t.content AS page_content
FROM feed_entries_v e JOIN (SELECT url, array_to_string(list_filter(ps, lambda t: length(t) > 50), ' ') AS content
  FROM (SELECT url, {_d_paragraphs(_ART)} AS ps FROM pages) WHERE len(ps) > 0) t USING (url)
WHERE (e.date IS NULL OR e.date >= {AS_OF_SQL} - INTERVAL 7 DAY) AND e.url <> '' AND e.title <> ''
ORDER BY e.feed_ord, e.pos LIMIT 20""", "feed_entries_v"))
def q_feed_collect(spark, sf):
    c = FD.feed_collect(feed_entries(spark, sf), FD.collector_texts(X.table(spark, sf, "pages")), X.AS_OF, days=7,
                        max_articles=20)
    return c.select("source", "feed_ord", "pos", "title", "url", "page_content")


_ENRICH_SQL = f"""enriched AS (
  SELECT e.*, CASE WHEN length(e.rss_content) > 500 THEN e.rss_content
    WHEN t.content IS NOT NULL AND t.content <> '' THEN t.content
    WHEN e.rss_content <> '' THEN e.rss_content ELSE 'Contenido no disponible' END AS full_content
  FROM (SELECT *, coalesce(nullif(content, ''), summary, '') AS rss_content FROM (
      SELECT source, feed_ord, pos, title, url, substr(summary, 1, 300) AS summary, content,
        coalesce(date, {AS_OF_SQL}) AS date FROM feed_entries_v
      WHERE coalesce(date, {AS_OF_SQL}) >= {AS_OF_SQL} - INTERVAL 7 DAY)
    ORDER BY strftime(date, '%Y-%m-%d') DESC, feed_ord, pos LIMIT 10) e
  LEFT JOIN page_texts_v t USING (url))"""


def _enriched(spark, sf):
    recent = FD.feed_recent(feed_entries(spark, sf), X.AS_OF, days=7, ordered=False)
    return FD.enrich_feed(recent, FD.page_texts(X.table(spark, sf, "pages")), max_articles=10)


@register("enrich_feed", with_views(f"""WITH {_ENRICH_SQL}
SELECT source, feed_ord, pos, url, {TS('date')} AS date, full_content FROM enriched""", "feed_entries_v", "page_texts_v"))
def q_enrich_feed(spark, sf):
    return _feed_out(_enriched(spark, sf).select("source", "feed_ord", "pos", "url", "date", "full_content"))


# ================================ K: digests ================================
from ..operators import digest as DG  # noqa: E402


def _sql_text(template: str, **exprs) -> str:
    """A python template rendered as a DuckDB string expression (newlines as chr(10))."""
    out, rest = [], template
    while "{" in rest:
        pre, tail = rest.split("{", 1)
        name, rest = tail.split("}", 1)
        if pre:
            out.append(_sql_str(pre))
        out.append(f"coalesce(CAST({exprs[name]} AS VARCHAR), 'None')")
    if rest:
        out.append(_sql_str(rest))
    return " || ".join(out)


def _sql_str(s: str) -> str:
    pieces = s.split("\n")
    return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in pieces) if s else "''"


def _sql_escape(x: str) -> str:
    for raw, ent in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")]:
        x = f"replace({x}, '{raw}', '{ent}')"
    return x


@register("digest_by_area", with_views(f"""WITH top AS (SELECT area, rank, {_sql_text(DG.AREA_ITEM, title='title', source='source', url='url')} AS item
  FROM (SELECT *, row_number() OVER (PARTITION BY area ORDER BY final_score DESC, doc_id) AS rank FROM final_v) WHERE rank <= 3)
SELECT p.area, {_sql_text(DG.AREA_HEADER, area='p.area')} || coalesce(string_agg(t.item, '' ORDER BY t.rank), '') || '{DG.AREA_FOOTER}' AS html
FROM profiles_v p LEFT JOIN top t ON t.area = p.area GROUP BY p.area""", "final_v", "profiles_v"))
def q_digest_by_area(spark, sf):
    return DG.digest_by_area(slices.scored_articles(spark, sf), X.profiles_v(spark), top_n=3)


_STYLED = DG.STYLED_AREA_HEADER.split("@AREA@")


@register("digest_by_area_styled", with_views(f"""WITH top AS (SELECT area, rank, {_sql_text(DG.AREA_ITEM, title='title', source='source', url='url')} AS item
  FROM (SELECT *, row_number() OVER (PARTITION BY area ORDER BY final_score DESC, doc_id) AS rank FROM final_v) WHERE rank <= 10)
SELECT p.area, {_sql_str(_STYLED[0])} || p.area || {_sql_str(_STYLED[1])} || coalesce(string_agg(t.item, '' ORDER BY t.rank), '') || '{DG.AREA_FOOTER}' AS html
FROM profiles_v p LEFT JOIN top t ON t.area = p.area GROUP BY p.area""", "final_v", "profiles_v"))
def q_digest_by_area_styled(spark, sf):
    return DG.digest_by_area(slices.scored_articles(spark, sf), X.profiles_v(spark), top_n=10, styled=True)


_RECENT_SQL = f"""recent AS (SELECT source, feed_ord, pos, title, url, substr(summary, 1, 300) AS summary,
    coalesce(date, {AS_OF_SQL}) AS date FROM feed_entries_v WHERE coalesce(date, {AS_OF_SQL}) >= {AS_OF_SQL} - INTERVAL 7 DAY),
rk AS (SELECT *, 0 - date_diff('day', DATE '1970-01-01', CAST(date AS DATE)) AS dkey FROM recent),
fs AS (SELECT source, first(dkey ORDER BY dkey, feed_ord, pos) AS s_day, first(feed_ord ORDER BY dkey, feed_ord, pos) AS s_feed_ord,
    first(pos ORDER BY dkey, feed_ord, pos) AS s_pos FROM rk GROUP BY source)"""


@register("digest_by_source", with_views(f"""WITH {_RECENT_SQL},
lines AS (SELECT -1073741824 AS s_day, -1073741824 AS s_feed_ord, -1073741824 AS s_pos, -1 AS part, 0 AS day, 0 AS feed_ord,
  0 AS pos, {_sql_str(DG.FEED_TITLE)} AS line
UNION ALL SELECT s_day, s_feed_ord, s_pos, 0, 0, 0, 0, {_sql_text(DG.SOURCE_HEADER, source='source')} FROM fs
UNION ALL SELECT fs.s_day, fs.s_feed_ord, fs.s_pos, 1, rk.dkey, rk.feed_ord, rk.pos,
  {_sql_text(DG.SOURCE_ITEM, url='rk.url', title='rk.title', date="strftime(rk.date, '%Y-%m-%d')", summary='rk.summary')}
  FROM rk JOIN fs USING (source)
UNION ALL SELECT s_day, s_feed_ord, s_pos, 2, 0, 0, 0, {_sql_str(DG.SOURCE_FOOTER)} FROM fs)
SELECT {", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in DG.LINE_ORDER)}, line FROM lines""", "feed_entries_v"))
def q_digest_by_source(spark, sf):
    recent = FD.feed_recent(feed_entries(spark, sf), X.AS_OF, days=7, ordered=False)
    return DG.digest_by_source_lines(recent).select(*[F.col(c).cast("int").alias(c) for c in DG.LINE_ORDER], "line")


@register("digest_full", with_views(f"""WITH {_ENRICH_SQL}
SELECT {_sql_str(DG.FEED_TITLE)} || string_agg({_sql_text(DG.FULL_ITEM, url='url', title='title', source='source',
    date="strftime(date, '%Y-%m-%d')", content='full_content')}, '' ORDER BY 0 - date_diff('day', DATE '1970-01-01', CAST(date AS DATE)), feed_ord, pos) AS html
FROM enriched""", "feed_entries_v", "page_texts_v"))
def q_digest_full(spark, sf):
    return DG.digest_full(_enriched(spark, sf))


_WEEKLY_CARD = ("""'<div class="article"><h3>' || {t} || '</h3><div class="meta">' || {s} || ' · ' || {l} || '</div><a href="' || {u} || '" target="_blank" class="read-more">Leer más</a></div>'""")


@register("digest_weekly", with_views(f"""SELECT '20240401T0000Z' AS generated_at, count(*) AS n_articles,
  '<html><body><div class="container"><div class="header"><h1>{DG.WEEKLY_TITLE}</h1><p>{DG.WEEKLY_SUBTITLE.format(date='20240401T0000Z')}</p></div>'
  || string_agg({_WEEKLY_CARD.format(t=_sql_escape('title'), s=_sql_escape('source'), l=_sql_escape('language'), u=_sql_escape('url'))}, '' ORDER BY final_score DESC, doc_id)
  || '<div class="footer">{DG.WEEKLY_FOOTER}</div></div></body></html>' AS html
FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY final_score DESC, doc_id) AS rank FROM final_v) WHERE rank <= 3""",
                                      "final_v"))
def q_digest_weekly(spark, sf):
    return DG.digest_weekly(slices.scored_articles(spark, sf), "20240401T0000Z", top_n=3)


# ================================ C3, E1, E3, M1: language and embeddings ================================

_HELD_OUT = "substr(md5(cast(doc_id as string)), 1, 1) in ('0', '1', '2', '3')"


@register("identify_language", f"""WITH t AS (
  SELECT doc_id, lang, {_HELD_OUT} AS held_out,
    ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}]+', ' ', 'g')) || ' ' AS x FROM documents),
g AS MATERIALIZED (SELECT doc_id, lang, held_out, substr(x, i, 3) AS g, count(*) AS n
  FROM (SELECT *, unnest(range(1, length(x) - 1)) AS i FROM t) GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, g, n FROM (SELECT lang, g, sum(n) AS n, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, g) AS r
  FROM g WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, g) WHERE r <= {LG.TOP}),
vocab AS (SELECT DISTINCT g FROM kept),
logs AS MATERIALIZED (SELECT v.g, t.lang, ln((coalesce(k.n, 0) + 1) / (t.total + (SELECT count(*) FROM vocab))) AS p
  FROM vocab v CROSS JOIN (SELECT lang, sum(n) AS total FROM kept GROUP BY lang) t LEFT JOIN kept k ON k.g = v.g AND k.lang = t.lang),
s AS (SELECT doc_id, lang, sum(g.n * p) / sum(g.n) AS score, sum(g.n) AS total FROM (SELECT doc_id, g, n FROM g) g JOIN logs USING (g) GROUP BY doc_id, lang),
r AS (SELECT doc_id, list(lang ORDER BY score DESC, lang) AS l, list(score ORDER BY score DESC, lang) AS sc, any_value(total) AS total FROM s GROUP BY doc_id)
SELECT t.doc_id, t.held_out, CASE WHEN r.total >= {LG.MIN_GRAMS} AND sc[1] - sc[2] >= {LG.MARGIN} THEN l[1] END AS language,
  CASE WHEN r.total >= {LG.MIN_GRAMS} THEN round(sc[1] - sc[2], 6) END AS lead
FROM t LEFT JOIN r USING (doc_id)""")
def q_identify_language(spark, sf):
    """C3 by a model trained on three quarters of the labelled rows (by a hash of the id), applied to all of them."""
    docs = X.table(spark, sf, "documents").select("doc_id", "lang", "text", F.expr(_HELD_OUT).alias("held_out"))
    model = LG.train_language_model(docs.where("not held_out"), "lang", "text")
    return LG.identify_language(docs, model, "text").select("doc_id", "held_out", "language", r6("lead").alias("lead"))



def _detect_language_sql():
    from ..functions.stopwords import sql_list
    sw = " UNION ALL ".join(f"SELECT '{l}' AS lang, unnest({sql_list(l)}) AS w" for l in EM.LANGS)
    order = " ".join(f"WHEN '{l}' THEN {i}" for i, l in enumerate(EM.LANGS))
    return with_views(f"""WITH sw AS (SELECT DISTINCT lang, w FROM ({sw})),
tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(content, '')), '\\p{{L}}+')) AS w FROM articles_v),
hits AS (SELECT tok.doc_id, sw.lang, count(*) AS n FROM tok JOIN sw USING (w) GROUP BY ALL),
best AS (SELECT doc_id, first(lang ORDER BY n DESC, CASE lang {order} END) AS lang FROM hits GROUP BY doc_id)
SELECT a.doc_id, coalesce(b.lang, 'unknown') AS language FROM articles_v a LEFT JOIN best b USING (doc_id)""", "articles_v")


@register("detect_language", _detect_language_sql())
def q_detect_language(spark, sf):
    return EM.detect_language(X.articles_v(spark, sf).select("doc_id", "content")).select("doc_id", "language")


_EMBED_TEXT = preprocess("title || '. ' || content")


def _encoded_sql(models: list[str]) -> str:
    """Every non-zero entry of every vector."""
    return with_views(" UNION ALL ".join(
        f"SELECT doc_id, '{m}' AS model, CAST(i AS INTEGER) AS pos, round(x, 6) AS value FROM ({md5_encoded('articles_v', 'doc_id', _EMBED_TEXT, EM.ENCODERS[m][1])})"
        for m in models), "articles_v")


def _entries(models: DataFrame) -> DataFrame:
    ex = models.select("doc_id", "model", F.posexplode("v").alias("pos", "value")).where("value != 0")
    return ex.select("doc_id", "model", "pos", r6("value").alias("value"))


@register("embed_text", _encoded_sql(["md5-64"]))
def q_embed_text(spark, sf):
    a = X.articles_v(spark, sf).select("doc_id", T.text_for_embedding("title", "content").alias("text_for_embedding"))
    return _entries(EM.embed_text(a, "md5-64").withColumn("model", F.lit("md5-64")))


@register("embed_models", _encoded_sql(list(EM.ENSEMBLE)))
def q_embed_models(spark, sf):
    return _entries(X.text_models(X.articles_v(spark, sf), tuple(EM.ENSEMBLE)))


EM.register_encoder("md5-26", functools.partial(EM.md5_encoder, 26), 26)


@register("register_encoder", _encoded_sql(["md5-26"]))
def q_register_encoder(spark, sf):
    EM.register_encoder("md5-26", functools.partial(EM.md5_encoder, 26), 26)
    return _entries(X.text_models(X.articles_v(spark, sf), ("md5-26",)))


@register("register_source_rule", f"""WITH {_d_routed()}
SELECT page_id, CASE WHEN contains({_D_HOST.format(u='url')}, 'blog.') THEN 'Blogs' ELSE source END AS source FROM routed""")
def q_register_source_rule(spark, sf):
    rules = P.source_rules(spark, generic=False)
    rules = P.register_source_rule(rules, dict(source="Blogs", domain="blog.", prefix="/"))
    for h in P.GENERIC_HOSTS:
        rules = P.register_source_rule(rules, dict(source=h, domain=h, prefix="/"))
    return P.route_url_to_source(X.table(spark, sf, "pages"), rules).select("page_id", "source")


# ================================ A: sources and sinks (round trips) ================================
from ..session import scratch_path  # noqa: E402
from ..sources import files as FS  # noqa: E402
from ..streaming import streams as ST  # noqa: E402
from . import runs as RN  # noqa: E402

_ART_SQL = f"SELECT doc_id, source, url, title, content, {TS('scraping_date')} AS scraping_date FROM articles_v"


def _articles_csv(spark, sf, sep=";", compression="none"):
    path = scratch_path(spark, "articles-csv")
    FS.write_articles_csv(X.articles_v(spark, sf).select("doc_id", "source", "url", "title", "content", "scraping_date"),
                          path, sep=sep, compression=compression)
    return path


@register("read_articles_csv", with_views(_ART_SQL, "articles_v"))
def q_read_articles_csv(spark, sf):
    back = FS.read_articles_csv(spark, _articles_csv(spark, sf), RN.CSV_SCHEMA)
    return back.withColumn("scraping_date", ts("scraping_date"))


@register("write_articles_csv", with_views(
    "SELECT doc_id, title, CAST(len(v) AS INTEGER) AS dims FROM valid_vec_v", "valid_vec_v"))
def q_write_articles_csv(spark, sf):
    v = slices.valid_with_vectors(spark, sf).select("doc_id", "title", "v")
    path = scratch_path(spark, "articles-csv-comma")
    FS.write_articles_csv(v, path, sep=",")
    back = FS.read_articles_csv(spark, path, "doc_id long, title string, v string", sep=",")
    return back.select("doc_id", "title", F.size(F.from_json("v", "array<double>")).alias("dims"))


@register("read_articles_parquet", "SELECT doc_id, lang FROM documents")
def q_read_articles_parquet(spark, sf):
    got = FS.read_articles_parquet(spark, f"{sf}/documents.parquet").select("doc_id", "lang")
    missing = FS.read_articles_parquet(spark, scratch_path(spark, "missing"), "doc_id long, lang string")
    return got.unionByName(missing)


@register("write_articles_parquet", with_views(_ART_SQL, "articles_v"))
def q_write_articles_parquet(spark, sf):
    path = scratch_path(spark, "corpus")
    a = X.articles_v(spark, sf).select("doc_id", "source", "url", "title", "content", "scraping_date")
    FS.write_articles_parquet(a, path, "20240401")
    FS.write_articles_parquet(a.limit(0), path, "20240408")
    back = spark.read.parquet(path).where(F.col("run_date") == "20240401").drop("run_date")  # partition pruning
    return back.withColumn("scraping_date", ts("scraping_date"))


@register("append_articles", with_views("""SELECT doc_id, round(final_score, 6) AS final_score FROM final_v
UNION ALL SELECT doc_id, NULL AS final_score FROM norm_v WHERE NOT is_valid""", "final_v", "norm_v"))
def q_append_articles(spark, sf):
    existing = slices.scored_articles(spark, sf, with_area=False).select("doc_id", "title", "final_score")
    new = slices.normalized_articles(spark, sf).where(~F.col("is_valid")).select("doc_id", "title")
    return FS.append_articles(existing, new).select("doc_id", r6("final_score").alias("final_score"))


@register("load_processed_urls", with_views("SELECT DISTINCT url FROM processed_v", "processed_v"))
def q_load_processed_urls(spark, sf):
    root = scratch_path(spark, "ledger")
    FS.append_processed_urls(spark, root, X.processed_v(spark, sf), "20240325")
    return FS.load_processed_urls(spark, root)


@register("append_processed_urls", with_views("""SELECT url FROM processed_v UNION
SELECT url FROM articles_v WHERE language = 'en'""", "processed_v", "articles_v"))
def q_append_processed_urls(spark, sf):
    root = scratch_path(spark, "ledger")
    FS.append_processed_urls(spark, root, X.processed_v(spark, sf), "20240325")
    new = X.articles_v(spark, sf).where(F.col("language") == "en").select("url")
    return FS.append_processed_urls(spark, root, new, "20240401")


@register("append_feedback", with_views(f"SELECT url, rating, {TS('ts')} AS timestamp FROM feedback_v", "feedback_v"))
def q_append_feedback(spark, sf):
    path = scratch_path(spark, "feedback")
    fb = X.feedback_v(spark, sf)
    FS.append_feedback(fb.where(F.col("rating") == "thumb_up"), path)
    FS.append_feedback(fb.where(F.col("rating") != "thumb_up"), path)
    return FS.read_feedback(spark, path).withColumn("timestamp", ts("timestamp"))


@register("save_cluster_metadata", "SELECT 'm1' AS model_name, CAST(6 AS BIGINT) AS n_clusters, true AS inertia_is_the_sum")
def q_save_cluster_metadata(spark, sf):
    """The record read back: its inertia must be the sum of squared distances to its own centroids."""
    data = clusters.stable_input(emb_vectors(spark, sf)).drop("cluster")
    model, _l, _c = clusters.fit_kmeans(data, k=6)
    path = scratch_path(spark, "cluster-meta")
    FS.save_cluster_metadata(spark, path, "m1", model)
    back = spark.read.json(path)
    cents = back.select(F.posexplode("centroids").alias("cluster", "centroid"))
    again = clusters.kmeans_inertia(clusters.predict_cluster(data, cents), cents).scalar()
    return back.withColumn("again", again).select(
        "model_name", "n_clusters", (F.abs(F.col("inertia") - F.col("again")) <= 1e-6 * F.col("again")).alias("inertia_is_the_sum"))


@register("save_model_version", "SELECT vec_id AS doc_id, true AS same FROM embeddings")
def q_save_model_version(spark, sf):
    data = clusters.stable_input(emb_vectors(spark, sf))
    model, labels, _c = clusters.fit_kmeans(data, k=6)
    root = scratch_path(spark, "models")
    FS.save_model_version(model, root, "20240401")
    loaded = FS.load_model_version(root, "20240401")
    again = loaded.transform(clusters.to_features(data.drop("cluster"))).select(
        "doc_id", F.col("cluster").cast("int").alias("again"))
    # the reloaded model must give every row the label the fitted one gave
    return labels.join(again, "doc_id").select("doc_id", (F.col("cluster") == F.col("again")).alias("same"))


@register("save_embeddings_version", """SELECT vec_id AS doc_id, CAST(len(embedding) AS INTEGER) AS dims,
  round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings""")
def q_save_embeddings_version(spark, sf):
    root = scratch_path(spark, "embeddings")
    path = FS.save_embeddings_version(emb_vectors(spark, sf), root, "20240401")
    back = spark.read.parquet(path)
    return back.select("doc_id", F.size("v").alias("dims"),
                       r6(F.aggregate("v", F.lit(0.0).cast("double"), lambda a, x: a + x)).alias("total"))


@register("write_digest", REGISTRY["digest_by_area"][1])
def q_write_digest(spark, sf):
    d = DG.digest_by_area(slices.scored_articles(spark, sf), X.profiles_v(spark), top_n=3)
    path = FS.write_digest(d, scratch_path(spark, "digests"), "20240401T0000Z")
    return FS.read_digest(spark, path).select("area", "html")


# ================================ L: streams ================================

def _stage_files(spark, df, name, n_files=3, order_col=None):
    """Write ``df`` as ``n_files`` Parquet files in a fresh folder (the stream's landing zone)."""
    path = scratch_path(spark, name)
    d = df.repartitionByRange(n_files, order_col) if order_col else df.repartition(n_files)
    d.write.mode("overwrite").parquet(path)
    return path


_PAGE_ART_SQL = f"""{_d_routed("(SELECT url, min(page_id) AS page_id, arg_min(html, page_id) AS html FROM pages GROUP BY url)")},
page_art AS MATERIALIZED (SELECT * FROM (SELECT page_id, source, url, coalesce({_D_ANY_TITLE.format(h='html')}, title_default) AS title,
    array_to_string(ps, ' ') AS content, lower(nullif(regexp_extract(html, '(?i)<html[^>]*\\blang="([A-Za-z]+)', 1), '')) AS language, len(ps) AS np
  FROM (SELECT *, {_d_paragraphs('html')} AS ps FROM routed))
  WHERE title IS NOT NULL AND np > 0 AND {word_count('content')} > 150 AND language IN ('es', 'en'))"""
_RUN_SCORE = """0.4 * similarity_to_centroid + 0.3 * novelty_score + 0.2 * {recency} + 0.5 * {weight}"""


@register("stream_ingest", with_views(f"""WITH {_PAGE_ART_SQL}, {assigned("page_art", "page_id")}
SELECT page_id, url, cluster, round(similarity_to_centroid, 6) AS similarity_to_centroid FROM page_art JOIN asg USING (page_id)""",
                                      "text_cents_v"))
def q_stream_ingest(spark, sf):
    """Novelty counts the members of a micro-batch, which depends on the files' split; the rest does not."""
    pg = X.table(spark, sf, "pages")
    land = _stage_files(spark, pg.unionByName(pg.where(F.col("page_id") % 5 == 0)), "pages-landing", 3, "url")
    out, ledger, ck = (scratch_path(spark, n) for n in ("ingested", "ledger", "ckpt-ingest"))
    ST.stream_ingest(spark, land, P.source_rules(spark), X.text_centroids_v(spark, sf).checkpoint(), lambda d: EM.embed_text(d, "md5-64"),
                     X.AS_OF, out, ledger, ck, dim=EM.ENCODERS["md5-64"][1])
    return spark.read.parquet(out).select("page_id", "url", "cluster", r6("similarity_to_centroid").alias("similarity_to_centroid"))


@register("stream_url_dedupe", with_views("SELECT DISTINCT url FROM feedback_v WHERE url IS NOT NULL", "feedback_v"))
def q_stream_url_dedupe(spark, sf):
    fb = X.feedback_v(spark, sf).where(F.col("url").isNotNull())
    land = _stage_files(spark, fb, "feedback-landing", 3, "ts")
    s = spark.readStream.schema(ST.FEEDBACK_STREAM_SCHEMA).option("maxFilesPerTrigger", 1).parquet(land)
    out, ck = scratch_path(spark, "dedupe"), scratch_path(spark, "ckpt-dedupe")
    ST.run_to_table(ST.stream_url_dedupe(s, "ts", "400 days"), out, ck)
    return spark.read.parquet(out).select("url")


def _feedback_weekly_cols(df):
    return df.select(ts("week.start").alias("week_start"), ts("week.end").alias("week_end"), "rating", "n")


@register("feedback_weekly", with_views(f"""SELECT {TS('ws')} AS week_start, {TS('ws + INTERVAL 7 DAY')} AS week_end, rating, count(*) AS n
FROM (SELECT rating, TIMESTAMP '1970-01-05 06:00:00' + to_days(CAST(floor(date_diff('second', TIMESTAMP '1970-01-05 06:00:00', ts) / 604800.0) * 7 AS INTEGER)) AS ws
  FROM feedback_v) GROUP BY ALL""", "feedback_v"))
def q_feedback_weekly(spark, sf):
    return _feedback_weekly_cols(ST.weekly_windows(X.feedback_v(spark, sf)))


_FEEDBACK_WEEKLY_SQL = with_views(f"""SELECT {TS('ws')} AS week_start, {TS('ws + INTERVAL 7 DAY')} AS week_end, rating, count(*) AS n
FROM (SELECT rating, TIMESTAMP '1970-01-05 06:00:00' + to_days(CAST(floor(date_diff('second', TIMESTAMP '1970-01-05 06:00:00', ts) / 604800.0) * 7 AS INTEGER)) AS ws
  FROM feedback_v) GROUP BY ALL""", "feedback_v")


# The watermark delay (60 days) exceeds the span of the events (30 days): no row is late, whatever order the
# staged files are read in, so the stream must equal its batch twin.  Dropping of late rows is covered in pytest.
@register("stream_feedback_counts", _FEEDBACK_WEEKLY_SQL)
def q_stream_feedback_counts(spark, sf):
    fb = X.feedback_v(spark, sf)
    land = _stage_files(spark, fb, "feedback-landing", 3, "ts")
    s = spark.readStream.schema(ST.FEEDBACK_STREAM_SCHEMA).option("maxFilesPerTrigger", 1).parquet(land)
    out, ck = scratch_path(spark, "weekly"), scratch_path(spark, "ckpt-weekly")
    ST.run_to_table(ST.stream_feedback_counts(s, delay="60 days"), out, ck, output_mode="update")
    rows = spark.read.parquet(out)
    last = rows.groupBy("week", "rating").agg(F.max_by("n", "batch_id").alias("n"))
    return _feedback_weekly_cols(last)


# ================================ M, K2, K7: composed runs ================================

@register("batch_run", with_views(f"""WITH {assigned("articles_v", "doc_id")}
SELECT doc_id, cluster, round({_RUN_SCORE.format(weight=source_weight('source'), recency=f"exp(-floor((epoch_us({AS_OF_SQL}) - epoch_us(scraping_date)) / 86400000000) / 30.0)")}, 6) AS final_score
FROM articles_v JOIN asg USING (doc_id)""", "articles_v", "text_cents_v"))
def q_batch_run(spark, sf):
    csv = _articles_csv(spark, sf, compression="gzip")
    out = RN.batch_run(spark, csv, scratch_path(spark, "batch-run"), X.AS_OF, model="md5-64",
                       centroids=X.text_centroids_v(spark, sf).checkpoint())
    return out.select("doc_id", "cluster", r6("final_score").alias("final_score"))


@register("weekly_run", with_views(f"""WITH {_PAGE_ART_SQL}, {assigned("page_art", "page_id")},
scored AS (SELECT *, round({_RUN_SCORE.format(weight=source_weight('source'), recency="1.0")}, 12) AS final_score FROM page_art JOIN asg USING (page_id)),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY final_score DESC, page_id) AS rank FROM scored) WHERE rank <= 3)
SELECT '20240401T0000Z' AS generated_at, count(*) AS n_articles,
  '<html><body><div class="container"><div class="header"><h1>{DG.WEEKLY_TITLE}</h1><p>{DG.WEEKLY_SUBTITLE.format(date='20240401T0000Z')}</p></div>'
  || string_agg({_WEEKLY_CARD.format(t=_sql_escape('title'), s=_sql_escape('source'), l=_sql_escape('language'), u=_sql_escape('url'))}, '' ORDER BY final_score DESC, page_id)
  || '<div class="footer">{DG.WEEKLY_FOOTER}</div></div></body></html>' AS html FROM top""", "text_cents_v"))
def q_weekly_run(spark, sf):
    return RN.weekly_run(spark, X.table(spark, sf, "pages"), X.text_centroids_v(spark, sf).checkpoint(), X.AS_OF,
                         scratch_path(spark, "weekly-articles"), scratch_path(spark, "weekly-ledger"), "20240401", "20240401T0000Z",
                         model="md5-64")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_RETRAIN_CORPUS = f"(SELECT * FROM articles_v WHERE source IN ({', '.join(_quoted(x) for x in RN.RETRAIN_SOURCES)}))"
_RETRAIN_TEXT = preprocess("title || '. ' || content")
_RETRAIN_POINTS = f"""SELECT a.doc_id AS id, list(coalesce(e.x, 0.0) ORDER BY d.i) AS v
  FROM {_RETRAIN_CORPUS} a CROSS JOIN (SELECT unnest(range(0, 64)) AS i) d
  LEFT JOIN ({md5_encoded(_RETRAIN_CORPUS, "doc_id", _RETRAIN_TEXT, 64)}) e ON e.doc_id = a.doc_id AND e.i = d.i
  GROUP BY a.doc_id"""


@register("full_retrain", with_views(f"""WITH {KS.scores(_RETRAIN_POINTS, range(4, 13))}
SELECT s.k, round(s.silhouette, 6) AS silhouette, s.k = best_k AS best, n.cluster, n.n
FROM scores s, best, (SELECT CAST(j - 1 AS INTEGER) AS cluster, count(*) AS n FROM own, best WHERE own.k = best_k GROUP BY j) n""",
    "articles_v").replace("WITH ", "WITH RECURSIVE ", 1))
def q_full_retrain(spark, sf):
    """The retrained version: the score of each k with the choice, and the cluster sizes of the stored snapshot."""
    models, snapshot = scratch_path(spark, "retrain-models"), scratch_path(spark, "retrain-corpus")
    meta = RN.full_retrain(spark, X.articles_v(spark, sf), models, snapshot, "20240401", 4, 12, model="md5-64")
    sizes = clusters.cluster_sizes(spark.read.parquet(snapshot).select("cluster"))
    # best_k rows: one value beside every score
    held = sizes.select(F.collect_list(F.struct("cluster", "n"))).scalar()
    scores = meta.select("best_k", F.explode("k_scores").alias("ks")).withColumn("_sizes", held)
    return scores.select("ks.k", r6("ks.silhouette").alias("silhouette"), (F.col("ks.k") == F.col("best_k")).alias("best"), F.inline("_sizes"))


@register("retrain_metadata", _K_SQL)
def q_retrain_metadata(spark, sf):
    best, scores = clusters.find_optimal_k(emb_vectors(spark, sf), 4, 12)
    meta = DG.retrain_metadata(spark, best, scores, "hashing", "20240401").select("best_k", F.explode("k_scores").alias("ks"))
    return meta.select("ks.k", r6("ks.silhouette").alias("silhouette"), (F.col("ks.k") == F.col("best_k")).alias("best"))


_CURATED_SQL = f"""f AS (SELECT * FROM valid_vec_v WHERE NOT coalesce(regexp_matches(source, 'wired', 'i'), false)),
fm AS (SELECT m.doc_id, m.model, f.cluster, m.v, {unit('m.v')} AS u FROM valid_models_v m JOIN f USING (doc_id)),
cents AS ({mean_vec_sql('fm', 'model, cluster', 'v')}),
pairs AS (SELECT a.doc_id AS id_a, b.doc_id AS id_b FROM fm a JOIN fm b ON a.model = b.model AND a.doc_id < b.doc_id
  GROUP BY ALL HAVING avg(list_dot_product(a.u, b.u)) > 0.85),
losers AS (SELECT DISTINCT CASE WHEN fa.word_count >= fb.word_count THEN id_b ELSE id_a END AS doc_id
  FROM pairs JOIN f fa ON fa.doc_id = id_a JOIN f fb ON fb.doc_id = id_b),
cur AS (SELECT * FROM f WHERE doc_id NOT IN (SELECT doc_id FROM losers)),
cm AS (SELECT * FROM fm WHERE doc_id IN (SELECT doc_id FROM cur)),
cmean AS ({mean_vec_sql('cm', 'model, cluster', 'u')}),
es AS (SELECT cm.doc_id, avg(1.0 - list_dot_product(cm.u, cmean.m)) AS novelty_score,
    avg({cosine('cm.v', 'cents.m')}) AS similarity_to_centroid
  FROM cm JOIN cmean USING (model, cluster) JOIN cents USING (model, cluster) GROUP BY cm.doc_id),
ar AS ({area_sql("cur", list(EM.ENSEMBLE.values()))}),
x AS (SELECT cur.*, es.novelty_score, es.similarity_to_centroid, ar.area,
    {source_weight('cur.source')} AS source_score,
    exp(-floor((epoch_us({AS_OF_SQL}) - epoch_us(cur.scraping_date)) / 86400000000) / 30.0) AS recency_score
  FROM cur JOIN es USING (doc_id) JOIN ar USING (doc_id)),
xs AS (SELECT *, 0.4 * similarity_to_centroid + 0.3 * novelty_score + 0.2 * recency_score + 0.1 * source_score AS final_score FROM x)"""


@register("curated_newsletter", with_views(f"""WITH {_CURATED_SQL},
top AS (SELECT area, rank, {_sql_text(DG.AREA_ITEM, title='title', source='source', url='url')} AS item
  FROM (SELECT *, row_number() OVER (PARTITION BY area ORDER BY final_score DESC, doc_id) AS rank FROM xs) WHERE rank <= 3)
SELECT p.area, {_sql_text(DG.AREA_HEADER, area='p.area')} || coalesce(string_agg(t.item, '' ORDER BY t.rank), '') || '{DG.AREA_FOOTER}' AS html
FROM profiles_v p LEFT JOIN top t ON t.area = p.area GROUP BY p.area""", "valid_vec_v", "valid_models_v", "profiles_v"))
def q_curated_newsletter(spark, sf):
    return RN.curated_newsletter(spark, sf, threshold=0.85, top_n=3)


_VARIANT_SQL = REGISTRY["curated_newsletter"][1].replace("0.3 * novelty_score + 0.2 * recency_score + 0.1 * source_score AS final_score FROM x)",
                                                         "0.4 * novelty_score + 0.2 * recency_score + 0.1 * source_score AS final_score FROM x)")


@register("curated_newsletter_novel", _VARIANT_SQL)
def q_curated_newsletter_novel(spark, sf):
    """M6 in its other known form: novelty weighs 0.4."""
    return RN.curated_newsletter(spark, sf, threshold=0.85, top_n=3, w_novelty=0.4)


@register("stage_counts", with_views(f"""WITH {_CURATED_SQL}
SELECT 0 AS ord, 'filtered' AS stage, (SELECT count(*) FROM f) AS n
UNION ALL SELECT 1, 'curated', (SELECT count(*) FROM cur)
UNION ALL SELECT 2, 'scored', (SELECT count(*) FROM xs)""", "valid_vec_v", "valid_models_v", "profiles_v"))
def q_stage_counts(spark, sf):
    _x, stages = RN.curated_scores(spark, sf, threshold=0.85)
    return DG.stage_counts(spark, stages)

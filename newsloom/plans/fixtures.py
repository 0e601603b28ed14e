"""Fixture views over the driver tables (see FIXTURES.md), Spark side.

The DuckDB twins of these views live in ``newsloom.plans.oracle``; both must
describe the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import embed

AS_OF = "2024-04-01 00:00:00"

# ---- fixed values (must equal the reference's) ---------------------------------
# Source names the scrapers emit.
FIXTURE_SOURCES = ["TechCrunch", "Hugging Face Blog", "AWS Blog", "Xataka", "Wired ES", "OpenAI Blog"]
# Business areas, in profile order (the first wins ties).
AREAS = [
    "Data & AI",
    "IT & Cloud",
    "Business",
    "Risk & Compliance",
    "Marketing",
    "Category Management",
    "Supply Chain",
    "Sales / Commercial",
    "Board",
    "New Product Development",
]
# Profile texts per area (used when profiles are embedded with an encoder).
AREA_PROFILES = {
    "Data & AI": "machine learning artificial intelligence data science models analytics",
    "IT & Cloud": "cloud infrastructure devops automation security networks azure aws",
    "Business": "strategy innovation digital transformation operations performance",
    "Risk & Compliance": "regulation ai ethics governance risk compliance privacy",
    "Marketing": "digital marketing customer engagement personalization content automation advertising social media",
    "Category Management": "product portfolio pricing market trends competition consumer insights procurement",
    "Supply Chain": "logistics operations forecasting demand planning inventory optimization manufacturing",
    "Sales / Commercial": "sales enablement customer acquisition crm revenue optimization commercial strategy",
    "Board": "executive leadership corporate strategy decision making innovation governance investment",
    "New Product Development": "product design innovation prototyping research development user needs experimentation",
}
# -------------------------------------------------------------------------------

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


# tables whose rows carry whole texts: per-row text work must use every core
TEXT_TABLES = {"documents", "pages"}


def spread(df: DataFrame) -> DataFrame:
    """Round-robin the rows over ``spark.newsloom.scanPartitions`` partitions if the session sets it.

    For inputs of a few row groups, which give a few scan tasks; the setting is the caller's choice (the bench sets
    it), nothing is decided from the size of the data.
    """
    n = df.sparkSession.conf.get("spark.newsloom.scanPartitions", None)
    return df.repartition(int(n)) if n else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def articles_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    names = F.array(*[F.lit(s) for s in FIXTURE_SOURCES])
    idx = (F.substring("source", 4, 1 << 20).cast("int") % 6) + 1
    return d.select(
        "doc_id",
        F.element_at(names, idx).alias("source"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/"), F.col("doc_id").cast("string")).alias("url"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("content"),
        F.col("lang").alias("language"),
        F.expr("timestamp'2024-01-01 08:00:00' + make_dt_interval(cast(doc_id % 90 as int), cast(doc_id % 13 as int), 0, 0)")
        .alias("scraping_date"),
    )


# Hosts of the site rules (and one that no rule knows), and a block of links of every form the rules judge: kept and
# rejected, quoted in each way, nested, relative, with a leading dot, in allowed and foreign domains.  @ is the page id.
LISTING_HOSTS = ["www.xataka.com", "huggingface.co", "techcrunch.com", "aws.amazon.com", "es.wired.com", "aibusiness.com",
                 "news.microsoft.com", "openai.com", "allenai.org", "blogs.microsoft.com", "news.google.com", "unknown.test"]
LISTING = """<article><a href="https://www.xataka.com/a@">1</a><a href='https://www.xataka.com/b@'>2</a></article>
<article><a href=https://www.xataka.com/tag/@>3</a></article><h2><a href="https://aws.amazon.com/blogs/@">4</a>
<a href="/elsewhere/@">5</a></h2><h2><a href='https://other.test/@'>6</a></h2>
<a class="loop-card__title-link" href="https://techcrunch.com/2024/@">7</a>
<a class='wide loop-card__title-link' href='https://other.test/x@'>8</a><a href="https://techcrunch.com/tag/@">9</a>
<a href="/blog/">10</a><a href="/blog/p@">11</a><a href='/blog/community/@'>12</a><a href="/blog/p@?page=2">13</a>
<a href="/blog">14</a><a href="/blog/p@">15</a><a href=/articulos/@>16</a><a href="/es-ES/news/">17</a>
<a href="/es-ES/news/x@/">18</a><h3 class="listing-title"><a href="/ai/@">19</a></h3>
<h3 class='listing-title wide'><a href="https://other.test/h@">20</a></h3>
<div class="listingResult"><div><a href="https://news.microsoft.com/source/@">21</a></div>
<a href="https://news.microsoft.com/second/@">22</a></div><a href="/research/">23</a><a href=/research/@>24</a>
<a href="https://allenai.org/research/@">25</a><a href="/2024/05/@">26</a><a href="news/post/@">27</a>
<a href="https://azure.microsoft.com/post/@">28</a><a href="https://other.test/post/@">29</a>
<a href="./articles/@">30</a><a href="./topics/@">31</a>"""


def listing_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` as listing pages of the rule hosts: the page's own html after the block of links."""
    hosts = F.array(*[F.lit(h) for h in LISTING_HOSTS])
    host = F.element_at(hosts, (F.col("page_id") % len(LISTING_HOSTS) + 1).cast("int"))
    return table(spark, sf_dir, "pages").select(
        "page_id", F.concat(F.lit("https://"), host, F.lit("/list")).alias("url"),
        F.concat(F.replace(F.lit(LISTING), F.lit("@"), F.col("page_id").cast("string")), F.col("html")).alias("html"))


def pages_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` with cases that drop out: every 5th has no h1 but an og:title, every 7th no title at all, every 11th
    no paragraph, every 13th a host that no rule knows."""
    i = F.col("page_id")
    no_h1 = F.replace(F.replace(F.col("html"), F.lit("<h1>"), F.lit("<h9>")), F.lit("</h1>"), F.lit("</h9>"))
    og = F.concat(F.lit("<meta content='&quot;OG&quot; "), i.cast("string"), F.lit("' property='og:title'>"), no_h1)
    html = F.when(i % 7 == 0, no_h1).when(i % 5 == 0, og).otherwise(F.col("html"))
    html = F.when(i % 11 == 0, F.replace(html, F.lit("<p>"), F.lit("<q>"))).otherwise(html)
    url = F.when(i % 13 == 0, F.lit("https://unknown.test/x")).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", url.alias("url"), html.alias("html"))


def embeddings_count(spark: SparkSession, sf_dir: str):
    """Scalar subquery column: number of rows of ``embeddings`` (evaluated once, no join)."""
    return table(spark, sf_dir, "embeddings").select(F.count(F.lit(1))).scalar()


def vec_v(spark: SparkSession, sf_dir: str, articles: DataFrame | None = None) -> DataFrame:
    a = (articles if articles is not None else articles_v(spark, sf_dir)).select("doc_id")
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    n = embeddings_count(spark, sf_dir)
    j = a.withColumn("vec_id", F.col("doc_id") % n).join(e, "vec_id")
    return j.select("doc_id", F.col("label").alias("cluster"), V.as_double("embedding").alias("v"))


def models_v(spark: SparkSession, sf_dir: str, vec: DataFrame | None = None) -> DataFrame:
    """Three 'models' per document: v, v reversed, v rotated by one and re-weighted then normalized."""
    vv = vec if vec is not None else vec_v(spark, sf_dir)
    rot = F.concat(F.slice("v", 2, F.size("v") - 1), F.slice("v", 1, 1))
    weighted = F.transform(rot, lambda x, i: x * (1 + i % 3))
    m1 = vv.select("doc_id", F.lit("m1").alias("model"), F.col("v"))
    m2 = vv.select("doc_id", F.lit("m2").alias("model"), F.reverse("v").alias("v"))
    m3 = vv.select("doc_id", F.lit("m3").alias("model"), V.l2_normalize(weighted).alias("v"))
    return m1.unionByName(m2).unionByName(m3)


def centroids_v(spark: SparkSession, sf_dir: str, dim: int | None = None) -> DataFrame:
    """Mean embedding per label (not normalized): the 'fitted' centroid table."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("cluster"), V.as_double("embedding").alias("v"))
    return V.mean_vectors(e, ["cluster"], "v", out="centroid", dim=dim)


def profiles_v(spark: SparkSession, models: tuple[str, ...] = ("md5-64",)) -> DataFrame:
    """The ten area profile texts under the named encoders: (ord, area, model, v)."""
    rows = [(i, a, t) for i, (a, t) in enumerate(AREA_PROFILES.items())]
    p = spark.createDataFrame(rows, "ord int, area string, text_for_embedding string").coalesce(1)
    e = embed.embed_models(p, list(models), "ord")
    return e.join(F.broadcast(p.select("ord", "area")), "ord").select("ord", "area", "model", "v")


def text_models(articles: DataFrame, models: tuple[str, ...] = ("md5-64",)) -> DataFrame:
    """Articles (doc_id, title, content) under the named encoders: (doc_id, model, v)."""
    text = articles.select("doc_id", T.text_for_embedding("title", "content").alias("text_for_embedding"))
    return embed.embed_models(text, list(models))


def text_centroids_v(spark: SparkSession, sf_dir: str, k: int = 6, model: str = "md5-64") -> DataFrame:
    """Fixed centroids in the encoder's own space: the mean article vector of each group doc_id % k."""
    v = text_models(articles_v(spark, sf_dir), (model,)).withColumn("cluster", (F.col("doc_id") % k).cast("int"))
    return V.mean_vectors(v, ["cluster"], "v", out="centroid", dim=embed.ENCODERS[model][1])


def processed_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles_v(spark, sf_dir).where(F.col("doc_id") % 3 == 0).select("url")


def feedback_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    a = articles_v(spark, sf_dir).select(F.col("doc_id").alias("user_id"), "url")
    rating = (F.when(F.col("event_type").isin("click", "purchase", "signup"), "thumb_up")
              .when(F.col("event_type") == "error", "thumb_down").otherwise("view"))
    return (ev.join(a, "user_id", "left")
            .select("event_id", "url", rating.alias("rating"), F.col("ts").cast("timestamp").alias("ts")))


_DIMS: dict[str, int] = {}


def vector_dim(spark: SparkSession, sf_dir: str) -> int:
    """Embedding width of a table (read once per path: a model's vectors have a fixed width)."""
    key = f"{sf_dir.rstrip('/')}/embeddings.parquet"
    if key not in _DIMS:
        _DIMS[key] = V.vector_dim(table(spark, sf_dir, "embeddings"), "embedding")
    return _DIMS[key]

"""Feeds (A9-A11) and the feed-side selections (D10, D11, H3): XML / JSON parsed by Spark.

A feed document is one row (``xml`` or ``payload`` column); ``from_xml`` /
``from_json`` parse it in place and ``explode`` yields one row per entry, so
nothing is gathered beyond a single document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import col
from . import pages as P

RSS_SCHEMA = ("channel struct<title:string, item:array<struct<title:string, link:string, pubDate:string, "
              "updated:string, description:string, `content:encoded`:string>>>")
ATOM_SCHEMA = ("title string, entry array<struct<title:string, link:struct<_href:string>, published:string, "
               "updated:string, summary:string, content:string>>")
SITEMAP_SCHEMA = "url array<struct<loc:string>>"
POST_SCHEMA = ("array<struct<title:string, slug:string, author:struct<name:string>, createdAt:string, "
               "summary:string, tags:array<string>, likesCount:long>>")
# ---- fixed values (must equal the reference's) ---------------------------------
NO_CONTENT = "Contenido no disponible"              # full content when neither feed nor page has text
API_POST_BASE = "https://huggingface.co/blog/"      # post url = base + slug
# -------------------------------------------------------------------------------


def xml_escape(c) -> Column:
    out = col(c)
    for raw, ent in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")]:
        out = F.replace(out, F.lit(raw), F.lit(ent))
    return out


def page_texts(pages: DataFrame, profile: str | None = "clean") -> DataFrame:
    """(url, title, content): paragraphs of each page's content container, filtered by a profile, joined by a space;
    pages whose container has no paragraph are left out."""
    paras = P.paragraphs_array(P.content_container(F.col("html"), F.col("url")))
    return _texts(pages, paras, profile)


def _texts(pages: DataFrame, paras: Column, profile: str | None) -> DataFrame:
    # the filter sits in the generator, on the bound row: a filter above it would be pushed down and parse twice
    row = F.struct(P.extract_title("html").alias("title"), paras.alias("paras"))
    kept = pages.select("url", F.inline(F.filter(F.array(row), lambda x: F.size(x["paras"]) > 0)))
    chosen = P.filter_paragraphs("paras", profile) if profile else F.col("paras")
    return kept.select("url", "title", F.array_join(chosen, " ").alias("content"))


def collector_texts(pages: DataFrame) -> DataFrame:
    """(url, title, content) as the feed collector reads a page: container prose, else article, else main, else
    content; paragraphs of more than 50 characters; pages without a container or paragraphs yield nothing."""
    return _texts(pages, P.paragraphs_array(P.container_html(F.col("html"), "div.prose, article, main, div.content", by_priority=True)), "long")


def feed_items(feeds: DataFrame, xml_col: str = "xml", keep: tuple[str, ...] = ()) -> DataFrame:
    """RSS 2.0 or Atom documents -> one row per entry.

    Output: (source, feed_ord, pos, title, url, published, summary, content, date) where ``date`` is the
    published (else updated) date parsed as RFC-822 with the offset dropped; unparseable -> null.
    """
    # the format is chosen first: a document is parsed once, the other parser sees null
    is_atom = F.col(xml_col).rlike(r"^\s*(<\?xml[^>]*>\s*)?<feed\b")
    rss = F.from_xml(F.when(~is_atom, F.col(xml_col)), RSS_SCHEMA, {"mode": "PERMISSIVE"})
    atom = F.from_xml(F.when(is_atom, F.col(xml_col)), ATOM_SCHEMA, {"mode": "PERMISSIVE"})
    f = feeds.withColumn("_rss", rss).withColumn("_atom", atom)
    rss_items = F.transform(F.coalesce(F.col("_rss.channel.item"), F.array()), lambda e: F.struct(
        e["title"].alias("title"), e["link"].alias("url"), e["pubDate"].alias("published"), e["updated"].alias("updated"),
        e["description"].alias("summary"), e.getField("content:encoded").alias("content")))
    atom_items = F.transform(F.coalesce(F.col("_atom.entry"), F.array()), lambda e: F.struct(
        e["title"].alias("title"), e["link"]["_href"].alias("url"), e["published"].alias("published"),
        e["updated"].alias("updated"), e["summary"].alias("summary"), e["content"].alias("content")))
    items = F.when(is_atom, atom_items).otherwise(rss_items)
    ex = f.select("source", F.col("feed_ord"), *keep, F.posexplode(items).alias("pos", "e"))
    return ex.select("source", "feed_ord", *keep, "pos",
                     F.coalesce(F.col("e.title"), F.lit("")).alias("title"),
                     F.coalesce(F.col("e.url"), F.lit("")).alias("url"),
                     F.coalesce(F.col("e.published"), F.col("e.updated")).alias("published"),
                     F.coalesce(F.col("e.summary"), F.lit("")).alias("summary"),
                     F.col("e.content").alias("content"),
                     T.parse_feed_date("e.published", "e.updated").alias("date"))


def sitemap_urls(sitemaps: DataFrame, contains: str = "/blog/", max_urls: int = 50, xml_col: str = "xml",
                 key: str = "sitemap_id") -> DataFrame:
    """A10: ``loc`` values containing ``contains``, the first ``max_urls`` of each sitemap in document order."""
    s = sitemaps.select(key, F.posexplode(F.from_xml(F.col(xml_col), SITEMAP_SCHEMA)["url"]).alias("pos", "u"))
    s = s.select(key, "pos", F.col("u.loc").alias("loc")).where(F.col("loc").contains(contains))
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("pos")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max_urls)


def api_posts(payloads: DataFrame, as_of: str, days: int = 30, payload_col: str = "payload") -> DataFrame:
    """JSON posts newer than ``as_of - days`` (createdAt in UTC, 'Z' accepted); defaults for missing fields."""
    p = payloads.select(F.explode(F.from_json(F.col(payload_col), POST_SCHEMA)).alias("p"))
    created = F.to_timestamp(F.regexp_replace(F.col("p.createdAt"), "Z$", "+00:00"))
    cutoff = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))
    return (p.withColumn("created", created).where(F.col("created") >= cutoff)
            .select(F.coalesce("p.title", F.lit("")).alias("title"),
                    F.concat(F.lit(API_POST_BASE), F.coalesce("p.slug", F.lit(""))).alias("url"),
                    F.coalesce("p.author.name", F.lit("")).alias("author"),
                    F.date_format("created", "yyyy-MM-dd").alias("date"),
                    F.coalesce("p.summary", F.lit("")).alias("summary"),
                    F.coalesce("p.tags", F.array().cast("array<string>")).alias("tags"),
                    F.coalesce("p.likesCount", F.lit(0)).alias("likes")))


def feed_recent(entries: DataFrame, as_of: str, days: int = 7, summary_chars: int = 300,
                ordered: bool = True) -> DataFrame:
    """Dated within ``days`` of as_of (an unparseable date counts as now), newest first, summary cut to 300.

    ``ordered=False`` skips the global sort (a range-partitioned shuffle) when a consumer applies its own order
    (the enrichment top-k, the by-source digest lines).
    """
    now = F.lit(as_of).cast("timestamp")
    eff = F.coalesce(F.col("date"), now)
    out = (entries.withColumn("date", eff).where(F.col("date") >= now - F.make_dt_interval(F.lit(days)))
           .withColumn("summary", T.truncate_summary("summary", summary_chars)))
    return out.orderBy(F.desc("date"), "feed_ord", "pos") if ordered else out


def feed_collect(entries: DataFrame, articles: DataFrame, as_of: str, days: int = 7, max_articles: int = 20) -> DataFrame:
    """Entries within the window (undated kept), with url and title, whose page yields an article;
    the first ``max_articles`` in source-then-entry order (a top-k, not a global window)."""
    now = F.lit(as_of).cast("timestamp")
    e = entries.where((F.col("date").isNull()) | (F.col("date") >= now - F.make_dt_interval(F.lit(days))))
    e = e.where((F.col("url") != "") & (F.col("title") != ""))
    j = e.join(articles.select("url", F.col("title").alias("page_title"), F.col("content").alias("page_content")),
               "url")
    return j.orderBy("feed_ord", "pos").limit(max_articles)


def enrich_feed(entries: DataFrame, articles: DataFrame, max_articles: int = 10, min_feed_chars: int = 500) -> DataFrame:
    """H3: newest ``max_articles`` entries; full content = feed text when longer than 500 chars, else the page's
    text, else the feed text, else 'Contenido no disponible'."""
    rss = T.feed_content("content", "summary")
    day = F.date_format("date", "yyyy-MM-dd")  # entries are ranked by day, then in feed order
    top = (entries.withColumn("rss_content", rss)
           .orderBy(F.desc_nulls_last(day), "feed_ord", "pos").limit(max_articles))
    j = top.join(articles.select("url", F.col("content").alias("_page")), "url", "left")
    full = (F.when(F.length("rss_content") > min_feed_chars, F.col("rss_content"))
            .when(F.col("_page").isNotNull() & (F.col("_page") != ""), F.col("_page"))
            .when(F.col("rss_content") != "", F.col("rss_content"))
            .otherwise(F.lit(NO_CONTENT)))
    return j.withColumn("full_content", full).drop("_page")

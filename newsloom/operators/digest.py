"""Aggregates and digests (section K).

A digest that renders a bounded selection (top N per area / cluster, the first
``max_articles`` feed entries) is assembled with an ordered ``collect_list`` of
at most N rows per group.  A digest over an unbounded list (every recent feed
entry) is emitted as ordered *lines* with their sort keys, so a sink writes it
with a distributed sort and no task ever holds the whole document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import html_escape
from .select import top_n_per_group

# ---- fixed values (must equal the reference's) ---------------------------------
AREA_HEADER = "<h1>Newsletter – {area}</h1><ul>"
AREA_ITEM = ("\n        <li>\n            <b>{title}</b><br>\n            <i>{source}</i><br>\n"
             "            <a href=\"{url}\">Leer más</a>\n        </li>\n        ")
AREA_FOOTER = "</ul>"
STYLED_AREA_HEADER = """
    <style>
        body { font-family: Arial; }
        h1 { color: #2C3E50; }
        ul { list-style-type: none; padding: 0; }
        li {
            margin-bottom: 15px;
            padding: 10px;
            border-left: 4px solid #3498DB;
            background: #F9F9F9;
        }
        a { text-decoration: none; color: #2980B9; }
        i { color: #7F8C8D; }
    </style>
    <h1>Newsletter – @AREA@</h1>
    <ul>
    """
FEED_TITLE = "<h1>📰 Newsletter IA Semanal</h1>\n"
SOURCE_HEADER = "<h2>{source}</h2>\n<ul>\n"
SOURCE_ITEM = '  <li><a href="{url}">{title}</a> - {date}<br>  <small>{summary}</small></li>\n'
SOURCE_FOOTER = "</ul>\n"
FULL_ITEM = "<h2><a href='{url}'>{title}</a></h2>\n<p><strong>{source}</strong> - {date}</p>\n<div>{content}</div>\n<hr>\n"
WEEKLY_TITLE = "🧠 AI Newsletter"  # the organisation's name is a deployment setting, not part of the format
WEEKLY_SUBTITLE = "Generado automáticamente el {date}"
WEEKLY_FOOTER = "Sistema automatizado de clasificación basado en clustering."
READ_MORE = "Leer más"
# -------------------------------------------------------------------------------


def _fill(template: str, escape: bool = False, **cols) -> F.Column:
    """Render ``template`` with column values; a null value renders as 'None', as a Python f-string would."""
    parts, rest = [], template
    while "{" in rest:
        pre, tail = rest.split("{", 1)
        name, rest = tail.split("}", 1)
        if pre:
            parts.append(F.lit(pre))
        c = cols[name]
        c = c if isinstance(c, F.Column) else F.col(c)
        c = c.cast("string")
        parts.append(html_escape(c) if escape else F.coalesce(c, F.lit("None")))
    if rest:
        parts.append(F.lit(rest))
    return F.concat(*parts)


def source_counts(df: DataFrame, source_col: str = "source") -> DataFrame:
    """K1."""
    return df.groupBy(source_col).agg(F.count(F.lit(1)).alias("n"))


def stage_counts(spark: SparkSession, stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """K2: (stage, n) for each named stage (one partial count per stage, unioned)."""
    out = None
    for i, (name, df) in enumerate(stages):
        c = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("ord"), F.lit(name).alias("stage"), "n")
        out = c if out is None else out.unionByName(c)
    return out


def digest_by_area(scored: DataFrame, areas: DataFrame | None = None, top_n: int = 3, escape: bool = False,
                   key: str = "doc_id", styled: bool = False) -> DataFrame:
    """K3: one HTML string per area from its best ``top_n`` articles (areas without articles get an empty list).

    ``styled`` selects the variant with an embedded style block (used with top 10)."""
    top = top_n_per_group(scored, "area", top_n, key=key)
    item = _fill(AREA_ITEM, escape, title="title", source="source", url="url")
    g = (top.select("area", F.struct("rank", item.alias("html")).alias("it"))
         .groupBy("area").agg(F.sort_array(F.collect_list("it")).alias("its")))
    if areas is not None:
        g = areas.select("area").distinct().join(g, "area", "left")
    body = F.array_join(F.transform(F.coalesce("its", F.array().cast("array<struct<rank:int,html:string>>")),
                                    lambda s: s["html"]), "")
    if styled:
        pre, post = STYLED_AREA_HEADER.split("@AREA@")
        area = html_escape(F.col("area")) if escape else F.col("area")
        head = F.concat(F.lit(pre), area, F.lit(post))
    else:
        head = _fill(AREA_HEADER, escape, area="area")
    return g.select("area", F.concat(head, body, F.lit(AREA_FOOTER)).alias("html"))


def digest_by_source_lines(entries: DataFrame, escape: bool = False) -> DataFrame:
    """K4: the by-source HTML list as ordered lines.

    Entries (source, feed_ord, pos, title, url, date, summary) are ranked newest day first, then in feed order;
    sources appear in the order of their first entry.  Output: (s_day, s_feed_ord, s_pos, part, day, feed_ord, pos,
    line); the document is the lines sorted by the key columns, after the title line (part = -1).
    """
    e = entries.withColumn("day_str", F.date_format("date", "yyyy-MM-dd"))
    # first appearance of a source = its smallest (day desc, feed_ord, pos) key; negate the day for ascending order
    first = (e.groupBy("source").agg(F.min(F.struct((F.lit(0) - F.datediff(F.col("date"), F.lit("1970-01-01"))).alias("d"),
                                                    F.col("feed_ord"), F.col("pos"))).alias("k")))
    first = first.select("source", F.col("k.d").alias("s_day"), F.col("k.feed_ord").alias("s_feed_ord"),
                         F.col("k.pos").alias("s_pos"))
    items = e.join(first, "source").select(
        "s_day", "s_feed_ord", "s_pos", F.lit(1).alias("part"),
        (F.lit(0) - F.datediff(F.col("date"), F.lit("1970-01-01"))).alias("day"), "feed_ord", "pos",
        _fill(SOURCE_ITEM, escape, url="url", title="title", date="day_str", summary="summary").alias("line"))
    zero = [F.lit(0).alias(c) for c in ("day", "feed_ord", "pos")]
    heads = first.select("s_day", "s_feed_ord", "s_pos", F.lit(0).alias("part"), *zero,
                         _fill(SOURCE_HEADER, escape, source="source").alias("line"))
    foots = first.select("s_day", "s_feed_ord", "s_pos", F.lit(2).alias("part"), *zero, F.lit(SOURCE_FOOTER).alias("line"))
    title = entries.sparkSession.range(1).select(*[F.lit(-(1 << 30)).alias(c) for c in ("s_day", "s_feed_ord", "s_pos")],
                                                  F.lit(-1).alias("part"), *zero, F.lit(FEED_TITLE).alias("line"))
    return title.unionByName(heads).unionByName(items).unionByName(foots)


LINE_ORDER = ["s_day", "s_feed_ord", "s_pos", "part", "day", "feed_ord", "pos"]


def digest_full(enriched: DataFrame, escape: bool = False) -> DataFrame:
    """K5: one HTML document with the full content of each selected entry (input is already a top-k)."""
    day = F.date_format("date", "yyyy-MM-dd")
    item = _fill(FULL_ITEM, escape, url="url", title="title", source="source", date=day, content="full_content")
    key = F.struct((F.lit(0) - F.datediff(F.col("date"), F.lit("1970-01-01"))).alias("d"), "feed_ord", "pos")
    g = enriched.select(F.struct(key.alias("k"), item.alias("html")).alias("it")).agg(
        F.sort_array(F.collect_list("it")).alias("its"))
    return g.select(F.concat(F.lit(FEED_TITLE), F.array_join(F.transform("its", lambda s: s["html"]), "")).alias("html"))


def digest_weekly(scored: DataFrame, generated_at: str, top_n: int = 3, escape: bool = True,
                  key: str = "doc_id", title: str = WEEKLY_TITLE) -> DataFrame:
    """K6: the weekly newsletter: header with the run stamp, one card per selected article (best ``top_n`` per
    cluster, in overall score order), footer.  One row per run; the selection is bounded by k * top_n."""
    top = top_n_per_group(scored, "cluster", top_n, key=key)
    card = F.concat(F.lit('<div class="article"><h3>'), html_escape(F.col("title")), F.lit('</h3><div class="meta">'),
                    html_escape(F.col("source")), F.lit(" · "), html_escape(F.col("language")),
                    F.lit(f'</div><a href="'), html_escape(F.col("url")),
                    F.lit(f'" target="_blank" class="read-more">{READ_MORE}</a></div>'))
    if not escape:
        card = F.concat(F.lit('<div class="article"><h3>'), F.col("title"), F.lit('</h3><div class="meta">'),
                        F.col("source"), F.lit(" · "), F.col("language"), F.lit('</div><a href="'), F.col("url"),
                        F.lit(f'" target="_blank" class="read-more">{READ_MORE}</a></div>'))
    k = F.struct(F.lit(0.0) - F.col("final_score"), F.col(key))
    g = top.select(F.struct(k.alias("k"), card.alias("c")).alias("it")).agg(F.sort_array(F.collect_list("it")).alias("its"),
                                                                          F.count(F.lit(1)).alias("n_articles"))
    header = (f'<html><body><div class="container"><div class="header"><h1>{title}</h1><p>'
              + WEEKLY_SUBTITLE.format(date=generated_at) + "</p></div>")
    footer = f'<div class="footer">{WEEKLY_FOOTER}</div></div></body></html>'
    return g.select(F.lit(generated_at).alias("generated_at"), "n_articles",
                    F.concat(F.lit(header), F.array_join(F.transform("its", lambda s: s["c"]), ""), F.lit(footer)).alias("html"))


def retrain_metadata(spark: SparkSession, best_k: int, scores: DataFrame, model_name: str, trained_at: str) -> DataFrame:
    """K7: one row: best_k, the per-k scores (a k-row list), model name and time."""
    s = scores.agg(F.sort_array(F.collect_list(F.struct("k", "silhouette"))).alias("k_scores"))
    return s.select(F.lit(best_k).alias("best_k"), "k_scores", F.lit(model_name).alias("model"),
                    F.lit(trained_at).alias("trained_at"))

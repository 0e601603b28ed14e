"""Page rules (html_sites), feeds (rss_xml, sitemap_xml, api_json) on hand-made rows."""

from pyspark.sql import functions as F

from newsloom.sources import feeds, pages

AS_OF = "2024-04-01 00:00:00"


def test_paragraphs_unclosed_and_script(spark):
    html = ('<html><head><script>var t="</p>";</script></head><body><article><h1>T &amp; U</h1>'
            '<p>one <b>bold</b><br><p>two</p><!-- <p>hidden</p> --><p>three &lt;x&gt;</p></article><p>after</p></body></html>')
    df = spark.createDataFrame([(1, "https://a.example.com/x", html)], "page_id long, url string, html string")
    got = df.select(pages.paragraphs_array("html").alias("p")).first().p
    assert got == ["one bold", "two", "three <x>", "after"]
    assert df.select(pages.extract_title("html")).first()[0] == "T & U"


def test_title_fallbacks(spark):
    df = spark.createDataFrame([(1, '<meta property="og:title" content="OG">'), (2, "<p>x</p>")], "page_id long, html string")
    got = {r.page_id: r.t for r in df.select("page_id", pages.extract_title("html").alias("t")).collect()}
    assert got == {1: "OG", 2: "Sin título"}


def test_rules_filter_resolve_and_route(spark):
    html_hf = '<a href="/blog/">x</a><a href="/blog/post-1">a</a><a href="/blog/community/z">b</a><a href="/docs">c</a>'
    html_oa = '<a href="/es-ES/news/">x</a><a href="/es-ES/news/item/">y</a>'
    html_xt = ('<article><a href="https://www.xataka.com/a">1</a><a href="https://www.xataka.com/b">2</a></article>'
               '<article><a href="https://www.xataka.com/tag/x">3</a></article>')
    df = spark.createDataFrame([(1, "https://huggingface.co/blog", html_hf), (2, "https://openai.com/es-ES/news/", html_oa),
                                (3, "https://www.xataka.com/", html_xt), (4, "https://unknown.test/", "<a href='/x'>")],
                               "page_id long, url string, html string")
    rules = pages.source_rules(spark)
    links = {(r.page_id, r.link) for r in pages.resolve_links(df, rules).collect()}
    assert (1, "https://huggingface.co/blog/post-1") in links
    assert not any(l.endswith("/blog/") or "community" in l for _, l in links)
    assert (2, "https://openai.com/es-ES/news/item/") in links and (2, "https://openai.com/es-ES/news/") not in links
    routed = {r.page_id: r.source for r in pages.route_url_to_source(df, rules).collect()}
    assert routed == {1: "Hugging Face Blog", 2: "OpenAI Blog", 3: "Xataka"}  # unknown host dropped
    first = [r.href for r in pages.scoped_links(df.where("page_id = 3"), "article", first_only=True).orderBy("container_pos").collect()]
    assert first == ["https://www.xataka.com/a", "https://www.xataka.com/tag/x"]


def test_container_choice_and_dense_div(spark):
    html1 = '<div class="other"><p>x</p></div><div class="markdown"><p>md text</p></div>'
    html2 = '<div><p>a</p><p>b</p><p>c</p><p>d</p></div>'
    df = spark.createDataFrame([(1, "https://huggingface.co/blog/x", '<div class="prose"><p>prose text</p></div>'),
                                (2, "https://site.test/x", html2), (3, "https://site.test/y", html1)], "page_id long, url string, html string")
    got = {r.page_id: r.c for r in df.select("page_id", pages.tag_text(pages.content_container(F.col("html"), F.col("url"))).alias("c")).collect()}
    assert got[1] == "prose text" and got[2] == "a b c d"


def test_paragraph_profiles(spark):
    df = spark.createDataFrame([(["Share this article with everybody you know right now", "x" * 45,
                                  "Copyright 2024 all of it, and more words here to pass", "y" * 51],)], "p array<string>")
    assert len(df.select(pages.filter_paragraphs("p", "short")).first()[0]) == 3
    assert len(df.select(pages.filter_paragraphs("p", "clean")).first()[0]) == 3
    assert len(df.select(pages.filter_paragraphs("p", "long")).first()[0]) == 3


def test_rss_and_atom(spark):
    rss = ("<rss><channel><title>S</title>"
           "<item><title>A</title><link>https://x/a</link><pubDate>Mon, 25 Mar 2024 10:00:00 +0100</pubDate>"
           "<description>sum</description><content:encoded>full</content:encoded></item>"
           "<item><title>B</title><link>https://x/b</link><pubDate>garbage</pubDate><description>s2</description></item>"
           "<item><title></title><link>https://x/c</link></item></channel></rss>")
    atom = ('<feed><title>F</title><entry><title>E</title><link href="https://y/e"/><updated>Tue, 26 Mar 2024 09:00:00 +0000'
            '</updated><summary>es</summary></entry></feed>')
    df = spark.createDataFrame([("S", 0, rss), ("F", 1, atom)], "source string, feed_ord int, xml string")
    items = feeds.feed_items(df).orderBy("feed_ord", "pos").collect()
    assert [i.title for i in items] == ["A", "B", "", "E"]
    assert str(items[0].date) == "2024-03-25 10:00:00" and items[1].date is None and items[2].date is None
    assert items[3].url == "https://y/e" and str(items[3].date) == "2024-03-26 09:00:00"
    content = [r.c for r in feeds.feed_items(df).select(
        __import__("newsloom.functions.text", fromlist=["x"]).feed_content("content", "summary").alias("c")).collect()]
    assert "full" in content and "s2" in content
    recent = feeds.feed_recent(feeds.feed_items(df), AS_OF, days=7).collect()
    assert {r.title for r in recent} == {"A", "B", "", "E"}  # undated rows count as now
    assert [r.title for r in feeds.feed_recent(feeds.feed_items(df), AS_OF, days=1).collect()] != ["A"]


def test_sitemap_first_n(spark):
    xml = "<urlset>" + "".join(f"<url><loc>https://s/{'blog/' if i % 2 else ''}{i}</loc></url>" for i in range(10)) + "</urlset>"
    df = spark.createDataFrame([(1, xml)], "sitemap_id int, xml string")
    got = [r.loc for r in feeds.sitemap_urls(df, "/blog/", 3).orderBy("rank").collect()]
    assert got == ["https://s/blog/1", "https://s/blog/3", "https://s/blog/5"]


def test_api_posts_defaults_and_cutoff(spark):
    payload = ('[{"title": "a", "slug": "s1", "createdAt": "2024-03-30T10:00:00Z", "summary": "x"},'
               ' {"title": "b", "slug": "s2", "author": {"name": "N"}, "createdAt": "2023-01-01T00:00:00Z", "tags": ["t"]}]')
    got = feeds.api_posts(spark.createDataFrame([(payload,)], "payload string"), AS_OF, days=30).collect()
    assert len(got) == 1 and got[0].author == "" and got[0].tags == [] and got[0].likes == 0
    assert got[0].url == "https://huggingface.co/blog/s1" and got[0].date == "2024-03-30"


def test_scoped_rules_per_site(spark):
    pages_rows = [
        (1, "https://techcrunch.com/tag/ai/", '<a href="https://techcrunch.com/x">nav</a>'
            '<a class="loop-card__title-link" href="https://techcrunch.com/2024/a/">A</a>'
            '<a href="https://techcrunch.com/2024/b/" class="x loop-card__title-link">B</a>'),
        (2, "https://aws.amazon.com/blogs/ml/", '<h2><a href="https://aws.amazon.com/blogs/p1/">1</a></h2>'
            '<a href="https://aws.amazon.com/blogs/nav/">n</a><h2 class="t"><a href="https://other.com/z">z</a></h2>'),
        (3, "https://news.microsoft.com/feed/", '<div class="listingResult"><a href="https://news.microsoft.com/a/">a</a>'
            '<a href="https://news.microsoft.com/b/">b</a></div><a href="https://news.microsoft.com/c/">c</a>'),
        (4, "https://aibusiness.com/", '<h3 class="listing-title"><a href="/ml/story">s</a></h3><a href="/other">o</a>'),
        (5, "https://es.wired.com/tag/ia", '<a href="/articulos/uno">1</a><a href="/tag/x">x</a>'),
        (6, "https://www.xataka.com/", '<article><a href="https://www.xataka.com/a">1</a>'
            '<a href="https://www.xataka.com/b">2</a></article><article><a href="https://www.xataka.com/tag/t">t</a></article>'),
    ]
    df = spark.createDataFrame(pages_rows, "page_id long, url string, html string")
    got = {}
    for r in pages.resolve_links(df, pages.source_rules(spark)).collect():
        got.setdefault(r.page_id, []).append((r.pos, r.link))
    links = {k: [l for _, l in sorted(v)] for k, v in got.items()}
    assert links[1] == ["https://techcrunch.com/2024/a/", "https://techcrunch.com/2024/b/"]
    assert links[2] == ["https://aws.amazon.com/blogs/p1/"]
    assert links[3] == ["https://news.microsoft.com/a/"]
    assert links[4] == ["https://aibusiness.com/ml/story"]
    assert links[5] == ["https://es.wired.com/articulos/uno"]
    assert links[6] == ["https://www.xataka.com/a"]  # first link per article; /tag/ excluded


def test_build_articles_rule_container_and_title_default(spark):
    hf = ('<html><body><h1>HF post</h1><div class="prose-other"><p>skip me</p></div>'
          '<div class="markdown"><p>first para</p><p>second para</p></div><p>outside</p></body></html>')
    no_h1 = '<html><body><div class="markdown"><p>text</p></div></body></html>'
    generic_no_h1 = '<html><body><p>text</p></body></html>'
    df = spark.createDataFrame([(1, "https://huggingface.co/blog/a", hf), (2, "https://huggingface.co/blog/b", no_h1),
                                (3, "https://a.example.com/x", generic_no_h1), (4, "https://a.example.com/y", "<h1>T</h1>")],
                               "page_id long, url string, html string")
    got = {r.page_id: r for r in pages.build_articles(df, pages.source_rules(spark), AS_OF).collect()}
    assert got[1].content == "first para second para" and got[1].source == "Hugging Face Blog"
    assert got[2].title == "Sin título"          # the rule's default title
    assert 3 not in got and 4 not in got         # no h1 on a generic page / no paragraphs: dropped


def test_enrich_feed_fallback_chain(spark):
    long_text = "x" * 501
    entries = spark.createDataFrame([
        ("S", 0, 1, "a", "https://p/1", long_text, "", "2024-03-30 10:00:00"),   # long feed content wins
        ("S", 0, 2, "b", "https://p/2", "", "short summary", "2024-03-30 09:00:00"),  # page text wins
        ("S", 0, 3, "c", "https://p/3", "", "only summary", "2024-03-29 10:00:00"),   # no page: feed text
        ("S", 0, 4, "d", "https://p/4", "", "", "2024-03-28 10:00:00"),               # nothing at all
    ], "source string, feed_ord int, pos int, title string, url string, content string, summary string, date string")
    entries = entries.withColumn("date", F.to_timestamp("date"))
    arts = spark.createDataFrame([("https://p/1", "page one"), ("https://p/2", "page two")], "url string, content string")
    got = {r.pos: r.full_content for r in feeds.enrich_feed(entries, arts, max_articles=10).collect()}
    assert got == {1: long_text, 2: "page two", 3: "only summary", 4: "Contenido no disponible"}
    top2 = {r.pos for r in feeds.enrich_feed(entries, arts, max_articles=2).collect()}
    assert top2 == {1, 2}  # newest day first, then feed order

import html
import re
import time

from newsloom.llm import htmltext, queries
from tests.llm.conftest import SF


def test_query_equals_article_markup(spark):
    """In these tables the article is one element of known markup, so a plain reading of it is the truth."""
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op9_main_text(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"(?s)<article>(.*)</article>", pages[r["page_id"]]["html"])[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b)
        assert r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


LONG = "A sentence with enough words to look like prose, and some more of them to be safe. "


def test_furniture_goes():
    page = f"""<html><head><title>t</title><style>p{{}}</style></head><body><div id="header">Site</div>
    <div class="cookie-notice">We use cookies {LONG}</div><ul class="menu"><li><a href="/">Home</a><li>More</ul>
    <div class="content"><h1>Title &amp; more</h1><p>{LONG}<p>Short.<ul><li>one<li>two</ul><script>var x = "<p>no</p>";</script>
    <div class="sidebar">{LONG}</div><form><label>Mail</label><input name="m"></form><blockquote>{LONG}</blockquote></div>
    <section id="comments"><p>{LONG}</p></section><aside>{LONG}</aside><!-- {LONG} --><div id="footer">(c)</div></body>"""
    text = LONG.strip()
    assert htmltext.main_text(page).split("\n") == ["Title & more", text, "Short.", "one", "two", text]


def test_sections_of_an_article_stay_together():
    page = f"<body><ul><li><a href='/'>Home</a><li><a href='/x'>News</a></ul><article><section>{'<p>' + LONG * 5}</section><section><p>Short end.</section></article></body>"
    assert htmltext.main_text(page).split("\n") == [(LONG * 5).strip(), "Short end."]
    bare = f"<body><ul><li><a href='/'>Home</a><li><a href='/x'>News</a></ul><h2>Head</h2><p>{LONG}<p>Short end."
    assert htmltext.main_text(bare).split("\n") == ["Head", LONG.strip(), "Short end."]


def test_small_clusters_beside_the_main_container_stay():
    body = "".join(f"<p>{LONG * 2}</p>" for _ in range(12))
    menu = "<ul><li><a href='/'>Home</a><li><a href='/x'>News</a></ul>"
    page = f"<body>{menu}<div id=story><h1>A headline of words</h1><div class=lead><p>{LONG}</p></div><div class=body>{body}</div></div></body>"
    text = (LONG * 2).strip()
    assert htmltext.main_text(page).split("\n") == ["A headline of words", LONG.strip()] + [text] * 12
    late = f"<body>{menu}<div>{body}</div><div class=share>{LONG}</div><div><p>{LONG}<p>Short end.</div></body>"
    assert htmltext.main_text(late).split("\n") == [text] * 12 + [LONG.strip(), "Short end."]
    two = f"<body>{menu}<div><article>{body * 4}<p><a href='/s'>Source</a></article><article>{body[:len(body) // 4]}</article></div>{menu}</body>"
    assert htmltext.main_text(two).split("\n") == [text] * 48 + ["Source"] + [text] * 3


def test_edge_pages(spark):
    cases = [(1, None, None), (2, "u", ""), (3, "u", "plain &lt;text&gt;\n only"), (4, "u", "<p>a</p><p>b"), (5, "u", "<"), (6, "u", "</div></p>"),
             (None, None, "<p>x  y</p>"), (4, "u", "<p>a</p><p>b"), (7, "u", "<div>" * 3000 + "deep"), (8, "u", "<p>" + "long " * 100_000)]
    df = spark.createDataFrame([(i, u, h, "x") for i, u, h in cases], "page_id long, url string, html string, text string")
    got = {(r["id"], r["text"][:20], r["n_chars"]) for r in htmltext.extract_main_text(df).collect()}
    assert got == {(1, "", 0), (2, "", 0), (3, "plain <text> only", 17), (4, "a\nb", 3), (5, "<", 1), (6, "", 0), (None, "x y", 3),
                   (7, "deep", 4), (8, "long long long long ", 499_999)}
    assert htmltext.extract_main_text(df).count() == len(cases)
    assert htmltext.extract_main_text(df.limit(0)).count() == 0


WORDS = " ".join(f"word{i}" for i in range(50)) + "."


def test_unknown_marked_sections_and_endings():
    for page, want in [("<p>a</p><![foo[x]]><p>b</p>", "a\nb"), ("a<![CDATA[x>y]]>b", "ab"), ("<!DOCTYPE [", ""), ("<p>x</p><![x[", "x"),
                       ("x <b", "x"), ("<p>x</p><!-- never", "x"), ("x & y &amp", "x & y &"), ("text &lt", "text <"), ("<", "<"),
                       ("<p>x</p><textarea>zz", "x"), ("a < b", "a < b"), ("<![if !IE]><p>y</p><![endif]>", "y")]:
        assert htmltext.main_text(page) == want, page


def test_containers_of_the_article_are_no_furniture():
    menu = "<ul><li><a href=/>link</a></ul>"
    for page in (f'<form id="aspnetForm"><article><p>{WORDS}</p></article></form>{menu}',
                 f'<div class="social-science"><p>{WORDS}</p></div>{menu}', f"<form><div><p>{WORDS}</p></div></form>{menu}",
                 f'<div id="sidebar"><main><p>{WORDS}</p></main></div><div class="sidebar">{LONG}</div>',
                 f'<header><article><p>{WORDS}</p></article></header>'):
        assert htmltext.main_text(page) == WORDS, page
    page = f"""<article><p>{WORDS}</p><section id="related-work"><p>{WORDS}</p></section><p class="ad-hoc">Short, ad hoc.</p>
    <div class="related-links"><a href=/x>{WORDS}</a></div><div class="ad-slot">Buy this now</div></article>"""
    assert htmltext.main_text(page) == f"{WORDS}\n{WORDS}\nShort, ad hoc."


def test_furniture_stays_furniture():
    comments = f'<section id="comments"><p>{LONG * 9}</p><article class="comment"><p>{LONG}</p></article></section>'
    page = f'<div class=post><p>{LONG * 2}</p></div>{comments}<div class="cookie-notice">{LONG}</div><div class="site-footer">{LONG}</div>'
    assert htmltext.main_text(page) == (LONG * 2).strip()
    assert htmltext.main_text(f"<article><p>{LONG}</p></article><div class=promo>{LONG * 9}</div>") == LONG.strip()


def test_hostile_pages_take_linear_time():
    hostile = [lambda n: "<a " * n, lambda n: "<p a='" * n, lambda n: "<!--" * n, lambda n: "<b>" * n + "<div>x" * n,
               lambda n: "<b>" * n + "</i>" * n, lambda n: "<p><tr>" + "<b>" * n + "<li>x" * n, lambda n: "<table>" + "<tr><td>x" * n,
               lambda n: "<![" * n, lambda n: "<script>" + "</scr" * n, lambda n: "<div class=share>" * n + "x", lambda n: "&" * n,
               lambda n: "</" * n + ">", lambda n: "<a " + "=" * n + ">", lambda n: "<title>" + "</t" * n]
    for make in hostile:
        took = []
        for n in (20_000, 40_000):
            page, best = make(n), 9e9
            for _ in range(3):
                start = time.process_time()
                htmltext.main_text(page)
                best = min(best, time.process_time() - start)
            took.append(best)
        assert took[1] <= 2.5 * took[0] + 0.1, make(2)
    assert len(htmltext.main_text("<p>" + "word " * 200_000 + "<b>" * 50_000)) == 999_999

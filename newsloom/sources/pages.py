"""Page extraction (section B): jobs over a ``pages`` table (page_id, url, html).

Everything is a per-row expression over the html column (regex extraction,
split, higher-order functions): no shuffle, no Python.  Site rules are data --
a small ``source_rules`` table -- folded into one value per query, so adding a
site is adding a row (M2).  Patterns stay within the RE2 subset (no
look-around, no back-references) so the same expressions run in the oracle.
"""

from __future__ import annotations

import json
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import col, let

# ---- fixed values (must equal the reference's) ---------------------------------
NO_TITLE = "Sin título"
# Per-site link and content rules, in routing order (the first matching domain wins).
RULES = [
    dict(source="Xataka", domain="xataka.com", scope="article", first_only=True,
         prefix="https://www.xataka.com/", excludes=["/tag/"], content="div.article-content"),
    dict(source="Hugging Face Blog", domain="huggingface.co", prefix="/blog/", not_equal="/blog/",
         excludes=["/blog/community"], base="https://huggingface.co", content="div.prose, div.markdown",
         title_default=NO_TITLE),
    dict(source="TechCrunch", domain="techcrunch.com", scope="a.loop-card__title-link", prefix="https://techcrunch.com/"),
    dict(source="AWS Blog", domain="aws.amazon.com", scope="h2", prefix="https://aws.amazon.com/"),
    dict(source="Wired ES", domain="es.wired.com", prefix="/articulos/", base="https://es.wired.com"),
    dict(source="AI Business", domain="aibusiness.com", scope="h3.listing-title", prefix="/",
         base="https://aibusiness.com", content="div.article-content"),
    dict(source="Microsoft News (AI)", domain="news.microsoft.com", scope="div.listingResult", first_only=True,
         prefix="https://news.microsoft.com/", content="div.entry-content"),
    dict(source="OpenAI Blog", domain="openai.com", prefix="/es-ES/news/", min_slashes=3, base="https://openai.com"),
    dict(source="Allen AI", domain="allenai.org", prefix="/research/", alt_prefix="https://allenai.org/research/",
         not_equal="/research/", base="https://allenai.org", content="div.blog-post, div.content, article",
         title_default=NO_TITLE),
    dict(source="Microsoft AI", domain="microsoft.com", contains_any=["/202", "/20", "/article", "/post"],
         allowed=["microsoft.com", "azure.microsoft.com"],
         content="article, div.entry-content, div.post-content, div.content", title_default=NO_TITLE),
    dict(source="Google News", domain="news.google.com", contains_any=["article"], base="https://news.google.com"),
]
# Other rules for sites of the table above (the blog listing, and the earlier forms); they take the place of the
# site's row when a caller asks for them.
ALTERNATIVE_RULES = [
    dict(source="OpenAI", domain="openai.com", prefix="/blog/", not_equal="/blog", excludes=["?", "#"],
         base="https://openai.com", content="div.prose, div.article-content, article"),
    dict(source="TechCrunch (legacy)", domain="techcrunch.com", prefix="https://techcrunch.com/", contains_any=["/202"]),
    dict(source="AWS Blog (legacy)", domain="aws.amazon.com", scope="h2", first_only=True),
    dict(source="Xataka (legacy)", domain="xataka.com", scope="article", first_only=True),
    dict(source="Hugging Face (legacy)", domain="huggingface.co", prefix="/blog/", base="https://huggingface.co"),
]
# Content container per host (first match in document order), and the generic fallback.
CONTAINER_BY_HOST = {
    "openai.com": "div.prose, article",
    "deepmind.google": "div[class*='blog-post'], article",
    "anthropic.com": "div.content, article",
    "huggingface.co": "div.prose",
    "techcrunch.com": "div.article-content, div.post-content",
    "news.mit.edu": "div.entry-content",
    "ai.meta.com": "div.blog-content",
    "wired.com": "div.article__body",
    "aibusiness.com": "div.article-content",
}
GENERIC_CONTAINER = "article, main, .content, .post-content"
# Paragraph filters: minimum length (strict) and rejected content, by profile.
PARAGRAPH_PROFILES = {
    "short": dict(min_len=30, reject_prefix="Share"),
    "clean": dict(min_len=40, reject_terms=["copyright", "all rights reserved", "compartir en"]),
    "long": dict(min_len=50),
}
# -------------------------------------------------------------------------------

# generic rules for the hosts of the driver's ``pages`` table: keep site-relative links, base = the page itself
GENERIC_HOSTS = ["example.com", "example.net", "example.org"]

RULE_SCHEMA = ("source string, domain string, scope string, first_only boolean, prefix string, alt_prefix string, "
               "contains_any array<string>, excludes array<string>, not_equal string, min_slashes int, allowed array<string>, "
               "base string, content string, title_default string, ord int, scope_regex string, scope_tag string")
RULE_FIELDS = ["source", "domain", "scope", "first_only", "prefix", "alt_prefix", "contains_any", "excludes", "not_equal",
               "min_slashes", "allowed", "base", "content", "title_default"]

# the value of an href, with its quotes if it has any
LINK_PATTERN = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
QUOTES = "\"'"
ENTITY_PATTERN = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
NAMED_ENTITIES = {n: chr(c) for n, c in name2codepoint.items()} | {"apos": "'"}
NOISE_PATTERN = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
P_OPEN = r"(?i)<p(?:\s[^>]*)?>"
P_END = r"(?is)(?:</p\s*>|</article\s*>|</body\s*>).*$"
H1_PATTERN = r"(?is)<h1[^>]*>(.*?)</h1>"
OG_TITLE_PATTERNS = [r"""(?is)<meta[^>]*property\s*=\s*["']og:title["'][^>]*content\s*=\s*("[^"]*"|'[^']*')""",
                     r"""(?is)<meta[^>]*content\s*=\s*("[^"]*"|'[^']*')[^>]*property\s*=\s*["']og:title["']"""]


def rule_rows(extra: list[dict] | None = None, generic: bool = True, alternatives: bool = False) -> list[dict]:
    """Site rules in routing order; ``alternatives`` puts the other rules of their sites before them."""
    rows = (list(ALTERNATIVE_RULES) if alternatives else []) + list(RULES) + list(extra or [])
    return rows + [dict(source=h, domain=h, prefix="/") for h in GENERIC_HOSTS] if generic else rows


def source_rules(spark: SparkSession, extra: list[dict] | None = None, generic: bool = True,
                 alternatives: bool = False) -> DataFrame:
    """The rule table: real site rules, optional extra rows (M2), then generic rows for example hosts."""
    data = [_rule_row(r, i) for i, r in enumerate(rule_rows(extra, generic, alternatives))]
    return spark.createDataFrame(data, RULE_SCHEMA)


def _rule_row(rule: dict, order: int) -> tuple:
    opener, tag = _css_regex(rule["scope"]) if rule.get("scope") else (None, None)
    return tuple(rule.get(f, False if f == "first_only" else None) for f in RULE_FIELDS) + (order, opener and "(?is)" + opener, tag)


def register_source_rule(rules: DataFrame, rule: dict) -> DataFrame:
    """M2: plug a new site = append one row (it routes after the existing ones)."""
    spark = rules.sparkSession
    nxt = rules.select(F.coalesce(F.max("ord") + 1, F.lit(0))).first()[0]
    return rules.unionByName(spark.createDataFrame([_rule_row(rule, int(nxt))], RULE_SCHEMA))


# ---------------------------------------------------------------- scalar helpers

def _character(code: Column) -> Column:
    """The character of a code point, through its UTF-16 form."""
    four = lambda n: F.lpad(F.hex(n), 4, "0")
    high = F.lit(0xD800) + F.shiftright(code - 0x10000, 10)
    low = F.lit(0xDC00) + (code - 0x10000) % 1024
    units = F.when(code < 0x10000, four(code)).otherwise(F.concat(four(high), four(low)))
    valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(units), "UTF-16BE")).otherwise(F.lit("\ufffd"))


def unescape(c) -> Column:
    """Character references (named, decimal, hexadecimal) decoded once, from left to right; no-break spaces become
    spaces; anything that is not a reference stays."""
    names = F.from_json(F.lit(json.dumps(NAMED_ENTITIES)), "map<string,string>")  # one constant, folded once

    def decode(p: Column) -> Column:
        def replaced(m: Column) -> Column:
            char = (F.when(m.rlike("^#[xX]"), _character(F.conv(F.substr(m, F.lit(3)), 16, 10).cast("long")))
                    .when(m.startswith("#"), _character(F.substr(m, F.lit(2)).cast("long")))
                    .otherwise(F.try_element_at(names, m)))
            return F.when((m == "") | char.isNull(), F.concat(F.lit("&"), p)).otherwise(
                F.concat(char, F.substr(p, F.length(m) + 2)))
        return let(F.regexp_extract(p, ENTITY_PATTERN, 1), replaced)

    parts = F.split(col(c), "&", -1)
    done = let(parts, lambda x: F.concat(F.element_at(x, 1), F.array_join(F.transform(F.slice(x, 2, F.size(x)), decode), "")))
    return F.translate(F.when(col(c).contains("&"), done).otherwise(col(c)), "\u00a0", " ")


def tag_text(c) -> Column:
    """Text of an html fragment: tags -> spaces, entities decoded, whitespace collapsed, stripped."""
    return let(F.regexp_replace(col(c), r"<[^>]*>", " "), lambda t: F.trim(F.regexp_replace(unescape(t), r"\s+", " ")))


def strip_noise(c) -> Column:
    return F.regexp_replace(col(c), NOISE_PATTERN, " ")


def page_host(url) -> Column:
    return F.lower(F.try_parse_url(col(url), F.lit("HOST")))


def normalize_host(url) -> Column:
    """Host, lower case, 'www.' removed."""
    return F.regexp_replace(page_host(url), r"www\.", "")


def page_base(url) -> Column:
    """scheme://host of a page (base for site-relative links)."""
    return F.concat(F.try_parse_url(col(url), F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url(col(url), F.lit("HOST")))


def extract_links_array(html) -> Column:
    """Values of all hrefs (double-quoted, single-quoted or bare)."""
    return F.transform(F.regexp_extract_all(col(html), F.lit(LINK_PATTERN), 1), lambda x: F.btrim(x, F.lit(QUOTES)))


def _paragraphs(cleaned) -> Column:
    return let(F.split(col(cleaned), P_OPEN, -1), lambda parts: F.transform(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda s: tag_text(F.regexp_replace(s, P_END, ""))))


def paragraphs_array(html) -> Column:
    """Text of each <p>, in order (script/style/comments removed first; unclosed p ends at the next p)."""
    return _paragraphs(strip_noise(html))


def extract_title(html, default: str | None = NO_TITLE) -> Column:
    """First h1 text; else og:title; else the default."""
    h1 = F.nullif(tag_text(F.regexp_extract(col(html), H1_PATTERN, 1)), F.lit(""))
    ogs = [F.nullif(F.btrim(F.regexp_extract(col(html), p, 1), F.lit(QUOTES)), F.lit("")) for p in OG_TITLE_PATTERNS]
    out = F.coalesce(h1, F.nullif(F.trim(let(F.coalesce(*ogs), unescape)), F.lit("")))
    return F.coalesce(out, F.lit(default)) if default is not None else out


def _css_regex(sel: str) -> tuple[str, str]:
    """(opener regex, tag) for 'tag', 'tag.cls', '.cls' or "tag[class*='x']"; class values in any quoting."""
    sel = sel.strip()
    if "[class*=" in sel:
        tag, rest = sel.split("[", 1)
        frag = rest.split("=", 1)[1].strip("]'\" ")
        tag = tag or "div"
        return rf"""<{tag}\b[^>]*\sclass\s*=\s*(?:"[^"]*{frag}[^"]*"|'[^']*{frag}[^']*'|[^\s"'>]*{frag}[^\s"'>]*)[^>]*>""", tag
    if "." in sel:
        tag, cls = sel.split(".", 1)
        tag = tag or "div"
        return rf"""<{tag}\b[^>]*\sclass\s*=\s*(?:"(?:[^"]*\s)?{cls}(?:\s[^"]*)?"|'(?:[^']*\s)?{cls}(?:\s[^']*)?'|{cls}\b)[^>]*>""", tag
    return rf"<{sel}\b[^>]*>", sel


def _pieces(html, tag) -> Column:
    """The html cut before every opening and closing tag of that name."""
    name = tag if isinstance(tag, Column) else F.lit(tag)
    return F.split(col(html), F.concat(F.lit("(?i)(?=</?"), name, F.lit("\\b)")), F.lit(-1))


def _inner(pieces: Column) -> Column:
    """Inner html of the element that the first piece opens: a running depth over the tags of its name finds the
    closing tag, so nested elements stay whole; an unclosed element reaches to the end."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("closed"))

    def step(acc, p):
        depth = acc["depth"] + F.when(p.startswith("</"), -1).otherwise(1)
        return F.when(acc["closed"], acc).otherwise(
            F.struct(depth.alias("depth"), (acc["n"] + 1).alias("n"), (depth <= 0).alias("closed")))

    return let(F.aggregate(pieces, start, step), lambda e: F.regexp_replace(
        F.array_join(F.slice(pieces, F.lit(1), F.when(e["closed"], e["n"] - 1).otherwise(e["n"])), ""), r"^<[^>]*>", ""))


def first_element(html: Column, selector: str) -> Column:
    """(pos, inner) of the first element that matches a single selector; pos 0 if there is none."""
    opener, tag = _css_regex(selector)
    return let(F.regexp_instr(html, F.lit("(?is)" + opener)), lambda p: F.struct(p.alias("pos"), F.when(
        p > 0, let(_pieces(F.substr(html, p), tag), _inner)).alias("inner")))


def elements(html: Column, opener, tag) -> Column:
    """Inner html of every element whose opening tag matches ``opener``, in document order."""
    head = F.regexp_replace(opener, r"^\(\?is\)", "(?is)^") if isinstance(opener, Column) else F.lit("(?is)^" + opener)
    return let(_pieces(html, tag), lambda x: F.transform(
        F.filter(F.sequence(F.lit(1), F.size(x)), lambda i: F.rlike(F.element_at(x, i), head)),
        lambda i: let(F.slice(x, i, F.size(x)), _inner)))


def container_html(html, selector: str, by_priority: bool = False) -> Column:
    """Inner html of the first element (document order) matching any selector of a comma list, else null; with
    ``by_priority`` the first selector of the list that matches wins."""
    return let(strip_noise(html), lambda h: _container(h, selector, by_priority))


def _container(cleaned: Column, selector: str, by_priority: bool = False) -> Column:
    found = F.filter(F.array(*[first_element(cleaned, sel) for sel in selector.split(",")]), lambda s: s["pos"] > 0)
    return let(found, lambda f: F.when(F.size(f) > 0, F.element_at(f, 1)["inner"] if by_priority else F.array_min(f)["inner"]))


def dense_div(html, min_paragraphs: int = 3) -> Column:
    """First div whose inner html holds more than ``min_paragraphs`` paragraphs."""
    rich = F.filter(elements(strip_noise(html), r"<div\b[^>]*>", "div"), lambda d: F.regexp_count(d, F.lit(P_OPEN)) > min_paragraphs)
    return F.try_element_at(rich, F.lit(1))


def content_container(html, url) -> Column:
    """Container by host (lookup), generic fallback, then the first paragraph-rich div."""
    host = F.regexp_replace(F.try_parse_url(col(url), F.lit("HOST")), r"www\.", "")
    by_host = None
    for h, sel in CONTAINER_BY_HOST.items():
        c = container_html(html, sel)
        by_host = F.when(host == h, c) if by_host is None else by_host.when(host == h, c)
    generic = container_html(html, GENERIC_CONTAINER)
    picked = by_host.otherwise(generic)
    return F.coalesce(picked, dense_div(html))


def filter_paragraphs(paras, profile: str = "clean") -> Column:
    """Keep paragraphs passing a profile's length / content rules."""
    p = PARAGRAPH_PROFILES[profile]

    def keep(t):
        cond = F.length(t) > p["min_len"]
        if "reject_prefix" in p:
            cond = cond & ~t.startswith(p["reject_prefix"])
        for term in p.get("reject_terms", []):
            cond = cond & ~F.lower(t).contains(term)
        return cond
    return F.filter(col(paras), keep)


# ---------------------------------------------------------------- table operators

def _rules_value(rules: DataFrame) -> Column:
    """All rules as one sorted array value (a lookup table of one row per site)."""
    return rules.select(F.sort_array(F.collect_list(F.struct("ord", *RULE_FIELDS, "scope_regex", "scope_tag"))).alias("rs")).scalar()


def route_url_to_source(df: DataFrame, rules: DataFrame, url_col: str = "url", out: str = "source",
                        keep_rule: bool = False) -> DataFrame:
    """The first rule (by ord) whose domain is contained in the url's host, case-insensitive; no match -> dropped."""
    d = df.withColumn("_rs", _rules_value(rules)).withColumn("_host", page_host(url_col))
    hit = F.filter("_rs", lambda r: F.col("_host").contains(F.lower(r["domain"])))
    d = d.withColumn("_rule", F.try_element_at(hit, F.lit(1))).where(F.col("_rule").isNotNull())
    d = d.withColumn(out, F.col("_rule.source")).drop("_rs", "_host")
    return d if keep_rule else d.drop("_rule")


def extract_links(pages: DataFrame) -> DataFrame:
    """B1: (page_id, pos, href) for every link of every page, in page order."""
    return pages.select("page_id", F.posexplode(extract_links_array("html")).alias("pos", "href"))


def _rule_keep(href: Column, rule: Column) -> Column:
    cond = F.coalesce(href.startswith(rule["prefix"]), F.lit(True)) | F.coalesce(href.startswith(rule["alt_prefix"]), F.lit(False))
    cond = cond & F.coalesce(F.exists(rule["contains_any"], lambda s: href.contains(s)), F.lit(True))
    cond = cond & ~F.coalesce(F.exists(rule["excludes"], lambda s: href.contains(s)), F.lit(False))
    cond = cond & F.coalesce(href != rule["not_equal"], F.lit(True))
    cond = cond & F.coalesce(F.regexp_count(href, F.lit("/")) > rule["min_slashes"], F.lit(True))
    return cond


def resolve(href: Column, base: Column, relative: Column | None = None) -> Column:
    """A site-relative href gets the base prepended, ./x counts as /x; a bare one too where ``relative`` holds."""
    out = F.when(href.startswith("/"), F.concat(base, href)).when(href.startswith("./"), F.concat(base, F.substr(href, F.lit(2))))
    if relative is not None:
        out = out.when(relative & ~href.startswith("http"), F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), href))
    return out.otherwise(href)


def _scope_links(cleaned: Column, opener, tag, first_only: Column) -> Column:
    """Links of each container (arrays); a container that is the link itself gives its own."""
    name = tag if isinstance(tag, Column) else F.lit(tag)
    pattern = opener if isinstance(opener, Column) else F.lit("(?is)" + opener)
    chunks = F.when(name == "a", F.regexp_extract_all(cleaned, pattern, F.lit(0))).otherwise(elements(cleaned, opener, tag))
    return F.transform(chunks, lambda c: let(extract_links_array(c), lambda x: F.when(
        first_only, F.slice(x, 1, 1)).otherwise(x)))


def rule_links(html: Column, rule: Column) -> Column:
    """The candidate links of a page under its rule: all links, or those inside the rule's containers (the first
    of each container when the rule says so).  The container pattern is a per-rule column (rules are data)."""
    scoped = let(strip_noise(html), lambda h: F.flatten(_scope_links(h, rule["scope_regex"], rule["scope_tag"], rule["first_only"])))
    return F.when(rule["scope_regex"].isNull(), extract_links_array(html)).otherwise(scoped)


def _kept_links(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, source, pos, href, link): links that pass the rule's predicates, resolved, in an allowed domain."""
    routed = route_url_to_source(pages, rules, keep_rule=True)
    ex = routed.select("page_id", "url", "source", "_rule",
                       F.posexplode(rule_links(F.col("html"), F.col("_rule"))).alias("pos", "href"))
    rule = F.col("_rule")
    ex = ex.where(_rule_keep(F.col("href"), rule))
    base = F.coalesce(rule["base"], page_base("url"))
    ex = ex.withColumn("link", resolve(F.col("href"), base, rule["allowed"].isNotNull()))
    return ex.where(F.coalesce(F.exists(rule["allowed"], lambda d: F.col("link").contains(d)), F.lit(True)))


def filter_links_by_rule(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """B2: links kept by the rule of the page's site (scope, then predicates) -> (page_id, source, pos, href)."""
    return _kept_links(pages, rules).select("page_id", "source", "pos", "href")


def resolve_links(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Kept links made absolute with the rule's base (or the page's own scheme and host)."""
    return _kept_links(pages, rules).select("page_id", "source", "pos", "link")


def scoped_links(pages: DataFrame, scope: str, first_only: bool = True) -> DataFrame:
    """Links inside a container (first link per container, or all) -> (page_id, container_pos, pos, href)."""
    opener, tag = _css_regex(scope)
    per = let(strip_noise(F.col("html")), lambda h: _scope_links(h, opener, tag, F.lit(first_only)))
    ex = pages.select("page_id", F.posexplode(per).alias("container_pos", "links"))
    return ex.select("page_id", "container_pos", F.posexplode("links").alias("pos", "href"))


def link_dedupe(links: DataFrame, key: str = "page_id", url_col: str = "href", pos_col: str = "pos") -> DataFrame:
    """Distinct links per page keeping the first position (order-keeping variant)."""
    return links.groupBy(key, url_col).agg(F.min(pos_col).alias(pos_col))


def build_articles(pages: DataFrame, rules: DataFrame, as_of: str, paragraph_profile: str | None = None) -> DataFrame:
    """(page_id, source, url, title, content, scraping_date); pages without a title or paragraphs are dropped.

    Title: h1, or the rule's default; content: the rule's container paragraphs (all paragraphs when the rule has
    no container), joined by one space (B8).
    """
    routed = route_url_to_source(pages, rules, keep_rule=True)

    def article(h: Column) -> Column:
        """Title and paragraphs of one page whose noise is stripped already."""
        by_source = {r["source"]: r["content"] for r in RULES + ALTERNATIVE_RULES if r.get("content")}
        part = F.when(F.lit(False), h)
        for content in dict.fromkeys(by_source.values()):
            part = part.when(F.col("source").isin([s for s, c in by_source.items() if c == content]), _container(h, content))
        chosen = let(part.otherwise(h), _paragraphs)
        if paragraph_profile:
            chosen = filter_paragraphs(chosen, paragraph_profile)
        title = F.coalesce(extract_title("html", None), F.col("_rule.title_default"))
        return F.struct(title.alias("title"), chosen.alias("paras"))

    # the filter sits in the generator, on the bound struct: a filter above it would be pushed down and parse twice
    whole = F.filter(F.array(let(strip_noise("html"), article)), lambda x: x["title"].isNotNull() & (F.size(x["paras"]) > 0))
    return (routed.select("page_id", "source", "url", F.inline(whole))
            .select("page_id", "source", "url", "title", F.array_join("paras", " ").alias("content"),
                    F.lit(as_of).cast("timestamp").alias("scraping_date")))

"""DuckDB twins of the fixture views, used to build the oracle SQL of every query.

``with_views(body, *names)`` prepends the CTEs a query body needs (with their
dependencies, in order).  Only the driver tables are assumed to exist.
"""

from __future__ import annotations

from ..operators.scoring import DEFAULT_SOURCE_WEIGHT, SOURCE_WEIGHTS
from .fixtures import AREA_PROFILES, FIXTURE_SOURCES, LISTING, LISTING_HOSTS

AS_OF_SQL = "TIMESTAMP '2024-04-01 00:00:00'"

_VIEWS: dict[str, tuple[list[str], str]] = {}


def view(name: str, deps: list[str], sql: str):
    _VIEWS[name] = (deps, sql)


def with_views(body: str, *names: str) -> str:
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in _VIEWS[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS MATERIALIZED (\n{_VIEWS[n][1]}\n)" for n in order)
    stripped = body.lstrip()
    if stripped[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{stripped[5:]}"
    return f"WITH {ctes}\n{body}"


def unit(v: str) -> str:
    """DuckDB: unit-length copy of a DOUBLE[] (zero stays zero)."""
    # the norm is bound once (a one-element list), not computed per element
    return (f"list_transform([{{'v': {v}, 'n': sqrt(list_dot_product({v}, {v}))}}], "
            "lambda s: CASE WHEN s.n > 0 THEN list_transform(s.v, lambda x: x / s.n) ELSE s.v END)[1]")


def cosine(a: str, b: str) -> str:
    return (f"(CASE WHEN list_dot_product({a}, {a}) * list_dot_product({b}, {b}) > 0 THEN "
            f"list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))) ELSE 0.0 END)")


def mean_vec_sql(src: str, keys: str, vec: str) -> str:
    """Element-wise mean of ``vec`` per ``keys`` over relation ``src``; output (keys..., m)."""
    return f"""SELECT {keys}, list(val ORDER BY i) AS m FROM (
  SELECT {keys}, i, avg(x) AS val FROM (
    SELECT {keys}, unnest(range(1, len({vec}) + 1)) AS i, unnest({vec}) AS x FROM {src}
  ) GROUP BY ALL
) GROUP BY ALL"""


WORD_COUNT_SQL = "CAST(len(list_filter(regexp_split_to_array({c}, '\\s+'), lambda t: t <> '')) AS BIGINT)"


def word_count(c: str) -> str:
    return WORD_COUNT_SQL.format(c=c)


def preprocess(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '\\s+', ' ', 'g'))"


# ---- fixture views -------------------------------------------------------------------------------------------
view("articles_v", [], f"""  SELECT d.doc_id,
    [{", ".join("'" + x + "'" for x in FIXTURE_SOURCES)}][1 + CAST(substr(d.source, 4) AS INTEGER) % 6] AS source,
    'https://' || d.source || '.example.org/' || CAST(d.doc_id AS VARCHAR) AS url,
    string_split(d.text, chr(10))[1] AS title,
    d.text AS content, d.lang AS language,
    TIMESTAMP '2024-01-01 08:00:00' + to_days(CAST(d.doc_id % 90 AS INTEGER)) + to_hours(CAST(d.doc_id % 13 AS INTEGER)) AS scraping_date
  FROM documents d""")

def _str(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


view("listing_v", [], f"""  SELECT page_id, 'https://' || [{", ".join(_str(h) for h in LISTING_HOSTS)}][1 + page_id % {len(LISTING_HOSTS)}] || '/list' AS url,
    replace({_str(LISTING)}, '@', CAST(page_id AS VARCHAR)) || html AS html FROM pages""")

view("pages_v", [], """  SELECT page_id, CASE WHEN page_id % 13 = 0 THEN 'https://unknown.test/x' ELSE url END AS url,
    CASE WHEN page_id % 11 = 0 THEN replace(h, '<p>', '<q>') ELSE h END AS html FROM (
      SELECT page_id, url, CASE WHEN page_id % 7 = 0 THEN n
        WHEN page_id % 5 = 0 THEN '<meta content=' || chr(39) || '&quot;OG&quot; ' || CAST(page_id AS VARCHAR) || chr(39) || ' property=' || chr(39) || 'og:title' || chr(39) || '>' || n
        ELSE html END AS h
      FROM (SELECT *, replace(replace(html, '<h1>', '<h9>'), '</h1>', '</h9>') AS n FROM pages))""")

def source_weight(c: str) -> str:
    whens = " ".join(f"WHEN {_str(k)} THEN {v}" for k, v in SOURCE_WEIGHTS.items())
    return f"CAST(CASE {c} {whens} ELSE {DEFAULT_SOURCE_WEIGHT} END AS DOUBLE)"


view("emb_count", [], "  SELECT count(*) AS n FROM embeddings")

view("vec_v", ["articles_v"], """  SELECT a.doc_id, e.label AS cluster, CAST(e.embedding AS DOUBLE[]) AS v
  FROM articles_v a JOIN embeddings e ON e.vec_id = a.doc_id % (SELECT count(*) FROM embeddings)""")

view("norm_v", ["articles_v"], f"""  SELECT *, (word_count > 150 AND language IN ('es', 'en')) AS is_valid FROM (
    SELECT *, CAST(length(content) AS BIGINT) AS content_length, {word_count('content')} AS word_count FROM articles_v)""")

view("valid_v", ["norm_v"], "  SELECT * FROM norm_v WHERE is_valid")

view("valid_vec_v", ["valid_v"], """  SELECT a.*, e.label AS cluster, CAST(e.embedding AS DOUBLE[]) AS v
  FROM valid_v a JOIN embeddings e ON e.vec_id = a.doc_id % (SELECT count(*) FROM embeddings)""")

view("centroids_v", [], "  " + mean_vec_sql("(SELECT label AS cluster, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)",
                                               "cluster", "v").replace("list(val ORDER BY i) AS m", "list(val ORDER BY i) AS centroid"))

def md5_encoded(src: str, key: str, text: str, dim: int, where: str = "true") -> str:
    """(key, i, x): non-zero entries of the unit vectors of the MD5 word encoder over a relation."""
    return f"""SELECT {key}, i, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS x FROM (
    SELECT {key}, CAST(concat('0x', substr(md5(t), 1, 7)) AS BIGINT) % {dim} AS i, CAST(count(*) AS DOUBLE) AS n FROM (
      SELECT {key}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) AS t FROM {src} WHERE {where}) GROUP BY ALL)"""


_PROFILES = ", ".join(f"({i}, {_str(a)}, {_str(t)})" for i, (a, t) in enumerate(AREA_PROFILES.items()))
view("profiles_v", [], f"  SELECT * FROM (VALUES {_PROFILES}) AS t(ord, area, text)")


def area_sql(articles: str, dims: list[int]) -> str:
    """(doc_id, area): the profile most similar on average over MD5 encoders of these widths; ties go to the first."""
    text = preprocess("title || '. ' || content")
    sims = " UNION ALL ".join(f"""SELECT d.doc_id, p.ord, sum(d.x * p.x) AS sim FROM ({md5_encoded(articles, "doc_id", text, n)}) d
    JOIN ({md5_encoded("profiles_v", "ord", "text", n)}) p USING (i) GROUP BY ALL""" for n in dims)
    return f"""  SELECT a.doc_id, first(p.area ORDER BY round(coalesce(s.sim, 0), 12) DESC, p.ord ASC) AS area
  FROM {articles} a CROSS JOIN profiles_v p
  LEFT JOIN (SELECT doc_id, ord, sum(sim) / {len(dims)} AS sim FROM ({sims}) GROUP BY ALL) s ON s.doc_id = a.doc_id AND s.ord = p.ord
  GROUP BY a.doc_id"""


view("processed_v", ["articles_v"], "  SELECT url FROM articles_v WHERE doc_id % 3 = 0")

view("feedback_v", ["articles_v"], """  SELECT e.event_id, a.url,
    CASE WHEN e.event_type IN ('click', 'purchase', 'signup') THEN 'thumb_up' WHEN e.event_type = 'error' THEN 'thumb_down' ELSE 'view' END AS rating,
    CAST(e.ts AS TIMESTAMP) AS ts
  FROM events e LEFT JOIN articles_v a ON a.doc_id = e.user_id""")

# cluster means of unit vectors over valid articles
view("valid_unit_v", ["valid_vec_v"], f"  SELECT doc_id, cluster, {unit('v')} AS u FROM valid_vec_v")
view("valid_cmean_v", ["valid_unit_v"], "  " + mean_vec_sql("valid_unit_v", "cluster", "u"))

view("text_cents_v", ["articles_v"], f"""  SELECT CAST(doc_id % 6 AS INTEGER) AS g, i, sum(x) / any_value(n) AS c
  FROM ({md5_encoded("articles_v", "doc_id", preprocess("title || '. ' || content"), 64)})
  JOIN (SELECT doc_id % 6 AS r, count(*) AS n FROM articles_v GROUP BY ALL) z ON z.r = doc_id % 6 GROUP BY ALL""")


def assigned(src: str, key: str) -> str:
    """CTE asg (key, cluster, similarity_to_centroid, novelty_score) of a relation with title and content: nearest fixed
    centroid, cosine to it, and novelty against the members of the same cluster within the relation."""
    return f"""ev AS MATERIALIZED ({md5_encoded(src, key, preprocess("title || '. ' || content"), 64)}),
vn AS (SELECT {key}, sum(x * x) AS vv FROM ev GROUP BY ALL),
cn AS (SELECT g, sum(c * c) AS cc FROM text_cents_v GROUP BY g),
dt AS (SELECT {key}, g, sum(x * c) AS dot FROM ev JOIN text_cents_v USING (i) GROUP BY ALL),
near AS MATERIALIZED (SELECT {key}, g AS cluster, dot / sqrt(vv * cc) AS similarity_to_centroid FROM (
  SELECT vn.{key}, cn.g, coalesce(dot, 0) AS dot, vv, cc, row_number() OVER (
    PARTITION BY vn.{key} ORDER BY round(vv - 2 * coalesce(dot, 0) + cc, 12), cn.g) AS r
  FROM vn CROSS JOIN cn LEFT JOIN dt ON dt.{key} = vn.{key} AND dt.g = cn.g) WHERE r = 1),
mu AS (SELECT cluster, i, sum(x) / any_value(n) AS m FROM ev JOIN near USING ({key})
  JOIN (SELECT cluster, count(*) AS n FROM near GROUP BY cluster) USING (cluster) GROUP BY ALL),
asg AS (SELECT near.{key}, near.cluster, any_value(similarity_to_centroid) AS similarity_to_centroid, 1 - sum(x * m) AS novelty_score
  FROM near JOIN ev USING ({key}) JOIN mu ON mu.cluster = near.cluster AND mu.i = ev.i GROUP BY ALL)"""


view("area_v", ["valid_vec_v", "profiles_v"], area_sql("valid_vec_v", [64]))

view("scored_v", ["valid_vec_v", "valid_cmean_v", "centroids_v", "area_v"], f"""  SELECT b.doc_id, b.source, b.url, b.title, b.content, b.language, b.scraping_date, b.cluster, b.word_count,
    b.content_length, b.v,
    {source_weight('b.source')} AS source_score,
    exp(-floor((epoch_us({AS_OF_SQL}) - epoch_us(b.scraping_date)) / 86400000000) / 30.0) AS recency_score,
    1.0 - list_dot_product({unit('b.v')}, m.m) AS novelty_score,
    {cosine('b.v', 'c.centroid')} AS similarity_to_centroid,
    ar.area
  FROM valid_vec_v b JOIN valid_cmean_v m USING (cluster) LEFT JOIN centroids_v c USING (cluster)
  JOIN area_v ar USING (doc_id)""")

view("final_v", ["scored_v"], """  SELECT *, 0.4 * similarity_to_centroid + 0.3 * novelty_score + 0.2 * recency_score + 0.1 * source_score AS final_score
  FROM scored_v""")

# three 'models' per vector: v, reversed, rotated by one + re-weighted + normalized
_M3 = "list_transform(v[2:] || v[1:1], lambda x, i: x * (1 + (i - 1) % 3))"
view("emb_models_v", [], f"""  SELECT vec_id AS doc_id, 'm1' AS model, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  UNION ALL SELECT vec_id, 'm2', list_reverse(CAST(embedding AS DOUBLE[])) FROM embeddings
  UNION ALL SELECT vec_id, 'm3', {unit('w')} FROM (SELECT vec_id, {_M3.replace('v[', 'CAST(embedding AS DOUBLE[])[')} AS w FROM embeddings)""")

view("valid_models_v", ["valid_vec_v"], f"""  SELECT doc_id, 'm1' AS model, v FROM valid_vec_v
  UNION ALL SELECT doc_id, 'm2', list_reverse(v) FROM valid_vec_v
  UNION ALL SELECT doc_id, 'm3', {unit('w')} FROM (SELECT doc_id, {_M3} AS w FROM valid_vec_v)""")


def title_case_sql(c: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({c}, '(\\p{{L}}+|[^\\p{{L}}]+)'), "
            "lambda p: (CASE WHEN substr(p, 1, 1) = chr(223) THEN 'Ss' ELSE upper(substr(p, 1, 1)) END) || lower(substr(p, 2))), '')")


def _terms_views():
    from ..functions.stopwords import sql_list

    view("g_clean", ["valid_vec_v"], f"""  SELECT doc_id, cluster, CASE
      WHEN language = 'en' THEN array_to_string(list_filter(regexp_extract_all(lower(content), '\\p{{L}}+'), lambda t: NOT list_contains({sql_list('en')}, t)), ' ')
      WHEN language = 'es' THEN array_to_string(list_filter(regexp_extract_all(lower(content), '\\p{{L}}+'), lambda t: NOT list_contains({sql_list('es')}, t)), ' ')
      ELSE '' END AS text_tfidf
  FROM valid_vec_v""")
    view("g_terms", ["g_clean"], """  SELECT doc_id, cluster, t1 || list_transform(range(1, len(t1)), lambda i: t1[i] || ' ' || t1[i + 1]) AS terms
  FROM (SELECT doc_id, cluster, regexp_extract_all(text_tfidf, '[\\p{L}\\p{N}_]{2,}') AS t1 FROM g_clean)""")
    view("g_vocab", ["g_terms"], """  SELECT term, df, n AS n_docs, ln((1 + n) / (1 + df)) + 1 AS idf
  FROM (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(terms) AS term FROM g_terms) GROUP BY term),
       (SELECT count(*) AS n FROM g_terms)
  WHERE df >= 5 AND df <= 0.9 * n""")
    view("g_tfidf", ["g_vocab"], """  SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM (
    SELECT doc_id, term, tf * idf AS w FROM (
      SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM g_terms) GROUP BY ALL
    ) JOIN g_vocab USING (term))""")
    view("g_scores", ["g_tfidf"], """  SELECT cluster, term, sum(weight) / any_value(sz) AS score
  FROM g_tfidf JOIN (SELECT doc_id, cluster FROM g_terms) USING (doc_id)
  JOIN (SELECT cluster, count(*) AS sz FROM g_terms GROUP BY cluster) USING (cluster)
  GROUP BY cluster, term""")
    view("g_top", ["g_scores"], """  SELECT * FROM (SELECT cluster, term, score,
    row_number() OVER (PARTITION BY cluster ORDER BY round(score, 12) DESC, term) AS rank FROM g_scores) WHERE rank <= 10""")
    view("g_names", ["g_top"], f"""  SELECT cluster, {title_case_sql("string_agg(term, ' / ' ORDER BY rank)")} AS cluster_name
  FROM g_top WHERE rank <= 3 GROUP BY cluster""")


_terms_views()

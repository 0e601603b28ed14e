"""DuckDB formulation of the k search: the same seeds, the same fixed points, scores from their definition."""

from __future__ import annotations

from ..operators.ksearch import SEED_ROWS, TOLERANCE
from .oracle import unit


def fits(points: str, ks: list[int]) -> str:
    """CTEs pts (id, v), fits (k, cents) and own (k, id, v, j): recursive seeding and recursive centre updates.

    ``points``: SQL of (id, v DOUBLE[]).  The text starts after ``WITH RECURSIVE``.
    """
    top = max(ks)
    return f"""pts AS MATERIALIZED ({points}),
smp AS MATERIALIZED (SELECT * FROM (SELECT row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR)), id) AS i, v FROM pts)
  WHERE i <= {max(SEED_ROWS, top)}),
dist AS MATERIALIZED (SELECT c.i, any_value(c.v) AS v,
    list(list_sum(list_transform(list_zip(c.v, p.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) ORDER BY p.i) AS r
  FROM smp c CROSS JOIN smp p GROUP BY c.i),
seeds(n, chosen, near) AS (
  SELECT 0, CAST([] AS DOUBLE[][]), CAST(list_transform(range({max(SEED_ROWS, top)}), lambda x: 1e300) AS DOUBLE[])
  UNION ALL
  SELECT n + 1, list_append(chosen, b.v), b.near FROM (
    SELECT n, chosen, arg_min({{'v': v, 'near': near}}, {{'p': list_sum(near), 'i': i}}) AS b FROM (
      SELECT s.n, s.chosen, d.i, d.v, list_transform(list_zip(s.near[1:len(d.r)], d.r), lambda z: least(z[1], z[2])) AS near
      FROM seeds s, dist d WHERE s.n < {top})
    GROUP BY n, chosen)),
lloyd(k, it, cents, moved) AS (
  SELECT k, 0, chosen[1:k], 1e300 FROM (SELECT chosen FROM seeds WHERE n = {top}), (SELECT unnest({list(ks)}) AS k)
  UNION ALL
  SELECT k, it + 1, new, list_max(list_transform(list_zip(cents, new), lambda z: list_distance(z[1], z[2]))) FROM (
    SELECT l.k, l.it, any_value(l.cents) AS cents, list(coalesce(m.c, l.cents[j.j]) ORDER BY j.j) AS new
    FROM lloyd l JOIN (SELECT unnest(range(1, {top + 1})) AS j) j ON j.j <= l.k
    LEFT JOIN (SELECT k, j, list(x ORDER BY pos) AS c FROM (SELECT k, j, pos, avg(x) AS x FROM (
        SELECT k, list_position(dl, list_min(dl)) AS j, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS pos FROM (
          SELECT l.k, p.v, list_transform(l.cents, lambda c: list_distance(p.v, c)) AS dl FROM lloyd l, pts p
          WHERE l.moved > {TOLERANCE}))
        GROUP BY k, j, pos) GROUP BY k, j) m ON m.k = l.k AND m.j = j.j
    WHERE l.moved > {TOLERANCE} GROUP BY l.k, l.it)),
fits AS MATERIALIZED (SELECT CAST(k AS INTEGER) AS k, arg_max(cents, it) AS cents FROM lloyd GROUP BY k),
own AS MATERIALIZED (SELECT k, id, v, list_position(dl, list_min(dl)) AS j, list_min(dl) AS d FROM (
  SELECT f.k, p.id, p.v, list_transform(f.cents, lambda c: list_distance(p.v, c)) AS dl FROM fits f, pts p))"""


def scores(points: str, ks: list[int]) -> str:
    """The CTEs of ``fits`` and scores (k, silhouette, best): cosine silhouettes, best with ties to the smallest k."""
    return f"""{fits(points, ks)},
un AS MATERIALIZED (SELECT k, id, j, {unit('v')} AS u FROM own),
mean AS MATERIALIZED (SELECT k, j, list(x ORDER BY pos) AS m, any_value(n) AS n FROM (
  SELECT k, j, pos, avg(x) AS x, count(*) AS n FROM (SELECT k, j, unnest(u) AS x, unnest(range(1, len(u) + 1)) AS pos FROM un)
  GROUP BY k, j, pos) GROUP BY k, j),
away AS (SELECT un.k, un.id, un.j AS own, m.j, m.n, 1 - list_dot_product(un.u, m.m) AS d FROM un JOIN mean m ON m.k = un.k),
each AS (SELECT k, id, max(n) FILTER (j = own) AS n, max(d * n / greatest(n - 1, 1)) FILTER (j = own) AS a, min(d) FILTER (j <> own) AS b
  FROM away GROUP BY k, id),
scores AS MATERIALIZED (SELECT k, avg(CASE WHEN n > 1 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END) AS silhouette
  FROM each GROUP BY k),
best AS (SELECT arg_min(k, {{'s': -silhouette, 'k': k}}) AS best_k FROM scores)"""
